"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed to WIDTH cells. The raw model counts all documents, the target model a bounded sample of
the labelled ones (TARGET documents of quality 1 and toxic 0, chosen by a hash of doc_id); it has two folds, so that no
document is weighed by a model of itself. A document's log weight is the
sum over its n-grams of log(p_target / p_raw). Adding Gumbel noise, a hash of the document, and keeping the k largest is a
sample without replacement in proportion to the weights. k is the share of labelled rows that are target rows, of all rows.

Null or empty text has no n-gram: a null log weight, never sampled. Rows with equal keys (repeated rows) are in or out
together, so that k is a lower bound then. Without labels every weight is 0. A null doc_id is scored like others.
Columns other than (doc_id, text) and (doc_id, quality, toxic) are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, saved, segments_of, summed, uniform
from loregraph.llm.wordhash import chunks, grams, words

WIDTH, TARGET = 1 << 18, 20_000
#: The target model starts from so many n-grams of each cell as the raw model expects: rare n-grams say little.
PRIOR = 8.0
#: Bins a pass, and keys that the driver sees at most, when the k-th largest key is looked for.
BINS, SEEN = 1024, 1000


def _cells(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all words and word pairs, and the text of each."""
    hashes, text, _, _ = words(data, bounds)
    pairs, at = grams(hashes, text, 2)
    return (np.concatenate([hashes, pairs]) & np.uint64(WIDTH - 1)).astype(np.int64), np.concatenate([text, text[at]])


def target_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that the target model is fitted on, TARGET at most."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET)


def _marked(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, fold): fold is 0 or 1 for the documents of the target model, else 2."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folds = picked.select("doc_id", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int").alias("fold"))
    return slim.join(F.broadcast(folds), "doc_id", "left").select("doc_id", "text", F.coalesce("fold", F.lit(2)).alias("fold"))


def log_ratios(marked: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each cell; p_target has the raw model as a prior. Row 0 is for the documents of fold 0 and
    has the target model of fold 1, row 1 the other way round, row 2 is for all others and has both folds."""

    def run(tables):
        counts = np.zeros((3, WIDTH), np.int64)
        for batch in tables:
            fold = batch.column("fold").to_numpy()
            for at, data, bounds in chunks(batch.column("text")):
                cell, text = _cells(data, bounds)
                own = fold[at + text]
                for f in (0, 1):
                    if (own == f).any():
                        counts[f] += np.bincount(cell[own == f], minlength=WIDTH)
                counts[2] += np.bincount(cell, minlength=WIDTH)
        yield from (pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([c], pa.binary())], names=["segment", "cells"]) for s, c in segments_of(counts.reshape(-1)))

    a, b, raw = summed(marked.select("text", "fold").mapInArrow(run, "segment long, cells binary"), 3 * WIDTH).reshape(3, WIDTH)
    share = raw / max(1, raw.sum())
    return np.array([np.log((t + PRIOR) / (share * t.sum() + PRIOR)) if t.any() else np.zeros(WIDTH) for t in (b, a, a + b)])


def log_weights(marked: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) per row of marked."""
    sent = marked.sparkSession.sparkContext.broadcast(ratios)
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(tables):
        ratio = sent.value
        for batch in tables:
            fold = batch.column("fold").to_numpy()
            for at, data, bounds in chunks(batch.column("text")):
                cell, text = _cells(data, bounds)
                n = len(bounds) - 1
                count = np.bincount(text, minlength=n)
                total = np.bincount(text, weights=ratio[fold[at + text], cell], minlength=n)
                yield batches(schema, [batch.column("doc_id").slice(at, n), count, pa.array(total, mask=count == 0)])

    return marked.mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of values(x): ever finer histograms, so that neither driver nor task gets them all."""
    values = values.where("x is not null")
    edge = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    if not edge.n or k < 1:
        return None
    if k >= edge.n:
        return edge.lo
    lo, hi = edge.lo, edge.hi
    while True:
        own = values.where((F.col("x") >= lo) & (F.col("x") <= hi))
        bins = own.groupBy(F.least(F.floor((F.col("x") - lo) / ((hi - lo) or 1.0) * BINS), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if k <= b.n:
                break
            k -= b.n
        if b.lo == b.hi or k == 1:
            return b.hi
        lo, hi = b.lo, b.hi
        if b.n <= SEEN:
            rest = sorted((r.x for r in values.where((F.col("x") >= lo) & (F.col("x") <= hi)).collect()), reverse=True)
            return rest[k - 1]


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n_grams, log_weight, gumbel_key, selected. share: of the rows that is sampled."""
    if share is None:
        got = labels.agg(F.avg(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1.0).otherwise(0.0))).first()[0]
        share = 1.0 if got is None else got
    marked = _marked(docs, saved(target_ids(labels)))
    scored = log_weights(marked, log_ratios(marked))
    noise = -F.log(-F.log(uniform("doc_id", "n_grams", seed=seed)))
    keyed = saved(scored.withColumn("gumbel_key", F.col("log_weight") + noise))
    edge = kth_largest(keyed.select(F.col("gumbel_key").alias("x")), round(share * keyed.count()))
    return keyed.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(edge), F.lit(False)))
