"""The control retriever: BM25 and cosine scores of chunks, top k behind the same gate.

chunks: chunk_id, corpus_id, global_index, label, text (or a vector). queries: corpus_id, query_id, read_point, text (or a vector).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.tables import saved
from loregraph.functions.text import tokens

K1, B, TOP = 1.5, 0.75, 6
#: Words of a query by which the first chunks are picked, and how many for each of the k.
LEAD, PICKED = 8, 8
#: Query vectors that go to every executor at once (numbers); more are split into blocks.
SENT_NUMBERS = 4_000_000
#: Words of queries that go to every executor at once (rows); more are joined by a shuffle.
SENT_WORDS = 500_000


def bm25_index(chunks: DataFrame, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, stats). postings(corpus_id, chunk_id, term, tf, n_tokens), of the vocabulary(term) if one is given;
    stats(corpus_id, term, idf, avg_len). Lengths and frequencies are of all chunks, hidden ones too."""
    cut = chunks.select("corpus_id", "chunk_id", tokens(F.col("text")).alias("t")).withColumn("n_tokens", F.size("t"))
    totals = cut.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg_len"))
    rows = cut.select("corpus_id", "chunk_id", "n_tokens", F.explode("t").alias("term"))
    if vocabulary is not None:
        rows = rows.join(_sent(vocabulary.select("term").distinct(), vocabulary), "term", "left_semi")
    postings = rows.groupBy("corpus_id", "chunk_id", "n_tokens", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("corpus_id", "term").agg(F.count("*").alias("df")).join(totals, "corpus_id")
    return postings, df.select("corpus_id", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")


def _sent(df: DataFrame, sized: DataFrame) -> DataFrame:
    """df, sent to all executors if `sized` has few rows."""
    return F.broadcast(df) if sized.limit(SENT_WORDS + 1).count() <= SENT_WORDS else df


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("corpus_id", "query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("corpus_id", "query_id", "term").agg(F.count("*").alias("times"))


def _weight(k1: float, b: float) -> Column:
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("avg_len")))


def _weights(chunks: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(corpus_id, chunk_id, term, weight): what each word of the queries is worth in each chunk that has it."""
    postings, stats = bm25_index(chunks, asked)
    return postings.join(stats, ["corpus_id", "term"]).select("corpus_id", "chunk_id", "term", _weight(k1, b).alias("weight"))


def bm25_score(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(corpus_id, query_id, chunk_id, score) of the chunks with a query word; a repeated word counts each time."""
    asked = saved(_asked(queries))
    # Texts are dealt out by chunk, once; what follows meets small tables and stays where it is, so that a row a word, query and chunk,
    # of which there are far more than results, is never dealt out.
    postings, stats = bm25_index(chunks.repartition("corpus_id", "chunk_id"), asked)
    words = saved(asked.join(stats, ["corpus_id", "term"]))
    met = postings.join(_sent(words, words), ["corpus_id", "term"])
    weight = _weight(k1, b) * F.col("times")
    return met.groupBy("corpus_id", "query_id", "chunk_id").agg(F.sum(weight).alias("score"))


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int = TOP, k1: float = K1, b: float = B, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(top, work). top: what `topk` gives of all scores, rounded to so many digits. work(corpus_id, query_id, scored, all): postings
    that were scored for it and that there are.

    A few chunks, the best by the query's LEAD most telling words, are scored first: the score of the k-th is a threshold. Words
    which together cannot reach it are looked up only for chunks that have one of the others, and of these only for
    such as can still reach it. What lies after the read point is left out before anything is summed.
    """
    key, slack = ["corpus_id", "query_id"], 10.0**-digits * 2
    asked = _asked(queries)
    weights = _weights(chunks, asked, k1, b).join(chunks.select("corpus_id", "chunk_id", "global_index"), ["corpus_id", "chunk_id"])
    weights = saved(weights)
    peaks = weights.groupBy("corpus_id", "term").agg(F.max("weight").alias("peak"), F.count("*").alias("df"))
    terms = asked.join(peaks, ["corpus_id", "term"]).join(queries.select(*key, "read_point"), key)
    by = Window.partitionBy(*key)
    terms = saved(terms.withColumn("peak", F.col("peak") * F.col("times")).withColumn("place", F.row_number().over(by.orderBy(F.desc("peak"), "term"))))

    def summed(words: DataFrame) -> DataFrame:
        met = words.join(weights, ["corpus_id", "term"]).where("global_index <= read_point")
        return met.groupBy(*key, "chunk_id").agg(F.sum(F.col("weight") * F.col("times")).alias("score"), F.count("*").alias("n"))

    def exact(spots: DataFrame) -> DataFrame:
        met = spots.select(*key, "chunk_id").join(terms.select(*key, "term", "times"), key).join(weights, ["corpus_id", "chunk_id", "term"])
        return met.groupBy(*key, "chunk_id").agg(F.sum(F.col("weight") * F.col("times")).alias("score"), F.count("*").alias("n"))

    first = summed(terms.where(F.col("place") <= LEAD)).withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "chunk_id"))).where(F.col("r") <= PICKED * k)
    best = exact(first).withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "chunk_id")))
    least = saved(best.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("r") == k, F.col("score"))), F.lit(0.0)).alias("least"), F.sum("n").alias("tried")))
    so_far = by.orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = terms.join(least.select(*key, "least"), key, "left").withColumn("needed", F.sum("peak").over(so_far) >= F.coalesce("least", F.lit(0.0)) - slack)
    ranked = saved(ranked.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("peak")).otherwise(0.0)).over(by)))
    some = saved(summed(ranked.where("needed")))
    hopes = some.join(ranked.groupBy(*key).agg(F.max("rest").alias("rest"), F.coalesce(F.max("least"), F.lit(0.0)).alias("least")), key)
    scores = saved(exact(hopes.where(F.col("score") + F.col("rest") >= F.col("least") - slack)))
    work = some.groupBy(*key).agg(F.sum("n").alias("a")).join(scores.groupBy(*key).agg(F.sum("n").alias("b")), key, "left").join(least, key, "left").join(terms.groupBy(*key).agg(F.sum("df").alias("all")), key)
    work = work.select(*key, (F.col("a") + F.coalesce("b", F.lit(0)) + F.coalesce("tried", F.lit(0))).alias("scored"), "all")
    return topk(scores.select(*key, "chunk_id", F.round("score", digits).alias("score")), chunks, queries, k), work


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, JVM-side; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP, part: bool = False) -> DataFrame:
    """(query_id, vec_id, score, place): the k nearest of vectors(vec_id, global_index, vector) to each of
    queries(query_id, read_point, vector), up to its read point, by block products; ties by vec_id. part: the queries are one of the blocks that are sent out at once."""
    queries = queries.where("vector is not null").select("query_id", "read_point", "vector").distinct()
    numbers = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
    if numbers > SENT_NUMBERS and not part:
        parts = -(-2 * numbers // SENT_NUMBERS)
        own = F.pmod(F.xxhash64("query_id", "read_point", "vector"), F.lit(parts))
        return reduce(DataFrame.union, [cosine_topk(vectors, queries.where(own == i), k, True) for i in range(parts)])
    rows = queries.collect()
    names = [r.query_id for r in rows]
    q = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(rows) else 1
    sent = vectors.sparkSession.sparkContext.broadcast((names, np.array([r.read_point for r in rows]), q))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points, q = sent.value
        for batch in tables:
            if not len(names) or not len(batch):
                continue
            ids, at = batch.column("vec_id").to_numpy(), batch.column("global_index").to_numpy()
            flat = batch.column("vector").flatten().to_numpy().astype(np.float64)
            if len(flat) != len(ids) * q.shape[1]:
                raise ValueError("vectors and queries differ in length")
            v = flat.reshape(len(ids), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            score = np.where(at[None] <= points[:, None], q @ v.T, -np.inf)
            best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(names)), best.shape[1]), best.ravel()
            ok = np.isfinite(score[i, j])
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i[ok]], pa.int64()), pa.array(ids[j[ok]], pa.int64()), pa.array(score[i, j][ok])], names=["query_id", "vec_id", "score"])

    near = vectors.where("vector is not null").select("vec_id", "global_index", "vector").mapInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def topk(scores: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(corpus_id, query_id, chunk_id, score, place): the best k visible chunks of each query. Visible chunks without a hit
    have score 0 and fill up; of these only the first k by chunk_id can be needed."""
    key = ["corpus_id", "query_id"]
    points = queries.select(*key, "read_point")
    seen = scores.join(chunks.select("corpus_id", "chunk_id", "global_index"), ["corpus_id", "chunk_id"]).join(points, key).where("global_index <= read_point")
    hit = seen.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "chunk_id"))).where(F.col("n") <= k)
    # Only queries with fewer than k hits need others: visible chunks that are none of their hits. The first 2k visible ones
    # hold them.
    few = points.join(hit.groupBy(*key).agg(F.count("*").alias("hits")), key, "left").where(F.coalesce("hits", F.lit(0)) < k).select(*key, "read_point")
    ids = chunks.select("corpus_id", "chunk_id", "global_index").join(few.select("corpus_id", "read_point").distinct(), "corpus_id").where("global_index <= read_point")
    early = ids.withColumn("n", F.row_number().over(Window.partitionBy("corpus_id", "read_point").orderBy("chunk_id"))).where(F.col("n") <= 2 * k)
    fill = few.join(early.select("corpus_id", "read_point", "chunk_id"), ["corpus_id", "read_point"])
    fill = fill.join(scores.select(*key, "chunk_id"), [*key, "chunk_id"], "left_anti").select(*key, "chunk_id", F.lit(0.0).alias("score"))
    both = hit.select(*key, "chunk_id", "score").union(fill)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "chunk_id"))).where(F.col("place") <= k)


def context_block(top: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(corpus_id, query_id, block, labels): the picked chunks in their order and their distinct labels; for a query that sees
    nothing a fixed text."""
    key = ["corpus_id", "query_id"]
    text = F.concat(F.lit("("), "label", F.lit(") "), "text")
    rows = top.join(chunks.select("corpus_id", "chunk_id", "label", "text"), ["corpus_id", "chunk_id"])
    rows = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("x"), F.array_sort(F.collect_set("label")).alias("labels"))
    none = F.format_string("Up to section %d this has not been revealed yet.", "read_point")
    return queries.join(rows, key, "left").select(*key, F.coalesce(F.array_join(F.col("x.t"), "\n\n"), none).alias("block"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
