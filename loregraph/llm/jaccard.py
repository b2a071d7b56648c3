"""N-gram Jaccard join of documents: size-aware, heavy and light.

A document's set is its distinct k-word shingles (`wordhash`: 64-bit hashes of words with A-Z lower-cased). Small sets
enumerate the fixed-size subsets that a partner must share, so that a common subset alone proves the link. Large sets scan
inverted lists of their rarest shingles, ranked by exact counts (`linking`). The boundary between the two is where the
expected number of rows is least. Exact copies are one set from the start.

Most documents have no partner, and that is cheap to prove: a set more than a fifth of which is in no other document
cannot link. A round of counting of the shingles in a third of the hash space takes such sets out before any list is made. A
share of the shingles only weakens the proof, never a link.

Null or empty text and text without words: an empty set, linked with nothing. One to k-1 words: the sequence is one shingle.
Repeated rows are copies of one another. A null doc_id joins groups but never names one, unless it is alone: then null.
Ties: lists break equal counts by the shingle's hash, components are named by the smallest doc_id. An empty table gives no row.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, dropped, free_names, recorded, row_key, saved, segments_of, setting, summed
from loregraph.llm.linking import components, link, prefix_lists
from loregraph.llm.wordhash import chunks, mix, numbers, shingle_sets, words

#: Cells of the filter of wanted sets.
WANTED = 1 << 21
#: The share of the hash space that the first round counts.
SHARE = 0.35
#: Sets above this size are never enumerated, whatever the costs say.
MOST_SMALL = 12
#: Rows that a shingle of a listed set costs (counted, joined with its count, put in order), and an entry of a list.
MOVES, SCAN = 3, 2
#: Rows that go to Python at once: a bound on the memory of a worker.
ROWS = "1000"


def _sets(column: pa.Array, k: int):
    """For each chunk of texts: row of the first, distinct shingles, bounds, sizes, ids of the sets."""
    for at, data, bounds in chunks(column):
        hashes, text, _, _ = words(data, bounds)
        found, ends = shingle_sets(hashes, text, len(bounds) - 1, k)
        total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(mix(found ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        size = np.diff(ends)
        yield at, found, ends, size, mix(total[ends[1:]] - total[ends[:-1]] + size.astype(np.uint64))


def _overview(docs: DataFrame, k: int) -> DataFrame:
    """One row (doc_id, key, n, set_id) a document."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64())])

    def run(tables):
        for batch in tables:
            for at, _, _, size, ids in _sets(batch.column("text"), k):
                yield batches(schema, [batch.column("doc_id").slice(at, len(size)), batch.column("key").slice(at, len(size)), size, ids.view(np.int64)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, n long, set_id long")


def _first_tokens(docs: DataFrame, k: int, share: float) -> DataFrame:
    """(token, id) of the shingles in the first `share` of the hash space."""
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64())])
    edge = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def run(tables):
        for batch in tables:
            for _, found, _, size, ids in _sets(batch.column("text"), k):
                keep = found <= edge
                yield batches(schema, [found[keep].view(np.int64), np.repeat(ids, size)[keep].view(np.int64)])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, id long")


def _marked(docs: DataFrame, ids: DataFrame):
    """The sets in ids(id), as bits of a filter of fixed size on all executors. It may pass other sets too."""

    def mark(tables):
        cells = np.zeros(WANTED, np.int64)
        for batch in tables:
            cells[(batch.column("id").to_numpy().view(np.uint64) & np.uint64(WANTED - 1)).astype(np.int64)] = 1
        yield from (pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([c], pa.binary())], names=["segment", "cells"]) for s, c in segments_of(cells))

    return docs.sparkSession.sparkContext.broadcast(np.packbits(summed(ids.mapInArrow(mark, "segment long, cells binary"), WANTED) > 0))


def _wanted_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, tokens) of the sets in ids(id). A filter of fixed size keeps most others from being moved; the join is exact."""
    marked = _marked(docs, ids)
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(tables):
        wanted, seen = np.unpackbits(marked.value).astype(bool), set()
        for batch in tables:
            for _, found, ends, size, mine in _sets(batch.column("text"), k):
                # copies within a task count once, as long as they are remembered
                hit = [i for i in np.flatnonzero(wanted[(mine & np.uint64(WANTED - 1)).astype(np.int64)] & (size > 0)) if mine[i] not in seen]
                if len(seen) < 1_000_000:
                    seen.update(mine[hit])
                if hit:
                    own = np.concatenate([found[ends[i] : ends[i + 1]] for i in hit]).view(np.int64)
                    tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[hit])), pa.int32()), pa.array(own))
                    yield batches(schema, [mine[hit].view(np.int64), tokens])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, tokens array<long>")
    once = found.join(ids, "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens"))
    return once.select("id", F.size("tokens").cast("long").alias("n"), "tokens")


def least_overlap(a: int, b: int, over: int, under: int) -> int:
    """The intersection that sets of sizes a and b need."""
    return -(-over * (a + b) // (over + under))


def partners(n: int, over: int, under: int) -> range:
    """Sizes that a set of size n can link with."""
    return range(-(-over * n // under), under * n // over + 1)


def boundary(sizes: dict[int, int], over: int, under: int) -> int:
    """The largest size that is enumerated. sizes: how many sets of each size."""

    def cost(x: int) -> float:
        rows = sum(m * sum(comb(n, least_overlap(n, b, over, under)) for b in partners(n, over, under) if b <= x) for n, m in sizes.items() if n <= x)
        return rows + sum(m * (MOVES * n + SCAN * (n - -(-over * n // under) + 1)) for n, m in sizes.items() if n <= MOST_SMALL and under * n > over * x)

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), x))


def _subsets(held: DataFrame, over: int, under: int, small: int) -> DataFrame:
    """(token, id, kind) of the subsets of the sets of up to `small` elements. kind tells the sides of a pair: 1 if both have
    one size, else 2 for the smaller and 3 for the larger set."""
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("kind", pa.int32())])
    salts = numbers(7, 4096)

    def of(tokens: np.ndarray, n: int):
        for b in partners(n, over, under):
            need = least_overlap(n, b, over, under)
            if b <= small and need <= n:
                low, high = min(n, b), max(n, b)
                for part in combinations(tokens, need):
                    yield int(mix(np.bitwise_xor.reduce(mix(np.array(part, np.uint64))) + salts[low * 64 + high : low * 64 + high + 1])[0]), 1 if low == high else 2 if n == low else 3

    def run(tables):
        for batch in tables:
            rows = [(t, i, kind) for i, tokens in zip(batch.column("id").to_pylist(), batch.column("tokens")) for t, kind in of(tokens.values.to_numpy().view(np.uint64), len(tokens))]
            if rows:
                yield batches(schema, [np.array([r[0] for r in rows], np.uint64).view(np.int64), [r[1] for r in rows], [r[2] for r in rows]])

    return held.where(F.col("n") <= small).select("id", "tokens").mapInArrow(run, "token long, id long, kind int")


def _linked(pairs: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs(a, b, ta, tb) whose token sets, each in the order of unsigned numbers, are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(tables):
        for batch in tables:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                inter = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(inter * under >= (len(x) + len(y) - inter) * over)
            yield batches(schema, [batch.column("a"), batch.column("b")]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _linkable(docs: DataFrame, sets: DataFrame, k: int, over: int, under: int) -> DataFrame:
    """The rows of sets(set_id, n) that may have a partner, by the shingles of the first round that are in no other set."""
    alone = _first_tokens(docs, k, SHARE).groupBy("token").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy("id").agg(F.count("*").alias("alone"))
    most = F.col("n") - F.ceil(F.col("n") * over / under)
    return sets.join(saved(alone, few=True), sets["set_id"] == F.col("id"), "left").where(F.coalesce("alone", F.lit(0)) <= most).select(*sets.columns)


def _groups(docs: DataFrame, distinct: DataFrame, k: int, over: int, under: int) -> DataFrame:
    """(id, root), saved, for the sets of distinct(set_id, n) that have a partner."""
    sizes = {r.n: r.m for r in distinct.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").agg(F.count("*").alias("m")).collect()}
    small = boundary(sizes, over, under)
    able = distinct.where(F.col("n") <= small).unionByName(_linkable(docs, distinct.where(F.col("n") > small), k, over, under))
    held = saved(_wanted_sets(docs, saved(able.select(F.col("set_id").alias("id")), few=True), k))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (held.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        return _linked(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb"), over, under)

    listed = held.where(F.col("n") * under > small * over)
    lists = prefix_lists(listed.select("id", F.explode("tokens").alias("element")), listed.select("id", F.col("n").alias("size")), over, under)
    roots = link(saved(lists), verify, over, under, central=True)
    if not small:
        return roots
    subsets = saved(_subsets(held, over, under, small).distinct())
    whole = subsets.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.min("kind").alias("low"), F.max("kind").alias("high")).where("a <> z and (low = 1 or low < high)").select("token", "a")
    edges = subsets.join(whole, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    return components(edges.union(roots.where("id <> root").select("root", "id")))


def jaccard_groups(docs: DataFrame, k: int = 5, over: int = 4, under: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, set_id, key (row_key). Documents link when
    under * |intersection| >= over * |union| of their shingle sets; component_id is the smallest doc_id reachable."""
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS):
        with recorded() as tables:
            sets = saved(_overview(docs, k))
            distinct = saved(sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")), few=True)
            roots = _groups(docs, distinct.select("set_id", "n"), k, over, under)
            least = roots.join(distinct.select(F.col("set_id").alias("id"), "least"), "id").groupBy("root").agg(F.min("least").alias("component_id"))
            comp = roots.join(least, "root").select(F.col("id").alias("set_id"), "component_id")
            names = saved(distinct.join(comp, "set_id", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id")), few=True)
        dropped(*[t for t in tables if t is not sets and t is not names])
    met = sets.join(names, "set_id", "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "key")


def one_of_each_group(docs: DataFrame, k: int = 5, over: int = 4, under: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is their group's component_id, in all their columns. Repeated rows stay repeated only
    if they cannot be told apart by doc_id; rows with a null doc_id stay if their group has no other id. Each row goes or
    stays for its own text's group, whatever other rows have its doc_id."""
    own, other = free_names(docs.columns, "_key", "_gone")
    with recorded() as tables:
        groups = saved(jaccard_groups(docs.select("doc_id", "text"), k, over, under))
    dropped(*[t for t in tables if t is not groups])
    gone = groups.where("doc_id is not null and doc_id <> component_id or doc_id is null and component_id is not null").select(F.col("key").alias(other)).distinct()
    return docs.withColumn(own, row_key()).join(gone, F.col(own) == F.col(other), "left_anti").drop(own)
