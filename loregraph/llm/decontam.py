"""Benchmark decontamination by greedy string tiling.

Seeds: each run of min_tile words of a benchmark item is a Karp-Rabin hash; documents that hold one are joined with its
items. For each such document and item the longest common run of words is marked again and again, without overlap, until
none of min_tile words is left; the order of the passages plays no part. A document is contaminated by an item of which at
least `coverage` of the words are marked.

Null or empty text, and items with fewer than min_tile words, match nothing. Repeated rows give repeated results. Null ids
are carried along. Columns other than (doc_id, text) and (item_id, text) are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, free_names, row_key, saved, segments_of, summed
from loregraph.llm.wordhash import chunks, grams, words

#: A benchmark of up to so many words (16 MB of hashes) is sent to every executor; a larger one is joined by a shuffle.
SENT_WORDS = 2_000_000
MIN_TILE, COVERAGE = 5, 0.5
#: Cells of the filter of seeds that a large benchmark is joined through.
FILTER = 1 << 21


def _runs(left: np.ndarray, right: np.ndarray, k: int, most: int) -> list[tuple[int, int, int]]:
    """The common runs of k words or more that cannot be made longer: (-words, place in left, place in right).

    From equal seeds, unless a repetitive text has more than `most` pairs of them: then word by word from the end, with the
    lengths of the runs that begin at one word in memory."""
    a, at = grams(left, np.zeros(len(left), np.int8), k)
    b, bt = grams(right, np.zeros(len(right), np.int8), k)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    if not n.any():
        return []
    if n.sum() > most:
        out, later = [], np.zeros(len(right) + 1, np.int64)
        for i in range(len(left) - 1, -1, -1):
            now = np.append(np.where(right == left[i], later[1:] + 1, 0), 0)
            begins = now[:-1] >= k
            if i:
                begins[1:] &= right[:-1] != left[i - 1]
            out += [(-int(now[j]), i, int(j)) for j in np.flatnonzero(begins)]
            later = now
        return out
    x = np.repeat(at, n)
    y = bt[order][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    # Seeds that follow one another on a diagonal are one run.
    by = np.lexsort((x, x - y))
    x, y = x[by], y[by]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(x - y) != 0) | (np.diff(x) != 1)]))
    length = np.diff(np.append(cut, len(x))) + k - 1
    return [(-int(m), int(p), int(q)) for m, p, q in zip(length, x[cut], y[cut])]


def _spans(free: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Begins and ends of the runs of k or more that are free."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= k]


def tiles(left: np.ndarray, right: np.ndarray, k: int, most: int = 1 << 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in left, place in right, words), longest first."""
    if len(left) < k or len(right) < k:
        return []
    runs = _runs(left, right, k, most)
    heapq.heapify(runs)
    free_l, free_r, out = np.ones(len(left), bool), np.ones(len(right), bool), []
    while runs:
        m, p, q = heapq.heappop(runs)
        free = free_l[p : p - m] & free_r[q : q - m]
        if free.all():
            free_l[p : p - m] = free_r[q : q - m] = False
            out.append((p, q, -m))
            if not _spans(free_r, k) or not _spans(free_l, k):
                break
            continue
        for s, e in _spans(free, k):
            heapq.heappush(runs, (s - e, p + s, q + s))
    return out


class Items:
    """The benchmark as arrays: words of all items, bounds, sorted seeds with their items."""

    def __init__(self, rows: list, k: int):
        rows = [r for r in rows if len(r[1]) >= 8 * k]
        self.ids = [r[0] for r in rows]
        self.words = [np.frombuffer(r[1], np.uint64) for r in rows]
        seeds = [grams(w, np.zeros(len(w), np.int8), k)[0] for w in self.words]
        item = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seeds, self.item = seed[order], item[order]

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Which of the hashes are seeds."""
        if not len(self.seeds):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.seeds, found), len(self.seeds) - 1)
        return self.seeds[at] == found

    def of(self, found: np.ndarray) -> list[int]:
        lo, hi = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
        return sorted({int(i) for a, b in {*zip(lo.tolist(), hi.tolist())} for i in self.item[a:b]})


_PAIR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("n_tiles", pa.int64()), ("longest", pa.int64())])
_PAIR_SQL = "doc_id long, item_id long, covered long, item_words long, n_tiles long, longest long"


def _matches(column: pa.Array, items: Items, k: int):
    """(row, item number, tiles) for each text of the column and each item that shares a seed with it."""
    for at, data, bounds in chunks(column):
        hashes, text, _, _ = words(data, bounds)
        found, place = grams(hashes, text, k)
        hit = items.hits(found)
        first = np.searchsorted(text, np.arange(len(bounds)))
        owner = text[place[hit]]
        for i in np.unique(owner):
            own = hashes[first[i] : first[i + 1]]
            for j in items.of(found[hit][owner == i]):
                yield at + int(i), j, tiles(own, items.words[j], k)


def item_words(bench: DataFrame) -> DataFrame:
    """(item_id, words): the items' word hashes."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary())])

    def run(tables):
        for batch in tables:
            for at, data, bounds in chunks(batch.column("text")):
                hashes, text, _, _ = words(data, bounds)
                first = np.searchsorted(text, np.arange(len(bounds)))
                yield batches(schema, [batch.column("item_id").slice(at, len(bounds) - 1), [hashes[a:b].tobytes() for a, b in zip(first, first[1:])]])

    return bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, words binary")


def _sent(docs: DataFrame, items: DataFrame, k: int):
    """The benchmark on all executors, or None if it is too large for that."""
    items = items.where(F.length("words") >= 8 * k)  # shorter ones match nothing
    n = items.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    return docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, bytes(r.words)) for r in items.collect()], k)) if n <= SENT_WORDS else None


def _row(doc, item, words_of_item, found):
    return doc, item, sum(m for _, _, m in found), len(words_of_item), len(found), max(m for _, _, m in found)


def contamination(docs: DataFrame, bench: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered, item_words, n_tiles, longest) of the documents and items at or above the coverage."""
    k = min_tile
    items = saved(item_words(bench))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = _sent(docs, items, k)

    def here(tables):
        for batch in tables:
            ids = batch.column("doc_id").to_pylist()
            rows = [_row(ids[i], sent.value.ids[j], sent.value.words[j], found) for i, j, found in _matches(batch.column("text"), sent.value, k)]
            if rows:
                yield batches(_PAIR, list(zip(*rows)))

    found = slim.mapInArrow(here, _PAIR_SQL) if sent else _joined(slim, items, k).drop("key")
    return found.where(F.col("covered") >= coverage * F.col("item_words"))


def _joined(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """As `contamination` for a benchmark of any size: a shuffle joins the seeds, then texts meet their items. Also key (row_key)."""
    schema, pair = pa.schema([("seed", pa.int64()), ("key", pa.int64())]), _PAIR.append(pa.field("key", pa.int64()))

    def seeds(tables):
        wanted = np.unpackbits(marked.value).astype(bool)
        for batch in tables:
            for at, data, bounds in chunks(batch.column("text")):
                hashes, text, _, _ = words(data, bounds)
                found, place = grams(hashes, text, k)
                hit = wanted[(found & np.uint64(FILTER - 1)).astype(np.int64)]
                yield batches(schema, [found[hit].view(np.int64), batch.column("key").take(pa.array(at + text[place[hit]]))])

    def item_seeds(tables):
        for batch in tables:
            for key, w in zip(batch.column("key"), batch.column("words")):
                w = np.frombuffer(w.as_buffer(), np.uint64) if w.is_valid else np.zeros(0, np.uint64)
                found, _ = grams(w, np.zeros(len(w), np.int8), k)
                yield batches(schema, [found.view(np.int64), [key.as_py()] * len(found)])

    def mark(tables):
        cells = np.zeros(FILTER, np.int64)
        for batch in tables:
            cells[(batch.column("seed").to_numpy().view(np.uint64) & np.uint64(FILTER - 1)).astype(np.int64)] = 1
        yield from (pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([c], pa.binary())], names=["segment", "cells"]) for x, c in segments_of(cells))

    def tile(tables):
        for batch in tables:
            rows = []
            for doc, item, text, w, key in zip(*(batch.column(c) for c in ("doc_id", "item_id", "text", "words", "key"))):
                w = np.frombuffer(w.as_buffer(), np.uint64)
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                found = tiles(words(data, np.array([0, len(data)]))[0], w, k)
                if found:
                    rows.append((*_row(doc.as_py(), item.as_py(), w, found), key.as_py()))
            if rows:
                yield batches(pair, list(zip(*rows)))

    keyed = docs.withColumn("key", row_key())
    numbered = items.withColumn("key", F.xxhash64("item_id", "words"))
    of_items = saved(numbered.select("key", "words").mapInArrow(item_seeds, "seed long, key long").withColumnRenamed("key", "item").distinct())
    # a filter of fixed width keeps most runs that no item has from being moved
    marked = docs.sparkSession.sparkContext.broadcast(np.packbits(summed(of_items.mapInArrow(mark, "segment long, cells binary"), FILTER) > 0))
    of_docs = keyed.select("key", "text").mapInArrow(seeds, "seed long, key long").distinct()
    pairs = saved(of_docs.join(of_items, "seed").select("key", "item").distinct())
    met = keyed.join(pairs, "key").join(numbered.withColumnRenamed("key", "item"), "item")
    return met.select("doc_id", "item_id", "text", "words", "key").mapInArrow(tile, f"{_PAIR_SQL}, key long")


def decontaminated(docs: DataFrame, bench: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs without the contaminated ones, in all their columns."""
    k = min_tile
    items = saved(item_words(bench))
    sent = _sent(docs, items, k)
    if sent is None:
        own, other = free_names(docs.columns, "_key", "_bad")
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        bad = _joined(slim, items, k).where(F.col("covered") >= coverage * F.col("item_words")).select(F.col("key").alias(other)).distinct()
        return docs.withColumn(own, row_key()).join(bad, F.col(own) == F.col(other), "left_anti").drop(own)

    def keep(tables):
        for batch in tables:
            ok = np.ones(len(batch), bool)
            for i, j, found in _matches(batch.column("text").cast(pa.large_string()), sent.value, k):
                ok[i] &= sum(m for _, _, m in found) < coverage * len(sent.value.words[j])
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
