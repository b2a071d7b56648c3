"""LM scoring: stupid backoff, computed relationally over all documents.

S(w | u v) = c(u v w) / c(u v) if the n-gram is in the count table (counts of CUTOFF or more), else ALPHA * S(w | v), down to
c(w) / N. A word near the beginning has as much context as there is. A document's score is the sum of the logarithms, for
n-grams of ORDER words and fewer. Counts are over all documents.

The sum is taken apart: each word adds the logarithm of its backoff to the lowest order, and each n-gram of the tables that a
document holds adds a correction, its own score less what its suffix would have got. So the tables (hash, count), joined with
themselves by prefix and suffix, become tables of corrections, and these are joined with the documents' exploded n-grams and
summed per document. Tables and n-grams meet in partitions of the hashes, to which they go as runs of numbers, not as a row an
n-gram; sums go to the partition of the document in the same way. All is done in ROUNDS, each over one range of the n-grams' hashes, so that no step moves or stores all
exploded n-grams at once. N-grams that are more than 1 in HEAVY are too many rows for one key: their corrections (at most
HEAVY an order) are sent to all executors. A filter of fixed width keeps most n-grams that are in no table from being moved.

Null or empty text: no words, a null score. Repeated rows count as often as they occur and have the same score. A null doc_id
is scored like others. Texts of any length are taken whole. An empty table gives no row. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.common import batches, dropped, recorded, saved, setting
from loregraph.llm.wordhash import chunks, mix, words

ALPHA, CUTOFF, ORDER, HEAVY, ROUNDS = 0.4, 2, 3, 1_000_000, 5
#: Characters of text and words worked on at once; log2 of the cells of 64 bits of the filter (8 MB).
CHUNK, BLOCK, CELL_BITS = 1 << 20, 1 << 20, 20
#: Characters of text, times the order, that a partition of the count tables gets in a round: about 2 million n-grams.
PART_CHARS = 12_000_000
#: Rows that go to Python at once: a bound on the memory of a worker.
ROWS = "2000"
#: What a run holds: corrections of the tables, n-grams of documents, scores of documents.
TABLE, NGRAMS, OWN = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = [np.uint64(pow(k, -1, 1 << 64)) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def unmixed(x: np.ndarray) -> np.ndarray:
    """The number of which `wordhash.mix` makes x."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * _INVERSE[1]
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * _INVERSE[0]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def ngrams(hashes: np.ndarray, text: np.ndarray, order: int, k: int = 0, rounds: int = 1):
    """For n = 1 to order: n, each n-gram's hash, that of its suffix of n-1 words (0 for words), its text; of n-grams in the
    k-th range alone.

    The hash is made of those of prefix and suffix so that `prefixes` gets the prefix back from hash and suffix."""
    g, suffix = mix(hashes + np.uint64(1)), np.zeros(len(hashes), np.uint64)
    for n in range(1, order + 1):
        if n > 1:
            if len(g) < 2:
                return
            prefix, suffix = g[:-1], g[1:]
            g = mix(prefix + suffix * _STEP + np.uint64(n))
        ok = _within(g, k, rounds)
        ok &= text[: len(g)] == text[n - 1 :]
        at = np.flatnonzero(ok)
        yield n, g[at], suffix[at], text[at]


def prefixes(h: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> np.ndarray:
    return unmixed(h) - suffix * _STEP - n.astype(np.uint64)


def _within(h: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Which hashes are in the k-th range."""
    low, high = (-(-(x << 32) // rounds) << 32 for x in (k, k + 1))
    return h - np.uint64(low) <= np.uint64(high - low - 1)


def _order(h: np.ndarray) -> np.ndarray:
    """An order in which numbers ascend: their leading bits are sorted with their places as one number, which takes half the time of
    `argsort`; what only the other bits tell apart is put right then."""
    bits = np.uint64(max(len(h), 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = h & ~low
    at |= np.arange(len(h), dtype=np.uint64)
    at.sort()
    at &= low
    by = at.view(np.int64)
    found = h[by]
    return by[np.argsort(found, kind="stable")] if (found[1:] < found[:-1]).any() else by


def _runs(part: np.ndarray, *columns: np.ndarray) -> list[list]:
    """Of ascending parts those that occur, and of each column the bytes of its values in each of them."""
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
    ranges = list(zip(cut[:-1], cut[1:]))
    return [[int(part[a]) for a, _ in ranges], *([x[a:b].tobytes() for a, b in ranges] for x in columns)]


def _dealt(part: np.ndarray, *columns: np.ndarray) -> list[list]:
    """The parts that occur, and of each column the bytes of its values in each of them, in their order."""
    by = np.argsort(part, kind="stable")
    return _runs(part[by], *(c[by] for c in columns))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash: by its lower half, as ranges are by the upper one."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)


def _parts(docs: DataFrame, order: int, rounds: int) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(32, -(-chars * order // (rounds * PART_CHARS)))


def counts(docs: DataFrame, order: int, cutoff: int, rounds: int = ROUNDS) -> DataFrame:
    """(n, h, suffix, prefix, c): the n-grams with c >= cutoff, words with c > 1, and a row with n = 0, c the number of words.

    Tasks send sorted runs of hashes with their counts to the partition of the hashes, which merges them."""
    packed = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("h", pa.binary()), ("suffix", pa.binary()), ("c", pa.binary())])
    out = pa.schema([("h", pa.int64()), ("suffix", pa.int64()), ("prefix", pa.int64()), ("n", pa.int32()), ("c", pa.int64())])
    text = docs.select(F.col("text").cast("string").alias("text"))
    parts = _parts(text, order, rounds)

    def seen(k: int):
        def run(tables):
            held: list[list[tuple]] = [[] for _ in range(order)]
            total = 0

            def rows(n: int):
                h, s = (np.concatenate(x) for x in zip(*held[n - 1]))
                held[n - 1].clear()
                by = _order(h)
                h = h[by]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                h, s, c = h[first], s[by[first]], np.diff(np.append(first, len(h))).astype(np.uint32)
                # parts ascend with the hashes of a range
                place = (h >> np.uint64(32)) * np.uint64(rounds) & np.uint64(0xFFFFFFFF)
                at, h, s, c = _runs(place * np.uint64(parts) >> np.uint64(32), h, s, c)
                return batches(packed, [at, [n] * len(at), h, s, c])

            for batch in tables:
                for _, data, bounds in chunks(batch.column("text"), CHUNK):
                    w, text, _, _ = words(data, bounds)
                    total += len(w)
                    for n, h, s, _ in ngrams(w, text, order, k, rounds):
                        held[n - 1].append((h, s))
                        if sum(len(x[0]) for x in held[n - 1]) >= BLOCK:
                            yield rows(n)
            for n in range(1, order + 1):
                if held[n - 1]:
                    yield rows(n)
            if k == 0:
                yield batches(packed, [[0], [0], [np.zeros(1, np.uint64).tobytes()], [np.zeros(1, np.uint64).tobytes()], [np.array([total], np.uint32).tobytes()]])

        return run

    def merged(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = key[1].as_py()
        held = [tuple(np.frombuffer(b"".join(v.as_buffer() for v in batch.column(c)), t) for c, t in (("h", np.uint64), ("suffix", np.uint64), ("c", np.uint32))) for batch in tables]
        h, s, c = (np.concatenate(x) for x in zip(*held))
        by = _order(h)
        h, s, c = h[by], s[by], c[by].astype(np.int64)
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, s, c = h[at], s[at], np.add.reduceat(c, at)
        ok = c >= (cutoff if n > 1 else 2 if n else 0)
        h, s, c = h[ok], s[ok], c[ok]
        yield batches(out, [h.view(np.int64), s.view(np.int64), prefixes(h, s, np.full(len(h), n)).view(np.int64), np.full(len(h), n, np.int32), c])

    found = []
    for k in range(rounds):
        runs = text.mapInArrow(seen(k), "part int, n int, h binary, suffix binary, c binary")
        found.append(saved(runs.groupBy("part", "n").applyInArrow(merged, "h long, suffix long, prefix long, n int, c long")))
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    return union


def corrections(found: DataFrame, order: int, alpha: float, total: int) -> DataFrame:
    """(h, n, c, delta), of the n-grams of `counts`: what one occurrence adds to the score of its document."""
    base = -float(np.log(max(total, 1)))
    own = lambda n: found.where(F.col("n") == n)
    level = own(1).select("h", "n", "c", F.log("c").alias("delta"), (F.log("c") + base).alias("score"))
    out = [saved(level)]
    for n in range(2, order + 1):
        less = out[-1]
        before = less.select(F.col("h").alias("prefix"), F.col("c").alias("before")).hint("shuffle_hash")
        lower = less.select(F.col("h").alias("suffix"), F.col("score").alias("lower")).hint("shuffle_hash")
        # in two halves of the prefixes, so that no step stores all of them twice in its shuffles
        halves = []
        for half in (0, 1):
            mine = lambda c: F.col(c).bitwiseAND(F.lit(1)) == half  # noqa: B023, E731
            met = own(n).where(mine("prefix")).select("h", "n", "c", "prefix", "suffix").join(before.where(mine("prefix")).hint("shuffle_hash"), "prefix", "left").drop("prefix").join(lower, "suffix", "left")
            score = F.log("c") - F.log(F.coalesce("before", F.lit(1)))
            halves.append(saved(met.select("h", "n", "c", (score - float(np.log(alpha)) - F.coalesce("lower", F.lit(base))).alias("delta"), score.alias("score"))))
        out.append(halves[0].unionByName(halves[1]))
    level = out[0]
    for x in out[1:]:
        level = level.unionByName(x)
    return level.select("h", "n", "c", "delta")


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Of hashes(h) a filter of fixed width: words of 64 bits."""
    cell = F.shiftright("h", 6).bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    rows = hashes.groupBy(cell.alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[((h >> np.uint64(6)) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1) > 0


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of x for each."""
    if not len(key):
        return key, x
    by = _order(key.view(np.uint64))
    key, x = key[by], x[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(x, at)


def _by_document(part: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An order by part and document, in which most n-grams of a document that are equal are neighbours: all that go into one number."""
    bits = [int(x.max()).bit_length() if len(x) else 0 for x in (part, doc)] + [len(h).bit_length()]
    left = 64 - sum(bits)
    if left < 0:
        return np.lexsort((doc, part))
    key = part.astype(np.uint64) << np.uint64(bits[1])
    key |= doc.astype(np.uint64)
    if left:
        # bits that neither the range nor the part have a say in
        key = key << np.uint64(left) | mix(h) >> np.uint64(64 - left)
    key = key << np.uint64(bits[2]) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << bits[2]) - 1)).view(np.int64)


def scores(docs: DataFrame, alpha: float = ALPHA, cutoff: int = CUTOFF, order: int = ORDER, heavy: int = HEAVY, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, log_score, mean_score (log_score / n_words)."""
    slim = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), recorded() as tables:
        per = _per_document(slim, alpha, cutoff, order, heavy, rounds)
    dropped(*[t for t in tables if t is not per])
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = slim.select("key", "doc_id", size.alias("n_words"))
    return rows.join(per, "key", "left").select("doc_id", "n_words", "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_score"))


def _per_document(slim: DataFrame, alpha: float, cutoff: int, order: int, heavy: int, rounds: int) -> DataFrame:
    """(key, log_score), saved."""
    spark = slim.sparkSession
    with recorded() as counted:
        found = counts(slim, order, cutoff, rounds)
    total = int(found.where("n = 0").agg(F.sum("c")).first()[0] or 0)
    with recorded() as levels:
        weights = corrections(found, order, alpha, total).withColumn("range", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {rounds}, 32) as int)"))
        dropped(*counted)
        weights = saved(weights, by="range")
    dropped(*[t for t in levels if t is not weights])
    many = weights.where(F.col("c") * heavy >= max(total, 1)).select("h", "delta").toArrow()
    sent_h = many.column("h").to_numpy().view(np.uint64)
    at = np.argsort(sent_h)
    sent = spark.sparkContext.broadcast((sent_h[at], many.column("delta").to_numpy()[at]))
    light = weights.where(F.col("c") * heavy < max(total, 1))
    log_alpha, log_n = float(np.log(alpha)), float(np.log(max(total, 1)))
    parts = _parts(slim, order, rounds)
    runs = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("key", pa.binary()), ("x", pa.binary())])
    part_sums = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("x", pa.binary())])

    def corrected(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def rows():
            h, delta = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at, h, delta = _dealt(_part_of(h, parts), h, delta)
            return batches(runs, [at, [TABLE] * len(at), h, [b""] * len(at), delta])

        for batch in tables:
            held.append((batch.column("h").to_numpy().view(np.uint64), batch.column("delta").to_numpy()))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield rows()
        if held:
            yield rows()

    def exploded(k: int, bits):
        def run(tables):
            known, delta = sent.value
            held: list[tuple] = []
            keys: list[np.ndarray] = []

            def rows():
                h, doc = (np.concatenate(x) for x in zip(*held))
                key = np.concatenate(keys)
                held.clear()
                keys.clear()
                part = _part_of(h, parts)
                by = _by_document(part, doc, h)
                h, doc, part = h[by], doc[by], part[by]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
                times = np.diff(np.append(first, len(h))).astype(np.uint32)
                at, h, key, times = _runs(part[first], h[first], key[doc[first]], times)
                return batches(runs, [at, [NGRAMS] * len(at), h, key, times])

            for batch in tables:
                ids = batch.column("key").to_numpy()
                for at, data, bounds in chunks(batch.column("text"), CHUNK):
                    w, text, _, _ = words(data, bounds)
                    if not len(w):
                        continue
                    docs = len(bounds) - 1
                    score = np.zeros(docs)
                    size = np.bincount(text, minlength=docs)
                    if k == 0:
                        score -= size * log_n
                    before = sum(len(x) for x in keys)
                    for n, h, _, doc in ngrams(w, text, order, k, rounds):
                        if k == 0 and n > 1:
                            score += log_alpha * np.maximum(size - (n - 1), 0)
                        wanted = np.flatnonzero(_passes(bits.value, h))
                        h, doc = h[wanted], doc[wanted]
                        if len(known):
                            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                            hit = known[place] == h
                            score += np.bincount(doc[hit], weights=delta[place[hit]], minlength=docs)
                            h, doc = h[~hit], doc[~hit]
                        held.append((h, doc + before))
                    keys.append(ids[at : at + docs].copy())
                    if sum(len(x[0]) for x in held) >= BLOCK:
                        yield rows()
                    # each text with words has a score, if only that of the first round
                    full = np.flatnonzero(size) if k == 0 else np.flatnonzero(score)
                    if len(full):
                        yield batches(runs, [[int(ids[at + full[0]] % parts)], [OWN], [b""], [ids[at + full].tobytes()], [score[full].tobytes()]])
            if held:
                yield rows()

        return run

    def met(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums per document of what its n-grams in this partition add."""
        held: dict[int, list[tuple]] = {TABLE: [], NGRAMS: [], OWN: []}
        for batch in tables:
            for kind, *row in zip(batch.column("kind").to_pylist(), *(batch.column(c) for c in ("h", "key", "x"))):
                held[kind].append(tuple(np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.uint64, np.int64, np.uint32 if kind == NGRAMS else np.float64))))
        keys, adds = [x[1] for x in held[OWN]], [x[2] for x in held[OWN]]
        if held[TABLE] and held[NGRAMS]:
            table_h, delta = (np.concatenate([x[i] for x in held[TABLE]]) for i in (0, 2))
            by = np.argsort(table_h)
            table_h, delta = table_h[by], delta[by]
            h, key, times = (np.concatenate(x) for x in zip(*held[NGRAMS]))
            place = np.minimum(np.searchsorted(table_h, h), len(table_h) - 1)
            hit = table_h[place] == h
            key, add = key[hit], delta[place[hit]] * times[hit]
            if len(key):  # a document's n-grams stand together
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                keys.append(key[at])
                adds.append(np.add.reduceat(add, at))
        if keys:
            key, x = _summed(np.concatenate(keys), np.concatenate(adds))
            yield batches(part_sums, _dealt(_part_of(mix(key.view(np.uint64)), parts), key, x))

    def totals(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.float64)) for batch in tables for k, x in zip(batch.column("key"), batch.column("x"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(*(np.concatenate(c) for c in zip(*rows)))], names=["key", "score"])

    sums = []
    for k in range(rounds):
        table = light.where(F.col("range") == k).select("h", "delta")
        bits = spark.sparkContext.broadcast(_filter_of(weights.where(F.col("range") == k).select("h")))
        kinds = "part int, kind int, h binary, key binary, x binary"
        rows = slim.select("key", "text").mapInArrow(exploded(k, bits), kinds).unionByName(table.mapInArrow(corrected, kinds))
        part = rows.groupBy("part").applyInArrow(met, "part int, key binary, x binary")
        sums.append(saved(part.groupBy("part").applyInArrow(totals, "key long, score double"), few=True))
        bits.unpersist()
    scored = sums[0]
    for s in sums[1:]:
        scored = scored.unionByName(s)
    alike = slim.groupBy("key").agg(F.count("*").alias("alike"))
    return saved(scored.groupBy("key").agg(F.sum("score").alias("score")).join(alike, "key").select("key", (F.col("score") / F.col("alike")).alias("log_score")), few=True)
