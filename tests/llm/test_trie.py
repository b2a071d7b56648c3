"""The trie of conversation prefixes against plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loregraph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string, k1 string"


def plain(convs):
    """Rows by (depth, conv_id) from {conversation: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(rows, donor, head):
    held = {}
    for c, no, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append(((no is not None, no or 0), role or "", text or ""))
    held = {c: [x[1:] for x in sorted(v)] for c, v in held.items()}
    return {c: held.get(donor(c), [])[: head(c)] + v[head(c) :] for c, v in held.items()}


def of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("band, members", [(2, 2), (8, 3)])
def test_trie_of_rebuilt_conversations(spark, monkeypatch, band, members):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "MEMBERS", members)
    r = random.Random(band)
    rows = [(c, r.choice([None, *range(6)]), r.choice([None, "", "user"]), r.choice([None, "", "a", "b", "é"])) for c in range(-12, 30) if c % 7 for _ in range(r.randint(1, 12))]
    rows += [(100, i, "user", str(i % 3)) for i in range(70)] + [(101, i, "user", str(i % 3)) for i in range(45)] + [(None, 1, "user", "x")] * 3
    rows += [(200 + k, 0, "user", "hi") for k in range(9)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA).repartition(3)
    div = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    turns, convs = trie.rebuilt(trie.placed_turns(df), head, F.col("conv") - F.col("conv") % 5, 8)
    want = plain(built(rows, div, lambda c: zlib.crc32(str(c).encode()) % 9))
    assert of(trie.prefix_trie(turns, convs)) == want
    assert max(x[1] for x in want) > band and any(x[2] is None for x in want)


def test_conversations_as_they_are(spark):
    """Without a donor; all alike; of the length of a band and of two; without turns."""
    rows = [(c, i, "u", "same") for c in (3, 1, 2) for i in range(8)] + [(9, i, "u", "same") for i in range(16)] + [(4, 0, "u", "same")]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA)
    placed = trie.placed_turns(df).drop("total")
    convs = placed.select("conv").distinct().union(spark.createDataFrame([(7,)], "conv long"))
    want = plain({c: [("u", "same")] * n for c, n in ((1, 8), (2, 8), (3, 8), (9, 16), (4, 1), (7, 0))})
    assert of(trie.prefix_trie(placed, convs)) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    turns, convs = trie.rebuilt(trie.placed_turns(df), F.lit(1), F.col("conv"), 8)
    assert trie.prefix_trie(turns, convs).collect() == []


def test_one_key_for_two_prefixes_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, bytearray(b"a"), 1), (2, 1, bytearray(b"b"), 1)], "conv long, pos long, turn binary, n_bytes long")
    monkeypatch.setattr(trie.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    with pytest.raises(Exception, match="two prefixes have one key"):
        trie.prefix_trie(rows, rows.select("conv")).collect()
