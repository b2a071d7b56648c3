"""Byte-level BPE: ids of whole texts, whatever the pieces; digests; round trips; hard texts."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loregraph.llm import tokens  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as f:
        return tokens.encoding(f.read(), PATTERN)


def test_pieces_give_the_ids_of_the_whole(whole):
    r = random.Random(5)
    letters = "ab'sC1９ \n\t\r\x0b\x0c\x1c\x85\xa0᠎　éßе́漢字。！!.,-'’s \U0001f600"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        cut = list(tokens.pieces(text.encode(), r.randint(1, 9), r.randint(1, 11)))
        assert "".join(cut) == text
        assert [i for p in cut for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


def test_pieces_are_bounded():
    assert max(map(len, tokens.pieces(b"word " * 100_000, 1000, 1000))) < 3000
    assert max(map(len, tokens.pieces(("漢字" * 20 + "。").encode() * 10_000, 1000, 1000))) < 3000
    assert [len(p) for p in tokens.pieces(b"a" * 50_000, 1000, 1000)] == [50_000]
    assert list(tokens.pieces(b"")) == []


def rows_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row string")
    return tokens.encoded(docs, PATH, PATTERN, **more)


def test_digests_and_round_trip(spark, whole):
    r = random.Random(6)
    long = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(120_000))
    texts = [(1, "Hello, it's me"), (2, ""), (3, None), (None, "no id"), (None, "no id"), (4, "same"), (4, "same"), (5, long), (6, "a" * 300_000), (7, "<|endoftext|> \U0001f600"), (8, " " * 70_000 + "x")]
    encoded = rows_of(spark, [(*t, "x", "y") for t in texts], segment=1000)
    got = tokens.digests(tokens.decoded(encoded, PATH, PATTERN)).collect()
    want = []
    for i, t in texts:
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda x: (x[0] or 0, *x[1:])
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    seen = {}
    for x in encoded.collect():
        assert len(x.ids) <= 1000
        seen.setdefault((x.row, x.doc_id), {})[x.segment] = x.ids
    assert len(seen) == len(texts) and all(sorted(s) == list(range(len(s))) for s in seen.values())
    back = [b"".join(whole.decode_bytes(s[k]) for k in sorted(s)).decode() for s in seen.values()]
    assert sorted(back) == sorted(t or "" for _, t in texts)


def test_empty_table_and_bad_bytes(spark, whole):
    assert tokens.digests(tokens.decoded(rows_of(spark, []), PATH, PATTERN)).collect() == []
    bad = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert tokens.encoded(bad, PATH, PATTERN).first().ids == whole.encode_ordinary("a�b")


def test_rank_files_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RANK_BYTES", 100)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        tokens.rank_file(spark, PATH)
