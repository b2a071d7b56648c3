"""Byte-level BPE with the tiktoken library: texts to token ids and ids back to bytes.

The rank file is read once by the driver (RANK_BYTES at most) and sent to the executors, which build one encoding a Python
process. A text is encoded piece by piece, so that a very long one needs no more memory than its own bytes: pieces end where
a word ends before white space, or, in a text of PIECE characters without such a place, where letters end before punctuation.
No match of the pattern goes across such a place and none looks across it, so the ids are those of the whole text. A text
without any such place is one piece. The ids of a text stand in rows of SEGMENT ids, those of one text one after the other.

Null text is empty: one row without ids. Bytes that are no UTF-8 count as U+FFFD each, as Python decodes them. Strings of special
tokens are ordinary text. Repeated rows, and rows with a null doc_id, are encoded each by itself, under an own `row` number.
An empty table gives no rows. Columns other than doc_id and text are not read. Results do not depend on any order.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a rank file; characters after which a piece may end; ids of a row; bytes that are decoded to text at once.
RANK_BYTES, PIECE, SEGMENT, WINDOW = 1 << 26, 1 << 18, 1 << 16, 1 << 18
TOKENS = "row long, doc_id long, segment int, ids array<int>"

# The last place, seen from the end, where a piece may end. White space and punctuation are of Unicode versions long settled.
_AFTER_WORD = regex.compile(r"(?r)(?<=[^\p{White_Space}\x1C-\x1F᠎])(?=[ \t\n\r])")
_AFTER_LETTER = regex.compile(r"(?r)(?<=\p{L})(?=[!-/:-@\[-`{-~、-〃！-／])")

#: Encodings of this Python process, by rank file and pattern.
_built: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def rank_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of the rank file at a path of the driver's machine, sent to the executors."""
    with open(path, "rb") as f:
        data = f.read(RANK_BYTES + 1)
    if len(data) > RANK_BYTES:
        raise ValueError(f"{path} has more than {RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _built:
        rows = (line.split() for line in ranks.splitlines() if line)
        _built[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})
    return _built[key]


def pieces(data: memoryview | bytes, piece: int = PIECE, window: int = WINDOW) -> Iterator[str]:
    """UTF-8 data as text, cut at safe places into pieces of about `piece` characters or more."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held: list[str] = []
    size = 0
    for at in range(0, len(data), window):
        part = decode(bytes(data[at : at + window]), at + window >= len(data))
        last = held[-1][-1:] if held else ""
        held.append(part)
        size += len(part)
        if size >= piece:
            # a cut lies between two characters of which the second is new, so old parts are not searched again
            near = last + part
            found = _AFTER_WORD.search(near) or _AFTER_LETTER.search(near)
            if found:
                rest = near[found.start() :]
                head = "".join(held)
                yield head[: len(head) - len(rest)]
                held, size = ([rest] if rest else []), len(rest)
    if size:
        yield "".join(held)


def encoded(docs: DataFrame, path: str, pattern: str, segment: int = SEGMENT) -> DataFrame:
    """(row, doc_id, segment, ids): the ids of each text in rows of `segment` ids or fewer, from segment 0; `row` numbers the
    rows of docs in this run."""
    sent = rank_file(docs.sparkSession, path)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value, pattern)
        out: list[tuple[int, int | None, int, np.ndarray]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            rows, docs_, parts, ids = zip(*out)
            flat = pa.array(np.concatenate(ids), pa.int32())
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs_, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(bounds, flat)], names=["row", "doc_id", "segment", "ids"])

        for table in tables:
            for row, doc, text in zip(table.column("row").to_pylist(), table.column("doc_id").to_pylist(), table.column("text")):
                part, ids = 0, np.empty(0, np.int32)
                for piece in pieces(memoryview(text.as_buffer()) if text.is_valid else b""):
                    ids = np.concatenate([ids, np.asarray(enc.encode_ordinary(piece), np.int32)])
                    while len(ids) > segment:
                        out.append((row, doc, part, ids[:segment]))
                        part, ids, held = part + 1, ids[segment:], held + segment
                        if held >= segment:
                            yield batch()
                            held = 0
                out.append((row, doc, part, ids))
                held += len(ids)
                if held >= segment or len(out) >= segment:
                    yield batch()
                    held = 0
        if out:
            yield batch()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, TOKENS)


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens (as from `encoded`) with `bytes`, the bytes of each row's ids. A segment may begin or end inside a character, so
    these are no texts by themselves. An id that has no token is an error."""
    sent = rank_file(tokens.sparkSession, path)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value, pattern)
        for table in tables:
            parts = [enc.decode_bytes(ids.values.to_numpy().tolist()) if ids.is_valid else b"" for ids in table.column("ids")]
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(parts, pa.binary())], names=[*table.schema.names, "bytes"])

    return tokens.mapInArrow(run, f"{TOKENS}, bytes binary")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text from rows with ids and bytes in the order in which `encoded`
    and `decoded` give them: the segments of a text follow each other."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, n, of_ids, of_bytes = None, None, 0, hashlib.sha256(), hashlib.sha256()
        for table in tables:
            out = []
            for row, d, ids, data in zip(table.column("row").to_pylist(), table.column("doc_id").to_pylist(), table.column("ids"), table.column("bytes")):
                if row != now:
                    if now is not None:
                        out.append((doc, n, of_ids.hexdigest(), of_bytes.hexdigest()))
                    now, doc, n, of_ids, of_bytes = row, d, 0, hashlib.sha256(), hashlib.sha256()
                numbers = ids.values.to_numpy().tolist()
                of_ids.update(f"{',' if n and numbers else ''}{','.join(map(str, numbers))}".encode())
                of_bytes.update(data.as_buffer())
                n += len(numbers)
            if out:
                yield _rows(out)
        if now is not None:
            yield _rows([(doc, n, of_ids.hexdigest(), of_bytes.hexdigest())])

    return tokens.select("row", "doc_id", "ids", "bytes").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, n, a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
