"""Language ID by string kernels: presence of character n-grams of all lengths from 1 to 3 (a blended spectrum), Nyström
landmarks, one-versus-rest kernel ridge regression, scored by batched matrix products over whole texts.

k(x, y) = shared n-grams / sqrt(n-grams of x * n-grams of y), with n-grams hashed to 2^14 cells; letters are lower-cased and
runs of anything else are as spaces. Fitted on a bounded sample of the labelled rows: PER_LANGUAGE documents a language, at most
SAMPLE in all, chosen by a hash of doc_id. The language, source and id of a document are no input of its prediction.

Null text and text without a letter: `und`, score 0. So is everything if there is no labelled row. Repeated rows get the
same result; a null doc_id is never learned from, and is held out. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.llm.common import batches, saved
from loregraph.llm.wordhash import chunks

WIDTH, LONGEST = 1 << 14, 3
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 256, 2048, 64, 1e-2
UNKNOWN = "und"
#: Texts that stand in memory as rows of cells at once (16 KB each, then four times that).
ROWS = 1000
_table: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point up to 0xFFFF: the lower-case letter or a space; whether it is a letter."""
    if not _table:
        code = np.arange(1 << 16)
        is_letter = np.array([chr(c).isalpha() for c in code])
        low = np.array([ord(chr(c).lower()[0]) if is_letter[c] else 32 for c in code], np.uint32)
        _table.extend([low, is_letter])
    return _table[0], _table[1]


def presence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the UTF-8 texts data[bounds[i]:bounds[i+1]]: a 0/1 row of WIDTH cells each, and whether they have a letter."""
    texts = len(bounds) - 1
    out, has = np.zeros((texts, WIDTH), np.uint8), np.zeros(texts, bool)
    if not len(data):
        return out, has
    low, is_letter = _letters()
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    ends = chars[bounds]
    text = np.repeat(np.arange(texts), np.diff(ends))
    wide = code >= 1 << 16
    letter = is_letter[np.where(wide, 0, code)]
    if wide.any():
        letter[wide] = [chr(c).isalpha() for c in code[wide]]
        code = np.where(wide, np.where(letter, code, 32), low[np.where(wide, 0, code)])
    else:
        code = low[code]
    has[text[letter]] = True
    flat = out.reshape(-1)
    total = np.zeros(len(code), np.uint32)
    row = text * WIDTH
    factors = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        m = len(code) - n + 1
        total = total[:m] + (code[n - 1 :] + np.uint32(n)) * factors[n - 1]
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(2146121005)
        cell = row[:m] + (mixed >> np.uint32(32 - 14))
        flat[cell if n == 1 else cell[text[:m] == text[n - 1 :]]] = 1
    return out, has


class Model:
    """Landmarks, weights of the languages, and their names."""

    def __init__(self, names: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.names, self.landmarks, self.weights = names, landmarks, weights

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))
        own = np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (x.astype(np.float32) @ self.landmarks.T) / size[:, None] / own

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights


def fit(langs: list[str], x: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Ridge regression of +1/-1 for each language on the kernel with the landmarks, taken from the languages in turn."""
    if not langs:
        return None
    names = sorted(set(langs))
    turn, seen = [], {n: 0 for n in names}
    for n in langs:
        turn.append(seen[n])
        seen[n] += 1
    chosen = sorted(range(len(langs)), key=lambda i: (turn[i], langs[i]))[: max(landmarks, len(names))]
    model = Model(names, x[chosen].astype(np.float32), np.zeros(0))
    k = np.concatenate([model.kernel(x[i : i + 256]) for i in range(0, len(x), 256)]).astype(np.float64)
    y = np.array([[1.0 if a == n else -1.0 for n in names] for a in langs])
    inner = model.kernel(x[chosen]).astype(np.float64)
    model.weights = np.linalg.lstsq(k.T @ k + ridge * len(langs) * inner / len(chosen) + 1e-6 * np.eye(len(chosen)), k.T @ y, rcond=None)[0].astype(np.float32)
    return model


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2")


def train(docs: DataFrame, rows: DataFrame | None = None) -> Model | None:
    """The model of docs(doc_id, text, lang). rows: which of them may be learned from, by default `learned_rows`."""
    rows = learned_rows(docs) if rows is None else rows
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct()
    order = (F.xxhash64("doc_id"), "doc_id")
    # first within slices of a language, so that the rows of a frequent one do not meet in one task
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(64))).orderBy(*order)
    ids = ids.withColumn("place", F.row_number().over(slices)).where(F.col("place") <= PER_LANGUAGE)
    picked = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= PER_LANGUAGE).orderBy("place", "lang", "doc_id").limit(SAMPLE)
    picked = saved(picked)
    schema = pa.schema([("place", pa.int32()), ("lang", pa.string()), ("cells", pa.binary())])

    def run(tables):
        for batch in tables:
            for at, data, bounds in chunks(batch.column("text"), rows=ROWS):
                x, has = presence(data, bounds)
                n = len(bounds) - 1
                out = batches(schema, [batch.column("place").slice(at, n), batch.column("lang").slice(at, n), [r.tobytes() for r in np.packbits(x, axis=1)]])
                yield out.filter(pa.array(has))

    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # one text of each key: of rows that share it the first in the order of texts
    met = texts.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("place", "lang").agg(F.min("text").alias("text"))
    got = sorted(((r.place, r.lang, bytes(r.cells)) for r in met.mapInArrow(run, "place int, lang string, cells binary").collect()))
    return fit([g[1] for g in got], np.array([np.unpackbits(np.frombuffer(g[2], np.uint8)) for g in got]) if got else np.zeros((0, WIDTH), np.uint8))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, with lang_pred and score (as first columns, under these names)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.schema.names
    names = [f"_c{i}" for i in range(len(kept))]
    at_text = kept.index("text")
    plain = docs.toDF(*names).withColumn("_text", F.col(names[at_text]).cast("string"))

    def run(tables):
        m = sent.value
        for batch in tables:
            langs, scores = [], []
            for _, data, bounds in chunks(batch.column("_text"), rows=ROWS):
                x, has = presence(data, bounds)
                if m is None:
                    has[:] = False
                s = m.scores(x) if has.any() else np.zeros((len(has), 1))
                best = s.argmax(1)
                langs += [m.names[b] if h else UNKNOWN for b, h in zip(best, has)]
                scores += np.where(has, np.clip((1 + s[np.arange(len(best)), best]) / 2, 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[:-1]], names=["lang_pred", "score", *names])

    schema = "lang_pred string, score double, " + ", ".join(f"`{n}` {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))
    return plain.mapInArrow(run, schema).toDF("lang_pred", "score", *kept)


def languages(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    model = train(docs)
    slim = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(True)))
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of docs whose language is told with a score of `least` or more, in all their columns."""
    names = docs.columns
    out = predict(docs, train(docs))
    keep = (F.col(out.columns[0]) != UNKNOWN) & (F.col(out.columns[1]) >= least)
    return out.where(keep).select(*names) if "lang_pred" not in names and "score" not in names else out.toDF("_lang_pred", "_score", *names).where((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least)).select(*names)
