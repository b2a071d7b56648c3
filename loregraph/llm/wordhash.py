"""Words and word shingles of Arrow text columns as 64-bit hashes, whole batches at a time.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased. The hash of a word depends on its bytes
alone; that of a shingle on its words and their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once. A longer document is a chunk of its own.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same for the same seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = numbers(1, 256)[_LOWER]
_BASE = int(numbers(2, 1)[0]) | 1
_PLACE = numbers(3, 64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK), base, np.uint64)]))
        if n > 8 * CHUNK:  # for one very long text; not kept
            return have
        _powers[base] = have
    return have


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts data[bounds[i]:bounds[i+1]]: each word's hash, its text's number, where it starts and ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = data - np.uint8(9) > 4
    inside &= data != 32
    full = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    begins, ends = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=begins[1:])
    np.greater(inside[:-1], inside[1:], out=ends[:-1])
    begins[first], ends[last] = inside[first], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    values = _BYTE.take(data.astype(np.intp))
    values *= _power(_BASE, n)[:n]
    np.cumsum(values, out=total[1:])
    hashes = (total[end] - total[start]) * _power(pow(_BASE, -1, 1 << 64), n)[start]
    hashes = mix(hashes + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds))), start, end


def grams(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each run of k words within a text: its hash, the place of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _PLACE[j]
    return mix(out[at]), at


def shingle_sets(hashes: np.ndarray, text: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, and bounds. A text of 1 to k-1 words has all of them as one."""
    found, at = grams(hashes, text, k)
    owner = text[at]
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = count[short].astype(np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += hashes[first[short][has] + j] * _PLACE[j]
        found, owner = np.concatenate([found, mix(whole)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        found[a:b].sort()
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[keep], owner[keep]
    return found, np.searchsorted(owner, np.arange(texts + 1))


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 30):
    """An Arrow string column as (first row, bytes, bounds), some texts at a time, `rows` at most; null is as empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1), a + rows)
        yield a, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b
