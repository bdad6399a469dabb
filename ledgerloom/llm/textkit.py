"""Vectorised text helpers used inside Arrow tasks: word bounds, word hashes and n-gram hashes over whole batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 18
#: Words longer than this are hashed by digest instead of by eights.
LONG_WORD = 1024

_SEED, _FACTOR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as one integer (a view, nothing is copied)."""
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start[i] .. end[i] - 1 of ``data``, eight bytes a step."""
    length = end - start
    out = mix(length.astype(np.uint64) + _SEED)
    if not len(out):
        return out
    eight = _eights(np.concatenate([data, np.zeros(8, np.uint8)]))
    todo, at, left = np.arange(len(out)), start, length
    for _ in range(LONG_WORD // 8):
        chunk = eight[at] & _KEEP[np.minimum(left, 8)]
        out[todo] = mix(out[todo] * _FACTOR + chunk)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
        if not len(todo):
            break
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


class Texts:
    """A run of documents as one byte array: ``data`` and document bounds ``at`` (length n + 1)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first, self.n = data, at, first, len(at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


class Words:
    """Words of a run: byte bounds ``start``/``end``, and ``at`` (n + 1) the bounds of documents in words."""

    def __init__(self, t: Texts, is_word: np.ndarray):
        self.data, self.n = t.data, t.n
        size = len(t.data)
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        cut = t.at[1:-1]
        cut = cut[(cut > 0) & (cut < size)]
        first[cut] = is_word[cut]
        last[cut - 1] = is_word[cut - 1]
        self.first, self.is_word = first, is_word
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, t.at)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return range_hashes(self.data, self.start, self.end)

    def of_gram(self, k: int) -> np.ndarray:
        """For every window of ``k`` words in the run: whether it lies in one document."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        doc = np.repeat(np.arange(self.n), np.diff(self.at))
        return doc[:n] == doc[k - 1 :]


def space_words(t: Texts) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return Words(t, ~SPACES[t.data])


class Spaced:
    """Words of a run joined by single spaces: ``words(a, b)`` are the bytes of words a .. b - 1."""

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray):
        self.raw, self.start, self.end = raw, start.tolist(), end.tolist()

    def words(self, a: int, b: int) -> bytes:
        return self.raw[self.start[a] : self.end[b - 1]] if b > a else b""


def spaced(w: Words) -> Spaced:
    """The same words, each followed by one space."""
    after = np.zeros(len(w.data) + 1, bool)
    after[w.end] = True
    kept = np.append(w.is_word, False) | after
    place = np.cumsum(kept) - kept
    raw = np.where(after, np.uint8(0x20), np.append(w.data, np.uint8(0x20)))
    # words that meet at the bound of two documents have no blank between them; they are never read together
    raw[w.start] = w.data[w.start]
    return Spaced(raw[kept].tobytes(), place[w.start], place[w.start] + (w.end - w.start))


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether bytes a[i] .. a_end[i] - 1 equal bytes b[i] .. b_end[i] - 1, eight a step."""
    same = a_end - a == b_end - b
    eight = _eights(np.concatenate([data, np.zeros(8, np.uint8)]))
    todo, left = np.flatnonzero(same), (a_end - a)[same]
    at, other = a[same], b[same]
    while len(todo):
        differ = (eight[at] ^ eight[other]) & _KEEP[np.minimum(left, 8)] != 0
        same[todo[differ]] = False
        more = ~differ & (left > 8)
        todo, at, other, left = todo[more], at[more] + 8, other[more] + 8, left[more] - 8
    return same


def grams(h: np.ndarray, k: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, by doubling: log2(k) passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, cur, size, a = None, 0, h, 1, np.uint64(salt)
    while True:
        if k & size:
            out = cur[: len(h) - size + 1] if out is None else mix(out[: len(h) - done - size + 1] * a + cur[done : done + len(h) - done - size + 1])
            done += size
        if done == k:
            return mix(out[:n] ^ a)
        cur = mix(cur[:-size] * a + cur[size:] + np.uint64(size))
        size *= 2


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` consecutive values."""
    if len(h) < w:
        return h[:0]
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def ragged(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)
