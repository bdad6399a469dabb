"""Suffix order of a byte text, with common prefixes, by external induced sorting.

A suffix is of type L where it is larger than its successor and S where it is smaller; an LMS suffix is an S after an L. LMS
substrings are named in order, the string of names is sorted by the same method (recursion ends where all names differ), and
the LMS suffixes in order induce the rest: one scan upwards settles all L suffixes, one downwards all S suffixes.

A scan is driven by a priority queue of suffix tuples (``Buckets``): smallest first character first, equal ones in order of
arrival. At the byte level a tuple carries its suffix's position and the characters it shares with the one that arrived before
it, which follow from the shared characters of the suffixes that induced both (a range minimum plus one); only LMS neighbours, and
the places where the two types meet, are compared in the text. Names form a large alphabet: its buckets hold ranges of names, and
tuples that are induced inside a bucket while it is read are merged into it in waves.

Queues and lists keep ``held`` bytes in memory and the rest in unnamed files of the task (below Spark's local folders where they
are known, gone when it ends); texts, names and orders beyond ``held`` bytes are mapped files. So a text may be far larger than
memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of one queue, list or array that stay in memory.
HELD = 8 << 20
#: Tuples handled at once, and tuples of a bucket of several names.
BATCH, NAMES = 1 << 15, 1 << 13
#: A tuple is one integer: the position, and in its lowest bits the shared characters.
BITS, LOW = 8, 255


def _file():
    """An unnamed file of this task, beside Spark's own spill files."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


def _array(n: int, dtype, held: int) -> np.ndarray:
    """An array in memory, or a mapped file where it is larger than ``held`` bytes."""
    size = n * np.dtype(dtype).itemsize
    return np.empty(n, dtype) if size <= held else np.memmap(_file(), dtype, "w+", shape=(n,))


class Spool:
    """Tuples in order of arrival: the newest in memory, the rest in a file."""

    def __init__(self):
        self.parts, self.n, self.filed, self.file = [], 0, 0, None

    def append(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.n += len(rows)

    @property
    def bytes(self) -> int:
        return 8 * (self.n - self.filed)

    def spill(self) -> None:
        self.file = self.file or _file()
        self.file.seek(0, 2)
        for p in self.parts:
            self.file.write(p.tobytes())
        self.parts, self.filed = [], self.n

    def read(self, a: int, b: int) -> np.ndarray:
        """Tuples a .. b - 1."""
        out = []
        if a < self.filed:
            self.file.seek(8 * a)
            out.append(np.frombuffer(self.file.read(8 * (min(b, self.filed) - a)), np.int64))
        if b > self.filed:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            out.append(self.parts[0][max(a - self.filed, 0) : b - self.filed])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int64)


class Buckets:
    """The priority queue: tuples by bucket of their first character, first in first out."""

    def __init__(self, n: int, held: int):
        self.spools: list[Spool | None] = [None] * n
        self.head, self.held, self.bytes, self.spilled = [0] * n, held, 0, 0

    def push(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        """Rows sorted by bucket."""
        if not len(rows):
            return
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
            k = int(bucket[a])
            if self.spools[k] is None:
                self.spools[k] = Spool()
            self.spools[k].append(rows[a:b])
        self.bytes += rows.nbytes
        if self.bytes > self.held:
            for s in self.spools:
                if s is not None and s.bytes:
                    self.spilled += s.bytes
                    s.spill()
            self.bytes = 0

    def pop(self, k: int, most: int | None) -> np.ndarray | None:
        """The next ``most`` tuples of a bucket (all of them if None); None when it is empty."""
        s = self.spools[k]
        if s is None:
            return None
        a = self.head[k]
        b = s.n if most is None else min(s.n, a + most)
        rows = s.read(a, b)
        self.head[k] = b
        if b == s.n:
            self.bytes = max(0, self.bytes - s.bytes)
            self.spools[k], self.head[k] = None, 0
        return rows


class _Minima:
    """Minimum of any run of a byte array."""

    def __init__(self, x: np.ndarray):
        self.levels, size = [x], 1
        while size * 2 <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - size], last[size:]))
            size *= 2
        width = len(x)
        self.table = np.concatenate([np.append(v, np.zeros(width - len(v), np.uint8)) for v in self.levels]) if width else x
        self.width = width

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of x[a[i]] .. x[b[i]]."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level * self.width + a], self.table[level * self.width + b - (1 << level) + 1])


def shared_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many characters, up to ``most``, suffixes a[i] and b[i] of a byte text share."""
    n, size = len(s), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    eight = np.ndarray((max(n - 7, 0),), "<u8", s.data, 0, (1,)) if n >= 8 else None
    for k in range(0, most, 8):
        x, y = a[live] + k, b[live] + k
        near = np.maximum(x, y) + 8 > n
        if eight is not None and not near.any():
            differ = eight[x] ^ eight[y]
        else:
            pad = np.concatenate([s[min(int(x.min()), int(y.min())) :], np.zeros(8, np.uint8)]) if len(x) else np.zeros(8, np.uint8)
            low = n + 8 - len(pad)
            words = np.ndarray((len(pad) - 7,), "<u8", pad.data, 0, (1,))
            differ = words[np.minimum(x - low, len(words) - 1)] ^ words[np.minimum(y - low, len(words) - 1)]
        first = np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1] - 1  # place of the lowest bit
        size[live] += np.where(differ == 0, 8, first >> 3)
        live = live[differ == 0]
        if not len(live):
            break
    return np.minimum(size, most)


def _scan(s: np.ndarray, kind: np.ndarray, ids: np.ndarray, single: np.ndarray, seeds, queue: Buckets, meet) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Read buckets upwards; yields (tuples in order, which came from the queue; None for none of them).

    ``kind`` tells which predecessors this scan settles; ``seeds(bucket)`` yields tuples that come after a bucket's own; ``meet(a, b)``
    compares two suffixes in the text (None: shared characters are not carried).
    """
    lowest = np.full(len(ids), 255, np.uint8) if meet else None  # shared since a character's last push
    pushed = np.zeros(len(ids), bool) if meet else None

    def follow(rows: np.ndarray, inside: int | None) -> None:
        """Push the predecessors of tuples that are in order."""
        p = (rows >> BITS) - 1
        at = np.flatnonzero(kind[p] & (p >= 0))
        k = s[p[at]]
        if inside is not None:
            far = ids[k] != inside
            at, k = at[far], k[far]
        by = np.argsort(k, kind="stable")
        at, k = at[by], k[by]
        out = p[at] << BITS
        if meet:
            l = (rows & LOW).astype(np.uint8)  # noqa: E741
            if len(at):
                new = np.append(True, k[1:] != k[:-1])
                before = np.where(new, -1, np.append(0, at[:-1]))
                least = _Minima(l).of(before + 1, at)
                least = np.where(new, np.minimum(least, lowest[k]), least)
                out |= np.where(new & ~pushed[k], 0, np.minimum(least, 253).astype(np.int64) + 1)
            if len(l):
                np.minimum(lowest, l.min(), out=lowest)
            if len(at):
                last = np.append(k[1:] != k[:-1], True)
                tail = np.append(np.minimum.accumulate(l[::-1])[::-1], np.uint8(255))
                lowest[k[last]] = tail[at[last] + 1]
                pushed[k[last]] = True
        queue.push(ids[k], out)

    def settled(b: int) -> tuple[np.ndarray, np.ndarray]:
        """A bucket of several names: its tuples, those induced inside it (merged in wave after wave), and its seeds, in order; and which
        are no seeds."""
        first = queue.pop(b, None)
        first = np.zeros(0, np.int64) if first is None else first
        pos = np.concatenate([first, *seeds(b)]) >> BITS
        group = s[pos].astype(np.int64) * 3
        group[len(first) :] += 2
        tie, source = np.arange(len(pos)), np.full(len(pos), -1)
        order = np.argsort((group << 32) | tie)
        newest = order
        while True:
            p = pos[newest] - 1
            ok = kind[p] & (p >= 0)
            ok[ok] = ids[s[p[ok]]] == b
            if not ok.any():
                return pos[order] << BITS, group[order] % 3 != 2
            rank = np.empty(len(pos), np.int64)
            rank[order] = np.arange(len(pos))
            own = source >= 0
            tie[own] = rank[source[own]]
            came, p = newest[ok], p[ok]
            mine, due = s[p].astype(np.int64) * 3 + 1, rank[came]
            by = np.argsort((mine << 32) | due)
            came, p, mine, due = came[by], p[by], mine[by], due[by]
            place = np.searchsorted(((group << 32) | tie)[order], (mine << 32) | due)
            newest = np.arange(len(pos), len(pos) + len(p))
            order = np.insert(order, place, newest)
            pos, group, source, tie = np.concatenate([pos, p]), np.concatenate([group, mine]), np.concatenate([source, came]), np.concatenate([tie, due])

    for b in range(len(single)):
        if not single[b]:
            rows, own = settled(b)
            follow(rows, b)
            yield rows, own
            continue
        end = -1
        while (rows := queue.pop(b, BATCH)) is not None:
            follow(rows, None)
            end = int(rows[-1]) >> BITS
            yield rows, np.ones(len(rows), bool)
        for i, rows in enumerate(seeds(b)):
            if meet and len(rows) and not i:
                rows = rows.copy()
                rows[0] = rows[0] >> BITS << BITS | (meet(end, int(rows[0]) >> BITS) if end >= 0 else 0)
            follow(rows, None)
            yield rows, None


def _spread(counts: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character, and which buckets hold a single one: neighbours share a bucket up to about ``NAMES`` suffixes."""
    if alone:
        return np.arange(len(counts)), np.ones(len(counts), bool)
    part = (np.cumsum(counts) - counts) // NAMES
    heavy = counts > BATCH
    new = (part[1:] != part[:-1]) | heavy[1:] | heavy[:-1]
    ids = np.append(0, np.cumsum(new))
    return ids, np.bincount(ids) == 1


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, shared: np.ndarray | None, held: int, most: int = 0) -> Iterator[np.ndarray]:
    """All suffixes, the largest first, from LMS suffixes in order (by their first characters at least); ``s`` ends with its only 0.

    With ``shared`` (characters that LMS neighbours share), tuples carry how many characters, up to ``most`` and more, a suffix shares
    with the larger one before it.
    """
    top = int(s.max())
    counts = np.bincount(s, minlength=top + 1)
    ids, single = _spread(counts, s.dtype == np.uint8)
    meet = (lambda a, b: int(shared_prefix(s, np.array([a]), np.array([b]), most)[0])) if shared is not None else None
    bounds = np.append(0, np.cumsum(np.bincount(ids[s[lms]], minlength=len(single))))

    def given(b: int) -> Iterator[np.ndarray]:
        first, end = int(bounds[b]), int(bounds[b + 1])
        for a in range(first, end, BATCH if single[b] else max(1, end - first)):
            z = min(end, a + BATCH) if single[b] else end
            yield lms[a:z] << BITS if shared is None else lms[a:z] << BITS | shared[a:z]

    larger, sizes = Spool(), np.zeros(len(single), np.int64)
    for rows, own in _scan(s, ~is_s, ids, single, given, Buckets(len(single), held), meet):  # upwards: L suffixes
        if own is not None:
            rows = rows[own]
            larger.append(rows)
            sizes += np.bincount(ids[s[rows >> BITS]], minlength=len(single))
            if larger.bytes > held:
                larger.spill()
    ends = np.cumsum(sizes)
    back, n = len(single) - 1, larger.n

    def downwards(b: int) -> Iterator[np.ndarray]:
        """L suffixes of a bucket (counted from the largest), the largest first, sharing with the larger one before."""
        z, first = int(ends[back - b]), int(ends[back - b] - sizes[back - b])
        while z > first:
            a = max(first, z - BATCH) if single[back - b] else first
            rows = larger.read(a, min(z + 1, n))
            carried = np.append(rows[1:] & LOW, 0)[: z - a]
            yield (rows[: z - a] >> BITS << BITS | carried)[::-1]
            z = a

    turned = _array(len(s), s.dtype, held)
    np.subtract(s.dtype.type(top), s, out=turned)
    queue = Buckets(len(single), held)
    queue.push(np.array([back]), np.array([(len(s) - 1) << BITS]))
    for rows, _ in _scan(turned, is_s, back - ids[::-1], single[::-1], downwards, queue, meet):
        yield rows


def s_types(s: np.ndarray, held: int = HELD) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is."""
    n = len(s)
    out = _array(n, bool, held)
    change = np.flatnonzero(s[:-1] != s[1:])
    up = np.append(s[change] < s[change + 1], True)
    out[: n - 1] = np.repeat(up, np.diff(np.concatenate([[-1], change, [n - 2]])))
    out[n - 1] = True
    return out


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray, held: int) -> np.ndarray:
    """Names of the LMS substrings (in text order), equal for equal substrings, ascending with their order (``ranked``)."""
    size = np.append(np.diff(lms) + 1, 1)
    same = size[ranked[1:]] == size[ranked[:-1]]
    a, b = lms[ranked[1:]], lms[ranked[:-1]]
    live = np.flatnonzero(same)
    left = size[ranked[1:]][live]
    k = 0
    while len(live):
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        k += 1
        go = ~differ & (k < left)
        live, left = live[go], left[go]
    names = _array(len(lms), np.int32 if len(lms) < 1 << 31 else np.int64, held)
    names[ranked] = np.cumsum(np.append(0, ~same))
    return names


def _lms_order(s: np.ndarray, is_s: np.ndarray, held: int) -> np.ndarray:
    """LMS suffixes in order: by name, and by recursion on the names where these repeat."""
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    place = _array(len(s), np.int32 if len(s) < 1 << 31 else np.int64, held)
    place[:] = -1
    place[lms] = np.arange(len(lms))
    by_first = lms[np.argsort(s[lms], kind="stable")]
    ranked, at = _array(len(lms), np.int64, held), len(lms)
    for rows in induce(s, is_s, by_first, None, held):
        own = place[rows >> BITS]
        own = own[own >= 0]
        ranked[at - len(own) : at] = own[::-1]
        at -= len(own)
    names = _names(s, lms, ranked, held)
    if int(names.max()) + 1 == len(lms):
        return lms[ranked]
    return lms[suffix_order(names, held)]


def suffix_order(s: np.ndarray, held: int = HELD) -> np.ndarray:
    """Positions of all suffixes of ``s`` in order; ``s`` ends with its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = s_types(s, held)
    out, at = _array(n, np.int64, held), n
    for rows in induce(s, is_s, _lms_order(s, is_s, held), None, held):
        out[at - len(rows) : at] = (rows >> BITS)[::-1]
        at -= len(rows)
    return out


def sorted_suffixes(s: np.ndarray, most: int, held: int = HELD) -> Iterator[np.ndarray]:
    """Tuples of all suffixes of a byte text (uint8, its only 0 last), the largest first; ``shared`` tells, up to ``most``,
    how many characters a suffix shares with the larger one before it."""
    if len(s) == 1:
        yield np.zeros(1, np.int64)
        return
    is_s = s_types(s, held)
    lms = _lms_order(s, is_s, held)
    shared = _array(len(lms), np.uint8, held)
    shared[0] = 0
    for a in range(1, len(lms), 1 << 20):
        z = min(len(lms), a + (1 << 20))
        shared[a:z] = shared_prefix(s, lms[a - 1 : z - 1], lms[a:z], most)
    yield from induce(s, is_s, lms, shared, held, most)
