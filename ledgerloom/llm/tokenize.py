"""Whole texts to token ids with a public tokenizer, one call for each distinct piece of text instead of each word.

Both tokenizers cut a text at white space before they merge, so a text may be cut where that cut is certain: before a
single space between two characters that are not white space, after a single line feed between such characters, and
between a Latin letter and a stop or comma. The pieces repeat, so each is encoded once and its ids are gathered for every
place; pieces are found by hash and compared byte by byte. A text that holds white space outside ASCII is encoded whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from .textkit import Texts, expand, range_hashes, same_bytes

#: Pieces held for reuse in a worker (about 40 bytes each); beyond it the store starts afresh.
HELD = 1_500_000
#: Bytes of text encoded at once.
SLICE = 1 << 20
#: Lead bytes of UTF-8 white space outside ASCII (next line, no-break space, ogham space, general punctuation spaces, ideographic space).
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Both tokenizers' special end token.
END_MARK = "<|endoftext|>"
_LETTER, _STOP, _LATIN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP[list(b".,;:!?")] = True
#: Second bytes of the letters of UTF-8's 0xC3 block (all but the signs for times and divided by).
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.end_mark = self.tokenizer.token_to_id(END_MARK)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of pieces in order, and their numbers
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # bytes of the pieces, one after the other
        self.start, self.length, self.pieces = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, lists: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.pieces + len(sizes) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.pieces : self.pieces + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.length[self.pieces : self.pieces + len(sizes)] = sizes
        self.used += len(flat)
        self.pieces += len(sizes)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes

    def _lists(self, strings: list[str]) -> list[list[int]]:
        """Ids of each string: joined by the tokenizer's own end mark, which nothing merges with, and cut there again."""
        out: list[list[int]] = []
        for k in range(0, len(strings), 512):
            part = strings[k : k + 512]
            ids = self.tokenizer.encode(END_MARK.join(part), add_special_tokens=False).ids
            at = [-1, *(i for i, x in enumerate(ids) if x == self.end_mark), len(ids)]
            if len(at) == len(part) + 1:
                out += [ids[a + 1 : b] for a, b in zip(at, at[1:], strict=False)]
            else:  # a text that holds the mark itself
                out += [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        return out

    def encode(self, t: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts, each closed by ``end_id``, and their bounds (n + 1)."""
        if self.pieces > HELD:
            self._clear()
        data, size = t.data, len(t.data)
        plain = (data > 0x20) & (data != 0x7F)
        cut = np.zeros(size + 1, bool)
        if size > 2:
            cut[1 : size - 1] |= (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
            cut[2:size] |= (data[1:-1] == 10) & plain[:-2] & plain[2:]
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
            cut[1:size] |= letter[:-1] & _STOP[data[1:]]
        at = t.at
        odd = [i for i in range(t.n) if any(x in t.text(i) for x in _LEADS)] if (data >= 0xC2).any() and any(x in data.tobytes() for x in _LEADS) else []
        for i in odd:
            cut[at[i] : at[i + 1]] = False
        inner = at[(at > 0) & (at < size)]
        if len(inner):  # a cut is judged inside its own document
            cut[inner + 1] &= data[np.minimum(inner, size - 1)] != 10
        cut[at] = True
        begin = np.flatnonzero(cut[:-1]) if size else np.zeros(0, np.int64)
        finish = np.append(begin[1:], size)
        keys = range_hashes(data, begin, finish)
        distinct, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        known = self._known(distinct)
        first = sample[which.reshape(-1)]
        alike = same_bytes(data, begin, finish, begin[first], finish[first]).all()
        if alike and known.any():
            held, here = self.index[np.searchsorted(self.keys, distinct[known])], sample[known]
            a, b = self.raw_at[held] + size, self.raw_at[held + 1] + size
            alike = same_bytes(np.concatenate([data, self.raw]), begin[here], finish[here], a, b).all()
        if not alike:  # two pieces share a hash: these texts are encoded whole
            lists = self._lists([t.text(i).decode() for i in range(t.n)])
            return np.array([i for x in lists for i in (*x, end_id)], np.uint32), np.append(0, np.cumsum([len(x) + 1 for x in lists]))
        new = np.flatnonzero(~known)
        if len(new):
            raw, first = data.tobytes(), self.pieces
            self._add(self._lists([raw[begin[j] : finish[j]].decode("utf-8", "replace") for j in sample[new]]))
            fresh = finish[sample[new]] - begin[sample[new]]
            self.raw = np.concatenate([self.raw, data[expand(begin[sample[new]], fresh)]])
            self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(fresh)])
            every = np.concatenate([self.keys, distinct[new]])
            by = np.argsort(every, kind="stable")
            self.keys, self.index = every[by], np.concatenate([self.index, np.arange(first, self.pieces, dtype=np.int32)])[by]
        piece = self.index[np.searchsorted(self.keys, distinct)][which]
        length = self.length[piece]
        flat = self.ids[expand(self.start[piece], length)]
        total = np.append(0, np.cumsum(length))[np.searchsorted(begin, at)]
        bounds = total + np.arange(t.n + 1)
        out = np.empty(len(flat) + t.n, np.uint32)
        ends = bounds[1:] - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep], out[ends] = flat, end_id
        return out, bounds


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path)
