"""Token ids of two tokenizers laid side by side: which ids share bytes, and how many documents hold each pair.

Both tokenizers (byte-level BPE: A; pieces with byte fallback: B) end a token before a single space between two characters that are
no white space: A's pattern gives that space to the next word, and no piece of B has a space after another character (checked
when the model is read; a model that has is encoded whole). A document is therefore a row of segments, and each distinct segment
is encoded and aligned once in a worker.

1. ``identity`` maps an A id to the B id of the same bytes, made once from both vocabularies. A link of such a pair is *exact*: it
   is counted by documents in a vector as long as A's vocabulary, one vector a task, summed by Spark. All other links (groups
   where the tokenizers cut differently) are *irregular*; only they become rows (document, pair, times).
2. Irregular pairs are counted, summed before the shuffle; the best count of each A id follows. Vectors of counts and of best
   counts are bounded by the vocabulary and go to every task; counts of pairs are not, so they are joined, hot pairs dealt out.
3. A document's exact links are kept as its A ids and how often each is linked; they are judged by the vectors without a shuffle.

Defined cases: texts that are null or empty, or whose bytes either tokenizer does not give back (U+2581, say), have no tokens: zeros and an
empty string; strings of special tokens are plain text; every row is a document of its own, so repeated rows count again; equal counts
are all best; a text of any length is aligned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, keep, meet
from .textkit import expand

#: Segments held in a worker (some 300 bytes each); beyond it they start afresh.
HELD = 700_000
#: Documents (or characters) that are summed up at once.
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        chars = byte_of_char()
        vocabulary = self.a.get_vocab()
        self.a_size, self.b_size = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.a_size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        same: dict[bytes, int] = {}
        for i in range(self.b_size):
            if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)) and (self.b_bytes[i] not in same or not self.b.is_byte(i)):
                same[self.b_bytes[i]] = i
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)

    def segments(self, text: str) -> list[str]:
        """The text cut where both tokenizers end a token; the space of each cut is left out, as is the one before the text."""
        return _CUT.split(text) if self.cuts else [text]

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each segment with a space ahead."""
        first = self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(first, self.b.encode(segments, num_threads=1), strict=True)]


@functools.lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    """The worker's tokenizers."""
    return Pair(a_path, b_path)


class Aligner:
    """Segments met so far, one after the other in flat arrays: counts, and links as (code, times). An exact link has its A id as
    code, an irregular one A's size + A id * B's size + B id."""

    def __init__(self, p: Pair):
        self.pair = p
        self.a_len, self.b_len, self.same = [len(x) for x in p.a_bytes], [len(x) for x in p.b_bytes], p.identity.tolist()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # none: the bytes do not come back
        self.counts, self.codes, self.times, self.at = array("q"), array("q"), array("q"), array("q", [0])

    def _add(self, segment: str, a: list[int], b: list[int]) -> None:
        """Align a segment's ids and append it."""
        p, raw = self.pair, (" " + segment).encode()
        self.number[segment] = len(self.groups)
        if not b"".join([p.a_bytes[x] for x in a]) == raw == b"".join([p.b_bytes[y] for y in b]):
            self.groups.append(None)
            self.counts.extend((0, 0, 0, 0))
            self.at.append(len(self.codes))
            return
        a_len, b_len, same, a_size, b_size = self.a_len, self.b_len, self.same, p.a_size, p.b_size
        text, links, n_links, i, j, x, y = [], {}, 0, 0, 0, 0, 0
        while i < len(a):  # every id has bytes, so both end together
            first, other = i, j
            x, y, i, j = x + a_len[a[i]], y + b_len[b[j]], i + 1, j + 1
            while x != y:
                if x < y:
                    x, i = x + a_len[a[i]], i + 1
                else:
                    y, j = y + b_len[b[j]], j + 1
            if i - first == j - other == 1:
                u, v = a[first], b[other]
                text.append(f"{u}|{v}")
                code, n_links = u if same[u] == v else a_size + u * b_size + v, n_links + 1
                links[code] = links.get(code, 0) + 1
                continue
            own, theirs = a[first:i], b[other:j]
            text.append(",".join(map(str, own)) + "|" + ",".join(map(str, theirs)))
            n_links += len(own) * len(theirs)
            few = len(own) * len(theirs) <= 16  # of a long group equal ids are taken together
            right = [(v, 1) for v in theirs] if few else Counter(theirs).items()
            for u, n in [(u, 1) for u in own] if few else Counter(own).items():
                for v, m in right:
                    code = u if same[u] == v else a_size + u * b_size + v
                    links[code] = links.get(code, 0) + n * m
        self.groups.append(";".join(text))
        self.counts.extend((len(a), len(b), len(text), n_links))
        self.codes.extend(links.keys())
        self.times.extend(links.values())
        self.at.append(len(self.codes))

    def numbers(self, segments: list[str]) -> list[int]:
        """The number of each segment; new ones are encoded together."""
        found = list(map(self.number.get, segments))
        if None in found:
            new = list(dict.fromkeys(s for s, n in zip(segments, found, strict=True) if n is None))
            for s, (a, b) in zip(new, self.pair.encode(new), strict=True):
                self._add(s, a, b)
            found = list(map(self.number.get, segments))
        return found

    def forget(self) -> None:
        """Start afresh where too many segments are held, or very long ones."""
        if len(self.groups) > HELD or len(self.codes) > 8 * HELD:
            self._clear()

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the digest of its groups and its counts; and its links as (text, code, times), in order."""
        parts = [self.pair.segments(t) if t else [] for t in texts]
        flat = self.numbers([s for own in parts for s in own])
        digests, ends, groups = [], np.cumsum([len(own) for own in parts]).tolist(), self.groups
        keep = np.ones(len(flat), bool)
        for k, end in enumerate(ends):
            first = ends[k - 1] if k else 0
            own = [groups[s] for s in flat[first:end]]
            if None in own:
                own, keep[first:end] = [], False
            digests.append(hashlib.sha256(";".join(own).encode()).hexdigest() if own else "")
        who, which = np.repeat(np.arange(len(parts)), [len(own) for own in parts])[keep], np.array(flat, np.int64)[keep]
        held = len(groups)
        if not len(who):
            none = np.zeros(0, np.int64)
            return digests, np.zeros((len(texts), 4), np.int64), none, none, none
        both, often = np.unique(who * held + which, return_counts=True)
        who, which = np.divmod(both, held)
        total = np.array(self.counts, np.int64).reshape(-1, 4)[which] * often[:, None]
        counts = np.stack([np.bincount(who, total[:, c], len(texts)).astype(np.int64) for c in range(4)], 1)
        at = np.array(self.at, np.int64)
        size = at[which + 1] - at[which]
        links = expand(at[which], size)
        doc, code, n = np.repeat(who, size), np.array(self.codes, np.int64)[links], np.array(self.times, np.int64)[links] * np.repeat(often, size)
        by = np.lexsort((code, doc))
        doc, code, n = doc[by], code[by], n[by]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
        return digests, counts, doc[first], code[first], np.add.reduceat(n, first)


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's segments, held over its tasks."""
    return Aligner(pair(a_path, b_path))


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, exact binary, rows binary, pairs binary, times binary, a int, found long"
_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string())] + [(c, pa.binary()) for c in ("exact", "rows", "pairs", "times")] + [("a", pa.int32()), ("found", pa.int64())]
)


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ALIGNED], schema=_ALIGNED)


def _aligned(a_path: str, b_path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, squeeze = aligner(a_path, b_path), zstandard.ZstdCompressor(3).compress
        p = work.pair
        vector, row = np.zeros(p.a_size, np.int64), TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            k = 0
            while k < len(texts):
                end, held = k, 0
                while end < len(texts) and end - k < ROWS_AT_ONCE and (end == k or held + len(texts[end] or "") <= CHARS_AT_ONCE):
                    held += len(texts[end] or "")
                    end += 1
                digests, counts, doc, code, times = work.documents(texts[k:end])
                n, exact = end - k, code < p.a_size
                ids, often = code[exact], times[exact]
                vector += np.bincount(ids, minlength=p.a_size)
                at = np.searchsorted(doc[exact], np.arange(n + 1)).tolist()
                own = [squeeze(ids[x:y].astype("<u4").tobytes() + often[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                names = ("n_a", "n_b", "n_groups", "n_links")
                yield _batch(n, row=pa.array(np.arange(row, row + n)), doc_id=doc_ids.slice(k, n), groups_sha256=pa.array(digests, pa.string()), exact=pa.array(own, pa.binary()), **{c: pa.array(counts[:, j]) for j, c in enumerate(names)})
                if not exact.all():
                    yield _batch(1, **{c: pa.array([squeeze(x.astype("<i8").tobytes())]) for c, x in (("rows", row + doc[~exact]), ("pairs", code[~exact] - p.a_size), ("times", times[~exact]))})
                row += n
                work.forget()
                k = end
        full = np.flatnonzero(vector)
        yield _batch(len(full), a=pa.array(full.astype(np.int32)), found=pa.array(vector[full]))

    return task


LINKS = "row long, pair long, times long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Irregular links, a row each."""
    spread = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for blobs in zip(*(batch.column(c).to_pylist() for c in ("rows", "pairs", "times")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(spread(x), "<i8")) for x in blobs], names=["row", "pair", "times"])


JUDGED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, exact_best long, exact_sum long"


def _judged(found: np.ndarray, best: np.ndarray):
    """Exact links of each document against the vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            top, total = [], []
            for blob in batch.column("exact").to_pylist():
                ids, times = np.frombuffer(spread(blob), "<u4").astype(np.int64).reshape(2, -1)
                top.append(int(times[found[ids] == best[ids]].sum()))
                total.append(int((times * found[ids]).sum()))
            names = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(top, pa.int64()), pa.array(total, pa.int64())], names=[*names, "exact_best", "exact_sum"])

    return task


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """A row a document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pair table (a, b, docs, best)."""
    spark = docs.sparkSession
    bound_batches(spark)
    p = pair(a_path, b_path)
    table = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(a_path, b_path), ALIGNED))
    found = np.zeros(p.a_size, np.int64)
    for r in table.where("a is not null").groupBy("a").agg(F.sum("found").alias("n")).collect():  # one row an id of the vocabulary
        found[r["a"]] = r["n"]
    links = keep(table.where("pairs is not null").select("rows", "pairs", "times").mapInArrow(_links, LINKS))
    counts = keep(links.groupBy("pair").agg(F.count("*").alias("docs")))
    of = (F.col("pair") / p.b_size).cast("long")
    best = found.copy()
    for r in counts.groupBy(of.alias("a")).agg(F.max("docs").alias("n")).collect():  # one row an id of the vocabulary
        best[r["a"]] = max(best[r["a"]], r["n"])
    known = spark.createDataFrame([(a, int(n)) for a, n in enumerate(best) if n], "a long, top long")
    known = known.join(spark.createDataFrame([(a, int(b), int(n)) for a, (b, n) in enumerate(zip(p.identity, found, strict=True)) if n], "a long, same long, same_docs long"), "a", "left")
    known = keep(known)
    tops = F.broadcast(known.select("a", "top"))
    weighed = keep(counts.withColumn("a", of).join(tops, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")))
    times = F.col("times")
    rest = meet(links, weighed, ["pair"], "docs").groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("rest_best"), F.sum(times * F.col("docs")).alias("rest_sum"))
    out = table.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "exact").mapInArrow(_judged(found, best), JUDGED).join(rest, "row", "left")
    both = lambda c: (F.col(f"exact_{c}") + F.coalesce(f"rest_{c}", F.lit(0))).cast("long")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("best").alias("n_best"), both("sum").alias("count_sum"), "groups_sha256")
    exact = known.where("same is not null").select("a", F.col("same").alias("b"), F.col("same_docs").alias("docs"), (F.col("same_docs") == F.col("top")).alias("best"))
    pairs = exact.unionByName(weighed.select(of.alias("a"), F.pmod("pair", F.lit(p.b_size)).alias("b"), "docs", "best"))
    return out, pairs


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
