"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Each window has a minimiser: the least hash among its
``MINI``-word grams. Consecutive windows with one minimiser form a super-k-mer and travel as one packed string to
the minimiser's bucket, where the windows of a bucket are sorted and the smallest document of each is found.

Steps, all of them Spark jobs over the whole table:

1. ``runs``: every document's super-k-mers as (minimiser, document, first window, windows); no text travels.
2. Exact copies of a word sequence (SHA-256) are represented by their smallest document (all windows of the others start there).
3. Only minimisers that two representatives share can hold a repeated window; only their super-k-mers are packed, words
   joined by one space.
4. Buckets up to ``HOT`` windows are sorted in one task each, streamed from a partition sorted by minimiser: words get ranks
   (equal hashes are compared byte by byte), and blocks of 2, 4, 8 ... words get ranks from pairs of ranks, so that equal ranks
   are equal windows. Windows of larger buckets are dealt out by a 128-bit BLAKE2 digest of the packed window, with map-side
   minima, and hot digests are salted, so no task gets a whole hot bucket.
5. Each document removes the words under its repeated windows.

Defined cases: null or empty text has no words, nothing is removed and the kept text is empty; documents under 50 words
are never changed; rows of one ``doc_id`` are all kept, and their windows never repeat against each other; a null doc_id is
neither smaller nor larger than another, so its row stays as it is; rows in are rows out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, named, small, spread_join
from .textkit import Words, expand, grams, same_bytes, signed, space_words, spaced, texts, window_min

WINDOW, MINI = 50, 8
#: Windows of one bucket that a task sorts at once; larger buckets are dealt out by window.
HOT = 200_000
#: Longest super-k-mer in windows; longer runs are cut, which changes no window.
LONGEST = 64
RUNS = "doc_id long, copy long, seq binary, n_words long, mini long, first long, n long"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(window: int, mini: int):
    schema = pa.schema([(c.split()[0], pa.binary() if c.startswith("seq") else pa.int64()) for c in RUNS.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (np.asarray(_column(batch, c)) for c in ("doc_id", "copy"))
            for t in texts(_column(batch, "text")):
                w = space_words(t)
                h, s = w.hashes(), spaced(w)
                n_words = np.diff(w.at)
                own, copy = ids[t.first : t.first + t.n], copies[t.first : t.first + t.n]
                seq = [hashlib.sha256(s.words(a, b)).digest() for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
                low = window_min(grams(h, mini), window - mini + 1)
                inside = w.of_gram(window)
                doc = np.repeat(np.arange(t.n), n_words)[: len(low)]
                low, doc, where = low[inside], doc[inside], np.flatnonzero(inside)
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(low)))
                parts = -(-size // LONGEST)
                piece = expand(np.zeros(len(begin), np.int64), parts)
                begin2 = np.repeat(begin, parts) + piece * LONGEST
                size2 = np.minimum(np.repeat(size, parts) - piece * LONGEST, LONGEST)
                d = doc[begin2] if len(begin2) else np.zeros(0, np.int64)
                docs = [own, copy, seq, n_words, None, None, None]
                runs = [own[d], copy[d], None, None, signed(low[begin2]), where[begin2] - w.at[d], size2]
                for n, cols in ((t.n, docs), (len(d), runs)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return task


PACKED = "mini long, doc_id long, copy long, first long, n long, packed binary"


def _packed(window: int):
    """Rows (doc_id, copy, text, runs of (mini, first, n)) to rows (mini, doc_id, copy, first, n, packed)."""
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PACKED.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, runs = np.asarray(_column(batch, "doc_id")), np.asarray(_column(batch, "copy")), _column(batch, "runs")
            for t in texts(_column(batch, "text")):
                w = space_words(t)
                s = spaced(w)
                part = runs.slice(t.first, t.n)
                per = np.asarray(part.value_lengths().fill_null(0))
                flat = part.flatten()
                mini, first, n = (np.asarray(flat.field(k)) for k in range(3))
                doc = np.repeat(np.arange(t.n), per)
                a = w.at[doc] + first
                strings = [s.words(x, y) for x, y in zip(a.tolist(), (a + n + window - 1).tolist(), strict=True)]
                cols = [mini, ids[t.first + doc], copies[t.first + doc], first, n, strings]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return task


def _words_of(packed: list[bytes]) -> Words:
    return space_words(next(texts(pa.array(packed, pa.large_binary()).cast(pa.large_string()), 1 << 62)))


def word_ranks(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    h = w.hashes()
    by = np.argsort(h, kind="stable")
    a, b = by[:-1], by[1:]
    twin = np.flatnonzero(h[a] == h[b])
    if same_bytes(w.data, w.start[a[twin]], w.end[a[twin]], w.start[b[twin]], w.end[b[twin]]).all():
        rank = np.empty(len(h), np.int64)
        rank[by] = np.cumsum(np.append(0, h[a] != h[b])) if len(h) else 0
        return rank
    words = pa.array([w.word(i) for i in range(len(h))], pa.large_binary())  # two words share a hash
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def run_ranks(rank: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` ranks, equal for equal runs only: pairs of runs half as long, then two that overlap."""

    def pairs(x: np.ndarray, step: int) -> np.ndarray:
        key = x[:-step] * (int(x.max()) + 1) + x[step:]
        return np.unique(key, return_inverse=True)[1].reshape(-1)

    size = 1
    if len(rank) < k:
        return rank[:0]
    while size * 2 <= k:
        rank, size = pairs(rank, size), size * 2
    return pairs(rank, k - size) if k > size else rank


def _windows_of(first: np.ndarray, w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of packed strings: which word they start at, their string, and their start in its document."""
    inside = w.of_gram(window)
    string = np.repeat(np.arange(w.n), np.diff(w.at))[: len(inside)][inside]
    return np.flatnonzero(inside), string, first[string] + np.arange(len(string)) - np.searchsorted(string, string)


def _repeats(doc: np.ndarray, first: np.ndarray, packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings and window starts of one or several buckets that a smaller document has too."""
    w = _words_of(packed)
    at, string, start = _windows_of(first, w, window)
    rank = run_ranks(word_ranks(w), window)[at]
    d = doc[string]
    least = np.full(int(rank.max()) + 1 if len(rank) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, d)
    hit = d > least[rank]
    return string[hit], start[hit]


_HITS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("first", pa.int64())])


def _buckets(window: int, at_once: int):
    """Rows sorted by minimiser: sort whole buckets, several small ones at a time."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        doc, copy, first = (np.asarray(rows[c]) for c in ("doc_id", "copy", "first"))
        string, start = _repeats(doc, first, rows["packed"].to_pylist(), window)
        return pa.RecordBatch.from_arrays([pa.array(doc[string]), pa.array(copy[string]), pa.array(start, pa.int64())], schema=_HITS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                parts.append(batch.slice(k, 2000))
                held += int(np.asarray(_column(parts[-1], "n")).sum())
                if held >= at_once:
                    rows = pa.Table.from_batches(parts)
                    keys = np.asarray(rows["mini"])
                    other = np.flatnonzero(keys != keys[-1])
                    if len(other):
                        cut = int(other[-1]) + 1
                        yield flush(rows.slice(0, cut))
                        parts = rows.slice(cut).to_batches()
                        held = sum(int(np.asarray(_column(x, "n")).sum()) for x in parts)
        if parts:
            yield flush(pa.Table.from_batches(parts))

    return task


def _windows(window: int):
    """Windows of hot buckets, one row each, by the digest of their words."""
    schema = pa.schema([("window", pa.binary()), *_HITS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                w = _words_of(_column(part, "packed").to_pylist())
                at, string, start = _windows_of(np.asarray(_column(part, "first")), w, window)
                raw = w.data.tobytes()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(w.start[at].tolist(), w.end[at + window - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(np.asarray(_column(part, "doc_id"))[string]), pa.array(np.asarray(_column(part, "copy"))[string]), pa.array(start)], schema=schema)

    return task


def repeated_windows(docs: DataFrame, window: int = WINDOW, mini: int = MINI, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, copy) whose whole text a smaller document has, window starts of the others that a smaller document has).

    ``docs`` has doc_id (none null), copy and text.
    """
    table = keep(docs.mapInArrow(_runs(window, mini), RUNS))
    per_doc = table.where("mini is null").select("doc_id", "copy", "seq")
    first = keep(per_doc.groupBy("seq").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("members")).where("first_id < last_id"))
    copies = keep(spread_join(per_doc, first.drop("last_id"), ["seq"], "members").where("doc_id > first_id").select("doc_id", "copy").distinct())
    runs = table.where("mini is not null").select("doc_id", "copy", "mini", "first", "n").join(copies, ["doc_id", "copy"], "left_anti")
    shared = runs.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("windows"), F.count("*").alias("members")).where("a < b")
    wanted = keep(spread_join(runs, shared.select("mini", "members", (F.col("windows") > hot).alias("is_hot")), ["mini"], "members").drop("members"))
    per = wanted.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("mini", "first", "n")).alias("runs"))
    packed = keep(docs.join(per, ["doc_id", "copy"]).mapInArrow(_packed(window), PACKED))
    hots = keep(wanted.where("is_hot").select("mini").distinct())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = "doc_id long, copy long, first long"
    cold = packed.join(small(hots), "mini", "left_anti").repartition(parts, "mini").sortWithinPartitions("mini").mapInArrow(_buckets(window, 100_000), hits)
    each = keep(packed.join(small(hots), "mini", "left_semi").mapInArrow(_windows(window), f"window binary, {hits}"))
    least = each.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("members")).where("least < most").drop("most")
    hotter = spread_join(each, keep(least), ["window"], "members").where("doc_id > least").select("doc_id", "copy", "first")
    return copies, cold.unionByName(hotter)


def _clean(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.large_string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = _column(batch, "doc_id"), _column(batch, "starts")
            copy = np.asarray(_column(batch, "is_copy").fill_null(False))
            for t in texts(_column(batch, "text")):
                w = space_words(t)
                removed, sha, kept = [], [], []
                for i in range(t.n):
                    a, b = w.at[i], w.at[i + 1]
                    gone = np.zeros(b - a + 1, np.int32)
                    if copy[t.first + i] and b - a >= window:
                        gone[0] = 1
                    elif starts[t.first + i].is_valid:
                        at = np.unique(np.asarray(starts[t.first + i].values))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    left = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                    words = b" ".join([t.data[x:y].tobytes() for x, y in zip(w.start[left], w.end[left], strict=True)])
                    removed.append(int(b - a) - len(left))
                    sha.append(hashlib.sha256(words).hexdigest())
                    kept.append(words.decode())
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), pa.array(np.diff(w.at)), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.large_string())], schema=schema)

    return task


def dedup_windows(docs: DataFrame, window: int = WINDOW, mini: int = MINI, hot: int = HOT) -> DataFrame:
    """Each document with its repeated words removed: doc_id, n_words, n_removed, kept_sha256, kept."""
    docs = named(docs)
    copies, hits = repeated_windows(docs.where("doc_id is not null"), window, mini, hot)
    starts = hits.groupBy("doc_id", "copy").agg(F.collect_list("first").alias("starts"))
    notes = starts.join(copies.withColumn("is_copy", F.lit(True)), ["doc_id", "copy"], "full")
    whole = docs.join(notes, ["doc_id", "copy"], "left").select("doc_id", "text", "starts", "is_copy")
    return whole.mapInArrow(_clean(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
