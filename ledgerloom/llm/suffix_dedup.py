"""Exact removal of repeated 50-byte strings, by suffix sorting of shards.

Equal strings of ``WINDOW`` bytes must meet in one shard. Each has a minimiser (the least hash among its ``GRAM``-byte grams);
consecutive strings with one minimiser form a segment of the document, and segments go to the minimiser's shard.

1. Exact copies of a text are represented by their smallest document.
2. (minimiser, document) pairs are sorted by minimiser and streamed; only minimisers that two documents share stay.
3. Segments of those minimisers travel to their shards, in order of minimiser. A shard is sorted in parts of whole minimisers of
   about ``PART`` bytes. A segment goes on only where it shares, to the left or the right of its minimiser, as much with another
   document as any common string must. Distinct segments are laid end to end, and external induced sorting (``induced_sort``:
   disk-backed queues of suffix tuples that carry common-prefix values, recursion to the end) streams the suffixes in order;
   suffixes that share ``WINDOW`` bytes with their neighbour form a class, whose smallest document keeps its bytes.
   Queues and lists hold ``HELD`` bytes in memory, a fraction of a part, so the external path is the one that runs; minimisers
   with over ``HOT`` strings are dealt out by a 128-bit BLAKE2 digest of the string instead, with map-side minima and salted hot
   digests, so no shard gets a whole hot minimiser.
4. Each document removes the bytes under its repeated strings.

Defined cases: null or empty text has no bytes; texts under ``WINDOW`` bytes never change; rows of one doc_id are all kept, and
their strings never repeat against each other; a null doc_id is neither smaller nor larger than another, so its row stays as it
is; rows in are rows out; removed bytes may split a character, so results are bytes; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import BITS, HELD, LOW, sorted_suffixes
from .store import keep, named, numbered, small, spread_join
from .textkit import Texts, expand, mix, range_hashes, signed, texts, window_min

WINDOW, GRAM = 50, 16
#: Strings of one minimiser that a shard sorts; beyond it they are dealt out by fingerprint.
HOT = 200_000
#: Bytes of segments sorted at once.
PART = 4 << 20
#: Longest segment in strings; longer runs are cut, which changes no string.
LONGEST = 64


def _get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` bytes (a multiple of 8)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, gram, 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + eight[k : k + n]
    return mix(h)


def _minimisers(t: Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one minimiser: minimiser, document, first string (in the document), number of strings."""
    low = window_min(_grams(t.data, gram), window - gram + 1)
    count = np.maximum(np.diff(t.at) - window + 1, 0)
    which = np.repeat(np.arange(t.n), count)
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    low = low[t.at[which] + at]
    begin = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (which[1:] != which[:-1])))
    return signed(low[begin]), which[begin], at[begin], np.diff(np.append(begin, len(low)))


def _keys(window: int, gram: int):
    """(token, doc_id, sure): minimisers of each document. Where several documents of a batch share one, all of them are sure and
    only the smallest document is sent on, so a frequent minimiser is not gathered in full."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("sure", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(_get(batch, "doc_id"))
            found = [(key, ids[t.first + doc]) for t in texts(_get(batch, "text")) for key, doc, _, _ in [_minimisers(t, window, gram)]]
            if not found:
                continue
            key, doc = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            by = np.lexsort((doc, key))
            key, doc = key[by], doc[by]
            once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            key, doc = key[once], doc[once]
            first = np.append(True, key[1:] != key[:-1])[: len(key)]
            shared = ~first
            shared[:-1] |= ~first[1:]
            for rows, sure in ((first, False), (shared, True)):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(doc[rows]), pa.array(np.full(int(rows.sum()), sure))], schema=schema)

    return task


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, doc_id) to those of tokens with several documents; a token's rows are streamed, never held."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64())])
    token, doc, sent = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the row held back, and whether its token is shared
    for batch in batches:
        if not batch.num_rows:
            continue
        token, doc = np.append(token, np.asarray(_get(batch, "token"))), np.append(doc, np.asarray(_get(batch, "doc_id")))
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        end = np.append(begin[1:], len(token))
        many = np.repeat(doc[begin] != doc[end - 1], end - begin)
        if sent:
            many[: end[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(token[:-1][many[:-1]]), pa.array(doc[:-1][many[:-1]])], schema=schema)
        token, doc, sent = token[-1:], doc[-1:], bool(many[-1])
    if sent and len(token):
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(doc)], schema=schema)


_SEGMENT = pa.schema([("mini", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
SEGMENT = "mini long, doc_id long, nth int, first long, n long, packed binary"


def _segments(window: int, gram: int):
    """Rows (doc_id, nth, text, keys) to the segments of those minimisers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nth, keys = np.asarray(_get(batch, "doc_id")), np.asarray(_get(batch, "nth")), _get(batch, "keys")
            for t in texts(_get(batch, "text")):
                mini, doc, first, n = _minimisers(t, window, gram)
                edge = np.searchsorted(doc, np.arange(t.n + 1))
                wanted = np.concatenate([np.isin(mini[a:b], np.asarray(keys[t.first + i].values)) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]) if len(mini) else np.zeros(0, bool)
                mini, doc, first, n = mini[wanted], doc[wanted], first[wanted], n[wanted]
                parts = -(-n // LONGEST)
                piece = expand(np.zeros(len(n), np.int64), parts)
                mini, doc, first, n = (np.repeat(x, parts) for x in (mini, doc, first, n))
                first, n = first + piece * LONGEST, np.minimum(n - piece * LONGEST, LONGEST)
                a = t.at[doc] + first
                raw = t.data.tobytes()
                packed = [raw[x:y] for x, y in zip(a.tolist(), (a + n + window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(ids[t.first + doc]), pa.array(nth[t.first + doc]), pa.array(first), pa.array(n), pa.array(packed, pa.binary())], schema=_SEGMENT)

    return task


def likely(mini: np.ndarray, doc: np.ndarray, packed: list[bytes], window: int, gram: int) -> np.ndarray:
    """Which segments can share a string with one of another document.

    A common string holds the minimiser and reaches half of what is left over at least, to its left or to its right; so one of the two
    longer grams must be shared. Segments that hold their minimiser twice are not judged.
    """
    half = (window - gram) // 2
    size = np.array([len(x) for x in packed], np.int64)
    start = np.cumsum(size) - size
    text = np.frombuffer(b"".join(packed), np.uint8)
    h = signed(_grams(text, gram))
    row = np.repeat(np.arange(len(size)), size)[: len(h)]
    at = np.flatnonzero((h == mini[row]) & (np.arange(len(h)) + gram <= (start + size)[row]))
    owner, first, times = np.unique(row[at], return_index=True, return_counts=True)
    keep_ = np.ones(len(size), bool)
    one = times == 1
    owner, p = owner[one], at[first[one]]
    keep_[owner] = False
    for a, b in ((p - half, p + gram), (p, p + gram + half)):
        inside = (a >= start[owner]) & (b <= (start + size)[owner])
        who = owner[inside]
        key = mix(range_hashes(text, a[inside], b[inside]) ^ mini[who].view(np.uint64))
        by = np.argsort(key, kind="stable")
        key, d = key[by], doc[who[by]]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        if len(new):
            mixed = np.minimum.reduceat(d, new) < np.maximum.reduceat(d, new)
            keep_[who[by]] |= np.repeat(mixed, np.diff(np.append(new, len(key))))
    return keep_


def least_documents(segments: list[bytes], docs: np.ndarray, window: int, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments with their smallest documents: bounds (n + 1), and the smallest document of every string.

    Suffixes stream by in order, the largest first. A suffix between two that share ``window`` bytes shares them too and so begins a
    string, as no string holds the mark between segments.
    """
    size = np.array([len(x) for x in segments], np.int64)
    text = np.frombuffer(b"\xff".join(segments), np.uint8)  # no byte of UTF-8 is over 0xF4
    s = np.append(np.where(text == 255, np.uint8(1), text + np.uint8(2)), np.uint8(0))
    count = size - window + 1
    start = np.cumsum(size + 1) - size - 1
    bounds = np.append(0, np.cumsum(count))
    group, least, classes, last = np.empty(bounds[-1], np.int64), [], 0, -1
    passed = 0  # suffixes so far that share less with the one before
    for rows in sorted_suffixes(s, window, held):
        pos = rows >> BITS
        run = passed + np.cumsum((rows & LOW) < window)
        passed = int(run[-1])
        seg = np.searchsorted(start, pos, "right") - 1
        offset = pos - start[seg]
        here = offset < count[seg]
        seg, run, string = seg[here], run[here], (bounds[seg] + offset)[here]
        if not len(run):
            continue
        new = np.append(run[0] != last, run[1:] != run[:-1])
        number = classes - 1 + np.cumsum(new)
        group[string] = number
        owner = docs[seg]
        begin = np.flatnonzero(np.append(True, new[1:]))
        minima = np.minimum.reduceat(owner, begin)
        if not new[0]:
            least[-1][-1] = min(least[-1][-1], minima[0])
            minima = minima[1:]
        if len(minima):
            least.append(minima)
        classes, last = int(number[-1]) + 1, int(run[-1])
    return bounds, np.concatenate(least)[group] if least else group


_HITS = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])
HITS = "doc_id long, nth int, first long, last long"


def _hits(doc: np.ndarray, nth: np.ndarray, first: np.ndarray, n: np.ndarray, least_at: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Runs of strings of the segments whose smallest document is another."""
    string = np.repeat(least_at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    hit = least[string] < np.repeat(doc, n)
    seg = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(seg))
    seg, at = seg[hit], at[hit]
    begin = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1))[: len(seg)])
    end = np.append(begin[1:], len(seg))[: len(begin)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[seg[begin]]), pa.array(nth[seg[begin]], pa.int32()), pa.array(at[begin]), pa.array(at[end])], schema=_HITS)


def _shards(window: int, gram: int, part: int, held: int):
    """Rows sorted by minimiser: suffix-sort whole minimisers, about ``part`` bytes at a time."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.filter(pa.array(likely(np.asarray(rows["mini"]), np.asarray(rows["doc_id"]), rows["packed"].to_pylist(), window, gram)))
        packed = rows["packed"].combine_chunks().dictionary_encode()
        which = np.asarray(packed.indices)
        doc, nth, first, n = (np.asarray(rows[c]) for c in ("doc_id", "nth", "first", "n"))
        if not len(doc):
            return pa.RecordBatch.from_arrays([pa.nulls(0, f.type) for f in _HITS], schema=_HITS)
        least_doc = np.full(len(packed.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least_doc, which, doc)
        bounds, least = least_documents(packed.dictionary.to_pylist(), least_doc, window, held)
        return _hits(doc, nth, first, n, bounds[which], least)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                pieces.append(piece)
                size += _get(piece, "packed").nbytes
                if size >= part:
                    rows = pa.Table.from_batches(pieces)
                    keys = np.asarray(rows["mini"])
                    other = np.flatnonzero(keys != keys[-1])
                    if len(other):
                        cut = int(other[-1]) + 1
                        yield solve(rows.slice(0, cut))
                        pieces = rows.slice(cut).to_batches()
                        size = sum(_get(x, "packed").nbytes for x in pieces)
        if pieces:
            yield solve(pa.Table.from_batches(pieces))

    return task


def _strings(window: int):
    """Strings of hot minimisers, one row each, by their 128-bit digest."""
    schema = pa.schema([("string", pa.binary()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("first", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                n, first, doc, nth = (np.asarray(_get(rows, c)) for c in ("n", "first", "doc_id", "nth"))
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                digest = [hashlib.blake2b(x[i : i + window], digest_size=16).digest() for x, m in zip(_get(rows, "packed").to_pylist(), n.tolist(), strict=True) for i in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(np.repeat(doc, n)), pa.array(np.repeat(nth, n)), pa.array(np.repeat(first, n) + offset)], schema=schema)

    return task


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"


def _clean(window: int):
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs, rows = _get(batch, "doc_id").to_pylist(), _get(batch, "runs"), []
            for t in texts(_get(batch, "text")):
                for i in range(t.n):
                    raw = t.text(i)
                    own = runs[t.first + i].values
                    first, last = (np.asarray(own.field(k)) for k in (0, 1))
                    gone = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, last + window, -1)
                    out = np.cumsum(gone)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                    kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
                    rows.append((ids[t.first + i], len(raw), int(out.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), [{"first": int(a), "last": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return task


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, part: int = PART, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` (bytes, last exclusive)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["doc_id", "nth"]
    docs = named(docs).withColumn("text", F.coalesce("text", F.lit("")))
    known = numbered(docs.where("doc_id is not null")).drop("copy")
    facts = keep(known.select(*key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    first = keep(facts.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("members")).where("first_id < last_id").drop("last_id"))
    copies = small(keep(spread_join(facts.select(*key, "sha"), first, ["sha"], "members").where("doc_id > first_id").select(*key).distinct()))
    live = known.join(copies, key, "left_anti")
    tokens = live.mapInArrow(_keys(window, gram), "token long, doc_id long, sure boolean")
    sent = tokens.where("not sure").select("token", "doc_id").repartition(parts, "token").sortWithinPartitions("token", "doc_id").mapInArrow(_shared, "token long, doc_id long")
    per = keep(sent.unionByName(tokens.where("sure").select("token", "doc_id")).groupBy("doc_id").agg(F.collect_set("token").alias("keys")))
    candidates = live.join(small(per.select("doc_id")), "doc_id", "left_semi").join(per, "doc_id").select(*key, "text", "keys")
    pieces = keep(candidates.mapInArrow(_segments(window, gram), SEGMENT))
    hots = small(keep(pieces.groupBy("mini").agg(F.sum("n").alias("strings")).where(F.col("strings") > hot).select("mini")))
    cold = pieces.join(hots, "mini", "left_anti").repartition(parts, "mini").sortWithinPartitions("mini").mapInArrow(_shards(window, gram, part, held), HITS)
    each = pieces.join(hots, "mini", "left_semi").mapInArrow(_strings(window), "string binary, doc_id long, nth int, first long")
    least = keep(each.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("members")).where("least < most").drop("most"))
    hotter = spread_join(each, least, ["string"], "members").where("doc_id > least").select(*key, "first", F.col("first").alias("last"))
    runs = keep(cold.unionByName(hotter).groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    found = small(runs.select(*key))
    changed = live.join(found, key, "left_semi").join(runs, key).select("doc_id", "text", "runs").mapInArrow(_clean(window), RESULT)
    copied = facts.join(copies, key).where(f"n_bytes >= {window}")
    span = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))
    copied = copied.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), span.alias("spans"))
    zero = F.lit(0).cast("long")
    short = facts.join(copies, key, "left_semi").where(f"n_bytes < {window}")
    nameless = docs.where("doc_id is null").select("doc_id", F.lit(0).alias("nth"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rest = facts.join(copies, key, "left_anti").join(found, key, "left_anti").unionByName(short).unionByName(nameless)
    same = rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"))
    return changed.unionByName(copied).unionByName(same)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
