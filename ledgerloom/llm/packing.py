"""Bounded-space online packing of documents into windows of ``SIZE`` tokens.

Each partition streams its documents with a fixed number of open windows. A document's full windows leave at once; what
is left goes to the open window where it fits best; where it fits in none, a window is opened, and once ``OPEN`` are
open the fullest leaves first. At the end of a partition its open windows are leftovers. Leftovers of ``MERGE``
partitions at a time are merged: their pieces are laid end to end, cut at window bounds, and the last window is cut at
powers of two, which need no padding. Only leftovers, at most ``OPEN`` windows a partition, are shuffled.

Defined cases: null or empty text is one end token; a text longer than a window is cut; repeated rows are packed once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep
from .textkit import texts
from .tokenize import SLICE, encoder

SIZE, OPEN, MERGE, END_ID = 2048, 128, 32, 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, leftover boolean"
_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("leftover", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _pack(path: str, size: int, most: int, end_id: int, with_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        free: list[tuple[int, int]] = []  # (room, window) of the open windows, in order of room
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def close(window: int, leftover: bool) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, tokens in held.pop(window):
                out.append((doc, start, len(ids), zlib.crc32(ids), tokens, base + made, at, ids.tobytes() if leftover or with_ids else None, leftover))
                at += len(ids)
            made += 1

        opened = 0
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for t in texts(batch.column(batch.schema.get_field_index("text")), SLICE):
                flat, bounds = encoder(path).encode(t, end_id)
                for i in range(t.n):
                    ids, doc = flat[bounds[i] : bounds[i + 1]], docs[t.first + i]
                    n = len(ids)
                    whole = n // size * size
                    for start in range(0, whole, size):
                        held[-1] = [(doc, start, ids[start : start + size], n)]
                        close(-1, False)
                    rest = n - whole
                    if not rest:
                        continue
                    j = bisect_left(free, (rest, -1))
                    if j < len(free):
                        room, window = free.pop(j)
                    else:
                        if len(free) >= most:
                            close(free.pop(0)[1], False)
                        room, window, opened = size, opened, opened + 1
                        held[window] = []
                    held[window].append((doc, whole, ids[whole:].copy(), n))
                    if room == rest:
                        close(window, False)
                    else:
                        insort(free, (room - rest, window))
                if out:
                    yield _batch(out)
                    out.clear()
        for window in sorted(held):
            close(window, True)
        if out:
            yield _batch(out)

    return task


def _merge(size: int, with_ids: bool):
    """Rows sorted by (group, sequence_id, offset): lay pieces end to end in new windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, window, room, pieces, out = None, 0, size, [], []

        def flush(cuts: list[int]) -> None:
            """The open pieces in sequences of the given lengths."""
            nonlocal window, pieces
            queue, pieces = pieces[::-1], []
            for length in cuts:
                at = 0
                while at < length:
                    doc, start, ids, n = queue.pop()
                    part = ids[: length - at]
                    if len(part) < len(ids):
                        queue.append((doc, start + len(part), ids[len(part) :], n))
                    out.append((doc, start, len(part), zlib.crc32(part), n, (1 << 62) + (group << 32) + window, at, part.tobytes() if with_ids else None, False))
                    at += len(part)
                window += 1

        def finish() -> None:
            used = size - room
            flush([1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1])

        for batch in batches:
            for g, doc, start, n, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                if g != group:
                    if group is not None:
                        finish()
                    group, window, room = g, 0, size
                ids = np.frombuffer(raw, np.uint32)
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    pieces.append((doc, start, part, n))
                    start += len(part)
                    room -= len(part)
                    if not room:
                        flush([size])
                        room = size
            if out:
                yield _batch(out)
                out.clear()
        if group is not None:
            finish()
            if out:
                yield _batch(out)

    return task


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, most: int = OPEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (little-endian 32 bits)."""
    table = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, size, most, end_id, with_ids), PIECES))
    left = table.where("leftover").withColumn("grp", F.shiftright("sequence_id", 32).cast("long") / F.lit(MERGE)).withColumn("grp", F.floor("grp").cast("long"))
    left = left.select("grp", "sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = left.repartition(parts, "grp").sortWithinPartitions("grp", "sequence_id", "offset").mapInArrow(_merge(size, with_ids), PIECES)
    return table.where("not leftover").unionByName(merged).drop("leftover")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
