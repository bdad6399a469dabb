"""Token ids in a compact file: canonical length-limited Huffman codes from counts over the whole corpus.

The file is a folder of two Parquet tables. ``codes`` has the code length of each id (canonical codes follow from the
lengths). ``blocks`` has one row for each independent block of whole documents, in ascending doc_id order: shard, block,
tokens before it in its shard, doc_ids, lengths, the bit stream, its CRC-32, and a bit-offset checkpoint after every
``STRIDE`` tokens, so that a block decodes from any checkpoint and all its runs decode side by side by table.

1. One scan encodes every text and counts ids; each task sends its counts and its documents' ids (compressed).
2. Counts are summed; at most one row an id of the vocabulary reaches the driver, which makes the code lengths by
   package-merge and sends the tables (bounded by the vocabulary) with the tasks.
3. Ids are dealt by range of doc_id, sorted, and written block by block. A block holds whole documents and closes at
   ``BLOCK`` tokens, so a very long document is a block of its own.
4. Readers decode blocks and add the tokens of the shards before.

Codes have at most ``MAX_BITS`` bits, or as many as the number of ids in use needs.

Defined cases: null or empty text is the end id alone; null doc_ids come first, as null (``nulls`` counts them in a block);
repeated doc_ids stay as several documents side by side, ordered by the CRC-32 of their packed ids; equal counts take code lengths in
order of id; an empty table gives files without blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep, scratch
from .textkit import texts
from .tokenize import SLICE, encoder

BLOCK, STRIDE, MAX_BITS = 1 << 17, 64, 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    level, flags = leaf, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        flags.append(by < n)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for flag in flags[::-1]:
        own = int(flag[:take].sum())
        out[:own] += 1
        take = 2 * (take - own)
    lengths = np.empty(n, np.int64)
    lengths[order] = out
    return lengths


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: codes ascend by (length, symbol)."""
    by = np.lexsort((symbols, lengths))
    codes, code, last = np.zeros(len(symbols), np.int64), 0, 0
    for length in np.unique(lengths):
        own = by[lengths[by] == length]
        code <<= int(length) - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(length)
    return codes


class Codec:
    """Encoding and decoding tables for ids below ``size``."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, size: int, max_bits: int = MAX_BITS):
        self.bits, self.step = max_bits, (max_bits + 14) // 8  # bytes that any code can touch
        codes = canonical(symbols, lengths)
        self.code, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code[symbols], self.length[symbols] = codes, lengths
        first = codes << (max_bits - lengths)
        by = np.argsort(first)
        self.symbol_of = np.zeros(1 << max_bits, np.uint32)
        self.length_of = np.ones(1 << max_bits, np.int64)
        spread = 1 << (max_bits - lengths[by])
        filled = int(spread.sum())
        self.symbol_of[:filled] = np.repeat(symbols[by], spread)
        self.length_of[:filled] = np.repeat(lengths[by], spread)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bits of each run of ``STRIDE`` ids."""
        length = self.length[ids]
        end = np.cumsum(length)
        start = end - length
        total = int(end[-1]) if len(end) else 0
        step = self.step
        value = self.code[ids] << (8 * step - (start & 7) - length)
        byte = start >> 3
        size = (total + 7) // 8
        out = np.zeros(size + step)
        for k in range(step):
            out += np.bincount(byte + k, (value >> (8 * (step - 1 - k))) & 255, size + step)[: size + step]
        return out[:size].astype(np.uint8).tobytes(), np.add.reduceat(length, np.arange(0, len(ids), STRIDE)) if len(ids) else length

    def decode(self, stream: bytes, runs: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids, every run of ``STRIDE`` from its own checkpoint, all runs side by side."""
        step = self.step
        data = np.frombuffer(stream + bytes(step), np.uint8).astype(np.int64)
        at = np.cumsum(runs) - runs
        out = np.zeros((STRIDE, len(runs)), np.uint32)
        mask, drop, last = (1 << self.bits) - 1, 8 * step - self.bits, len(data) - step
        for k in range(min(STRIDE, n)):
            byte = np.minimum(at >> 3, last)
            window = data[byte]
            for j in range(1, step):
                window = window << 8 | data[byte + j]
            peek = (window >> (drop - (at & 7))) & mask
            out[k] = self.symbol_of[peek]
            at = at + self.length_of[peek]
        return out.T.reshape(-1)[:n]


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


ENCODED = "doc_id long, n long, ids binary, id int, found long"


def _encoded(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("id", pa.int32()), ("found", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path), zstandard.ZstdCompressor(3)
        found = np.zeros(max(enc.size, end_id + 1), np.int64)
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id"))
            for t in texts(batch.column(batch.schema.get_field_index("text")), SLICE):
                flat, bounds = enc.encode(t, end_id)
                found += np.bincount(flat, minlength=len(found))
                narrow = flat.astype(_width(enc.size))
                blobs = [pack.compress(narrow[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([docs.slice(t.first, t.n), pa.array(np.diff(bounds)), pa.array(blobs, pa.binary()), pa.nulls(t.n, pa.int32()), pa.nulls(t.n, pa.int64())], schema=schema)
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), f.type) for f in list(schema)[:3]), pa.array(full, pa.int32()), pa.array(found[full])], schema=schema)

    return task


BLOCKS = "shard int, block int, before long, n_tokens long, nulls int, doc_ids binary, lengths binary, stream binary, crc32 long, checkpoints binary"
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("nulls", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("stream", pa.binary()), ("crc32", pa.int64()), ("checkpoints", pa.binary())])


def _written(codec: Codec, width: str, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, open_zstd = TaskContext.get().partitionId(), 0, 0, zstandard.ZstdDecompressor()
        docs, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            stream, runs = codec.encode(np.concatenate(parts))
            row = [shard, number, before, held, docs.count(None), np.array([x or 0 for x in docs], "<i8").tobytes(), np.array([len(x) for x in parts], "<u4").tobytes(), stream, zlib.crc32(stream), runs.astype("<u2").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            for doc, blob in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("ids")), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(open_zstd.decompress(blob.as_buffer()), width))
                held += len(parts[-1])
                if held >= block:
                    yield close()
                    number, before = number + 1, before + held
                    docs, parts, held = [], [], 0
        if parts:
            yield close()

    return task


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK) -> None:
    """Encode ``docs`` (doc_id, text) to a token file at ``path``."""
    size = max(encoder(tokenizer).size, end_id + 1)
    table = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(tokenizer, end_id), ENCODED))
    counts = table.where("id is not null").groupBy("id").agg(F.sum("found").alias("found")).orderBy("id").collect()  # one row an id of the vocabulary
    symbols = np.array([r["id"] for r in counts], np.int64)
    bits = max(MAX_BITS, (len(symbols) - 1).bit_length())
    lengths = code_lengths(np.array([r["found"] for r in counts], np.int64), bits)
    spark = docs.sparkSession
    spark.createDataFrame([(int(s), int(n), size, bits) for s, n in zip(symbols, lengths, strict=True)], "id int, bits int, size int, most int").write.parquet(f"{path}/codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table.where("id is null").select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.crc32("ids"))
    rows.mapInArrow(_written(Codec(symbols, lengths, size, bits), _width(encoder(tokenizer).size), block), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


TOKENS = "shard int, doc_id long, before long, n_tokens long, ids binary, ids_crc32 long"


def _read(codec: Codec, with_ids: bool):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
    names = ("shard", "before", "n_tokens", "nulls", "doc_ids", "lengths", "stream", "crc32", "checkpoints")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, n, nulls, docs, lengths, stream, crc, runs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if zlib.crc32(stream) != crc:
                    raise ValueError("a block of the token file is damaged")
                size = np.frombuffer(lengths, "<u4").astype(np.int64)
                raw = codec.decode(stream, np.frombuffer(runs, "<u2").astype(np.int64), n).astype("<u4").tobytes()
                end = np.cumsum(size)
                parts = [raw[4 * (b - a) : 4 * b] for a, b in zip(size.tolist(), end.tolist(), strict=True)]
                cols = [pa.array([shard] * len(size), pa.int32()), pa.array(np.frombuffer(docs, "<i8"), mask=np.arange(len(size)) < nulls), pa.array(before + end - size), pa.array(size), pa.array(parts, pa.binary()) if with_ids else pa.nulls(len(size), pa.binary()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return task


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32 bits), ids_crc32."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # one row an id of the vocabulary
    codec = Codec(np.array([r["id"] for r in codes], np.int64), np.array([r["bits"] for r in codes], np.int64), max((r["size"] for r in codes), default=1), max((r["most"] for r in codes), default=MAX_BITS))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row a written partition
    start = np.cumsum([0, *(r["n"] for r in shards)]).tolist()
    base = spark.createDataFrame([(r["shard"], s) for r, s in zip(shards, start, strict=False)], "shard int, base long")
    rows = blocks.mapInArrow(_read(codec, with_ids), TOKENS)
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids", "ids_crc32")


def op1_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return read_tokens(spark, path, with_ids=False).drop("ids")
