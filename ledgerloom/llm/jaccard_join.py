"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance 1 - J is a metric. Pivots that are whole documents do not divide it: two texts that are not copies are at
distance 1, or nearly, so every text lies within the triangle window of every such pivot (README has figures). Pivots are therefore
small sets of the corpus' own shingles. A set of n shingles is at distance 1 - k / n from a pivot of k of them and at 1 from pivots
that it shares nothing with, so its nearest pivots of one shingle are its own; ties go to the rarer shingle, and its Voronoi region is
that of its rarest one. A set y within distance r = 1 - t of x overlaps it in at least t n shingles, so in any fixed order of all
shingles both must hold one pivot among their first n - ceil(t n) + 1: that is the window in which boundary documents are replicated.

1. ``profiles``: one scan gives each document's set size, a 128-bit set identity, and its distances to virtual pivots
   (how many of its shingles fall in each slice of the hash space: a bound on the symmetric difference), and
   counts all shingles in 2**16 bins, so that the order of rarity covers every document.
2. Equal sets are one class, stood for by the smallest doc_id.
3. ``regions``: a second scan sends (pivot, document) for every pivot of the window; the smallest document there is the
   region's centre. A region is streamed in order, so a hot one needs no more memory than a cold one.
4. Every member is held against its region's centre exactly. Members within the limit belong to the centre's component, so
   no pairs among them are needed.
5. Only pairs of different components can still add links. Regions of several components with over ``DIVIDE`` members are divided
   again: sets that overlap so much share at least l of their first n - ceil(t n) + l shingles, so pivots of l shingles, those of the
   region and one more, divide it without loss; and so on, ``LEVELS`` times. Regions are then joined: window on size, window on the
   distance to the centre (triangle inequality), bound from the virtual pivots, and what is left is compared exactly. Regions over
   ``CELL`` members are dealt out in cells of pairs of blocks.

Set elements are 64-bit hashes of shingles; sets are compared element by element.

Defined cases: null, empty or blank text has an empty set, n_shingles 0, and is linked with nothing; fewer words than a
shingle make one shingle of the whole sequence; a text of any length is one set; rows of one doc_id have set sizes of their own
and share a component; a null doc_id is a document like another, and a component of such alone has none; a similarity at exactly
the limit is a link; rows in are rows out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import keep, named, on_rows, small
from .textkit import SPACES, Texts, Words, grams, mix, signed, texts

WORDS, PERCENT = 4, 85
#: Virtual pivots are slices of the hash space, about one for each two shingles: at least and at most so many.
LEAST_SLICES, MOST_SLICES = 64, 8192
#: Slices that travel with the members of a region; the pairs found there are bounded by all slices before they are compared.
SKETCH = 256
#: Bins of the shingle counts that order shingles by rarity.
BINS = 16
#: Members of a region that one task compares; larger regions are dealt out in cells of pairs of blocks, each member at most
#: ``DIVIDE`` / ``CELL`` times; beyond ``DIVIDE`` members a region is divided by larger pivots, ``LEVELS`` - 1 times at most.
CELL, DIVIDE, LEVELS = 1024, 16_384, 5
#: Pairs of one document that a task compares.
PAIRS = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shingle_sets(t: Texts, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a run."""
    data = _LOWER[t.data]
    w = Words(Texts(data, t.at, t.first), ~SPACES[data])
    h = w.hashes()
    g = grams(h, k)
    out = []
    for i in range(t.n):
        a, b = int(w.at[i]), int(w.at[i + 1])
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        else:
            s = grams(h[a:b], b - a, 0x51ED270B + b - a) if b > a else h[:0]
        out.append(s)
    return out


def _identity(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(signed(mix(s + np.uint64(1)).sum(keepdims=True))[0]), int(signed(mix(s ^ np.uint64(0x7F4A7C159E3779B9)).sum(keepdims=True))[0])


def _slices(s: np.ndarray) -> np.ndarray:
    """How many of the hashes fall in each slice, up to 255; the number of slices is a power of two that follows the size."""
    size = min(MOST_SLICES, max(LEAST_SLICES, 1 << max(1, len(s)).bit_length() - 1))
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def _fold(v: np.ndarray, size: int) -> np.ndarray:
    """Counts of ``size`` slices from counts of more; sums of capped counts still differ by no more than the sets do."""
    while v.shape[-1] > size:
        half = v.shape[-1] // 2
        v = v[..., :half] + v[..., half:]
    return v


PROFILE = "doc_id long, copy long, n long, set_hi long, set_lo long, slices binary, sketch binary, bin int, found long"


def _profiles(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("n", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("slices", pa.binary()), ("sketch", pa.binary()), ("bin", pa.int32()), ("found", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << BINS, np.int64)
        for batch in batches:
            ids, copies = _get(batch, "doc_id"), _get(batch, "copy")
            for t in texts(_get(batch, "text")):
                sets = shingle_sets(t, k)
                n, hi, lo, vec, few = [], [], [], [], []
                for s in sets:
                    a, b = _identity(s)
                    n.append(len(s))
                    hi.append(a)
                    lo.append(b)
                    v = _slices(s)
                    vec.append(v.tobytes())
                    few.append(np.minimum(_fold(v.astype(np.int16), SKETCH), 255).astype(np.uint8).tobytes())
                found += np.bincount((np.concatenate(sets) >> np.uint64(64 - BINS)).astype(np.int64), minlength=1 << BINS)
                none = pa.nulls(t.n, pa.int32()), pa.nulls(t.n, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), copies.slice(t.first, t.n), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(vec, pa.binary()), pa.array(few, pa.binary()), *none], schema=schema)
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), f.type) for f in list(schema)[:7]), pa.array(full, pa.int32()), pa.array(found[full])], schema=schema)

    return task


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(k: int, percent: int, level: np.ndarray):
    """(shingle, document) of each document's rarest shingles; one copy of equal sets in a batch is enough."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            ids = np.asarray(_get(batch, "doc_id"))
            for t in texts(_get(batch, "text")):
                tokens, docs = [], []
                for i, s in enumerate(shingle_sets(t, k)):
                    if not len(s) or (me := _identity(s)) in seen:
                        continue
                    seen.add(me)
                    key = (level[(s >> np.uint64(64 - BINS)).astype(np.int64)] << np.uint64(56)) | (mix(s) >> np.uint64(8))
                    p = prefix_length(len(s), percent)
                    tokens.append(np.partition(key, p - 1)[:p] if p < len(s) else key)
                    docs.append(np.full(p, ids[t.first + i], np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(docs))], schema=schema)

    return task


def _windows(k: int, percent: int, level: np.ndarray, more: int):
    """(doc_id, tokens): each document's rarest shingles, ``more`` beyond the window of pivots of one, the rarest first."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _get(batch, "doc_id")
            for t in texts(_get(batch, "text")):
                tokens = []
                for s in shingle_sets(t, k):
                    key = np.sort((level[(s >> np.uint64(64 - BINS)).astype(np.int64)] << np.uint64(56)) | (mix(s) >> np.uint64(8)))
                    tokens.append(signed(key[: prefix_length(len(s), percent) + more]))
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), pa.array(tokens, pa.list_(pa.int64()))], schema=schema)

    return task


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, doc_id) to the rows of regions with several documents, each with the region's pivot."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("pivot", pa.int64())])
    token, doc, pivot, shared = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        token, doc = np.append(token, np.asarray(_get(batch, "token"))), np.append(doc, np.asarray(_get(batch, "doc_id")))
        new = np.append(True, token[1:] != token[:-1])
        lead = doc[np.flatnonzero(new)]
        if len(pivot):
            lead[0] = pivot[0]
        pivot = lead[np.cumsum(new) - 1]
        many = ~new
        many[:-1] |= ~new[1:]
        many[0] |= shared
        shared = bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][many[:-1]]) for x in (token, doc, pivot)], schema=schema)
        token, doc, pivot = token[-1:], doc[-1:], pivot[-1:]
    if shared and len(token):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, doc, pivot)], schema=schema)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).astype(np.int16) for x in column.to_pylist()]


def _possible(percent: int):
    """Keep pairs whose sizes and distances to the virtual pivots allow a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if batch.num_rows:
                n = np.asarray(_get(batch, "n_a")) + np.asarray(_get(batch, "n_b"))
                apart = np.zeros(batch.num_rows, np.int64)
                for i, (x, y) in enumerate(zip(_vectors(_get(batch, "v_a")), _vectors(_get(batch, "v_b")), strict=True)):
                    size = min(len(x), len(y))
                    apart[i] = np.abs(_fold(x, size) - _fold(y, size)).sum()
                ok = pa.array(apart * (100 + percent) <= (100 - percent) * n)
                yield pa.RecordBatch.from_arrays([_get(batch, "a").filter(ok), _get(batch, "b").filter(ok)], schema=schema)

    return task


def _compare(k: int):
    """Rows sorted by (b, salt, a), the text of b ahead (a null), to exact (a, b, both, either)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            a, b = _get(batch, "a").to_pylist(), np.asarray(_get(batch, "b"))
            for t in texts(_get(batch, "text")):
                rows, both, either = [], [], []
                for i, s in enumerate(shingle_sets(t, k)):
                    r = t.first + i
                    if a[r] is None:
                        held = s
                        continue
                    x = np.sort(np.concatenate([s, held]))
                    rows.append(r)
                    both.append(int((x[1:] == x[:-1]).sum()))
                    either.append(len(x) - both[-1])
                yield pa.RecordBatch.from_arrays([pa.array([a[r] for r in rows], pa.int64()), pa.array(b[rows] if rows else [], pa.int64()), pa.array(both, pa.int64()), pa.array(either, pa.int64())], schema=schema)

    return task


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact set comparison of candidate pairs (a, b) that the bounds allow. One text a pair travels, and one for up to ``PAIRS`` pairs of b."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("slices").alias(f"v_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    left = keep(sized.mapInArrow(_possible(percent), "a long, b long"))
    salts = keep(left.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts")))
    hot = small(keep(salts.where("salts > 1")))
    salted = left.join(hot, "b", "left").select("a", "b", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("salts"))).cast("int").alias("salt"))
    ids = small(keep(left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()))
    whole = keep(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"))
    one = salted.join(whole.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "b", "salt", "text")
    centre = whole.select(F.col("doc_id").alias("b"), "text").join(salts, "b").select(F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = one.unionByName(centre).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return keep(both.mapInArrow(_compare(k), "a long, b long, both long, either long"))


def _mixed(members: DataFrame, region: str) -> DataFrame:
    """Regions that hold several components, with their size; of regions of the same documents one."""
    who = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"who{k}") for k in (1, 2)]
    mixed = members.groupBy(region).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), *who).where("lo < hi")
    return keep(mixed.groupBy("members", "who1", "who2").agg(F.min(region).alias(region)).select(region, "members"))


def _divided(members: DataFrame, docs: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """``members`` (token, doc_id, pivot, component, n) of regions of several components with their size, large ones divided by pivots of more
    shingles: region, token, doc_id, pivot (null beyond the first division), component, n, members.

    Sets that may overlap in no more shingles than the pivot has stay in the region as well: a larger pivot would lose them.
    """
    first = _mixed(members, "token")
    rows = members.join(first, "token").withColumn("region", F.col("token"))
    done = [rows.where(F.col("members") <= DIVIDE)]
    big = keep(rows.where(F.col("members") > DIVIDE).withColumn("own", F.array("token")))
    for more in range(1, LEVELS):
        if big.isEmpty():
            return reduce(DataFrame.unionByName, [d.drop("own") for d in done])
        done.append(big.where(F.ceil(F.col("n") * percent / 100) <= F.size("own")))
        inside = docs.join(small(keep(big.select("doc_id").distinct())), "doc_id", "left_semi")
        wide = inside.mapInArrow(_windows(k, percent, level, more), "doc_id long, tokens array<long>")
        each = big.drop("members").join(wide, "doc_id").withColumn("next", F.explode(F.array_except("tokens", "own")))
        each = each.withColumn("own", F.array_sort(F.array_union("own", F.array("next")))).withColumn("region", F.xxhash64("own")).drop("next", "tokens")
        each = keep(each.withColumn("pivot", F.lit(None).cast("long")).dropDuplicates(["region", "doc_id"]))
        rows = each.join(_mixed(each, "region"), "region")
        done.append(rows.where(F.col("members") <= DIVIDE))
        big = keep(rows.where(F.col("members") > DIVIDE))
    return reduce(DataFrame.unionByName, [d.drop("own") for d in [*done, big]])


def _cells(percent: int):
    """Rows sorted by (token, cell, n): pairs of different components that every bound allows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ("token", "cell", "block", "doc_id", "component", "n", "both", "either")

    def group(c: dict[str, np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        sizes = np.array([len(x) for x in v])
        folded: dict[int, np.ndarray] = {}
        doc, comp, n, block = c["doc_id"], c["component"], c["n"], c["block"]
        far = np.where(c["either"] > 0, 1 - c["both"] / np.maximum(c["either"], 1), np.nan)
        limit = 1 - percent / 100 + 1e-9
        split = block.min() != block.max()
        for i in range(len(doc) - 1):
            j = np.arange(i + 1, int(np.searchsorted(n * percent, 100 * n[i], "right")))
            j = j[(comp[j] != comp[i]) & ((block[j] != block[i]) | (not split)) & ~(np.abs(far[j] - far[i]) > limit)]
            if len(j):
                size = int(sizes[i])
                if size not in folded:  # sizes ascend, so what follows has as many slices or more
                    folded = {size: np.stack([_fold(x, size) for x in v[i:]])}
                    base = i
                m = folded[size]
                j = j[np.abs(m[j - base] - m[i - base]).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n[j] + n[i])]
                left.append(np.minimum(doc[i], doc[j]))
                right.append(np.maximum(doc[i], doc[j]))
        return (np.concatenate(left), np.concatenate(right)) if left else (doc[:0], doc[:0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4096:
                continue
            key = np.asarray(held["token"]) ^ (np.asarray(held["cell"]) << 40)
            cut = np.flatnonzero(key != key[-1])
            if not len(cut):
                continue
            ready, held = held.slice(0, int(cut[-1]) + 1), held.slice(int(cut[-1]) + 1)
            yield from pairs(ready)
        if held is not None and held.num_rows:
            yield from pairs(held)

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: np.asarray(table[k].fill_null(0)) for k in names}
        v = _vectors(table["sketch"].combine_chunks())
        edge = np.flatnonzero((c["token"][1:] != c["token"][:-1]) | (c["cell"][1:] != c["cell"][:-1])) + 1
        found = [group({k: x[a:b] for k, x in c.items()}, v[a:b]) for a, b in zip([0, *edge], [*edge, len(v)], strict=True)]
        both = np.unique(np.stack([np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    return task


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, copy, n_shingles, component_id for rows (doc_id, copy, text) whose doc_ids are distinct and not null."""
    spark = docs.sparkSession
    table = keep(docs.mapInArrow(_profiles(k), PROFILE))
    counts = table.where("bin is not null").groupBy("bin").agg(F.sum("found").alias("found")).collect()  # 2**BINS rows at most
    found = np.ones(1 << BINS)
    for r in counts:
        found[r["bin"]] += r["found"]
    level = np.clip(np.log2(found / found.mean()) + 1, 0, 200).astype(np.uint64)
    mine = table.where("bin is null")
    first = mine.where("n > 0").groupBy("set_hi", "set_lo", "n").agg(F.min("doc_id").alias("rep"))
    classes = keep(mine.join(first, ["set_hi", "set_lo", "n"], "left").select("doc_id", "copy", "n", "slices", "sketch", F.coalesce("rep", "doc_id").alias("rep")))
    reps = classes.where("doc_id = rep").dropDuplicates(["doc_id"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = docs.mapInArrow(_prefixes(k, percent, level), "token long, doc_id long")
    region = keep(tokens.repartition(parts, "token").sortWithinPartitions("token", "doc_id").mapInArrow(_regions, "token long, doc_id long, pivot long"))
    rep_of = classes.select("doc_id", "rep").where("doc_id != rep").distinct()
    stand = lambda df, c: df.join(rep_of.select(F.col("doc_id").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    stars = stand(stand(region.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "a"), "b").where("a != b").distinct()
    star = _verified(stars, reps, docs, k, percent)
    linked = lambda df: df.where(f"100 * both >= {percent} * either").select("a", "b")
    comps = keep(components(linked(star)))
    members = stand(stand(region, "doc_id"), "pivot").distinct()
    members = members.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).join(reps.select("doc_id", "n"), "doc_id")
    members = keep(members)
    rows = _divided(members, docs, k, percent, level).join(reps.select("doc_id", "sketch"), "doc_id")
    rows = rows.join(star.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "both", "either"), ["doc_id", "pivot"], "left")
    blocks = F.ceil(F.col("members") / CELL).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    cells = rows.select(F.col("region").alias("token"), "cell", "block", "doc_id", "component", "n", "sketch", "both", "either")
    more = cells.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "n").mapInArrow(_cells(percent), "a long, b long").distinct()
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = _verified(more.join(known, ["a", "b"], "left_anti"), reps, docs, k, percent)
    final = components(linked(late).join(comps.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("component", "a").alias("a"), "b").join(comps.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("b")))
    lifted = comps.join(final.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = final.join(comps.select("node"), "node", "left_anti").select("node", "component")
    where = lifted.unionByName(alone)
    out = classes.join(where.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "copy", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, copy (hash of the text), n_shingles (set size) and component_id (smallest doc_id reachable), a row for each input row."""
    docs = named(docs)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null")
    if again.isEmpty():
        return _joined(docs, k, percent)
    # texts are nodes of their own; those of one doc_id are linked with each other
    nodes = keep(docs.select("doc_id", "copy").distinct().withColumn("node", F.monotonically_increasing_id()))
    each = keep(on_rows(docs, nodes).select(F.col("node").alias("doc_id"), "copy", "text").dropDuplicates(["doc_id"]))
    found = keep(_joined(each, k, percent).select(F.col("doc_id").alias("node"), "n_shingles", "component_id").join(nodes, "node"))
    first = found.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    more = components(found.join(first, "doc_id").select(F.col("component_id").alias("b"), "a"))
    found = found.join(more.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("top", F.coalesce("component", "component_id"))
    least = found.groupBy("top").agg(F.min("doc_id").alias("least"))
    found = found.join(least, "top").select("doc_id", "copy", "n_shingles", F.col("least").alias("component_id"))
    return on_rows(docs.select("doc_id", "copy"), found)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copy")
