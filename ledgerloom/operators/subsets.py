"""Subset sums of each key's rows: the one subset that makes a sum, and the sum nearest to a target.

Rows of a key meet their target in one shuffle by key; Arrow tasks then solve each key exactly. Up to ``FEW`` rows every sum is listed, its
place in the list being its members' bits. More rows are cut in two halves whose sums are sorted, equal sums joined and hopeless ones
dropped, and the two lists are run against each other. Forty rows make at most 2 ** 20 sums a half, so they are always answered;
only a half of over ``SUMS`` sums is not searched to its end (``bounded``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Rows whose sums are all listed; sums of a half that are held; rows whose members fit one integer of bits.
FEW, SUMS, WORD = 14, 1 << 20, 62


def all_sums(amounts: list[int]) -> np.ndarray:
    """The sum of every subset; a subset's place has the bits of its members."""
    s = np.zeros(1, np.int64)
    for x in amounts:
        s = np.concatenate([s, s + x])
    return s


class Half:
    """Distinct sums of some rows in order, how many subsets make each (up to two), and the bits of one of them."""

    def __init__(self, amounts: list[int], low: int, high: int, with_members: bool = True, most: int = SUMS):
        """Only sums that further rows can bring between ``low`` and ``high`` are held; ``full`` says that there were over ``most``."""
        words = (len(amounts) + WORD - 1) // WORD if with_members else 0
        self.sums, self.ways, self.bits = np.zeros(1, np.int64), np.ones(1, np.int8), np.zeros((1, words), np.int64)
        self.full, self._limits, self._middle = False, (low, high), (low + high) // 2
        up, down = sum(x for x in amounts if x > 0), sum(x for x in amounts if x < 0)
        for k, x in enumerate(amounts):
            up, down = up - max(x, 0), down - min(x, 0)
            self._add(k, x, up, down, most)

    def _add(self, k: int, x: int, up: int, down: int, most: int) -> None:
        added = self.bits.copy()
        if added.shape[1]:
            added[:, k // WORD] |= 1 << k % WORD
        sums, ways, bits = np.concatenate([self.sums, self.sums + x]), np.concatenate([self.ways, self.ways]), np.concatenate([self.bits, added])
        low, high = self._limits
        may = (sums + up >= low) & (sums + down <= high)
        sums, ways, bits = sums[may], ways[may], bits[may]
        by = np.argsort(sums, kind="stable")
        sums, ways, bits = sums[by], ways[by], bits[by]
        first = np.flatnonzero(np.append(True, sums[1:] != sums[:-1])) if len(sums) else by
        self.sums, self.bits = sums[first], bits[first]
        self.ways = np.minimum(2, np.add.reduceat(ways, first)).astype(np.int8) if len(first) else ways
        if len(self.sums) > most:
            self.full = True
            near = np.sort(np.argsort(np.abs(self.sums - self._middle), kind="stable")[:most])
            self.sums, self.ways, self.bits = self.sums[near], self.ways[near], self.bits[near]

    def members(self, place: int, n: int) -> list[int]:
        return [k for k in range(n) if int(self.bits[place, k // WORD]) >> k % WORD & 1]


def _halves(amounts: list[int], low: int, high: int, with_members: bool, most: int) -> tuple[Half, Half]:
    """Both halves, each pruned by what the other can still add."""
    a, b = amounts[0::2], amounts[1::2]
    reach = lambda x: (sum(v for v in x if v < 0), sum(v for v in x if v > 0))
    (a_low, a_high), (b_low, b_high) = reach(a), reach(b)
    return Half(a, low - b_high, high - b_low, with_members, most), Half(b, low - a_high, high - a_low, with_members, most)


def exact_subset(amounts: list[int], goal: int, few: int = FEW, most: int = SUMS) -> tuple[str, list[int]]:
    """unique and the members, or ambiguous, none, bounded: which subsets of the positive ``amounts`` sum to ``goal``."""
    if len(amounts) <= few:
        hit = np.flatnonzero(all_sums(amounts) == goal)
        if len(hit) != 1:
            return ("ambiguous" if len(hit) else "none"), []
        return "unique", [k for k in range(len(amounts)) if int(hit[0]) >> k & 1]
    a, b = _halves(amounts, goal, goal, True, most)
    at = np.searchsorted(b.sums, goal - a.sums)
    at[at == len(b.sums)] = 0
    pairs = np.flatnonzero(b.sums[at] == goal - a.sums) if len(b.sums) else at[:0]
    ways = int((a.ways[pairs].astype(np.int64) * b.ways[at[pairs]]).sum())
    if ways > 1:  # also where a half is full: two subsets are two
        return "ambiguous", []
    if a.full or b.full:
        return "bounded", []
    if not ways:
        return "none", []
    i, j = int(pairs[0]), int(at[pairs[0]])
    even, odd = len(amounts[0::2]), len(amounts[1::2])
    return "unique", sorted([2 * k for k in a.members(i, even)] + [2 * k + 1 for k in b.members(j, odd)])


def nearest_sum(amounts: list[int], goal: int, few: int = FEW, most: int = SUMS) -> tuple[int, str]:
    """The subset sum nearest to ``goal`` (the larger on ties) and exact, nearest or bounded."""
    if len(amounts) <= few:
        sums, full = all_sums(amounts), False
    else:
        width = abs(goal)  # no subset at all is as near as that
        a, b = _halves(amounts, goal - width, goal + width, False, most)
        full = a.full or b.full
        at = np.searchsorted(b.sums, goal - a.sums)
        last = len(b.sums) - 1
        sums = np.concatenate([a.sums + b.sums[np.clip(at + k, 0, last)] for k in (-1, 0)]) if last >= 0 and len(a.sums) else np.zeros(1, np.int64)
    far = np.abs(sums - goal)
    best = int(sums[far == far.min()].max())
    return best, "exact" if best == goal else "bounded" if full else "nearest"


def _cents(c: str) -> Column:
    return (F.col(c) * 100).cast("long")


def subset_sums(targets: DataFrame, rows: DataFrame, key: str, most: int = 100, sums: int = SUMS) -> DataFrame:
    """The unique subset of at least two rows of the target's sign whose exact sum is the target. ``rows``: key, id, amount;
    ``targets``: one row a key, target. Rows as large as the target cannot be members; where less is left over than chosen, what is left
    over is searched for.

    Returns key, status and the ids of a unique subset. Status: unique, ambiguous, none, invalid (target null or 0), bounded (over
    ``most`` rows, which is part of what is asked for, or a half of over ``sums`` sums).
    """
    t = targets.select(key, _cents("target").alias("_t"), F.signum(_cents("target")).cast("long").alias("_sign"))
    met = t.join(rows.select(key, "id", _cents("amount").alias("_a")), key, "left").withColumn("c", F.col("_a") * F.col("_sign"))
    may = F.coalesce((F.col("c") > 0) & (F.col("c") < F.abs("_t")), F.lit(False))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_may")))  # of a key no more rows are collected than tell that it has too many
    held = met.withColumn("_may", may).withColumn("_k", place).where(F.col("_k") <= most + 1)
    items = F.array_sort(F.collect_list(F.when(F.col("_may"), F.struct("id", "c"))))
    asked = held.groupBy(key).agg(F.first("_t").alias("_t"), items.alias("_items")).select(key, "_t", F.col("_items.id").alias("ids"), F.col("_items.c").alias("cents"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{key} {targets.schema[key].dataType.simpleString()}, status string, ids array<{kind}>"

    def judge(goal: int | None, cents: list[int]) -> tuple[str, list[int]]:
        n = len(cents)
        if not goal:
            return "invalid", []
        if n > most:
            return "bounded", []
        rest = sum(cents) - abs(goal)
        if n < 2 or rest < 0:
            return "none", []
        inverse = rest < abs(goal)
        status, places = exact_subset(cents, min(rest, abs(goal)), most=sums)
        if inverse and status == "unique":
            places = sorted(set(range(n)) - set(places))
        return status, places

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("_t", "cents")), strict=True)]
            ids = [[own[k] for k in places] if status == "unique" else None for own, (status, places) in zip(batch.column("ids").to_pylist(), out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([s for s, _ in out], pa.string()), pa.array(ids, batch.column("ids").type)], names=[key, "status", "ids"])

    return asked.mapInArrow(task, schema)


def closest_subset(targets: DataFrame, rows: DataFrame, key: str, most: int = 600, sums: int = SUMS) -> DataFrame:
    """The subset sum nearest to the target (the larger on ties) among the ``most`` largest rows: key, sum, status (exact, nearest, or
    bounded: a half of over ``sums`` sums, or more rows, and no exact answer)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_c")))
    ranked = rows.select(key, _cents("amount").alias("_c")).where("_c is not null").withColumn("_k", place).where(F.col("_k") <= most + 1)
    packed = ranked.groupBy(key).agg(F.collect_list(F.when(F.col("_k") <= most, F.col("_c"))).alias("cents"), (F.max("_k") > most).alias("_cut"))
    asked = targets.select(key, _cents("target").alias("_goal")).where("_goal is not null").join(packed, key)
    schema = f"{key} {targets.schema[key].dataType.simpleString()}, cents long, status string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [nearest_sum(c, g, most=sums) for c, g in zip(batch.column("cents").to_pylist(), batch.column("_goal").to_pylist(), strict=True)]
            status = ["bounded" if cut and s == "nearest" else s for (_, s), cut in zip(out, batch.column("_cut").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([v for v, _ in out], pa.int64()), pa.array(status, pa.string())], names=[key, "cents", "status"])

    return asked.mapInArrow(task, schema).select(key, (F.col("cents") / 100).cast(MONEY).alias("sum"), "status")
