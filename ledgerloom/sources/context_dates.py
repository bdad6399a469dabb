"""Dates that only their column can decide: a day and month take the year, and two numbers of which either may be the month take the order,
that lies nearest the last resolved date before, which may itself have been resolved so.

Each cell is a function from the date before to the date after it. A column is cut into blocks of rows; the functions of a block's
cells are composed to one (piecewise constant: after its first cell it has few values), the blocks of a column are run through from
the first to the last, a value each, and then all blocks resolve their rows side by side. A column of any length is work for many
tasks, and no task holds more than a block.
"""

from __future__ import annotations

import datetime
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_date

#: Rows of a block; days (since 1970) of 1900 and 2200, outside which the first and last value hold.
BLOCK, FIRST, LAST = 1 << 16, -25567, 84006
_EPOCH = datetime.date(1970, 1, 1)


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return (datetime.date(y, m, d) - _EPOCH).days
    except ValueError:
        return None


def resolve(cell: tuple, before: int | None) -> int | None:
    """The day of a cell (plain, swapped, day, month; null where it has none) after the day ``before``."""
    plain, swapped, d, m = cell
    if d is not None:
        if before is None:
            return None
        y = (_EPOCH + datetime.timedelta(before)).year
        near = [x for k in (-1, 0, 1) if (x := _day(y + k, m, d)) is not None]
        return min(near, key=lambda x: (abs(x - before), x), default=None)
    if swapped is not None and before is not None and abs(swapped - before) < abs(plain - before):
        return swapped
    return plain


def compose(cells: list[tuple]) -> tuple[list[int], list[int | None], int | None]:
    """The cells as one function: (starts, values) of its pieces over days, and its value without a day before."""
    after = lambda cell, x: x if (y := resolve(cell, x)) is None else y
    none: int | None = None
    starts: list[int] | None = None
    values: list = []
    for cell in cells:
        none = after(cell, none)
        if starts is not None:
            moved = {v: after(cell, v) for v in set(values)}
            values = [moved[v] for v in values]
            continue
        plain, swapped, d, m = cell
        if d is None and plain is None:
            continue  # no date: what was before goes on
        if d is None and swapped is None:
            starts, values = [FIRST], [plain]
        elif d is None:
            low, high = sorted((plain, swapped))
            cut = (low + high) // 2 + 1 if (low + high) % 2 or plain == low else (low + high) // 2  # on a tie the plain one
            starts, values = [FIRST, cut], [low, high]
        else:
            days = [x for y in range(1899, 2202) if (x := _day(y, m, d)) is not None]
            edges = [FIRST]
            for y in range(1900, 2201):  # the value can change at the turn of a year and half way between two days
                edges += [_day(y, 1, 1), *(e for a, b in zip(days, days[1:], strict=False) if (e := (a + b) // 2 + 1) and _day(y, 1, 1) <= e < _day(y + 1, 1, 1))]
            edges = sorted({e for e in edges if FIRST <= e <= LAST})
            got = [resolve(cell, e) for e in edges]
            if all(g is None for g in got):
                continue  # there is no such day in any year
            # where no year near has the day, what was before goes on: such pieces are kept apart day by day
            starts, values = [], []
            for e, end, g in zip(edges, [*edges[1:], LAST + 1], got, strict=True):
                for x in [e] if g is not None else range(e, end):
                    starts.append(x)
                    values.append(g if g is not None else x)
    return (starts or [], values, none)


def _facts(column: DataFrame) -> DataFrame:
    """file, column, rank, block and the cell as days: plain, swapped (where it can be either), or day and month alone."""
    cell = F.trim("cell")
    both = lambda i: F.regexp_extract(cell, "^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})$", i)
    short = lambda i: F.regexp_extract(cell, "^([0-9]{1,2})[/.-]([0-9]{1,2})$", i)
    either = (both(3) != "") & both(1).try_cast("int").between(1, 12) & both(2).try_cast("int").between(1, 12) & (both(1).try_cast("int") != both(2).try_cast("int"))
    other = F.try_to_timestamp(F.concat_ws("-", both(3), F.lpad(both(1), 2, "0"), F.lpad(both(2), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    american = F.when((both(3) != "") & (both(2).try_cast("int") > 12), other)
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    partial = short(1) != ""
    return column.select(
        "file", "column", "rank", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), F.when(~partial, days(F.coalesce(american, parse_date("cell")))).alias("plain"), F.when(either, days(other)).alias("swapped"),
        F.when(partial, short(1).try_cast("int")).alias("d"), F.when(partial, short(2).try_cast("int")).alias("m"))


def _cells(rows: pd.DataFrame) -> list[tuple]:
    return [tuple(None if pd.isna(x) else int(x) for x in r) for r in rows[["plain", "swapped", "d", "m"]].itertuples(index=False)]


def resolve_dates(column: DataFrame) -> DataFrame:
    """Dates of (file, column, rank, cell). Without a date before, day first, and no year is null; a cell that is no date is null and changes
    nothing for those after it."""
    key = column.schema
    kinds = ", ".join(f"`{c}` {key[c].dataType.simpleString()}" for c in ("file", "column"))
    facts = _facts(column)

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        starts, values, none = compose(_cells(rows.sort_values("rank")))
        first = rows.iloc[0]
        return pd.DataFrame({"file": [first["file"]], "column": [first["column"]], "block": [first["block"]], "starts": [starts], "values": [values], "none": pd.array([none], "Int64")})

    def through(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        now, before = None, []
        for starts, values, none in zip(blocks["starts"], blocks["values"], blocks["none"], strict=True):
            before.append(now)
            if now is None:
                now = None if pd.isna(none) else int(none)
            elif len(starts):
                now = int(values[max(0, bisect_right(list(starts), now) - 1)])
        return pd.DataFrame({"file": blocks["file"], "column": blocks["column"], "block": blocks["block"], "before": pd.array(before, "Int64")})

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by block, in order."""
        key, now = None, None
        for rows in batches:
            out = []
            for own, first, cell in zip(rows[["file", "column", "block"]].itertuples(index=False, name=None), rows["before"], _cells(rows), strict=True):
                if own != key:
                    key, now = own, None if pd.isna(first) else int(first)
                day = resolve(cell, now)
                out.append(day)
                now = now if day is None else day
            yield pd.DataFrame({"file": rows["file"], "column": rows["column"], "rank": rows["rank"], "day": pd.array(out, "Int64")})

    several = facts.where("block > 0").select("file", "column").distinct()  # a column of one block starts without a date
    blocks = facts.join(several, ["file", "column"], "left_semi").groupBy("file", "column", "block").applyInPandas(summary, f"{kinds}, block long, starts array<int>, values array<int>, none long")
    before = blocks.groupBy("file", "column").applyInPandas(through, f"{kinds}, block long, before long")
    rows = facts.join(before, ["file", "column", "block"], "left").repartition("file", "column", "block").sortWithinPartitions("file", "column", "block", "rank")
    days = rows.mapInPandas(resolved, f"{kinds}, rank {key['rank'].dataType.simpleString()}, day long")
    return days.select("file", "column", "rank", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date"))
