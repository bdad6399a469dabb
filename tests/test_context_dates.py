"""Chains of dates that decide each other, in blocks of any size, against one loop over the column."""

import datetime
import random

import pytest

from ledgerloom.sources import context_dates as C


def plain(cells):
    now, out = None, []
    for text in cells:
        parts = text.replace(".", "/").replace("-", "/").split("/")
        make = lambda *x: next((d for d in [_date(*x)] if d), None)
        day = None
        if text[:4].isdigit() and len(parts) == 3:
            day = make(*map(int, parts))
        elif len(parts) == 3 and all(p.isdigit() for p in parts):
            a, b, y = map(int, parts)
            first, other = make(y, b, a), make(y, a, b)
            day = first or other
            if first and other and now and abs((other - now).days) < abs((first - now).days):
                day = other
        elif len(parts) == 2 and all(p.isdigit() for p in parts) and now:
            near = [d for k in (-1, 0, 1) if (d := make(now.year + k, int(parts[1]), int(parts[0])))]
            day = min(near, key=lambda d: (abs((d - now).days), d), default=None)
        out.append(day)
        now = day or now
    return out


def _date(y, m, d):
    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def column(rng, n, anchors):
    out, day = [], datetime.date(2023, rng.randrange(1, 13), rng.randrange(1, 28))
    for _ in range(n):
        day += datetime.timedelta(rng.randrange(0, 40))
        form = rng.choice(["%d/%m", "%d-%m", "%d/%m/%Y", "%m/%d/%Y", "x"] + ["%Y-%m-%d"] * anchors)
        out.append(rng.choice(["29/02", "30/02", "31/04", "x", ""]) if form == "x" else day.strftime(form))
    return out


@pytest.mark.parametrize("block", [3, 7, 1 << 16])
def test_chains(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    cells = {f"f{k}": column(rng, rng.randrange(1, 60), k % 3) for k in range(24)}
    cells["year"] = ["2023-12-30", "31/12", "02/01", "05/01", "07/02/2024", "01/03", "29/02"]
    cells["none"] = ["01/02", "x", "03/04", "05/06/2024", "07/06"]
    rows = [(f, 0, k, c) for f, own in cells.items() for k, c in enumerate(own)]
    got = {(r["file"], r["rank"]): r["date"] for r in C.resolve_dates(spark.createDataFrame(rows, "file string, column int, rank int, cell string").repartition(5)).collect()}
    assert got == {(f, k): d for f, own in cells.items() for k, d in enumerate(plain(own))}
    assert got["year", 3] == datetime.date(2024, 1, 5) and got["year", 6] == datetime.date(2024, 2, 29)


def test_compose():
    """A block's one function is the same as its cells one after the other, for every day before."""
    rng = random.Random(8)
    for _ in range(60):
        cells = []
        for _ in range(rng.randrange(1, 6)):
            a, b = (rng.randrange(19000, 20500) for _ in range(2))
            cells.append(rng.choice([(a, None, None, None), (a, b, None, None), (a, b, None, None), (None, None, rng.randrange(1, 32), rng.randrange(1, 13)), (None, None, 29, 2), (None, None, None, None)]))
        starts, values, none = C.compose(cells)
        for before in [None, *rng.sample(range(18000, 21500), 60)]:
            now = before
            for c in cells:
                day = C.resolve(c, now)
                now = now if day is None else day
            got = none if before is None else before if not starts else values[max(0, C.bisect_right(starts, before) - 1)]
            assert got == now, (cells, before)
