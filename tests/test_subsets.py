"""Subset sums against plain search: every subset of few rows, a growing set of sums for more."""

import random
from decimal import Decimal

import pytest

from ledgerloom.operators import subsets


def plain_ways(amounts, goal):
    """How many subsets make the goal (dictionary of sums), for positive amounts."""
    ways = {0: 1}
    for x in amounts:
        more = {}
        for s, n in ways.items():
            if s + x <= goal:
                more[s + x] = more.get(s + x, 0) + n
        for s, n in more.items():
            ways[s] = ways.get(s, 0) + n
    return ways.get(goal, 0)


@pytest.mark.parametrize("n", [2, 9, 13, 15, 24, 40])
@pytest.mark.parametrize("few", [0, subsets.FEW])
def test_exact(n, few):
    rng = random.Random(n)
    for k in range(25):
        top = (30, 2000, 10**7, 10**9)[k % 4] if n < 30 else (30, 900)[k % 2]
        own = [rng.randrange(1, top) for _ in range(n)]
        goal = sum(rng.sample(own, rng.randrange(1, n))) if k % 3 else rng.randrange(1, sum(own))
        if n == 40 or n <= 15 or top <= 2000:
            ways = plain_ways(own, goal)
            status, members = subsets.exact_subset(own, goal, few=few)
            assert status == ("none", "unique", "ambiguous")[min(ways, 2)]
            assert status != "unique" or sum(own[i] for i in members) == goal and len(set(members)) == len(members)


def test_forty_large():
    """Sums of 40 rows that are all different: the planted subset is found, and no answer is bounded."""
    own = [3**9 * 2**k + k for k in range(40)]
    members = [1, 4, 5, 17, 22, 38, 39]
    assert subsets.exact_subset(own, sum(own[k] for k in members)) == ("unique", members)
    assert subsets.exact_subset(own, 3**9 + 5)[0] == "none"
    rng = random.Random(2)
    own = [rng.randrange(10**6, 10**10) for _ in range(40)]
    assert subsets.nearest_sum(own, sum(own[::3])) == (sum(own[::3]), "exact")
    assert subsets.nearest_sum(own, sum(own) // 2)[1] != "bounded"
    assert subsets.exact_subset([1] * 70 + [10**6 + 5 * k for k in range(60)], 60 * 10**6 + 5 * 1770 + 70) == ("unique", list(range(130)))
    assert subsets.exact_subset(own, sum(own[:20]), most=50)[0] == "bounded"


@pytest.mark.parametrize("few", [0, subsets.FEW])
def test_nearest(few):
    rng = random.Random(7)
    for k in range(150):
        n = rng.choice([1, 2, 5, 12, 13, 16, 18])
        low = -200 if k % 3 == 0 else 1
        own = [rng.randrange(low, (40, 1000, 10**6)[k % 3]) for _ in range(n)]
        goal = rng.randrange(-100 if low < 0 else 0, max(2, sum(map(abs, own)) * 2))
        sums = {0}
        for x in own:
            sums |= {s + x for s in sums}
        best = min(sums, key=lambda s: (abs(s - goal), -s))
        assert subsets.nearest_sum(own, goal, few=few) == (best, "exact" if best == goal else "nearest")


ROWS, TARGETS = "k string, id int, amount decimal(18,2)", "k string, target decimal(18,2)"


def test_subset_sums(spark):
    """What is left over is searched for, both signs, ambiguity, nulls and every limit."""
    rows = [("wide", i, Decimal(2**i)) for i in range(30)] + [("rest", i, Decimal(3**i)) for i in range(12)] + [("two", i, Decimal(1)) for i in range(3)] + [("minus", i, Decimal(-(i + 1))) for i in range(3)] + [("minus", 9, Decimal(5))]
    rows += [("much", i, Decimal(i)) for i in range(1, 120)] + [("over", i, Decimal("1.5")) for i in range(101)] + [("odd", 1, Decimal(2)), ("odd", 2, Decimal(4)), ("zero", 1, Decimal(1)), ("null", 1, Decimal(1)), ("two", 5, None)]
    targets = [("wide", Decimal(2**29 + 2**3)), ("rest", Decimal(sum(3**i for i in range(12)) - 3)), ("two", Decimal(2)), ("minus", Decimal(-5)), ("much", Decimal(50)), ("odd", Decimal(5)), ("zero", Decimal(0)), ("alone", Decimal(4)), ("null", None), ("over", Decimal(3))]
    t, r = spark.createDataFrame(targets, TARGETS), spark.createDataFrame(rows, ROWS).repartition(3)
    got = {x["k"]: (x["status"], x["ids"]) for x in subsets.subset_sums(t, r, "k").collect()}
    assert len(got) == len(targets) and got["wide"] == ("unique", [3, 29]) and got["rest"] == ("unique", [0, *range(2, 12)]) and got["minus"] == ("unique", [1, 2])
    assert {k: got[k][0] for k in ("two", "odd", "zero", "alone", "much", "null", "over")} == {"two": "ambiguous", "odd": "none", "zero": "invalid", "alone": "none", "much": "ambiguous", "null": "invalid", "over": "bounded"}
    few = {x["k"]: x["status"] for x in subsets.subset_sums(t, r, "k", most=20, sums=50).collect()}
    assert few["wide"] == "bounded" and few["much"] == "bounded" and few["two"] == "ambiguous"
    assert subsets.subset_sums(t.limit(0), r, "k").count() == 0


def test_closest_subset(spark):
    rng = random.Random(4)
    rows = [(str(k), 0, Decimal(rng.randrange(1, 400))) for k in range(20) for _ in range(9 if k % 2 else 24)]
    targets = [(str(k), Decimal(rng.randrange(1, 2500))) for k in range(20)]
    t, r = spark.createDataFrame(targets, TARGETS), spark.createDataFrame(rows, ROWS)
    got = {x["k"]: (int(x["sum"]), x["status"]) for x in subsets.closest_subset(t, r, "k").collect()}
    for k, goal in targets:
        sums = {0}
        for j, _, a in rows:
            if j == k:
                sums |= {s + int(a) for s in sums}
        best = min(sums, key=lambda s: (abs(s - int(goal)), -s))
        assert got[k] == (best, "exact" if best == goal else "nearest")
    assert {x["status"] for x in subsets.closest_subset(t, r, "k", most=3).collect()} <= {"bounded", "exact"}


def test_few_scans(spark):
    """The plan of the query reads its rows twice (targets and rows), not once a case."""
    from ledgerloom.plans import load

    plan = load()[0]["j8_batch_suggest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2
