"""Committed batches: restarts, retries, small batches on large states, cut collections, appends that count once."""

import datetime
import os
from decimal import Decimal

import pytest

from ledgerloom.sources import commits, sinks
from ledgerloom.streaming import feed

D = datetime.date(2024, 3, 1)
TX = "tx_id bigint, account_id bigint, amount decimal(18,2), day date, description string, version int"


def tx(spark, ids, text="a", amount="1.00", version=1):
    return spark.createDataFrame([(i, i % 3, Decimal(amount), D, text, version) for i in ids], TX)


def files(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_restart(spark, tmp_path):
    """Two pages, a restart with nothing new, a third page: every time the snapshot that was left."""
    path, landed = str(tmp_path / "s"), str(tmp_path / "landed")
    tx(spark, range(5)).write.mode("append").parquet(landed)
    stream = lambda: spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).parquet(landed)
    start = tx(spark, range(3, 9), "old")
    got = lambda df: {r["tx_id"]: (r["description"], r["outcome"]) for r in df.collect()}
    want = {i: ("a", "new") for i in range(3)} | {i: ("a", "described") for i in (3, 4)} | {i: ("old", "kept") for i in range(5, 9)}
    assert got(feed.upsert_stream(stream(), path, start)) == want
    assert got(feed.upsert_stream(stream(), path, start)) == want
    tx(spark, [8, 20], "b").write.mode("append").parquet(landed)
    want |= {8: ("b", "described"), 20: ("b", "new")}
    assert got(feed.upsert_stream(stream(), path, start)) == want
    assert got(feed.feed_state(spark, path).snapshot()) == want


def test_batch_again(spark, tmp_path):
    """A batch that was committed is not applied again; one that stopped before its commit is."""
    state = feed.feed_state(spark, str(tmp_path), tx(spark, range(4)))
    change = lambda old, new: feed.upsert(old, new)
    assert state.apply(tx(spark, [1], "x"), 7, change) and not state.apply(tx(spark, [1], "y"), 7, change)

    def stops(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        state.apply(tx(spark, [2], "z"), 8, stops)
    assert {r["tx_id"]: r["description"] for r in state.snapshot().collect()} == {0: "a", 1: "x", 2: "a", 3: "a"}
    assert state.apply(tx(spark, [2], "z"), 8, change)
    assert {r["tx_id"]: r["description"] for r in feed.feed_state(spark, str(tmp_path)).snapshot().collect()} == {0: "a", 1: "x", 2: "z", 3: "a"}


def test_small_batches(spark, tmp_path):
    """A batch of one key in a hundred writes about that part of the state; merged runs go."""
    n, root = 20_000, str(tmp_path)
    state = feed.feed_state(spark, root, spark.range(n).selectExpr("id as tx_id", "id % 9 as account_id", "cast(id as decimal(18,2)) as amount", "date'2024-03-01' as day", "sha2(string(id), 256) as description", "1 as version"))
    before, names = files(f"{root}/state"), set(os.listdir(f"{root}/state"))
    state.apply(spark.range(n).where("id % 100 = 5").selectExpr("id as tx_id", "id % 9 as account_id", "cast(id as decimal(18,2)) as amount", "date'2024-03-01' as day", "'b' as description", "2 as version"), 0, feed.upsert)
    (new,) = set(os.listdir(f"{root}/state")) - names
    assert spark.read.parquet(f"{root}/state/{new}").count() == n // 100 and files(f"{root}/state/{new}") < before / 3
    for k in range(1, 12):
        state.apply(tx(spark, [k, k + 1], f"v{k}", version=3), k, feed.upsert)
    assert len(state.log.state["runs"]) <= 2 * commits.FANOUT
    assert len([d for d in os.listdir(f"{root}/state") if d.startswith("run-")]) <= len(state.log.state["runs"]) + commits.FANOUT
    rows = {r["tx_id"]: (r["description"], r["outcome"]) for r in state.snapshot().where("tx_id < 14 or tx_id = 105").collect()}
    assert state.snapshot().count() == n
    assert rows[105] == ("b", "described") and rows[13][1] == "kept" and rows[5][1] == "review"  # money of ids above 1 differs from 1.00
    assert rows[1] == ("v1", "described")


def test_conflict(spark, tmp_path):
    """Changed money is kept for review beside the old values until the old ones come again."""
    state = feed.feed_state(spark, str(tmp_path), tx(spark, [1, 2]))
    state.apply(tx(spark, [1], "new", "5.00", 2), 1, feed.upsert)
    row = state.snapshot().where("tx_id = 1").first()
    assert (row["amount"], row["description"], row["outcome"], row["conflict"]["amount"], row["conflict"]["description"]) == (Decimal("1.00"), "a", "review", Decimal("5.00"), "new")
    state.apply(tx(spark, [2], "b"), 2, feed.upsert)
    assert state.snapshot().where("tx_id = 1").first()["conflict"]["amount"] == Decimal("5.00")
    state.apply(tx(spark, [1]), 3, feed.upsert)
    assert state.snapshot().where("tx_id = 1").first()["conflict"] is None


def pages(spark, rows):
    return spark.createDataFrame([(a, k, c, n, [(i, Decimal("2.00"), D, "p", 1) for i in ids]) for a, k, c, n, ids in rows], "account_id bigint, page int, cursor string, next_cursor string, data array<struct<tx_id: bigint, amount: decimal(18,2), day: date, description: string, version: int>>")


def test_watermarks(spark, tmp_path):
    """A cut run, a repeated cursor and a gap leave transactions and watermark; a whole one commits both, once."""
    path, (early, late) = str(tmp_path), ("2024-05-01 00:00:00", "2024-05-02 00:00:00")
    stamp = datetime.datetime.fromisoformat
    first = pages(spark, [(1, 0, None, "a", [1, 2]), (1, 1, "a", "", [3]), (2, 0, None, "b", [4]), (3, 0, None, "c", [5]), (3, 1, "c", "c", [6]), (4, 0, None, "d", [7]), (4, 2, "d", None, [8]), (5, 0, None, None, []), (6, 0, None, "x" * 4097, [9]), (7, 0, "late", None, [10])])
    got = {r["account_id"]: (r["state"], r["watermark"]) for r in feed.collect_feed(spark, path, first, early, "r1").collect()}
    assert got == {1: ("complete", stamp(early)), 2: ("cut", None), 3: ("repeated_cursor", None), 4: ("broken", None), 5: ("complete", stamp(early)), 6: ("repeated_cursor", None), 7: ("broken", None)}
    held = lambda: sorted(r["tx_id"] for r in feed.feed_state(spark, path).snapshot().collect())
    assert held() == [1, 2, 3]
    feed.collect_feed(spark, path, first, late, "r1")
    assert held() == [1, 2, 3]
    second = pages(spark, [(1, 0, None, "a", [20]), (2, 0, None, "b", [4]), (2, 1, "b", None, [21])])
    got = {r["account_id"]: (r["state"], r["watermark"]) for r in feed.collect_feed(spark, path, second, late, "r2").collect()}
    assert got[1] == ("cut", stamp(early)) and got[2] == ("complete", stamp(late)) and got[5] == ("none", stamp(early))
    assert held() == [1, 2, 3, 4, 21]


def test_audit(spark, tmp_path):
    e = spark.createDataFrame([("x", "{}", datetime.datetime(2024, 1, 1))], sinks.AUDIT)
    assert sinks.read_audit(spark, str(tmp_path)).count() == 0
    assert [sinks.append_audit(e, str(tmp_path), b) for b in ("1", "2", "1")] == [True, True, False]
    assert sinks.read_audit(spark, str(tmp_path)).count() == 2


def test_two_writers(spark, tmp_path):
    """A version that another writer published first is not overwritten."""
    a, b = (commits.CommitLog(spark, str(tmp_path), {"n": []}) for _ in range(2))
    assert a.commit(lambda s: {"n": [*s["n"], "a"]})
    refreshed = []

    def change(s):
        if not refreshed:
            refreshed.append(1)
            a.commit(lambda t: {"n": [*t["n"], "between"]})
        return {"n": [*s["n"], "b"]}

    assert b.commit(change) and b.state["n"] == ["a", "between", "b"] and b.versions() == [0, 1, 2]
    assert not b.commit(lambda s: None)
    assert sorted(f for f in os.listdir(tmp_path / "log") if not f.startswith(".")) == ["0.json", "1.json", "2.json"]
