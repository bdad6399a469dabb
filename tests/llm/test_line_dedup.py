"""Line dedup against plain loops, and the store of sorted runs: batches, retries, compaction, opening again."""

import random
from collections import Counter

import pytest

from ledgerloom.llm import line_dedup
from ledgerloom.llm.store import named

from .brute import LOW, sha
from .conftest import prose

BLANKS = " \t\n\x0b\f\r"


def plain(rows, least=40, most=5):
    """A row each: (doc_id, lines, dropped, digest)."""
    key = lambda x: x.strip(BLANKS).translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                held.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(held.get(key(x), ())) < most or max(held[key(x)]) == i]
        out[i, len(lines), len(lines) - len(keep), sha("\n".join(keep))] += 1
    return out


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(6)
    common = [prose(rng, 12).replace("\n", " ") for _ in range(8)] + ["é" * 39, "é" * 40, "x" * 50_000]
    out = list(texts.items())
    for k in range(60):
        lines = [rng.choice([str.upper, str.lower, str])(rng.choice(common)) if rng.random() < 0.5 else prose(rng, 9) for _ in range(rng.randrange(1, 12))]
        out.append((1000 + k, "\n".join(rng.choice(["", " ", "\t\r", "\x0b"]) + x + rng.choice(["", "\r", "  "]) for x in lines)))
    out += [(2000 + k, common[0]) for k in range(4)] + [(3000, common[1] + "\n" + common[1]), (3000, common[1]), (3000, "other\n" + common[2]), (None, common[1]), (None, None), (3001, None), (3002, ""), (3003, "\n\n"), (3004, common[3].upper() + "\n" + common[3]), (-5, common[3])]
    return out + [(4000 + k, "edge line of exactly forty code points !!") for k in range(5)] + [(5000 + k, f"{'four documents hold this line, no more of them'}") for k in range(4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in rows], "doc_id long, text string, hi long, lo long, docs long, holder string, batch int").repartition(3)


def digests(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in df.collect())


@pytest.mark.parametrize(("batches", "fanout"), [(6, 3), (1, 3), (7, 2)])
def test_lines(docs, rows, batches, fanout):
    assert digests(line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)) == plain(rows)


def test_empty(docs):
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert digests(line_dedup.dedup_lines(docs.where("doc_id is null"))) == Counter({(None, 1, 0, sha("")): 1} | {k: n for k, n in plain([(None, r["text"]) for r in docs.where("doc_id is null and text is not null").collect()]).items()})


def test_runs(spark, docs, tmp_path):
    """Holders and counts over batches, one of them tried again, runs merged, and the store opened anew."""
    lines = line_dedup.line_hashes(named(docs), 1).where("doc_id is not null").select("hi", "lo", "doc_id")
    store = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    fresh = Counter()
    for k in range(5):
        new = store.add(lines.where(f"pmod(doc_id, 5) = {k}"), str(k)).collect()
        fresh.update((r["hi"], r["lo"]) for r in new)
    assert store.add(lines, "3").count() == 0 and len(store.runs) <= 4
    assert max(fresh.values()) == 1  # a line is new once
    want = {(r["hi"], r["lo"]): r["n"] for r in lines.distinct().groupBy("hi", "lo").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    for s in (store, line_dedup.LineRuns(spark, str(tmp_path))):
        assert {(r["hi"], r["lo"]): r["docs"] for r in s.totals().collect()} == want and set(fresh) == set(want)
    again = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    again.add(lines.where("doc_id < 50").withColumn("doc_id", lines["doc_id"] + 10**6), "later")
    assert again.batches == ["0", "1", "2", "3", "4", "later"]


def test_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
