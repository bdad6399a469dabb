"""What only shows on larger tables, on small ones made for it."""

from pyspark.sql import functions as F

from ledgerloom.functions import similarity, text, values
from ledgerloom.operators import matching, reading, summaries
from ledgerloom.plans import imports
from ledgerloom.plans import views as W
from ledgerloom.plans.learning import v11_newest_sample
from ledgerloom.sources import statements


def test_consolidated_balance_of_a_long_file(spark, monkeypatch):
    """s6_consolidated: the balance of a file's 300,001st line is beyond 32 bits as an integer of cents."""
    row = spark.sql("select 'f' as file, 300000 as rank, date '2024-01-02' as operation_date, cast(5 as decimal(18,2)) as amount")
    monkeypatch.setattr(imports, "_ranked", lambda *a: row)
    line = imports.consolidated_files(spark, None, put=lambda rows, text: rows.select(text.alias("line"))).collect()[0]["line"]
    assert line.endswith("+000000003000000000")


def test_coverage_just_below_a_percent(spark):
    """a13_candidate_metrics: 1,000.00 of 100,000.01 is no whole percent, however close."""
    rows = "select {0} as {1}, 1L as account_id, date '2024-01-02' as {2}, cast({3} as decimal(18,2)) as amount"
    lines = spark.sql(rows.format("1L", "line_id", "operation_date", "100000.01") + " union all " + rows.format("2L", "line_id", "operation_date", "0"))
    docs = spark.sql(rows.format("7L", "ledger_id", "booking_date", "1000.00") + " union all " + rows.format("8L", "ledger_id", "booking_date", "0"))
    assert sorted(map(tuple, summaries.candidate_metrics(lines, docs).collect())) == [(1, 1, 0), (2, 1, None)]


def test_equal_samples(spark, monkeypatch):
    """v11_newest_sample: of lines with an equal place the first counts (keys 100,003 apart are equal to the hash)."""
    rows = spark.sql("select 1L as account_id, id * 10 + 1000030 * d as line_id, 2 as status from range(1, 4) a cross join (select explode(array(0, 1)) as d) b")
    monkeypatch.setattr(W, "lines", lambda *a: rows)
    assert [r["line_id"] for r in v11_newest_sample(spark, None).collect()] == [10]


def test_evidence_is_judged_before_it_is_cut(spark):
    """v6_evidence_sequence, s16_statement_evidence: what looks through a whole statement stands below the step that makes its rows."""
    line = lambda i: f"named_struct('line_id', {i}L, 'day', date '2024-01-0{i}', 'amount', {i})"
    s = spark.sql(f"select 1L as statement_id, 1L as account_id, 'DESC' as direction, array({line(2)}, {line(1)}) as lines union all select 2L, 1L, 'ASC', array({line(3)}, {line(3)})")
    out = statements.explode_evidence(s)
    assert sorted((r["statement_id"], r["sequence"], r["line_id"]) for r in out.collect()) == [(1, 1, 1), (1, 2, 2)]
    big = spark.sql("select id as statement_id, 1L as account_id, 'ASC' as direction, transform(sequence(1, 3), i -> named_struct('line_id', id * i, 'day', current_date(), 'amount', i)) as lines from range(9)")
    plan = statements.explode_evidence(big)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, x in enumerate(plan) if "Generate posexplode" in x) < min(i for i, x in enumerate(plan) if "array_distinct" in x)


def test_parties_are_counted_before_requests_meet_them(spark):
    """j13_party_resolution: a key that many requests and many parties share makes a row a request, not a pair."""
    parties = spark.sql("select 1 as vat, id % 500 as party_id from range(1000) union all select 2, 7L")
    counted = matching.parties_by(parties, ["vat"])
    assert sorted(map(tuple, counted.collect())) == [(1, 500, 0), (2, 1, 7)]
    asked = spark.sql("select id as request_id, cast(id % 3 as int) as vat from range(30)")
    tiers = [asked.join(counted, "vat"), spark.sql("select 0L as request_id, 5L as party_id union all select 0L, 5L")]
    got = {tuple(r) for r in matching.resolve_tiers(asked.select("request_id"), tiers).collect() if r["request_id"] < 4}
    assert got == {(0, "unique", 5, 2), (1, "ambiguous", None, 1), (2, "unique", 7, 1), (3, "none", None, None)}


def test_selection_counts_before_pairs(spark):
    """j23_selection_candidates: pairs are made last, so none is shuffled; results as counted pair by pair."""
    lines = spark.sql("select id as line_id, 1L as account_id, date '2024-01-02' as operation_date, cast(if(id % 2 = 0, 1, -1) * (id % 5) as decimal(18,2)) as amount from range(20)")
    ledger = spark.sql("select id as ledger_id, 1L as account_id, date '2024-01-02' as booking_date, cast(if(id % 3 = 0, 1, -1) * (id % 4) as decimal(18,2)) as amount, id % 7 = 0 as reconciled from range(25)")
    a, b = lines.collect(), [g for g in ledger.collect() if not g["reconciled"]]
    sign = lambda x: (x > 0) - (x < 0)
    fits = {l["line_id"]: [g for g in b if sign(g["amount"]) == sign(l["amount"]) and abs(g["amount"]) <= abs(l["amount"])] for l in a}  # noqa: E741
    want = sorted((l["line_id"], g["ledger_id"], g["amount"] == l["amount"], g["amount"] != l["amount"] and sum(o["amount"] != l["amount"] for o in fits[l["line_id"]]) >= 2) for l in a for g in fits[l["line_id"]])  # noqa: E741
    out = reading.selection_candidates(lines, ledger)
    assert sorted(map(tuple, out.collect())) == want and any(w[3] for w in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, x in enumerate(plan) if "Join" in x) < min(i for i, x in enumerate(plan) if "Window" in x)


def test_lines_without_a_link_are_spread(spark):
    """d7, r3, d1 and the others that join on links: lines without one do not meet in one task, and match nothing."""
    lines = spark.sql("select id as line_id, if(id % 10 = 0, id, null) as linked_ledger_id from range(1000)")
    other = spark.sql("select id * 20 as linked_ledger_id, 'x' as found from range(20) union all select null, 'never'")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = matching.by_link(lines, other)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 1000 and max(sizes) < 500
        assert {r["line_id"] for r in out.where("found is not null").collect()} == set(range(0, 400, 20)) and out.where("found = 'never'").count() == 0
        assert matching.by_link(lines, other.drop("found"), how="left_anti").count() == 980
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_names_are_told_unlike_by_counting(spark, monkeypatch):
    """j9_score_bills, j25_best_bill: likeness of a threshold is what the measure says, and most unlike names are never measured."""
    names = ["customer_000000007", "custmer customer_000000007", "other company", "custoner_000000070", "x", "", None]
    want = {(a, b): similarity.similarity(a, b) >= 72 for a in names for b in names}
    assert {(a, b): similarity.alike(a, b, 72) for a, b in want} == want and any(want.values())
    rows = spark.createDataFrame([(a, b) for a, b in want], "a string, b string")
    assert {(r["a"], r["b"]): r["c"] for r in rows.select("a", "b", similarity.text_alike("a", "b", 72).alias("c")).collect()} == want
    monkeypatch.setattr(similarity, "common_length", lambda a, b: 1 / 0)
    assert not similarity.alike("customer_000000007", "other company", 72)


def test_bills_that_cannot_score_are_not_compared(spark):
    """j9_score_bills, j25_best_bill: pairs whose amounts fit in no way go before names are compared."""
    from ledgerloom.plans.matches import bill_pairs

    plan = bill_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    compared = next(i for i, x in enumerate(plan) if "ArrowEvalPython" in x)
    assert any("Join Inner" in x and "doc_amount" in x or "Filter" in x and "doc_amount" in x for x in plan[compared + 1 :])


def test_checks_read_a_text_once(spark):
    """j9_score_bills, s11_mapped_rows, s9_tabulated: a value used several times is computed once, also in filters."""
    plan = lambda c: spark.createDataFrame([("x",)], "t string").where(c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.iban_valid("t")).count("upper(") == 1
    assert plan(values.parse_date("t").isNotNull()).count("trim(t") == 1
    assert plan(values.parse_number("t").isNotNull()).count("EUR|USD") == 1


def test_forms_of_dates(spark):
    """parse_date: every form, days that do not exist, and eight digits that can be read both ways."""
    known = {
        "2024-02-29": "2024-02-29", "2023-02-29": None, "01-02-2024": "2024-02-01", "01/02/2024": "2024-02-01", "01.02.2024": "2024-02-01", "01-02/2024": None, "2024/02/01": "2024-02-01", "2024.02.01": None, "20240201": "2024-02-01",
        "01022024": "2024-02-01", "10121112": None, "01-02-24": "2024-02-01", "31/12/99": "2099-12-31", "45000": "2023-03-15", "99999": None, "5 Fev 2024": "2024-02-05", "31 Fev 2024": None, " 2024-01-01 ": "2024-01-01", "1899-12-31": None, "": None, "abc": None}
    rows = spark.createDataFrame([(k,) for k in known], "t string").select("t", values.parse_date("t").cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == known


def test_first_lines_of_a_held_file(spark):
    """s12_detect_format: what follows the first lines is not cut into lines."""
    files = spark.sql("select 'f' as file, concat_ws('\\n', transform(sequence(1, 500), i -> cast(i as string))) as content")
    assert [tuple(r) for r in statements.file_lines(files, 3).collect()] == [("f", 0, "1"), ("f", 1, "2"), ("f", 2, "3")]
    assert statements.file_lines(files).count() == 500
