"""Operators on small tables with the values worked out by hand or by plain code."""

import datetime
import random
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import common_length, similarity
from ledgerloom.operators import learning, matching, reports
from ledgerloom.plans import layouts as plans
from ledgerloom.sources import layouts, statements

D = datetime.date


def plain_common(a, b):
    """Longest shared run, the first of the longest, then left and right of it."""
    best = max(((n, -i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=None)
    if not best:
        return 0
    n, i = best[0], -best[1]
    j = b.index(a[i : i + n])
    return n + plain_common(a[:i], b[:j]) + plain_common(a[i + n :], b[j + n :])


def test_similarity():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        assert common_length(a, b) == plain_common(a, b)
    assert similarity("world", "word") == pytest.approx(4 * 200 / 9) and similarity("ab", "abcdefg") == 0 and similarity("", "a") == 0 and similarity(None, "a") == 0
    assert similarity("x" * 60, "x" * 60) == 100


def test_camt(spark):
    """Default namespace, two statements, a time instead of a day, several details, no currency, an entry without details."""
    entry = lambda inner, side="DBIT": f"<Ntry>{inner}<CdtDbtInd>{side}</CdtDbtInd></Ntry>"
    one = entry('<NtryRef>r1</NtryRef><Amt Ccy="EUR">12.30</Amt><BookgDt><DtTm>2026-01-20T10:11:12</DtTm></BookgDt><ValDt><Dt>2026-01-21</Dt></ValDt><AcctSvcrRef>s1</AcctSvcrRef><NtryDtls><TxDtls><Refs><EndToEndId>e1</EndToEndId></Refs>'
                '<RltdPties><Dbtr><Nm>Me</Nm></Dbtr><Cdtr><Nm>Shop &amp; Co</Nm></Cdtr><CdtrAcct><Id><IBAN>pt50 0002 0123</IBAN></Id></CdtrAcct></RltdPties><RmtInf><Ustrd>inv 7</Ustrd><Ustrd>x</Ustrd></RmtInf></TxDtls><TxDtls><Refs><EndToEndId>e2</EndToEndId></Refs></TxDtls></NtryDtls><AddtlNtryInf>card</AddtlNtryInf>')  # fmt: skip
    two = entry("<Amt>5</Amt><BookgDt><Dt>2026-02-01</Dt></BookgDt><AcctSvcrRef>s2</AcctSvcrRef>", "CRDT")
    xml = f'<?xml version="1.0"?><Document xmlns="urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"><BkToCstmrStmt><Stmt>{one}</Stmt><Stmt>{two}{two}</Stmt></BkToCstmrStmt></Document>'
    rows = statements.parse_camt(spark.createDataFrame([("f", xml), ("empty", "<Document/>")], "file string, content string")).orderBy("rank").collect()
    assert [(r["rank"], r["operation_date"], r["amount"]) for r in rows] == [(0, D(2026, 1, 20), Decimal("-12.30")), (1, D(2026, 2, 1), Decimal("5.00")), (2, D(2026, 2, 1), Decimal("5.00"))]
    a, b = rows[0], rows[1]
    assert (a["value_date"], a["counterparty_name"], a["counterparty_iban"], a["description"], a["payment_reference"], a["reference"], a["currency"]) == (D(2026, 1, 21), "Shop & Co", "PT5000020123", "card inv 7", "e1", "r1", "EUR")
    assert (b["value_date"], b["counterparty_name"], b["payment_reference"], b["currency"], b["description"]) == (D(2026, 2, 1), "", "s2", "EUR", "")


def test_supplier_bins(spark):
    text = "Acme Ltda; TRF 12 acme x"
    row = learning.supplier_features(spark.createDataFrame([(Decimal("-99"), "Acme", "PT1", text, "")], "amount decimal(18,2), counterparty_name string, counterparty_iban string, description string, payment_reference string")).first()
    words = ["acme", "pt1", "acme", "ltda", "trf", "12", "acme"]
    want = [0.0] * 64
    for w in words:
        want[zlib.crc32(w.encode()) % 64] += 1 / len(words)
    assert row["tokens"] == 7 and row["bins"] == pytest.approx(want) and (row["s1"], row["s2"], row["s3"], row["s4"]) == (pytest.approx(2 / 6), 1, 1, 0.05)


def test_learned_headers(spark):
    heads, known = plans.learned(spark, "/root/testdata/sf0.001")
    none = heads.where("false").select("file", F.lit("").alias("field"), "column")
    got = {(r["field"], r["column"]) for r in layouts.map_by_learned_header(heads, none, known).collect()}
    assert got == {("operation_date", 0), ("value_date", 1), ("description", 2), ("amount", 3)}
    unsure = spark.createDataFrame([("f", 0, "importe_total_a"), ("f", 1, "importe_total_b"), ("f", 2, "qqq_zzz")], "file string, column int, key string")
    assert layouts.map_by_learned_header(unsure, none, known).count() == 0  # two columns as close, and one that is like nothing


def test_running_balance_days(spark):
    """Two rows a day, a day without date, and an invalid row in the middle."""
    rows = [(1, i, D(2020, 1, 1 + i // 2) if i < 8 else None, Decimal(i + 1), i != 5) for i in range(10)]
    df = spark.createDataFrame(rows, "account_id int, id int, day date, amount decimal(18,2), ok boolean")
    got = {r["id"]: r["balance"] for r in reports.running_balance(df, "day", "id").collect()}
    total = Decimal(3 + 0) + Decimal(16)  # the undated rows come first
    assert got[8] == 9 and got[9] == 19 and got[0] == total + 1 and got[7] == total + 36
    checked = {r["id"]: r["balance"] for r in reports.running_balance(df, "day", "id", valid=F.col("ok")).collect()}
    assert checked[4] == got[4] and checked[5] is None and checked[7] is None
