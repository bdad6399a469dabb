"""Edge values of the column functions."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators.selection import comparison


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("(12,50)", "-12.5"), ("12.50-", "-12.5"), ("1.234.567", "1234567"), ("€ 5", "5"), ("12a", None), ("", None), ("01-02-1996", None)],
)
def test_number(spark, text, value):
    assert one(spark, V.parse_number("a"), a=text) == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("text", "day"),
    [("31/12/2020", (2020, 12, 31)), ("2020-02-30", None), ("20200131", (2020, 1, 31)), ("31012020", (2020, 1, 31)), ("45000", (2023, 3, 15)), ("5 mar 2021", (2021, 3, 5)), ("0000-00-00", None)],
)
def test_date(spark, text, day):
    assert one(spark, V.parse_date("a"), a=text) == (day and datetime.date(*day))


@pytest.mark.parametrize(("iban", "good"), [("GB82 WEST 1234 5698 7654 32", True), ("GB82WEST12345698765433", False), ("PT50000201231234567890154", True), ("X", False), (None, False)])
def test_iban(spark, iban, good):
    assert one(spark, T.iban_valid("a", lengths=True), a=iban) is good


def test_references(spark):
    assert one(spark, T.strong_reference_match("a", "b"), a="pay-00012345/E123456", b="PAY 00012345") is True
    assert one(spark, T.reference_core("a"), a="ab 1-E12345") == "AB1"
    assert one(spark, T.split_refs("a"), a="a, b;a | ") == ["A", "B"]
    assert one(spark, V.exact_decimal("a"), a="1e5") is None
    assert one(spark, T.csv_safe("a"), a=" =1+1") == "' =1+1"
    assert one(spark, T.csv_safe("a"), a="-1.50") == "-1.50"


@pytest.mark.parametrize(("expression", "hit"), [(">=5", True), ("< 5", False), ("5,00", True), ("<>5", False), ("x", False), ("—", False)])
def test_comparison(spark, expression, hit):
    assert spark.sql("select cast(5 as decimal(18,2)) a").select(comparison(expression, F.col("a")).alias("x")).first()["x"] is hit
