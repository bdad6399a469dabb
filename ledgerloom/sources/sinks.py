"""Writers: spreadsheet-safe CSV, exports of statements, reports and balances, and append-only audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe
from .commits import Appended

LINE_COLUMNS = ("operation_date", "value_date", "description", "payment_reference", "counterparty_name", "amount", "currency", "running_balance", "status")


def safe(df: DataFrame) -> DataFrame:
    """Every string column made safe for spreadsheets."""
    return df.select(*[csv_safe(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    safe(df).write.option("sep", ";").option("header", "true").mode("overwrite").csv(path)


def statement_lines(lines: DataFrame, statement_id: int | None = None) -> DataFrame:
    """What the export of a statement (or of all) holds, in order of its lines; columns that the lines lack are empty."""
    rows = lines if statement_id is None else lines.where(F.col("statement_id") == statement_id)
    cells = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in LINE_COLUMNS]
    return safe(rows.select("statement_id", "line_id", *cells))


def export_statement_lines(lines: DataFrame, statement_id: int, path: str) -> None:
    write_csv(statement_lines(lines, statement_id).orderBy("operation_date", "line_id"), path)


def export_monthly_report(sections: DataFrame, month: str, path: str) -> None:
    """The tidy report (account_id, section, key, value) as files by month and account."""
    safe(sections).withColumn("month", F.lit(month)).write.option("sep", ";").option("header", "true").partitionBy("month", "account_id").mode("append").csv(path)


def write_month_ends(series: DataFrame, pending: DataFrame, path: str) -> None:
    """Month-end balances and the complete pending list with its total by account."""
    write_csv(series, f"{path}/balances")
    write_csv(pending, f"{path}/pending")
    write_csv(pending.groupBy("account_id").agg(F.sum("amount").alias("total"), F.count("*").alias("n")), f"{path}/totals")


AUDIT = "type string, payload string, at timestamp"


def append_audit(events: DataFrame, path: str, batch: str) -> bool:
    """Append (type, payload, at) rows as one batch; a batch that is tried again counts once."""
    return Appended(events.sparkSession, path).append(events.select("type", "payload", F.col("at").cast("timestamp").alias("at")), batch)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows."""
    return Appended(spark, path).read(AUDIT)
