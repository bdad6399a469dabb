"""Audit history, enrichment and late suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def latest_audit(lines: DataFrame, audit: DataFrame) -> DataFrame:
    """The newest audit row of each line whose ledger id agrees with the line's link."""
    rows = lines.select("line_id", "linked_ledger_id").join(audit.select("line_id", "ledger_id", "audit_id", "at"), "line_id").where(F.col("ledger_id") == F.col("linked_ledger_id"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("at"), F.desc("audit_id")))).where("_k = 1").select("line_id", "audit_id")


def enrich_transfers(ledger: DataFrame, payments: DataFrame, key: str, most: int = 200) -> DataFrame:
    """Ledger receipts whose 1 to ``most`` allocations belong to one party and sum to the receipt exactly."""
    sums = payments.groupBy(key).agg(F.sum("paid").cast(MONEY).alias("total"), F.count("*").alias("n"), F.min("party_id").alias("a"), F.max("party_id").alias("b"))
    return ledger.join(sums.where((F.col("a") == F.col("b")) & (F.col("n") <= most)), key).where("total = amount").select(key, F.col("a").alias("party_id"), "n")


def batch_reason(lines: DataFrame, metrics: DataFrame, keyword, predicted: DataFrame | None = None, documents: int = 4, coverage: int = 90) -> DataFrame:
    """Why a line looks like a batch: a keyword, the model (``predicted``: id, is_batch, as ``learning.predict_batch`` gives), or so many
    same-day documents that cover so much percent of it."""
    rows = lines.join(metrics, "line_id", "left")
    told = F.lit(False)
    if predicted is not None:
        rows = rows.join(predicted.select(F.col("id").alias("line_id"), F.col("is_batch").alias("_model")), "line_id", "left")
        told = F.coalesce("_model", F.lit(False))
    enough = (F.coalesce("documents", F.lit(0)) >= documents) & (F.coalesce("coverage", F.lit(0)) >= coverage)
    return rows.select("line_id", F.when(keyword, "keyword").when(told, "model").when(enough, "coverage").alias("reason"))


def draft_invoices(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Draft invoices with a line's exact amount and party name in its description."""
    i = invoices.select("invoice_id", F.col("total").alias("amount"), "party")
    told = lines.withColumn("_word", F.explode(F.array_distinct(F.split("description", " "))))  # a name's last word is a word of the description
    named = told.join(i.withColumn("_word", F.element_at(F.split("party", " "), -1)), ["amount", "_word"])
    return named.where(F.contains("description", F.col("party"))).select("line_id", "invoice_id").distinct()
