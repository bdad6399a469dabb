"""Read views and filters over statements, lines, history and the ledger, and document search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .matching import by_link, near_days

MONEY = "decimal(18,2)"


def import_list(summaries: DataFrame, account: int | None = None, since: str | None = None, until: str | None = None, state: str | None = None, text: str | None = None) -> DataFrame:
    """Statement summaries (account_id, first_date, last_date, n, reconciled, issues, ref) by account, overlap of dates, state (complete,
    open, issues) and text of the reference."""
    states = {"complete": F.col("reconciled") == F.col("n"), "open": F.col("reconciled") < F.col("n"), "issues": F.col("issues") > 0}
    tests = [F.col("account_id") == account] if account is not None else []
    tests += [F.col("last_date") >= since] if since else []
    tests += [F.col("first_date") <= until] if until else []
    tests += [states[state]] if state else []
    tests += [F.contains(F.lower("ref"), F.lit(text.lower()))] if text else []
    return summaries.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def import_details(lines: DataFrame, summaries: DataFrame, state: str | None = None, text: str | None = None) -> DataFrame:
    """Lines of the statements in ``summaries`` by line state (reconciled, skipped, pending) and text."""
    states = {"reconciled": F.col("status") == 2, "skipped": F.col("status") == 3, "pending": F.col("status") < 2}
    rows = lines.join(summaries.select("statement_id"), "statement_id", "left_semi")
    rows = rows.where(states[state]) if state else rows
    return rows.where(F.contains(F.lower("description"), F.lit(text.lower()))) if text else rows


def statement_lines(lines: DataFrame, ledger: DataFrame, batches: DataFrame, openings: DataFrame, legacy: DataFrame) -> DataFrame:
    """Lines of every statement (account_id, statement_id) with what they are tied to: the ledger row's amount and flag, or the batch's
    (line_id, batch_id, total, reconciled, n, is_valid), and whether the opening covers them; and the ledger rows of an earlier generation
    (account_id, statement_id, ledger_id, operation_date, amount, description) of statements that are not staged, unless a line has them."""
    g = ledger.select(F.col("ledger_id").alias("linked_ledger_id"), F.col("amount").alias("_g"), F.col("reconciled").alias("_r"))
    b = batches.select("line_id", "batch_id", F.col("total").alias("_t"), F.col("reconciled").alias("_br"), "is_valid")
    o = openings.select("account_id", F.col("start_date").alias("_start"))
    before = F.coalesce(F.col("operation_date") < F.col("_start"), F.lit(False))
    grouped = F.col("batch_id").isNotNull()
    staged = by_link(lines, g).join(b, "line_id", "left").join(o, "account_id", "left").select(
        F.lit("staging").alias("storage"), F.col("line_id").alias("row_id"), "account_id", "statement_id", "operation_date", "amount", "description", F.col("linked_ledger_id").alias("native_id"), F.when(grouped, F.col("_t")).otherwise(F.col("_g")).alias("native_amount"),
        F.when(grouped, F.col("_br")).otherwise(F.col("_r")).alias("reconciled"), F.coalesce("batch_id", F.lit(0)).alias("batch_id"), F.coalesce("is_valid", F.lit(False)).alias("batch_valid"), before.alias("opening"))
    old = legacy.join(lines.select("account_id", "statement_id").distinct(), ["account_id", "statement_id"], "left_anti")
    old = old.join(lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id")), "ledger_id", "left_anti").join(ledger.select("ledger_id", "reconciled"), "ledger_id").join(o, "account_id", "left")
    rest = old.select(
        F.lit("legacy").alias("storage"), F.col("ledger_id").alias("row_id"), "account_id", "statement_id", "operation_date", "amount", "description", F.col("ledger_id").alias("native_id"), F.col("amount").alias("native_amount"), "reconciled", F.lit(0).cast("long").alias("batch_id"), F.lit(False).alias("batch_valid"), before.alias("opening"))
    return staged.unionByName(rest)


def bank_statement(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """All lines with value date, description, balance and sequence of their statement evidence where every fact agrees: line, account,
    day, amount, currency, identity and description (``expected_description``); duplicates keep what was imported."""
    e = evidence.select("line_id", "account_id", F.col("day").alias("operation_date"), "amount", "currency", "line_uid", F.col("expected_description").alias("description"), F.col("value_date").alias("_v"), F.col("description").alias("_d"), F.col("running_balance").alias("_b"), F.col("sequence").alias("_s"))
    on = ["line_id", "account_id", "operation_date", "amount", "currency", "line_uid", "description"]
    rows = lines.join(e, on, "left")
    use = ~F.col("is_duplicate")
    pick = lambda new, old: F.coalesce(F.when(use, F.col(new)), F.col(old)).alias(old)
    return rows.select("line_id", "account_id", "operation_date", "amount", pick("_v", "value_date"), pick("_d", "description"), pick("_b", "running_balance"), F.when(use, F.col("_s")).alias("sequence"))


def history_filters(rows: DataFrame, since: str | None = None, until: str | None = None, direction: int | None = None, link: str | None = None, strategy: str | None = None, amount: Column | None = None, text: str | None = None) -> DataFrame:
    """Reconciled rows (operation_date, amount, description, strategy, links: array of (type, label)) by dates, sign, type of a link, strategy,
    an amount predicate, and words that stand in the row or in any of its links, accents and case aside."""
    plain = lambda c: F.lower(fold(c))
    told = lambda w: F.contains(plain(F.col("description")), w) | F.exists("links", lambda x: F.contains(plain(x["label"]), w))
    tests = [F.col("operation_date") >= since] if since else []
    tests += [F.col("operation_date") <= until] if until else []
    tests += [F.signum("amount") == direction] if direction else []
    tests += [F.exists("links", lambda x: x["type"] == link)] if link else []
    tests += [F.col("strategy") == strategy] if strategy else []
    tests += [amount] if amount is not None else []
    tests += [told(plain(F.lit(word))) for word in (text or "").split()]
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def recent_reconciled(lines: DataFrame, legacy: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest reconciled rows of each account, staged and of the earlier generation, the sign forced by ``direction``."""
    signed = F.when(F.col("direction") < 0, -F.abs("amount")).otherwise(F.abs("amount")).cast(MONEY).alias("amount")
    rows = lines.where("status = 2").select(F.lit("staging").alias("storage"), F.col("line_id").alias("row_id"), "account_id", "operation_date", signed)
    rows = rows.unionByName(legacy.where("reconciled").select(F.lit("legacy").alias("storage"), F.col("ledger_id").alias("row_id"), "account_id", F.col("booking_date").alias("operation_date"), signed))
    w = Window.partitionBy("account_id").orderBy(F.desc("operation_date"), F.desc("storage"), F.desc("row_id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def rule_invoices(winners: DataFrame, invoices: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions (line_id, doc_id, score) with the open invoices of the winning rule's party and type added at score 1, and
    ``by_rule``. ``winners``: line_id, amount, party_id, invoice_type; a customer invoice takes an inflow, a supplier's an outflow."""
    side = F.when(F.col("invoice_type") == "customer_invoice", 1).otherwise(-1)
    asked = winners.where(F.signum("amount") == side).select("line_id", "party_id", F.col("invoice_type").alias("kind"))
    docs = asked.join(invoices.where("open_amount > 0").select("party_id", "kind", F.col("invoice_id").alias("doc_id")), ["party_id", "kind"]).select("line_id", "doc_id", F.lit(True).alias("by_rule"))
    both = suggestions.select("line_id", "doc_id", "score").join(docs, ["line_id", "doc_id"], "full")
    return both.select("line_id", "doc_id", F.coalesce("score", F.lit(1)).alias("score"), F.coalesce("by_rule", F.lit(False)).alias("by_rule"))


def rule_advice(lines: DataFrame, winners: DataFrame, ledger: DataFrame) -> DataFrame:
    """Category of the winning rule on every unreconciled ledger row of the line's account and exact amount: line_id, ledger_id, category;
    and the prefilled entry (party, label) where the rule asks for one. ``winners``: line_id, action, category, party_id, label."""
    w = lines.join(winners, "line_id")
    g = ledger.where(~F.col("reconciled")).select("ledger_id", "account_id", "amount")
    tagged = w.where("action = 'category'").join(g, ["account_id", "amount"]).select("line_id", "ledger_id", "category", F.lit(None).cast("long").alias("party_id"), F.lit(None).cast("string").alias("label"))
    return tagged.unionByName(w.where("action = 'quick_entry'").select("line_id", F.lit(None).cast("long").alias("ledger_id"), F.lit(None).cast("string").alias("category"), "party_id", "label"))


def search_ledger(asked: DataFrame, ledger: DataFrame, claimed: DataFrame, fields: list[str], most: int = 100) -> DataFrame:
    """Ledger rows for lines with a search text (line_id, account_id, amount, operation_date, search): the line's exact amount and account,
    unreconciled, unclaimed, every word of the text in ``fields`` or day; nearest day first, the first ``most``, with ``truncated``."""
    free = ledger.where(~F.col("reconciled")).join(claimed.select("ledger_id"), "ledger_id", "left_anti")
    day = F.col("booking_date")
    whole = F.lower(F.concat_ws(" ", *fields, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.col("amount").cast("string")))
    rows = asked.join(free.withColumn("_whole", whole), ["account_id", "amount"])
    rows = rows.where(F.forall(F.filter(F.split(F.lower("search"), "\\s+"), lambda x: x != ""), lambda x: F.contains(F.col("_whole"), x)))
    w = Window.partitionBy("line_id").orderBy(F.abs(F.datediff("booking_date", "operation_date")), "booking_date", "ledger_id")
    ranked = rows.withColumn("place", F.row_number().over(w))
    return ranked.withColumn("truncated", F.max("place").over(Window.partitionBy("line_id")) > most).where(F.col("place") <= most).select("line_id", "ledger_id", "place", "truncated")


def selection_candidates(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows that a user may select for a line: unreconciled, of its account, sign and day, with can_single (the exact amount) and
    can_group (smaller, and others of the day with it)."""
    g = ledger.where(~F.col("reconciled")).select("ledger_id", "account_id", F.col("booking_date").alias("operation_date"), F.col("amount").alias("_m"))
    day = ["account_id", "operation_date", "_sign"]
    a = lines.select(*day[:2], F.signum("amount").alias("_sign"), "line_id", F.abs("amount").alias("_size"))
    b = g.select(*day[:2], F.signum("_m").alias("_sign"), "ledger_id", F.abs("_m").alias("_own"))
    both = a.withColumn("_n", F.lit(0)).unionByName(b.select(*day, F.lit(None).cast("long").alias("line_id"), F.col("_own").alias("_size"), F.lit(1).alias("_n")))
    below = F.sum("_n").over(Window.partitionBy(*day).orderBy("_size").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("_n").over(Window.partitionBy(*day, "_size"))
    counted = both.withColumn("_smaller", below - same).where("_n = 0")  # what a line can group is counted before the pairs are made
    rows = counted.join(b, day).where(F.col("_own") <= F.col("_size"))
    smaller = F.col("_own") != F.col("_size")
    return rows.select("line_id", "ledger_id", (~smaller).alias("can_single"), (smaller & (F.col("_smaller") >= 2)).alias("can_group"))


def linked_fallback(lines: DataFrame, linked: DataFrame, suggestions: DataFrame, tolerance: int, cents: int = 1) -> DataFrame:
    """Suggestions (line_id, kind, doc_id, score) with linked payments (kind, doc_id, account_id, amount, day) of the line's account added that
    are within ``cents`` of it and ``tolerance`` days: score 70 for the amount and 30 for the day."""
    key = lambda c: (F.abs(c) * 100).cast("long")
    a = lines.select("line_id", "account_id", "operation_date", F.explode(F.array(*[key("amount") + i for i in range(-cents, cents + 1)])).alias("_c"))
    b = linked.select("kind", "doc_id", "account_id", "day", key("amount").alias("_c"))
    more = near_days(a, b, ["account_id", "_c"], "operation_date", "day", tolerance).select("line_id", "kind", "doc_id").distinct()
    fresh = more.join(suggestions.select("line_id", "kind", "doc_id"), ["line_id", "kind", "doc_id"], "left_anti")
    return suggestions.select("line_id", "kind", "doc_id", "score").unionByName(fresh.withColumn("score", F.lit(100)))


def collections(accounts: DataFrame, lines: DataFrame, audit: DataFrame) -> dict[str, tuple[DataFrame, list[Column]]]:
    """The read collections by name, each a projection and its stable order for paging. The audit's payloads stay inside."""
    statements = lines.groupBy("account_id", "statement_id").agg(F.min("operation_date").alias("first_date"), F.max("operation_date").alias("last_date"), F.count("*").alias("n"))
    return {
        "accounts": (accounts.select("account_id", "label", "currency", "closed"), [F.asc("account_id")]),
        "statements": (statements, [F.desc("last_date"), F.desc("statement_id")]),
        "lines": (lines.select("line_id", "statement_id", "operation_date", "amount", "description", "status"), [F.asc("operation_date"), F.asc("line_id")]),
        "audit": (audit.select("audit_id", "type", "at"), [F.desc("at"), F.desc("audit_id")]),
    }
