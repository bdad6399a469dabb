"""Filters, derived states, ordering and paging over lines and ledger rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import by_link


def historical(rows: DataFrame, openings: DataFrame, date: str) -> DataFrame:
    """``rows`` with ``historical``: dated before the account's opening in the opening's currency (EUR rows here)."""
    o = openings.select("account_id", F.col("start_date").alias("_start"))
    return rows.join(o, "account_id", "left").withColumn("historical", F.coalesce(F.col(date) < F.col("_start"), F.lit(False))).drop("_start")


def pending_lines(lines: DataFrame, ledger: DataFrame, accounts: DataFrame, openings: DataFrame, include_skipped: bool = False) -> DataFrame:
    """Lines still to reconcile: open reconcilable account, status below 2 (3 too with ``include_skipped``), ledger row not
    reconciled, not before the opening."""
    status = F.col("status") < 2
    if include_skipped:
        status = status | (F.col("status") == 3)
    live = accounts.where(~F.col("closed") & F.col("reconcilable")).select("account_id")
    done = ledger.where("reconciled").select(F.col("ledger_id").alias("linked_ledger_id"))
    rows = by_link(lines.where(status).join(live, "account_id", "left_semi"), done, how="left_anti")
    return historical(rows, openings, "operation_date").where(~F.col("historical")).drop("historical").select(*lines.columns)


def comparison(expression: str, column: Column) -> Column:
    """The list filter language: ``>=, <=, <>, !=, =, <, >`` and a decimal (comma allowed), a bare decimal for equality, a dash for
    missing. Anything else matches nothing."""
    text = expression.strip()
    if text in ("—", "-"):
        return column.isNull()
    m = re.fullmatch(r"(>=|<=|<>|!=|=|<|>)?\s*(-?[0-9]{1,16}([.,][0-9]{1,8})?)", text)
    if not m:
        return F.lit(False)
    value = F.lit(m[2].replace(",", ".")).cast("decimal(24,8)")
    sign = m[1] or "="
    return {">=": column >= value, "<=": column <= value, "<": column < value, ">": column > value, "=": column == value}.get(sign, column != value)


def search(rows: DataFrame, text: str, fields: list[str], amount: str) -> DataFrame:
    """Every word of ``text`` stands in the fields, or is the absolute amount."""
    whole = F.lower(F.concat_ws(" ", *fields))

    def one(word: str) -> Column:
        hit = F.contains(whole, F.lit(word.lower()))
        if re.fullmatch(r"[0-9]+([.,][0-9]{1,2})?", word):
            hit = hit | (F.abs(amount) == F.lit(word.replace(",", ".")).cast("decimal(18,2)"))
        return hit

    return rows.where(reduce(lambda a, b: a & b, map(one, text.split()), F.lit(True)))


def line_state(rows: DataFrame) -> DataFrame:
    """Lines joined to their ledger row (``l_*`` columns, null where it is missing) with ``state``."""
    linked = F.col("linked_ledger_id").isNotNull()
    wrong = linked & (F.col("l_amount").isNull() | (F.abs(F.col("amount") - F.col("l_amount")) > 0.01) | ((F.col("status") == 2) & ~F.coalesce("l_reconciled", F.lit(False))))
    state = (
        F.when(F.col("historical"), "reconciled").when(wrong, "review").when(linked & F.col("l_reconciled"), "reconciled").when(linked, "registered").when(F.col("status") == 3, "skipped").otherwise("pending")
    )
    return rows.withColumn("state", state)


def compatible_direction(kind: Column, amount: Column) -> Column:
    """Whether a document kind may explain an amount of this sign."""
    always = kind.isin("native_bank", "payment_linked", "payment_supplier_linked", "quick_entry")
    return always | (kind.isin("payment", "customer_invoice") & (amount > 0)) | (kind.isin("payment_supplier", "supplier_invoice", "tax", "payment_tax") & (amount < 0))


def stable_order(*keys: str, tiebreak: str) -> list[Column]:
    """Ascending order with missing values last and a unique tiebreak."""
    return [*[F.col(k).asc_nulls_last() for k in keys], F.col(tiebreak).asc()]


def page(rows: DataFrame, order: list[Column], limit: int, number: int, by: list[str]) -> DataFrame:
    """Page ``number`` (from 0) of each group of ``by``, with ``more`` where rows follow."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    sized = ranked.withColumn("more", F.lead("_n").over(w).isNotNull())
    return sized.where(F.col("_n").between(number * limit + 1, (number + 1) * limit)).drop("_n")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def positions(rows: DataFrame, by: list[str], coarse: list[Column], order: list[Column]) -> DataFrame:
    """``rows`` with ``position``, from 1, in each group of ``by`` in the order of ``coarse`` (ascending) and then ``order``.

    Rows are counted by ``coarse`` first, the counts are accumulated, and only the rows of one value are ordered, so no task orders a whole
    group. ``coarse`` must agree with the order wanted: a day, say, or a range of ids.
    """
    names = [f"_c{i}" for i in range(len(coarse))]
    own = rows.withColumns(dict(zip(names, coarse, strict=True)))
    sizes = own.groupBy(*by, *names).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"_k{c}") for c in (*by, *names)], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in (*by, *names)])
    inner = F.row_number().over(Window.partitionBy(*by, *names).orderBy(*order))
    return own.join(before, same).withColumn("position", F.col("_before") + inner).select(*rows.columns, "position")


def page_of(rows: DataFrame, by: list[str], coarse: list[Column], order: list[Column], limit: int, number: int) -> DataFrame:
    """``page`` for large groups: by ``positions``."""
    ranked = positions(rows, by, coarse, order)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    out = ranked.where(F.col("position").between(number * limit + 1, (number + 1) * limit)).join(sizes, by)
    return out.withColumn("more", F.col("position") < F.col("_n")).select(*rows.columns, "more")


def line_filter(lines: DataFrame, text: str | None = None, amount: str | None = None, within: str = "0", direction: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Lines by text of description or reference, absolute amount (``within`` so much of it), sign and dates."""
    tests = [F.contains(F.lower(F.concat_ws(" ", "description", "payment_reference")), F.lit(text.lower()))] if text else []
    exact = lambda x: F.lit(x).cast("decimal(18,2)")
    tests += [F.abs(F.abs("amount") - exact(amount)) <= exact(within)] if amount else []
    tests += [F.signum("amount") == direction] if direction else []
    tests += [F.col("operation_date") >= since] if since else []
    tests += [F.col("operation_date") <= until] if until else []
    return lines.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def statement_filter(lines: DataFrame, month: str, amount: str | None = None, status: int | None = None) -> DataFrame:
    """Lines of the month that begins on a day, by the filter language on the amount and by status."""
    first = F.lit(month).cast("date")
    rows = lines.where((F.col("operation_date") >= first) & (F.col("operation_date") < F.add_months(first, 1)))
    rows = rows.where(comparison(amount, F.col("amount"))) if amount else rows
    return rows.where(F.col("status") == status) if status is not None else rows


def worklist_status(states: DataFrame, accounts: DataFrame) -> DataFrame:
    """``states`` (line_state) with ``worklist``: review, reconciled, draft, or pending on open reconcilable accounts; null elsewhere."""
    rows = states.join(accounts.select("account_id", "closed", "reconcilable"), "account_id")
    gate = ~F.col("closed") & F.col("reconcilable")
    status = F.when(F.col("state").isin("review", "reconciled"), F.col("state")).when(F.col("state") == "registered", "draft").when(gate, "pending")
    return rows.withColumn("worklist", status).select(*states.columns, "worklist")


def history_needs_review(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reconciled lines with ``needs_review``: no ledger row, one that is not reconciled, or another amount."""
    g = ledger.select(F.col("ledger_id").alias("linked_ledger_id"), F.col("amount").alias("_a"), F.col("reconciled").alias("_r"))
    rows = by_link(lines.where("status = 2"), g)
    return rows.withColumn("needs_review", F.col("_a").isNull() | ~F.col("_r") | (F.col("amount") != F.col("_a"))).select(*lines.columns, "needs_review")


def matched_ledger(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Reconciled ledger rows that a line stands behind."""
    backed = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id"))
    return ledger.where("reconciled").join(backed, "ledger_id", "left_semi")


def unbacked_ledger(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Reconciled ledger rows that no line stands behind."""
    backed = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id"))
    return ledger.where("reconciled").join(backed, "ledger_id", "left_anti")


def nature_and_month(lines: DataFrame) -> DataFrame:
    """``lines`` with nature (payment, receipt) and origin_month."""
    return lines.withColumns({"nature": F.when(F.col("amount") < 0, "payment").otherwise("receipt"), "origin_month": F.date_format("operation_date", "yyyy-MM")})


def statement_accounts(accounts: DataFrame, lines: DataFrame) -> DataFrame:
    """Accounts that have statement lines."""
    return accounts.join(lines.select("account_id"), "account_id", "left_semi")


def payable_invoices(invoices: DataFrame) -> DataFrame:
    """Invoices (kind, open_amount) without credit notes (kind 2) and those with nothing open."""
    return invoices.where((F.col("kind") != 2) & (F.col("open_amount") > 1e-7))


def skip_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines with the open ones of ``ids`` skipped (status 3)."""
    asked = ids.select("line_id").distinct().withColumn("_s", F.lit(True))
    rows = lines.join(asked, "line_id", "left")
    return rows.withColumn("status", F.when(F.col("_s") & (F.col("status") < 2), 3).otherwise(F.col("status"))).select(*lines.columns)


def movable(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Ledger rows with ``movable``: not reconciled and claimed by no line, so their account may change."""
    held = lines.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id")).distinct().withColumn("_h", F.lit(True))
    return ledger.join(held, "ledger_id", "left").withColumn("movable", ~F.col("reconciled") & F.col("_h").isNull()).select(*ledger.columns, "movable")


def scope_violations(lines: DataFrame, accounts: DataFrame, openings: DataFrame) -> DataFrame:
    """Lines on closed or not reconcilable accounts, or before the opening."""
    bad = accounts.where("closed or not reconcilable").select("account_id", F.lit(True).alias("_bad"))
    return historical(lines, openings, "operation_date").join(bad, "account_id", "left").where("_bad or historical").select(*lines.columns)
