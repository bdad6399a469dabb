"""Running balances, month-end series, reconciliation report and opening boundary for all accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import by_link

MONEY = "decimal(18,2)"


def earlier_sums(rows: DataFrame, day: str, order: list[str], sums: dict[str, Column], last_first: bool = False) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum over all rows of the account before the row in the order of ``day`` and
    ``order`` (after it with ``last_first``).

    Days are summed first and accumulated an account (a row a day), and only the rows of one day are ordered, so no task orders a
    whole account.
    """
    way = (lambda c: F.col(c).desc()) if last_first else (lambda c: F.col(c).asc())
    before = lambda w, *o: w.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_{n}": c for n, c in sums.items()})
    days = own.groupBy("account_id", day).agg(*(F.sum(f"_{n}").alias(f"_d{n}") for n in sums))
    w = before(Window.partitionBy("account_id"), way(day))
    days = days.select("account_id", F.col(day).alias("_day"), *(F.coalesce(F.sum(f"_d{n}").over(w), F.lit(0)).alias(f"_b{n}") for n in sums))
    inner = before(Window.partitionBy("account_id", day), *(way(c) for c in order))
    out = own.join(days.withColumnRenamed("account_id", "_account"), (F.col("account_id") == F.col("_account")) & F.col(day).eqNullSafe(F.col("_day")))
    return out.select(*rows.columns, *((F.col(f"_b{n}") + F.coalesce(F.sum(f"_{n}").over(inner), F.lit(0))).alias(n) for n in sums))


def running_balance(rows: DataFrame, date: str, key: str, amount: str = "amount", valid: Column | None = None) -> DataFrame:
    """Cumulative sum by (date, key) in each account; null from the first invalid row onward."""
    bad = (~valid).cast("int") if valid is not None else F.lit(0)
    out = earlier_sums(rows, date, [key], {"_total": F.col(amount), "_wrong": bad})
    total = (F.col("_total") + F.col(amount)).cast(MONEY)
    return out.withColumn("balance", F.when(F.col("_wrong") + bad == 0, total)).drop("_total", "_wrong")


def balance_from_anchor(rows: DataFrame, anchors: DataFrame, order: list[str], amount: str = "amount") -> DataFrame:
    """Balance after each row from the account's closing balance, less everything later; ``order`` begins with the day."""
    out = earlier_sums(rows, order[0], order[1:], {"_later": F.col(amount)}, last_first=True)
    return out.join(anchors.select("account_id", "anchor"), "account_id").withColumn("balance", (F.col("anchor") - F.col("_later")).cast(MONEY)).drop("_later")


def balance_chain(rows: DataFrame, order: list[str]) -> DataFrame:
    """account_id, closing, is_coherent: every supplied ``running_balance`` implies the same opening; ``order`` begins with the day."""
    base = earlier_sums(rows, order[0], order[1:], {"_before": F.col("amount")}).withColumn("base", (F.col("running_balance") - F.col("_before") - F.col("amount")).cast(MONEY))
    agg = base.groupBy("account_id").agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.sum("amount").cast(MONEY).alias("moved"))
    same = F.col("lo") == F.col("hi")
    return agg.select("account_id", F.when(same, (F.col("lo") + F.col("moved")).cast(MONEY)).alias("closing"), F.coalesce(same, F.lit(False)).alias("is_coherent"))


def months_between(first: str, last: str) -> Column:
    """First days of the months from ``first`` to ``last``."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def month_end_series(rows: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """Balance of every account at every month end: movements are summed a month first, then accumulated over the spine."""
    monthly = rows.groupBy("account_id", F.trunc(date, "month").alias("month")).agg(F.sum("amount").alias("moved"))
    spine = rows.select("account_id").distinct().withColumn("month", F.explode(months_between(first, last)))
    before = monthly.where(F.col("month") < first).groupBy("account_id").agg(F.sum("moved").alias("opening"))
    w = Window.partitionBy("account_id").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spine.join(monthly, ["account_id", "month"], "left").join(before, "account_id", "left")
    total = F.coalesce("opening", F.lit(0)) + F.coalesce(F.sum("moved").over(w), F.lit(0))
    return out.select("account_id", F.last_day("month").alias("month_end"), total.cast(MONEY).alias("balance"))


def side_summary(rows: DataFrame, date: str, month: str, accepted: str) -> DataFrame:
    """Opening, movement, counts and ages of one side of the report for a month (first day given)."""
    start, end = F.lit(month).cast("date"), F.add_months(F.lit(month).cast("date"), 1)
    d = F.col(date)
    inside, before = (d >= start) & (d < end), d < start
    open_ = ~F.col(accepted) & (d < end)
    age = F.datediff(F.date_sub(end, 1), d)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast(MONEY)
    count = lambda c: F.count_if(c)
    return rows.groupBy("account_id").agg(
        total(before).alias("opening"), total(inside).alias("movement"), count(inside).alias("n"), count(inside & F.col(accepted)).alias("matched"),
        count(open_).alias("pending"), total(open_).alias("pending_amount"), count(open_ & (age > 30)).alias("over_30"), count(open_ & (age > 90)).alias("over_90"), count(open_ & before).alias("carried"))


def reconciliation_map(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Both sides' summaries to adjusted balances and their difference."""
    b = bank.select("account_id", (F.col("opening") + F.col("movement")).alias("bank_close"), F.col("pending_amount").alias("bank_pending"))
    l = ledger.select("account_id", (F.col("opening") + F.col("movement")).alias("ledger_close"), F.col("pending_amount").alias("ledger_pending"))  # noqa: E741
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY).alias(c)
    both = b.join(l, "account_id", "full").select("account_id", *[zero(c) for c in ("bank_close", "bank_pending", "ledger_close", "ledger_pending")])
    m = lambda c: c.cast(MONEY)
    out = both.withColumn("bank_adjusted", m(F.col("bank_close") + F.col("ledger_pending"))).withColumn("ledger_adjusted", m(F.col("ledger_close") + F.col("bank_pending")))
    return out.withColumn("difference", m(F.col("bank_adjusted") - F.col("ledger_adjusted")))


def checks(report: DataFrame) -> DataFrame:
    """Keyed checks of a report row: difference, pending on either side."""
    row = lambda k, c: F.struct(F.lit(k).alias("check"), F.when(c, "ok").otherwise("warning").alias("result"))
    every = F.array(row("difference", F.col("difference") == 0), row("bank_pending", F.col("bank_pending") == 0), row("ledger_pending", F.col("ledger_pending") == 0))
    return report.select("account_id", F.explode(every).alias("c")).select("account_id", "c.*")


def match_state(lines: DataFrame, ledger: DataFrame, claims: DataFrame) -> DataFrame:
    """Per line: matched, timing, conflict, invalid or open. ``ledger`` has ledger_id, l_amount, l_date, reconciled; ``claims`` ledger_id, n."""
    g = ledger.withColumnRenamed("ledger_id", "linked_ledger_id")
    c = claims.select(F.col("ledger_id").alias("linked_ledger_id"), F.col("n").alias("claims"))
    rows = by_link(lines, g, c)
    linked = F.col("linked_ledger_id").isNotNull()
    state = (
        F.when(linked & (F.col("claims") > 1), "conflict").when(linked & F.col("l_amount").isNull(), "invalid").when(linked & (F.col("amount") != F.col("l_amount")), "invalid")
        .when(linked & (F.trunc("l_date", "month") > F.trunc("operation_date", "month")), "timing").when(linked & (F.col("status") == 2) & F.col("reconciled"), "matched").otherwise("open")
    )
    return rows.withColumn("match", state)


def opening_preview(ledger: DataFrame, openings: DataFrame) -> DataFrame:
    """Ledger total and rows before each account's opening, and the adjustment to the official balance."""
    before = ledger.join(openings.select("account_id", "start_date", "official"), "account_id").where("booking_date < start_date")
    sums = before.groupBy("account_id").agg(F.sum("amount").alias("s"), F.count("*").alias("rows_before"))
    out = openings.join(sums, "account_id", "left").withColumn("ledger_balance", F.coalesce("s", F.lit(0)).cast(MONEY))
    return out.select("account_id", "ledger_balance", (F.col("official") - F.col("ledger_balance")).cast(MONEY).alias("adjustment"), F.coalesce("rows_before", F.lit(0)).alias("rows_before"))


def opening_apply(ledger: DataFrame, openings: DataFrame) -> DataFrame:
    """Ledger with earlier rows reconciled and one adjustment row (negative id, the day before the start) where it is not zero."""
    o = openings.select("account_id", "start_date")
    marked = ledger.join(o, "account_id", "left").withColumn("reconciled", F.col("reconciled") | F.coalesce(F.col("booking_date") < F.col("start_date"), F.lit(False)))
    extra = opening_preview(ledger, openings).where("adjustment <> 0").join(o, "account_id")
    rows = extra.select((-F.col("account_id")).alias("ledger_id"), "account_id", F.date_sub("start_date", 1).alias("booking_date"), F.col("adjustment").alias("amount"), F.lit(True).alias("reconciled"))
    return marked.select("ledger_id", "account_id", "booking_date", "amount", "reconciled").unionByName(rows)


def opening_valid(ledger: DataFrame, openings: DataFrame) -> DataFrame:
    """account_id, balance before the start, valid: it equals the official balance and every row before is reconciled."""
    rows = ledger.join(openings.select("account_id", "start_date"), "account_id").where("booking_date < start_date")
    sums = rows.groupBy("account_id").agg(F.sum("amount").alias("s"), F.bool_and("reconciled").alias("done"))
    out = openings.join(sums, "account_id", "left").withColumn("balance", F.coalesce("s", F.lit(0)).cast(MONEY))
    return out.select("account_id", "balance", (F.coalesce("done", F.lit(True)) & (F.col("balance") == F.col("official"))).alias("valid"))


def validity(rows: DataFrame, currency: str) -> DataFrame:
    """``rows`` (operation_date, amount, currency) with invalid_date, invalid_amount, currency_mismatch and valid; an amount has eight
    places at most."""
    wrong = F.coalesce(F.col("currency"), F.lit("")) != F.lit(currency)
    exact = F.coalesce(F.col("amount").cast("decimal(24,8)") == F.col("amount"), F.lit(False))
    out = rows.withColumns({"invalid_date": F.col("operation_date").isNull(), "invalid_amount": ~exact, "currency_mismatch": wrong})
    return out.withColumn("valid", ~(F.col("invalid_date") | F.col("invalid_amount") | F.col("currency_mismatch")))


def cutoff(rows: DataFrame, ledger: DataFrame, next_month: str) -> DataFrame:
    """``rows`` before ``next_month`` (undated ones stay) with ``timing``: linked to a valid ledger row (ledger_id, l_date, l_valid) of a
    later month, which is no error."""
    end = F.lit(next_month).cast("date")
    late = ledger.where((F.col("l_date") >= end) & F.col("l_valid")).select(F.col("ledger_id").alias("native_id"), F.lit(True).alias("_late"))
    kept = rows.where(F.col("operation_date").isNull() | (F.col("operation_date") < end))
    return kept.join(late, "native_id", "left").withColumn("timing", F.coalesce("_late", F.lit(False))).drop("_late")


def link_state(rows: DataFrame, ledger: DataFrame, currency: str, next_month: str) -> DataFrame:
    """State of each single link at a month's end.

    ``rows``: row_id, operation_date, amount, valid, is_duplicate, status, native_id (the link), expected_native_id, statement_ref,
    start_date (opening, may be null); ``ledger``: ledger_id, l_date, l_amount, l_currency, l_valid, l_reconciled, l_ref.

    Returns row_id, conflict (claimed twice), link_invalid (missing, foreign or unequal ledger row, or a link across the opening),
    flags_invalid (status 2 without an intact link, reference or reconciled row; reconciled without status 2), matched, review.
    """
    end = F.lit(next_month).cast("date")
    claims = rows.where(~F.col("is_duplicate") & F.col("expected_native_id").isNotNull()).groupBy(F.col("expected_native_id").alias("_id")).agg(F.count("*").alias("_claims"))
    g = ledger.withColumnRenamed("ledger_id", "_id")
    r = rows.where(F.col("operation_date").isNull() | (F.col("operation_date") < end)).withColumn("_id", F.coalesce("expected_native_id", "native_id"))
    r = r.join(claims, "_id", "left").join(g, "_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    asked, found = F.col("_id").isNotNull(), no(F.col("l_date") < end)
    linked = no(F.col("native_id") == F.col("_id"))
    equal, referred = no(F.col("amount") == F.col("l_amount")), no((F.col("statement_ref") != "") & (F.col("statement_ref") == F.col("l_ref")))
    conflict = no(F.col("_claims") > 1)
    done = F.col("status") == 2
    matched = ~F.col("is_duplicate") & ~conflict & F.col("valid") & found & no(F.col("l_valid")) & done & no(F.col("l_reconciled")) & linked & equal & referred
    crosses = no((F.col("operation_date") < F.col("start_date")) != (F.col("l_date") < F.col("start_date")))
    broken = asked & (F.col("native_id").isNull() | ~no(F.col("l_currency") == currency) | ~equal | crosses | F.col("l_date").isNull())
    flags = (done & (~asked | broken | ~no(F.col("l_reconciled")) | ~referred)) | (~done & asked & no(F.col("l_reconciled")))
    wrong = ~F.col("is_duplicate") & (broken | flags | (done & found & ~matched))
    return r.select("row_id", conflict.alias("conflict"), broken.alias("link_invalid"), flags.alias("flags_invalid"), (matched & ~wrong).alias("matched"), (~F.col("valid") | conflict | wrong).alias("review"))


def group_state(rows: DataFrame, members: DataFrame, currency: str, next_month: str) -> DataFrame:
    """State of each grouped row at a month's end: row_id, matched, review, timing.

    ``rows``: row_id, amount, valid, status, statement_ref; ``members``: row_id, ledger_id, amount, expected_amount, day, currency,
    reconciled, ref, claims. All members must hold: equal to what was expected, of the row's sign and currency, reconciled
    under its reference, claimed once; at least two, distinct, and exactly the row's amount together. A good group with a member
    after the month is timing.
    """
    end = F.lit(next_month).cast("date")
    m = members.join(rows.select("row_id", F.col("amount").alias("_a"), F.col("statement_ref").alias("_ref")), "row_id")
    good = (F.col("amount") == F.col("expected_amount")) & (F.col("amount") != 0) & (F.signum("amount") == F.signum("_a")) & (F.col("currency") == currency) & F.col("reconciled") & (F.col("ref") == F.col("_ref")) & F.col("day").isNotNull()
    per = m.groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct("ledger_id").alias("ids"), F.sum("amount").alias("total"), F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.bool_or(F.col("claims") > 1).alias("conflict"), F.bool_or(F.coalesce(F.col("day") >= end, F.lit(False))).alias("future"))
    r = rows.join(per, "row_id", "left")
    valid = F.coalesce(F.col("valid") & (F.col("status") == 2) & (F.col("statement_ref") != "") & (F.col("amount") != 0) & (F.col("n") >= 2) & (F.col("ids") == F.col("n")) & F.col("good") & (F.col("total") == F.col("amount")), F.lit(False))
    calm = valid & ~F.coalesce("conflict", F.lit(False))
    future = F.coalesce("future", F.lit(False))
    return r.select("row_id", (calm & ~future).alias("matched"), (~calm).alias("review"), (calm & future).alias("timing"))


def detail_rows(rows: DataFrame, month: str) -> DataFrame:
    """Rows shown for a month, with ``detail`` (duplicate, opening, matched, review, pending), age at its end, and whether carried.

    ``rows``: operation_date, is_duplicate, historical, matched, review. A row is shown where it has no date, lies in the month, or is
    not accepted (matched or opening) and so carried.
    """
    start = F.lit(month).cast("date")
    end = F.date_sub(F.add_months(start, 1), 1)
    d = F.col("operation_date")
    old = F.col("historical") & ~F.col("is_duplicate") & ~F.col("review")
    detail = F.when(F.col("is_duplicate"), "duplicate").when(old, "opening").when(F.col("matched"), "matched").when(F.col("review"), "review").otherwise("pending")
    accepted = F.col("matched") | old
    shown = rows.where((d.isNull() | (d <= end)) & (d.isNull() | (d >= start) | ~accepted))
    return shown.withColumns({"detail": detail, "age": F.coalesce(F.greatest(F.lit(0), F.datediff(end, d)), F.lit(0)).cast("int"), "carried": F.coalesce(d < start, F.lit(False))})


def bank_balances(movements: DataFrame, chain: DataFrame, confirmed: DataFrame, openings: DataFrame, month: str) -> DataFrame:
    """account_id, bank_open, bank_close of a month: the close is the confirmed balance, else the chain's; it was open less the month's
    movement, or, with an opening before it, the official balance and everything since its start.

    ``movements``: account_id, operation_date, amount; ``chain``: account_id, closing; ``confirmed``: account_id, confirmed;
    ``openings``: account_id, start_date, official.
    """
    start = F.lit(month).cast("date")
    d = F.col("operation_date")
    rows = movements.join(openings, "account_id", "left")
    inside = (d >= start) & (d < F.add_months(start, 1))
    since = (d < start) & (d >= F.col("start_date"))
    sums = rows.groupBy("account_id").agg(F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).alias("moved"), F.coalesce(F.sum(F.when(since, F.col("amount"))), F.lit(0)).alias("since"), F.max("official").alias("official"))
    out = sums.join(chain.select("account_id", "closing"), "account_id", "left").join(confirmed, "account_id", "left")
    close = F.coalesce("confirmed", "closing")
    opened = F.when(F.col("official").isNotNull(), F.col("official") + F.col("since")).otherwise(close - F.col("moved"))
    return out.select("account_id", opened.cast(MONEY).alias("bank_open"), close.cast(MONEY).alias("bank_close"))


def month_comparison(bank: DataFrame, ledger: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Month ends side by side: account_id, month_end, bank, ledger, difference, confirmed, comment. ``confirmed``: account_id, month_end."""
    b = bank.select("account_id", "month_end", F.col("balance").alias("bank"))
    l = ledger.select("account_id", "month_end", F.col("balance").alias("ledger"))  # noqa: E741
    both = b.join(l, ["account_id", "month_end"], "full").join(confirmed.select("account_id", "month_end", F.lit(True).alias("_c")), ["account_id", "month_end"], "left")
    comment = F.when(F.col("bank").isNull(), "BalanceUnavailable").when(F.col("bank") != F.col("ledger"), "EvidenceReview").otherwise("")
    return both.select("account_id", "month_end", "bank", "ledger", (F.col("bank") - F.col("ledger")).cast(MONEY).alias("difference"), F.coalesce("_c", F.lit(False)).alias("confirmed"), comment.alias("comment"))


def report_sections(report: DataFrame, checks_: DataFrame, details: dict[str, DataFrame]) -> DataFrame:
    """A month's report as one tidy table (account_id, section, key, value): the map, the checks and every detail row, unrounded."""
    names = [c for c in report.columns if c != "account_id"]
    rows = report.select("account_id", F.lit("map").alias("section"), F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names))).alias("x")).select("account_id", "section", "x.*")
    rows = rows.unionByName(checks_.select("account_id", F.lit("checks").alias("section"), F.col("check").alias("key"), F.col("result").alias("value")))
    for name, d in details.items():
        rows = rows.unionByName(d.select("account_id", F.lit(name).alias("section"), F.col("row_id").cast("string").alias("key"), F.to_json(F.struct("detail", F.col("amount").cast("string").alias("amount"))).alias("value")))
    return rows


def feed_balances(rows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``rows`` (account_id, line_id, operation_date, statement_id, amount) with the balance after each: backwards from the account's
    verified endpoint (account_id, anchor, endpoint_id), null where the endpoint is not its last row."""
    order = ["operation_date", "statement_id", "line_id"]
    last = rows.groupBy("account_id").agg(F.max_by("line_id", F.struct(*order)).alias("_last"))
    good = endpoints.join(last, "account_id").where("endpoint_id = _last").select("account_id", "anchor")
    known = balance_from_anchor(rows, good, order).select("line_id", "balance")
    return rows.join(known, "line_id", "left")


def anchor_valid(feeds: DataFrame, tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether each feed account's balance can anchor: feed_id, valid.

    ``feeds``: feed_id, account_id, mapped (currency, IBAN and kind as mapped), balance, status, last_success, last_attempt, history_to, bank_day;
    ``tx``: feed_id, line_id, status, amount, currency, day (as the feed told); ``lines``: line_id, account_id, amount, currency, operation_date.
    Every imported transaction has one line of the account that says the same, no two share a line, and no line is without one.
    """
    head = F.col("mapped") & F.col("balance").isNotNull() & F.col("status").isin("ready", "stale") & (F.col("last_success") >= F.col("last_attempt")) & (F.col("history_to") <= F.col("bank_day"))
    l = lines.select("line_id", F.col("account_id").alias("_acc"), F.col("amount").alias("_amount"), F.col("currency").alias("_cur"), F.col("operation_date").alias("_day"))  # noqa: E741
    t = tx.join(feeds.select("feed_id", "account_id", "bank_day"), "feed_id").join(l, "line_id", "left")
    same = (F.col("_acc") == F.col("account_id")) & (F.col("_amount") == F.col("amount")) & (F.col("_cur") == F.col("currency")) & (F.col("_day") == F.col("day")) & (F.col("_day") <= F.col("bank_day"))
    bad = (~F.col("status").isin("imported", "zero")) | ((F.col("status") == "imported") & ~F.coalesce(same, F.lit(False)))
    wrong = t.where(bad).select("feed_id")
    twice = tx.where("status = 'imported'").groupBy("feed_id", "line_id").agg(F.count("*").alias("n")).where("n > 1").select("feed_id")
    owned = lines.join(feeds.select("feed_id", "account_id"), "account_id").select("feed_id", "line_id")
    alone = owned.join(tx.where("status = 'imported'").select("feed_id", "line_id"), ["feed_id", "line_id"], "left_anti").select("feed_id")
    refused = wrong.union(twice).union(alone).distinct().withColumn("_no", F.lit(True))
    return feeds.join(refused, "feed_id", "left").select("feed_id", (F.coalesce(head, F.lit(False)) & F.col("_no").isNull()).alias("valid"))


def pending_totals(rows: DataFrame, valid: Column) -> DataFrame:
    """account_id, bad_dates, bad_amounts, and the total of the pending rows; null where any of them is not valid."""
    return rows.groupBy("account_id").agg(F.count_if(F.col("operation_date").isNull()).alias("bad_dates"), F.count_if(F.col("amount") == 0).alias("bad_amounts"), F.when(F.bool_and(valid), F.sum("amount")).cast(MONEY).alias("pending_total"))
