"""Queries of balances, month-end series, report and opening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from . import views as W
from .registry import query

M = W.MONEY


@query("select ledger_id, cast(sum(amount) over (partition by account_id order by booking_date, ledger_id) as decimal(18,2)) as balance from ledger")
def v1_ledger_running_balance(spark, sf_dir):
    return R.running_balance(W.ledger(spark, sf_dir), "booking_date", "ledger_id").select("ledger_id", "balance")


@query("""with bad as (select *, min(case when ledger_id % 5003 = 7 then 0 else 1 end) over (partition by account_id order by booking_date, ledger_id) as ok from ledger)
 select ledger_id, case when ok = 1 then cast(sum(amount) over (partition by account_id order by booking_date, ledger_id) as decimal(18,2)) end as balance from bad""")
def v1_balance_until_invalid(spark, sf_dir):
    return R.running_balance(W.ledger(spark, sf_dir), "booking_date", "ledger_id", valid=F.col("ledger_id") % 5003 != 7).select("ledger_id", "balance")


ANCHOR = "anchors as (select account_id, cast(1000000 + account_id as decimal(18,2)) as anchor from accounts)"


@query(f"with {ANCHOR} select line_id, cast(anchor - coalesce(sum(amount) over (partition by account_id order by operation_date desc, statement_id desc, line_id desc rows between unbounded preceding and 1 preceding), 0) as decimal(18,2)) as balance from lines join anchors using (account_id)")
def v2_feed_display_balance(spark, sf_dir):
    anchors = W.accounts(spark, sf_dir).select("account_id", (F.col("account_id") + 1000000).cast(M).alias("anchor"))
    return R.balance_from_anchor(W.lines(spark, sf_dir), anchors, ["operation_date", "statement_id", "line_id"]).select("line_id", "balance")


@query("""with b as (select *, cast(500 + sum(amount) over (partition by account_id order by operation_date, line_id) + case when account_id = 3 and line_id % 11 = 0 then 1 else 0 end as decimal(18,2)) as running_balance from lines),
 base as (select *, running_balance - sum(amount) over (partition by account_id order by operation_date, line_id) as base from b)
 select account_id, case when min(base) = max(base) then cast(min(base) + sum(amount) as decimal(18,2)) end as closing, min(base) = max(base) as is_coherent from base group by 1""")
def v5_balance_chain(spark, sf_dir):
    """Statement balances of account 3 are a unit off on some lines."""
    off = F.when((F.col("account_id") == 3) & (F.col("line_id") % 11 == 0), 1).otherwise(0)
    rows = R.running_balance(W.lines(spark, sf_dir), "operation_date", "line_id").withColumn("running_balance", (F.col("balance") + 500 + off).cast(M))
    return R.balance_chain(rows, ["operation_date", "line_id"])


@query("""with m as (select unnest(generate_series(date '1995-01-01', date '1995-12-01', interval 1 month))::date as month)
 select account_id, cast(last_day(month) as date) as month_end, cast(coalesce((select sum(amount) from ledger g where g.account_id = a.account_id and booking_date <= last_day(month)), 0) as decimal(18,2)) as balance
 from (select distinct account_id from ledger) a, m""")
def v12_month_end_series(spark, sf_dir):
    return R.month_end_series(W.ledger(spark, sf_dir), "booking_date", "1995-01-01", "1995-12-01")


def _summary(side: str, date: str, accepted: str) -> str:
    end = "date '1996-07-01'"
    return f"""select account_id, cast(coalesce(sum(amount) filter ({date} < date '1996-06-01'), 0) as decimal(18,2)) as opening, cast(coalesce(sum(amount) filter ({date} >= date '1996-06-01' and {date} < {end}), 0) as decimal(18,2)) as movement,
 count(*) filter ({date} >= date '1996-06-01' and {date} < {end}) as n, count(*) filter ({date} >= date '1996-06-01' and {date} < {end} and {accepted}) as matched, count(*) filter ({date} < {end} and not {accepted}) as pending,
 cast(coalesce(sum(amount) filter ({date} < {end} and not {accepted}), 0) as decimal(18,2)) as pending_amount, count(*) filter ({date} < {end} - 31 and not {accepted}) as over_30, count(*) filter ({date} < {end} - 91 and not {accepted}) as over_90,
 count(*) filter ({date} < date '1996-06-01' and not {accepted}) as carried from {side} group by 1"""


def _bank(spark, sf_dir):
    return R.side_summary(W.lines(spark, sf_dir).withColumn("accepted", F.col("status") == 2), "operation_date", "1996-06-01", "accepted")


def _ledger(spark, sf_dir):
    return R.side_summary(W.ledger(spark, sf_dir), "booking_date", "1996-06-01", "reconciled")


@query(_summary("lines", "operation_date", "(status = 2)"))
def r8_bank_summary(spark, sf_dir):
    return _bank(spark, sf_dir)


@query(_summary("ledger", "booking_date", "reconciled"))
def a11_ledger_summary(spark, sf_dir):
    return _ledger(spark, sf_dir)


MAP = f"""b as ({_summary('lines', 'operation_date', '(status = 2)')}), l as ({_summary('ledger', 'booking_date', 'reconciled')}),
 report as (select account_id, cast(coalesce(b.opening + b.movement, 0) as decimal(18,2)) as bank_close, cast(coalesce(b.pending_amount, 0) as decimal(18,2)) as bank_pending,
 cast(coalesce(l.opening + l.movement, 0) as decimal(18,2)) as ledger_close, cast(coalesce(l.pending_amount, 0) as decimal(18,2)) as ledger_pending from b full join l using (account_id)),
 full_report as (select *, cast(bank_close + ledger_pending as decimal(18,2)) as bank_adjusted, cast(ledger_close + bank_pending as decimal(18,2)) as ledger_adjusted, cast(bank_close + ledger_pending - ledger_close - bank_pending as decimal(18,2)) as difference from report)"""


@query(f"with {MAP} select * from full_report")
def r10_reconciliation_map(spark, sf_dir):
    return R.reconciliation_map(_bank(spark, sf_dir), _ledger(spark, sf_dir))


@query(f"""with {MAP} select account_id, 'difference' as "check", case when difference = 0 then 'ok' else 'warning' end as result from full_report union all
 select account_id, 'bank_pending', case when bank_pending = 0 then 'ok' else 'warning' end from full_report union all select account_id, 'ledger_pending', case when ledger_pending = 0 then 'ok' else 'warning' end from full_report""")
def r11_checks(spark, sf_dir):
    return R.checks(R.reconciliation_map(_bank(spark, sf_dir), _ledger(spark, sf_dir)))


@query("""with c as (select linked_ledger_id as id, count(*) as n from lines where linked_ledger_id is not null group by 1)
 select line_id, case when linked_ledger_id is not null and n > 1 then 'conflict' when linked_ledger_id is not null and g.amount is null then 'invalid' when linked_ledger_id is not null and l.amount <> g.amount then 'invalid'
  when linked_ledger_id is not null and date_trunc('month', g.booking_date) > date_trunc('month', operation_date) then 'timing' when linked_ledger_id is not null and status = 2 and reconciled then 'matched' else 'open' end as "match"
 from lines l left join ledger g on g.ledger_id = linked_ledger_id left join c on c.id = linked_ledger_id""")
def r3_match_state(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    g = W.ledger(spark, sf_dir).select("ledger_id", F.col("amount").alias("l_amount"), F.col("booking_date").alias("l_date"), "reconciled")
    claims = l.where("linked_ledger_id is not null").groupBy(F.col("linked_ledger_id").alias("ledger_id")).agg(F.count("*").alias("n"))
    return R.match_state(l, g, claims).select("line_id", "match")


@query("""select line_id, case when status = 2 then 'matched' when status = 3 then 'skipped' when operation_date < date '1996-06-01' then 'carried' else 'pending' end as detail, greatest(0, date_diff('day', operation_date, date '1996-06-30')) as age
 from lines where operation_date < date '1996-07-01' and (status <> 2 or operation_date >= date '1996-06-01')""")
def r6_detail_rows(spark, sf_dir):
    """Detail rows of June 1996: in the month, or carried and still open."""
    d = F.col("operation_date")
    rows = W.lines(spark, sf_dir).where((d < "1996-07-01") & ((F.col("status") != 2) | (d >= "1996-06-01")))
    detail = F.when(F.col("status") == 2, "matched").when(F.col("status") == 3, "skipped").when(d < "1996-06-01", "carried").otherwise("pending")
    return rows.select("line_id", detail.alias("detail"), F.greatest(F.lit(0), F.datediff(F.lit("1996-06-30").cast("date"), d)).cast("long").alias("age"))


@query("""select account_id, count(*) filter (operation_date is null) as bad_dates, count(*) filter (amount = 0) as bad_amounts, case when bool_or(line_id % 12347 = 0) then null else cast(sum(amount) as decimal(18,2)) end as pending_total from lines where status < 2 group by 1""")
def r13_validity_and_total(spark, sf_dir):
    rows = W.lines(spark, sf_dir).where("status < 2")
    return R.pending_totals(rows, F.col("line_id") % 12347 != 0)


OFFICIAL = "official as (select account_id, start_date, cast(case when account_id % 4 = 1 then 0 else 100000 end as decimal(18,2)) as official from openings)"


def _openings(spark, sf_dir):
    return W.openings(spark, sf_dir).withColumn("official", F.when(F.col("account_id") % 4 == 1, 0).otherwise(100000).cast(M))


@query(f"with {OFFICIAL}, s as (select account_id, sum(amount) as s, count(*) as n from ledger join official using (account_id) where booking_date < start_date group by 1) select account_id, cast(coalesce(s, 0) as decimal(18,2)) as ledger_balance, cast(official - coalesce(s, 0) as decimal(18,2)) as adjustment, coalesce(n, 0) as rows_before from official left join s using (account_id)")
def q1_opening_preview(spark, sf_dir):
    return R.opening_preview(W.ledger(spark, sf_dir), _openings(spark, sf_dir))


@query(f"""with {OFFICIAL}, s as (select account_id, sum(amount) as s from ledger join official using (account_id) where booking_date < start_date group by 1)
 select ledger_id, account_id, booking_date, amount, reconciled or coalesce(booking_date < start_date, false) as reconciled from ledger left join official using (account_id)
 union all select -account_id, account_id, cast(start_date - 1 as date), cast(official - coalesce(s, 0) as decimal(18,2)), true from official left join s using (account_id) where official - coalesce(s, 0) <> 0""")
def q2_opening_apply(spark, sf_dir):
    return R.opening_apply(W.ledger(spark, sf_dir), _openings(spark, sf_dir))


@query(f"with {OFFICIAL} select account_id, official as balance, true as valid from official")
def q3_opening_valid(spark, sf_dir):
    """After the opening is applied, everything before its start sums to the official balance and is reconciled."""
    o = _openings(spark, sf_dir)
    return R.opening_valid(R.opening_apply(W.ledger(spark, sf_dir), o), o)
