"""Queries of the report's row states, balances and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from . import views as W
from .balances import ANCHOR, MAP, OFFICIAL, _bank, _ledger, _openings
from .registry import query

M = W.MONEY
NEXT = "1996-07-01"
#: Bank rows with every kind of flaw: undated, without amount, foreign, duplicate, linked twice, to nothing, with other references.
ROWS = """bank_rows as (select line_id as row_id, line_id // 10 as k, account_id, case when line_id // 10 % 101 <> 0 then operation_date end as operation_date, case when line_id // 10 % 103 <> 0 then amount end as amount,
   case when line_id // 10 % 97 = 0 then 'USD' else 'EUR' end as currency, line_id // 10 % 89 = 0 as is_duplicate, status, linked_ledger_id as native_id,
   case when line_id // 10 % 83 = 1 and linked_ledger_id is null then (line_id // 10 - 1) else linked_ledger_id end as expected_native_id, 'S' || statement_id as statement_ref, start_date from lines left join openings using (account_id)),
 native as (select ledger_id, case when ledger_id % 107 <> 0 then booking_date end as l_date, amount as l_amount, case when ledger_id % 109 = 0 then 'USD' else 'EUR' end as l_currency, ledger_id % 107 <> 0 and ledger_id % 109 <> 0 as l_valid, reconciled as l_reconciled,
   case when ledger_id % 79 = 0 then 'other' else 'S' || (account_id * 100000 + year(booking_date) * 12 + month(booking_date)) end as l_ref from ledger),
 judged as (select *, operation_date is null as invalid_date, amount is null as invalid_amount, currency <> 'EUR' as currency_mismatch, operation_date is not null and amount is not null and currency = 'EUR' as valid from bank_rows)"""


def bank_rows(spark, sf_dir):
    k = (F.col("line_id") / 10).cast("long")
    rows = W.lines(spark, sf_dir).join(W.openings(spark, sf_dir).select("account_id", "start_date"), "account_id", "left")
    return rows.select(
        F.col("line_id").alias("row_id"), "account_id", F.when(k % 101 != 0, F.col("operation_date")).alias("operation_date"), F.when(k % 103 != 0, F.col("amount")).alias("amount"), F.when(k % 97 == 0, "USD").otherwise("EUR").alias("currency"),
        (k % 89 == 0).alias("is_duplicate"), "status", F.col("linked_ledger_id").alias("native_id"), F.when((k % 83 == 1) & F.col("linked_ledger_id").isNull(), k - 1).otherwise(F.col("linked_ledger_id")).alias("expected_native_id"),
        F.concat(F.lit("S"), F.col("statement_id").cast("string")).alias("statement_ref"), "start_date")


def native(spark, sf_dir):
    k = F.col("ledger_id")
    month = F.col("account_id") * 100000 + F.year("booking_date") * 12 + F.month("booking_date")
    return W.ledger(spark, sf_dir).select(
        "ledger_id", F.when(k % 107 != 0, F.col("booking_date")).alias("l_date"), F.col("amount").alias("l_amount"), F.when(k % 109 == 0, "USD").otherwise("EUR").alias("l_currency"), ((k % 107 != 0) & (k % 109 != 0)).alias("l_valid"),
        F.col("reconciled").alias("l_reconciled"), F.when(k % 79 == 0, "other").otherwise(F.concat(F.lit("S"), month.cast("string"))).alias("l_ref"))


@query(f"with {ROWS} select row_id, invalid_date, invalid_amount, currency_mismatch, valid from judged")
def r1_row_validity(spark, sf_dir):
    return R.validity(bank_rows(spark, sf_dir), "EUR").select("row_id", "invalid_date", "invalid_amount", "currency_mismatch", "valid")


@query(f"with {ROWS} select row_id, coalesce(l_date >= date '{NEXT}' and l_valid, false) as timing from judged left join native on ledger_id = native_id where operation_date is null or operation_date < date '{NEXT}'")
def r2_cutoff(spark, sf_dir):
    return R.cutoff(bank_rows(spark, sf_dir), native(spark, sf_dir), NEXT).select("row_id", "timing")


STATES = f"""claims as (select expected_native_id as id, count(*) as claims from judged where not is_duplicate and expected_native_id is not null group by 1),
 linked as (select j.*, coalesce(expected_native_id, native_id) as id, c.claims, n.* from judged j left join claims c on c.id = coalesce(expected_native_id, native_id) left join native n on n.ledger_id = coalesce(expected_native_id, native_id) where operation_date is null or operation_date < date '{NEXT}'),
 facts as (select *, id is not null as asked, coalesce(l_date < date '{NEXT}', false) as found, coalesce(native_id = id, false) as own, coalesce(amount = l_amount, false) as equal, coalesce(statement_ref = l_ref, false) as referred, coalesce(claims > 1, false) as conflict,
   coalesce((operation_date < start_date) <> (l_date < start_date), false) as crosses from linked),
 step as (select *, not is_duplicate and not conflict and valid and found and coalesce(l_valid, false) and status = 2 and coalesce(l_reconciled, false) and own and equal and referred as good,
   asked and (native_id is null or coalesce(l_currency, '') <> 'EUR' or not equal or crosses or l_date is null) as broken from facts),
 flagged as (select *, (status = 2 and (not asked or broken or not coalesce(l_reconciled, false) or not referred)) or (status <> 2 and asked and coalesce(l_reconciled, false)) as flags from step),
 states as (select *, not is_duplicate and (broken or flags or (status = 2 and found and not good)) as wrong from flagged)"""


@query(f"with {ROWS}, {STATES} select row_id, conflict, broken as link_invalid, flags as flags_invalid, good and not wrong as matched, not valid or conflict or wrong as review from states")
def r4_link_state(spark, sf_dir):
    return R.link_state(R.validity(bank_rows(spark, sf_dir), "EUR"), native(spark, sf_dir), "EUR", NEXT)


GROUPS = f"""raw as (select ledger_id // 40 as batch, * from ledger where ledger_id % 4 = 0 and amount > 0),
 groups as (select -batch as row_id, cast(sum(amount) + case when batch % 7 = 0 then 1 else 0 end as decimal(18,2)) as amount, batch % 11 <> 0 as valid, case when batch % 13 = 0 then 1 else 2 end as status, 'G' || batch as statement_ref from raw group by batch),
 parts as (select -batch as row_id, ledger_id, amount, cast(amount + case when ledger_id % 52 = 0 then 1 else 0 end as decimal(18,2)) as expected, booking_date as day, reconciled, case when ledger_id % 68 = 0 then 'x' else 'G' || batch end as ref, case when ledger_id % 76 = 0 then 2 else 1 end as claims from raw),
 per as (select p.row_id, count(*) as n, sum(p.amount) as total, bool_and(p.amount = expected and reconciled and ref = statement_ref) as good, bool_or(claims > 1) as conflict, bool_or(day >= date '{NEXT}') as future from parts p join groups g using (row_id) group by 1),
 calm as (select row_id, valid and status = 2 and n >= 2 and good and total = amount and not conflict as calm, future from groups join per using (row_id))"""


@query(f"with {GROUPS} select row_id, calm and not future as matched, not calm as review, calm and future as timing from calm")
def r5_group_state(spark, sf_dir):
    """Groups of reconciled receipts with neighbouring ids; some sums, members, references, claims or flags are off."""
    raw = W.ledger(spark, sf_dir).where("ledger_id % 4 = 0 and amount > 0").withColumn("batch", F.floor(F.col("ledger_id") / 40).cast("long"))
    b, k = F.col("batch"), F.col("ledger_id")
    g = raw.groupBy("batch").agg(F.sum("amount").alias("s")).select((-b).alias("row_id"), (F.col("s") + F.when(b % 7 == 0, 1).otherwise(0)).cast(M).alias("amount"), (b % 11 != 0).alias("valid"), F.when(b % 13 == 0, 1).otherwise(2).alias("status"), F.concat(F.lit("G"), b.cast("string")).alias("statement_ref"))
    m = raw.select((-b).alias("row_id"), "ledger_id", "amount", (F.col("amount") + F.when(k % 52 == 0, 1).otherwise(0)).cast(M).alias("expected_amount"), F.col("booking_date").alias("day"), F.lit("EUR").alias("currency"), "reconciled", F.when(k % 68 == 0, "x").otherwise(F.concat(F.lit("G"), b.cast("string"))).alias("ref"), F.when(k % 76 == 0, 2).otherwise(1).alias("claims"))
    return R.group_state(g, m, "EUR", NEXT)


DETAIL = f"""shown as (select row_id, account_id, amount, operation_date, case when is_duplicate then 'duplicate' when old and not review then 'opening' when matched then 'matched' when review then 'review' else 'pending' end as detail,
   coalesce(greatest(0, date_diff('day', operation_date, date '1996-06-30')), 0)::int as age, coalesce(operation_date < date '1996-06-01', false) as carried from
   (select *, coalesce(valid and operation_date < start_date, false) and not is_duplicate as old, good and not wrong as matched, not valid or conflict or wrong as review from states)
   where operation_date is null or operation_date >= date '1996-06-01' or not ((good and not wrong) or (old and not review)))"""


def details(spark, sf_dir):
    rows = R.validity(bank_rows(spark, sf_dir), "EUR")
    state = R.link_state(rows, native(spark, sf_dir), "EUR", NEXT).select("row_id", "matched", "review")
    old = F.coalesce(F.col("valid") & (F.col("operation_date") < F.col("start_date")), F.lit(False))
    return R.detail_rows(rows.join(state, "row_id").withColumn("historical", old), "1996-06-01")


@query(f"with {ROWS}, {STATES}, {DETAIL} select row_id, detail, age, carried from shown")
def r7_detail_members(spark, sf_dir):
    return details(spark, sf_dir).select("row_id", "detail", "age", "carried")


BALANCES = f"""{OFFICIAL}, chain as (select account_id, cast(sum(amount) + 500 as decimal(18,2)) as closing from lines where operation_date < date '{NEXT}' group by 1),
 sums as (select l.account_id, coalesce(sum(amount) filter (operation_date >= date '1996-06-01' and operation_date < date '{NEXT}'), 0) as moved, coalesce(sum(amount) filter (operation_date < date '1996-06-01' and operation_date >= start_date), 0) as since, max(official) as official from lines l left join official using (account_id) group by 1),
 closes as (select s.*, case when s.account_id % 5 = 0 then cast(1000 as decimal(18,2)) else closing end as close from sums s left join chain using (account_id))"""


@query(f"with {BALANCES} select account_id, cast(case when official is not null then official + since else close - moved end as decimal(18,2)) as bank_open, cast(close as decimal(18,2)) as bank_close from closes")
def r9_balances(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    chain = l.where(F.col("operation_date") < NEXT).groupBy("account_id").agg((F.sum("amount") + 500).cast(M).alias("closing"))
    confirmed = W.accounts(spark, sf_dir).where("account_id % 5 = 0").select("account_id", F.lit(1000).cast(M).alias("confirmed"))
    return R.bank_balances(l, chain, confirmed, _openings(spark, sf_dir).select("account_id", "start_date", "official"), "1996-06-01")


SERIES = """m as (select unnest(generate_series(date '1995-01-01', date '1995-12-01', interval 1 month))::date as month),
 b as (select account_id, month, last_day(month) as month_end, cast(coalesce((select sum(amount) from lines l where l.account_id = a.account_id and operation_date <= last_day(month)), 0) as decimal(18,2)) as bank from (select distinct account_id from lines) a, m),
 g as (select account_id, month, cast(coalesce((select sum(amount) from ledger l where l.account_id = a.account_id and booking_date <= last_day(month)), 0) as decimal(18,2)) as ledger from (select distinct account_id from ledger) a, m)"""


def series(spark, sf_dir):
    month = lambda t, d: R.month_end_series(t, d, "1995-01-01", "1995-12-01")
    bank, ledger = month(W.lines(spark, sf_dir), "operation_date"), month(W.ledger(spark, sf_dir), "booking_date")
    confirmed = bank.where("account_id % 5 = 0 and month(month_end) % 2 = 0").select("account_id", "month_end")
    return R.month_comparison(bank, ledger, confirmed)


COMPARED = "account_id, cast(last_day(month) as date) as month_end, bank, ledger, cast(bank - ledger as decimal(18,2)) as difference, account_id % 5 = 0 and month(month) % 2 = 0 as confirmed, case when bank is null then 'BalanceUnavailable' when bank <> ledger then 'EvidenceReview' else '' end as comment from b full join g using (account_id, month)"


@query(f"with {SERIES} select {COMPARED}")
def r12_month_comparison(spark, sf_dir):
    return series(spark, sf_dir)


@query(f"with {SERIES} select account_id || ';' || strftime(last_day(month), '%Y-%m-%d') || ';' || coalesce(cast(bank as varchar), '') || ';' || ledger as row from b full join g using (account_id, month) where ledger is not null and bank is not null")
def w4_month_end_balances(spark, sf_dir):
    """The export's rows as they are written; the file itself is written by ``sinks.write_month_ends``."""
    s = series(spark, sf_dir).where("bank is not null and ledger is not null")
    return s.select(F.concat_ws(";", *(F.col(c).cast("string") for c in ("account_id", "month_end", "bank", "ledger"))).alias("row"))


@query(f"""with {MAP}, {ROWS}, {STATES}, {DETAIL}
 select account_id, 'map' as section, key, cast(value as varchar) as value from full_report unpivot (value for key in (bank_close, bank_pending, ledger_close, ledger_pending, bank_adjusted, ledger_adjusted, difference))
 union all select account_id, 'checks', 'difference', case when difference = 0 then 'ok' else 'warning' end from full_report union all select account_id, 'checks', 'bank_pending', case when bank_pending = 0 then 'ok' else 'warning' end from full_report
 union all select account_id, 'checks', 'ledger_pending', case when ledger_pending = 0 then 'ok' else 'warning' end from full_report
 union all select account_id, 'bank', cast(row_id as varchar), '{{"detail":"' || detail || '"' || case when amount is null then '' else ',"amount":"' || amount || '"' end || '}}' from shown""")
def w3_monthly_report(spark, sf_dir):
    report = R.reconciliation_map(_bank(spark, sf_dir), _ledger(spark, sf_dir))
    return R.report_sections(report, R.checks(report), {"bank": details(spark, sf_dir)})


@query(f"with {ANCHOR}, last as (select account_id, max_by(line_id, (operation_date, statement_id, line_id)) as last from lines group by 1), good as (select account_id, anchor from anchors join last using (account_id) where account_id % 3 <> 0) "
       "select line_id, cast(anchor - coalesce(sum(amount) over (partition by account_id order by operation_date desc, statement_id desc, line_id desc rows between unbounded preceding and 1 preceding), 0) as decimal(18,2)) as balance from lines left join good using (account_id)")  # fmt: skip
def v3_feed_balances(spark, sf_dir):
    """The endpoint of every third account is not its last row."""
    l = W.lines(spark, sf_dir)  # noqa: E741
    last = l.groupBy("account_id").agg(F.max_by("line_id", F.struct("operation_date", "statement_id", "line_id")).alias("last"))
    ends = last.select("account_id", (F.col("account_id") + 1000000).cast(M).alias("anchor"), F.when(F.col("account_id") % 3 != 0, F.col("last")).otherwise(-1).alias("endpoint_id"))
    return R.feed_balances(l, ends).select("line_id", "balance")


@query("""with t as (select account_id, bool_or((account_id % 4 = 1 and line_id % 770 = 0) or (account_id % 4 = 2 and line_id % 130 = 0) or (account_id % 4 = 3 and line_id % 910 = 0)) as bad from lines group by 1)
 select account_id as feed_id, account_id % 7 <> 0 and account_id % 5 <> 0 and account_id % 11 <> 0 and not coalesce(bad, false) as valid from accounts left join t using (account_id)""")
def v4_anchor_valid(spark, sf_dir):
    """Some accounts are not mapped, have a failed attempt or too long a history; some transactions differ, are doubled or missing."""
    a, l = F.col("account_id"), W.lines(spark, sf_dir).withColumn("currency", F.lit("EUR"))  # noqa: E741
    day = F.lit("2030-01-01").cast("date")
    feeds = W.accounts(spark, sf_dir).select(a.alias("feed_id"), "account_id", (a % 7 != 0).alias("mapped"), F.lit(1).alias("balance"), F.lit("ready").alias("status"), F.lit(5).alias("last_success"), F.when(a % 5 == 0, 6).otherwise(5).alias("last_attempt"), F.when(a % 11 == 0, F.date_add(day, 1)).otherwise(day).alias("history_to"), day.alias("bank_day"))
    tx = l.where("not (account_id % 4 = 3 and line_id % 910 = 0)").select(a.alias("feed_id"), "line_id", F.lit("imported").alias("status"), (F.col("amount") + F.when((a % 4 == 1) & (F.col("line_id") % 770 == 0), 1).otherwise(0)).cast(M).alias("amount"), "currency", F.col("operation_date").alias("day"))
    return R.anchor_valid(feeds, tx.unionByName(tx.where("feed_id % 4 = 2 and line_id % 130 = 0")), l)
