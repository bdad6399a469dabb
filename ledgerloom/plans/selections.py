"""Queries of filters, states, order and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..operators.matching import by_link
from ..streaming import feed as N
from . import views as W
from .registry import query

PENDING = """pending as (
  select l.* from lines l join accounts a using (account_id) left join openings o using (account_id)
  where status < 2 and not closed and reconcilable and coalesce(operation_date >= start_date, true)
    and not exists (select 1 from ledger g where g.ledger_id = l.linked_ledger_id and g.reconciled))"""


def pending(spark, sf_dir, **more):
    return S.pending_lines(W.lines(spark, sf_dir), W.ledger(spark, sf_dir), W.accounts(spark, sf_dir), W.openings(spark, sf_dir), **more)


@query(f"with {PENDING} select line_id, account_id, amount from pending")
def d1_pending_lines(spark, sf_dir):
    return pending(spark, sf_dir).select("line_id", "account_id", "amount")


@query("select line_id from lines where contains(lower(description || ' ' || payment_reference), 'cartao') and abs(abs(amount) - 1000) <= 900 and amount < 0 and operation_date between date '1995-01-01' and date '1997-12-31'")
def d2_line_filters(spark, sf_dir):
    return S.line_filter(W.lines(spark, sf_dir), "CARTAO", "1000", "900", -1, "1995-01-01", "1997-12-31").select("line_id")


@query("select '>=' || 1000 as f, count(*)::bigint as n from lines where amount >= 1000 union all select '<> 2,5', count(*) from lines where amount <> 2.5 union all select 'dash', count(*) from lines where linked_ledger_id is null union all select 'bad', 0")
def d3_comparison_language(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    count = lambda name, e, c: l.where(S.comparison(e, c)).agg(F.count("*").alias("n")).select(F.lit(name).alias("f"), "n")
    return count(">=1000", ">= 1000", F.col("amount")).union(count("<> 2,5", "<> 2,5", F.col("amount"))).union(count("dash", "—", F.col("linked_ledger_id"))).union(count("bad", "> abc", F.col("amount")))


@query("select line_id from lines where operation_date >= date '1996-03-01' and operation_date < date '1996-03-31' + interval 1 day and contains(description, '_') = false and amount > 0 and status = 0")
def d4_statement_filter(spark, sf_dir):
    return S.statement_filter(W.lines(spark, sf_dir), "1996-03-01", "> 0", 0).where(~F.contains("description", F.lit("_"))).select("line_id")


@query("select line_id from lines where contains(lower(description || ' ' || counterparty_name), 'pagamento') and (contains(lower(description || ' ' || counterparty_name), '12') or abs(amount) = 12.00)")
def d6_token_search(spark, sf_dir):
    return S.search(W.lines(spark, sf_dir), "Pagamento 12", ["description", "counterparty_name"], "amount").select("line_id")


@query("select ledger_id, coalesce(booking_date < start_date, false) as historical from ledger left join openings using (account_id)")
def d9_is_historical(spark, sf_dir):
    return S.historical(W.ledger(spark, sf_dir), W.openings(spark, sf_dir), "booking_date").select("ledger_id", "historical")


STATE = """states as (
  select line_id, l.account_id, l.amount, l.operation_date, case
    when coalesce(operation_date < start_date, false) then 'reconciled'
    when linked_ledger_id is not null and (g.amount is null or abs(l.amount - g.amount) > 0.01 or (status = 2 and not coalesce(g.reconciled, false))) then 'review'
    when linked_ledger_id is not null and g.reconciled then 'reconciled' when linked_ledger_id is not null then 'registered'
    when status = 3 then 'skipped' else 'pending' end as state
  from lines l left join ledger g on g.ledger_id = l.linked_ledger_id left join openings o on o.account_id = l.account_id)"""


def states(spark, sf_dir):
    g = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("linked_ledger_id"), F.col("amount").alias("l_amount"), F.col("reconciled").alias("l_reconciled"))
    rows = by_link(W.lines(spark, sf_dir), g)
    return S.line_state(S.historical(rows, W.openings(spark, sf_dir), "operation_date"))


@query(f"with {STATE} select line_id, state from states")
def d10_line_state(spark, sf_dir):
    return states(spark, sf_dir).select("line_id", "state")


@query(f"with {STATE} select line_id, case when state in ('review', 'reconciled') then state when state = 'registered' then 'draft' when not closed and reconcilable then 'pending' end as worklist from states join accounts using (account_id)")
def d11_worklist_status(spark, sf_dir):
    return S.worklist_status(states(spark, sf_dir), W.accounts(spark, sf_dir)).select("line_id", "worklist")


@query("select line_id, g.ledger_id is null or not g.reconciled or l.amount <> g.amount as needs_review from lines l left join ledger g on g.ledger_id = l.linked_ledger_id where l.status = 2")
def d12_history_needs_review(spark, sf_dir):
    return S.history_needs_review(W.lines(spark, sf_dir), W.ledger(spark, sf_dir)).select("line_id", "needs_review")


@query("select ledger_id from ledger g where reconciled and exists (select 1 from lines l where l.linked_ledger_id = g.ledger_id)")
def d13_matched_ledger(spark, sf_dir):
    return S.matched_ledger(W.ledger(spark, sf_dir), W.lines(spark, sf_dir)).select("ledger_id")


@query("""select user_id % 25 + 1 as account_id, case when max(ts) < timestamp '2024-06-01 00:00:00' - interval 36 hour then 'stale' else 'ready' end as state from events group by 1""", base=False)
def d14_feed_state(spark, sf_dir):
    e = W.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25 + 1).alias("account_id")).agg(F.max("ts").alias("last"))
    return N.freshness(e, "last", "2024-06-01 00:00:00").select("account_id", "state")


KIND = "case ledger_id % 4 when 0 then 'native_bank' when 1 then 'payment' when 2 then 'supplier_invoice' else 'tax' end"


@query(f"select ledger_id, {KIND} as kind from ledger where ledger_id % 4 = 0 or (ledger_id % 4 = 1 and amount > 0) or (ledger_id % 4 > 1 and amount < 0)")
def d15_direction_compatible(spark, sf_dir):
    k = F.col("ledger_id") % 4
    kind = F.when(k == 0, "native_bank").when(k == 1, "payment").when(k == 2, "supplier_invoice").otherwise("tax")
    return W.ledger(spark, sf_dir).withColumn("kind", kind).where(S.compatible_direction(F.col("kind"), F.col("amount"))).select("ledger_id", "kind")


@query("select line_id, case when amount < 0 then 'payment' else 'receipt' end as nature, strftime(operation_date, '%Y-%m') as origin_month from lines")
def d16_nature_and_month(spark, sf_dir):
    return S.nature_and_month(W.lines(spark, sf_dir)).select("line_id", "nature", "origin_month")


@query("select distinct account_id, label from accounts a where exists (select 1 from lines l where l.account_id = a.account_id)")
def d22_statement_accounts(spark, sf_dir):
    return S.statement_accounts(W.accounts(spark, sf_dir), W.lines(spark, sf_dir)).select("account_id", "label")


@query("select account_id, line_id, linked_ledger_id, row_number() over (partition by account_id order by linked_ledger_id nulls last, operation_date nulls last, line_id) as position from lines")
def o1_stable_order(spark, sf_dir):
    order = S.stable_order("linked_ledger_id", "operation_date", tiebreak="line_id")
    link, day = F.col("linked_ledger_id"), F.col("operation_date")
    coarse = [link.isNull(), F.floor(link / 4096), F.when(link.isNull(), F.coalesce(day, F.lit("9999-12-31").cast("date")))]
    return S.positions(W.lines(spark, sf_dir), ["account_id"], coarse, order).select("account_id", "line_id", "linked_ledger_id", "position")


@query("select * from (select account_id, line_id, amount, row_number() over (partition by account_id order by abs(amount) desc, line_id) as rank from lines) where rank <= 5")
def o2_top_k(spark, sf_dir):
    return S.top_k(W.lines(spark, sf_dir), ["account_id"], [F.desc(F.abs("amount")), F.asc("line_id")], 5).select("account_id", "line_id", "amount", "rank")


@query("select statement_id, line_id, row_number() over (partition by account_id order by operation_date desc nulls last, statement_id desc, line_id desc) as position from lines")
def o3_statement_order(spark, sf_dir):
    far = F.coalesce(-F.datediff("operation_date", F.lit("1970-01-01").cast("date")), F.lit(1 << 30))
    return S.positions(W.lines(spark, sf_dir), ["account_id"], [far], [F.desc("statement_id"), F.desc("line_id")]).select("statement_id", "line_id", "position")


@query("""select account_id, line_id, n < total as more from (select account_id, line_id, row_number() over (partition by account_id order by operation_date, line_id) as n, count(*) over (partition by account_id) as total from lines)
 where n between 101 and 150 and n <= 150""")
def o4_page(spark, sf_dir):
    return S.page_of(W.lines(spark, sf_dir), ["account_id"], [F.col("operation_date")], [F.asc("line_id")], 50, 2).select("account_id", "line_id", "more")
