"""Queries of summaries and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as A
from . import views as W
from .candidates import PAYMENTS, payments
from .registry import query
from .selections import STATE, states

M = W.MONEY
MEMBERS = "members as (select cast(floor(ledger_id / 3) as bigint) as batch_id, ledger_id, booking_date, amount, reconciled from ledger where ledger_id % 7 = 0 or ledger_id % 4 = 0)"


def members(spark, sf_dir):
    return W.ledger(spark, sf_dir).where("ledger_id % 7 = 0 or ledger_id % 4 = 0").select(F.floor(F.col("ledger_id") / 3).cast("long").alias("batch_id"), "ledger_id", "booking_date", "amount", "reconciled")


@query("""select statement_id, min(operation_date) as first_date, max(operation_date) as last_date, count(*) as n, cast(sum(l.amount) as decimal(18,2)) as total, count(linked_ledger_id) as linked, count(*) filter (status = 2) as reconciled,
 count(*) filter (linked_ledger_id is not null and (g.amount is null or abs(l.amount - g.amount) > 0.001 or not g.reconciled)) as issues from lines l left join ledger g on g.ledger_id = linked_ledger_id group by 1""")
def a1_statement_summary(spark, sf_dir):
    return A.statement_summary(W.lines(spark, sf_dir), W.ledger(spark, sf_dir))


@query("select a.account_id, label, cast(coalesce((select sum(amount) from ledger g where g.account_id = a.account_id), 0) as decimal(18,2)) as balance, (select count(*) from lines l where l.account_id = a.account_id and status < 2) as pending from accounts a where not closed")
def a2_account_overview(spark, sf_dir):
    return A.account_overview(W.accounts(spark, sf_dir), W.ledger(spark, sf_dir), W.lines(spark, sf_dir))


@query(f"with {MEMBERS} select batch_id, count(*) as n, cast(sum(amount) as decimal(18,2)) as total, min(booking_date) as first_date, max(booking_date) as last_date, count(*) >= 2 and bool_and(reconciled) and sum(amount) = sum(amount) + case when batch_id % 5 = 0 then 1 else 0 end as is_valid from members group by 1")
def a3_batch_projection(spark, sf_dir):
    m = members(spark, sf_dir)
    targets = m.groupBy("batch_id").agg(F.sum("amount").alias("s")).select("batch_id", (F.col("s") + F.when(F.col("batch_id") % 5 == 0, 1).otherwise(0)).cast(M).alias("target"))
    return A.batch_projection(m, targets).select("batch_id", "n", "total", "first_date", "last_date", "is_valid")


@query(f"with {MEMBERS} select ledger_id, count(*) as claims from (select linked_ledger_id as ledger_id from lines where linked_ledger_id is not null union all select ledger_id from members) group by 1")
def a4_claim_counts(spark, sf_dir):
    return A.claim_counts(W.lines(spark, sf_dir), members(spark, sf_dir))


KINDS = ("pending", "review", "reconciled", "registered", "skipped")


@query(f"with {STATE} select account_id, {', '.join(f'count(*) filter (state = {chr(39)}{k}{chr(39)}) as {k}' for k in KINDS)}, count(*) as every from states group by 1")
def a5_status_counts(spark, sf_dir):
    return A.status_counts(states(spark, sf_dir), "state", list(KINDS), ["account_id"])


@query(f"with {STATE} select count(*) filter (state in ('pending', 'registered')) as pending, count(*) filter (state = 'registered') as draft, count(*) filter (state = 'reconciled') as reconciled, count(*) filter (state = 'review') as review, count(*) as every from states")
def a6_worklist_counts(spark, sf_dir):
    return A.worklist_counts(states(spark, sf_dir))


@query("select 'EUR' as currency, count(*) as n, count(linked_ledger_id) as linked, cast(sum(greatest(amount, 0)) as decimal(18,2)) as credit, cast(sum(least(amount, 0)) as decimal(18,2)) as debit from lines where status = 2")
def a7_history_summary(spark, sf_dir):
    return A.history_summary(W.lines(spark, sf_dir).withColumn("currency", F.lit("EUR")))


@query("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities from orders group by 1", base=False)
def a8_listed(spark, sf_dir):
    return A.listed(W.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "priorities")


@query(f"with {PAYMENTS} select invoice_id, min(supplier_id) as supplier_id, count(*) as n from payments group by 1 having count(distinct supplier_id) = 1")
def a10_single_party(spark, sf_dir):
    return A.single_party(payments(spark, sf_dir), "invoice_id", "supplier_id")


@query("""with a as (select account_id, description, count(*) as uses, max(operation_date) as last_used from lines group by 1, 2)
 select * from (select *, row_number() over (partition by account_id order by uses desc, last_used desc, description) as place from a) where place <= 5""")
def a12_top_descriptions(spark, sf_dir):
    return A.top_descriptions(W.lines(spark, sf_dir), 5)


@query("select line_id, count(*) as documents, cast(sum(cast(abs(g.amount) * 100 as bigint)) * 100 // max(cast(abs(l.amount) * 100 as bigint)) as bigint) as coverage from lines l join ledger g on g.account_id = l.account_id and g.booking_date = l.operation_date and sign(g.amount) = sign(l.amount) and abs(g.amount) <= abs(l.amount) group by 1")
def a13_candidate_metrics(spark, sf_dir):
    return A.candidate_metrics(W.lines(spark, sf_dir), W.ledger(spark, sf_dir))


@query("select count(*) as total, count(*) filter (cast(ts as date) < date '2024-01-15') as purgeable, min(cast(ts as date)) as oldest, max(cast(ts as date)) as newest from events", base=False)
def a14_audit_retention(spark, sf_dir):
    return A.retention(W.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")), "day", F.lit("2024-01-15").cast("date"))


@query("select user_id % 25 + 1 as account_id, least(min(cast(ts as date)), date '2024-01-10') as first_day, greatest(max(cast(ts as date)), date '2024-01-20') as last_day from events group by 1", base=False)
def a15_feed_history_range(spark, sf_dir):
    e = W.table(spark, sf_dir, "events").select((F.col("user_id") % 25 + 1).alias("account_id"), F.col("ts").cast("date").alias("day"))
    return A.feed_history_range(e, "day", "2024-01-10", "2024-01-20")
