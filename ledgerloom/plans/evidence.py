"""Queries of deduplication, set operations, integrity and state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import matching as J
from ..operators import selection as S
from ..operators import summaries as A
from . import views as W
from .matches import SCORED, scored
from .registry import query

OLD = "old as (select ledger_id * 10 as line_id, account_id, amount from ledger where ledger_id % 3 = 0)"


@query(f"with {OLD} select line_id, account_id, amount, 'staged' as generation from lines union all select *, 'legacy' from old where line_id not in (select line_id from lines)")
def u1_unite_generations(spark, sf_dir):
    old = W.ledger(spark, sf_dir).where("ledger_id % 3 = 0").select((F.col("ledger_id") * 10).alias("line_id"), "account_id", "amount")
    return A.unite_generations(W.lines(spark, sf_dir).select("line_id", "account_id", "amount"), old, "line_id")


@query("select ledger_id from ledger where reconciled and ledger_id not in (select linked_ledger_id from lines where linked_ledger_id is not null)")
def u4_unclaimed_reconciled(spark, sf_dir):
    return S.unbacked_ledger(W.ledger(spark, sf_dir), W.lines(spark, sf_dir)).select("ledger_id")


def _import(spark, sf_dir):
    """The lines with some repeated and some zeroed, hashed; a fifth exists already."""
    l = W.lines(spark, sf_dir)  # noqa: E741
    again = l.where("line_id % 500 = 10").withColumn("line_id", F.col("line_id") + 1)
    new = l.unionByName(again).withColumn("amount", F.when(F.col("line_id") % 130 == 0, F.lit(0).cast(W.MONEY)).otherwise(F.col("amount")))
    new = new.withColumn("hash", V.line_hash(F.lit(1), "account_id", "operation_date", "amount", "payment_reference", "description"))
    return new, new.where("line_id % 50 = 10").select("hash")


@query("""with src as (select line_id, account_id, operation_date, amount, payment_reference, description from lines union all select line_id + 1, account_id, operation_date, amount, payment_reference, description from lines where line_id % 500 = 10),
 n as (select line_id, account_id, operation_date, case when line_id % 130 = 0 then 0 else amount end as amount, payment_reference, description from src),
 k as (select distinct account_id, operation_date, amount, payment_reference, description, true as known from n where line_id % 50 = 10)
 select line_id, case when n.amount = 0 then 'zero' when known then 'known' when row_number() over (partition by n.account_id, n.operation_date, n.amount, n.payment_reference, n.description order by line_id) > 1 then 'repeated' else 'imported' end as outcome
 from n left join k on k.account_id = n.account_id and k.operation_date = n.operation_date and k.amount = n.amount and k.payment_reference = n.payment_reference and k.description = n.description""")
def x1_import_dedupe(spark, sf_dir):
    new, existing = _import(spark, sf_dir)
    return A.import_dedupe(new, existing, "line_id").select("line_id", "outcome")


@query("select line_id, case when line_id % 3 = 0 then 'new' when line_id % 7 = 0 then 'conflict' else 'same' end as outcome from lines")
def x2_occurrence_dedupe(spark, sf_dir):
    l = W.lines(spark, sf_dir).select("line_id", "account_id", "amount")  # noqa: E741
    old = l.where("line_id % 3 <> 0").withColumn("amount", F.when(F.col("line_id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(W.MONEY))
    return A.occurrence_dedupe(l, old, "line_id", ["account_id", "amount"]).select("line_id", "outcome")


@query("""with s as (select distinct statement_id, min(operation_date) over (partition by statement_id) as day, 'extract_' || (statement_id % 3) || '.csv' as filename from lines),
 b as (select statement_id, substr('KB-' || strftime(day, '%Y%m%d') || '-' || upper(regexp_replace(filename, '[^A-Za-z0-9]', '', 'g')), 1, 24) as base from s),
 n as (select *, row_number() over (partition by base order by statement_id) as n from b) select statement_id, case when n = 1 then base else base || '-' || n end as ref from n""")
def x3_statement_refs(spark, sf_dir):
    s = W.lines(spark, sf_dir).groupBy("statement_id").agg(F.min("operation_date").alias("day"))
    s = s.withColumn("filename", F.concat(F.lit("extract_"), (F.col("statement_id") % 3).cast("string"), F.lit(".csv")))
    return A.statement_refs(s).select("statement_id", "ref")


@query("select line_id, count(*) as n from (select line_id from lines union all select line_id from lines where line_id % 900 = 10) group by 1 having count(*) > 1")
def x4_repeated_identities(spark, sf_dir):
    l = W.lines(spark, sf_dir).select("line_id")  # noqa: E741
    return A.repeated_identities(l.unionByName(l.where("line_id % 900 = 10")), "line_id")


@query("""with v as (select 'orphan_links' as what, count(*) filter (linked_ledger_id is not null and linked_ledger_id not in (select ledger_id from ledger)) as n from lines
 union all select 'orphan_accounts', count(*) filter (account_id not in (select account_id from accounts)) from lines
 union all select 'account_mismatches', count(*) from lines l join ledger g on g.ledger_id = linked_ledger_id and g.account_id <> l.account_id) select what, n, n = 0 as ok from v""")
def k1_diagnostics(spark, sf_dir):
    return A.diagnostics(W.lines(spark, sf_dir), W.ledger(spark, sf_dir), W.accounts(spark, sf_dir))


@query("select line_id from lines l join accounts a using (account_id) left join openings o using (account_id) where closed or not reconcilable or coalesce(operation_date < start_date, false)")
def k2_scope_violations(spark, sf_dir):
    return S.scope_violations(W.lines(spark, sf_dir), W.accounts(spark, sf_dir), W.openings(spark, sf_dir)).select("line_id")


@query("select event_id from events where event_id % 50 = 3", base=False)
def k3_feed_evidence(spark, sf_dir):
    """Feed rows whose stored hash no longer follows from their facts: every fiftieth was tampered with."""
    e = W.table(spark, sf_dir, "events")
    stored = V.financial_hash(F.col("value") + F.when(F.col("event_id") % 50 == 3, 1).otherwise(0), F.col("ts").cast("date"), F.lit("EUR"))
    now = V.financial_hash("value", F.col("ts").cast("date"), F.lit("EUR"))
    return A.hash_mismatches(e, "event_id", stored, now)


@query("select line_id, case when line_id % 11 = 0 then 'removed' else 'changed' end as change from lines where line_id % 11 = 0 or line_id % 13 = 0 union all select -line_id, 'added' from lines where line_id % 17 = 0")
def k5_fingerprint_diff(spark, sf_dir):
    old = W.lines(spark, sf_dir).select("line_id", "amount", "description")
    new = old.where("line_id % 11 <> 0").withColumn("amount", F.when(F.col("line_id") % 13 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(W.MONEY))
    new = new.unionByName(old.where("line_id % 17 = 0").withColumn("line_id", -F.col("line_id")))
    return A.fingerprint_diff(old, new, "line_id", ["amount", "description"])


@query("select event_id, cast(ts as date) >= date '2024-01-15' as keep from events", base=False)
def k6_retention_split(spark, sf_dir):
    return W.table(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("date") >= "2024-01-15").alias("keep"))


@query("select event_type, count(*) as n, cast(sum(coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)) as bigint) as total from events group by 1", base=False)
def k7_payload_summary(spark, sf_dir):
    e = W.table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return A.payload_summary(e, "event_type", "k")


OUTCOME = f"""{SCORED}, m as (select line_id, doc_id as ledger_id, score from ranks where rank = 1),
 o as (select m.*, case when g.reconciled then 'reconciled' when abs(l.amount - g.amount) > 0.001 then 'amount' end as reason from m join lines l using (line_id) join ledger g using (ledger_id)),
 p as (select *, row_number() over (partition by ledger_id order by reason is not null, score desc, line_id) as k from o),
 outcomes as (select line_id, ledger_id, case when reason is null and k > 1 then 'claimed' else coalesce(reason, 'applied') end as outcome from p)"""


def outcomes(spark, sf_dir):
    top = J.ranked(scored(spark, sf_dir)).where("rank = 1").select("line_id", F.col("doc_id").alias("ledger_id"), "score")
    return A.apply_matches(W.lines(spark, sf_dir), W.ledger(spark, sf_dir), top)


@query(f"with {OUTCOME} select line_id, ledger_id, outcome from outcomes")
def t1_apply_matches(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query(f"with {OUTCOME} select l.line_id, case when outcome = 'applied' then 2 else status end as status, case when outcome = 'applied' then ledger_id else linked_ledger_id end as linked_ledger_id from lines l left join outcomes o on o.line_id = l.line_id and outcome = 'applied'")
def t1_lines_after(spark, sf_dir):
    return A.matched_lines(W.lines(spark, sf_dir), outcomes(spark, sf_dir)).select("line_id", "status", "linked_ledger_id")


@query("select line_id, case when u then 0 else status end as status, case when not u then linked_ledger_id end as linked_ledger_id from (select l.*, l.line_id % 30 = 0 and coalesce(operation_date >= start_date, true) as u from lines l left join openings using (account_id))")
def t2_undo_matches(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    old = S.historical(l, W.openings(spark, sf_dir), "operation_date").where("historical")
    return A.undo_matches(l, l.where("line_id % 30 = 0"), old).select("line_id", "status", "linked_ledger_id")


@query("select statement_id, count(*) as lines, case when bool_or(status = 2) then 'blocked' else 'deleted' end as outcome from lines where statement_id % 4 = 0 group by 1")
def t4_delete_statements(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    return A.delete_statements(l, l.where("statement_id % 4 = 0").select("statement_id").distinct())


@query("select line_id, case when line_id % 6 = 0 and status < 2 then 3 else status end as status from lines")
def t5_skip_lines(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    return S.skip_lines(l, l.where("line_id % 6 = 0")).select("line_id", "status")


@query("select ledger_id, not reconciled and ledger_id not in (select linked_ledger_id from lines where linked_ledger_id is not null) as movable from ledger")
def t6_movable(spark, sf_dir):
    return S.movable(W.ledger(spark, sf_dir), W.lines(spark, sf_dir)).select("ledger_id", "movable")


@query("""select -line_id as ledger_id, account_id, operation_date as booking_date, amount, case when amount < 0 then 'DEB' else 'CRE' end as operation, case when payment_reference <> '' then payment_reference else description end as label
 from lines l where status < 2 and linked_ledger_id is null and not exists (select 1 from ledger g where g.account_id = l.account_id and g.amount = l.amount and abs(date_diff('day', operation_date, booking_date)) <= 3)""")
def t7_materialize_lines(spark, sf_dir):
    l, g = W.lines(spark, sf_dir), W.ledger(spark, sf_dir)  # noqa: E741
    return A.materialize(l, J.existing_movement(l, g, 3))
