"""Queries of audit history, enrichment, closest subsets and late suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import learning as L
from ..operators import rules as R
from ..operators import selection as S
from ..operators import summaries as A
from ..operators.subsets import closest_subset
from . import views as W
from .registry import query

M = W.MONEY


@query("""with a as (select line_id * 10 + k as audit_id, line_id, case when k = 2 then -1 else linked_ledger_id end as ledger_id, cast(operation_date + k as date) as day from lines, (values (0), (1), (2)) t(k))
 select line_id, max_by(audit_id, day) as audit_id from a join lines using (line_id) where ledger_id = linked_ledger_id group by 1""")
def v10_latest_audit(spark, sf_dir):
    """Three audit rows a line; the newest names another ledger row and so does not count."""
    l = W.lines(spark, sf_dir)  # noqa: E741
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    audit = l.withColumn("k", k).select("line_id", (F.col("line_id") * 10 + F.col("k")).alias("audit_id"), F.when(F.col("k") == 2, -1).otherwise(F.col("linked_ledger_id")).alias("ledger_id"), F.date_add("operation_date", F.col("k")).alias("at"))
    return H.latest_audit(l, audit)


@query("""with p as (select o_orderkey as ledger_id, o_custkey + case when o_orderkey % 10 = 0 then k else 0 end as party_id, cast(o_totalprice as decimal(18,2)) * case when k = 0 then 0.25 else 0.75 end as paid from orders, (values (0), (1)) t(k) where o_orderstatus <> 'F')
 select g.ledger_id, min(p.party_id) as party_id, count(*) as n from ledger g join p using (ledger_id) group by g.ledger_id, amount having min(p.party_id) = max(p.party_id) and sum(cast(paid as decimal(18,4))) = amount""")
def j16_transfer_enrichment(spark, sf_dir):
    """Each receipt is allocated in a quarter and three quarters, to two parties for every tenth."""
    o = W.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    quarter = (F.col("o_totalprice").cast(M) * F.lit("0.25").cast("decimal(4,2)")).cast("decimal(20,4)")
    paid = F.when(F.col("k") == 0, quarter).otherwise(F.col("o_totalprice").cast("decimal(20,4)") - quarter)
    p = o.select(F.col("o_orderkey").cast("long").alias("ledger_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, F.col("k")).otherwise(0)).alias("party_id"), paid.alias("paid"))
    return H.enrich_transfers(W.ledger(spark, sf_dir), p, "ledger_id")


@query("""with n as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as k, cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) as c from lineitem),
 f as (select distinct l_orderkey from n), t as (select l_orderkey, sum(c) // 2 as goal from n group by 1),
 s as (select * from (with recursive s(l_orderkey, last, total) as (select l_orderkey, 0::bigint, 0::bigint from f union all select s.l_orderkey, n.k, total + c from s join n on n.l_orderkey = s.l_orderkey and n.k > s.last) select l_orderkey, total from s)),
 r as (select s.l_orderkey, total, goal, row_number() over (partition by s.l_orderkey order by abs(total - goal), total desc) as k from s join t using (l_orderkey))
 select l_orderkey, cast(total / 100.0 as decimal(18,2)) as sum, case when total = goal then 'exact' else 'nearest' end as status from r where k = 1""", base=False)
def j28_closest_subset(spark, sf_dir):
    li = W.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast(M).alias("amount"))
    targets = li.groupBy("l_orderkey").agg((F.floor(F.sum((F.col("amount") * 100).cast("long")) / 2) / 100).cast(M).alias("target"))
    return closest_subset(targets, li, "l_orderkey")


@query("""with m as (select line_id, count(*) as documents, cast(sum(cast(abs(g.amount) * 100 as bigint)) * 100 // max(cast(abs(l.amount) * 100 as bigint)) as bigint) as coverage from lines l join ledger g on g.account_id = l.account_id and g.booking_date = l.operation_date and sign(g.amount) = sign(l.amount) and abs(g.amount) <= abs(l.amount) group by 1)
 select line_id, case when contains(lower(description), 'cartao') then 'keyword' when line_id % 130 = 0 then 'model' when coalesce(documents, 0) >= 4 and coalesce(coverage, 0) >= 90 then 'coverage' end as reason from lines left join m using (line_id)""")
def j27_detect_batch_line(spark, sf_dir):
    """Every thirteenth line is one that the model calls a batch."""
    l = W.lines(spark, sf_dir)  # noqa: E741
    predicted = l.where("line_id % 130 = 0").select(F.col("line_id").alias("id"), F.lit(True).alias("is_batch"))
    return H.batch_reason(l, A.candidate_metrics(l, W.ledger(spark, sf_dir)), F.contains(F.lower("description"), F.lit("cartao")), predicted)


@query("select line_id, ledger_id as invoice_id from lines l join ledger g on g.amount = l.amount and contains(l.description, g.counterparty)")
def d20_draft_invoices(spark, sf_dir):
    drafts = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("invoice_id"), F.col("amount").alias("total"), F.col("counterparty").alias("party"))
    return H.draft_invoices(W.lines(spark, sf_dir), drafts)


@query("select o_orderkey from orders where o_orderpriority <> '5-LOW' and o_totalprice > 0.0000001", base=False)
def d19_credit_exclusion(spark, sf_dir):
    """Low-priority orders stand for credit notes."""
    kind = F.when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(0)
    return S.payable_invoices(W.table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.col("o_totalprice").alias("open_amount"))).select("o_orderkey")


@query("select event_id, event_type from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20' and event_type in ('click', 'purchase') and contains(props, '1')", base=False)
def d18_audit_filters(spark, sf_dir):
    e = W.table(spark, sf_dir, "events")
    return e.where(F.col("ts").cast("date").between("2024-01-05", "2024-01-20") & F.col("event_type").isin("click", "purchase") & F.contains("props", F.lit("1"))).select("event_id", "event_type")


@query("""select c_custkey as rule_id, case c_custkey % 13 when 0 then 'conditions' when 1 then 'conditions' when 2 then 'operator' when 3 then 'value' when 4 then 'interval' when 5 then 'iban' when 6 then 'currency' when 7 then 'regex' when 8 then 'action' when 9 then 'action' end as problem from customer""", base=False)
def b1_validate_rules(spark, sf_dir):
    """A rule a customer, most with one flaw: no or too many conditions, operator, value, interval, IBAN, currency, pattern, action."""
    c = W.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), (F.col("c_custkey") % 13).cast("int").alias("k"))
    k = F.col("k")
    pick = lambda rest, **by: F.coalesce(*[F.when(k == int(n[1:]), F.lit(v)) for n, v in by.items()], F.lit(rest))
    one = F.struct(F.lit("all").alias("side"), pick("description", k3="description", k4="amount", k5="counterparty_iban", k6="currency").alias("field"), pick("contains", k2="between", k4="between", k5="equals", k6="equals", k7="regex").alias("operator"),
                   pick("abc", k3="", k4="9", k5="PT50000201231234567890155", k6="euro", k7="a(?=b)").alias("value"), pick("", k4="1").alias("max"))
    rows = c.where("k <> 0").select("rule_id", F.explode(F.when(k == 1, F.array_repeat(one, 13)).otherwise(F.array(one))).alias("c")).select("rule_id", "c.*")
    actions = c.select("rule_id", F.when(k == 8, "unknown").when(k % 2 == 0, "category").otherwise("invoice_search").alias("type"), F.when(k != 9, 5).alias("party_id"), F.lit("customer_invoice").alias("invoice_type"), F.lit(3).alias("category_id"), *(F.lit(None).cast("string").alias(x) for x in ("account", "payment_mode", "label")), F.lit(None).cast("decimal(5,2)").alias("vat"))
    return R.validate_rules(rows, actions)


@query("select account_id, line_id from (select account_id, line_id, row_number() over (partition by account_id order by operation_date desc, line_id) as k from lines where status = 2 and linked_ledger_id is not null and line_id % 4 <> 1) where k <= 20")
def l2_batch_labels(spark, sf_dir):
    """The newest labelled samples of each account, from manual approvals only."""
    rows = W.lines(spark, sf_dir).where("status = 2 and linked_ledger_id is not null and line_id % 4 <> 1")
    return A.top_k(rows, ["account_id"], [F.desc("operation_date"), F.asc("line_id")], 20).select("account_id", "line_id")


@query("select linked_ledger_id as ledger_id, min(party_id) as party_id from lines l join ledger g on g.ledger_id = linked_ledger_id where l.amount < 0 group by 1 having count(distinct party_id) = 1")
def l9_supplier_training(spark, sf_dir):
    party = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("linked_ledger_id"), "party_id")
    rows = W.lines(spark, sf_dir).where("amount < 0").join(party, "linked_ledger_id").select(F.col("linked_ledger_id").alias("ledger_id"), "party_id")
    return A.single_party(rows, "ledger_id", "party_id").select("ledger_id", "party_id")


def _predicted(spark, sf_dir, kind):
    from pyspark.ml.feature import VectorAssembler

    from .learning import featured

    rows = L.holdout(featured(spark, sf_dir), "operation_date", "id")
    v = VectorAssembler(inputCols=list(L.FEATURES), outputCol="features").transform(rows)
    model = L.fit_classifier(kind, v.where("part = 'train'"))
    test = v.where("part = 'test'")
    return test.select("id", "label", F.lit(None).cast("int").alias("predicted")) if model is None else model.transform(test).select("id", "label", F.col("prediction").cast("int").alias("predicted"))


@query(None)
def l4_batch_forest(spark, sf_dir):
    """Random forest of 31 trees over the batch features; predictions of the held-out lines."""
    return _predicted(spark, sf_dir, "random_forest")


@query(None)
def l4_batch_tree(spark, sf_dir):
    return _predicted(spark, sf_dir, "decision_tree")


@query(None)
def l4_batch_bayes(spark, sf_dir):
    return _predicted(spark, sf_dir, "naive_bayes")
