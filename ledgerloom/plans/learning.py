"""Queries of rules and learned advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import rules as R
from . import views as W
from .registry import query

RULES = [
    {"id": 1, "priority": 2, "all": [{"field": "description", "operator": "contains", "value": "cartao"}]},
    {"id": 2, "priority": 1, "all": [{"field": "amount", "operator": "between", "value": "1000", "max": "50000"}, {"field": "description", "operator": "not_contains", "value": "cartao"}]},
    {"id": 3, "priority": 1, "any": [{"field": "description", "operator": "regex", "value": "^trf.*0{4}[0-9]+$"}, {"field": "counterparty_name", "operator": "contains", "value": "#00000001"}], "direction": -1},
    {"id": 4, "priority": 0, "all": [{"field": "amount", "operator": "regex", "value": "1"}]},
    {"id": 5, "priority": 3, "all": [{"field": "amount", "operator": "between", "value": "100000", "max": "900000"}], "account_id": 5},
]
HITS = """hits as (select line_id, operation_date, list_filter([
  case when amount between 1000 and 50000 and not contains(lower(description), 'cartao') then 2 end,
  case when (regexp_matches(description, '(?i)^trf.*0{4}[0-9]+$') or contains(lower(counterparty_name), '#00000001')) and amount < 0 then 3 end,
  case when contains(lower(description), 'cartao') then 1 end, case when amount between 100000 and 900000 and account_id = 5 then 5 end], lambda x: x is not null) as h from lines)"""


@query(f"with {HITS} select line_id, h[1] as rule_id, cast(len(h) as int) as matching from hits")
def b2_evaluate_rules(spark, sf_dir):
    return R.evaluate(W.lines(spark, sf_dir), RULES).select("line_id", "rule_id", "matching")


@query(f"with {HITS} select line_id from hits where list_contains(h, 2) and operation_date between date '1998-05-01' - 90 and date '1998-05-01'")
def b3_rule_preview(spark, sf_dir):
    recent = F.col("operation_date").between(F.date_sub(F.lit("1998-05-01").cast("date"), 90), F.lit("1998-05-01").cast("date"))
    return W.lines(spark, sf_dir).where(recent & R.condition(RULES[1])).select("line_id")


@query(f"with {HITS} select h[1] as rule_id, count(*) as hits, max(hits.operation_date) as last_used from hits join lines using (line_id) where status = 2 and len(h) > 0 group by 1")
def b4_rule_usage(spark, sf_dir):
    return R.usage(R.evaluate(W.lines(spark, sf_dir).where("status = 2"), RULES))


@query("""with p as (select account_id as restricted, case when account_id % 6 = 1 then account_id when account_id % 6 = 2 then account_id + 1 when account_id = 9 then 25 else 4 end as main from accounts where account_id % 3 <> 0 or account_id = 9)
 select restricted, case when restricted = main then 'self' when restricted in (select main from p) then 'chain' else 'account' end as problem from p where restricted = main or restricted in (select main from p) or main not in (select account_id from accounts where not closed)""")
def b6_account_pair_policy(spark, sf_dir):
    a = F.col("account_id")
    pairs = W.accounts(spark, sf_dir).where("account_id % 3 <> 0 or account_id = 9").select(a.alias("restricted"), F.when(a % 6 == 1, a).when(a % 6 == 2, a + 1).when(a == 9, 25).otherwise(4).cast("long").alias("main"))
    return R.pair_problems(pairs, W.accounts(spark, sf_dir))


FEATURED = """featured as (select line_id as id, account_id, operation_date, status, cast(contains(lower(description), 'cartao') as int)::double as f1, least(1, (line_id % 50) / 40.0)::double as f2, least(1, (line_id % 400) / 250.0)::double as f3,
 least(1, log10(1 + abs(amount)::double) / 6) as f4, least(1, length(description) / 140.0)::double as f5, cast(amount > 0 as int)::double as f6, cast(line_id % 7 = 0 as int) as label from lines)"""


def featured(spark, sf_dir):
    rows = W.lines(spark, sf_dir).withColumns({"keyword": F.contains(F.lower("description"), F.lit("cartao")), "documents": F.col("line_id") % 50, "coverage": F.col("line_id") % 400})
    return L.batch_features(rows).withColumn("id", F.col("line_id")).withColumn("label", (F.col("line_id") % 7 == 0).cast("int"))


@query(f"with {FEATURED} select id, round(f1, 6) as f1, round(f2, 6) as f2, round(f3, 6) as f3, round(f4, 6) as f4, round(f5, 6) as f5, round(f6, 6) as f6 from featured")
def l1_batch_features(spark, sf_dir):
    return featured(spark, sf_dir).select("id", *[F.round(c, 6).alias(c) for c in L.FEATURES])


@query(f"with {FEATURED} select id from (select *, row_number() over (partition by label order by operation_date desc, id desc) as k from featured) where k <= 2 * (select min(n) from (select count(*) as n from featured group by label))")
def l3_rebalance(spark, sf_dir):
    return L.rebalance(featured(spark, sf_dir), "label", "operation_date", [F.desc("id")], 2).select("id")


KNN = f"""{FEATURED}, q as (select * from featured where id % 100 = 0), s as (select *, greatest(3, least(31, floor(sqrt(n)) - case when floor(sqrt(n)) % 2 = 0 then 1 else 0 end)) as kk from (select *, count(*) over (partition by account_id) as n from (select *, row_number() over (partition by account_id order by operation_date desc, id desc) as newest from featured where status = 2) where newest <= 5000)),
 d as (select q.id, s.label, kk, round(sqrt((q.f1-s.f1)**2 + (q.f2-s.f2)**2 + (q.f3-s.f3)**2 + (q.f4-s.f4)**2 + (q.f5-s.f5)**2 + (q.f6-s.f6)**2), 9) as d from q join s using (account_id)),
 r as (select *, rank() over (partition by id order by d) as k from d), near as (select id, sum(label / (1 + d)) / sum(1 / (1 + d)) as p, count(*) as neighbours from r where k <= kk group by id)"""


@query(f"with {KNN} select id, round(p, 6) as p, neighbours from near")
def l5_knn_probability(spark, sf_dir):
    """Queries are the lines with ids divisible by 100, against the newest reconciled lines of their account."""
    f = featured(spark, sf_dir)
    return L.nearest(f.where("id % 100 = 0"), f.where("status = 2"), ["account_id"], [F.desc("operation_date"), F.desc("id")]).select("id", F.round("p", 6).alias("p"), "neighbours")


@query(f"with {KNN} select id, round(p, 6) as p, p >= 0.6 as is_batch from near")
def l6_predict_batch(spark, sf_dir):
    f = featured(spark, sf_dir)
    return L.predict_batch(f.where("id % 100 = 0"), f.where("status = 2"), ["account_id"], [F.desc("operation_date"), F.desc("id")], 60).select("id", F.round("p", 6).alias("p"), "is_batch")


@query("""with w as (select line_id, amount, counterparty_name, string_split(regexp_replace(lower(counterparty_name || ' ' || description || ' ' || payment_reference), '[^a-z0-9]+', ' ', 'g'), ' ') as t from lines)
 select line_id, round(least(1, log10(1 + abs(amount)::double) / 6), 6) as s1, cast(amount < 0 as int)::double as s2, 0::double as s3, round(least(1, length(trim(counterparty_name)) / 80.0), 6)::double as s4, cast(len(list_filter(t, lambda x: length(x) >= 2)) as int) as tokens, 1.0::double as total from w""")
def l8_supplier_features(spark, sf_dir):
    """The bins themselves are tested against plain code: SQL has no CRC-32 here; their shares sum to one."""
    rows = L.supplier_features(W.lines(spark, sf_dir).withColumn("counterparty_iban", F.lit("")))
    return rows.select("line_id", F.round("s1", 6).alias("s1"), "s2", "s3", F.round("s4", 6).alias("s4"), "tokens", F.round(F.aggregate("bins", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {FEATURED}, r as (select *, row_number() over (order by operation_date desc, id desc) as k, count(*) over () as n from featured) select id, case when k <= floor(n * 20 / 100) then 'test' else 'train' end as part from r")
def l7_holdout(spark, sf_dir):
    return L.holdout(featured(spark, sf_dir), "operation_date", "id").select("id", "part")


@query(f"""with {FEATURED}, j as (select label, case when f1 = 1 or f2 > 0.9 then 1 else 0 end as predicted from featured),
 t as (select count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 0 and predicted = 1) as fp, count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 0 and predicted = 0) as tn from j)
 select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy, greatest(tp + fn, tn + fp) / (tp + fp + fn + tn) as majority from t""")
def l7_validation_metrics(spark, sf_dir):
    return L.metrics(featured(spark, sf_dir).select("label", F.when((F.col("f1") == 1) | (F.col("f2") > 0.9), 1).otherwise(0).alias("predicted")))


@query("select account_id, max_by(line_id, line_id * 7919 % 100003) as line_id from lines where status = 2 group by 1")
def v11_newest_sample(spark, sf_dir):
    rows = W.lines(spark, sf_dir).where("status = 2").withColumn("h", F.col("line_id") * 7919 % 100003)
    return L.newest_per(rows, "account_id", [F.desc("h"), "line_id"]).select("account_id", "line_id")  # of equal ones the first, as max_by keeps it


@query("""with a as (select description, party_id, operation_date from lines l join ledger g on g.ledger_id = linked_ledger_id where status = 2 and length(description) between 8 and 120)
 select description, party_id, count(*) as hits, max(operation_date) as last_used from a group by 1, 2 order by hits desc, last_used desc, description, party_id limit 500""")
def l11_learn_patterns(spark, sf_dir):
    party = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("linked_ledger_id"), "party_id")
    return L.learn_patterns(W.lines(spark, sf_dir).where("status = 2").join(party, "linked_ledger_id"), 500)


@query("""with v as (select l_partkey as key, l_suppkey as party_id, count(*) as votes from lineitem group by 1, 2),
 r as (select *, sum(votes) over (partition by key) as total, row_number() over (partition by key order by votes desc, party_id) as k, lead(votes) over (partition by key order by votes desc, party_id) as second from v)
 select key, case when votes >= 3 and votes * 100 / total >= 10 and (votes - coalesce(second, 0)) * 100 / total >= 3 then party_id end as party_id, votes, cast(total as bigint) as total from r where k = 1""", base=False)
def l10_predict_supplier(spark, sf_dir):
    rows = W.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("party_id"))
    return L.party_votes(rows, 3, 10, 3)
