"""Queries of candidate documents and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import selection as S
from ..operators.subsets import subset_sums
from . import views as W
from .registry import query

MONEY = W.MONEY
PAYMENTS = """payments as (
  select cast(l_orderkey * 10 + l_linenumber as bigint) as payment_id, cast(l_orderkey as bigint) as invoice_id, cast(l_extendedprice as decimal(18,2)) as amount,
         cast(l_shipdate as date) as payment_date, l_linenumber % 4 = 1 as banked, cast(l_suppkey as bigint) as supplier_id from lineitem where l_linenumber % 2 = 1)"""
INVOICES = """invoices as (
  select cast(o_orderkey as bigint) as invoice_id, cast(o_custkey as bigint) as party_id, cast(o_totalprice as decimal(18,2)) as total, cast(o_orderdate as date) as invoice_date,
         'FT-' || lpad(cast(o_orderkey as varchar(20)), 8, '0') as ref from orders)"""


def payments(spark, sf_dir):
    return W.table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("payment_id"), F.col("l_orderkey").cast("long").alias("invoice_id"), F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").cast("date").alias("payment_date"), (F.col("l_linenumber") % 4 == 1).alias("banked"), F.col("l_suppkey").cast("long").alias("supplier_id"))


def invoices(spark, sf_dir):
    return W.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("invoice_id"), F.col("o_custkey").cast("long").alias("party_id"), F.col("o_totalprice").cast(MONEY).alias("total"),
        F.col("o_orderdate").cast("date").alias("invoice_date"), F.concat(F.lit("FT-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("ref"))


@query("select line_id, l.account_id, entity, label, g.amount as ledger_amount from lines l join accounts a using (account_id) left join ledger g on g.ledger_id = l.linked_ledger_id")
def j1_line_account_ledger(spark, sf_dir):
    g = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("linked_ledger_id"), F.col("amount").alias("ledger_amount"))
    return W.lines(spark, sf_dir).join(W.accounts(spark, sf_dir), "account_id").transform(M.by_link, g).select("line_id", "account_id", "entity", "label", "ledger_amount")


@query("select ledger_id, account_id, amount from ledger g left join openings o using (account_id) where not reconciled and coalesce(booking_date >= start_date, true) and not exists (select 1 from lines l where l.linked_ledger_id = g.ledger_id) and not exists (select 1 from orders where o_orderkey = g.ledger_id and o_orderpriority = '1-URGENT')")
def j2_open_ledger_candidates(spark, sf_dir):
    """Urgent orders stand for members of active batches."""
    members = W.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("ledger_id"))
    rows = M.unclaimed(W.ledger(spark, sf_dir), W.lines(spark, sf_dir), members)
    return S.historical(rows, W.openings(spark, sf_dir), "booking_date").where(~F.col("historical")).select("ledger_id", "account_id", "amount")


@query(f"with {PAYMENTS}, {INVOICES} select p.invoice_id, cast(sum(p.amount) as decimal(18,2)) as amount, count(*)::bigint as n, string_agg(distinct i.ref, ',' order by i.ref) as refs from payments p join invoices i using (invoice_id) where not banked and p.amount <> 0 and payment_date between date '1996-01-01' and date '1996-12-31' group by 1")
def j3_open_payments(spark, sf_dir):
    rows = payments(spark, sf_dir).where(~F.col("banked") & (F.col("amount") != 0) & F.col("payment_date").between("1996-01-01", "1996-12-31"))
    joined = rows.join(invoices(spark, sf_dir).select("invoice_id", "ref"), "invoice_id")
    return joined.groupBy("invoice_id").agg(F.sum("amount").cast(MONEY).alias("amount"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))


@query(f"with {PAYMENTS} select payment_id, ledger_id, g.reconciled as locked from payments p join ledger g on g.ledger_id = p.invoice_id where banked")
def j4_linked_payments(spark, sf_dir):
    g = W.ledger(spark, sf_dir).select(F.col("ledger_id").alias("invoice_id"), F.col("reconciled").alias("locked"))
    return payments(spark, sf_dir).where("banked").join(g, "invoice_id").select("payment_id", F.col("invoice_id").alias("ledger_id"), "locked")


OPEN = "open_invoices as (select i.*, cast(total - coalesce(paid, 0) as decimal(18,2)) as open_amount from invoices i left join (select invoice_id, sum(amount) as paid from payments group by 1) using (invoice_id))"


@query(f"with {PAYMENTS}, {INVOICES}, {OPEN} select invoice_id, open_amount from open_invoices where open_amount > 0")
def j5_open_invoices(spark, sf_dir):
    return M.open_amounts(invoices(spark, sf_dir), payments(spark, sf_dir), "invoice_id", "total", "amount").where("open_amount > 0").select("invoice_id", "open_amount")


@query("""select s_suppkey, cast(cast(s_acctbal as decimal(18,2)) - coalesce(paid, 0) as decimal(18,2)) as remaining from supplier left join
 (select l_suppkey, sum(cast(l_tax as decimal(18,2))) as paid from lineitem group by 1) on l_suppkey = s_suppkey where cast(s_acctbal as decimal(18,2)) - coalesce(paid, 0) > 0""", base=False)
def j6_obligations(spark, sf_dir):
    parents = W.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast(MONEY).alias("total"))
    children = W.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_tax").cast(MONEY).alias("paid"))
    return M.open_amounts(parents, children, "s_suppkey", "total", "paid").where("open_amount > 0").select("s_suppkey", F.col("open_amount").alias("remaining"))


@query(f"with {PAYMENTS}, {INVOICES} select 'bank' as family, ledger_id as doc_id, amount from ledger where not reconciled union all select 'invoice', invoice_id, total from invoices union all select 'bank', invoice_id, sum(amount)::decimal(18,2) from payments where not exists (select 1 from ledger where ledger_id = invoice_id and not reconciled) group by invoice_id")
def j7_candidate_union(spark, sf_dir):
    bank = W.ledger(spark, sf_dir).where("not reconciled").select(F.lit("bank").alias("family"), F.col("ledger_id").alias("doc_id"), "amount")
    bills = invoices(spark, sf_dir).select(F.lit("invoice").alias("family"), F.col("invoice_id").alias("doc_id"), F.col("total").alias("amount"))
    linked = payments(spark, sf_dir).groupBy("invoice_id").agg(F.sum("amount").cast(MONEY).alias("amount")).select(F.lit("bank").alias("family"), F.col("invoice_id").alias("doc_id"), "amount")
    return M.candidate_union(bank, bills, linked)


@query("""with items as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) as cents from lineitem),
 targets as (select l_orderkey, sum(cents) filter (l_linenumber % 2 = 1) as target from items group by 1),
 may as (select i.* from items i join targets using (l_orderkey) where cents < target), sized as (select l_orderkey, count(*) as n, sum(cents) as total from may group by 1),
 sets as (select * from (with recursive s(l_orderkey, last, n, total, ids) as (
   select l_orderkey, l_linenumber, 1, cents, cast(l_linenumber as varchar) from may
   union all select s.l_orderkey, i.l_linenumber, n + 1, total + cents, ids || ',' || i.l_linenumber from s join may i on i.l_orderkey = s.l_orderkey and i.l_linenumber > s.last) select * from s)),
 hits as (select t.l_orderkey, count(s.n) as n, min(ids) as ids from targets t left join sets s on s.l_orderkey = t.l_orderkey and s.n >= 2 and s.total = t.target group by 1)
 select l_orderkey, case when n = 1 then 'unique' when n > 1 then 'ambiguous' else 'none' end as status, case when n = 1 then ids end as ids from hits""", base=False)
def j8_batch_suggest(spark, sf_dir):
    """Lines of an order are the bank rows of a day, the sum of its odd lines is the statement line."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    rows = W.table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("id"), F.col("l_extendedprice").cast(MONEY).alias("amount"))
    targets = rows.groupBy("l_orderkey").agg(F.sum(F.when(F.col("id") % 2 == 1, F.col("amount"))).alias("target"))
    return subset_sums(targets, rows, "l_orderkey").select("l_orderkey", "status", F.array_join("ids", ",").alias("ids"))


@query("""with m as (select line_id, account_id, operation_date, amount from lines union all
   select -line_id, account_id % 25 + 1, cast(operation_date + cast(line_id % 3 - 1 as int) as date), cast(-amount as decimal(18,2)) from lines where line_id % 7 = 0),
 p as (select a.line_id as out_id, b.line_id as in_id, b.amount from m a join m b on b.amount = -a.amount and a.amount < 0 and a.account_id <> b.account_id and abs(date_diff('day', a.operation_date, b.operation_date)) <= 3)
 select out_id, in_id, amount from p where (select count(*) from p q where q.out_id = p.out_id) = 1 and (select count(*) from p q where q.in_id = p.in_id) = 1""")
def j11_own_transfers(spark, sf_dir):
    """Every seventh line gets a mirror on the next account; pairs unique on both sides are transfers."""
    l = W.lines(spark, sf_dir).select("line_id", "account_id", "operation_date", "amount")  # noqa: E741
    mirror = l.where("line_id % 7 = 0").select((-F.col("line_id")).alias("line_id"), (F.col("account_id") % 25 + 1).alias("account_id"), F.date_add("operation_date", (F.col("line_id") % 3 - 1).cast("int")).alias("operation_date"), (-F.col("amount")).cast(MONEY).alias("amount"))
    pairs = M.opposite_pairs(l.unionByName(mirror), 3)
    return M.mutual_unique(pairs, "out_id", "in_id").select("out_id", "in_id", "amount")


@query("""with moved as (select line_id, case when line_id % 110 = 0 then account_id % 25 + 1 else account_id end as account_id, operation_date, amount from lines where status = 0)
 select l.line_id, g.ledger_id from moved l join ledger g on g.amount = l.amount and g.account_id <> l.account_id and abs(date_diff('day', operation_date, booking_date)) <= 30
 where not exists (select 1 from ledger h where h.account_id = l.account_id and h.amount = l.amount and abs(date_diff('day', operation_date, h.booking_date)) <= 30)""")
def j12_wrong_account_review(spark, sf_dir):
    """Every eleventh order's line was imported into the next account."""
    moved = F.when(F.col("line_id") % 110 == 0, F.col("account_id") % 25 + 1).otherwise(F.col("account_id"))
    l, g = W.lines(spark, sf_dir).where("status = 0").withColumn("account_id", moved), W.ledger(spark, sf_dir)  # noqa: E741
    return M.wrong_account(l, g, 30).select("line_id", "ledger_id")


@query("""with req as (select s_suppkey as request_id, s_nationkey as vat, upper(s_name) as name from supplier), 
 hit as (select request_id, 1 as tier, c_custkey as party_id from req join customer on c_nationkey = vat and c_custkey % 40 = request_id % 40 and c_acctbal > 5000
   union all select request_id, 2, s_suppkey from req join supplier on upper(s_name) = name),
 first as (select request_id, tier, count(distinct party_id) as n, min(party_id) as party_id, row_number() over (partition by request_id order by tier) as k from hit group by 1, 2)
 select r.request_id, case when tier is null then 'none' when n > 1 then 'ambiguous' else 'unique' end as status, case when n = 1 then party_id end as party_id, tier from req r left join first f on f.request_id = r.request_id and k = 1""", base=False)
def j13_party_resolution(spark, sf_dir):
    s, c = W.table(spark, sf_dir, "supplier"), W.table(spark, sf_dir, "customer")
    req = s.select(F.col("s_suppkey").alias("request_id"), F.col("s_nationkey").alias("vat"), F.upper("s_name").alias("name"))
    rich = M.parties_by(c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("vat"), (F.col("c_custkey") % 40).alias("part"), F.col("c_custkey").alias("party_id")), ["vat", "part"])
    first = req.withColumn("part", F.col("request_id") % 40).join(rich, ["vat", "part"])
    second = req.join(M.parties_by(s.select(F.upper("s_name").alias("name"), F.col("s_suppkey").alias("party_id")), ["name"]), "name")
    return M.resolve_tiers(req.select("request_id"), [first, second])


@query(f"with {PAYMENTS}, {INVOICES}, {OPEN} select invoice_id, payment_id, cast(total - amount as decimal(18,2)) as shortfall from invoices join payments using (invoice_id) where total > amount and total - amount <= 5000 and (total - amount) * 100 <= total * 12.5")
def j14_writeoff_candidates(spark, sf_dir):
    pairs = invoices(spark, sf_dir).withColumnRenamed("total", "open_amount").join(payments(spark, sf_dir).select("invoice_id", "payment_id", F.col("amount").alias("paid")), "invoice_id")
    return M.write_offs(pairs, "5000", "12.5").select("invoice_id", "payment_id", "shortfall")


@query("select line_id from lines l where exists (select 1 from ledger g where g.account_id = l.account_id and g.amount = l.amount and abs(date_diff('day', operation_date, booking_date)) <= 1)")
def j19_existing_movement_guard(spark, sf_dir):
    return M.existing_movement(W.lines(spark, sf_dir), W.ledger(spark, sf_dir), 1).select("line_id")


@query("""with c as (select *, regexp_replace(regexp_replace(payment_reference, '[-/]?E[0-9]{4,}$', ''), '[^A-Z0-9]', '', 'g') as core from lines)
 select distinct l.line_id from c l join c x on x.line_id % 70 = 0 and ((length(x.core) >= 8 and x.core = l.core) or (x.amount = l.amount and abs(date_diff('day', x.operation_date, l.operation_date)) <= 31))""")
def j21_affected_peers(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    return M.affected_peers(l.where("line_id % 70 = 0"), l)


@query(f"with {PAYMENTS} select line_id, string_agg(cast(payment_id as varchar), ',' order by payment_id) as links from lines join payments on invoice_id = linked_ledger_id group by line_id")
def j22_ledger_links(spark, sf_dir):
    p = payments(spark, sf_dir).select(F.col("invoice_id").alias("linked_ledger_id"), "payment_id")
    rows = W.lines(spark, sf_dir).join(p, "linked_ledger_id")
    return rows.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("payment_id")), lambda x: x.cast("string")), ",").alias("links"))


@query(f"with {PAYMENTS} select ledger_id from ledger g where not exists (select 1 from payments p where p.invoice_id = g.ledger_id and p.supplier_id % 10 = 0)")
def j24_ownership_filter(spark, sf_dir):
    """Suppliers divisible by ten belong to another company."""
    foreign = payments(spark, sf_dir).where("supplier_id % 10 = 0").select(F.col("invoice_id").alias("ledger_id"))
    return W.ledger(spark, sf_dir).join(foreign, "ledger_id", "left_anti").select("ledger_id")
