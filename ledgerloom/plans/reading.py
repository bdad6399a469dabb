"""Queries of read views, filters, search, exports and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as J
from ..operators import reading as V
from ..operators import selection as S
from ..operators import summaries as A
from ..sources import erp, sinks, statements as P
from . import views as W
from .aggregates import MEMBERS, members
from .candidates import INVOICES, OPEN, PAYMENTS, invoices, payments
from .matches import SCORED, scored
from .registry import query
from .scalars import FOLD

M = W.MONEY
SUMMARY = """summaries as (select account_id, statement_id, min(operation_date) as first_date, max(operation_date) as last_date, count(*) as n, count(*) filter (status = 2) as reconciled,
 count(*) filter (linked_ledger_id is not null and abs(l.amount - g.amount) > 0.001) as issues, 'KB-' || statement_id as ref from lines l left join (select ledger_id, amount from ledger) g on g.ledger_id = linked_ledger_id group by 1, 2)"""


def summaries(spark, sf_dir):
    s = A.statement_summary(W.lines(spark, sf_dir), W.ledger(spark, sf_dir))
    return s.withColumns({"account_id": F.floor(F.col("statement_id") / 100000).cast("long"), "ref": F.concat(F.lit("KB-"), F.col("statement_id").cast("string"))})


@query(f"with {SUMMARY} select statement_id, n from summaries where last_date >= date '1994-01-01' and first_date <= date '1996-12-31' and reconciled < n and contains(lower(ref), 'kb-1')")
def d5_import_list(spark, sf_dir):
    return V.import_list(summaries(spark, sf_dir), since="1994-01-01", until="1996-12-31", state="open", text="KB-1").select("statement_id", "n")


@query(f"with {SUMMARY} select line_id from lines where statement_id in (select statement_id from summaries where account_id = 7 and reconciled = n) and status = 2 and contains(lower(description), 'trf')")
def d5_import_details(spark, sf_dir):
    chosen = V.import_list(summaries(spark, sf_dir), account=7, state="complete")
    return V.import_details(W.lines(spark, sf_dir), chosen, "reconciled", "TRF").select("line_id")


BATCHES = "batched as (select line_id, -line_id as batch_id, cast(amount + 1 as decimal(18,2)) as total, line_id % 20 = 0 as reconciled, line_id % 3 = 0 as is_valid from lines where line_id % 170 = 0)"
LEGACY = "legacy as (select account_id, cast(account_id * 100000 + case when ledger_id % 9 = 0 then 99999 else year(booking_date) * 12 + month(booking_date) end as bigint) as statement_id, ledger_id, booking_date as operation_date, amount, counterparty as description from ledger)"


@query(f"""with {BATCHES}, {LEGACY}
 select 'staging' as storage, l.line_id as row_id, l.account_id, statement_id, operation_date, l.amount, description, linked_ledger_id as native_id, case when b.batch_id is not null then total else g.amount end as native_amount, case when b.batch_id is not null then b.reconciled else g.reconciled end as reconciled,
  coalesce(batch_id, 0) as batch_id, coalesce(is_valid, false) as batch_valid, coalesce(operation_date < start_date, false) as opening from lines l left join ledger g on g.ledger_id = linked_ledger_id left join batched b using (line_id) left join openings o on o.account_id = l.account_id
 union all select 'legacy', y.ledger_id, y.account_id, statement_id, operation_date, y.amount, description, y.ledger_id, y.amount, reconciled, 0, false, coalesce(operation_date < start_date, false) from legacy y join ledger g using (ledger_id) left join openings o on o.account_id = y.account_id
 where not exists (select 1 from lines l where l.account_id = y.account_id and l.statement_id = y.statement_id) and not exists (select 1 from lines l where l.linked_ledger_id = y.ledger_id)""")
def d7_statement_lines_view(spark, sf_dir):
    """Every seventeenth line is tied to a batch; ledger rows divisible by nine belong to statements that were never staged."""
    l, g = W.lines(spark, sf_dir), W.ledger(spark, sf_dir)  # noqa: E741
    b = l.where("line_id % 170 = 0").select("line_id", (-F.col("line_id")).alias("batch_id"), (F.col("amount") + 1).cast(M).alias("total"), (F.col("line_id") % 20 == 0).alias("reconciled"), (F.col("line_id") % 3 == 0).alias("is_valid"))
    month = F.when(F.col("ledger_id") % 9 == 0, 99999).otherwise(F.year("booking_date") * 12 + F.month("booking_date"))
    old = g.select("account_id", (F.col("account_id") * 100000 + month).cast("long").alias("statement_id"), "ledger_id", F.col("booking_date").alias("operation_date"), "amount", F.col("counterparty").alias("description"))
    return V.statement_lines(l, g, b, W.openings(spark, sf_dir), old)


@query("""with e as (select line_id, line_id // 10 as k, account_id, operation_date, amount, description from lines)
 select line_id, account_id, operation_date, amount, case when k % 4 <> 3 and k % 7 <> 0 and k % 23 <> 0 then cast(operation_date + 1 as date) else operation_date end as value_date,
  case when k % 4 <> 3 and k % 7 <> 0 and k % 23 <> 0 then 'told ' || description else description end as description, case when k % 4 <> 3 and k % 7 <> 0 and k % 23 <> 0 then cast(k as decimal(18,2)) end as running_balance, case when k % 4 <> 3 and k % 7 <> 0 and k % 23 <> 0 then k end as sequence from e""")
def d8_bank_statement_view(spark, sf_dir):
    """A quarter of the lines has no evidence, every seventh evidence another amount, every 23rd line is a duplicate."""
    k = (F.col("line_id") / 10).cast("long")
    l = W.lines(spark, sf_dir).withColumns({"currency": F.lit("EUR"), "line_uid": F.col("line_id").cast("string"), "value_date": F.col("operation_date"), "running_balance": F.lit(None).cast(M), "is_duplicate": k % 23 == 0})  # noqa: E741
    e = l.where(k % 4 != 3).select("line_id", "account_id", F.col("operation_date").alias("day"), F.when(k % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(M).alias("amount"), "currency", "line_uid", F.col("description").alias("expected_description"), F.date_add("operation_date", 1).alias("value_date"), F.concat(F.lit("told "), "description").alias("description"), k.cast(M).alias("running_balance"), k.alias("sequence"))
    return V.bank_statement(l, e)


@query(f"""with h as (select line_id, line_id // 10 as k, operation_date, amount, description, case when line_id // 10 % 3 = 0 then 'manual' else 'auto' end as strategy, case when line_id // 10 % 2 = 0 then 'invoice' else 'payment' end as type, 'Fatúra ' || counterparty_name as label from lines where status = 2)
 select line_id from h where operation_date between date '1993-01-01' and date '1997-12-31' and amount > 0 and type = 'invoice' and strategy = 'manual' and amount >= 1000 and (contains(lower({FOLD.format('description')}), 'fatura') or contains(lower({FOLD.format('label')}), 'fatura'))
  and (contains(lower(description), '#00000') or contains(lower(label), '#00000'))""")
def d17_history_filters(spark, sf_dir):
    k = (F.col("line_id") / 10).cast("long")
    link = F.struct(F.when(k % 2 == 0, "invoice").otherwise("payment").alias("type"), F.concat(F.lit("Fatúra "), "counterparty_name").alias("label"))
    h = W.lines(spark, sf_dir).where("status = 2").withColumns({"strategy": F.when(k % 3 == 0, "manual").otherwise("auto"), "links": F.array(link)})
    return V.history_filters(h, "1993-01-01", "1997-12-31", 1, "invoice", "manual", S.comparison(">=1000", F.col("amount")), "FATURA #00000").select("line_id")


@query("""with r as (select 'staging' as storage, line_id as row_id, account_id, operation_date, cast(case when line_id % 3 = 0 then -abs(amount) else abs(amount) end as decimal(18,2)) as amount from lines where status = 2
  union all select 'legacy', ledger_id, account_id, booking_date, cast(case when ledger_id % 3 = 0 then -abs(amount) else abs(amount) end as decimal(18,2)) from ledger where reconciled and ledger_id % 10 = 0)
 select *, cast(place as int) as place from (select * exclude (place), place from (select *, row_number() over (partition by account_id order by operation_date desc, storage desc, row_id desc) as place from r) where place <= 25)""".replace("select *, cast(place as int) as place from (select * exclude (place), place from", "select * exclude (place), cast(place as int) as place from (select * from"))
def d21_recent_reconciled(spark, sf_dir):
    side = lambda c: F.when(F.col(c) % 3 == 0, -1).otherwise(1)
    old = W.ledger(spark, sf_dir).where("ledger_id % 10 = 0").withColumn("direction", side("ledger_id"))
    return V.recent_reconciled(W.lines(spark, sf_dir).withColumn("direction", side("line_id")), old, 25)


WINNERS = "winners as (select l.line_id, l.amount, g.party_id, case when l.line_id // 10 % 3 = 0 then 'supplier_invoice' else 'customer_invoice' end as invoice_type from lines l join ledger g on g.ledger_id * 10 = l.line_id where l.line_id // 10 % 6 < 3)"


@query(f"""with {PAYMENTS}, {INVOICES}, {OPEN}, {WINNERS}, {SCORED}, docs as (select line_id, invoice_id as doc_id from winners w join open_invoices i on i.party_id = w.party_id and open_amount > 0 and invoice_type = case when invoice_id % 2 = 0 then 'customer_invoice' else 'supplier_invoice' end
  where sign(w.amount) = case when invoice_type = 'customer_invoice' then 1 else -1 end), s as (select line_id, doc_id, score from scored where score > 0)
 select line_id, doc_id, coalesce(score, 1) as score, d.doc_id is not null as by_rule from s full join (select *, true as t from docs) d using (line_id, doc_id)""".replace("d.doc_id is not null as by_rule", "coalesce(t, false) as by_rule"))
def j20_rule_invoices(spark, sf_dir):
    party = W.ledger(spark, sf_dir).select((F.col("ledger_id") * 10).alias("line_id"), "party_id")
    k = (F.col("line_id") / 10).cast("long")
    winners = W.lines(spark, sf_dir).where(k % 6 < 3).join(party, "line_id").select("line_id", "amount", "party_id", F.when(k % 3 == 0, "supplier_invoice").otherwise("customer_invoice").alias("invoice_type"))
    docs = J.open_amounts(invoices(spark, sf_dir), payments(spark, sf_dir), "invoice_id", "total", "amount").withColumn("kind", F.when(F.col("invoice_id") % 2 == 0, "customer_invoice").otherwise("supplier_invoice"))
    return V.rule_invoices(winners, docs, scored(spark, sf_dir).where("score > 0"))


@query("""select l.line_id, g.ledger_id, 'bank fees' as category, cast(null as bigint) as party_id, cast(null as varchar) as label from lines l join ledger g on g.account_id = l.account_id and g.amount = l.amount and not g.reconciled where l.line_id // 10 % 5 = 0
 union all select line_id, null, null, 9, 'entry ' || line_id from lines where line_id // 10 % 5 = 1""")
def b5_rule_advice(spark, sf_dir):
    l, k = W.lines(spark, sf_dir), (F.col("line_id") / 10).cast("long") % 5  # noqa: E741
    w = l.where(k < 2).select("line_id", F.when(k == 0, "category").otherwise("quick_entry").alias("action"), F.when(k == 0, "bank fees").alias("category"), F.lit(9).cast("long").alias("party_id"), F.concat(F.lit("entry "), F.col("line_id").cast("string")).alias("label"))
    return V.rule_advice(l, w, W.ledger(spark, sf_dir))


@query("""with a as (select line_id, account_id, amount, operation_date, 'pay- ' || year(operation_date) as search from lines where status = 0),
 m as (select a.line_id, g.ledger_id, row_number() over (partition by a.line_id order by abs(date_diff('day', booking_date, operation_date)), booking_date, g.ledger_id) as place from a join ledger g using (account_id, amount)
  where not reconciled and g.ledger_id not in (select linked_ledger_id from lines where linked_ledger_id is not null) and contains(lower(concat_ws(' ', ref, counterparty, strftime(booking_date, '%Y-%m-%d'), strftime(booking_date, '%d/%m/%Y'), cast(g.amount as varchar))), cast(year(operation_date) as varchar)) and contains(lower(ref), 'pay-'))
 select line_id, ledger_id, cast(place as int) as place, false as truncated from m""")
def j23_search_ledger(spark, sf_dir):
    l = W.lines(spark, sf_dir)  # noqa: E741
    asked = l.where("status = 0").select("line_id", "account_id", "amount", "operation_date", F.concat(F.lit("pay- "), F.year("operation_date").cast("string")).alias("search"))
    return V.search_ledger(asked, W.ledger(spark, sf_dir), l.where("linked_ledger_id is not null").select(F.col("linked_ledger_id").alias("ledger_id")), ["ref", "counterparty"])


@query("""with m as (select line_id, ledger_id, g.amount <> l.amount as smaller from lines l join ledger g on g.account_id = l.account_id and g.booking_date = l.operation_date and sign(g.amount) = sign(l.amount) and abs(g.amount) <= abs(l.amount) where not g.reconciled)
 select line_id, ledger_id, not smaller as can_single, smaller and count(*) filter (smaller) over (partition by line_id) >= 2 as can_group from m""")
def j23_selection_candidates(spark, sf_dir):
    return V.selection_candidates(W.lines(spark, sf_dir), W.ledger(spark, sf_dir))


@query(f"""with {SCORED}, s as (select line_id, 'native_bank' as kind, doc_id, score from scored where score > 0),
 linked as (select case when ledger_id % 2 = 0 then 'payment_linked' else 'native_bank' end as kind, ledger_id as doc_id, account_id, amount, cast(booking_date + 1 as date) as day from ledger where ledger_id % 3 = 0),
 more as (select distinct line_id, kind, doc_id from lines l join linked p on p.account_id = l.account_id and abs(cast(abs(p.amount) * 100 as bigint) - cast(abs(l.amount) * 100 as bigint)) <= 1 and abs(date_diff('day', operation_date, day)) <= 3)
 select * from s union all select line_id, kind, doc_id, 100 from more where not exists (select 1 from s where s.line_id = more.line_id and s.kind = more.kind and s.doc_id = more.doc_id)""")
def j26_linked_fallback(spark, sf_dir):
    k = F.col("ledger_id")
    linked = W.ledger(spark, sf_dir).where("ledger_id % 3 = 0").select(F.when(k % 2 == 0, "payment_linked").otherwise("native_bank").alias("kind"), k.alias("doc_id"), "account_id", "amount", F.date_add("booking_date", 1).alias("day"))
    return V.linked_fallback(W.lines(spark, sf_dir), linked, scored(spark, sf_dir).where("score > 0"), 3)


@query(f"with {PAYMENTS}, {INVOICES} select invoice_id, greatest(cast(total - coalesce(paid, 0) as decimal(18,2)), 0) as remaining, total - coalesce(paid, 0) <= 0 as settled from invoices left join (select invoice_id, sum(amount) as paid from payments group by 1) using (invoice_id)")
def a9_remaining_amount(spark, sf_dir):
    return A.remaining_amount(invoices(spark, sf_dir), payments(spark, sf_dir), "invoice_id", "total", "amount")


@query("""with t as (select l.account_id, case line_id // 10 % 7 when 0 then 'new' when 1 then 'zero' when 2 then 'review' when 3 then 'ambiguous' when 4 then 'described' else 'unchanged' end as outcome from lines l)
 select entity, count(distinct account_id) filter (account_id % 4 <> 0) as mapped, count(distinct account_id) filter (account_id % 4 = 0) as unmapped, count(*) filter (outcome in ('new', 'zero')) as imported, count(*) filter (outcome in ('unchanged', 'described')) as unchanged,
  count(*) filter (outcome = 'review') as conflicts, count(*) filter (outcome = 'ambiguous') as failed from accounts left join t using (account_id) group by 1""")
def a16_feed_run_summary(spark, sf_dir):
    kinds = ["new", "zero", "review", "ambiguous", "described", "unchanged", "unchanged"]
    at = (F.floor(F.col("line_id") / 10) % 7).cast("int")
    tx = W.lines(spark, sf_dir).select("account_id", F.get(F.array(*[F.lit(x) for x in kinds]), at).alias("outcome"))
    return A.feed_run_summary(tx, W.accounts(spark, sf_dir).withColumn("mapped", F.col("account_id") % 4 != 0))


@query(f"with {MEMBERS} select linked_ledger_id as ledger_id, 'line' as \"by\", line_id as id from lines where linked_ledger_id is not null union all select ledger_id, 'batch', batch_id from members")
def u2_claims(spark, sf_dir):
    return A.claims(W.lines(spark, sf_dir), members(spark, sf_dir))


@query("""with u as (select 'a' as family, ledger_id as doc_id, amount, 0 as p from ledger where ledger_id % 2 = 0 union all select 'a', ledger_id, cast(amount + 1 as decimal(18,2)), 1 from ledger union all select 'b', ledger_id, cast(amount + 2 as decimal(18,2)), 2 from ledger where ledger_id % 5 = 0)
 select family, doc_id, min_by(amount, p) as amount from u group by 1, 2""")
def u3_priority_union(spark, sf_dir):
    g = W.ledger(spark, sf_dir)
    part = lambda rows, family, add: rows.select(F.lit(family).alias("family"), F.col("ledger_id").alias("doc_id"), (F.col("amount") + add).cast(M).alias("amount"))
    return J.candidate_union(part(g.where("ledger_id % 2 = 0"), "a", 0), part(g, "a", 1), part(g.where("ledger_id % 5 = 0"), "b", 2))


@query("select statement_id, line_id, cast(row_number() over (partition by statement_id order by operation_date, line_id) as int) as sequence from lines")
def v6_evidence_sequence(spark, sf_dir):
    """Lines as they stand in their statement, newest first; the sequence counts from the oldest."""
    x = F.struct(F.col("operation_date").alias("day"), "line_id", "amount")
    s = W.lines(spark, sf_dir).groupBy("statement_id", "account_id").agg(F.reverse(F.array_sort(F.collect_list(x))).alias("lines"))
    rows = P.explode_evidence(s.select("statement_id", "account_id", F.lit("DESC").alias("direction"), F.transform("lines", lambda y: F.struct(y["line_id"].alias("line_id"), y["day"].alias("day"), y["amount"].alias("amount"))).alias("lines")))
    return rows.select("statement_id", "line_id", "sequence")


@query("""select line_id, case when k % 11 = 0 then '' when k % 7 = 0 then '' when k % 13 = 0 then '' when sign(amount) <> case when k % 2 = 0 then 1 else -1 end then '' when k % 5 = 0 then 'iban' when k % 5 = 1 then '' when k % 3 = 0 then 'company' else '' end as identity
 from (select line_id, line_id // 10 as k, amount from lines)""")
def f21_owned_identity(spark, sf_dir):
    """Transfers in both directions; some texts hold a refusing word, an unknown word or another display code, some an IBAN."""
    k = (F.col("line_id") / 10).cast("long")
    way = F.when(k % 2 == 0, " DE ").otherwise(" PARA ")
    rail = F.when(k % 7 == 0, "TRF. HOJE").when(k % 4 == 0, "Transferência SEPA 123").otherwise("TRF IMED.")
    name = F.when(k % 3 == 0, "Empresa Exemplo & Filhos Lda - E12345").otherwise("Outra Empresa Grande SA")
    text = F.concat(rail, way, F.when(k % 13 == 0, "XY9 - ").otherwise(""), name, F.when(k % 11 == 0, " ESTORNO").otherwise(""))
    iban = lambda n: F.concat(F.lit("DE"), F.lpad((98 - ((n % 97) * 27 + 62) % 97).cast("string"), 2, "0"), F.lpad(n.cast("string"), 18, "0"))
    own = F.when(k % 5 == 0, iban(k)).when(k % 5 == 1, iban(k + 1)).otherwise("")
    return W.lines(spark, sf_dir).select("line_id", T.owned_identity(text, "amount", F.lit("CU1 - Empresa Exemplo e Filhos, Lda"), own, iban(k)).alias("identity"))


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'vat:PT' || s_suppkey else 'name:' || upper(s_name) end as key from supplier", base=False)
def f29_supplier_lookup_key(spark, sf_dir):
    vat = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("pt-"), F.col("s_suppkey").cast("string"))).when(F.col("s_suppkey") % 3 == 1, " . ")
    return W.table(spark, sf_dir, "supplier").select("s_suppkey", T.supplier_lookup_key(vat, F.concat(F.lit(" "), "s_name")).alias("key"))


@query("select event_id, json_extract_string(props, '$.k') as k, case when event_id % 3 = 0 then null else cast(event_id as varchar) end as id from events", base=False)
def f30_json_access(spark, sf_dir):
    """A field of the stored objects, and of texts of which every third is no JSON."""
    told = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}")))
    return W.table(spark, sf_dir, "events").select("event_id", T.payload_text("props", "k").alias("k"), T.payload_text(told, "id").alias("id"))


@query("select statement_id, line_id, operation_date, description, amount, cast(status as int) as status from lines")
def w2_export_statement_lines(spark, sf_dir):
    return sinks.statement_lines(W.lines(spark, sf_dir)).select("statement_id", "line_id", "operation_date", "description", "amount", F.col("status").cast("int").alias("status"))


@query("select cast(line_id as varchar) as line_id, case when line_id % 4 = 0 then '''=' || description else description end as description, cast(amount as varchar) as amount from lines")
def w1_write_csv(spark, sf_dir):
    """The file as it is read again."""
    path = erp.shared_path(spark, "csv")
    sinks.write_csv(W.lines(spark, sf_dir).select("line_id", F.when(F.col("line_id") % 4 == 0, F.concat(F.lit("="), "description")).otherwise(F.col("description")).alias("description"), "amount"), path)
    return spark.read.option("sep", ";").option("header", "true").csv(path)


@query("select type, count(*) as n from (select event_type as type from events union all select 'again' from events where event_id % 4 = 0) group by 1", base=False)
def w5_append_audit(spark, sf_dir):
    """Two appends, one of them tried again, read as one table."""
    path = erp.shared_path(spark, "audit")
    e = W.table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("props").alias("payload"), F.col("ts").alias("at"), "event_id")
    for batch in ("a", "b", "a"):
        sinks.append_audit(e if batch == "a" else e.where("event_id % 4 = 0").withColumn("type", F.lit("again")), path, batch)
    return sinks.read_audit(spark, path).groupBy("type").agg(F.count("*").alias("n"))


@query("""with s as (select statement_id as id, account_id, row_number() over (partition by account_id order by max(operation_date) desc, statement_id desc) as k from lines group by 1, 2), l as (select line_id as id, account_id, row_number() over (partition by statement_id order by operation_date, line_id) as k from lines)
 select 'accounts' as name, account_id as id from accounts union all select 'statements', id from s where k between 4 and 6 union all select 'lines', id from l where k between 4 and 6 union all select 'audit', event_id from (select event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k between 4 and 6""")
def w6_read_collections(spark, sf_dir):
    """The second page of three rows of each statement, account or type; all accounts."""
    e = W.table(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), F.col("event_type").alias("type"), F.col("ts").alias("at"), "props")
    c = V.collections(W.accounts(spark, sf_dir), W.lines(spark, sf_dir), e)
    page = lambda name, by, key: S.page(*c[name], 3, 1, [by]).select(F.lit(name).alias("name"), F.col(key).cast("long").alias("id"))
    every = c["accounts"][0].select(F.lit("accounts").alias("name"), F.col("account_id").alias("id"))
    return every.unionByName(page("statements", "account_id", "statement_id")).unionByName(page("lines", "statement_id", "line_id")).unionByName(page("audit", "type", "audit_id"))


@query("select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem union all select 'supplier', count(*) from supplier", base=False)
def s15_scan_tables(spark, sf_dir):
    tables = erp.scan_erp_tables(spark, sf_dir, ("customer", "orders", "lineitem", "supplier"))
    out = None
    for name, t in tables.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("select event_id as id, cast(value as decimal(18,2)) as amount from events where ts >= timestamp '2024-01-12 00:00:00'", base=False)
def s17_feed_pages(spark, sf_dir):
    """Events as landed pages of a hundred; those of the 48 hours before the watermark are read again."""
    path = erp.shared_path(spark, "pages")
    e = W.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").cast(M).cast("string").alias("amount"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))
    erp.pages_of(e, 100, F.col("id")).write.json(path)
    rows = erp.read_feed_pages(spark, path, "id: bigint, amount: string, updated_at: string", "2024-01-14 00:00:00")
    return rows.select("id", F.col("amount").cast(M).alias("amount"))


@query("""with p as (select line_id, line_id // 10 as k from lines) select line_id, case when k % 17 = 0 then 'missing' when k % 19 = 0 then 'hash' else 'facts' end as problem from p where k % 17 = 0 or k % 19 = 0 or k % 23 = 0""")
def k4_provider_evidence(spark, sf_dir):
    """Some payloads are missing, changed after they were hashed, or tell another amount."""
    k = (F.col("line_id") / 10).cast("long")
    l = W.lines(spark, sf_dir).withColumn("currency", F.lit("EUR"))  # noqa: E741
    told = F.to_json(F.struct(F.when(k % 23 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("string").alias("amount"), "currency", F.col("operation_date").cast("string").alias("operation_date")))
    p = l.where(k % 17 != 0).select("line_id", told.alias("payload")).withColumn("payload_hash", F.sha2(F.when(k % 19 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")), 256))
    return A.provider_evidence(l, p)


@query("select event_id, case when cast(ts as date) < date '2024-01-15' then 'purge' else 'keep' end as side from events", base=False)
def k6_retention_sides(spark, sf_dir):
    kept, purged = A.retention_split(W.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "day", "2024-02-14", 30)
    return kept.select("event_id", F.lit("keep").alias("side")).unionByName(purged.select("event_id", F.lit("purge").alias("side")))


PROPOSED = """free as (select ledger_id, account_id, amount, row_number() over (partition by account_id order by ledger_id) - 1 as n from ledger where not reconciled),
 groups as (select account_id, n // 3 as b, min(ledger_id) as id, sum(amount) as total, count(*) as size from free group by 1, 2),
 owners as (select -id as line_id, account_id, cast(total + case when id % 5 = 0 then 1 else 0 end as decimal(18,2)) as amount, case when id % 7 = 0 then 2 else 0 end as status from groups),
 proposed as (select -id as line_id, ledger_id from free f join groups g on g.account_id = f.account_id and g.b = f.n // 3),
 held as (select ledger_id from free where ledger_id % 11 = 0),
 outcomes as (select o.line_id, count(*) as members, case when max(status) >= 2 then 'done' when count(*) < 2 then 'members' when sum(f.amount) <> max(o.amount) then 'sum' when bool_or(p.ledger_id in (select ledger_id from held)) then 'taken' else 'applied' end as outcome
   from owners o join proposed p using (line_id) join free f using (ledger_id) group by 1)"""


def proposals(spark, sf_dir):
    """Three open ledger rows in order of id make a batch of a line of their sum; some sums are off, some lines done, some rows held."""
    from pyspark.sql import Window

    g = W.ledger(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("ledger_id")) - 1
    free = g.where("not reconciled").withColumn("b", F.floor(n / 3))
    groups = free.groupBy("account_id", "b").agg(F.min("ledger_id").alias("id"), F.sum("amount").alias("total"))
    i = F.col("id")
    lines = groups.select((-i).alias("line_id"), "account_id", (F.col("total") + F.when(i % 5 == 0, 1).otherwise(0)).cast(M).alias("amount"), F.when(i % 7 == 0, 2).otherwise(0).alias("status"), F.lit(None).cast("long").alias("linked_ledger_id"))
    proposed = free.join(groups.select("account_id", "b", "id"), ["account_id", "b"]).select((-i).alias("line_id"), "ledger_id")
    return g, lines, proposed, free.where("ledger_id % 11 = 0").select("ledger_id")


@query(f"with {PROPOSED} select line_id, members, outcome from outcomes")
def t3_batch_outcomes(spark, sf_dir):
    g, lines, proposed, held = proposals(spark, sf_dir)
    return A.apply_batches(proposed, lines, g, held)


@query(f"with {PROPOSED} select ledger_id, reconciled or ledger_id in (select ledger_id from proposed join outcomes using (line_id) where outcome = 'applied') as reconciled from ledger")
def t3_ledger_after(spark, sf_dir):
    g, lines, proposed, held = proposals(spark, sf_dir)
    return A.batched_ledger(g, proposed, A.apply_batches(proposed, lines, g, held)).select("ledger_id", "reconciled")


@query(f"with {PROPOSED} select line_id, ledger_id, line_id % 4 <> 0 as active from proposed")
def t3_undo_batches(spark, sf_dir):
    _, lines, proposed, _ = proposals(spark, sf_dir)
    return A.undo_batches(proposed.withColumn("active", F.lit(True)), lines.where("line_id % 4 = 0"))
