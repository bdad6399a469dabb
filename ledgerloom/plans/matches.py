"""Queries of scoring and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import text_similarity
from ..operators import matching as M
from . import views as W
from .candidates import INVOICES, invoices
from .registry import query
from .scalars import CORE, NORM, WORDS

N = NORM.format
TEXT = N("concat_ws(' ', payment_reference, description)")
#: The longest shared run of x and y with its place in x (the first of the longest), and what lies left and right of it.
_BEST = "list_max(flatten([[{{'n': l, 'p': -i}} for l in range(1, len({x}) - i + 2) if contains({y}, {x}[i:i + l - 1])] for i in range(1, len({x}) + 1)]))"


def similar(pairs: str) -> str:
    """CTEs ``pieces`` and ``likeness`` (x, y, likeness): twice the characters in common of the pairs (x, y) of a table, in percent."""
    best = _BEST.format(x="x", y="y")
    return f"""pieces as (select * from (with recursive r(a, b, x, y, n) as (select distinct x, y, substr(x, 1, 50), substr(y, 1, 50), 0 from {pairs} where length(x) > 0 and length(y) > 0 and greatest(length(x), length(y)) <= 3 * least(length(x), length(y))
   union all select a, b, h.x, h.y, h.n from (select a, b, unnest([{{'x': substr(x, 1, -m.p - 1), 'y': substr(y, 1, instr(y, substr(x, -m.p, m.n)) - 1), 'n': m.n}}, {{'x': substr(x, -m.p + m.n), 'y': substr(y, instr(y, substr(x, -m.p, m.n)) + m.n), 'n': 0}}]) as h from (select *, {best} as m from r where length(x) > 0 and length(y) > 0) where m is not null)) select * from r)),
 likeness as (select a as x, b as y, sum(n) * 200.0 / (length(substr(a, 1, 50)) + length(substr(b, 1, 50))) as likeness from pieces group by a, b)"""


SCORED = f"""pairs as (
  select l.line_id, l.amount, l.operation_date, l.payment_reference, l.description, l.counterparty_name, g.ledger_id as doc_id, g.amount as doc_amount, g.booking_date as doc_date, g.ref as doc_ref, g.counterparty as doc_name
  from lines l join ledger g on g.account_id = l.account_id and abs(l.amount - g.amount) <= 0.01 and abs(date_diff('day', operation_date, booking_date)) <= 7
  where l.status = 0 and not g.reconciled),
 facts as (select *, abs(date_diff('day', operation_date, doc_date)) as days, {CORE.format('payment_reference')} = {CORE.format('doc_ref')} and length({CORE.format('payment_reference')}) >= 8 as strong,
  {TEXT} as body, {N('doc_ref')} as nref, {N('counterparty_name')} as mine, {N('doc_name')} as other, {WORDS.format('description')} as words, {WORDS.format('doc_name')} as phrase from pairs),
 flags as (select *, not strong and contains(body, nref) as exact, length(mine) > 0 and (contains(mine, other) or contains(other, mine)) as named, length(mine) = 0 and length(trim(phrase)) >= 8 and len(string_split(trim(phrase), ' ')) >= 2 and contains(words, phrase) as described from facts),
 unlike as (select mine as x, other as y from flags where length(mine) > 0 and not named), {similar('unlike')},
 scored as (select line_id, doc_id, doc_amount, strong or exact as sure, cast(greatest(0, 70 + case when days <= 3 then 30 else 0 end + case when strong then 120 when exact then 50 else 0 end + case when named then 35 when coalesce(likeness, 0) >= 72 then 25 else 0 end + case when described then 25 else 0 end
  - case when days > 3 and not strong and not exact then least(80, 20 + 2 * (days - 3)) else 0 end) as int) as score from flags left join likeness on x = mine and y = other and not named),
 ranks as (select *, row_number() over w as rank, cast(score - coalesce(lead(score) over w, 0) as int) as lead from scored where score > 0 window w as (partition by line_id order by score desc, abs(doc_amount), doc_id))"""


def scored(spark, sf_dir):
    docs = W.ledger(spark, sf_dir).where("not reconciled").select(
        F.lit("native_bank").alias("kind"), F.col("ledger_id").alias("doc_id"), F.col("account_id").alias("doc_account"), F.col("amount").alias("doc_amount"),
        F.col("booking_date").alias("doc_date"), F.col("ref").alias("doc_ref"), F.col("counterparty").alias("doc_name"))
    return M.score(M.near_amount_pairs(M.prepare_lines(W.lines(spark, sf_dir).where("status = 0")), M.prepare_docs(docs), 7), 3)


@query(f"""with near as (select p_partkey, lower(p_name || ' ' || p_brand) as x, lower(p_type || ' ' || p_name) as y from part), {similar('near')}
 select p_partkey, round(coalesce(likeness, 0), 6) as likeness from near left join likeness using (x, y)""", base=False)
def f6_text_similarity(spark, sf_dir):
    p = W.table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("x"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("y"))
    return p.select("p_partkey", F.round(text_similarity("x", "y"), 6).alias("likeness"))


def _iban(n):
    """A valid IBAN of a number: 'DE', check digits, 18 digits (27 and 62 are 10**6 and 131400 modulo 97)."""
    return F.concat(F.lit("DE"), F.lpad((98 - ((n % 97) * 27 + 62) % 97).cast("string"), 2, "0"), F.lpad(n.cast("string"), 18, "0"))


IBAN = "'DE' || lpad(cast(98 - (({n} % 97) * 27 + 62) % 97 as varchar), 2, '0') || lpad(cast({n} as varchar), 18, '0')"
BILLS = f"""bill_lines as (select l.line_id, l.line_id // 10 as k, g.party_id, l.amount, l.operation_date, case when l.line_id // 10 % 4 = 0 then 'FT-' || lpad(cast(l.line_id // 10 as varchar), 8, '0') || '-E1234567' else '' end as payment_reference,
   l.description || ' RC' || g.party_id as description, l.counterparty_name, case when l.line_id // 10 % 3 = 0 then {IBAN.format(n='g.party_id')} else '' end as iban from lines l join ledger g on g.ledger_id * 10 = l.line_id),
 bills as (select o_orderkey as doc_id, o_custkey as party_id, case when o_orderkey % 7 = 0 then 'tax' when o_orderkey % 2 = 0 then 'customer_invoice' else 'supplier_invoice' end as kind, cast(o_totalprice as decimal(18,2)) as doc_amount, cast(o_orderdate as date) as doc_date,
   'FT-' || lpad(cast(o_orderkey as varchar), 8, '0') as doc_ref, case when o_orderkey % 5 = 0 then 'Z9; RC' || o_custkey else '' end as ref_client, case when o_orderkey % 2 = 0 then {IBAN.format(n='o_custkey')} else '' end as doc_iban,
   case o_orderkey % 3 when 0 then c_name when 1 then 'Custmer ' || c_name else 'Other company' end as doc_name, o_orderkey % 11 = 0 as p_iban, o_orderkey % 13 = 0 as p_text from orders join customer on c_custkey = o_custkey),
 bill_pairs as (select *, abs(date_diff('day', operation_date, doc_date)) as days, abs(abs(amount) - doc_amount) <= 0.01 as equal from bill_lines join bills using (party_id) where abs(date_diff('day', operation_date, doc_date)) <= 60),
 bill_facts as (select *, not equal and abs(amount) < doc_amount + 0.01 as partial, {CORE.format('payment_reference')} = {CORE.format('doc_ref')} and length({CORE.format('payment_reference')}) >= 8 as strong, {TEXT} as body, {N('doc_ref')} as nref,
   {N('counterparty_name')} as mine, {N('doc_name')} as other, {N('description')} as told from bill_pairs),
 bill_flags as (select *, not strong and contains(body, nref) as exact, length(mine) > 0 and (contains(mine, other) or contains(other, mine)) as named from bill_facts),
 unlike as (select mine as x, other as y from bill_flags where length(mine) > 0 and not named), {similar('unlike')},
 bill_why as (select line_id, doc_id, equal, partial, list_filter([case when equal then 'amount' end, case when partial then 'amount_pending' end, case when days <= 3 then 'date' end, case when strong then 'ref_payment' end, case when exact then 'ref_exact' end,
   case when not strong and not exact and ref_client <> '' and contains(body, 'rc' || party_id) then 'ref_client' end, case when named then 'name_partial' end, case when length(mine) > 0 and not named and coalesce(likeness, 0) >= 72 then 'name_fuzzy' end,
   case when iban <> '' and iban = doc_iban then 'iban' end, case when (equal or partial) and p_iban and iban <> '' then 'pattern_iban' end, case when (equal or partial) and p_text and contains(told, 'rc' || party_id) then 'pattern_desc' end], lambda x: x is not null) as why
   from bill_flags left join likeness on x = mine and y = other and not named),
 bill_points as (select *, list_sum([case w when 'amount' then 70 when 'amount_pending' then 40 when 'date' then 30 when 'ref_payment' then 120 when 'ref_exact' then 50 when 'ref_client' then 35 when 'name_partial' then 35 when 'name_fuzzy' then 25 when 'iban' then 45
   when 'pattern_iban' then case when equal then 60 else 25 end else case when equal then 40 else 15 end end for w in why]) as points, equal or (partial and list_has_any(why, ['ref_payment', 'ref_exact', 'ref_client', 'name_partial', 'name_fuzzy', 'iban', 'pattern_iban', 'pattern_desc'])) as allowed from bill_why)"""


def bill_pairs(spark, sf_dir):
    """Lines with invoices and taxes of their party: every reason for a score occurs."""
    party = W.ledger(spark, sf_dir).select((F.col("ledger_id") * 10).alias("line_id"), "party_id")
    k = (F.col("line_id") / 10).cast("long")
    own = F.concat(F.lit("FT-"), F.lpad(k.cast("string"), 8, "0"), F.lit("-E1234567"))
    l = W.lines(spark, sf_dir).join(party, "line_id").withColumns({"payment_reference": F.when(k % 4 == 0, own).otherwise(""), "description": F.concat("description", F.lit(" RC"), F.col("party_id").cast("string")), "counterparty_iban": F.when(k % 3 == 0, _iban(F.col("party_id"))).otherwise("")})  # noqa: E741
    n = F.col("invoice_id")
    names = W.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party_id"), "c_name")
    d = invoices(spark, sf_dir).join(names, "party_id").select(
        F.when(n % 7 == 0, "tax").when(n % 2 == 0, "customer_invoice").otherwise("supplier_invoice").alias("kind"), n.alias("doc_id"), "party_id", F.col("total").alias("doc_amount"), F.col("invoice_date").alias("doc_date"), F.col("ref").alias("doc_ref"),
        F.when(n % 5 == 0, F.concat(F.lit("Z9; RC"), F.col("party_id").cast("string"))).otherwise("").alias("ref_client"), F.when(n % 2 == 0, _iban(F.col("party_id"))).otherwise("").alias("doc_iban"),
        F.when(n % 3 == 0, F.col("c_name")).when(n % 3 == 1, F.concat(F.lit("Custmer "), "c_name")).otherwise("Other company").alias("doc_name"))
    told = F.concat(F.lit("rc"), F.col("party_id").cast("string"))
    rows = lambda step, kind, value: d.where(n_mod(step)).select("kind", "doc_id", F.lit(kind).alias("pattern_type"), value.alias("pattern_value"))
    n_mod = lambda step: F.col("doc_id") % step == 0
    patterns = rows(11, "iban", _iban(F.col("party_id"))).unionByName(rows(13, "description", told))
    pairs = M.prepare_lines(l).join(M.prepare_docs(d, patterns), "party_id").where(F.abs(F.datediff("operation_date", "doc_date")) <= 60)
    equal, partial = M.amounts()
    return M.score(pairs.where(equal | partial), 3)  # before names are compared


@query(f"with {BILLS} select line_id, doc_id, cast(points as int) as score, array_to_string(why, ',') as details from bill_points where allowed")
def j9_score_bills(spark, sf_dir):
    return bill_pairs(spark, sf_dir).where("score > 0").select("line_id", "doc_id", "score", F.array_join("details", ",").alias("details"))


@query(f"""with {BILLS}, r as (select *, row_number() over w as k, points - coalesce(lead(points) over w, 0) as lead from (select b.*, doc_amount from bill_points b join bills using (doc_id) where allowed) window w as (partition by line_id order by points desc, abs(doc_amount), doc_id))
 select line_id, doc_id, points >= 150 and equal and lead >= 35 and list_has_any(why, ['ref_payment', 'ref_exact', 'iban', 'pattern_iban']) as is_safe, lead >= 35 as is_unambiguous from r where k = 1""")
def j25_best_bill(spark, sf_dir):
    return M.decided(bill_pairs(spark, sf_dir)).select("line_id", "doc_id", "is_safe", "is_unambiguous")


@query(f"with {SCORED} select line_id, doc_id, score from scored where score > 0")
def j9_score_pairs(spark, sf_dir):
    return scored(spark, sf_dir).where("score > 0").select("line_id", "doc_id", "score")


@query("select i.invoice_id, l.line_id from lines l join invoices i on i.party_id = (select party_id from ledger where ledger_id * 10 = l.line_id) and l.amount > 0 and l.amount < i.total - 0.01 and abs(date_diff('day', l.operation_date, i.invoice_date)) <= 60 where l.counterparty_name <> ''".replace("select i.", f"with {INVOICES} select i.", 1))
def j9_partial_pairs(spark, sf_dir):
    """Invoices of the line's party that the line would pay in part."""
    party = W.ledger(spark, sf_dir).select((F.col("ledger_id") * 10).alias("line_id"), "party_id")
    l = W.lines(spark, sf_dir).where("counterparty_name <> '' and amount > 0").join(party, "line_id")  # noqa: E741
    pairs = l.join(invoices(spark, sf_dir), "party_id").where((F.col("amount") < F.col("total") - F.lit("0.01").cast(W.MONEY)) & (F.abs(F.datediff("operation_date", "invoice_date")) <= 60))
    return pairs.select("invoice_id", "line_id")


@query(f"with {SCORED} select line_id, doc_id, score, cast(rank as int) as rank from ranks")
def o2_ranked_suggestions(spark, sf_dir):
    return M.ranked(scored(spark, sf_dir)).select("line_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


@query(f"with {SCORED} select line_id, doc_id, lead from ranks where rank = 1")
def v9_score_gap(spark, sf_dir):
    return M.ranked(scored(spark, sf_dir)).where("rank = 1").select("line_id", "doc_id", "lead")


@query(f"with {SCORED}, top as (select *, score >= 150 and sure and lead >= 35 as is_safe from ranks where rank = 1) select line_id, doc_id, is_safe, lead >= 35 as is_unambiguous, is_safe and sum(is_safe::int) over (partition by doc_id) = 1 as is_mutual from top")
def j25_best_resolution(spark, sf_dir):
    return M.decided(scored(spark, sf_dir)).select("line_id", "doc_id", "is_safe", "is_unambiguous", "is_mutual")


@query(f"with {SCORED}, byd as (select line_id, doc_id, row_number() over (partition by doc_id order by score desc, line_id) as k from scored where score > 0) select r.line_id, r.doc_id from ranks r join byd b on b.line_id = r.line_id and b.doc_id = r.doc_id where rank = 1 and k = 1")
def v8_mutual_best(spark, sf_dir):
    r = M.ranked(scored(spark, sf_dir))
    back = r.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_id")))
    return back.where("rank = 1 and k = 1").select("line_id", "doc_id")


@query(f"with {SCORED} select line_id, doc_id, cast(row_number() over (partition by line_id order by score desc, (select ref from ledger where ledger_id = doc_id)) as int) as place from scored where score > 0")
def j29_candidate_order(spark, sf_dir):
    w = Window.partitionBy("line_id").orderBy(*M.candidate_order(F.col("score"), F.col("kind")))
    return scored(spark, sf_dir).where("score > 0").select("line_id", "doc_id", F.row_number().over(w).cast("int").alias("place"))


@query("""with o as (select ledger_id as obligation_id, account_id, abs(amount) as remaining, cast(booking_date + cast(ledger_id % 50 - 10 as int) as date) as due from ledger where amount < 0),
 p as (select line_id, obligation_id from lines l join o on o.account_id = l.account_id and o.remaining = -l.amount and l.amount < 0 and date_diff('day', due, operation_date) between -45 and 5)
 select line_id, case when count(*) = 1 then 'unique' else 'ambiguous' end as status, case when count(*) = 1 then min(obligation_id) end as obligation_id from p group by 1""")
def j15_planned_payments(spark, sf_dir):
    o = W.ledger(spark, sf_dir).where("amount < 0").select(F.col("ledger_id").alias("obligation_id"), "account_id", F.abs("amount").alias("remaining"), F.date_add("booking_date", (F.col("ledger_id") % 50 - 10).cast("int")).alias("due_date"))
    return M.planned_payments(W.lines(spark, sf_dir), o, 45, 5)


@query("""with c as (select account_id, payment_reference, operation_date, amount, count(*) as n, min(line_id) as line_id from lines where payment_reference <> '' and amount > 0 group by 1, 2, 3, 4),
 g as (select account_id, amount, count(*) as n, min(ledger_id) as ledger_id from ledger where not reconciled group by 1, 2)
 select line_id, case when g.n is null then 'create' when g.n = 1 then 'reuse' else 'blocked' end as action, case when g.n = 1 then ledger_id end as ledger_id from c left join g using (account_id, amount) where c.n = 1""")
def j17_terminal_settlements(spark, sf_dir):
    """Settlement lines alone in their identity, day and amount; a ledger row is reused only where it is the only one."""
    l = W.lines(spark, sf_dir).where("payment_reference <> '' and amount > 0")  # noqa: E741
    alone = l.groupBy("account_id", "payment_reference", "operation_date", "amount").agg(F.count("*").alias("c"), F.min("line_id").alias("line_id")).where("c = 1")
    g = W.ledger(spark, sf_dir).where("not reconciled").groupBy("account_id", "amount").agg(F.count("*").alias("n"), F.min("ledger_id").alias("ledger_id"))
    one = F.col("n") == 1
    return alone.join(g, ["account_id", "amount"], "left").select("line_id", F.when(F.col("n").isNull(), "create").when(one, "reuse").otherwise("blocked").alias("action"), F.when(one, F.col("ledger_id")).alias("ledger_id"))


@query("""with s as (select ledger_id as payout_id, account_id, amount, cast(booking_date - 1 as date) as starts, cast(booking_date + 2 as date) as ends from ledger where amount > 0)
 select line_id, payout_id from lines join s using (account_id, amount) where operation_date between starts and ends""")
def j18_payout_settlements(spark, sf_dir):
    spans = W.ledger(spark, sf_dir).where("amount > 0").select(F.col("ledger_id").alias("payout_id"), "account_id", "amount", F.date_sub("booking_date", 1).alias("starts"), F.date_add("booking_date", 2).alias("ends"))
    return M.interval_join(W.lines(spark, sf_dir), spans, ["account_id", "amount"], "operation_date").select("line_id", "payout_id")


@query("""with m as (select line_id, account_id, operation_date, cast(floor(abs(amount) / 5000) * 50 * sign(amount) as decimal(18,2)) as amount from lines where status = 0),
 p as (select a.line_id as out_id, b.line_id as in_id, abs(date_diff('day', a.operation_date, b.operation_date)) as d from m a join m b on a.amount < 0 and b.amount = -a.amount and b.account_id = a.account_id % 25 + 1 and abs(date_diff('day', a.operation_date, b.operation_date)) <= 2),
 r as (select *, row_number() over (partition by out_id order by d, in_id) as x, row_number() over (partition by in_id order by d, out_id) as y from p)
 select out_id, in_id from r where x = 1 and y = 1""")
def j10_transfer_pairs(spark, sf_dir):
    """Restricted account a pays to main account a % 25 + 1; coarse amounts make rivals; only mutual best pairs stay."""
    coarse = (F.floor(F.abs("amount") / 5000) * 50 * F.signum("amount").cast("int")).cast(W.MONEY)
    m = W.lines(spark, sf_dir).where("status = 0").withColumn("amount", coarse)
    pairs = M.opposite_pairs(m, 2, F.col("out_account") % 25 + 1).withColumn("d", F.abs(F.datediff("out_date", "in_date")))
    best = lambda a, b: F.row_number().over(Window.partitionBy(a).orderBy("d", b))
    return pairs.withColumn("x", best("out_id", "in_id")).withColumn("y", best("in_id", "out_id")).where("x = 1 and y = 1").select("out_id", "in_id")
