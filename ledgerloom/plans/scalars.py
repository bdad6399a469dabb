"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import query
from .views import ledger, lines, table

FOLD = f"translate({{}}, '{T.ACCENTED}', '{T.PLAIN}')"
NORM = "regexp_replace(regexp_replace(lower(translate(trim(regexp_replace({}, '\\s+', ' ', 'g')), '" + T.ACCENTED + "', '" + T.PLAIN + "')), '[^a-z0-9 ]', '_', 'g'), ' +', ' ', 'g')"
CORE = "regexp_replace(regexp_replace(regexp_replace(upper({}), '[^A-Z0-9/-]', '', 'g'), '[-/]?E[0-9]{{4,}}$', ''), '[^A-Z0-9]', '', 'g')"
WORDS = "' ' || trim(regexp_replace(lower(translate({}, '" + T.ACCENTED + "', '" + T.PLAIN + "')), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"select doc_id, sha256({NORM.format('text')}) as norm_sha from documents", base=False)
def f1_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text("text"), 256).alias("norm_sha"))


@query(
    f"select line_id, contains({WORDS.format('description')}, {WORDS.format('counterparty')}) and length(trim({WORDS.format('counterparty')})) >= 8"
    f" and len(string_split(trim({WORDS.format('counterparty')}), ' ')) >= 2 as named from lines join ledger on line_id = ledger_id * 10"
)
def f2_complete_name(spark, sf_dir):
    pairs = lines(spark, sf_dir).join(ledger(spark, sf_dir).select("ledger_id", "counterparty"), F.col("line_id") == F.col("ledger_id") * 10)
    return pairs.select("line_id", T.complete_name_in("counterparty", "description").alias("named"))


@query(f"select line_id, {CORE.format('payment_reference')} as core from lines")
def f3_reference_core(spark, sf_dir):
    return lines(spark, sf_dir).select("line_id", T.reference_core("payment_reference").alias("core"))


@query(f"select line_id, {CORE.format('payment_reference')} = {CORE.format('ref')} and length({CORE.format('payment_reference')}) >= 8 as strong from lines join ledger on ledger_id * 10 = line_id")
def f4_strong_reference(spark, sf_dir):
    both = lines(spark, sf_dir).join(ledger(spark, sf_dir).select("ledger_id", "ref"), F.col("ledger_id") * 10 == F.col("line_id"))
    return both.select("line_id", T.strong_reference_match("payment_reference", "ref").alias("strong"))


@query("""with src as (select p_partkey, replace(p_name, ' ', ';') || ', ' || p_brand || ' |' || p_brand as refs from part),
 parts as (select p_partkey, upper(trim(x)) as x, i from src, unnest(regexp_split_to_array(refs, '[,;|]')) with ordinality t(x, i)),
 firsts as (select p_partkey, x, min(i) as i from parts where x <> '' group by all)
 select p_partkey, string_agg(x, '/' order by i) as refs, count(*)::bigint as n from firsts group by p_partkey""")
def f5_split_refs(spark, sf_dir):
    joined = F.concat(F.translate("p_name", " ", ";"), F.lit(", "), "p_brand", F.lit(" |"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.split_refs(joined).alias("r")).select("p_partkey", F.array_join("r", "/").alias("refs"), F.size("r").cast("long").alias("n"))


IBAN = "'PT' || lpad(cast(s_suppkey % 98 as varchar(10)), 2, '0') || lpad(cast(s_suppkey as varchar(20)), 21, '0')"


@query(f"""with i as (select s_suppkey, {IBAN} as iban from supplier)
 select s_suppkey, cast(substr(iban, 5) || '2529' || substr(iban, 3, 2) as hugeint) % 97 = 1 as valid, length(iban) = 25 and cast(substr(iban, 5) || '2529' || substr(iban, 3, 2) as hugeint) % 97 = 1 as valid_length from i""")
def f7_iban_valid(spark, sf_dir):
    iban = F.concat(F.lit("PT"), F.lpad((F.col("s_suppkey") % 98).cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 21, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.iban_valid(iban).alias("valid"), T.iban_valid(iban, lengths=True).alias("valid_length"))


@query("""select line_id, coalesce(nullif(regexp_extract(upper(description || ' ' || payment_reference), '(PAY-?[0-9]{4,})', 1), ''), '') as found,
 case when length(regexp_replace(upper(payment_reference), '[^A-Z0-9]', '', 'g')) < 4 then '' else upper(trim(payment_reference)) end as reference from lines""")
def f8_extract_reference(spark, sf_dir):
    text = F.concat_ws(" ", "description", "payment_reference")
    return lines(spark, sf_dir).select("line_id", T.extract_strong_reference(text).alias("found"), T.normalize_reference("payment_reference").alias("reference"))


@query("""select l_orderkey, l_linenumber, cast(case when l_linenumber % 3 = 0 then -l_extendedprice else l_extendedprice end as decimal(18,2)) as amount from lineitem""", base=False)
def f9_parse_localized_number(spark, sf_dir):
    """Prices written the continental way, in brackets, or with a minus behind, and read back."""
    plain = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    continental = F.translate(plain, ",.", ".,")
    written = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("("), continental, F.lit(")"))).otherwise(F.concat(plain, F.lit("-")))).otherwise(F.concat(continental, F.lit(" EUR")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.parse_number(written).cast("decimal(18,2)").alias("amount"))


@query("""select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) * case when o_orderstatus = 'F' then -1 else 1 end as decimal(18,2)) as amount from orders""", base=False)
def f10_parse_implied_cents(spark, sf_dir):
    digits = F.lpad((F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("decimal(18,0)").cast("string"), 14, "0")
    sign = F.when(F.col("o_orderstatus") == "F", "D").otherwise("C")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.parse_cents(digits, sign).cast("decimal(18,2)").alias("amount"))


@query("select o_orderkey, cast(o_orderdate as date) as day from orders", base=False)
def f11_parse_date(spark, sf_dir):
    """Order dates written in five ways and read back."""
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).when(k == 3, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.parse_date(written).alias("day"))


@query("""select o_orderkey, cast(case when 2000 + year(o_orderdate) % 100 > 2026 + 50 then 1900 + year(o_orderdate) % 100 else 2000 + year(o_orderdate) % 100 end as int) as year from orders""", base=False)
def f12_expand_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.expand_year(F.year("o_orderdate") % 100, "2026-01-01").alias("year"))


@query("select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') as key from part", base=False)
def f13_header_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.header_key(F.concat_ws(" / ", "p_name", "p_type")).alias("key"))


FACTS = f"'1|' || account_id || '|' || operation_date || '|' || amount || '|' || {NORM.format('payment_reference')}"


@query(f"""with h as (select line_id, account_id, sha256({FACTS} || '|' || {NORM.format("'B-' || line_id")} || '|trf|' || {NORM.format('description')}) as hash, sha256({FACTS} || '|' || {NORM.format('description')}) as legacy from lines)
 select line_id, hash, legacy, sha256('1|' || account_id || '|u' || line_id) as feed, sha256(hash || '|approved|2') as forced, sha256('f1|' || line_id || '|' || hash) as occurrence from h""")
def f14_idempotency_hash(spark, sf_dir):
    """All variants: whole, of an earlier generation, of the feed, of an approved duplicate and of a verified spreadsheet's row."""
    k = F.col("line_id").cast("string")
    facts = (F.lit(1), "account_id", "operation_date", "amount", "payment_reference")
    rows = lines(spark, sf_dir).withColumns({"hash": V.line_hash(*facts, F.concat(F.lit("B-"), k), F.lit("TRF"), "description"), "legacy": V.line_hash(*facts, "description")})
    return rows.select("line_id", "hash", "legacy", V.feed_line_hash(F.lit(1), "account_id", F.concat(F.lit("u"), k)).alias("feed"), V.forced_hash("hash", F.lit(2)).alias("forced"), V.occurrence_hash(F.lit("f1"), "line_id", "hash").alias("occurrence"))


@query("select event_id, sha256('w|' || (user_id % 25 + 1) || '|' || event_id) as uid, sha256(cast(value as decimal(24,2)) || '|' || cast(ts as date) || '|EUR') as financial from events", base=False)
def f16_feed_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", V.feed_uid("w", F.col("user_id") % 25 + 1, "event_id").alias("uid"), V.financial_hash("value", F.col("ts").cast("date"), F.lit("EUR")).alias("financial"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then null else cast(l_extendedprice as decimal(24,8)) end as amount from lineitem", base=False)
def f17_exact_decimal(spark, sf_dir):
    """Decimals as text; every second line has a form that is refused."""
    text = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.exact_decimal(F.when(F.col("l_linenumber") % 2 == 0, F.concat(text, F.lit("e2"))).otherwise(text)).alias("amount"))


@query("""select l_orderkey, l_linenumber, cast(e + t as decimal(24,8)) as added, cast(e - t as decimal(24,8)) as less, cast(e * t as decimal(38,8)) as times, cast(sign(e - 30000) as int) as compared, cast(abs(t - e) as decimal(24,8)) as size, cast(-e as decimal(24,8)) as negated
 from (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(18,2)) as e, cast(l_tax as decimal(18,2)) as t from lineitem)""", base=False)
def f18_decimal_arithmetic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    e, t = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(18,2)")
    return li.select("l_orderkey", "l_linenumber", V.decimal_add(e, t).alias("added"), V.decimal_sub(e, t).alias("less"), V.decimal_mul(e, t).alias("times"), V.decimal_cmp(e, F.lit("30000")).alias("compared"), V.decimal_abs(V.decimal_sub(t, e)).alias("size"), V.decimal_neg(e).alias("negated"))


@query("""select ledger_id, case when ledger_id % 7 in (0, 5) then '' when ledger_id % 3 = 0 then lpad(cast(ledger_id % 100000 as varchar), 6, '0') || '/12345/' || ledger_id % 1000 when ledger_id % 3 = 1 then lpad(cast(ledger_id % 100000 as varchar), 6, '0') || '/' || ledger_id % 1000 else '' end as identity from ledger""")
def f19_tpa_identity(spark, sf_dir):
    """Both shapes, with words that refuse it (whole) and others that only begin like them."""
    k = F.col("ledger_id")
    n, period = F.lpad((k % 100000).cast("string"), 6, "0"), (k % 1000).cast("string")
    base = F.when(k % 3 == 0, F.concat(F.lit("Fecho  TPA "), n, F.lit("/12345/"), period)).when(k % 3 == 1, F.concat(F.lit("FECHO TPA "), n, F.lit(" Período Nº "), period)).otherwise(F.concat(F.lit("TPA "), n))
    tail = F.when(k % 7 == 0, " ESTORNO").when(k % 7 == 5, " Comissão").when(k % 7 == 1, " FEEDBACK ESTORNOS").otherwise("")
    return ledger(spark, sf_dir).select("ledger_id", T.tpa_identity(F.concat(base, tail)).alias("identity"))


@query("select c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') as key from customer", base=False)
def f20_company_key(spark, sf_dir):
    named = F.concat(F.lit("CU12 - "), "c_name", F.lit(" Lda"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.company_key(named).alias("key"))


@query("select line_id, contains(lower(description || ' ' || payment_reference), 'cartao') or contains(lower(description || ' ' || payment_reference), 'trf') as batch_like from lines")
def f22_batch_like(spark, sf_dir):
    return lines(spark, sf_dir).select("line_id", T.is_batch_like(["CARTAO", "trf"], "description", "payment_reference").alias("batch_like"))


@query("select line_id, cast(abs(date_diff('day', booking_date, operation_date)) as int) as days from lines join ledger on ledger_id * 10 = line_id")
def f23_day_distance(spark, sf_dir):
    both = lines(spark, sf_dir).join(ledger(spark, sf_dir).select("ledger_id", "booking_date"), F.col("ledger_id") * 10 == F.col("line_id"))
    return both.select("line_id", V.day_distance("operation_date", "booking_date").alias("days"))


@query("select o_orderkey, o_orderkey % 3 <> 2 as dated from orders", base=False)
def f24_obligation_period(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    label = F.when(k == 0, F.concat(F.lit("IVA "), F.year("o_orderdate").cast("string"))).when(k == 1, F.lit("Segurança social Março")).otherwise("Taxa")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.obligation_period(label).alias("dated"))


@query("""select line_id, contains(' ' || regexp_replace(upper(description), '[^A-Z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(upper(ref), '[^A-Z0-9]+', ' ', 'g') || ' ') as found
 from lines join ledger on ledger_id * 10 = line_id""")
def f25_token_reference(spark, sf_dir):
    both = lines(spark, sf_dir).join(ledger(spark, sf_dir).select("ledger_id", "ref"), F.col("ledger_id") * 10 == F.col("line_id"))
    return both.select("line_id", T.token_reference_in("description", "ref").alias("found"))


@query("select c_custkey, c_name || ' & ' || c_mktsegment as name from customer", base=False)
def f28_html_clean(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.html_clean(F.concat("c_name", F.lit("&nbsp; &amp;amp;  "), "c_mktsegment")).alias("name"))


@query("select year(operation_date) as y, strftime(operation_date, '%Y-%m') as month, cast(count(*) as bigint) as n, min(concat_ws('/', payment_reference, description)) as first from lines group by all")
def f31_sql_functions(spark, sf_dir):
    l = lines(spark, sf_dir)  # noqa: E741
    return l.groupBy(F.year("operation_date").alias("y"), F.date_format("operation_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(F.concat_ws("/", "payment_reference", "description")).alias("first"))
