"""Queries of column roles in unknown files: statements are written in three layouts and read without being told which."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import layouts as L
from ..sources import statements as P
from ..sources.context_dates import resolve_dates
from . import views as W
from .registry import query
from .statements import RANKED, WHOLE, _held, _ranked, _sheet, landed

#: Layout 0 has known headings, 1 two lines ahead of unknown headings, 2 no headings.
HEADS = ("Data Mov.;Data Valor;Descrição;Débito;Crédito;Saldo\n", "Extrato;X\nConta;123\nFecha;Posting;Texto;Importe;Controlo\n", "")


def layout_files(spark, sf_dir, only=None, put=_held, by="statement_id"):
    """One file a statement, in the layout of its number (or all in ``only``)."""
    day, comma = F.date_format("operation_date", "dd-MM-yyyy"), lambda c: F.replace(c, F.lit("."), F.lit(","))
    money, next_ = comma(F.col("amount").cast("string")), (F.col("rank") + 1).cast("string")
    split = [F.when(c, money).otherwise("0,00") for c in (F.col("amount") < 0, F.col("amount") >= 0)]
    text = (F.concat_ws(";", day, day, "description", *split, next_), F.concat_ws(";", day, day, "description", money, next_), F.concat_ws(";", F.col("rank").cast("string"), day, day, "description", money, next_))
    kind = F.lit(only) if only is not None else F.col("statement_id") % 3
    pick = lambda xs: F.when(kind == 0, xs[0]).when(kind == 1, xs[1]).otherwise(xs[2])
    rows = _ranked(spark, sf_dir, by).withColumns({"t": pick(text), "h": pick([F.lit(h) for h in HEADS])})
    return put(rows, F.concat(F.when(F.col("rank") == 0, F.col("h")).otherwise(""), F.col("t")))


@query("select cast(statement_id as varchar) as file, cast(case statement_id % 3 when 0 then 0 when 1 then 2 else -1 end as int) as header_row from (select distinct statement_id from lines)")
def m2_header_row(spark, sf_dir):
    return L.guess_header_row(layout_files(spark, sf_dir), ";")


@query("select cast(statement_id as varchar) as file, f as field, cast(c as int) as \"column\" from (select distinct statement_id from lines), (values ('operation_date', 0), ('value_date', 1), ('description', 2), ('debit', 3), ('credit', 4), ('running_balance', 5)) t(f, c) where statement_id % 3 = 0")
def m3_map_by_alias(spark, sf_dir):
    files = layout_files(spark, sf_dir)
    return L.map_by_alias(L.headings(files, ";", L.guess_header_row(files, ";")))


PATTERN = """select cast(statement_id as varchar) as file, f as field, cast(c as int) as "column" from (select distinct statement_id from lines) s, (values (0, 'operation_date', 0), (0, 'value_date', 1), (0, 'description', 2), (0, 'debit', 3), (0, 'credit', 4), (0, 'running_balance', 5),
 (1, 'operation_date', 0), (1, 'value_date', 1), (1, 'description', 2), (1, 'amount', 3), (1, 'running_balance', 4)) t(k, f, c) where statement_id % 3 = k"""


@query(PATTERN)
def m4_map_by_header_pattern(spark, sf_dir):
    files = layout_files(spark, sf_dir)
    header = L.guess_header_row(files, ";")
    return L.map_by_header_pattern(L.column_facts(files, ";", header), L.map_by_alias(L.headings(files, ";", header)))


@query("""with s as (select statement_id, statement_id % 3 as k, least(count(*), 220) as n, count(*) filter (amount < 0) as d, count(*) filter (amount >= 0) as c from lines group by 1),
 m as (select *, greatest(1, floor(0.15 * n)) as z, n >= 3 as many from s),
 r as (select statement_id, case when k < 2 then 0 when many then 2 end as operation_date, case when k < 2 then (case when many then 1 else 0 end) when many then 1 end as value_date, case when k < 2 then 2 when many then 3 end as description,
  case when not many then null when k = 0 then (case when d >= 2 then 3 else 5 end) when k = 1 then 3 when d >= 1 then 4 else 5 end as amount,
  case when k = 0 and many and d >= 2 and c >= z then 3 end as debit, case when k = 0 and many and c >= 2 and d >= z then 4 when k = 2 and many and z <= 1 then 0 end as credit,
  case when k = 0 then 5 when k = 1 then 4 when not many then null when d >= 1 then 5 else 4 end as running_balance from m)
 select cast(statement_id as varchar) as file, field, cast(c as int) as "column" from r unpivot (c for field in (operation_date, value_date, description, amount, debit, credit, running_balance))""")
def m4_map_columns(spark, sf_dir):
    """Alias, heading words and content together; short files cannot tell by content."""
    return L.map_columns(layout_files(spark, sf_dir), ";")


def learned(spark, sf_dir):
    """Headings of a bank that no alias knows; approved mappings of earlier files are the examples."""
    heads = W.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"), F.posexplode(F.split(F.concat(F.lit("dia_de_lancamento,fecha_valor,detalle_operacion,importe_total_"), F.col("s_nationkey").cast("string")), ",")).alias("column", "key"))
    examples = [("operation_date", "dia_lancamento"), ("value_date", "fecha_valor"), ("description", "detalle_operaciones"), ("amount", "importe_total"), ("running_balance", "saldo_final"), ("currency", "divisa_cuenta"), ("debit", "cargo_total"), ("credit", "abono_total")]
    known = heads.sparkSession.createDataFrame(examples, "field string, key string")
    return heads, known


@query()
def m5_learned_headers(spark, sf_dir):
    """No SQL: the likeness is a recursive text measure; tested against plain code."""
    heads, known = learned(spark, sf_dir)
    none = heads.where("false").select("file", F.lit("").alias("field"), "column")
    return L.map_by_learned_header(heads, none, known)


DATES = """cells as (select cast(statement_id as varchar) as file, rank, operation_date as d, case when rank % 8 = 0 then 'iso' when rank % 8 in (1, 4) then 'short' when rank % 8 in (3, 7) then 'month' else 'day' end as k, day(operation_date) as dd, month(operation_date) as mm, year(operation_date) as yy from ranked),
 facts as (select *, k in ('day', 'month') and dd <= 12 and dd <> mm as either, case when k = 'month' and dd <= 12 and dd <> mm then make_date(yy, dd, mm) when k <> 'short' then d end as plain,
  case when k in ('day', 'month') and dd <= 12 then (case when k = 'month' then d else make_date(yy, dd, mm) end) end as swapped from cells)"""


@query(f"""with recursive {RANKED}, {DATES}, r as (select file, rank, plain as date, plain as c from facts where rank = 0 union all
  select file, rank, date, coalesce(date, c) from (select f.file, f.rank, r.c, case when k = 'short' then (select x from (select try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', cast(year(r.c) + i as int), mm, dd) as date) as x from (values (-1), (0), (1)) t(i)) where x is not null order by abs(date_diff('day', r.c, x)), x limit 1)
   when either and abs(date_diff('day', r.c, swapped)) < abs(date_diff('day', r.c, plain)) then swapped else plain end as date from r join facts f on f.file = r.file and f.rank = r.rank + 1))
 select file, 0 as "column", rank, date from r""")
def m6_context_dates(spark, sf_dir):
    """ISO days, days without a year, day first and month first, mixed in one column; what is resolved decides what follows."""
    k, d = F.col("rank") % 8, F.col("operation_date")
    form = lambda f: F.date_format(d, f)
    cell = F.when(k == 0, form("yyyy-MM-dd")).when(k.isin(1, 4), form("dd/MM")).when(k.isin(3, 7), form("MM/dd/yyyy")).otherwise(form("dd/MM/yyyy"))
    return resolve_dates(_ranked(spark, sf_dir).select("file", F.lit(0).alias("column"), "rank", cell.alias("cell")))


@query("""with f as (select distinct statement_id, account_id, 'f' || statement_id % 97 as fp, 's' || statement_id % 13 as sg from lines),
 p as (select s_suppkey as profile_id, case when s_suppkey % 3 = 0 then null else s_nationkey + 1 end as owner, 'f' || s_suppkey % 97 as fp, 's' || s_suppkey % 13 as sg, s_suppkey * 7 % 1000 as saved from supplier),
 may as (select statement_id, profile_id, 0 as tier, owner, saved from f join p using (fp) where owner is null or owner = account_id union all select statement_id, profile_id, 1, owner, saved from f join p using (sg) where owner is null or owner = account_id),
 r as (select *, row_number() over (partition by statement_id order by tier, owner is null, saved desc, profile_id desc) as k from may)
 select cast(statement_id as varchar) as file, profile_id from r where k = 1""")
def m8_best_profile(spark, sf_dir):
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    f = W.lines(spark, sf_dir).select("statement_id", "account_id").distinct().select(F.col("statement_id").cast("string").alias("file"), "account_id", name("f", "statement_id", 97).alias("fingerprint"), name("s", "statement_id", 13).alias("signature"))
    p = W.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") + 1).alias("account_id"), name("f", "s_suppkey", 97).alias("fingerprint"), name("s", "s_suppkey", 13).alias("signature"), (F.col("s_suppkey") * 7 % 1000).alias("saved"))
    return L.best_profile(f, p)


@query("""with s as (select statement_id, statement_id % 7 as k, count(*) as n, count(*) filter (line_id // 10 % 2 = 0) as half, count(*) filter (abs(amount) > 100000 and (statement_id % 7 <> 3 or line_id // 10 % 2 = 0)) as big from lines group by 1)
 select cast(statement_id as varchar) as file, case when n < 3 then 'few_lines' when k = 1 then 'amount_is_text' when k = 2 then 'date_is_text' when k = 3 and half < 0.6 * n then 'few_amounts' when k = 4 and half < 0.4 * n then 'few_descriptions' when k = 5 then 'no_dates'
  when big > 0 then 'huge_amounts' else 'ok' end as verdict from s""")
def m9_mapping_quality(spark, sf_dir):
    """By statement: amounts that are words, dates that are words, amounts or texts in part of the lines, no dates, huge amounts."""
    k, even = F.col("statement_id") % 7, F.col("line_id") / 10 % 2 == 0
    rows = W.lines(spark, sf_dir).select(
        F.col("statement_id").cast("string").alias("file"), F.when(k == 1, "abc").otherwise(F.col("amount").cast("string")).alias("raw_amount"), F.when(k == 2, "soon").otherwise(F.col("operation_date").cast("string")).alias("raw_date"),
        F.when(k != 5, F.col("operation_date")).alias("operation_date"), F.when((k != 3) | even, F.col("amount")).alias("amount"), F.when((k != 4) | even, F.col("description")).otherwise("").alias("description"))
    return L.mapping_quality(rows, "100000.01")


@query("""select distinct 'description' as field, 'h' || s_nationkey || '_texto' as key from supplier union select 'amount', 'montante' """)
def m10_header_examples(spark, sf_dir):
    heads = W.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.lit(2).alias("column"), F.concat(F.lit("h"), F.col("s_nationkey").cast("string"), F.lit("_texto")).alias("key"))
    known = spark.createDataFrame([("amount", "montante")], "field string, key string")
    return L.header_examples(heads, heads.select("file", F.lit("description").alias("field"), "column"), known)


@query(f"with {WHOLE}, s as (select account_id from lines group by 1 having count(*) >= 5) select cast(account_id as varchar) as file, rank, operation_date, operation_date as value_date, amount, description || ' PAY-' || lpad(cast(line_id as varchar), 9, '0') as description, 'PAY-' || case when line_id // 10 % 5 = 1 then lpad(cast(line_id // 10 as varchar), 8, '0') else lpad(cast(line_id as varchar), 9, '0') end as reference, cast(7 as decimal(18,2)) as running_balance from ranked semi join s using (account_id)")
def s9_tabulated(spark, sf_dir):
    """Files of fewer than five rows are not known to be of this format."""
    return L.parse_tabulated(landed(_sheet, spark, sf_dir, sep="\t").where("rank > 0").withColumn("rank", F.col("rank") - 1), "\t")


@query(f"with {WHOLE} select cast(account_id as varchar) as file, rank + 1 as rank, operation_date, operation_date as value_date, amount, description, cast(rank + 1 as decimal(18,2)) as running_balance from ranked")
def s10_csv_aliased(spark, sf_dir):
    return L.parse_csv_aliased(landed(layout_files, spark, sf_dir, only=0), ";")



