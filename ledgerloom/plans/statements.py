"""Queries of statement parsers: lines are written as files of a format to the shared folder and read back by path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import records, sinks, statements as P
from ..sources.erp import shared_path
from . import views as W
from .registry import query

#: Statements (an account's month) as files; and whole accounts, which are written and read by path.
RANKED = "ranked as (select *, cast(row_number() over (partition by statement_id order by operation_date, line_id) - 1 as int) as rank from lines)"
WHOLE = "ranked as (select *, cast(row_number() over (partition by account_id order by operation_date, line_id) - 1 as int) as rank from lines)"
LINES = f"with {WHOLE} select cast(account_id as varchar) as file, rank, operation_date, amount, cast(line_id as varchar) as reference"


def _ranked(spark, sf_dir, by="statement_id"):
    """All lines with their place in their file: a statement (an account's month) or a whole account."""
    w = Window.partitionBy(by).orderBy("operation_date", "line_id")
    return W.lines(spark, sf_dir).withColumn("rank", F.row_number().over(w) - 1).withColumn("file", F.col(by).cast("string"))


def _held(rows, text, head="", tail=""):
    """(file, content): the files as texts."""
    return P.joined(rows, ["file"], "rank", text, head, tail)


def _written(rows, text, head="", tail=""):
    """The files written to the shared folder, line by line in order; their path."""
    path = shared_path(rows.sparkSession, "statements")
    body = rows.select("file", "rank", text.alias("value"))
    for at, words in ((-1, head.rstrip("\n")), ((1 << 31) - 1, tail.lstrip("\n"))):
        if words:
            body = body.unionByName(rows.select("file").distinct().select("file", F.lit(at).alias("rank"), F.lit(words).alias("value")))
    body.repartition("file").sortWithinPartitions("file", "rank").select("file", "value").write.partitionBy("file").text(path)
    return path


def landed(make, spark, sf_dir, kind=None, **more):
    """What ``make`` writes, a file an account, read again by path: as movements of ``kind``, or as lines."""
    path = make(spark, sf_dir, put=_written, by="account_id", **more)
    rows = records.read_movements(spark, path, kind) if kind else records.read_lines(spark, path)
    return rows.withColumn("file", F.regexp_extract("file", "/file=([^/]*)/", 1))


def _abs():
    return F.abs("amount").cast("string")


def _camt(spark, sf_dir, put=None, by="statement_id"):
    """Namespaced documents of two statements; every third entry has a time instead of a day, every second its details."""
    k = F.col("line_id") / 10
    day = F.when(k % 3 == 0, F.concat(F.lit("<n:DtTm>"), F.col("operation_date").cast("string"), F.lit("T10:00:00</n:DtTm>"))).otherwise(F.concat(F.lit("<n:Dt>"), F.col("operation_date").cast("string"), F.lit("</n:Dt>")))
    side = F.when(F.col("amount") < 0, "Cdtr").otherwise("Dbtr")
    party = F.concat(F.lit("<n:Dbtr><n:Nm>me</n:Nm></n:Dbtr><n:Cdtr><n:Nm>me</n:Nm></n:Cdtr>"))
    other = F.replace(party, F.concat(F.lit("<n:"), side, F.lit("><n:Nm>me")), F.concat(F.lit("<n:"), side, F.lit("><n:Nm>"), F.concat(F.lit("P"), F.col("line_id").cast("string"))))
    details = F.concat(F.lit("<n:NtryDtls><n:TxDtls><n:Refs><n:EndToEndId>E"), F.col("line_id").cast("string"), F.lit("</n:EndToEndId></n:Refs><n:RltdPties>"), other, F.lit("<n:"), side, F.lit("Acct><n:Id><n:IBAN>pt50 0002</n:IBAN></n:Id></n:"), side, F.lit("Acct></n:RltdPties><n:RmtInf><n:Ustrd>more</n:Ustrd></n:RmtInf></n:TxDtls><n:TxDtls><n:Refs><n:EndToEndId>other</n:EndToEndId></n:Refs></n:TxDtls></n:NtryDtls>"))
    entry = F.concat(
        F.lit("<n:Ntry><n:NtryRef>"), F.col("line_id").cast("string"), F.lit("</n:NtryRef><n:Amt Ccy='"), F.when(k % 5 == 0, "usd").otherwise("EUR"), F.lit("'>"), _abs(), F.lit("</n:Amt><n:CdtDbtInd>"), F.when(F.col("amount") < 0, "DBIT").otherwise("CRDT"),
        F.lit("</n:CdtDbtInd><n:BookgDt>"), day, F.lit("</n:BookgDt><n:AcctSvcrRef>S1</n:AcctSvcrRef>"), F.when(k % 2 == 0, details).otherwise(""), F.lit("<n:AddtlNtryInf>"), "description", F.lit("</n:AddtlNtryInf></n:Ntry>"),
        F.when(F.col("rank") == 1, "</n:Stmt><n:Stmt>").otherwise(""))
    return (put or _held)(_ranked(spark, sf_dir, by), entry, "<n:Document xmlns:n='urn:iso:std:iso:20022:tech:xsd:camt.053.001.02'><n:BkToCstmrStmt><n:Stmt>", "</n:Stmt></n:BkToCstmrStmt></n:Document>")


def _ofx(spark, sf_dir, put=None, by="statement_id"):
    block = F.concat(F.lit("<STMTTRN><TRNAMT>"), F.col("amount").cast("string"), F.lit("\n<DTPOSTED>"), F.date_format("operation_date", "yyyyMMdd"), F.lit("120000\n<FITID>"), F.col("line_id").cast("string"), F.lit("\n<MEMO>"), "description", F.lit("\n</STMTTRN>"))
    return (put or _held)(_ranked(spark, sf_dir, by), block, "OFXHEADER:100\n<OFX><CURDEF>EUR\n", "</OFX>")


def _mt940(spark, sf_dir, put=None, by="statement_id"):
    mark = F.when(F.col("amount") < 0, F.when(F.col("line_id") % 2 == 0, "RC").otherwise("D")).otherwise(F.when(F.col("line_id") % 2 == 0, "RD").otherwise("C"))
    line = F.concat(F.lit(":61:"), F.date_format("operation_date", "yyMMdd"), F.date_format("operation_date", "MMdd"), mark, F.replace(_abs(), F.lit("."), F.lit(",")), F.lit("NTRF"), F.col("line_id").cast("string"), F.lit("//BANK\n:86:"), F.substring("description", 1, 9), F.lit("\n"), F.substring("description", 10, 200))
    return (put or _held)(_ranked(spark, sf_dir, by), line, ":20:X\n:60F:C950101EUR0,00\n", "\n:62F:C950101EUR0,00")


def _norma43(spark, sf_dir, put=None, by="statement_id", head="11000000000000000000USD", override=False):
    """Every second movement has its text in the record itself and an IBAN in a continuation; with ``override`` every third its currency."""
    cents = F.lpad((F.abs("amount") * 100).cast("decimal(14,0)").cast("string"), 14, "0")
    day = F.date_format("operation_date", "yyMMdd")
    k = F.col("line_id") / 10
    text = F.when(k % 2 == 0, F.concat("description", F.lit("\n2301PT50000201231234567890154"))).otherwise(F.concat(F.lit("\n2301"), "description"))
    money = F.when((k % 3 == 0) & F.lit(override), F.concat(F.lit("\n2401978"), cents)).otherwise("")
    line = F.concat(F.lit("22        "), day, day, F.lit("99999"), F.when(F.col("amount") < 0, "1").otherwise("2"), cents, F.rpad(F.col("line_id").cast("string"), 10, " "), text, money)
    return (put or _held)(_ranked(spark, sf_dir, by), line, head + "\n", "\n3300000000\n8899999999\n2301late")


def _csv(spark, sf_dir, put=None, by="statement_id"):
    debit, credit = F.when(F.col("amount") < 0, _abs()).otherwise(""), F.when(F.col("amount") >= 0, _abs()).otherwise("")
    line = F.concat_ws(";", F.date_format("operation_date", "dd-MM-yyyy"), F.date_format("operation_date", "dd-MM-yyyy"), "description", F.replace(debit, F.lit("."), F.lit(",")), F.replace(credit, F.lit("."), F.lit(",")), F.col("line_id").cast("string"))
    return (put or _held)(_ranked(spark, sf_dir, by), line, "Data;Valor;Descricao;Debito;Credito;Saldo\n")


@query(LINES + """, case when line_id // 10 % 5 = 0 then 'USD' else 'EUR' end as currency, case when line_id // 10 % 2 = 0 then 'P' || line_id else '' end as counterparty_name, case when line_id // 10 % 2 = 0 then 'PT500002' else '' end as counterparty_iban,
 case when line_id // 10 % 2 = 0 then description || ' more' else description end as description, case when line_id // 10 % 2 = 0 then 'E' || line_id else 'S1' end as payment_reference from ranked""")
def s1_camt053(spark, sf_dir):
    return P.parse_camt(landed(_camt, spark, sf_dir, "camt")).drop("value_date", "line_uid")


@query(f"""with {RANKED}, x as (select *, case when line_id // 10 % 2 = 0 then 'E' || line_id else 'S1' end as p, cast(operation_date as varchar) || case when line_id // 10 % 3 = 0 then 'T10:00:00' else '' end as d from ranked)
 select cast(statement_id as varchar) as file, rank, sha1(rank || '|' || d || '|' || amount || '|' || p || '|' || line_id) as line_uid from x""")
def f15_line_uid(spark, sf_dir):
    return P.parse_camt(_camt(spark, sf_dir)).select("file", "rank", "line_uid")


@query(LINES + ", description from ranked")
def s2_ofx(spark, sf_dir):
    return P.parse_ofx(landed(_ofx, spark, sf_dir, "ofx"))


@query(LINES + ", substr(description, 1, 9) || ' ' || substr(description, 10) as description from ranked")
def s3_mt940(spark, sf_dir):
    return P.parse_mt940(landed(_mt940, spark, sf_dir, "mt940")).drop("value_date")


@query(LINES + ", case when line_id // 10 % 2 = 0 then description || ' PT50000201231234567890154' else description end as description, case when line_id // 10 % 2 = 0 then 'PT50000201231234567890154' else '' end as counterparty_iban, 'USD' as currency from ranked")
def s4_norma43(spark, sf_dir):
    return P.parse_norma43(landed(_norma43, spark, sf_dir, "norma43")).drop("value_date")


@query(LINES + ", case when line_id // 10 % 2 = 0 then description || ' PT50000201231234567890154' else description end as description, case when line_id // 10 % 2 = 0 then 'PT50000201231234567890154' else '' end as counterparty_iban, 'EUR' as currency from ranked")
def s4_norma43_978(spark, sf_dir):
    return P.parse_norma43(landed(_norma43, spark, sf_dir, "norma43", head="11000000000000000000978")).drop("value_date")


@query(LINES + ", case when line_id // 10 % 2 = 0 then description || ' PT50000201231234567890154' else description end as description, case when line_id // 10 % 2 = 0 then 'PT50000201231234567890154' else '' end as counterparty_iban, case when line_id // 10 % 3 = 0 then 'EUR' else 'USD' end as currency from ranked")
def s4_norma43_r24(spark, sf_dir):
    return P.parse_norma43(landed(_norma43, spark, sf_dir, "norma43", override=True)).drop("value_date")


@query(f"with {WHOLE} select cast(account_id as varchar) as file, rank + 1 as rank, operation_date, amount, description, cast(line_id as decimal(18,2)) as running_balance from ranked")
def s11_mapped_rows(spark, sf_dir):
    mapping = {"date": 0, "value": 1, "description": 2, "debit": 3, "credit": 4, "balance": 5}
    return P.parse_mapped(landed(_csv, spark, sf_dir), mapping).drop("value_date")


def _sheet(spark, sf_dir, sep, put=None, by="statement_id"):
    """Eight columns: number, two dates, text, reference, debit, credit, balance."""
    debit, credit = F.when(F.col("amount") < 0, _abs()).otherwise(""), F.when(F.col("amount") >= 0, _abs()).otherwise("")
    day = F.date_format("operation_date", "dd-MM-yyyy")
    line = F.concat_ws(sep, F.col("rank").cast("string"), day, day, F.concat("description", F.lit(" PAY-"), F.lpad(F.col("line_id").cast("string"), 9, "0")), F.lit("x"), debit, credit, F.lit("7.00"))
    return (put or _held)(_ranked(spark, sf_dir, by), line, sep.join(["n", "data", "valor", "texto", "ref", "debito", "credito", "saldo"]) + "\n")


def _all_formats(spark, sf_dir):
    from . import imports as I

    tagged = lambda df, p: df.withColumn("file", F.concat(F.lit(p), "file"))
    n43 = lambda **k: lambda s, d: _norma43(s, d, **k)
    makers = {"ofx": _ofx, "mt940": _mt940, "norma43": n43(), "norma43_978": n43(head="11000000000000000000978"), "norma43_r24": n43(override=True), "csv": _csv, "tabulated": lambda s, d: _sheet(s, d, ";"),
              "tabulated_tsv": lambda s, d: _sheet(s, d, "\t"), "nib_compound": I.nib_files, "consolidated": I.consolidated_files, "bit_recon": I.bit_recon_files, "emc": I.emc_files}
    out = tagged(_camt(spark, sf_dir), "camt053-")
    for name, f in makers.items():
        out = out.unionByName(tagged(f(spark, sf_dir), f"{name}-"))
    return out


@query(f"""with {RANKED}, s as (select statement_id, count(*) as n, count(*) filter (line_id // 10 % 3 = 0) as overrides from ranked group by 1)
 select f || '-' || statement_id as file, case when f in ('nib_compound', 'consolidated') and n < 2 then 'unknown' when f in ('norma43', 'norma43_r24') and overrides * (f = 'norma43_r24')::int = 0 then case when contains(cast(statement_id as varchar), '978') then 'norma43_978' else 'norma43' end
  when f = 'tabulated' and n < 3 then 'csv' when f = 'tabulated_tsv' and n < 3 then 'tsv' else f end as format
 from s, unnest(['camt053', 'ofx', 'mt940', 'norma43', 'norma43_978', 'norma43_r24', 'csv', 'tabulated', 'tabulated_tsv', 'nib_compound', 'consolidated', 'bit_recon', 'emc']) t(f)""")
def s12_detect_format(spark, sf_dir):
    return P.detect_format(_all_formats(spark, sf_dir))


@query(f"with {RANKED} select distinct cast(statement_id as varchar) as file, ';' as delimiter from ranked")
def s13_detect_delimiter(spark, sf_dir):
    return P.detect_delimiter(_csv(spark, sf_dir))


@query("select doc_id, sha256(text) as sha from documents", base=False)
def s14_decode_text(spark, sf_dir):
    """Texts as UTF-8, UTF-8 with mark, and UTF-16 with mark, decoded again."""
    d = W.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    k = F.col("file") % 3
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-16"))
    return P.decode_text(d.select("file", raw.alias("content"))).select(F.col("file").alias("doc_id"), F.sha2("content", 256).alias("sha"))


@query("""with e as (select statement_id, account_id, line_id, operation_date as day, amount, row_number() over (partition by statement_id order by operation_date, line_id) as sequence from lines where statement_id % 5 <> 0)
 select statement_id, account_id, cast(sequence as int) as sequence, line_id, day, amount from e""")
def s16_statement_evidence(spark, sf_dir):
    """Statements as arrays, odd ones newest first; those divisible by five repeat a line and are refused."""
    l = W.lines(spark, sf_dir)  # noqa: E741
    rows = l.select("statement_id", "account_id", F.struct(F.col("operation_date").alias("d"), "line_id", F.col("operation_date").alias("day"), "amount").alias("x"))
    s = rows.groupBy("statement_id", "account_id").agg(F.array_sort(F.collect_list("x")).alias("a"))
    entries = F.transform("a", lambda x: F.struct(x["line_id"].alias("line_id"), x["day"].alias("day"), x["amount"].alias("amount")))
    doubled = F.when(F.col("statement_id") % 5 == 0, F.concat(F.array(entries[0]), entries)).otherwise(entries)
    desc = F.col("statement_id") % 2 == 1
    s = s.select("statement_id", "account_id", F.when(desc, "DESC").otherwise("ASC").alias("direction"), F.when(desc, F.reverse(doubled)).otherwise(doubled).alias("lines"))
    return P.explode_evidence(s)


@query(f"""with {RANKED}, r as (select *, case c.k when 3 then amount < 0 when 4 then amount >= 0 else true end as shown from ranked, (values (0), (1), (2), (3), (4), (5)) c(k) where rank < 220)
 select cast(statement_id as varchar) as file, k as "column", count(*) as filled, count(*) filter (k in (3, 4, 5)) as "numeric", count(*) filter (k < 2 or (k = 5 and line_id between 20000 and 90000)) as dates, count(*) filter (k = 2) as "text", 0 as negative,
  count(*) filter (k in (3, 4, 5)) as positive, 0 as zero, count(*) filter (k in (3, 4, 5)) as non_zero,
  avg(case when k < 2 then 10 when k = 2 then length(description) when k = 5 then length(cast(line_id as varchar)) else length(cast(abs(amount) as varchar)) end) as mean_length from r where shown group by 1, 2""")
def m1_profile_columns(spark, sf_dir):
    return P.profile_columns(_csv(spark, sf_dir), ";")


@query(f"with {RANKED} select cast(statement_id as varchar) as file, sha256('data_valor_descricao_debito_credito_saldo|' || string_agg('6', ',')) as fingerprint from ranked where rank < 5 group by 1")
def m7_layout_fingerprint(spark, sf_dir):
    return P.layout_fingerprint(_csv(spark, sf_dir), ";")


@query("select line_id, case when line_id % 4 = 0 then '''=' || description when line_id % 4 = 1 then '''+' || description else description end as description, cast(amount as varchar) as amount from lines")
def w1_csv_safe(spark, sf_dir):
    risky = F.when(F.col("line_id") % 4 == 0, F.concat(F.lit("="), "description")).when(F.col("line_id") % 4 == 1, F.concat(F.lit("+"), "description")).otherwise(F.col("description"))
    return sinks.safe(W.lines(spark, sf_dir).select("line_id", risky.alias("description"), F.col("amount").cast("string").alias("amount")))
