"""Queries of further statement formats and of line clean-up on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import statements as P
from . import views as W
from .registry import query
from .statements import LINES, RANKED, WHOLE, _abs, _held, _ranked, landed

BARE = f"with {WHOLE} select cast(account_id as varchar) as file, rank, operation_date, amount"


def _cents(n):
    return F.lpad((F.abs("amount") * 100).cast("decimal(18,0)").cast("string"), n, "0")


def nib_files(spark, sf_dir, put=_held, by="statement_id"):
    day = F.date_format("operation_date", "yyMMdd")
    line = F.concat(F.lit("5"), day, day, F.rpad(F.substring("description", 1, 30), 30, " "), F.lit("TRF0001"), F.when(F.col("amount") < 0, "-").otherwise("+"), _cents(15))
    return put(_ranked(spark, sf_dir, by), line)


@query(BARE + ", substr(description, 1, 30) as description, 'TRF' as operation from ranked")
def s5_nib_compound(spark, sf_dir):
    return P.parse_nib_compound(landed(nib_files, spark, sf_dir)).drop("value_date")


def consolidated_files(spark, sf_dir, put=_held, by="statement_id"):
    sign = F.when(F.col("amount") < 0, "-").otherwise("+")
    move = F.concat(sign, _cents(18))
    balance = F.concat(F.lit("+"), F.lpad((F.col("rank").cast("long") * 10000).cast("string"), 18, "0"))
    blocks = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("+000000000000000000"), move, balance)).otherwise(move)
    line = F.concat(F.lit("0300000000  "), F.date_format("operation_date", "yyyyMMdd"), F.lit(" X "), blocks)
    return put(_ranked(spark, sf_dir, by), line)


@query(BARE + ", cast(case when rank % 2 = 0 then rank * 100 end as decimal(18,2)) as running_balance from ranked")
def s6_consolidated(spark, sf_dir):
    return P.parse_consolidated(landed(consolidated_files, spark, sf_dir)).drop("value_date")


def bit_recon_files(spark, sf_dir, put=_held, by="statement_id"):
    side = F.when(F.col("amount") < 0, "D").otherwise("C")
    line = F.concat(F.date_format("operation_date", "yyyyMMdd"), F.lit(" "), "description", F.lit(" "), F.translate(_abs(), ".", ","), side, F.lit(" "), F.col("rank").cast("string"), F.lit(",00D"))
    return put(_ranked(spark, sf_dir, by), line)


@query(BARE + ", cast(-rank as decimal(18,2)) as running_balance, description from ranked")
def s7_bit_recon(spark, sf_dir):
    return P.parse_bit_recon(landed(bit_recon_files, spark, sf_dir))


def emc_files(spark, sf_dir, put=_held, by="statement_id"):
    pair = F.when(F.col("amount") < 0, F.when(F.col("rank") % 2 == 0, "CD").otherwise("DD")).otherwise("CC")
    line = F.concat(F.lit("EMC23"), F.date_format("operation_date", "yyyyMMdd"), pair, _cents(16), "description")
    return put(_ranked(spark, sf_dir, by), line, "EMC13EUR\n")


@query(BARE + ", 'EUR' as currency, description from ranked")
def s8_emc(spark, sf_dir):
    return P.parse_emc(landed(emc_files, spark, sf_dir))


@query("select line_id, cast(sign(amount) as int) as direction, operation_date, case when line_id % 4 = 0 then 'USD' else 'EUR' end as currency, sha1(line_id || '|' || operation_date || '|' || amount || '|' || description) as line_uid from lines")
def f27_normalize_line(spark, sf_dir):
    """Every third line has only a value date, most have no currency."""
    l = W.lines(spark, sf_dir).withColumn("rank", F.col("line_id")).withColumn("value_date", F.when(F.col("line_id") % 3 == 0, F.col("operation_date")))  # noqa: E741
    l = l.withColumn("operation_date", F.when(F.col("line_id") % 3 != 0, F.col("operation_date"))).withColumn("currency", F.when(F.col("line_id") % 4 == 0, "USD").when(F.col("line_id") % 4 == 1, ""))  # noqa: E741
    return P.normalize_lines(l, "EUR").select("line_id", "direction", "operation_date", "currency", "line_uid")


@query("""with s as (select line_id, amount, line_id % 90 as n, line_id % 3 = 0 as odd from lines)
 select line_id, case when w then cast(n + 0.5 as decimal(18,2)) else amount end as amount, case when w then amount end as running_balance from (select *, odd and abs(amount) >= 100 and (n + 0.5) * 5 <= abs(amount) as w from s)""")
def f26_repair_balance(spark, sf_dir):
    l = W.lines(spark, sf_dir).withColumn("description", F.when(F.col("line_id") % 3 == 0, F.concat((F.col("line_id") % 90).cast("string"), F.lit(",50"))).otherwise(F.col("description")))  # noqa: E741
    return P.repair_balance(l).select("line_id", "amount", "running_balance")


@query(f"with {RANKED} select cast(statement_id as varchar) as file, rank, operation_date, amount, cast(line_id as varchar) as reference from ranked")
def v7_line_rank(spark, sf_dir):
    """Every line keeps its place in its file."""
    text = F.concat_ws("|", F.col("operation_date").cast("string"), F.col("amount").cast("string"), F.col("line_id").cast("string"))
    rows = P.file_lines(P.joined(_ranked(spark, sf_dir), ["file"], "rank", text)).withColumn("c", F.split("line", "[|]"))
    return rows.select("file", "rank", F.col("c")[0].cast("date").alias("operation_date"), F.col("c")[1].cast(W.MONEY).alias("amount"), F.col("c")[2].alias("reference"))
