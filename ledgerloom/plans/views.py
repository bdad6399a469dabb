"""The bank view of the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

CTE = """
with accounts as (
  select cast(n_nationkey + 1 as bigint) as account_id, cast(n_regionkey + 1 as bigint) as entity, 'EUR' as currency, n_name as label,
         n_nationkey = 24 as closed, n_nationkey % 7 <> 6 as reconcilable
  from nation),
ledger as (
  select cast(o_orderkey as bigint) as ledger_id, cast(c_nationkey + 1 as bigint) as account_id, cast(o_orderdate as date) as booking_date,
         cast(cast(o_totalprice as decimal(18,2)) * (case when o_orderstatus = 'F' then -1 else 1 end) as decimal(18,2)) as amount,
         'PAY-' || lpad(cast(o_orderkey as varchar(20)), 8, '0') as ref, c_name as counterparty, o_orderkey % 4 = 0 as reconciled,
         cast(o_custkey as bigint) as party_id
  from orders join customer on o_custkey = c_custkey),
lines as (
  select cast(ledger_id * 10 as bigint) as line_id, account_id, cast(booking_date + cast(ledger_id % 5 - 2 as int) as date) as operation_date,
         cast(amount + (case when ledger_id % 37 = 0 then 0.01 else 0.00 end) as decimal(18,2)) as amount,
         case when ledger_id % 3 = 0 then ref || '-E1234567' else '' end as payment_reference,
         case when ledger_id % 2 = 0 then counterparty else '' end as counterparty_name,
         case when ledger_id % 5 = 0 then 'TRF PARA ' || counterparty when ledger_id % 5 = 1 then 'CARTAO ' || ref else 'Pagamento ' || counterparty end as description,
         cast(case when reconciled then 2 when ledger_id % 29 = 0 then 3 else 0 end as int) as status,
         case when reconciled then ledger_id end as linked_ledger_id,
         cast(account_id * 100000 + year(booking_date) * 12 + month(booking_date) as bigint) as statement_id
  from ledger where ledger_id % 10 <> 0),
openings as (
  select account_id, date '1995-01-01' as start_date, 'EUR' as currency from accounts where account_id % 2 = 1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        (F.col("n_nationkey") + 1).cast("long").alias("account_id"),
        (F.col("n_regionkey") + 1).cast("long").alias("entity"),
        F.lit("EUR").alias("currency"),
        F.col("n_name").alias("label"),
        (F.col("n_nationkey") == 24).alias("closed"),
        (F.col("n_nationkey") % 7 != 6).alias("reconcilable"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("long").alias("ledger_id"),
        (F.col("c_nationkey") + 1).cast("long").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("booking_date"),
        (F.col("o_totalprice").cast(MONEY) * sign).cast(MONEY).alias("amount"),
        F.concat(F.lit("PAY-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("ref"),
        F.col("c_name").alias("counterparty"),
        (F.col("o_orderkey") % 4 == 0).alias("reconciled"),
        F.col("o_custkey").cast("long").alias("party_id"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ledger_id")
    named = F.when(k % 5 == 0, F.concat(F.lit("TRF PARA "), "counterparty")).when(k % 5 == 1, F.concat(F.lit("CARTAO "), "ref")).otherwise(F.concat(F.lit("Pagamento "), "counterparty"))
    return ledger(spark, sf_dir).where("ledger_id % 10 <> 0").select(
        (k * 10).alias("line_id"),
        "account_id",
        F.date_add("booking_date", (k % 5 - 2).cast("int")).alias("operation_date"),
        (F.col("amount") + F.when(k % 37 == 0, F.lit("0.01").cast(MONEY)).otherwise(F.lit("0.00").cast(MONEY))).cast(MONEY).alias("amount"),
        F.when(k % 3 == 0, F.concat("ref", F.lit("-E1234567"))).otherwise("").alias("payment_reference"),
        F.when(k % 2 == 0, F.col("counterparty")).otherwise("").alias("counterparty_name"),
        named.alias("description"),
        F.when(F.col("reconciled"), 2).when(k % 29 == 0, 3).otherwise(0).cast("int").alias("status"),
        F.when(F.col("reconciled"), k).alias("linked_ledger_id"),
        (F.col("account_id") * 100000 + F.year("booking_date") * 12 + F.month("booking_date")).cast("long").alias("statement_id"),
    )


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).where("account_id % 2 = 1").select("account_id", F.lit("1995-01-01").cast("date").alias("start_date"), "currency")
