"""Tables of the accounting system, landed feed pages, and the shared folder for what a job writes on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What an accounting system is read as.
TABLES = ("accounts", "ledger", "links", "payments", "invoices", "parties", "obligations")


def scan_erp_tables(spark: SparkSession, source: str | dict[str, str], names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables by name: Parquet folders below a path, or over JDBC with the given options (url, user, partitionColumn ...)."""
    if isinstance(source, str):
        return {n: spark.read.parquet(f"{source.rstrip('/')}/{n}.parquet") for n in names}
    return {n: spark.read.format("jdbc").options(**source, dbtable=n).load() for n in names}


def read_feed_pages(spark: SparkSession, path: str, schema: StructType | str, watermark: str | None = None, overlap: str = "48 hours", updated: str = "updated_at") -> DataFrame:
    """Transactions of landed provider pages (JSON objects with an array ``data``): those updated since ``overlap`` before the watermark,
    each with the page it came from."""
    inner = schema if isinstance(schema, str) else schema.simpleString()
    pages = spark.read.schema(f"data array<struct<{inner}>>").json(path)
    rows = pages.select(F.input_file_name().alias("page"), F.explode("data").alias("t")).select("page", "t.*")
    if watermark is None:
        return rows
    return rows.where(F.col(updated).cast("timestamp") >= F.lit(watermark).cast("timestamp") - F.expr(f"interval {overlap}"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``; below a temporary one where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        root = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pages_of(rows: DataFrame, size: int, key: Column) -> DataFrame:
    """Rows as provider pages of at most ``size``: (data), dealt by ``key``."""
    page = F.floor(key / size)
    return rows.groupBy(page.alias("page")).agg(F.collect_list(F.struct(*rows.columns)).alias("data")).select("data")
