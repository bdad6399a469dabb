"""Shared-folder tables: cut lineage by writing a table every executor can read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path under the folder in ``spark.checkpoint.dir``; a temporary folder where that is unset and the master local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        root = "file://" + tempfile.mkdtemp(prefix="spark-ll-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ll-{uuid.uuid4().hex}"


#: What Arrow hands to Python at once, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB: whole texts are large rows, and Spark's default of 10,000 rows a batch is held several times over.

    A bound that the user has set stays.
    """
    for key, default, value in (("maxRecordsPerBatch", (None, "10000"), BATCH_ROWS), ("maxBytesPerBatch", (None,), BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in default:
            spark.conf.set(key, str(value))


def keep(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` once (in folders by ``parts``, its last columns) and return the table read back: later jobs survive lost executors
    without recomputing it.

    Results read the tables lazily, so an operator leaves them below ``spark.checkpoint.dir``; who keeps its result can do so in
    ``only_last``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch(spark)
    df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    for made in _SCOPES:
        made.append(table)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def only_last() -> Iterator[None]:
    """Of the tables kept inside, leave the last one: for work whose result is kept itself."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
    forget(*made[:-1])


#: Bytes (values and 32 a row for the hash table) that are broadcast at most.
BROADCAST_BYTES = 64 << 20
_FIXED = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` (written, so measuring is cheap) marked for broadcast if it has at most ``most`` bytes; else joined by shuffle."""
    return F.broadcast(table) if measured(table) <= most else table


def measured(table: DataFrame) -> int:
    """Bytes of a written table's values, and 32 a row."""
    fixed = 32 + sum(_FIXED.get(t, 0) for _, t in table.dtypes)
    wide = [c for c, t in table.dtypes if t not in _FIXED]
    own = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in wide), F.lit(fixed).cast("long"))
    return table.agg(F.sum(own)).first()[0] or 0


#: Rows of one key that a task joins; more are dealt out.
EACH = 20_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], members: str, each: int = EACH) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``members`` how many rows of ``left`` have it.

    Keys of over ``each`` rows are dealt over several tasks by a salt; there are at most rows / ``each`` such keys.
    """
    hot = small(keep(right.where(F.col(members) > each).select(*keys, F.ceil(F.col(members) / each).cast("int").alias("__salts"))))
    mine = left.join(hot, keys, "left")
    others = [F.col(c) for c in left.columns if c not in keys]
    mine = mine.withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("__salts"))).cast("int")).drop("__salts")
    salts = F.greatest(F.lit(1), F.when(F.col(members) > each, F.ceil(F.col(members) / each)).otherwise(1)).cast("int")
    theirs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return mine.join(theirs, [*keys, "__salt"]).drop("__salt")


def meet(left: DataFrame, right: DataFrame, keys: list[str], members: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` joined with ``right`` (written; one row a key, in ``members`` how many rows of ``left`` have it): broadcast where it has at
    most ``most`` bytes, else a shuffle join whose hot keys are dealt out."""
    return left.join(F.broadcast(right), keys) if measured(right) <= most else spread_join(left, right, keys, members)


def named(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), ``copy`` (hash of the text, which tells rows of one doc_id apart), text and ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text", *more)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, nth, text of ``named`` rows without null doc_ids; ``nth`` tells rows of one doc_id and other texts apart: 0 for all rows of
    almost every doc_id, so it costs nothing to carry."""
    several = docs.groupBy("doc_id").agg(F.min("copy").alias("a"), F.max("copy").alias("b")).where("a < b").select("doc_id")
    again = keep(docs.select("doc_id", "copy").join(small(keep(several)), "doc_id", "left_semi").distinct())
    place = again.groupBy("doc_id").agg(F.array_sort(F.collect_set("copy")).alias("copies")).select("doc_id", F.posexplode("copies").alias("nth", "copy"))
    out = docs.join(small(keep(place.where("nth > 0"))), ["doc_id", "copy"], "left")
    return out.withColumn("nth", F.coalesce("nth", F.lit(0)).cast("int"))


def on_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where doc_id (null equals null) and copy agree."""
    right = right.withColumnRenamed("doc_id", "__doc_id").withColumnRenamed("copy", "__copy")
    same = left["doc_id"].eqNullSafe(right["__doc_id"]) & (left["copy"] == right["__copy"])
    return left.join(right, same, how).drop("__doc_id", "__copy")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text (``copy``) are in ``rows``; without ``copy``, whose doc_id is."""
    names = [c for c in ("doc_id", "copy") if c in rows.columns]
    gone = small(keep(rows.select(*(F.col(c).alias(f"__{c}") for c in names)).distinct()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    if "copy" in names:
        same &= F.xxhash64("text") == F.col("__copy")
    return docs.join(gone, same, "left_anti")
