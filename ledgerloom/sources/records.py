"""Statement files read by path, in splits: a large file is read by many tasks, and rows know their place in it.

Spark's text source cuts a file at byte ranges and aligns them on a separator. Where the separator is what opens a movement
(``<STMTTRN>``, ``:61:``, register 22, the end of an entry's tag), each row is a whole movement, whichever split it starts in.
What depends on rows before is carried in two steps: within a split by a window, from split to split by the few rows that the splits come
down to. No task orders a whole file.

Separators are found as bytes, so files are UTF-8 or one of the single-byte sets; files in UTF-16 are read whole (``statements.read_files``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What opens a movement, by format; lines elsewhere.
SEPARATORS = {"camt": "Ntry>", "ofx": "<STMTTRN>", "mt940": "\n:61:", "norma43": "\n22"}


def _text(raw: Column) -> Column:
    """Bytes of the source as text: UTF-8 where valid, else Latin-1; without a mark."""
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _rows(spark: SparkSession, path: str, separator: str | None) -> DataFrame:
    """(file, block, at, value): ``block`` is the first byte of the split, ``at`` ascends within it."""
    read = spark.read.option("lineSep", separator) if separator else spark.read
    rows = read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), _text(F.col("value")).alias("value"))
    return rows


def _blocks(rows: DataFrame) -> DataFrame:
    """file, block, _first (``at`` of its first row), _before (rows of the file in earlier blocks)."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    return counts.select("file", "block", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def placed(rows: DataFrame) -> DataFrame:
    """``rank``, the row's place in its file from 0, of rows whose ``at`` ascends by one within a split."""
    return rows.join(_blocks(rows), ["file", "block"]).withColumn("rank", (F.col("_before") + F.col("at") - F.col("_first")).cast("int")).drop("_first", "_before")


def numbered(rows: DataFrame) -> DataFrame:
    """``rank`` counted anew from 0 among the rows that are left, in their order; rows without ``block`` are those of files held whole."""
    if "block" not in rows.columns:
        return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("file").orderBy("rank")) - 1).cast("int"))
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("rank")))
    return placed(own.drop("rank")).drop("at")


def carried(rows: DataFrame, order: str, value: Column, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``carried``: the last non-null ``value`` of the file up to the row (or before it)."""
    rows = rows.withColumn("_v", value)
    by = ["file", "block"] if "block" in rows.columns else ["file"]
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumn("carried", F.last("_v", ignorenulls=True).over(w))
    if len(by) == 1:
        return out.drop("_v")
    lasts = rows.groupBy("file", "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_l"))
    before = F.last("_l", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return out.join(lasts.select("file", "block", before.alias("_b")), ["file", "block"], "left").withColumn("carried", F.coalesce("carried", "_b")).drop("_v", "_b")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, rank, line) of the files under ``path``."""
    return placed(_rows(spark, path, None)).select("file", "block", "rank", F.regexp_replace("value", "\r$", "").alias("line"))


def read_movements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, block, rank, piece): the file cut where ``kind`` opens a movement; each piece but a file's first starts after that mark."""
    rows = placed(_rows(spark, path, SEPARATORS[kind]))
    return rows.select("file", "block", "rank", F.rtrim("value", F.lit("\r")).alias("piece"))
