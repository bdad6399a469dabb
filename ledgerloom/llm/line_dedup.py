"""Lines that many documents hold, dropped but in one of them: levelled sorted runs of line hashes.

The store (``LineRuns``) is a folder of runs. A run is a bucketed, sorted Parquet table with one row a line: its 128-bit hash, how
many documents of the run's batches hold it, and its holder. Each new batch

1. counts its own lines (documents once a line, summed before the shuffle by line),
2. merge-anti-joins the runs: a line that no run has is new and gets a holder, the largest doc_id of the batch that has it; a
   line that a run has keeps the holder of that run, and only its count is new,
3. adds its own run. ``FANOUT`` runs of a level are merged into one of the next, so a line is rewritten once a level.

Runs share buckets, so neither the anti-join nor a compaction shuffles a run. A manifest names the runs and the batches in them; it
is written after the runs are, so a batch that is tried again after a failure counts once, and a store can be opened again later.

``dedup_lines`` feeds documents in ranges of falling doc_id: the first batch that brings a line has its largest doc_id. Lines are
hashed in one scan; the texts are read again only to cut them. Only DataFrame functions are used.

Defined cases: null or empty text is one empty line; a line's key is stripped of ASCII blanks and A-Z are lower-cased; a key of exactly
``MIN_POINTS`` code points, or in exactly ``MIN_DOCS`` documents, is dropped; rows of one doc_id are one document, and all of them keep
the lines that it holds; null doc_ids are not counted and lose nothing; repeated rows give repeated rows; a text of any length is
judged whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqltext import BLANKS, let, lower_ascii
from .store import keep, meet, named, scratch, small

MIN_POINTS, MIN_DOCS = 40, 5
#: Batches that the query makes of the documents; runs of a level that are merged.
BATCHES, FANOUT = 6, 3


class LineRuns:
    """A store of runs at ``root``; an existing one is opened with its own number of buckets."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout, self._tables = spark, root, fanout, {}
        self.version, self.runs, self.batches, self.retired = 0, [], [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        versions = [int(s.getPath().getName()) for s in self._list("manifest") if self._list(f"manifest/{s.getPath().getName()}/_SUCCESS")]
        if versions:
            self.version = max(versions)
            m = json.loads(spark.read.text(f"{root}/manifest/{self.version}").where("value != ''").first()[0])
            self.runs, self.batches, self.retired, self.buckets = [tuple(r) for r in m["runs"]], m["batches"], m["retired"], m["buckets"]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        path, fs = self._path(name)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _commit(self) -> None:
        """Publish the runs as they stand; the version before stays for readers, older ones go."""
        self.version += 1
        text = json.dumps({"runs": self.runs, "batches": self.batches, "retired": self.retired, "buckets": self.buckets})
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{self.version}")
        path, fs = self._path(f"manifest/{self.version - 2}")
        fs.delete(path, True)

    def table(self, name: str) -> DataFrame:
        """A run, with its buckets and order known to the planner."""
        if name not in self._tables:
            self._tables[name] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self._tables[name]} (hi bigint, lo bigint, docs bigint, holder bigint) using parquet clustered by (hi, lo) sorted by (hi, lo) into {self.buckets} buckets location '{self.root}/{name}'")
        return self.spark.table(self._tables[name])

    def _write(self, rows: DataFrame) -> str:
        name, table = f"run-{uuid.uuid4().hex}", f"line_run_{uuid.uuid4().hex}"
        rows.select("hi", "lo", "docs", "holder").write.option("path", f"{self.root}/{name}").option("compression", "zstd").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").saveAsTable(table)
        self._tables[name] = table
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            if name in self._tables:
                self.spark.sql(f"drop table if exists {self._tables.pop(name)}")
            path, fs = self._path(name)
            fs.delete(path, True)

    def add(self, lines: DataFrame, batch: str) -> DataFrame:
        """Add a batch (hi, lo, doc_id; a document may repeat a line); its new lines as (hi, lo, holder). A batch in the store adds nothing."""
        if batch in self.batches:
            return self.spark.range(0).select(*(F.col("id").alias(c) for c in ("hi", "lo", "holder")))
        own = lines.select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder"))
        for k, (_, name) in enumerate(self.runs):
            own = own.join(self.table(name).select("hi", "lo", F.lit(True).alias(f"in_{k}")), ["hi", "lo"], "left")
        known = F.coalesce(*(F.col(f"in_{k}") for k in range(len(self.runs))), F.lit(False))
        name = self._write(own.withColumn("holder", F.when(~known, F.col("holder"))))
        before, self.retired = self.retired, []
        self.runs.append((0, name))
        self.batches.append(batch)
        self._commit()
        self._drop(before)
        fresh = self.table(name).where("holder is not null").select("hi", "lo", "holder")
        self._compact()
        return fresh

    def _merged(self, names: list[str]) -> DataFrame:
        rows = lambda name: self.table(name).where("docs > 0")  # noqa: E731  Spark 4.1 joins the buckets of a union of rows, not of column batches
        both = rows(names[0])
        for name in names[1:]:
            both = both.unionByName(rows(name))
        return both.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def _compact(self) -> None:
        """Merge the runs of every level that is full."""
        level = 0
        while level <= max((k for k, _ in self.runs), default=0):
            names = [n for k, n in self.runs if k == level]
            if len(names) >= self.fanout:
                merged = self._write(self._merged(names))
                self.runs = [r for r in self.runs if r[1] not in names] + [(level + 1, merged)]
                self.retired = self.retired + names  # what the batch's result reads; the next batch deletes them
                self._commit()
            level += 1

    def close(self) -> None:
        """Delete the store."""
        self._drop([*self.retired, *(n for _, n in self.runs)])
        path, fs = self._path("")
        fs.delete(path, True)

    def totals(self) -> DataFrame:
        """Every line of the store: hi, lo, docs, holder."""
        return self._merged([n for _, n in self.runs])


def line_hashes(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """doc_id, copy, place, hi, lo of every line of ``named`` rows whose key has ``least`` code points or more."""
    lines = docs.select("doc_id", "copy", F.posexplode(F.split(lower_ascii(F.coalesce("text", F.lit(""))), "\n")).alias("place", "line"))
    key = F.trim("line", F.lit(BLANKS))
    return lines.where(F.length(key) >= least).select("doc_id", "copy", "place", F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(1), key).alias("lo"))


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Bounds of doc_id that cut the documents into about equal ranges, falling."""
    found = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / batches) for k in range(1, batches))))).first()[0]
    return sorted(set(found or []), reverse=True)


def dedup_lines(docs: DataFrame, least: int = MIN_POINTS, most: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay)."""
    spark, own = docs.sparkSession, named(docs)
    bounds = _bounds(own, batches)
    batch = sum((F.when(F.col("doc_id") <= b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines = keep(line_hashes(own, least).where("doc_id is not null").withColumn("batch", batch.cast("int")), "batch")
    store = LineRuns(spark, scratch(spark), fanout)
    for k in range(len(bounds) + 1):
        store.add(lines.where(F.col("batch") == k), str(k))
    often = keep(store.totals().where(F.col("docs") >= most))
    hits = meet(lines.select("hi", "lo", "doc_id", "copy", "place"), often, ["hi", "lo"], "docs").where("doc_id != holder")
    gone = keep(hits.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("place")).alias("gone")))
    store.close()
    joined = own.join(small(gone), ["doc_id", "copy"], "left")

    def cut(a):
        """The lines between dropped places, run by run."""
        before = F.concat(F.array(F.lit(-1)), F.col("gone"))
        after = F.concat(F.col("gone"), F.array(F.size(a)))
        return F.array_join(F.flatten(F.zip_with(before, after, lambda x, y: F.slice(a, x + 2, y - x - 1))), "\n")

    text = F.coalesce("text", F.lit(""))
    return joined.select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), cut)).alias("text"),
    )


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
