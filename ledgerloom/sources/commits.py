"""Tables that change by committed batches: a log of versions, appends that count once, and a keyed snapshot of base and changes.

A version is a small JSON file that names the folders of the table; it is written beside its place and moved there, which fails if
another writer was first. Folders are written before the version that names them, so a job that stops on the way leaves the last version
as it was, and a batch that is run again finds its number and adds nothing. Readers go by the newest version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of a level that are merged into one of the next.
FANOUT = 4


class CommitLog:
    """Versions below ``root``/log. ``state`` is what the newest one says."""

    def __init__(self, spark: SparkSession, root: str, empty: dict):
        self.spark, self.root, self._empty = spark, root.rstrip("/"), empty
        self.refresh()

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs("log")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def refresh(self) -> None:
        found = self.versions()
        self.version = found[-1] if found else -1
        self.state = json.loads(json.dumps(self._empty))
        if found:
            path, fs = self._fs(f"log/{self.version}.json")
            stream = fs.open(path)
            self.state = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()

    def commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Publish ``change`` of the newest state (none: nothing to do); tried again on what another writer published first."""
        while True:
            self.refresh()
            after = change(json.loads(json.dumps(self.state)))
            if after is None:
                return False
            temp, fs = self._fs(f"log/.{uuid.uuid4().hex}")
            stream = fs.create(temp, False)
            stream.write(json.dumps(after).encode())
            stream.close()
            place, _ = self._fs(f"log/{self.version + 1}.json")
            rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
            try:
                files.rename(fs.makeQualified(temp), fs.makeQualified(place), self.spark._sc._gateway.new_array(rename, 0))
            except Exception:
                fs.delete(temp, False)
                if not fs.exists(place):
                    raise
                continue
            self.refresh()
            return True

    def delete(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)


class Appended:
    """A table of appended batches; a batch id counts once."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root, {"batches": {}})

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add a batch; false where its id is there already."""
        self.log.refresh()
        if batch in self.log.state["batches"]:
            return False
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.log.root}/{name}")

        def add(state: dict) -> dict | None:
            return None if batch in state["batches"] else state | {"batches": state["batches"] | {batch: name}}

        if not self.log.commit(add):
            self.log.delete(name)  # the same batch was committed meanwhile
            return False
        return True

    def read(self, schema) -> DataFrame:
        self.log.refresh()
        paths = [f"{self.log.root}/{n}" for n in self.log.state["batches"].values()]
        return self.log.spark.read.schema(schema).parquet(*paths) if paths else self.log.spark.createDataFrame([], schema)


class KeyedState:
    """The newest row of each key: runs of changed rows in folders by ``bucket`` of the key, newer runs before older ones.

    A batch reads only the buckets of its keys and writes only the rows it changes. ``FANOUT`` runs of a level become one of the
    next level, so a row is rewritten once a level. Folders that the newest two versions do not name are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema, buckets: int = 64):
        self.log = CommitLog(spark, root, {"runs": [], "batches": [], "buckets": buckets, "notes": {}, "retired": []})
        self.spark, self.key, self.schema = spark, key, schema
        self.buckets = self.log.state["buckets"]

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _runs(self, names: list[str]) -> DataFrame:
        """Rows of the runs with ``_age``: 0 for the newest."""
        out = None
        for age, name in enumerate(reversed(names)):
            run = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.log.root}/{name}").withColumn("_age", F.lit(age))
            out = run if out is None else out.unionByName(run)
        return out

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (self.key, "bucket", "_age")]
        best = rows.groupBy(self.key).agg(F.min_by(F.struct(*others), "_age").alias("_r"))
        return best.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in others])

    def snapshot(self) -> DataFrame:
        """All keys as the last committed batch left them."""
        self.log.refresh()
        names = [n for _, n in self.log.state["runs"]]
        return self._newest(self._runs(names)) if names else self.spark.createDataFrame([], self.schema)

    def rows_of(self, batch: DataFrame) -> DataFrame:
        """The state's rows of the batch's keys; only their buckets are read."""
        names = [n for _, n in self.log.state["runs"]]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        keys = batch.select(self.key).distinct()
        touched = [r["bucket"] for r in self._bucket(keys).select("bucket").distinct().collect()]  # at most ``buckets``
        return self._newest(self._runs(names).where(F.col("bucket").isin(touched)).join(keys, self.key, "left_semi"))

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(self.schema)])
        self._bucket(rows).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.log.root}/{name}")
        return name

    def apply(self, batch: DataFrame, number: int | str, change: Callable[[DataFrame, DataFrame], DataFrame], notes: dict | None = None) -> bool:
        """Write ``change(state rows of the batch's keys, batch)`` as batch ``number``; false where that batch is committed already."""
        self.log.refresh()
        if number in self.log.state["batches"]:
            return False
        name = self._write(change(self.rows_of(batch), batch))

        def add(state: dict) -> dict | None:
            if number in state["batches"]:
                return None
            return state | {"runs": [*state["runs"], [0, name]], "batches": [*state["batches"], number], "notes": state["notes"] | (notes or {})}

        if not self.log.commit(add):
            self.log.delete(name)
            return False
        self._compact()
        return True

    def _compact(self) -> None:
        level = 0
        while level <= max((k for k, _ in self.log.state["runs"]), default=0):
            own = [n for k, n in self.log.state["runs"] if k == level]
            if len(own) >= FANOUT:
                merged = self._write(self._newest(self._runs(own)))

                def swap(state: dict, own=own, merged=merged, level=level) -> dict:
                    runs = [r for r in state["runs"] if r[1] not in own]
                    at = sum(k > level for k, _ in runs)  # older runs have higher levels and stand first
                    return state | {"runs": [*runs[:at], [level + 1, merged], *runs[at:]], "retired": own}

                before = self.log.state["retired"]
                self.log.commit(swap)
                for name in before:  # what the version before the last one read
                    self.log.delete(name)
            level += 1
