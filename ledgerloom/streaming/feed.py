"""Bank feed: mapping, validation, upsert of keyed state, cursors and watermarks, late data and freshness. The stream and the batch use the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import financial_hash
from ..sources.commits import KeyedState

MONEY = "decimal(18,2)"


def map_accounts(feed: DataFrame, accounts: DataFrame) -> DataFrame:
    """Feed account to bank account by IBAN, unique on both sides, equal currency, open: mapped, mapping_review or unavailable."""
    a = accounts.select("account_id", "iban", F.col("currency").alias("_c"), "closed")
    n = feed.withColumn("_f", F.count("*").over(Window.partitionBy("iban")))
    b = a.withColumn("_b", F.count("*").over(Window.partitionBy("iban")))
    rows = n.join(b, "iban", "left")
    state = F.when(F.col("account_id").isNull(), "unavailable").when((F.col("_f") > 1) | (F.col("_b") > 1) | (F.col("currency") != F.col("_c")) | F.col("closed"), "mapping_review").otherwise("mapped")
    return rows.select("feed_id", state.alias("state"), F.when(state == "mapped", F.col("account_id")).alias("account_id")).distinct()


def validate(tx: DataFrame) -> DataFrame:
    """``problem`` of each transaction; null where it is good: posted, exact amount, real date."""
    problem = F.when(F.col("pending"), "pending").when(~F.coalesce(F.col("amount_text").rlike("^-?[0-9]{1,16}(\\.[0-9]{1,8})?$"), F.lit(False)), "amount").when(F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd")).isNull(), "date")
    return tx.withColumn("problem", problem)


#: Columns of a transaction that a batch brings.
FIELDS = ("account_id", "amount", "day", "description", "version")


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """New snapshot of (tx_id, account_id, amount, day, description, version, outcome, conflict) after a batch; the newest version of a
    transaction in the batch counts. Outcomes: new, unchanged, described (text changed), review (money or day changed), kept. In review
    the old values stay and ``conflict`` has the new ones; it stays until the old values come again.
    """
    last = F.row_number().over(Window.partitionBy("tx_id").orderBy(F.desc("version")))
    b = batch.withColumn("_k", last).where("_k = 1").select("tx_id", *[F.col(c).alias(f"_{c}") for c in FIELDS])
    if "conflict" not in state.columns:
        state = state.withColumn("conflict", F.lit(None))
    both = state.join(b, "tx_id", "full")
    money = lambda p: financial_hash(f"{p}amount", f"{p}day", F.lit("EUR"))
    outcome = (
        F.when(F.col("_version").isNull(), "kept").when(F.col("version").isNull(), "new").when(money("") != money("_"), "review")
        .when(F.col("description") != F.col("_description"), "described").otherwise("unchanged")
    )
    old = outcome.isin("kept", "review")
    pick = lambda c: F.when(old, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    told = F.struct(*[F.col(f"_{c}").alias(c) for c in ("amount", "day", "description")])
    conflict = F.when(outcome == "review", told).when(outcome == "kept", F.col("conflict").cast(CONFLICT))
    return both.select("tx_id", *[pick(c) for c in FIELDS], outcome.alias("outcome"), conflict.cast(CONFLICT).alias("conflict"))


CONFLICT = "struct<amount: decimal(18,2), day: date, description: string>"
STATE = f"tx_id bigint, account_id bigint, amount decimal(18,2), day date, description string, version int, outcome string, conflict {CONFLICT}"


def identified(state: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (tx_id, external, previous) with ``known_id``: the transaction of ``state`` (tx_id, external) that it is, by its id or by its
    current or previous external id (empty: none), and ``ambiguous`` where these name several."""
    s = state.select(F.col("tx_id").alias("_s"), F.col("external").alias("_e"))
    hits = batch.select("tx_id", F.col("tx_id").alias("_s")).join(s.select("_s"), "_s").select("tx_id", "_s")
    for name in ("external", "previous"):
        hits = hits.unionByName(batch.where(F.col(name) != "").select("tx_id", F.col(name).alias("_e")).join(s, "_e").select("tx_id", "_s"))
    per = hits.distinct().groupBy("tx_id").agg(F.count("*").alias("_n"), F.min("_s").alias("known_id"))
    out = batch.join(per, "tx_id", "left")
    return out.withColumns({"ambiguous": F.coalesce(F.col("_n") > 1, F.lit(False)), "known_id": F.when(F.col("_n") == 1, F.col("known_id"))}).drop("_n")


def outcomes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Outcome of each identified transaction (``identified``; amount, day, description): tx_id, known_id, outcome, staged.

    ambiguous, review (money or day changed), described (text changed), unchanged, zero (recorded, not staged) or new.
    """
    s = state.select(F.col("tx_id").alias("known_id"), *[F.col(c).alias(f"_{c}") for c in ("amount", "day", "description")])
    rows = batch.join(s, "known_id", "left")
    money = lambda p: financial_hash(f"{p}amount", f"{p}day", F.lit("EUR"))
    outcome = (
        F.when(F.col("ambiguous"), "ambiguous").when(F.col("known_id").isNotNull() & (money("") != money("_")), "review").when(F.col("known_id").isNotNull() & (F.col("description") != F.col("_description")), "described")
        .when(F.col("known_id").isNotNull(), "unchanged").when(F.col("amount") == 0, "zero").otherwise("new")
    )
    return rows.select("tx_id", "known_id", outcome.alias("outcome"), (outcome == "new").alias("staged"))


def feed_state(spark: SparkSession, path: str, start: DataFrame | None = None) -> KeyedState:
    """The feed's transactions at ``path``; ``start`` is its first batch where there is none yet."""
    state = KeyedState(spark, f"{path}/state", "tx_id", STATE)
    if start is not None:
        none = F.lit(None).cast(CONFLICT)
        state.apply(start, "start", lambda _, rows: rows.select("tx_id", *FIELDS, F.lit("kept").alias("outcome"), (F.col("conflict") if "conflict" in rows.columns else none).alias("conflict")))
    return state


def upsert_stream(stream: DataFrame, path: str, start: DataFrame) -> DataFrame:
    """Apply landed batches one after the other (``upsert`` in ``foreachBatch``) and return the snapshot, each transaction with the outcome of
    the last batch that had it.

    A batch writes the transactions it has, not the snapshot, and is committed under its number: one that is run again counts once,
    and a restart without new pages returns what was there.
    """
    spark = stream.sparkSession
    state = feed_state(spark, path, start)

    def one(batch: DataFrame, number: int) -> None:
        feed_state(batch.sparkSession, path).apply(batch, number, upsert)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.snapshot()


def judged_runs(pages: DataFrame, marks: DataFrame, started: str) -> DataFrame:
    """account_id, pages, state and watermark of each account's collection. ``pages``: account_id, page (from 0), cursor (of the request; null
    in the first), next_cursor; ``marks``: account_id, watermark.

    A run is complete if its pages follow each other without a gap and the last has no next cursor; the watermark then becomes
    ``started``. A cursor that comes again, is over 4096 characters long or leads elsewhere is an error; after an error or a cut run
    the watermark stays.
    """
    w = Window.partitionBy("account_id").orderBy("page")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = pages.select("account_id", "page", blank("cursor").alias("c"), blank("next_cursor").alias("n"))
    follows = F.when(F.lag("page").over(w).isNull(), (F.col("page") == 0) & F.col("c").isNull()).otherwise((F.col("page") == F.lag("page").over(w) + 1) & F.coalesce(F.col("c") == F.lag("n").over(w), F.lit(False)))
    again = F.count("n").over(Window.partitionBy("account_id", "n")) > 1
    last = F.lead("page").over(w).isNull()
    marked = rows.select("account_id", follows.alias("follows"), again.alias("again"), (last & F.col("n").isNull()).alias("ends"), (F.length("n") > 4096).alias("long"))
    per = marked.groupBy("account_id").agg(F.count("*").alias("pages"), F.bool_and("follows").alias("chain"), F.bool_or("again").alias("again"), F.bool_or(F.coalesce("long", F.lit(False))).alias("long"), F.bool_or("ends").alias("ends"))
    state = F.when(F.col("again") | F.col("long"), "repeated_cursor").when(~F.col("chain"), "broken").when(F.col("ends"), "complete").otherwise("cut")
    out = per.withColumn("state", state).join(marks, "account_id", "full")
    mark = F.when(F.col("state") == "complete", F.lit(started).cast("timestamp")).otherwise(F.col("watermark").cast("timestamp"))
    return out.select("account_id", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("state", F.lit("none")).alias("state"), mark.alias("watermark"))


def collect_feed(spark: SparkSession, path: str, pages: DataFrame, started: str, run: str) -> DataFrame:
    """Apply a collection's pages (account_id, page, cursor, next_cursor, data: transactions) to the feed at ``path`` as one commit and return
    the accounts' states and watermarks.

    Only complete runs are applied; their watermarks are committed with them, so a run that stops on the way, or is tried again,
    leaves both as they were.
    """
    state = feed_state(spark, path)
    schema = "account_id bigint, watermark timestamp"
    known = state.log.state["notes"].get("marks")
    marks = spark.read.schema(schema).parquet(f"{path}/state/{known}") if known else spark.createDataFrame([], schema)
    judged = judged_runs(pages.select("account_id", "page", "cursor", "next_cursor"), marks, started)
    if run in state.log.state["batches"]:
        return judged
    name = f"marks-{run}"
    judged.select("account_id", "watermark").write.mode("overwrite").parquet(f"{path}/state/{name}")
    good = pages.join(judged.where("state = 'complete'").select("account_id"), "account_id", "left_semi")
    rows = good.select("account_id", F.explode("data").alias("t")).select("t.tx_id", "account_id", "t.amount", "t.day", "t.description", "t.version")
    state.apply(rows, run, upsert, {"marks": name})
    return judged


def freshness(accounts: DataFrame, updated: str, as_of: str, hours: int = 36) -> DataFrame:
    """``accounts`` with ``state``: stale where the bank's last update is missing or over ``hours`` before ``as_of``, else ready."""
    old = F.col(updated).isNull() | (F.col(updated).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return accounts.withColumn("state", F.when(old, "stale").otherwise("ready"))


def slot(ts: Column, hours: list[int]) -> Column:
    """The latest of the day's collection hours at or before a time; the day before's last one if there is none."""
    day = F.date_trunc("day", ts)
    of = lambda d, h: d + F.make_dt_interval(F.lit(0), F.lit(h))
    today = F.array(*[of(day, h) for h in sorted(hours)])
    past = F.filter(today, lambda x: x <= ts)
    return F.when(F.size(past) > 0, F.element_at(past, -1)).otherwise(of(day - F.expr("interval 1 day"), max(hours)))


def read_landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream over landed Parquet pages."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: a single file may stand where a folder is expected


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "48 hours") -> DataFrame:
    """Each key once within the overlap that is read again before the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Process what has landed, write it under ``path`` with its checkpoint, and return it."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
