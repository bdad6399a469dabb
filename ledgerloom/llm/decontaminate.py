"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (the whole item where it has fewer). A window occurs in a document only
if all its words do, so one necessary token a window is enough to find it: words are ordered by how often they occur
in all documents, and the window's rarest word is its prefix. Document words join prefixes; the position of the word in
the window fixes where the window would start (positional bound) and end (length bound), and there the document's words
are compared with the window's, one by one.

Only DataFrame functions are used. Prefixes are broadcast only where they measure below ``store.BROADCAST_BYTES``, and joined
by shuffle beyond it. Windows that several items share are compared once. A document's possible places travel as numbers
(start, size, window), not as words; the words there are compared with the window by SHA-256.

Defined cases: null or empty text has no words, no hits, and is not contaminated; items without words match nothing; a text of
any length is judged whole; rows of one doc_id are judged by their own texts, equal rows alike, a null doc_id like another;
rows in are rows out; repeated items count once; ties in rarity go to the smaller word; empty tables give no hits or no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sqltext import let, plain_words
from .store import keep, named, on_rows, small

WINDOW, SHARE = 13, 20
KEY = ("doc_id", "copy")


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words): every window of every item."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("words")).where("size(words) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1))))
    return w.withColumn("at", start).select("item_id", F.slice("words", F.col("at"), F.least(F.lit(window), F.size("words"))).alias("words"))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their number of words, occurrences (doc_id, copy, start, size, window), (window, item_id))."""
    texts = named(docs)
    ids = texts.select(*KEY, F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    digest = lambda words: F.unhex(F.sha2(F.array_join(words, " "), 256))
    items = keep(_windows(benchmark, window).select("item_id", "words", digest("words").alias("sha")).distinct())
    distinct = keep(items.select("sha", "words").distinct().withColumn("window", F.monotonically_increasing_id()))
    vocabulary = keep(distinct.select(F.explode("words").alias("word")).distinct())
    every = texts.select(F.explode(plain_words(F.col("text"))).alias("word"))
    counts = every.join(small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = distinct.select("window", "words", F.posexplode("words").alias("offset", "word")).join(counts, "word")
    complete = ranked.groupBy("window").agg(F.min_by(F.struct("word", "offset"), F.struct("n", "word", "offset")).alias("p"), F.count("*").alias("found"), F.first("words").alias("words"))
    prefixes = keep(complete.where("found = size(words)").select("window", "p.word", "p.offset", F.size("words").alias("size")))
    spread = texts.select(*KEY, F.posexplode(plain_words(F.col("text"))).alias("pos", "word"))
    found = spread.join(small(prefixes), "word").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    per = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size", "window")).alias("may"))
    inside = lambda w: F.filter("may", lambda c: c["start"] + c["size"] <= F.size(w))
    places = lambda w: F.transform(inside(w), lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), c["window"].alias("window"), digest(F.slice(w, c["start"] + 1, c["size"])).alias("sha")))
    may = on_rows(texts, per).select(*KEY, F.explode(let(plain_words(F.col("text")), places)).alias("hit")).select(*KEY, "hit.*")
    exact = may.join(small(distinct.select("window", "sha")), ["window", "sha"])
    return ids, exact.select(*KEY, "start", "size", "window"), items.select("sha", "item_id").distinct().join(distinct.select("sha", "window"), "sha").select("window", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, copy (hash of the text), n_words, n_hit, n_items, items (sorted), contaminated (at least 1 word in ``share`` is hit)."""
    ids, hits, items = contaminated_windows(docs, benchmark, window)
    hits = keep(hits.distinct())
    runs = F.array_sort(F.collect_set(F.struct("start", "size")))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["start"] + r["size"] - F.greatest(a["end"], r["start"].cast("long")))).cast("long").alias("n"), F.greatest(a["end"], (r["start"] + r["size"]).cast("long")).alias("end"))
    words = hits.groupBy(*KEY).agg(runs.alias("runs")).select(*KEY, F.aggregate("runs", first, step, lambda a: a["n"]).alias("n_hit"))
    whose = hits.select(*KEY, "window").distinct().join(items, "window").groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = on_rows(ids, on_rows(words, whose), "left")  # every document with a hit has both
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "copy", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items", "copy")
