"""Quality rules on each document, then cross-document line frequency.

Lines are normalised (blanks trimmed, lower case, digits as 0) and hashed. For each host (``source``) the distinct
documents that hold a line are counted: a document once however often it repeats the line, exact copies of a text once, and
near copies once. A line that more than ``MIN_DOCS`` documents and more than ``SHARE`` of the host's distinct texts hold is
boilerplate. Boilerplate lines are removed (``cleaned`` gives the texts without them); a document with under ``MIN_WORDS``
words or under ``MIN_LEFT`` of its words left is depleted and rejected.

Near copies are looked for only among texts that hold a line frequent enough to matter. Each has a sketch, the ``SKETCH``
smallest hashes of its runs of ``SHINGLE`` words, and is held against the smallest text that shares the least hash of one of
``BANDS`` parts of the sketch; at an estimated Jaccard similarity of ``NEAR`` or more both are one document. The sketch
estimates; texts near the limit can fall on either side.

Only DataFrame functions are used. Counts are summed on the map side first.

Defined cases: null or empty text has no words and fails the base rules; a null source is a host of its own; a text of any
length is judged whole; repeated or null doc_ids are judged row by row (exact copies count once), and rows in are rows out; a
line at exactly a limit is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .sqltext import BLANKS, blank_words, let, lower_ascii, repeated_words, run_hashes
from .store import keep, small, without

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
MIN_DOCS, SHARE, MIN_LEFT = 20, 0.001, 0.3
SHINGLE, SKETCH, BANDS, NEAR = 5, 128, 8, 0.8
SYMBOLS = "[#*$%&|<>]"


def _hashed(line):
    return F.xxhash64(F.translate(F.lower(F.trim(line, F.lit(BLANKS))), "0123456789", "0000000000"))


def _lines(text):
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")


def _sketch(text):
    """The smallest hashes of the runs of ``SHINGLE`` words; a shorter text is one run."""
    of = lambda w: F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(run_hashes(w, SHINGLE))
    return F.slice(F.sort_array(F.array_distinct(let(blank_words(lower_ascii(text)), of))), 1, SKETCH)


def _text_key():
    """Host, hash and length: what tells texts apart. A host is marked, so that null is none of the others."""
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"), F.xxhash64("text").alias("copy"), F.length(text).alias("size")


def _profile(docs: DataFrame) -> DataFrame:
    """One row a document: counts, and its lines as (hash, neighbours, words)."""
    text = F.coalesce("text", F.lit(""))
    counts = let(
        blank_words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w, WINDOW).alias("n_repeat_words")),
    )
    with_lines = let(
        _lines(text),
        lambda a: F.struct(
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            F.transform(a, _hashed).alias("hashes"),
            F.transform(a, lambda x: F.size(blank_words(x)).cast("long")).alias("words"),
        ),
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_text_key(),
        _sketch(text).alias("sketch"),
        counts.alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        with_lines.alias("l"),
    ).select("doc_id", "host", "copy", "size", "sketch", "c.*", "n_symbols", "l.*")


def _near_copies(texts: DataFrame) -> DataFrame:
    """node, component for every text (row, host, sketch) that is a near copy of another; the component is the smallest row."""
    part = lambda b: F.array_min(F.filter("sketch", lambda x: F.pmod(x, F.lit(BANDS)) == b))
    bands = F.array(*(part(b) for b in range(BANDS)))
    held = texts.select("row", "host", F.explode(F.array_compact(bands)).alias("band"))
    pivots = held.groupBy("host", "band").agg(F.min("row").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = held.join(pivots, ["host", "band"]).where("row != pivot").select("row", "pivot").distinct()
    sided = pairs.join(texts.select("row", F.col("sketch").alias("x")), "row").join(texts.select(F.col("row").alias("pivot"), F.col("sketch").alias("y")), "pivot")
    either = F.slice(F.sort_array(F.array_union("x", "y")), 1, SKETCH)
    same = let(either, lambda u: F.size(F.array_intersect(F.array_intersect(u, F.col("x")), F.col("y"))) / F.size(u))
    return components(sided.where(same >= NEAR).select(F.col("row").alias("a"), F.col("pivot").alias("b")))


def _common(base: DataFrame) -> DataFrame:
    """(host, line) of boilerplate."""
    first = base.groupBy("host", "copy", "size").agg(F.min("row").alias("row"))
    hosts = first.groupBy("host").agg(F.count("*").alias("of"))
    lines = base.join(first.select("row"), "row", "left_semi").select("row", "host", F.explode(F.array_distinct("hashes")).alias("line"))
    often = lambda n: (F.col(n) > MIN_DOCS) & (F.col(n) > SHARE * F.col("of"))
    hot = keep(lines.groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > MIN_DOCS).join(hosts, "host").where(often("texts")).select("host", "line", "of"))
    held = keep(lines.join(small(hot), ["host", "line"]))
    near = _near_copies(keep(base.join(held.select("row").distinct(), "row", "left_semi").select("row", "host", "sketch")))
    each = held.join(near.withColumnRenamed("node", "row"), "row", "left").select("host", "line", "of", F.coalesce("component", "row").alias("document")).distinct()
    return each.groupBy("host", "line", "of").agg(F.count("*").alias("docs")).where(often("docs")).select("host", "line")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their verdicts, and (row, line) of the boilerplate lines in rows that pass the base rules."""
    base = keep(_profile(docs).withColumn("row", F.monotonically_increasing_id()))
    common = keep(_common(base))
    each = base.where(~_failed()).select("row", "host", F.explode(F.arrays_zip("hashes", "words")).alias("x")).select("row", "host", F.col("x.hashes").alias("line"), F.col("x.words").alias("words"))
    hits = each.join(small(common), ["host", "line"])
    gone = hits.groupBy("row").agg(F.sum("words").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    out = base.join(gone, "row", "left").withColumn("base_failed", _failed()).withColumn("n_left", left)
    kept = ~F.col("base_failed") & (F.col("n_left") >= MIN_WORDS) & (F.col("n_left") >= MIN_LEFT * F.col("n_words"))
    return out.withColumn("kept", kept), hits


def line_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left (words outside boilerplate), kept."""
    return _judged(docs)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, without their boilerplate lines; all columns stay, ``n_chars`` follows the text."""
    judged, hits = _judged(docs)
    judged = keep(judged.select("row", "doc_id", "host", "copy", "size", "kept"))
    lines = hits.groupBy("row").agg(F.collect_set("line").alias("__gone"))
    names = ["host", "copy", "size"]
    notes = keep(judged.where("kept").join(lines, "row").dropDuplicates(names).select(*(F.col(c).alias(f"__{c}") for c in names), "__gone"))
    same = [k == F.col(f"__{c}") for k, c in zip(_text_key(), names, strict=True)]
    joined = without(docs, judged.where("not kept")).join(small(notes), same, "left")
    less = F.array_join(F.filter(F.split("text", "\n"), lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~F.array_contains("__gone", _hashed(x))), "\n")
    hit = F.col("__gone").isNotNull()
    out = joined.withColumn("text", F.when(hit, less).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return line_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
