"""Secret scan: candidates from every text, then a random forest that removes false positives.

Candidates are runs of ``[A-Za-z0-9+/_-]`` (with ``=`` as padding at the end only) in every blank-separated word that hold a digit, or
letters of both cases that do not read as words (``MIXED``: five consonants in a row, or at most two letters between changes of
case): all of at least ``LEAST`` characters, and behind a credential word with an assignment those of at least ``SHORT``. ``nth`` counts
the word's runs of ``SHORT`` characters or more.

Features: length; share of each of the 16 transitions between digits, small letters, capitals and other characters; distinct
characters, digits and capitals; dictionary coverage (share of its letters in runs that are frequent words of the whole
corpus); whether the neighbouring words are frequent words; and the path (``source``): its number of words, whether it names
samples or tests, and its candidates a document.

Labelled findings come from what is no feature: a credential word with an assignment ahead of the value is a true finding.
False ones are numbers with a right check digit (cards and the like), parts of links, and values that stand under more than
``HOSTS`` sources, all without credential word and assignment. The forest is trained on at most ``SAMPLE`` findings of each
label by hash of the value (the bound is for fitting only), never on the fifth ``held_out`` by value, and judges every candidate.

Only DataFrame functions and Spark's own random forest are used. Defined cases: null or empty text has no candidates; a text or
a run of any length is read whole; with fewer than two labels among the findings, decided labels stand and undecided candidates
are kept as findings; a probability of exactly 0.5 is a secret; repeated rows and null doc_ids are judged row by row; an empty
table gives an empty result; a null source is a path of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqltext import blank_words, let
from .store import keep, small

LEAST, SHORT, SAMPLE, TREES, DEPTH, FREQUENT, HOSTS, FOLDS = 16, 6, 5000, 20, 6, 200, 3, 5
#: Words that name credentials.
CREDENTIAL = "(?i)(token|secret|passw(or)?d|pwd|api_?key|apikey|auth|credential|private_?key|access_?key)"
#: A run starts where no run goes on, so a long one is read once; ``=`` ahead of a value ends it.
RUN = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORT},}}+(?:={{1,2}}+(?![A-Za-z0-9+/_=-]))?"
#: An assignment ends what leads to a value.
ASSIGNED = "[=:]\\s*[\"']?$"
MIXED = "(?i:[b-df-hj-np-tv-xz]{5})|[a-z][A-Z](?![a-z]{2})|[A-Z][a-z](?![a-z])"
#: Words of paths that hold samples.
SAMPLES = "(?i)(test|example|sample|fixture|mock|demo|doc)"
MARKS = "1aB-"
TRANSITIONS = tuple(f"{a}{b}" for a in MARKS for b in MARKS)
FEATURES = ("length", "distinct", "digits", "capitals", "coverage", "near_before", "near_after", "path_words", "path_samples", "path_rate", *(f"from_{i // 4}_to_{i % 4}" for i in range(16)))


def _random(run: Column) -> Column:
    return run.rlike("[0-9]") | (run.rlike("[a-z]") & run.rlike("[A-Z]") & run.rlike(MIXED))


def candidates(docs: DataFrame) -> DataFrame:
    """One row a candidate: doc_id, source, pos (word), nth (run of the word), word, run, prefix (what leads to the run in the word), before2, before, after."""

    def near(w: Column) -> Column:
        def may(i: Column) -> Column:
            word = F.get(w, i)
            ahead = F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))
            return (F.length(word) >= SHORT) & _random(word) & word.rlike(RUN) & (word.rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}") | (word.rlike(CREDENTIAL) & word.rlike("[=:]")) | (ahead.rlike(CREDENTIAL) & ahead.rlike("[=:]")))

        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), may)
        pick = lambda i: F.struct(i.alias("pos"), F.get(w, i).alias("word"), F.get(w, i - 2).alias("before2"), F.get(w, i - 1).alias("before"), F.get(w, i + 1).alias("after"))
        return F.when(F.size(w) > 0, F.transform(at, pick))

    text = F.coalesce("text", F.lit(""))
    likely = docs.where(text.rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}") | text.rlike(CREDENTIAL)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.explode(let(blank_words(text), near)).alias("c"))
    split = likely.select("doc_id", "source", "c.*", F.regexp_extract_all("c.word", F.lit(RUN), 0).alias("runs"), F.split("c.word", RUN).alias("between"))
    led = lambda r, i: F.struct(i.alias("nth"), r.alias("run"), F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.coalesce(F.get("between", i), F.lit(""))).alias("prefix"))
    own = F.filter(F.transform("runs", led), lambda x: _random(x["run"]))
    each = split.withColumn("r", F.explode(F.transform(own, lambda x, i: x.withField("first", i == 0)))).drop("runs", "between")
    first = lambda c: F.when(F.col("r.first"), F.col(c)).alias(c)  # noqa: E731  # words before count for the first such run only
    out = each.select("doc_id", "source", "pos", "r.nth", "word", first("before2"), first("before"), "after", "r.run", "r.prefix")
    return out.where((F.length("run") >= LEAST) | (_credential() & _assigned()))


def _credential() -> Column:
    return F.concat_ws(" ", "before2", "before", "prefix").rlike(CREDENTIAL)


def _assigned() -> Column:
    return F.concat_ws(" ", "before", "prefix").rlike(ASSIGNED)


def _path() -> Column:
    """The source, marked so that null is none of the others."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _classes(run: Column) -> Column:
    for pattern, mark in (("[0-9]", "1"), ("[a-z]", "a"), ("[A-Z]", "B"), ("[^1aB]", "-")):
        run = F.regexp_replace(run, pattern, mark)
    return run


def _luhn(run: Column) -> Column:
    """Whether ``run`` is a number of 13 to 19 digits with a right check digit."""
    digits = F.transform(F.split(F.reverse(F.when(run.rlike("^[0-9]{13,19}$"), run)), ""), lambda d: d.cast("int"))
    part = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.coalesce(F.aggregate(F.transform(F.filter(digits, lambda d: d.isNotNull()), part), F.lit(0), lambda a, d: a + d) % 10 == 0, F.lit(False))


def _bare(word: str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.col(word), F.lit("")), "[^\\p{L}]", ""))


def findings(docs: DataFrame) -> DataFrame:
    """Candidates with features, the decided label (null where context does not decide) and the forest's probability."""
    docs = docs.select("doc_id", "text", "source")
    rows = keep(candidates(docs).withColumn("id", F.monotonically_increasing_id()).withColumn("letters", F.array_remove(F.split(F.lower("run"), "[^a-z]+"), "")))
    asked = keep(rows.select(F.explode(F.concat("letters", F.array(_bare("before"), _bare("after")))).alias("piece")).where("length(piece) >= 2").distinct())
    every = docs.select(F.explode(blank_words(F.col("text"))).alias("w")).select(F.lower(F.regexp_replace("w", "[^\\p{L}]", "")).alias("piece"))
    uses = every.join(small(asked), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("uses"))
    size = docs.select(F.size(blank_words(F.col("text"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = keep(uses.where(F.col("uses") >= max(2, size / 1e6 * FREQUENT / 100)).select("piece"))
    covered = rows.select("id", F.explode("letters").alias("piece")).join(frequent, "piece").groupBy("id").agg(F.sum(F.length("piece")).alias("covered"))
    beside = lambda c: rows.select("id", _bare(c).alias("piece")).join(frequent, "piece").select("id", F.lit(1.0).alias(f"near_{c}"))
    rows = rows.withColumn("path", _path())
    here = rows.groupBy("path").agg(F.count("*").alias("here"))
    paths = docs.groupBy(_path().alias("path")).agg(F.count("*").alias("documents")).join(here, "path").select("path", (F.col("here") / F.col("documents")).alias("path_rate"))
    hosts = rows.groupBy("run").agg(F.count_distinct("path").alias("hosts")).where(F.col("hosts") > HOSTS)
    wide = rows.join(covered, "id", "left").join(beside("before"), "id", "left").join(beside("after"), "id", "left").join(paths, "path", "left").join(hosts, "run", "left")
    classes = _classes(F.col("run"))
    credential, assigned = _credential(), _assigned()
    public = _luhn(F.col("run")) | F.col("word").contains("://") | F.col("hosts").isNotNull()
    label = F.when(credential & assigned, 1.0).when(~credential & ~assigned & public, 0.0)
    n = F.length("run").cast("double")
    shaped = wide.select(
        "id", "doc_id", "pos", "nth", "run", label.alias("label"), (F.pmod(F.xxhash64("run"), F.lit(FOLDS)) == 0).alias("held_out"), n.alias("length"),
        (F.size(F.array_distinct(F.split("run", ""))) / F.least(n, F.lit(64.0))).alias("distinct"),
        (F.length(F.regexp_replace("run", "[^0-9]", "")) / n).alias("digits"),
        (F.length(F.regexp_replace("run", "[^A-Z]", "")) / n).alias("capitals"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        F.coalesce("near_before", F.lit(0.0)).alias("near_before"), F.coalesce("near_after", F.lit(0.0)).alias("near_after"),
        F.size(F.array_remove(F.split("path", "[^A-Za-z]+"), "")).cast("double").alias("path_words"),
        F.col("path").rlike(SAMPLES).cast("double").alias("path_samples"), "path_rate",
        *((F.regexp_count(classes, F.lit(f"{t[0]}(?={t[1]})")) / n).alias(name) for t, name in zip(TRANSITIONS, FEATURES[10:], strict=True)),
    )
    shaped = keep(shaped)
    totals = {r["label"]: r["n"] for r in shaped.where("label is not null and not held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return shaped.withColumn("p_secret", F.coalesce("label", F.lit(1.0)))
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spot = F.pmod(F.xxhash64(F.lit(1), "run"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE / totals[1.0])).otherwise(min(1.0, SAMPLE / totals[0.0]))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    train = vectors.transform(shaped.where("label is not null and not held_out").where(spot < share))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label").fit(train)
    return forest.transform(vectors.transform(shaped)).withColumn("p_secret", vector_to_array("probability")[1])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate: doc_id, pos (word), nth (run of the word), length, run_sha256, labelled, held_out, p_secret, is_secret."""
    out = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("nth").cast("long").alias("nth"), F.col("length").cast("long").alias("length"), F.sha2("run", 256).alias("run_sha256"), F.col("label").alias("labelled"), "held_out", "p_secret", (F.col("p_secret") >= 0.5).alias("is_secret"))
