"""Learned advice: features, balanced samples, nearest neighbours, hold-out validation and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import positions

FEATURES = ("f1", "f2", "f3", "f4", "f5", "f6")


def batch_features(rows: DataFrame) -> DataFrame:
    """Six features in [0, 1] from keyword, documents, coverage, amount, description."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    return rows.withColumns({
        "f1": unit(F.col("keyword").cast("int")), "f2": unit(F.col("documents") / 40), "f3": unit(F.col("coverage") / 250),
        "f4": unit(F.log10(1 + F.abs("amount").cast("double")) / 6), "f5": unit(F.length("description") / 140), "f6": unit((F.col("amount") > 0).cast("int"))})


def rebalance(samples: DataFrame, label: str, day: str, order: list, ratio: int = 4) -> DataFrame:
    """Newest rows (by ``day``, then ``order``) of the larger class, at most ``ratio`` times the smaller one.

    Days are counted first; only the rows of the day that the limit cuts are ordered, by day, so no task orders a class.
    """
    newest_first = F.datediff(F.lit("1970-01-01").cast("date"), F.col(day))
    limit = samples.groupBy(label).agg(F.count("*").alias("n")).agg((F.min("n") * ratio).alias("limit"))
    ranked = positions(samples, [label], [newest_first], order)
    return ranked.join(F.broadcast(limit)).where("position <= limit").drop("position", "limit")  # one row is broadcast


#: Newest samples of a block that a fit reads at most (a bound of fitting).
SAMPLES = 5_000


def neighbours(n):
    """How many neighbours vote: the root of the samples, odd, from 3 to 31."""
    root = F.floor(F.sqrt(n))
    return F.greatest(F.lit(3), F.least(F.lit(31), root - F.when(root % 2 == 0, 1).otherwise(0))).cast("int")


def nearest(queries: DataFrame, samples: DataFrame, block: list[str], newest: list, k: int | None = None) -> DataFrame:
    """Probability of label 1 by the nearest of the ``SAMPLES`` newest samples of the same block (``neighbours`` of them, or ``k``); ties at
    the k-th distance all count; weights 1 / (1 + d)."""
    kept = samples.withColumn("_n", F.row_number().over(Window.partitionBy(*block).orderBy(*newest))).where(F.col("_n") <= SAMPLES)
    many = F.lit(k) if k else neighbours(F.count("*").over(Window.partitionBy(*block)))
    s = kept.withColumn("_k", many).select(*block, F.array(*FEATURES).alias("_s"), "label", "_k")
    pairs = queries.withColumn("_q", F.array(*FEATURES)).select("id", *block, "_q").join(s, block)
    d = F.sqrt(F.aggregate(F.zip_with("_q", "_s", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    ranked = pairs.select("id", "label", "_k", F.round(d, 9).alias("d")).withColumn("_r", F.rank().over(Window.partitionBy("id").orderBy("d")))
    near = ranked.where(F.col("_r") <= F.col("_k")).withColumn("w", 1 / (1 + F.col("d")))
    return near.groupBy("id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("p"), F.count("*").alias("neighbours"))


def predict_batch(queries: DataFrame, samples: DataFrame, block: list[str], newest: list, threshold: int = 80) -> DataFrame:
    """(id, p, is_batch): class 1 with a probability of at least ``threshold`` (50 to 99) percent."""
    level = min(99, max(50, threshold)) / 100
    return nearest(queries, samples, block, newest).select("id", "p", (F.col("p") >= level).alias("is_batch"))


#: Samples, and samples of each class, that a classifier needs.
NEEDED, NEEDED_EACH = 24, 4


def fit_classifier(kind: str, train: DataFrame, features: str = "features", label: str = "label"):
    """A fitted ``naive_bayes`` (Gaussian), ``decision_tree`` or ``random_forest`` (31 trees); None where samples are too few."""
    from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier

    sizes = [r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()]  # a row a class
    if len(sizes) < 2 or sum(sizes) < NEEDED or min(sizes) < NEEDED_EACH:
        return None
    columns = {"featuresCol": features, "labelCol": label}
    makers = {"naive_bayes": lambda: NaiveBayes(modelType="gaussian", **columns), "decision_tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=3, **columns), "random_forest": lambda: RandomForestClassifier(numTrees=31, maxDepth=5, seed=3, **columns)}
    return makers[kind]().fit(train)


#: Bins of the hashed words of a supplier's line.
BINS = 64


def supplier_features(lines: DataFrame) -> DataFrame:
    """``lines`` (amount, counterparty_name, counterparty_iban, description, payment_reference) with four numbers in [0, 1] (size, outflow,
    IBAN given, length of the name) and ``bins``: the shares of its words of two letters and more by CRC-32."""
    from ..functions.text import normalize_text

    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    text = normalize_text(F.concat_ws(" ", "counterparty_name", "counterparty_iban", "description", "payment_reference"))
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 2)
    rows = lines.withColumn("_words", words)
    place = F.transform("_words", lambda w: (F.crc32(w) % BINS).cast("int"))
    share = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.size(F.filter("_at", lambda x: x == i)) / F.nullif(F.size("_at"), F.lit(0)), F.lit(0.0)))
    return rows.withColumn("_at", place).withColumns({
        "s1": unit(F.log10(1 + F.abs("amount").cast("double")) / 6), "s2": (F.col("amount") < 0).cast("double"), "s3": (F.coalesce("counterparty_iban", F.lit("")) != "").cast("double"), "s4": unit(F.length(F.trim("counterparty_name")) / 80),
        "tokens": F.size("_words"), "bins": share}).drop("_words", "_at")


def newest_per(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def holdout(samples: DataFrame, order: str, tiebreak: str, percent: int = 20) -> DataFrame:
    """``part``: test for the newest ``percent``, train before; ranks come from counts of days, not from one ordered task."""
    days = samples.groupBy(order).agg(F.count("*").alias("n"))
    after = days.select(order, (F.sum("n").over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))).alias("_after"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    rows = samples.join(F.broadcast(after), order)
    place = F.coalesce("_after", F.lit(0)) + F.row_number().over(Window.partitionBy(order).orderBy(F.desc(tiebreak)))
    return rows.withColumn("part", F.when(place <= F.floor(F.col("_all") * percent / 100), "test").otherwise("train")).drop("_after", "_all")


def unseen(train: DataFrame, test: DataFrame) -> DataFrame:
    """``train`` without rows whose features a row of ``test`` has: what a model is measured on it has not read."""
    return train.join(test.select(*FEATURES).distinct(), list(FEATURES), "left_anti")


def metrics(judged: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, balanced accuracy, and the accuracy of the more frequent label (majority), of
    (label, predicted)."""
    c = lambda a, b: F.count_if((F.col("label") == a) & (F.col("predicted") == b))
    t = judged.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return t.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "majority": ratio(F.greatest(tp + fn, tn + fp), tp + fp + fn + tn)})



def learn_patterns(approved: DataFrame, most: int) -> DataFrame:
    """Descriptions of 8 to 120 characters that led to a party: hits and last use; the ``most`` used."""
    good = approved.where(F.length("description").between(8, 120)).groupBy("description", "party_id").agg(F.count("*").alias("hits"), F.max("operation_date").alias("last_used"))
    return good.orderBy(F.desc("hits"), F.desc("last_used"), "description", "party_id").limit(most)


def party_votes(rows: DataFrame, support: int, percent: int, lead: int) -> DataFrame:
    """Per key: the party most approved before, if it has the support, the share and the lead over the next; null otherwise."""
    n = rows.groupBy("key", "party_id").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("key")
    ranked = n.withColumn("total", F.sum("votes").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("votes"), "party_id"))).withColumn("second", F.lead("votes").over(w.orderBy(F.desc("votes"), "party_id")))
    top = ranked.where("k = 1").withColumn("share", F.col("votes") * 100 / F.col("total")).withColumn("gap", (F.col("votes") - F.coalesce("second", F.lit(0))) * 100 / F.col("total"))
    sure = (F.col("votes") >= support) & (F.col("share") >= percent) & (F.col("gap") >= lead)
    return top.select("key", F.when(sure, F.col("party_id")).alias("party_id"), "votes", "total")
