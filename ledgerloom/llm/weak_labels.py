"""Weak-label quality and toxicity model.

1. Labelled documents, at most ``LABELLED`` of each class by hash of doc_id (a bound of fitting only), give a lexicon: all
   words, and all beginnings of words (``STEMS`` bytes), that at least five of the toxic ones hold and others hardly do.
2. Overlapping heuristic labellers vote on every document (1 bad, 0 good, or abstain); given labels are one more labeller.
3. Expectation-maximisation over the counts of vote patterns (at most 3 ** labellers, whatever the number of documents)
   estimates the prior and each labeller's hit rate and false-alarm rate, and with them a posterior for every pattern.
4. Posterior labels train a sparse hashed linear scorer (logistic loss, L1 by proximal gradient) on at most ``SAMPLE``
   documents of each class and target, taken by hash of doc_id. ``SAMPLE`` bounds the fitting only: statistics, votes and
   scores cover every document.
5. Every document is scored from its whole text. A document is toxic, or of low quality, where the mean of the scorer's and the
   posterior's log-odds, weighted by ``SHARE``, is not negative.

Defined cases: null or empty text gets few-words votes and scores 0 features; documents without labels (a null doc_id has none)
abstain there; labels of unknown documents are ignored, repeated labels count once with the larger value; rows of one doc_id are
judged by their own texts, equal rows alike, and rows in are rows out; a very long text is one row; ties (a log-odds of 0) are
toxic, or low quality; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sqltext import blank_words
from .store import keep, named, small
from .textkit import Texts, Words, mix, range_hashes, space_words, texts

BINS, SAMPLE, LABELLED, ROUNDS = 1 << 16, 3000, 50_000, 60
#: Weight of the scorer's log-odds beside the posterior's: it reads the whole text, but knows fewer rare words than the labellers.
SHARE = 0.25
#: Insults that need no labels to be known.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile filth vermin dumb retarded".split()
TOXIC = ("insults", "short", "long", "given")
QUALITY = ("symbols", "capitals", "tables", "few_words", "repeats", "odd_ends", "in_a_row", "given")
#: Bytes of the beginnings of words that the lexicon knows, and that the scorer reads.
STEMS, STEM = (5, 6, 7, 8), 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def _letter_words(t: Texts) -> Words:
    data = _LOWER[t.data]
    return Words(Texts(data, t.at, t.first), _LETTERS[data])


def _hash_of(words: list[str] | list[bytes]) -> np.ndarray:
    raw = [w if isinstance(w, bytes) else w.encode() for w in words]
    end = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return range_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end) if raw else np.zeros(0, np.uint64)


def _stems(w: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word; 0 for shorter ones."""
    long = w.end - w.start >= size
    out = np.zeros(len(w.start), np.uint64)
    out[long] = range_hashes(w.data, w.start[long], w.start[long] + size)
    return out


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[at[1:]] - total[at[:-1]]


def _votes(insults: np.ndarray, lexicon: np.ndarray, stems: dict[int, np.ndarray]):
    """(doc_id, copy, toxic pattern, quality pattern) in base 3 without the given labels: digit 2 abstains."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("toxic", pa.int64()), ("quality", pa.int64())])
    tables, half = {n: np.sort(x) for n, x in ({0: lexicon} | stems).items()}, len(STEMS) // 2

    def inside(h: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(h), bool)
        return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "copy"))
            for t in texts(batch.column(batch.schema.get_field_index("text"))):
                w = _letter_words(t)
                h = w.hashes()
                toxic = (_per_doc(inside(h, np.sort(insults)), w.at) > 0).astype(np.int64)
                for sizes in ((0, *STEMS[:half]), (0, *STEMS[half:])):  # whole words of the lexicon, and shorter or longer beginnings
                    hit = np.zeros(len(h), bool)
                    for n in sizes:
                        hit |= inside(_stems(w, n) if n else h, tables[n])
                    toxic = toxic * 3 + (_per_doc(hit, w.at) > 0 if any(len(tables[n]) for n in sizes) else 2)
                data, size = t.data, np.maximum(np.diff(t.at), 1)
                upper = _per_doc((data >= 65) & (data <= 90), t.at)
                lower = _per_doc((data >= 97) & (data <= 122), t.at)
                symbols = _per_doc(np.isin(data, np.frombuffer(b"#*$%&<>!", np.uint8)), t.at)
                pipes = _per_doc(data == 124, t.at)
                every = space_words(t)
                n = np.diff(every.at)
                wh = every.hashes()
                distinct = np.array([len(np.unique(wh[a:b])) for a, b in zip(every.at[:-1], every.at[1:], strict=True)], np.int64)
                odd = _per_doc(np.isin(data[every.end - 1], np.frombuffer(b"#*$%&<>!|", np.uint8)), every.at)
                again = np.append(False, wh[1:] == wh[:-1])[: len(wh)]
                first = every.at[:-1][every.at[:-1] < len(wh)]
                again[first] = False
                row = _per_doc(again, every.at)
                quality = np.zeros(t.n, np.int64)
                for vote in (symbols > 0.01 * size, 5 * upper > upper + lower, pipes > 0.05 * n, n < 20, 5 * distinct < 2 * n, odd > 0.05 * n, row > 0.05 * n):
                    quality = quality * 3 + vote
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), copies.slice(t.first, t.n), pa.array(toxic), pa.array(quality)], schema=schema)

    return task


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of 0, 1 or 2 for abstain): posterior of each pattern, (hit, false-alarm) rates, prior."""
    votes, given = patterns == 1, patterns < 2
    share = np.where(given.any(1), (votes & given).sum(1) / np.maximum(given.sum(1), 1), 0)
    post = np.clip(np.where(patterns[:, -1] < 2, patterns[:, -1], (votes.any(1) * 0.5 + share * 0.5)), 0.02, 0.98).astype(float)
    rates, prior = np.zeros((2, patterns.shape[1])), 0.5
    for _ in range(rounds):
        bad, good = counts * post, counts * (1 - post)
        prior = float(np.clip(bad.sum() / max(counts.sum(), 1), 1e-4, 0.9))
        for j in range(patterns.shape[1]):
            g, v = given[:, j], votes[:, j]
            rates[0, j] = (bad[v].sum() + 1) / (bad[g].sum() + 2)
            rates[1, j] = (good[v].sum() + 0.1) / (good[g].sum() + 2)
        rates[0] = np.maximum(rates[0], rates[1] + 1e-3).clip(1e-4, 1 - 1e-4)
        rates[1] = rates[1].clip(1e-5, 1 - 1e-3)
        odds = np.log(prior / (1 - prior)) + np.where(votes, np.log(rates[0] / rates[1]), np.where(given, np.log((1 - rates[0]) / (1 - rates[1])), 0)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates, prior


def _features(t: Texts) -> list[np.ndarray]:
    """Distinct hashed features of each document: lower-case words, their beginnings, and the shapes of blank-separated words."""
    w = _letter_words(t)
    words = (mix(w.hashes()) % np.uint64(BINS)).astype(np.int64)
    stems = (mix(_stems(w, STEM) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)
    kind = np.full(256, 5, np.uint8)
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 1, 2, 3, 3
    kind[[ord(c) for c in "#*$%&<>"]] = 6
    kind[[ord(c) for c in "|"]] = 7
    kind[[ord(c) for c in "!"]] = 8
    s = space_words(t)
    tail = kind[t.data[s.end - 1]].astype(np.int64) if len(s.end) else np.zeros(0, np.int64)
    head = kind[t.data[s.start]].astype(np.int64) if len(s.start) else tail
    second = kind[t.data[np.minimum(s.start + 1, s.end - 1)]].astype(np.int64) if len(s.start) else tail
    shape = (head * 16 + second) * 16 + tail
    out = []
    for i in range(t.n):
        own = shape[s.at[i] : s.at[i + 1]]
        seen, n = np.unique(own, return_counts=True)
        out.append(np.unique(np.concatenate([words[w.at[i] : w.at[i + 1]], stems[w.at[i] : w.at[i + 1]], (seen[10 * n >= len(own)] * 7919 + 13) % BINS])))
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample: weights of both targets."""
    feats, labels = [], {"p_toxic": [], "p_quality": []}
    for batch in batches:
        for t in texts(batch.column(batch.schema.get_field_index("text"))):
            feats += _features(t)
        for k, x in labels.items():
            x += batch.column(batch.schema.get_field_index(k)).to_pylist()
    size = np.array([len(f) for f in feats], np.int64)
    idx = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    for target, y in (("toxic", labels["p_toxic"]), ("quality", labels["p_quality"])):
        y = np.array(y, float)
        w, bias = fit_sparse(idx, row, len(size), y)
        full = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([target] * (len(full) + 1)), pa.array([-1, *full], pa.int32()), pa.array([bias, *w[full]], pa.float64())], schema=pa.schema([("target", pa.string()), ("bin", pa.int32()), ("weight", pa.float64())]))


def fit_sparse(idx: np.ndarray, row: np.ndarray, n: int, y: np.ndarray, rounds: int = 150, l1: float = 2e-3) -> tuple[np.ndarray, float]:
    """L1 logistic regression on binary features by adaptive proximal gradient; classes weigh alike."""
    w, bias, seen = np.zeros(BINS), 0.0, np.full(BINS, 1e-8)
    if not n:
        return w, bias
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(row, w[idx], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(idx, g[row], BINS)
        seen += grad**2
        rate = 0.5 / np.sqrt(seen)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        bias -= 2.0 * g.sum()
    return w, bias


def _scores(weights: dict[str, tuple[np.ndarray, float]]):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("toxic_odds", pa.float64()), ("quality_odds", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "copy"))
            for t in texts(batch.column(batch.schema.get_field_index("text"))):
                feats = _features(t)
                cols = [pa.array([float(weights[k][0][f].sum() + weights[k][1]) for f in feats]) for k in ("toxic", "quality")]
                yield pa.RecordBatch.from_arrays([ids.slice(t.first, t.n), copies.slice(t.first, t.n), *cols], schema=schema)

    return task


def lexicon(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[list[str], dict[int, list[bytes]]]:
    """Words, and beginnings of words by their bytes, of at least five toxic documents that hardly any other labelled document holds, from
    ``most`` documents of each class."""
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(spot < F.when(F.col("toxic") == 1, min(1.0, most / sizes.get(1, 1))).otherwise(min(1.0, most / sizes.get(0, 1))))
    words = docs.join(small(keep(chosen.select("doc_id", "toxic"))), "doc_id").select("doc_id", "toxic", F.explode(F.array_distinct(blank_words(F.lower(F.col("text"))))).alias("word"))
    words = keep(words.select("doc_id", "toxic", F.regexp_extract("word", r"([a-z\x80-\x{10FFFF}]+)", 1).cast("binary").alias("word")).where("octet_length(word) > 0").distinct())
    marked = lambda rows: rows.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad >= 5 and bad >= 10 * good")
    whole = [bytes(r["word"]).decode() for r in marked(words).select("word").collect()]  # words of the bounded sample
    stems = {n: [bytes(r["word"]) for r in marked(words.where(F.octet_length("word") > n).select("doc_id", "toxic", F.substring("word", 1, n).alias("word")).distinct()).select("word").collect()] for n in STEMS}
    return whole, stems


def _digits(code: int, n: int) -> list[int]:
    return [code // 3**k % 3 for k in range(n - 1, -1, -1)]


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_toxic, p_low_quality, toxic, low_quality, kept; one row a document."""
    spark = docs.sparkSession
    docs, key = named(docs), ["doc_id", "copy"]
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.max(1 - F.col("quality")).cast("int").alias("bad"))
    labels = small(keep(labels))
    words, stems = lexicon(docs, labels)
    votes = docs.mapInArrow(_votes(_hash_of(INSULTS), _hash_of(words), {n: _hash_of(x) for n, x in stems.items()}), "doc_id long, copy long, toxic long, quality long")
    given = lambda c: F.coalesce(F.col(c), F.lit(2)).cast("long")
    votes = votes.join(labels.select("doc_id", F.col("toxic").alias("g_toxic"), "bad"), "doc_id", "left")
    votes = keep(votes.select(*key, (F.col("toxic") * 3 + given("g_toxic")).alias("toxic"), (F.col("quality") * 3 + given("bad")).alias("quality")))
    tables, classes = {}, {}
    for target, names in (("toxic", TOXIC), ("quality", QUALITY)):
        rows = votes.groupBy(target).count().collect()  # at most 3 ** labellers rows
        patterns = np.array([_digits(r[target], len(names)) for r in rows], np.int64).reshape(-1, len(names))
        post, _, _ = fit_labellers(patterns, np.array([r["count"] for r in rows], float))
        tables[target] = spark.createDataFrame([(int(r[target]), float(p)) for r, p in zip(rows, post, strict=True)], f"{target} long, p_{target} double")
        classes[target] = [max(1, sum(r["count"] for r, p in zip(rows, post, strict=True) if (p >= 0.5) == side)) for side in (True, False)]
    judged = keep(votes.join(F.broadcast(tables["toxic"]), "toxic").join(F.broadcast(tables["quality"]), "quality").select(*key, "p_toxic", "p_quality").distinct())
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for target in ("toxic", "quality"):
        for side, n in zip((F.col(f"p_{target}") >= 0.5, F.col(f"p_{target}") < 0.5), classes[target], strict=True):
            chosen |= side & (spot < min(1.0, sample / n))
    picked = docs.join(small(keep(judged.where(chosen))), key).select("text", "p_toxic", "p_quality")
    weights = {k: (np.zeros(BINS), 0.0) for k in ("toxic", "quality")}
    for r in picked.repartition(1).mapInArrow(_fit, "target string, bin int, weight double").collect():  # at most BINS weights a target
        w, bias = weights[r["target"]]
        if r["bin"] < 0:
            weights[r["target"]] = (w, r["weight"])
        else:
            w[r["bin"]] = r["weight"]
    scores = docs.mapInArrow(_scores(weights), "doc_id long, copy long, toxic_odds double, quality_odds double")
    judged = judged.select(*(F.col(c).alias(f"_{c}") for c in key), "p_toxic", "p_quality")
    both = scores.join(judged, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("copy").eqNullSafe(F.col("_copy")))
    odds = lambda p: F.log(F.col(p) / (1 - F.col(p)))
    p = lambda t: 1 / (1 + F.exp(-(SHARE * F.col(f"{t}_odds") + (1 - SHARE) * odds(f"p_{t}"))))
    out = both.select("doc_id", p("toxic").alias("p_toxic"), p("quality").alias("p_low_quality"))
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5).withColumn("low_quality", F.col("p_low_quality") >= 0.5).withColumn("kept", ~F.col("toxic") & ~F.col("low_quality"))


def op2_weak_labels(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
