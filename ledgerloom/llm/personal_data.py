"""Personal data: fixed patterns seed a bootstrapped contextual extraction.

1. One scan finds base spans (email, ip, card, phone) and, as candidates, every other token with a digit or an ``@`` and every
   run of two to four numeric tokens with ``RUN_DIGITS`` digits. Base spans and candidates are instances. Each gives edges
   (pattern, instance): the one to three tokens before it (``<``), the one to three after it (``>``), and its own shape (``=``:
   digits as 9, a run of letters as a).
2. A context can be a pattern only if at least ``TRIGGER`` of its occurrences in the corpus are beside an instance; every
   occurrence in every text is counted, once, for all contexts that several distinct instances share. Tasks hash every run of
   words, let those through that a filter of 2**24 bits (of any number of contexts) knows, and count a batch before the shuffle.
3. Rounds on the pattern-instance graph, all Spark jobs, until no instance is new (at most ``ROUNDS``): every pattern beside
   ``MIN_SEEDS`` known instances of a kind, those of earlier rounds included, is scored by RlogF, R * log2(F): F is the mass of
   its known instances, R that mass over the instances that can be of its kind (by characters; open ones can be of any). At
   ``ACCEPT`` or more, with R at ``SHARE`` or more, its unseen instances that can be of the kind become known with the
   pattern's score (1 at most), and induce patterns of their own in the next round.
4. Candidates of a known instance become spans of its kind: everywhere where the text has ``SURE_DIGITS`` digits or an ``@``,
   else beside an accepted pattern. An added span inside another of its kind is dropped. Base spans always stay.

Defined cases: null or empty text has no spans; overlapping spans of different kinds all stay; of kinds with equal scores the
alphabetically last wins; repeated rows are judged row by row, rows in are rows out, a null doc_id is kept; long texts are read
whole, and tokens, shapes and values of over ``LONG`` characters are told apart by SHA-256; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, named, small
from .textkit import Texts, grams, signed, space_words, texts

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, ACCEPT, TRIGGER, SHARE, ROUNDS = 3, 0.8, 0.5, 0.3, 8
RUN_DIGITS, SURE_DIGITS, LONG = (8, 19), 5, 64
#: The filter of contexts has 2**24 bits, in words of 64.
FILTER_WORDS = 1 << 18

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NUMERIC = re.compile(r"[+(]*[0-9][0-9().+-]*")
_DIGIT, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+")
_EDGE, _STOPS = ".,;:!?()[]{}<>\"'", ".,;:!?\"'"
_LOW = {c: c + 32 for c in range(65, 91)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _run_keys(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words (A-Z as a-z): their hashes, and which lie in one document."""
    w = space_words(Texts(_LOWER[t.data], t.at, t.first))
    h = w.hashes()
    return [(signed(grams(h, n, 0x9E3779B97F4A7C15 + 2 * n)), w.of_gram(n)) for n in (1, 2, 3)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` outwards in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(_LOCAL))
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
        floor = tail.end() if tail else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0] if c.isascii()) <= 15:
            out["phone"].append(m.span())
    return out


def _short(text: str) -> str:
    return text if len(text) <= LONG else "#" + hashlib.sha256(text.encode()).hexdigest()[:32]


class _Tokens:
    """Tokens of a text and the patterns of an instance in it."""

    def __init__(self, text: str):
        self.text, self.at = text, [m.span() for m in _TOKEN.finditer(text)]
        self.start = [a for a, _ in self.at]
        raw = np.frombuffer(text.encode(), np.uint8)
        self.keys = [k for k, _ in _run_keys(Texts(raw, np.array([0, len(raw)]), 0))]

    def word(self, k: int) -> str:
        a, b = self.at[k]
        return _short(self.text[a:b].translate(_LOW))

    def patterns(self, a: int, b: int) -> list[tuple[str, int]]:
        """Contexts (none on a side where the instance is only part of a token) with their hashes, and the shape of text[a:b]."""
        first, last = bisect_right(self.start, a) - 1, bisect_left(self.start, b) - 1
        out = [("=" + _short(_LETTERS.sub("a", _DIGIT.sub("9", self.text[a:b]))), 0)]
        if not self.text[self.at[first][0] : a].strip(_EDGE):
            words = [self.word(k) for k in range(max(0, first - 3), first)]
            out += [("<" + " ".join(words[-n:]), int(self.keys[n - 1][first - n])) for n in range(1, len(words) + 1)]
        if not self.text[b : self.at[last][1]].strip(_EDGE):
            words = [self.word(k) for k in range(last + 1, min(last + 4, len(self.at)))]
            out += [(">" + " ".join(words[:n]), int(self.keys[n - 1][last + 1])) for n in range(1, len(words) + 1)]
        return out

    def candidates(self, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether it is a single token) of instances that touch no base span."""
        j, reach, run = 0, 0, []
        for a, b in self.at:
            while j < len(taken) and taken[j][0] < b:
                reach = max(reach, taken[j][1])
                j += 1
            token = self.text[a:b]
            head, tail = len(token) - len(token.lstrip(_EDGE)), len(token.rstrip(_EDGE))
            free = reach <= a
            end = len(token.rstrip(_STOPS))
            numeric = free and _NUMERIC.fullmatch(token[:end]) is not None
            if free and head < tail and ("@" in token or _DIGIT.search(token)):
                yield a + head, a + tail, True
            if not numeric or (run and self.text[run[-1][1] : a] != " "):
                run = []
            if numeric:
                run = [*run[-3:], (a, b)]
                for x, _ in run[:-1]:
                    if RUN_DIGITS[0] <= len(_DIGIT.findall(self.text[x : a + end])) <= RUN_DIGITS[1]:
                        yield x, a + end, False
                if end < len(token):
                    run = []


SPANS = "row long, doc_id long, copy long, kind string, first long, last long, value string, single boolean, digits int, patterns array<struct<name:string,key:long>>, base array<string>"
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("value", pa.string()), ("single", pa.bool_()), ("digits", pa.int32()), ("patterns", pa.list_(pa.struct([("name", pa.string()), ("key", pa.int64())]))), ("base", pa.list_(pa.string()))])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (``base`` set) and for each base span or candidate (``value`` set)."""
    marks = np.zeros(256, bool)
    marks[list(b"0123456789@")] = True
    for batch in batches:
        rows, ids, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "doc_id", "copy"))
        for t in texts(batch.column(batch.schema.get_field_index("text"))):
            has = np.add.reduceat(np.append(marks[t.data], False).astype(np.int64), t.at[:-1]) * (np.diff(t.at) > 0) if t.n else []
            out: list[tuple] = []
            for i in range(t.n):
                own = tuple(x[t.first + i] for x in (rows, ids, copies))
                text = t.text(i).decode() if has[i] else ""
                found = base_spans(text)
                out.append((*own, *[None] * 7, [f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]]))
                if not text:
                    continue
                tokens = _Tokens(text)
                every = [(k, a, b, True) for k in KINDS for a, b in found[k]]
                every += [(None, a, b, single) for a, b, single in tokens.candidates(sorted(s for k in KINDS for s in found[k]))]
                out += [(*own, k, a, b, _short(text[a:b].lower()), single, len(_DIGIT.findall(text[a:b])), [{"name": n, "key": x} for n, x in tokens.patterns(a, b)], None) for k, a, b, single in every]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _shape(value):
    """The kind that the characters of an unseen instance tell; null if they leave it open."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    plain = ~value.rlike("[^0-9+() ./-]")
    return F.when(value.contains("@"), "email").when(value.rlike("^[0-9]+([.][0-9]+){3}$"), "ip").when(plain & (digits >= 16), "card").when(plain, "phone")


def _uses(bits: np.ndarray):
    """(key, uses) of the runs of one to three words that the filter lets through."""
    schema = pa.schema([("key", pa.int64()), ("uses", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for t in texts(batch.column(batch.schema.get_field_index("text"))):
                for key, inside in _run_keys(t):
                    own = key[inside].view(np.uint64)
                    known = bits[(own >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (own & np.uint64(63)) & np.uint64(1)
                    found.append(signed(own[known == 1]))
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], schema=schema)

    return task


def triggers(beside: DataFrame, docs: DataFrame) -> DataFrame:
    """Patterns that can be scored: shapes, and contexts that mostly stand beside instances. ``beside`` has pattern, key, value, single."""
    shared = keep(beside.groupBy("pattern", "key").agg(F.count_distinct("value").alias("values"), F.sum(F.col("single").cast("long")).alias("hits")).where(F.col("values") >= MIN_SEEDS).select("pattern", "key", "hits"))
    contexts = shared.where("pattern not like '=%'")
    place = F.pmod(F.shiftrightunsigned("key", 6), F.lit(FILTER_WORDS)).cast("int")
    bits = np.zeros(FILTER_WORDS, np.uint64)
    for r in contexts.groupBy(place.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b")).collect():  # FILTER_WORDS rows at most
        bits[r["at"]] = np.int64(r["b"]).view(np.uint64)
    uses = docs.select("text").mapInArrow(_uses(bits), "key long, uses long").groupBy("key").agg(F.sum("uses").alias("uses"))
    good = contexts.join(uses, "key").where(F.col("hits") >= TRIGGER * F.col("uses"))
    return keep(good.select("pattern").unionByName(shared.where("pattern like '=%'").select("pattern")))


def discovered(edges: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(value, kind, score) of unseen instances and the accepted (pattern, kind, score) that found them.

    ``edges`` has value, kind (null: candidate), single and patterns (name, key); ``docs`` has every text.
    """
    seeds = keep(edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0)))
    beside = keep(edges.select("value", "kind", "single", F.explode("patterns").alias("p")).select("value", "kind", "single", F.col("p.name").alias("pattern"), "p.key"))
    graph = beside.groupBy("pattern", "value").agg(F.max("kind").isNotNull().alias("seen"))
    graph = keep(graph.join(triggers(beside, docs), "pattern").withColumn("shape", _shape(F.col("value"))))
    unseen = graph.where("not seen").select("pattern", "value", "shape")
    known, patterns, before = seeds, None, 0
    for _ in range(rounds):
        mass = graph.join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("held")).where(F.col("held") >= MIN_SEEDS)
        able = F.col("shape").isNull() | (F.col("shape") == F.col("kind"))
        rivals = unseen.join(mass.select("pattern", "kind"), "pattern").where(able)
        fresh = rivals.join(known.select("value", "kind"), ["value", "kind"], "left_anti").groupBy("pattern", "kind").agg(F.count("*").alias("open"))
        share = F.col("mass") / (F.col("held") + F.coalesce("open", F.lit(0)))
        patterns = mass.join(fresh, ["pattern", "kind"], "left").where(share >= SHARE).select("pattern", "kind", (share * F.log2("mass")).alias("score")).where(F.col("score") >= ACCEPT)
        patterns = keep(patterns)
        found = rivals.join(patterns.select("pattern", "kind", F.least("score", F.lit(1.0)).alias("score")), ["pattern", "kind"]).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best"))
        new = keep(found.select("value", "best.kind", "best.score").join(seeds.select("value"), "value", "left_anti"))
        known, count = seeds.unionByName(new), new.count()
        if count == before:
            break
        before = count
    return known.join(seeds.select("value"), "value", "left_anti"), patterns


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, copy (hash of the text), base (kind:start:end strings), added (the same, from discovered instances)."""
    docs = named(docs)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    table = keep(numbered.select("row", "doc_id", "copy", "text").mapInArrow(_spans, SPANS))
    edges = table.where("base is null")
    new, patterns = discovered(edges, docs, rounds)
    may = keep(edges.where("kind is null").drop("kind").join(new.select("value", "kind"), "value"))
    sure = (F.col("digits") >= SURE_DIGITS) | F.col("value").contains("@")
    here = ["row", "first", "last", "kind"]
    near = may.where(~sure).select(*here, F.explode("patterns.name").alias("pattern")).join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select(*here)
    added = may.where(sure).select(*here).unionByName(near).distinct()
    before = Window.partitionBy("row", "kind").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("last").over(before)).where("reach is null or last > reach")
    spans = added.groupBy("row").agg(F.collect_list(F.struct(F.col("kind"), F.col("first"), F.col("last"))).alias("added"))
    return table.where("base is not null").select("row", "doc_id", "copy", "base").join(spans, "row", "left")


def with_spans(found: DataFrame) -> DataFrame:
    """Digest columns: n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, ordered by kind then start)."""
    order = F.array(*(F.lit(k) for k in KINDS))
    part = lambda x, i: F.split(x, ":")[i]
    old = F.transform("base", lambda x: F.struct(F.array_position(order, part(x, 0)).alias("k"), part(x, 1).cast("long").alias("a"), part(x, 2).cast("long").alias("b")))
    new = F.transform(F.coalesce("added", F.array().cast("array<struct<kind:string,first:bigint,last:bigint>>")), lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["first"].alias("a"), x["last"].alias("b")))
    every = F.array_sort(F.array_distinct(F.concat(old, new)))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(order, x["k"].cast("int")), x["a"].cast("string"), x["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: F.startswith(x, F.lit(f"{k}:")))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", "copy", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), text.alias("spans"))


def redact(spark_docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; all columns stay, ``n_chars`` follows the text."""
    spans = with_spans(find_personal_data(spark_docs, rounds)).where("spans != ''")
    notes = keep(spans.select(F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy"), F.col("spans").alias("__spans")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__copy"))
    joined = spark_docs.join(small(notes), same, "left")
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def masked(text, spans):
        import pandas as pd

        return pd.Series([mask(a, b) if isinstance(b, str) else a for a, b in zip(text, spans, strict=True)], dtype=object)

    hit = joined.where("__spans is not null").withColumn("text", masked("text", "__spans"))  # only these rows reach Python
    if "n_chars" in spark_docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(spark_docs.schema["n_chars"].dataType))
    return joined.where("__spans is null").select(*spark_docs.columns).unionByName(hit.select(*spark_docs.columns))


def mask(text: str, spans: str) -> str:
    """``text`` with the spans replaced; overlapping spans are replaced together by the first one's kind."""
    parts, end = [], 0
    for a, b, k in sorted((int(x[1]), int(x[2]), x[0]) for x in (s.split(":") for s in spans.split(","))):
        if a >= end:
            parts += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return with_spans(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("copy")
