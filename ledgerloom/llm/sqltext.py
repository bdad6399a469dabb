"""Column expressions for words and lines, evaluated by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters.
BLANKS = " \t\n\x0b\f\r"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def plain_words(text: Column) -> Column:
    """Words of letters, digits and characters outside ASCII, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def covered(starts: Column, length: Column | int) -> Column:
    """How many positions the runs [s, s + length) of an ascending array of starts cover."""
    size = F.lit(length) if isinstance(length, int) else length
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + s + size - F.greatest(acc["end"], s.cast("long"))).cast("long").alias("n"), (s + size).cast("long").alias("end"))
    return F.aggregate(starts, first, step, lambda acc: acc["n"])


def run_hashes(words: Column, k: int) -> Column:
    """Hash of every run of ``k`` words: each word once, then runs twice as long from two neighbours, last two that overlap."""

    def pairs(h: Column, step: int) -> Column:
        return let(h, lambda v: F.zip_with(F.slice(v, 1, F.size(v) - step), F.slice(v, 1 + step, F.size(v) - step), lambda a, b: F.xxhash64(a, b)))

    h, size = F.transform(words, lambda x: F.xxhash64(x)), 1
    while size * 2 <= k:
        h, size = pairs(h, size), size * 2
    return pairs(h, k - size) if k > size else h


def repeated_words(words: Column, k: int) -> Column:
    """Words inside runs of ``k`` words that occur at least twice in ``words``."""

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            twice = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            return covered(F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"])), k)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, again))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(let(run_hashes(words, k), of))
