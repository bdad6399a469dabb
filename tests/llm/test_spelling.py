"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling

from .brute import LOW


def plain(rows):
    """word -> (form, root, n, n_near, form_n)."""
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    deleted = {}
    for w in n:
        for k in range(len(w)):
            deleted.setdefault((w[:k] + w[k + 1 :], k), set()).add(w)
    near = {w: set() for w in n}
    for (less, _), own in deleted.items():
        for w in own:
            near[w] |= own - {w}
        if less in n:
            near[less] |= own
            for w in own:
                near[w].add(less)
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        top = w
        while form[top]:
            top = form[top]
        out[w] = (form[w], top, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def changed(rng, w):
    k, c = rng.randrange(len(w)), rng.choice("aeinrstéüÿÉ")
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("aeinrsté") for _ in range(rng.randrange(4, 12))) for _ in range(250)]
    words = base + [changed(rng, w) for w in base for _ in range(4)]
    words += [changed(rng, w) for w in words[-400:]] + ["x" * 300, "x" * 301, "x" * 299 + "y", "abcde", "×÷×÷×"]
    words += ["".join(p) for p in {tuple(rng.sample("abcdefg", 7)) for _ in range(300)}]  # one point, many words
    out = [(i, " ".join(rng.choice((str.upper, str.lower, str.title))(w) for w in rng.choices(words, k=rng.randrange(5, 400)))) for i in range(60)]
    return out + out[:3] + [(None, out[4][1]), (None, None), (7, ""), (8, " 12 34 "), (9, out[5][1].replace(" ", "-9")), (-3, (words[0] + " ") * 20_000), (99, "y" * 60_000 + " " + "y" * 60_000 + "  " + "y" * 60_000 + " " + ("y" * 59_999 + " ") * 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "f") for i, t in rows], "doc_id long, text string, word string, n long, size int, form string").repartition(3)


@pytest.mark.parametrize(("cell", "sample"), [(spelling.CELL, spelling.SAMPLE), (20, spelling.SAMPLE), (15, 30)])
def test_variants(spark, rows, docs, cell, sample):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs, cell=cell, sample=sample).collect()}
    want = plain(rows)
    assert len(want) > 500 and any(len(w) > 1000 for w in want) and any(f and r != f for f, r, *_ in want.values())
    assert got == want


def test_empty(spark, docs):
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_given_tables(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    out = spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001")
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r["word"]: tuple(r)[1:] for r in out.collect()} == plain(rows)


def test_boxes():
    """Every point that one edit's moves reach lies in a leaf that is found."""
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (400, spelling.DIMS)).astype(np.int16)
    for tight in (True, False):
        tree = spelling.Tree(points, 7, tight)
        place = tree.place(points)
        for up, down in spelling.MOVES.values():
            ask = np.clip(points + np.eye(spelling.DIMS, dtype=np.int16)[rng.integers(0, spelling.DIMS, 400)] * -up + np.eye(spelling.DIMS, dtype=np.int16)[rng.integers(0, spelling.DIMS, 400)] * down, 0, 255).astype(np.int16)
            found = set(zip(*(x.tolist() for x in tree.reach(ask, up, down)), strict=True))
            near = (np.maximum(points[None] - ask[:, None], 0).sum(2) <= up) & (np.maximum(ask[:, None] - points[None], 0).sum(2) <= down)
            assert {(i, place[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True)} <= found
