"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from ledgerloom.llm import alignment

from .conftest import prose

P = pytest.importorskip("public_tokenizers")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(rows):
    p = alignment.Pair(P.path(A), P.path(B))
    chars = alignment.byte_of_char()
    docs, held = [], Counter()
    for i, t in rows:
        ids = p.a.encode(" " + t, add_special_tokens=False).ids if t else []
        other = p.b.encode(t) if t else []
        left = [bytes(chars[c] for c in p.a.id_to_token(x)) for x in ids]
        right = [bytes([int(s[3:5], 16)]) if p.b.is_byte(y) else s.replace("▁", " ").encode() for y in other for s in [p.b.id_to_piece(y)]]
        groups, a, b, at, to = [], [], [], 0, 0
        if t and b"".join(left) == (" " + t).encode() == b"".join(right):
            j = 0
            for x, raw in zip(ids, left, strict=True):
                a.append(x)
                at += len(raw)
                while j < len(other) and to < at:
                    b.append(other[j])
                    to += len(right[j])
                    j += 1
                if at == to:
                    groups.append((a, b))
                    a, b = [], []
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(set(links))
        docs.append((i, groups, links))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = Counter()
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for (x, y), n in links.items() if held[x, y] == top[x])
        out[i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out, {(*k, n, n == top[k[0]]) for k, n in held.items()}


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(4)
    odd = [" lead", "trail ", "a  b   c", "\n\n x \t y\r\n", "x▁y z", "　 wide　space \xa0no break\xa0 ", "<s> </s> <|endoftext|> <unk> <0x0A>", "日本語 한국어 🙂🙃 é ﬁ", "\x00\x01 \x1c \x7f", "don't it's  we'll", "a" * 3000 + " " + "日" * 700, "1234567 89 0.5", "﻿ bom", "é" * 41 + " ́", "  ", " ", "\n", "x \x85y   z"]
    out = [*texts.items(), *((500 + k, t) for k, t in enumerate(odd)), (7, "again " + odd[2]), (7, odd[2]), (None, odd[2]), (None, None), (900, prose(rng, 30_000))]
    return out + [(1000 + k, "".join(rng.choice("ab é\n 日'▁.1") for _ in range(rng.randrange(1, 60)))) for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, row long, pairs string, a long, docs long").repartition(3)


@pytest.mark.parametrize("held", [None, 5])
def test_alignment(monkeypatch, docs, rows, held):
    if held:
        monkeypatch.setattr(alignment, "ROWS_AT_ONCE", held)
    out, pairs = alignment.align_tokenizers(docs, P.path(A), P.path(B))
    want, table = plain(rows)
    assert Counter(tuple(r[c] for c in COLS) for r in out.collect()) == want
    assert {tuple(r) for r in pairs.select("a", "b", "docs", "best").collect()} == table


def test_hot_pairs(monkeypatch, docs, rows):
    """Counts that are too large to broadcast are joined with their hot pairs dealt out."""
    from ledgerloom.llm import store

    monkeypatch.setattr(alignment, "meet", lambda *a: store.spread_join(*a, each=10))
    out, _ = alignment.align_tokenizers(docs, P.path(A), P.path(B))
    assert Counter(tuple(r[c] for c in COLS) for r in out.collect()) == plain(rows)[0]


def test_forgets(monkeypatch, rows):
    """A worker that drops what it holds gives the same."""
    monkeypatch.setattr(alignment, "HELD", 10)
    p = alignment.Pair(P.path(A), P.path(B))
    once, texts = alignment.Aligner(p), [t for _, t in rows if t]
    for t in texts[:20]:
        work = alignment.Aligner(p)
        want = once.documents([t])
        work.documents(texts[20:25])
        work.forget()
        assert work.documents([t])[0] == want[0]


def test_whole_where_cuts_are_unsafe(rows):
    p = alignment.Pair(P.path(A), P.path(B))
    assert p.cuts
    text = " ".join(t for _, t in rows[:12] if t)
    want = alignment.Aligner(p).documents([text])[0]
    p.cuts = False
    assert alignment.Aligner(p).documents([text])[0] == want


def test_empty(docs):
    out, pairs = alignment.align_tokenizers(docs.limit(0), P.path(A), P.path(B))
    assert out.count() == 0 and pairs.count() == 0


def test_given_tables(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    out = alignment.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert out.columns == list(COLS) and Counter(tuple(r) for r in out.collect()) == plain(rows)[0]
