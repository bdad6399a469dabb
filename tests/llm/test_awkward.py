"""All ten operators on one table of awkward rows: repeated ids with equal and other texts, null ids, a text of 100,000 words, ties, clashing columns."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from ledgerloom.llm import decontaminate, jaccard_join, packing, personal_data, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_file, weak_labels  # noqa: E402

from . import brute  # noqa: E402
from .conftest import prose  # noqa: E402

P = pytest.importorskip("public_tokenizers")
SCHEMA = "copy long, doc_id long, text string, source string, row long, word string, mini long, kind string, id long, label double, n long, window string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passage, base, long = prose(rng, 60), prose(rng, 130), prose(rng, 100_000)
    other = base.replace(",", ";", 1) + " end"
    card = "so 4111111111111111 it a.b@x.org or 8.8.8.8"
    out = [(7, base), (7, base), (7, other), (7, None), (3, "x " + passage), (None, base), (None, base), (None, ""), (9, base), (5, passage + " and " + prose(rng, 40)), (5, passage), (11, long), (12, long[:4000] + " " + passage)]
    out += [(13, None), (14, ""), (15, " \n "), (15, card), (15, card), (None, card), (16, "key" + "a1" * 9000 + " api_key=9f8e7d6c5b4a39281706f5e4"), (-1, prose(rng, 30)), (-1, base)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    data = [(1, i, t, "s" if k % 2 else None, 0, "w", 1, "email", 0, 1.0, 1, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def test_token_file(spark, rows, table, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in rows)
    token_file.write_tokens(table, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 0, block=300)
    got = sorted(token_file.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_wide_codes():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 70_000)
    codec = token_file.Codec(np.arange(70_000), token_file.code_lengths(counts, 18), 70_000, 18)
    ids = rng.integers(0, 70_000, 5000)
    stream, runs = codec.encode(ids)
    assert (codec.decode(stream, runs, len(ids)) == ids).all()


def test_weak_labels(spark, rows, table):
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (None, 1, 1), (14, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = weak_labels.score_documents(table, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and all(0 <= r["p_toxic"] <= 1 for r in got)


def test_packing(rows, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, got, ids = Counter(), Counter(), Counter()
    for i, x in rows:
        own = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i] += len(own)
        ids.update(own)
    for r in packing.pack(table, P.path("word_bpe_49k.json"), size=256, most=4).collect():
        got[r["doc_id"]] += r["length"]
        ids.subtract(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want and not any(ids.values())


@pytest.mark.parametrize("hot", [200_000, 20])
def test_substring_dedup(rows, table, hot):
    words = [brute.re.findall(brute.BLANK, t or "") for _, t in rows]
    gone = brute.repeated_rows([i for i, _ in rows], words, lambda w, j: " ".join(w[j : j + 50]))
    want = Counter((i, len(w), sum(g), brute.sha(" ".join(x for x, y in zip(w, g, strict=True) if not y))) for (i, _), w, g in zip(rows, words, gone, strict=True))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_windows(table, hot=hot).collect())
    assert got == want


@pytest.mark.parametrize("hot", [200_000, 30])
def test_suffix_dedup(rows, table, hot):
    raw = [(t or "").encode() for _, t in rows]
    gone = brute.repeated_rows([i for i, _ in rows], raw, lambda b, j: b[j : j + 50])
    want = Counter((i, len(b), sum(g), hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()) for (i, _), b, g in zip(rows, raw, gone, strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(table, hot=hot).collect())
    assert got == want


def test_hash_collisions(monkeypatch, rows, table):
    """Words that share a hash are still told apart."""
    import pyarrow as pa

    w = substring_dedup._words_of([b"aa bb cc aa", b"bb aa"])
    monkeypatch.setattr(type(w), "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    rank = substring_dedup.word_ranks(w)
    assert rank[0] == rank[3] == rank[5] and rank[1] == rank[4] and len(set(rank.tolist())) == 3 and pa


def test_decontaminate(spark, rows, table):
    long = rows[11][1].split()
    items = [(1, " ".join(long[50_000:50_020])), (1, " ".join(long[50_000:50_020])), (2, " ".join(long[99_900:])), (3, rows[4][1]), (None, "it a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_row = brute.contaminated(dict(enumerate(t for _, t in rows)), [(n, t) for n, t in items if n is not None])
    want = Counter((i, *map(str, by_row[k])) for k, (i, _) in enumerate(rows))
    got = decontaminate.decontaminate(table, bench.where("item_id is not null")).collect()
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"]), str(r["contaminated"])) for r in got) == want


def test_personal_data(rows, table):
    want = Counter()
    for i, t in rows:
        p = brute.personal(t or "")
        want[i, tuple(len(p[k]) for k in personal_data.KINDS), brute.sha(",".join(f"{k}:{a}:{b}" for k in personal_data.KINDS for a, b in p[k]))] += 1
    got = personal_data.with_spans(personal_data.find_personal_data(table)).collect()
    assert Counter((r["doc_id"], tuple(r[f"n_{k}"] for k in personal_data.KINDS), r["base_sha256"]) for r in got) == want
    assert personal_data.redact(table).count() == len(rows)


@pytest.mark.parametrize("cell", [1024, 3])
def test_jaccard_join(monkeypatch, rows, table, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    s = [brute.shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if (i is not None and i == j) or (s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])):
                top[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    want = Counter((i, len(s[a]), least.get(root(a))) for a, (i, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table).collect()) == want


def test_quality_rules(rows, table):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((i, brute.rules(t)) for i, t in rows)
    got = quality_rules.line_verdicts(table).collect()
    assert Counter((r["doc_id"], tuple(r[c] for c in names)) for r in got) == want
    assert quality_rules.cleaned(table).count() == sum(r["kept"] for r in got)


def test_secret_scan(rows, table):
    got = secret_scan.findings(table).collect()
    assert Counter(r["doc_id"] for r in got)[15] == 2 and len(got) == Counter(t for _, t in rows)[rows[16][1]] + 2
    assert {r["label"] for r in got if r["doc_id"] == 16} == {None, 1.0} and all(r["label"] == 0 for r in got if r["doc_id"] == 15)
