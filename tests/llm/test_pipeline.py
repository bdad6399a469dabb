"""The whole pipeline, and each of its stages, against plain code."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm.personal_data import mask

from . import brute
from .conftest import prose

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda i: "abcdefghijklmnop"[i % 16] + "xyz"[i % 3]
    base, item = prose(rng, 90), prose(rng, 30)
    rows = [(1, None), (2, ""), (3, "too few words"), (4, "same words again and " * 30), (5, base), (5, base), (6, base.replace(" ", "  ", 3)), (7, " ".join([*base.split()[:-1], "other"])), (8, prose(rng, 40) + " " + item + " " + prose(rng, 5)), (9, prose(rng, 3000))]
    rows += [(10 + i, f"{prose(rng, 30)} {word(i)} mail: u{i}@site.example.org {word(i + 1)} {prose(rng, 10)}") for i in range(6)]
    rows += [(20, f"{prose(rng, 30)} q mail: someone(at)site99 k {prose(rng, 4)}"), (21, prose(rng, 60) + " 4111111111111111"), (None, prose(rng, 50)), (None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    data = [(i, t, "en", f"s{k % 2}" if k % 5 else None, len(t or ""), "extra") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int, row string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, None), (3, "never there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain(rows, items):
    """Texts that reach packing, as (doc_id, text)."""
    rows = [(i, t) for i, t in rows if not brute.rules(t)[-1]]
    sets = [brute.shingles(t, 5) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    rows = list(dict.fromkeys((i, t) for a, (i, t) in enumerate(rows) if least.get(root(a), i) == i))
    hit = brute.contaminated(dict(enumerate(t for _, t in rows)), items)
    rows = [r for k, r in enumerate(rows) if not hit[k][-1]]
    spans = brute.bootstrap([t for _, t in rows])
    return [(i, mask(t, spans[k]) if spans[k] else t) for k, (i, t) in enumerate(rows)]


def test_pipeline(spark, case):
    from tokenizers import Tokenizer

    folder, rows, items = case
    want = plain(rows, items)
    assert {8, 1, 2, 3, 4, 6, 7}.isdisjoint({i for i, _ in want}) and "[EMAIL]" in dict(want)[20] and "[CARD]" in dict(want)[21]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in want}
    got, seen = corpus_pipeline.run(spark, folder).collect(), {i: 0 for i in ids}
    assert len(ids) == len(want)
    for r in sorted(got, key=lambda r: r["start"]):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}


def test_stages_keep_columns(spark, case):
    folder, rows, _ = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").where("false"), folder).count() == 0, name
