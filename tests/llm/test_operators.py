"""Each operator against its plain version on texts with every awkward case, and on an empty table."""

import os
import re
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from ledgerloom.llm import induced_sort, jaccard_join, packing, token_file  # noqa: E402
from ledgerloom.llm.components import components  # noqa: E402
from ledgerloom.llm.decontaminate import decontaminate  # noqa: E402
from ledgerloom.llm.personal_data import KINDS, base_spans, find_personal_data, mask, redact, with_spans  # noqa: E402
from ledgerloom.llm.quality_rules import cleaned, line_verdicts  # noqa: E402
from ledgerloom.llm.secret_scan import FEATURES, candidates, findings  # noqa: E402
from ledgerloom.llm.substring_dedup import dedup_windows  # noqa: E402
from ledgerloom.llm.suffix_dedup import dedup_bytes  # noqa: E402
from ledgerloom.llm.weak_labels import fit_labellers, score_documents  # noqa: E402

from . import brute  # noqa: E402

P = pytest.importorskip("public_tokenizers")


def ids_of(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in texts.items()}


def test_token_file(spark, docs, texts, empty, tmp_path):
    want, start = ids_of(texts, "byte_bpe_50k.json", 0), 0
    token_file.write_tokens(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 0, block=500)
    got = {r["doc_id"]: r for r in token_file.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        r = got[i]
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(want[i]), want[i].tobytes(), zlib.crc32(want[i].tobytes()))
        start += len(want[i])
    token_file.write_tokens(empty, str(tmp_path / "e"), P.path("byte_bpe_50k.json"), 0)
    assert token_file.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, bits in ((2, 16), (3, 2), (100, 7), (1000, 16), (64, 6)):
        counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = token_file.code_lengths(counts, bits)
        assert lengths.max() <= bits and abs((0.5**lengths).sum() - 1) < 1e-12
        ids = rng.integers(0, n, 3000)
        codec = token_file.Codec(np.arange(n), lengths, n)
        stream, runs = codec.encode(ids)
        assert (codec.decode(stream, runs, len(ids)) == ids).all()


def test_packing(docs, texts, empty):
    path = P.path("word_bpe_49k.json")
    want = ids_of(texts, "word_bpe_49k.json", 1)
    rows = packing.pack(docs, path, size=256, most=4).collect()
    pieces, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert (want[r["doc_id"]][r["start"] : r["start"] + r["length"]] == ids).all() and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for group, total in ((pieces, {i: len(x) for i, x in want.items()}), (windows, None)):
        for k, x in group.items():
            at = 0
            for a, n in sorted(x):
                assert a == at
                at += n
            assert at == total[k] if total else at <= 256
    assert set(pieces) == set(texts)
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("hot", [200_000, 20])
def test_substring_dedup(docs, texts, empty, hot):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_windows(docs, hot=hot).collect()}
    assert got == brute.windows(texts)
    assert any(x[1] for x in got.values())
    assert dedup_windows(empty).count() == 0


@pytest.mark.parametrize(("hot", "part", "held"), [(200_000, 1 << 20, 1 << 23), (30, 500, 1 << 10), (200_000, 1 << 20, 1 << 10)])
def test_suffix_dedup(docs, texts, empty, hot, part, held):
    """The last case sorts parts a thousand times as large as what a queue holds in memory."""
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_bytes(docs, hot=hot, part=part, held=held).collect()}
    assert got == brute.byte_strings(texts)
    assert dedup_bytes(empty).count() == 0


@pytest.mark.parametrize("most", [1 << 15, 7])
def test_induced_sort(monkeypatch, most):
    """Order and shared characters, in memory and from files, with small batches and name buckets; queues do spill."""
    monkeypatch.setattr(induced_sort, "BATCH", most)
    monkeypatch.setattr(induced_sort, "NAMES", most)
    spilled = []
    push = induced_sort.Buckets.push
    monkeypatch.setattr(induced_sort.Buckets, "push", lambda self, *a: (push(self, *a), spilled.append(self.spilled))[0])
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (2, 1), (50, 2), (800, 3), (900, 1), (700, 40), (2500, 2)):
        s = np.append(rng.integers(1, k + 1, n), 0).astype(np.uint8)
        if n == 800:
            s[:-1] = np.tile(s[:100], 8)
        raw = s.tobytes()
        want = sorted(range(n + 1), key=lambda i: raw[i:], reverse=True)
        for held in (64, 1 << 20):
            assert induced_sort.suffix_order(s, held).tolist() == want[::-1]
            rows = np.concatenate(list(induced_sort.sorted_suffixes(s, 50, held)))
            assert (rows >> induced_sort.BITS).tolist() == want
            for a, b, x in zip(want, want[1:], rows[1:].tolist(), strict=False):
                assert min(len(os.path.commonprefix([raw[a:], raw[b:]])), 50) == min(x & induced_sort.LOW, 50)
    assert max(spilled) > 0


@pytest.mark.parametrize("cell", [1024, 3])
def test_jaccard_join(monkeypatch, docs, texts, empty, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute.components(texts)
    assert jaccard_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("k", [4, 1])
def test_jaccard_division(monkeypatch, spark, k):
    """Large regions divided five times: common shingles in all texts, small sets, chains of near copies; against all pairs."""
    monkeypatch.setattr(jaccard_join, "CELL", 2)
    monkeypatch.setattr(jaccard_join, "DIVIDE", 3)
    monkeypatch.setattr(jaccard_join, "PAIRS", 3)
    rng = np.random.default_rng(k)
    common = [f"c{j}" for j in range(8)]
    rows, base = [], [f"w{j}" for j in range(40)]
    for i in range(40):
        text = list(common) + [f"x{rng.integers(0, 12)}" for _ in range(int(rng.integers(0, 4)))]
        if i % 4 == 0:
            base[int(rng.integers(0, 40))] = f"e{i}"
            text = list(base)
        rows.append((i, " ".join(text)))
    sets = {i: brute.shingles(t, k) for i, t in rows}
    top = list(range(40))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=80).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(40)}


def test_pipeline_near_duplicates(spark):
    """Two of 100 words changed: 5-word Jaccard 86/106 is a copy for the stage, 4-word 89/105 is none for op7."""
    from corpus_pipeline import near_duplicate_stage

    base = [f"w{j}" for j in range(100)]
    edit = [f"edit{j}" if j in (30, 70) else w for j, w in enumerate(base)]
    table = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edit))], "doc_id long, text string")
    assert [r["doc_id"] for r in near_duplicate_stage(spark, table, "").collect()] == [1]
    assert jaccard_join.jaccard_components(table).where("doc_id != component_id").count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_decontaminate(spark, docs, texts, empty):
    long = max((t for t in texts.values() if t), key=len).split()
    items = [(1, " ".join(long[40:60])), (2, " ".join(long[45:80])), (3, "two WORDS"), (4, None), (5, ""), (6, "one"), (7, " ".join(long[40:60])), (8, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(docs, bench).collect()}
    assert got == brute.contaminated(texts, items)
    assert decontaminate(empty, bench).count() == 0
    assert not decontaminate(docs, bench.limit(0)).where("n_hit > 0").count()


SAMPLES = ["mail a.b+c@x-y.co.uk, @no x@y a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-9", "+1 (555) 123-4567 +12 +1((((( +351 912.345.678 9", "", "9" * 400 + ".1.1.1", "é@ü.de é.x@ab.de"]


def test_base_spans(texts):
    for t in [*SAMPLES, *(t or "" for t in texts.values())]:
        assert base_spans(t) == brute.personal(t)
    assert not base_spans("9" * 5000 + ".1.1.1")["ip"]


def test_personal_data(spark, empty):
    found = [f"person {w} contact: user{i}@mail.example.com or so" for i, w in enumerate("abcdefghijklmnop")]
    rows = list(enumerate([*found, "please contact: user99(at)mail99123", "the number 99123 is free", None, *SAMPLES]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in with_spans(find_personal_data(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute.personal(t or "")
        assert [got[i][f"n_{k}"] for k in KINDS] == [len(want[k]) for k in KINDS]
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in want[k]))
    assert got[16]["spans"] == "email:16:35" and got[17]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean[0] == "person a contact: [EMAIL] or so" and clean[18] is None
    assert mask("abcdef", "ip:1:3,card:2:5") == "a[IP]f"
    assert redact(empty).columns == empty.columns and find_personal_data(empty).count() == 0


def test_personal_data_patterns(spark):
    """40 % unseen instances, two kinds behind one context, and a context of several tokens that only together precede identifiers."""
    alpha = "abcdefghijklmnopqrst"
    text = [f"q{c} ring: +351 912 345 6{i:02} u{c}" for i, c in enumerate(alpha[:6])] + [f"r{c} ring: 91234561{i} v{c}" for i, c in enumerate(alpha[:4])]
    text += [f"s{c} contact: user{i}@mail.example.com w{c}" for i, c in enumerate(alpha[:6])] + [f"t{c} contact: +351 912 777 6{i:02} x{c}" for i, c in enumerate(alpha[:6])] + ["ta contact: 912777699 xz"]
    text += [f"y{c} reach me at me{i}@mail.example.com k{c}" for i, c in enumerate(alpha[:6])] + [f"m{c} sits at home o{c}" for c in alpha] + ["yz reach me at who99123(at)mail kz", "the 99887766 is free"]
    got = {r["doc_id"]: r["spans"] for r in with_spans(find_personal_data(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"))).collect()}
    assert all(got[i] == "phone:9:18" for i in range(6, 10))
    assert got[22] == "phone:12:21"
    assert got[len(text) - 2] == "email:15:31" and got[len(text) - 1] == ""


def test_personal_data_rounds(spark):
    """Shapes find what the fixed patterns miss, a context found through them finds more in the next round; against plain loops."""
    rng = np.random.default_rng(3)
    number = lambda n: "".join(rng.choice(list("123456789"), n))

    def card(valid):
        while True:
            c = number(16)
            if bool(brute.personal(c)["card"]) == valid:
                return c

    alpha = [a + b for a in "abcdefgh" for b in "klmnop"]
    word = lambda i, x: f"{x}{alpha[i % 48]}"
    text = [f"{word(i, 'a')} {card(True)} {word(i, 'b')}" for i in range(9)] + [f"{word(i, 'c')} blip zap {card(False)} {word(i, 'd')}" for i in range(5)]
    text += [f"{word(i, 'e')} blip zap {number(4)}x{number(7)} {word(i, 'f')}" for i in range(3)]  # another shape behind the found context
    text += [f"{word(i, 'g')} +1 (234) 555-{number(4)}, {word(i, 'h')}" for i in range(5)] + ["so +1 (234) 555-9876 8.8.4.4 it", "just 12x1234567 here", "version 4.0. of 2021", "1 2 3 4"]
    rows = list(enumerate(text))
    got = {r["doc_id"]: r["spans"] for r in with_spans(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    want = brute.bootstrap(text)
    assert got == {i: want[i] for i, _ in rows}
    assert all(got[i] for i in range(17)) and got[22].count("phone") == 1 and not got[24]


def test_quality_rules(spark, docs, texts, empty):
    got = {r["doc_id"]: r for r in line_verdicts(docs).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {i: tuple(r[c] for c in names) for i, r in got.items()} == {i: brute.rules(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    assert line_verdicts(empty).count() == 0


def test_boilerplate(spark):
    letters = str.maketrans("0123456789-", "abcdefghijk")
    words = lambda k, n: " ".join(f"w{k}x{j}".translate(letters) for j in range(n))
    banner = words("b", 15)
    rows = [(k, f"{words(k, 30)}\n{banner}\n{words(-k, 30)}", "h") for k in range(1, 60)] + [(99, f"{words(7000, 3)}\n{banner}\n{words(7001, 3)}", "h")]
    copies = [(200 + k, words("c", 12) + "\n" + words("d", 12), "h") for k in range(50)]
    got = {r["doc_id"]: r for r in line_verdicts(spark.createDataFrame(rows + copies, "doc_id long, text string, source string")).collect()}
    assert got[5]["kept"] and got[5]["n_left"] == 60
    assert not got[99]["kept"] and not got[99]["base_failed"]
    assert got[210]["kept"]


def test_boilerplate_documents(spark):
    """A block of five lines is boilerplate as a whole; a line that one document repeats, or that near copies share, is not."""
    letters = str.maketrans("0123456789-", "abcdefghijk")
    words = lambda k, n: " ".join(f"w{k}x{j}".translate(letters) for j in range(n))
    header = "\n".join(words(f"h{j}", 12) for j in range(5))
    rows = [(k, f"{header}\n{words(k, 60)}", "a") for k in range(1, 31)] + [(40, f"{header}\n{words(7000, 10)}", "a")]
    again = "\n".join(f"{words('r', 5)}\n{words(300 + k, 12)}" for k in range(25))
    rows += [(50, again, "b"), (51, "\n".join([words("r", 5)] * 1 + [words(8000, 30)]), "b")]
    near = [words(500 + j, 12) for j in range(12)]
    rows += [(100 + k, "\n".join([*near[:-1], near[-1] + " " + words(600 + k, 1)]), "c") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_verdicts(docs).collect()}
    assert got[1]["kept"] and got[1]["n_left"] == 60
    assert not got[40]["kept"] and not got[40]["base_failed"] and got[40]["n_left"] == 10
    assert got[50]["n_left"] == got[50]["n_words"] and got[51]["n_left"] == 35
    assert all(got[100 + k]["kept"] and got[100 + k]["n_left"] == got[100 + k]["n_words"] for k in range(40))
    clean = {r["doc_id"]: r["text"] for r in cleaned(docs).collect()}
    assert clean[1] == words(1, 60) and 40 not in clean and clean[100] == rows[33][1]


def test_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < 0.8, truth ^ (rng.random(4000) < e), 2) for e in (0.05, 0.1, 0.2, 0.1)], 1).astype(np.int64)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = fit_labellers(patterns, counts.astype(float))
    assert ((post[which.reshape(-1)] > 0.5) == truth).mean() > 0.95 and abs(prior - 0.2) < 0.05


def test_weak_labels(spark, empty):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            w[3 : 40 : 9] = ["grumpfel", "zornix", "idiot", "grumpfel", "moron"]
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, "")]
    out = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in out.collect()}
    assert len(got) == 402 and np.mean([got[i] == (i % 5 == 0) for i in range(400) if i % 2]) > 0.97
    assert score_documents(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_secret_scan(spark, empty):
    rng = np.random.default_rng(6)
    hexes = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'the file has token = "{hexes()}" in the text here', "a") for i in range(60)]
    rows += [(100 + i, f"the {rng.integers(10**15, 10**16)} the text here in the file has the", "b") for i in range(60)]
    rows += [(300, f"the value {hexes()} alone", "a"), (301, None, None), (302, "", "a")]
    got = {r["doc_id"]: r["p_secret"] for r in findings(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] > 0.5 for i in range(60)) and all(got[100 + i] < 0.5 for i in range(60)) and got[300] > 0.5
    assert findings(empty).count() == 0


def test_secret_candidates(spark):
    key, mixed = "9f8e7d6c5b4a39281706f5e4", "qWhTrbNxKpLzVsDmGcYf"
    rows = [f'{{"a":"{key}1","b":"{key}2"}}', f"api_key={key}", f"x={mixed};y={key}==", "internationalization getElementIdentifier", f"see {key[:16]}{'x' * 20000} end"]
    got = {}
    for r in candidates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "'s' as source")).collect():
        got.setdefault(r["doc_id"], []).append((r["nth"], r["run"], r["prefix"]))
    assert [x[1] for x in sorted(got[0])] == [key + "1", key + "2"]
    assert got[1] == [(1, key, "api_key=")]
    assert [x[1] for x in sorted(got[2])] == [mixed, key + "=="]
    assert 3 not in got and len(got[4]) == 1


def plain_candidates(text):
    """(pos, nth, run, prefix, before2, before, after), word by word."""
    random = lambda x: re.search("[0-9]", x) or (re.search("[a-z]", x) and re.search("[A-Z]", x) and re.search(r"(?i:[b-df-hj-np-tv-xz]{5})|[a-z][A-Z](?![a-z]{2})|[A-Z][a-z](?![a-z])", x))
    named = lambda x: re.search("(?i)token|secret|passw(or)?d|pwd|api_?key|auth|credential|private_?key|access_?key", x)
    words, out = re.findall(brute.BLANK, text or ""), []
    for pos, w in enumerate(words):
        end, last, first = 0, "", True
        for nth, m in enumerate(re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{6,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?", w)):
            run, prefix = m[0], last + w[end : m.start()]
            end, last = m.end(), run
            if not random(run):
                continue
            ahead = [words[pos - k] if first and pos >= k else None for k in (2, 1)]
            first = False
            told = " ".join(x for x in (*ahead, prefix) if x is not None)
            if len(run) >= 16 or (named(told) and re.search("[=:]\\s*[\"']?$", " ".join(x for x in (ahead[1], prefix) if x is not None))):
                out.append((pos, nth, run, prefix, *ahead, words[pos + 1] if pos + 1 < len(words) else None))
    return out


def test_secret_candidates_plain(spark, texts):
    """Every candidate against a loop over words; short values count behind a credential word with an assignment only."""
    odd = ["password=hunter2secret", "token: abc123def456 next", "my pwd = 'a1b2c3'; note: x1y2z3", "order: abc123def456", "api_key=short1,token=0123456789abcdef0123 secret : q9w8e7", "AUTH:Abc-9/xyz== passwd:none", '{"password":"p4ssw0rd","id":"77aa88bb99cc00dd1"}', "token=" + "z9" * 5000, "secret=\nabc123xyz", "Token= x1", "secretary: a1b2c3d4"]
    rows = [*texts.items(), *((900 + k, t) for k, t in enumerate(odd))]
    got = sorted((r["doc_id"], r["pos"], r["nth"], r["run"], r["prefix"], r["before2"], r["before"], r["after"]) for r in candidates(spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, source string")).collect())
    want = sorted((i, *c) for i, t in rows for c in plain_candidates(t))
    assert got == want and {i for i, *_ in want} >= {900, 901, 902, 904, 905, 906, 907, 908} and not any(i == 903 for i, *_ in want)


def test_null_source(spark):
    """Null and empty source are two hosts: a line of twelve documents each is common in neither, a value in two paths is in two."""
    line = "this very line stands in many documents of both hosts and is no news"
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(k, f"{line}\n{words} {k} " + " ".join(f"own{k}x{j}" for j in range(20)), None if k % 2 else "") for k in range(24)]
    got = line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["n_left"] == r["n_words"] for r in got)
    value = "key 1234567890abcdef77"
    for other, decided in (("c", 0.0), (None, None)):
        rows = [(1, value, None), (2, value, ""), (3, value, "b"), (4, value, other)]
        assert {r["label"] for r in findings(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {decided}


def luhn_number(rng, good):
    while True:
        n = str(rng.integers(10**15, 10**16))
        if bool(brute.personal(n)["card"]) == good:
            return n


def test_secret_labels(spark):
    """A credential in the word labels true, a check digit or a link labels false; the forest decides the rest and the held-out fifth."""
    rng = np.random.default_rng(8)
    hexes = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f"the api_key={hexes()} the text", "a/b") for i in range(400)] + [(500 + i, f"the {luhn_number(rng, True)} the text the", "b/test") for i in range(400)]
    rows += [(1000 + i, f"the {hexes()} the text the", "a/b") for i in range(20)] + [(1100 + i, f"the {luhn_number(rng, False)} the text the", "b/test") for i in range(20)]
    rows += [(1200, f"see https://x.org/{hexes()} now", "a/b")]
    got = {r["doc_id"]: r for r in findings(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["label"] == 1 for i in range(400)) and all(got[500 + i]["label"] == 0 for i in range(400)) and got[1200]["label"] == 0
    assert all(got[i]["label"] is None and got[i]["p_secret"] > 0.5 for i in range(1000, 1020)) and all(got[i]["label"] is None and got[i]["p_secret"] < 0.5 for i in range(1100, 1120))
    held = [r for r in got.values() if r["held_out"] and r["label"] is not None]
    assert len(held) > 100 and np.mean([(r["p_secret"] >= 0.5) == r["label"] for r in held]) > 0.97


def test_secret_transitions(spark):
    """The features of one candidate, against plain counts."""
    run = "aB3aB3aB3aB3--9xYz"
    row = findings(spark.createDataFrame([(1, f"w {run} w", "s")], "doc_id long, text string, source string")).first()
    marks = "".join("1" if c.isdigit() else "a" if c.islower() else "B" if c.isupper() else "-" for c in run)
    for i, a in enumerate("1aB-"):
        for j, b in enumerate("1aB-"):
            assert abs(row[f"from_{i}_to_{j}"] - sum(x + y == a + b for x, y in zip(marks, marks[1:], strict=False)) / len(run)) < 1e-9
    assert row["length"] == len(run) and abs(row["digits"] - 5 / len(run)) < 1e-9 and {*FEATURES} <= {*row.asDict()}


def test_weak_labels_held_out(spark):
    """Labels of half of the documents judge the other half, both ways: low quality is found without a label, toxic ones mostly."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    hidden = labels.where("doc_id % 2 = 0")
    got = score_documents(docs, labels.where("doc_id % 2 = 1")).withColumnRenamed("toxic", "found").join(hidden, "doc_id").collect()
    for found, truth, recall, precision in (("found", lambda r: r["toxic"] == 1, 0.85, 0.9), ("low_quality", lambda r: r["quality"] == 0, 0.95, 0.95)):
        right = sum(r[found] and truth(r) for r in got)
        assert right >= recall * sum(map(truth, got)) and right >= precision * sum(r[found] for r in got), found


def test_expectation_maximisation():
    """Rates and posteriors against a loop over documents, and against the rates that made the votes."""
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    hit, false = np.array([0.9, 0.6, 0.7, 0.5]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = (rng.random((20_000, 4)) < np.where(truth[:, None], hit, false)).astype(np.int64)
    votes[rng.random((20_000, 4)) < 0.1] = 2
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = fit_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.02 and np.abs(rates[0] - hit).max() < 0.05 and np.abs(rates[1] - false).max() < 0.03
    odds = []
    for v in votes[:300]:
        x = np.log(prior / (1 - prior))
        for j, y in enumerate(v):
            x += (np.log(rates[0, j] / rates[1, j]), np.log((1 - rates[0, j]) / (1 - rates[1, j])), 0)[(1, 0, 2).index(y)]
        odds.append(1 / (1 + np.exp(-x)))
    assert np.abs(post[which.reshape(-1)[:300]] - odds).max() < 1e-2
    assert np.mean((post[which.reshape(-1)] >= 0.5) == truth) > 0.95
