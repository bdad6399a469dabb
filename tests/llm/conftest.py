import random

import pytest

WORDS = [a + b for a in ("ab", "cer", "dol", "ém", "fin", "gra") for b in ("a", "en", "is", "ost", "ül", "ion", "eau")]


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """doc_id to text: null, empty, blank, short, long, copies, near copies, shared passages, repeats, odd white space."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = prose(rng, 160)
    docs = [None, "", " \n\t ", "one", "two words", prose(rng, 3), prose(rng, 12), base, base, base, passage, "x" * 300, "x" * 300 + "y", "ab " * 400, "日本語 テキスト " * 30, "a b c \x1c d"]
    for k in range(10):
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{k}"
        docs.append(" ".join(w))
    for _ in range(10):
        docs.append(prose(rng, rng.randrange(5, 90)) + " " + passage + " " + prose(rng, rng.randrange(5, 60)))
    docs += [prose(rng, rng.randrange(20, 200)) for _ in range(10)] + [prose(rng, 9000)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return {i * 3 + 1: docs[j] for i, j in enumerate(order)}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, mini string, n long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, None, None if i % 7 == 0 else f"src{i % 3}", len(t or ""), "x", None, 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
