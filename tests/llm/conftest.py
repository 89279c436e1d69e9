import random

import pytest

CLASHING = "print int, key long, ids string, spans string, n_words int, component_id long, label string, score double, pair int"


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]


def edited(words, seed, every):
    rng = random.Random(seed)
    return [f"x{rng.randrange(10**6)}" if rng.random() < 1 / every else w for w in words]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with copies, near copies, shared passages, white space of all kinds, nothing, and great length."""
    base, passage = prose(1, 400), prose(2, 60)
    texts = {
        1: None, 2: "", 3: " \t\n\r\x0b\x0c ", 4: "One two", 5: "one  TWO", 6: "a b c d e", 7: "A b c d E", 8: "a b c d f",
        9: "é\u00a0ü \x00 \u3000 ÉCOLE don't  x's   7 <|endoftext|> <|endoftext|>end", 10: "x" * 3000,
        11: " ".join(base), 12: "  ".join(base), 13: "\n".join(w.upper() for w in base), 14: " ".join(prose(3, 30000)),
        15: " ".join(prose(3, 30000)[:29000]), 16: " ".join(["same"] * 500), 17: " ".join(["same"] * 400 + ["other"] * 60),
        18: " ".join(base[:49]), 19: " ".join(base[:50]), 20: " ".join(base[:51]), 60: "ab" * 700 + " " * 70 + "tail",
    }
    for k in range(18):
        texts[21 + k] = " ".join(edited(base, k, 60))
    for k in range(12):
        texts[40 + k] = " ".join([*prose(50 + k, 30 + 7 * k), *passage[k % 3 : 60 - k % 2], *prose(90 + k, 25)])
    return sorted(texts.items())


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    """The texts with columns that clash with internal names, one row repeated and one without an id."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, 2, "3", "4", 5, 6, "7", 8.0, 9) for i, t in odd_texts]
    rows += [rows[10], (None, rows[10][1], *rows[10][2:])]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark, documents):
    return spark.createDataFrame([], documents.schema)
