import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, n_words int, word string, node int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, shared passages, nulls, empty texts, ties, repeated rows and clashing names."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéüñ漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    passage, texts = make(120), []
    for i in range(40):
        texts.append(make(rng.randint(1, 300)))
    texts += [texts[3], texts[3], texts[5] + " tail", None, "", " \n\t ", "a" * 900, "ab " * 400, "x"]
    for i in (1, 2, 8):
        texts.append(make(60) + "\n" + passage + "\n" + make(50))
        near = texts[i + 20].split(" ")
        texts.append(" ".join(w if k % 60 else "CHANGED" for k, w in enumerate(near)))
    texts += ["All Rights Reserved. " + make(5), "Licensed under CC BY-NC 4.0.\n" + make(30), "cc by cc by K GNU General Public License, version 3", make(5000)]
    texts += ["line one is here\nline two is here\nline three is here\nline four is here\n" + make(10), make(10) + "\nline one is here\nline two is here\nline three is here\nline four is here\nend"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "é", None]), None if t is None else len(t), 1, "k", 2, "w", 3) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[12], "en", "b", 1, 1, "k", 2, "w", 3), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
