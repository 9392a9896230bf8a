"""Whole jobs: what earlier cuts of the text operators lost."""

import math
import random
import re

import pytest

from pyspark.sql import functions as F

from rimfold.llm import licenses, lm


@pytest.mark.parametrize("least", [licenses.LEAST, 0.6])
def test_licenses_at_every_offset(spark, least):
    """A notice is found wherever it stands: against brute force over every block start."""
    notice = "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    far = "gnu general public license " + "x " * 24 + "either version license later"
    texts = [" ".join(["w"] * k + [t] + ["v"] * 40) for k in range(32) for t in (notice, far, "gnu " + far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for text in texts:
        w, found = [x.strip("(),").lower() for x in text.split()], {}
        for _, label, own, span in licenses.templates():
            for b in range(len(w)):
                c = len(set(w[b : b + span]) & set(own))
                if c >= math.ceil(least * len(own) - 1e-9):
                    found[label] = max(found.get(label, 0), c / len(own))
        want.append(found)
    got = licenses.scan(docs, least=least).orderBy("doc_id").collect()
    assert [set(r["labels"].split(",")) for r in got] == [{"gpl"} | set(f) for f in want]
    assert all("gpl-or-later" in f for f in want[::3])
    words = docs.transform(licenses.found_words)
    shares = licenses.template_labels(words, licenses.word_order(words.selectExpr("explode(hits.word) as word")), least=least)
    assert {r["_row"]["doc_id"]: r["containment"] for r in shares.collect()} == {i: max(f.values()) for i, f in enumerate(want) if f}
    assert least == licenses.LEAST or any(v < 1 for f in want for v in f.values())


def held(w, own, span):
    """The share of a template that its best block holds, and the share held without regard to blocks."""
    best = max((len(set(w[b : b + span]) & own) for b in range(len(w))), default=0)
    return best / len(own), len(set(w) & own) / len(own)


def test_paragraphs_by_containment(spark):
    """Whole license paragraphs with words changed, dropped or moved far apart: the threshold decides, block by block."""
    rng = random.Random(3)
    paragraphs = [re.findall(r"[0-9a-z]+", t.lower()) for texts in licenses.PARAGRAPHS.values() for t in texts]
    texts = []
    for words in paragraphs:
        for lost in (0, 0.03, 0.06, 0.1, 0.15, 0.3):
            own = [w if rng.random() >= lost else rng.choice(["", "other", f"x{rng.random()}".replace(".", "")]) for w in words]
            texts.append(" ".join(["w"] * rng.randint(0, 90) + [w for w in own if w] + ["v"] * rng.randint(0, 90)))
        half = len(words) // 2
        texts += [" ".join(words[:half] + ["gap"] * gap + words[half:]).upper() for gap in (5, 12, 25, 60)]
    texts.append(" ".join(" ".join(p) for p in paragraphs))
    want, edge = [], 0
    for text in texts:
        w, found = text.lower().split(), {}
        for _, label, own, span in licenses.templates():
            share, loose = held(w, set(own), span)
            if share >= licenses.LEAST - 1e-9:
                found[label] = max(share, found.get(label, 0))
            edge += licenses.LEAST <= share < 1 or share < licenses.LEAST <= loose
        want.append(found)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = docs.transform(licenses.found_words)
    shares = licenses.template_labels(words, licenses.word_order(words.selectExpr("explode(hits.word) as word")))
    got = {r["_row"]["doc_id"]: (set(r["method_labels"]), r["containment"]) for r in shares.collect()}
    assert got == {i: (set(f), max(f.values())) for i, f in enumerate(want) if f}
    assert edge > 30 and len({label for f in want for label in f}) >= len(licenses.PARAGRAPHS)


def test_what_was_seen_once_counts(spark):
    """A held-out text that repeats a passage seen once scores by its n-grams, not as if never seen."""
    docs = spark.createDataFrame([(0, "the red fox ran home"), (1, "red the home fox ran"), (2, "the red fox"), (3, "fox the red")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") >= 2).collect()}
    # 12 tokens in training, 6 different (the end twice)
    p = lambda c: (c + 0.5) / (12 + 0.5 * 7)
    d = lm.DISCOUNT
    the = (1 - d) / 2 + d * 2 / 2 * p(2)  # P(the | start): seen once of two, two followers
    red = (1 - d) / 1 + d * 1 / 1 * ((1 - d) / 2 + d * 2 / 2 * p(2))  # P(red | start the)
    fox = (1 - d) / 1 + d * 1 / 1 * ((1 - d) / 2 + d * 2 / 2 * p(2))  # P(fox | the red)
    end = d * 1 / 1 * (d * 1 / 2 * p(2))  # after (red fox) only ran was seen, and after fox ran, twice
    assert got[2] == pytest.approx(math.log10(the * red * fox * end))
    assert got[2] > got[3]
