"""Near duplicates by the query's own measure: recall of weighted similarity, and the classes of a plain version."""

import collections
import math
import random

import numpy as np
import pytest

from rimfold.llm import neardup


def weights_of(texts):
    """Shingle weights of each text, plainly."""
    words = [t.lower().split() for t in texts]
    df = collections.Counter(w for own in words for w in set(own))
    least = sum(df.values()) / neardup.IDF_WORDS
    idf = {w: math.log1p(len(texts) / (c if c > least else max(least, 1.0))) for w, c in df.items()}
    out = []
    for own in words:
        bag = collections.Counter(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else {}
        out.append({s: c * (sum(idf[w] for w in s) / len(s)) ** neardup.DAMPING for s, c in bag.items()})
    return out


def similarity(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def pairs_near_the_threshold(seed, n):
    rng = random.Random(seed)
    zipf = [f"w{int(1 / rng.random())}" for _ in range(20_000)]
    out = []
    for _ in range(n):
        base = [rng.choice(zipf) for _ in range(rng.randint(60, 300))]
        near = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 40))):
            near[rng.randrange(len(near))] = f"new{rng.random()}"
        out += [" ".join(base), " ".join(near)]
    return out


def test_classes_are_those_of_weighted_similarity(spark):
    """Recall over planted pairs of weighted similarity 0.8 and more, most of them below 0.9; and nothing below is linked."""
    texts = pairs_near_the_threshold(4, 500)
    weight = weights_of(texts)
    real = [similarity(weight[i], weight[i + 1]) for i in range(0, len(texts), 2)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(real))]
    above = [x for x, s in zip(linked, real) if s >= 0.8]
    print(f"recall {sum(above) / len(above):.4f} of {len(above)} pairs, {sum(0.8 <= s < 0.9 for s in real)} of them below 0.9")
    assert len(above) > 150 and sum(0.8 <= s < 0.9 for s in real) > 80 and sum(above) / len(above) >= 0.98
    assert not any(x for x, s in zip(linked, real) if s < 0.8 - 1e-9) and all(got[i] in (i, i - i % 2) for i in got)


@pytest.mark.parametrize("small", [64, 2])
def test_classes_of_a_plain_version(spark, monkeypatch, small):
    """Connected components of weighted similarity in groups of many copies, some of them far from one another."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "CROSS", 4)
    rng = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(120)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            texts.append(" ".join(own))
    weight, parent = weights_of(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if similarity(weight[a], weight[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in got} and len(set(got.values())) > 6


def test_unlike_shingles_do_not_agree():
    """Texts without a common shingle agree in no sample, though all shingles weigh the same."""
    weights = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0), 100, 1.0, 0.25)
    texts = [" ".join(f"a{i}b{k}" for k in range(2000)) for i in range(4)]
    doc, key, weight, _ = neardup.shingles(texts, weights)
    s = neardup.Sampler(16, 4, 1).signatures(4, doc, key, weight)
    assert all((s[i] != s[j]).all() for i in range(4) for j in range(i)) and (s != 0).all()


def test_rows_are_told_apart_by_text(spark):
    """One id with two texts, ids past 2^53 beside nulls, rows without id, and the same row many times."""
    a, b, c = ([f"{k}{i}" for i in range(120)] for k in "abc")
    near = lambda words, at: " ".join(words[:at] + ["other"] + words[at + 1 :])
    big = (1 << 60) + 1
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 50)), (3, near(b, 70)), (None, near(a, 9)), (big, near(b, 4)), (big + 1, " ".join(c))]
    rows += [(None, "x y z"), (None, None), (7, None), (8, " "), *[(5, near(c, 60))] * 300]
    got = neardup.keyed_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["class_key"]].append((r["doc_id"], r["class_id"]))
    alone = by.pop(None)
    assert sorted(alone, key=str) == [(7, 7), (8, 8), (None, None)]
    found = sorted((sorted(set(x), key=str) for x in by.values()), key=str)
    want = [[(1, 1), (2, 1), (None, 1)], [(1, 1), (big, 1), (3, 1)], [(big + 1, 5), (5, 5)], [(None, None)]]
    assert found == sorted((sorted(x, key=str) for x in want), key=str) and len(got) == len(rows)
