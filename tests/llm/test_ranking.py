"""Ranked search against brute force, and how far a search reads."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rimfold.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_ranks(docs, items, k):
    own = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, length = len(own), sum(len(t) for _, t in own)
    df = Counter(w for _, t in own for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    counts, out = [(i, len(t), Counter(t)) for i, t in own], []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, n, tf in counts:
            m = 50 + 50 * n * n_docs // length
            score = sum(weight[w] * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * m)) for w in asked if w in tf)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("shard", "group", "k"), [(1_000_000, 1024, 50), (2000, 3, 5)])
def test_ranks(spark, docs, shard, group, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    some = [t for _, t in rows if t and len(t) > 40]
    items = [(i, some[i % len(some)][:200].upper() if i % 2 else some[i % len(some)][10:90]) for i in range(20)]
    items += [(20, None), (21, ""), (22, "nowhereseenterm"), (3, some[1][:50]), (None, "cc by all rights"), (24, "x X x"), (25, some[0] * 3)]
    asked = spark.createDataFrame([(*x, 1, "t") for x in items], "item_id long, text string, n int, term string")
    got = ranking.rank(docs, asked, k, shard=shard, group=group)
    assert sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in got.collect()) == plain_ranks(rows, items, k)


def test_no_documents_no_items(spark, docs, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.rank(none, items).count() == 0
    assert ranking.rank(docs, items.limit(0)).count() == 0


def test_walk_stops_early_and_completes_scores():
    rng = np.random.default_rng(5)
    term, impact, offsets = [], [], [0]
    for d in range(3000):
        own = np.flatnonzero(rng.random(6) < 0.5)
        term += own.tolist()
        impact += (rng.integers(1, 50, len(own)) * (40 if d % 500 == 0 else 1)).tolist()
        offsets.append(len(term))
    index = ranking.Shard(np.array(offsets), np.array(term), np.array(impact), 6)
    ids = rng.permutation(3000)
    for own in (np.arange(6), np.array([2, 5])):
        whole = index.complete(np.arange(3000), own)
        want = np.lexsort((ids, -whole))[:5]
        best, scores, read = index.search(own, ids, 5)
        assert best.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
        assert read < 0.6 * sum(index.begin[t + 1] - index.begin[t] for t in own)


def test_longer_integers():
    assert ranking.damped(np.array([10, 1 << 40]), 1 << 30, 1 << 60).tolist() == [50, 50 + 50 * (1 << 40) * (1 << 30) // (1 << 60)]
