"""SimHash components against brute force, and the BK-trees by themselves."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rimfold.llm import simhash

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    text = "".join(" " if c in SPACE else c for c in (text or "").translate(LOWER))
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(fps):
    """fingerprint -> the set of those it reaches."""
    own = {x: x for x in fps}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    fps = sorted(own)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                own[root(x)] = root(y)
    return {x: root(x) for x in fps}


def wanted(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(repr((i, f"{f:016x}", least.get(root[f]))) for (i, _), f in zip(rows, fps))


def found(df):
    shown = df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    return sorted(repr(tuple(r)) for r in shown.collect())


@pytest.mark.parametrize(("shard", "levels"), [(8192, 3), (4, 0), (4, 2)])
def test_components(spark, docs, shard, levels):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"w{rng.randrange(40)}" for _ in range(1500)]
    for k in range(60):  # near copies whose fingerprints differ by a few bits: one large bucket
        own = list(base)
        for _ in range(rng.randrange(1, 12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        rows.append((5000 + k, " ".join(own)))
    rows += [(7000, "a b"), (7001, "a b c"), (7002, "A  b\tC"), (7003, " \x0b "), (None, "a b c"), (7004, "é b")]
    table = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, n int, mask string").repartition(3)
    got = found(simhash.near_components(table, shard=shard, levels=levels))
    assert got == wanted(rows)
    assert len({r.split(", ")[2] for r in got}) < len({r.split(", ")[1] for r in got})  # different fingerprints are linked


def test_no_rows_and_no_ids(spark, none):
    assert simhash.near_components(none).count() == 0
    rows = spark.createDataFrame([(None, "same text of words"), (None, "same text of words"), (3, None)], "doc_id long, text string")
    assert found(simhash.near_components(rows)) == wanted([(None, "same text of words")] * 2 + [(3, None)])


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(30_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7001)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_trees_find_all_within_the_radius_and_skip_the_rest(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 40, np.uint64)
    fps = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for _ in range(20)]))
    bucket = (fps % np.uint64(3)).astype(np.int64)
    looked = []
    count = np.bitwise_count
    forest = simhash.Forest(fps, bucket)
    for child in np.flatnonzero(forest.parent >= 0):
        assert int(fps[child] ^ fps[forest.parent[child]]).bit_count() == forest.edge[child]
    monkeypatch.setattr(simhash, "STEP", 100)
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.append(len(x)) or count(x))
    pairs = {(int(a), int(b)) for q, n in forest.search(fps, bucket, 3) for a, b in zip(q, n)}
    every = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert pairs == every and sum(looked) < 0.8 * sum((bucket == b).sum() ** 2 for b in range(3))
