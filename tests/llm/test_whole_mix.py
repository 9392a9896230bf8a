"""The mix against a plain version: targets, the blocks that slots get, what is taken of each row, and the texts."""

import collections

import pytest
from pyspark.sql import functions as F

from rimfold.llm import mixing

MASK = (1 << 64) - 1


def mix64(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def permuted(i, n, key):
    """Plain form of the permutation of range(n)."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = i >> half, i & mask
        for turn in range(4):
            a, b = b, a ^ mix64((b + key + turn * 0x632BE5AB + 1) & MASK) & mask
        i = a << half | b
        if i < n:
            return i


def plain(rows, block, seed=1, most=3):
    """rows: (k1, k2, source, size). Targets by source, and words taken by row hashes (summed over equal rows)."""
    words = collections.Counter()
    for _, _, s, n in rows:
        words[s] += n
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    target, open_, total = {}, set(names), sum(words.values())
    while open_:
        share = (total - sum(target.values())) / sum(1 + names.index(s) % 3 for s in open_)
        above = {s for s in open_ if (1 + names.index(s) % 3) * share > most * words[s]}
        target |= {s: most * words[s] for s in above} if above else {s: (1 + names.index(s) % 3) * share for s in open_}
        open_ -= above or open_
    taken = collections.Counter()
    for no, s in enumerate(names):
        n = -(-words[s] // block)
        slots = min(int(target[s] * n / words[s] + 0.5), most * n) if n else 0
        times = collections.Counter(permuted(j % n, n, mix64((mix64((seed * 1_000_003 + no) & MASK) + j // n) & MASK)) for j in range(slots))
        at = 0
        buckets = mixing.groups_for(len(rows), mixing.BUCKET)
        for k1, k2, _, size in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] % buckets, r[0], r[1])):
            for w in range(at, at + size):
                taken[k1, k2] += times[w // block]
            at += size
    return target, taken


@pytest.mark.parametrize("bucket", [2000, 7])
def test_mix(docs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "SLOTS", 64)
    monkeypatch.setattr(mixing, "SLICE", 500)
    shards, rows, sources = mixing.mix(docs, keep=["doc_id", "source", "text", *mixing.ROW], block=4)
    own = [(r["_k1"], r["_k2"], r["source"], r["size"]) for r in rows.collect()]
    sizes = collections.Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    target, taken = plain(own, 4)
    held = mixing.taken_words(shards, rows, sources).collect()
    assert len(held) == docs.count() and sum(r["taken"] for r in held) == sum(taken.values()) > 0
    by = collections.Counter()
    for r in held:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    for s in sizes:
        assert by[s] == pytest.approx(target[s], rel=0.05, abs=10)
    # the shards: every slot once, no more than a block's words, and each piece a part of its text
    got, whole = shards.collect(), collections.defaultdict(list)
    real = collections.Counter()
    for r in got:
        assert r["piece"] in r["text"] and r["words"] == len(r["piece"].encode().split()) > 0
        whole[r["shard"], r["slot"]].append((r["at"], r["words"]))
        real[r["_k1"], r["_k2"]] += r["words"]
    assert real == +taken
    for parts in whole.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(w for _, w in parts[:k]) for k in range(len(parts))] and sum(w for _, w in parts) <= 4
    assert sorted(whole) == [(k // 64, k % 64) for k in range(len(whole))]
    again = mixing.mix(docs.repartition(5), keep=["doc_id"], block=4)[0].drop("_k1", "_k2")
    assert collections.Counter(map(repr, again.collect())) == collections.Counter(map(repr, shards.drop("source", "text", *mixing.ROW).collect()))


def test_pieces_of_a_pass_are_the_text(spark):
    texts = ["  \n a\tbé  c\r\n漢字 d ", "one", "x " * 500, "\u2003y z"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(9, "big " * 5000, "t")], "doc_id long, text string, source string")
    shards = mixing.mix(docs, block=3, keep=["doc_id", "text"])[0].where("doc_id < 9 and pass = 0")
    own = collections.defaultdict(list)
    for r in shards.collect():
        own[r["doc_id"]].append((r["block"], r["piece"]))
    assert {i: "".join(p for _, p in sorted(x)) for i, x in own.items()} == dict(enumerate(texts))


def test_many_sources(spark):
    """Sources are rows: more of them than any list on the driver should hold make no difference."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("a b c d").alias("text"))
    shards, rows, sources = mixing.mix(docs)
    assert sources.count() == 30_000 and sources.agg(F.max("source_no")).first()[0] == 29_999
    assert mixing.taken_words(shards, rows, sources).where("taken > 12").count() == 0
