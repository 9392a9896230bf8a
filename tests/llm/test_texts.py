"""Operators on documents against brute force, on a table with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rimfold.llm import licenses, lines, lm, mixing, neardup, pieces, quality, substrings

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(map(repr, rows))


@pytest.mark.parametrize("large", [2048, 1])
def test_substrings(docs, monkeypatch, large):
    monkeypatch.setattr(substrings, "LARGE", large)
    own = [(i, (t or "").encode()) for i, t in pairs(docs)]
    seen = collections.Counter(b[p : p + 400] for _, b in own for p in range(len(b) - 399))
    want = []
    for i, b in own:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs).drop("kept").collect()]
    assert bag(got) == bag(want) and sum(w[2] for w in want) > 1000


def test_line_runs(docs):
    by, blank = {}, " \t\r\x0b\x0c"
    for i, t in pairs(docs):
        by[(i is not None, i or 0, t)] = [x for x in (t or "").split("\n") if x.strip(blank)]
    # rows of equal id and text are one; order by id (nulls first), then by the text's hash
    hashes = {t: h for t, h in docs.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(by, key=lambda k: (k[0], k[1], hashes[k[2]]))
    gone = {k: set() for k in order}
    for size in range(1, 300):
        first = {}
        for k in order:
            for p in range(len(by[k]) - size + 1):
                run = tuple(by[k][p : p + size])
                if run in first and (size >= 4 or sum(map(len, run)) >= 200):
                    gone[k] |= set(range(p, p + size))
                first.setdefault(run, (k, p))
    want = []
    for i, t in pairs(docs):
        k, at, kept = (i is not None, i or 0, t), -1, []
        for x in (t or "").split("\n"):
            at += bool(x.strip(blank))
            if not x.strip(blank) or at not in gone[k]:
                kept.append(x)
        want.append((i, len(by[k]), len(gone[k]), None if t is None else "\n".join(kept)))
    got = [tuple(r) for r in lines.drop_repeated_lines(docs).select("doc_id", "_n_lines", "_n_removed", "_kept_text").collect()]
    assert bag(got) == bag(want) and any(w[2] for w in want)


def test_licenses(docs):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in pairs(docs):
        w = words.findall((t or "").translate(LOWER))
        starts, base, share = [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        labels = set(base)
        for _, label, own, span in licenses.templates():
            for b in range(len(w)):
                block = set(w[b : b + span])
                c = len(block & set(own))
                if c >= math.ceil(licenses.LEAST * len(own) - 1e-9):
                    labels.add(label)
                    share = max(share, c / len(own))
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else share))
    got = [tuple(r) for r in licenses.scan(docs).collect()]
    assert bag(got) == bag(want) and any(w[5] for w in want) and any("cc-by-nc" in w[6] for w in want)


@pytest.mark.parametrize("group", [8_000_000, 2_000])
def test_lm_scores(docs, monkeypatch, group):
    monkeypatch.setattr(lm, "GROUP", group)
    monkeypatch.setattr(lm, "PART", 500)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    texts = [(i, [b"<s>", *(t or "").translate(LOWER).encode().split(), b"</s>"]) for i, t in pairs(docs)]
    grams = {k: collections.Counter() for k in (1, 2, 3)}
    for i, w in texts:
        if not held(i):
            for k in grams:
                grams[k].update(tuple(w[j - k + 1 : j + 1]) for j in range(1, len(w)) if j - k + 1 >= 0)
    n, v = sum(grams[1].values()), len(grams[1])
    count, after = collections.Counter(), collections.Counter()
    for k in (2, 3):
        for gram, c in grams[k].items():
            count[gram[:-1]] += c
            after[gram[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 0.5) / (n + 0.5 * (v + 1))
        lower, context = p(gram[1:]), gram[:-1]
        return max(grams[len(gram)][gram] - lm.DISCOUNT, 0) / count[context] + lm.DISCOUNT * after[context] / count[context] * lower if count[context] else lower

    want = []
    for i, w in texts:
        score = sum(math.log10(p(tuple(w[max(0, j - 2) : j + 1]))) for j in range(1, len(w)))
        want.append((i, held(i), len(w) - 1, sum((x,) in grams[1] for x in w[1:]), n, round(sum(math.log10(p((x,))) for x in w[1:]), 6), round(score, 6)))
    rows = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    got = [(*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in rows.collect()]
    assert bag(got) == bag(want)


def test_lm_probabilities_sum_to_one():
    import numpy as np

    # four words; the context (0, 1) was seen 6 times: 4 before 2, 2 before 3; the context 1 was seen 20 times, before all but 0
    total = np.array([10, 20, 30, 5])
    bigrams, times2, after2 = np.array([1, 4, 5, 6, 7]), np.array([6, 0, 3, 12, 5]), np.array([1, 3, 0, 0])
    trigrams, times3, after3 = np.arange(0, 4), np.array([0, 0, 4, 2]), np.array([2, 0, 0, 0, 0])
    auto = lm.Automaton(4, 65, 4, total, bigrams, times2, after2, trigrams, times3, after3, np.array([1, 2, 3, 4]))
    ids, before, bigram = np.array([1, 0, 1, 1, 1, 2, 1, 3]), np.array([0, 1, 0, 1, 0, 1, 0, 1]), np.array([0, 1, 0, 2, 0, 3, 0, 4])
    way = auto.walk(ids, before, bigram, np.array([1, 3, 5, 7]), np.arange(4))
    unknown = 10 ** (auto.fail3[0] + auto.fail2[1]) * 0.5 / (65 + 0.5 * 5)
    assert sum(10 ** way[[1, 3, 5, 7]]) + unknown == pytest.approx(1)


def test_near_duplicates(docs):
    shingles, words = {}, {}
    for i, t in pairs(docs):
        w = (t or "").lower().split()
        words[i] = w
        shingles[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    ids = sorted(i for i in shingles if i is not None and shingles[i])
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = sum((shingles[a] | shingles[b]).values())
            if a < b and sum((shingles[a] & shingles[b]).values()) / both >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["class_id"] == (find(r["doc_id"]) if r["doc_id"] in parent else r["doc_id"])
    assert sum(r["doc_id"] != r["class_id"] for r in got) >= 3


def test_a_group_is_linked_through_its_hub(spark):
    """Copies near one text but not near one another are one class, whichever has the least id."""
    base = [f"w{k}" for k in range(200)]
    rows = [(100, " ".join(base))] + [(i, " ".join(w if k % 50 != i % 50 else f"z{i}" for k, w in enumerate(base))) for i in range(12)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_consistent_weighted_sampling_estimates_weighted_jaccard():
    import numpy as np

    weights = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0), 100, 1.0, 0.5)
    a, b = [f"w{k}" for k in range(300)], [f"w{k}" if k % 40 else "x" for k in range(300)]
    doc, key, weight, _ = neardup.shingles([" ".join(a), " ".join(b)], weights)
    s = neardup.Sampler(512, 4, 1).signatures(2, doc, key, weight)
    x, y = ({int(k): w for k, w in zip(key[doc == d], weight[doc == d])} for d in (0, 1))
    real = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
    assert (s[0] == s[1]).mean() == pytest.approx(real, abs=0.05)


def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        key = np.full(n, 12345, np.uint64)
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), key)) == list(range(n))


def test_pieces(docs):
    got = pieces.encode(docs, ["doc_id", "text"]).collect()
    lattice = pieces.Lattice(*pieces.vocabulary())
    import numpy as np

    for r in got:
        if r["text"] is None:
            assert r["ids"] is None and r["lossless"] is None
        else:
            assert r["lossless"] and (lattice.decode_text(np.array(r["ids"], np.int64)) if r["ids"] else "") == r["text"] and r["n_ids"] == len(r["ids"])
    other = pieces.encode(docs.repartition(7), ["doc_id", "text"]).collect()
    assert bag((r["doc_id"], r["ids"]) for r in got) == bag((r["doc_id"], r["ids"]) for r in other)
    assert bag((r["doc_id"], r["ids"]) for r in got) != bag((r["doc_id"], r["ids"]) for r in pieces.encode(docs, ["doc_id"], seed=1).collect())


def test_sampled_segmentations_follow_their_weights():
    import numpy as np

    names = ["", "\x0061", "a", "b", "ab", " ", " a"]
    scores = [0.0, 0.0, -1.0, -2.0, -3.0, -4.0, -5.0]
    lattice = pieces.Lattice(names, scores)
    w = {n: math.exp(lattice.weights[i]) for i, n in enumerate(names) if i > 1}
    ways = {(" ", "a", "b"): w[" "] * w["a"] * w["b"], (" ", "ab"): w[" "] * w["ab"], (" a", "b"): w[" a"] * w["b"]}
    n = 6000
    ids, counts = lattice.encode(["ab"] * n, np.arange(n).astype(np.uint64), 0)
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(names[i] for i in ids[e - c : e]) for e, c in zip(ends, counts))
    for way, weight in ways.items():
        assert seen[way] / n == pytest.approx(weight / sum(ways.values()), abs=0.03)


def test_quality(docs, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(0, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {}
    for r in quality.apply_rules(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in pairs(docs):
        w = (t or "").encode().split()
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                dup += x in seen
                seen.add(x)
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert want in [tuple(r[f"_{c}"] for c in quality.COUNTS[:5]) for r in got[i]]
        for r in got[i]:
            failed = r["_n_words"] < 20 or 100 * r["_n_repeat_words"] > 30 * r["_n_words"]
            assert r["_base_failed"] == failed and (not failed or not r["_kept"])


def test_cutoffs_limit_false_rejection(spark):
    """Rejections of good documents stay under the risk, and bad documents are rejected."""
    rows = [(i, "*** " * 10 + "word " * 20 if i % 10 == 0 else f"plain words only number {i} " * 2 + " ".join(f"t{i}x{k}" for k in range(30)), "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat_ws(" ", F.lit("*** *** *** ***"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("v"), k.cast("string"), F.col("doc_id").cast("string"))))).otherwise(F.col("text")))
    got = quality.apply_rules(docs, labels).collect()
    assert all(r["_kept"] for r in got if r["doc_id"] % 10) and not any(r["_kept"] for r in got if r["doc_id"] % 10 == 0)


def test_binomial_test_is_exact():
    import numpy as np

    for k, n, p in ((0, 300, 0.01), (2, 500, 0.02), (5, 1000, 0.01), (30, 60, 0.4)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = quality.binomial_cdf(np.array([k]), np.array([n]), p)[0]
        assert got == pytest.approx(want) if k < n * p else got == 1


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substrings.remove_repeats(none).count() == 0
    assert lines.drop_repeated_lines(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert lm.score_texts(none, F.lit(False)).count() == 0
    assert neardup.classes(none).count() == 0
    shards, rows, sources = mixing.mix(none)
    assert shards.count() == sources.count() == mixing.taken_words(shards, rows, sources).count() == 0
    assert pieces.encode(none, ["doc_id"]).count() == 0
    assert quality.apply_rules(none, labels).count() == 0


def test_blocks_find_the_links_that_pairs_find(docs, monkeypatch):
    want = bag(map(tuple, neardup.classes(docs).collect()))
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "CROSS", 2)
    monkeypatch.setattr(neardup, "hub_pairs", lambda members, nodes: members.where("node <> lead and (n = 2 or lead % 3 = 0)").select(*neardup.ordered("node", "lead")).distinct())
    assert bag(map(tuple, neardup.classes(docs).collect())) == want
