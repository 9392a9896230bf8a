"""Long texts are taken in parts; parts of a hot context are bounded."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimfold.llm import lm, substrings


@pytest.mark.parametrize("part", [500, 1777, 4_000_000])
def test_passages_across_the_parts_of_long_texts(spark, monkeypatch, part):
    monkeypatch.setattr(substrings, "PART", part)
    rng = np.random.default_rng(part)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = noise(900)
    texts = [noise(1300) + passage + noise(2411) + passage[:650] + noise(77), noise(50) + passage[200:] + noise(3), passage, "q" * 3000, noise(399)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(rows).collect()}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            gone[p : p + 400] |= seen[t[p : p + 400]] > 1
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        assert got[i] == (int(gone.sum()), spans, hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest())
    assert sum(g[0] for g in got.values()) > 3000


def test_large_ids_beside_rows_without_id(spark):
    """An id over 2^53 is no double; a row without id is not the row of id 0 with its text."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, tail = noise(450), noise(500)
    rows = [(2**53 + 1, noise(50) + passage), (None, noise(500)), (2**53 + 3, passage + noise(60)), (None, tail), (0, tail), (0, "é" * 30), (None, None)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(2**53 + 1, 500, 450), (None, 500, 0), (2**53 + 3, 510, 450), (None, 500, 500), (0, 500, 500), (0, 60, 0), (None, 0, 0)]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found) == Counter(want)


@pytest.mark.parametrize("tokens", [30_000, 300_000])
def test_no_part_grows_with_the_corpus(spark, monkeypatch, tokens):
    """One word makes up one token in 20 and has ever more followers; no part gets over twice PART of the bigrams asked."""
    monkeypatch.setattr(lm, "PART", 1000)
    monkeypatch.setattr(lm, "GROUP", 20_000)
    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in rng.integers(0, 10_000_000, tokens)], object)
    words[::20] = "hot"
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(np.split(words, tokens // 1000))], "doc_id long, text string")
    sizes, make = {}, lm._requests

    def noted(order, parts, hot):
        def run(batches):
            for batch in make(order, parts, hot)(batches):
                batch["seen"] = [b"" if f is None else int.from_bytes(f[:8], "little").to_bytes(8, "little") for f in batch["followers"]]
                yield batch

        return run

    groups = lm.grouped(docs, F.lit(False))
    request = "o int, p long, g long, contexts binary, hot binary, runs binary, followers binary, seen binary"
    answer = "g long, o int, p long, times binary, after binary, context long, t long, n long, gram long"
    parts, hot = tokens // 1000, np.zeros(0, np.uint64)
    for order in (1, 2, 3):
        asked = groups.drop("n").mapInPandas(noted(order, parts, hot), request).where("o > 0")
        sizes[order] = Counter()
        for r in asked.select("p", "seen").collect():
            sizes[order][r["p"]] += int.from_bytes(r["seen"], "little")
        own = groups.drop("n").mapInPandas(make(order, parts, hot), request).groupBy("o", "p").applyInPandas(lm._answers(500), answer)
        hot = np.array([r["gram"] for r in own.where("gram is not null").select("gram").collect()], np.int64).view(np.uint64)
        if order == 1:
            assert len(hot) == 1
            hot = np.append(hot, lm.FIRST)
        assert max(sizes[order].values()) <= 2000, order
