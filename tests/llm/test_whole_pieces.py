"""Texts without spaces, which are one chunk of any length."""

import collections
import math
import random

import numpy as np
import pytest

from rimfold.llm import pieces


def test_long_chunks_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 300)
    monkeypatch.setattr(pieces, "WINDOW", 37)
    lattice = pieces.Lattice(*pieces.vocabulary())
    rng = random.Random(1)
    unbroken = "".join(rng.choice("theandingré漢😀") for _ in range(5000))
    texts = [unbroken, "short words " + unbroken[:1000] + " and more", "x" * 301, unbroken]
    keys = np.array([1, 2, 3, 1], np.uint64)
    ids, counts = lattice.encode(texts, keys, 0)
    ends = np.cumsum(counts)
    own = [ids[e - c : e] for e, c in zip(ends, counts)]
    assert [lattice.decode_text(x) for x in own] == texts and own[0].tolist() == own[3].tolist()
    assert own[0].tolist() != lattice.encode([unbroken], np.array([9], np.uint64), 0)[0].tolist()


def test_windows_draw_as_the_lattice_weighs(monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 1)
    monkeypatch.setattr(pieces, "WINDOW", 2)
    names = ["", "\x0061", "a", "b", "ab", " ", " a"]
    lattice = pieces.Lattice(names, [0.0, 0.0, -1.0, -2.0, -3.0, -4.0, -5.0])
    w = {n: math.exp(lattice.weights[i]) for i, n in enumerate(names) if i > 1}
    ways = {(" ", "a", "b"): w[" "] * w["a"] * w["b"], (" ", "ab"): w[" "] * w["ab"], (" a", "b"): w[" a"] * w["b"]}
    n = 3000
    ids, counts = lattice.encode(["ab"] * n, np.arange(n).astype(np.uint64), 0)
    ends = np.cumsum(counts)
    seen = collections.Counter(tuple(names[i] for i in ids[e - c : e]) for e, c in zip(ends, counts))
    for way, weight in ways.items():
        assert seen[way] / n == pytest.approx(weight / sum(ways.values()), abs=0.04)


def test_a_very_long_text_without_spaces():
    lattice = pieces.Lattice(*pieces.vocabulary())
    text = "abcdefghij" * 30_000
    ids, counts = lattice.encode([text], np.array([5], np.uint64), 0)
    assert lattice.decode_text(ids) == text and counts[0] == len(ids) < len(text)
