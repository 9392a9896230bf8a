"""Repeated runs of lines of every length, against brute force."""

import random

import pytest

import corpus_pipeline
from rimfold.llm import lines


def left(texts, n, chars):
    split, gone, first = [t.split("\n") for t in texts], [set() for _ in texts], {}
    for d, own in enumerate(split):
        for p in range(len(own)):
            for size in range(1, len(own) - p + 1):
                run = tuple(own[p : p + size])
                if run in first and first[run] < (d, p) and (size >= n or sum(map(len, run)) >= chars):
                    gone[d] |= set(range(p, p + size))
                first.setdefault(run, (d, p))
    return ["\n".join(x for k, x in enumerate(own) if k not in g) for own, g in zip(split, gone)]


@pytest.mark.parametrize("n", [4, 8])
def test_runs_of_every_length(spark, n):
    rng = random.Random(3)
    pool = [f"{k} " + "y" * rng.randint(5, 90) for k in range(40)]
    texts = ["\n".join(pool[k] for k in [*range(a, a + m), rng.randrange(40)]) + f"\nown {i}" for i, (a, m) in enumerate((rng.randrange(32), rng.randint(1, 8)) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = left(texts, n, 200)
    got = [r["_kept_text"] for r in lines.drop_repeated_lines(docs, lines=n).orderBy("doc_id").collect()]
    assert got == want and any(w != t for w, t in zip(want, texts))


@pytest.mark.parametrize("sizes", [(95, 95, 95), (140, 20, 140)])
def test_the_pipeline_drops_passages_of_three_lines(spark, sizes):
    passage = "\n".join(c * k for c, k in zip("abc", sizes))
    docs = spark.createDataFrame([(i, f"head {i}\n{passage}\ntail {i}", 0) for i in range(3)], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()
    assert [passage in r["text"] for r in got] == [True, False, False] and got[2]["text"] == "head 2\ntail 2"


def test_maximal_runs(spark):
    """Runs of 5 and 100 lines come out whole, and copies of whole sequences, with blank lines between, go as a whole."""
    long = [f"line {k}" for k in range(100)]
    texts = ["\n".join(["a", *long, "b"]), "\n".join(["c", *long, "d"]), "\n".join(["e", *long[40:45], "f", *long[:3], "g"]), "\n\n".join(["a", *long, "b"]), "short\ntext", "short\ntext"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_doc"]: [(x["at"], x["end"]) for x in r["runs"]] for r in lines.repeated_runs(docs).collect()}
    assert got == {1: [(1, 101)], 2: [(1, 6)], 3: [(0, 102)]}


def test_long_texts_and_a_very_common_line(spark):
    """Work is linear in the lines of a text, and a line that a third of all documents share is a line like others."""
    import time

    rows = [(i, "\n".join(f"{i} {k}" if k % 10_000 else "shared one\nshared two\nshared three\nshared four" for k in range(100_000))) for i in range(2)]
    rows += [(i, f"own {i}\n" + ("c" * 300 if i % 3 == 0 else f"other {i}") + f"\n \nend {i}") for i in range(10, 1000)]
    began = time.time()
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert got[0]["_n_removed"] == 36 and got[1]["_n_removed"] == 40 and got[1]["_n_lines"] == 100_030
    assert got[12]["_n_removed"] == 0 and got[15]["_kept_text"] == "own 15\n \nend 15"
