"""Conversations, vectors, the pipeline and the registry."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from rimfold.llm import chat, topk


def test_chat(spark):
    rows = [
        (1, 0, "system", "be <|end|> kind \\n"), (1, 1, "user", "hé\n<|turn|>"), (1, 2, "assistant", "\n\n  ok \\<| 漢字 😀 "), (1, 3, "user", ""), (1, 4, "assistant", ""), (1, 5, "assistant", "<"),
        (2, 0, "assistant", "x" * 30_000), (3, None, None, None), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
    ]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, turns int, ids string")
    got = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
        assert len(got[conv]["ids"]) == len(got[conv]["loss"])
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_token_mask():
    spans, offsets = np.array([[2, 5], [7, 7], [9, 12]]), np.array([[0, 2], [2, 3], [3, 5], [5, 7], [7, 9], [9, 12]])
    assert chat.token_mask(offsets, spans).tolist() == [False, True, True, False, False, True]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 6).round(1)]) for i in range(700)]
    data[5] = (5, None)
    data[6] = (6, [0.1, None, 0.2])
    data[7] = (7, [float("nan"), 1.0])
    data[8] = (8, [float("inf")])
    data[9] = (9, [1.0, 2.0])
    data += [(None, [1.0] * 6), (900, []), (1000, [0.0] * 6), (300, [0.3, -0.2] * 3), (301, [0.9] * 6), data[400], data[400], (301, [0.9] * 6)]
    rows = topk.integers(spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, score int"))
    got = {}
    for r in topk.top_k(rows, "vec_id % 100 = 0", 10, block=64, shard=3).collect():
        got.setdefault((r["query_id"], r["query_row"]), []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(fine):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for k, (i, w) in enumerate(fine) if k != at)[:10]
            want.append((q, [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]))
    assert sorted((q, sorted(x)) for (q, _), x in got.items()) == sorted(want) and len(want) == 12
    few = topk.top_k(rows.where("vec_id % 100 = 0"), "vec_id >= 300", 20)
    assert few.count() == 11 * few.select("query_row").distinct().count()
    assert topk.top_k(rows.limit(0), "true", 10).count() == 0


def test_threshold_algorithm_stops_early():
    x = np.array([[100 - i, 100 - i] for i in range(100)]) ** 3
    met = []

    class Watch(np.ndarray):
        def __matmul__(self, other):
            met.append(len(self))
            return np.asarray(self) @ other

    lists = np.argsort(-x, axis=0, kind="stable")
    best = topk.threshold_search(x.view(Watch), np.arange(100), lists, np.array([1, 1]), -1, 3)
    assert sorted(best.tolist()) == [0, 1, 2] and sum(met) < 100
    once = sum(met)
    best = topk.threshold_search(x.view(Watch), np.arange(100), lists, np.array([1, 1]), -1, 60, 2 * 99**3)
    assert sorted(best.tolist()) == [0, 1] and sum(met) - once < 30  # a bound from elsewhere ends the walk before k are found


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, rows, str(tmp_path))
    assert kept.columns == columns
    words = F.size(F.array_compact(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    assert kept.where(words < 20).count() == 0 and kept.count() > 30
    lined = corpus_pipeline.line_dedup(spark, kept, str(tmp_path))
    assert lined.columns == columns and lined.count() == kept.count()
    one = corpus_pipeline.near_dedup(spark, kept, str(tmp_path))
    texts = [" ".join((r["text"] or "").lower().split()) for r in one.where("doc_id is not null").collect()]
    assert one.columns == columns and len(set(texts)) == len(texts)
    mixed = corpus_pipeline.mix_sources(spark, kept, str(tmp_path))
    most = mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert mixed.columns == columns and most <= 9  # three rows of one document, three times each
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["lossless"] in (True, None) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "sentencepiece"]


def test_registry():
    from rimfold.llm import registry

    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert hashlib.sha256(b"").hexdigest()
