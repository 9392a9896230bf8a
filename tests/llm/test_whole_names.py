"""Extra columns keep their values where their names are those that operators use inside, and stages take empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rimfold.llm import lines

NAMES = ["_doc", "_text", "_d", "_t", "_runs", "_k1", "_k2", "_nth", "_row", "_class", "_id", "_part", "own", "hash", "runs", "pieces", "size", "source_no", "block", "k0"]


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


def values(df):
    return sorted({(str(r["doc_id"]), *(str(r[c]) for c in NAMES)) for r in df.select("doc_id", *NAMES).collect()})


def test_lines_keep_other_columns(docs, odd):
    got = lines.drop_repeated_lines(odd)
    assert got.columns == [*odd.columns, "_kept_text", "_n_lines", "_n_removed"] and values(got) == values(odd)
    plain = lines.drop_repeated_lines(docs.select("doc_id", "text"))
    shown = ["doc_id", "text", "_kept_text", "_n_lines", "_n_removed"]
    assert sorted(map(repr, got.select(*shown).collect())) == sorted(map(repr, plain.select(*shown).collect()))


def test_stages_take_empty_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "/root/testdata/sf0.001")
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == rows.columns)


def test_stages_keep_other_columns(spark, odd):
    """All stages but the last give the columns they got, with their values."""
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns and set(values(out)) <= set(values(odd)) and out.count() > 5
