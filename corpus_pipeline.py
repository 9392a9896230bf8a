"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.llm import lines, mixing, neardup, pieces, quality
from rimfold.llm.common import read, stored

#: Words in a block of the mix.
BLOCK = 512


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows of equal doc_id, language and text are judged alike."""
    own = F.struct(*docs.columns).alias("own")  # the input's columns go in one, so that no name clashes
    keyed = docs.select(own, "doc_id", "lang", "text", F.xxhash64("text").alias("hash"))
    measured = stored(quality.statistics(keyed.drop("own"), ["doc_id", "lang", "hash"]))
    judged = quality.verdicts(measured, quality.fit_cutoffs(measured, read(spark, sf_dir, "labels")))
    gone = judged.where(~F.col("_kept")).select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), F.col("hash").alias("h")).distinct()
    rows = docs.select(own, F.col("doc_id").alias("id"), F.col("lang").alias("tongue"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("d")) & F.col("tongue").eqNullSafe(F.col("l")) & (F.col("hash") == F.col("h"))
    return rows.join(gone, same, "left_anti").select("own.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of repeated runs of lines; some are empty then, and n_chars follows."""
    kept = F.col("_kept_text")
    made = {"text": kept, "n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)}
    return lines.drop_repeated_lines(docs).select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least doc_id (no id first, then the text's hash). Rows are told apart by doc_id
    and text, so texts of one doc_id are documents of their own and equal rows are one; texts without words stay."""
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(3))
    found = stored(neardup.classes(docs.select(row.alias("doc_id"), "text")).distinct().toDF("row", "class"))
    least = F.min(F.struct(F.col("id"), F.col("row"))).alias("least")
    first = docs.select(F.col("doc_id").alias("id"), row.alias("row")).join(found.hint("merge"), "row").groupBy("class").agg(least).select(F.col("least.row").alias("row"))
    keyed = docs.select(F.struct(*docs.columns).alias("own"), row.alias("row"))  # the input's columns go in one, so that no name clashes
    one = keyed.join(first.hint("merge"), "row", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    return one.where("nth = 1").select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed shards: a row for each piece of a document in a slot, as often as the mix takes it. text is the piece
    (pieces of BLOCK words at most, most documents whole) and n_chars follows; the other columns are the document's."""
    rest = [c for c in docs.columns if c != "text"]
    shards, _, _ = mixing.mix(docs, keep=rest, block=BLOCK)
    chars = F.length("piece").cast(docs.schema["n_chars"].dataType)
    return shards.withColumns({"n_chars": chars, "text": F.col("piece")}).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, ["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Sampling, likelihood tests and hashed bands have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
