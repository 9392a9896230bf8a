"""Scoring predictions as their files arrive.

Images are whole in a file, so each micro-batch is scored by the batch operators against the truth table, and its
scores are appended under the batch's number: a batch run again after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rimfold.operators.score import image_scores


def score_arrivals(spark: SparkSession, source: str, schema, truth: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """A query that scores all Parquet files now in source (and, started again, what came since) into sink."""

    def work(batch: DataFrame, number: int) -> None:
        images = batch.select("image_no").distinct()
        scores = image_scores(truth.join(images, "image_no", "left_semi"), batch)
        scores.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/part={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
