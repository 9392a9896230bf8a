"""Scores of images and of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimfold.functions.geometry import PI
from rimfold.operators.match import CELL, greedy_matches, match_rows, measured_pairs


def counts(rows: DataFrame, name: str) -> DataFrame:
    """image_no, the rows, and whether the image is the one row of an empty image (a = -1)."""
    return rows.groupBy("image_no").agg(F.count(F.lit(1)).alias(name), ((F.count(F.lit(1)) == 1) & (F.min("a") == -1)).alias(f"{name}_empty"))


def image_scores(truth: DataFrame, pred: DataFrame, *, sentinels: bool = True, guard: float | None = None, cell: float | None = CELL) -> DataFrame:
    """image_no, n_truth, n_pred, n_match, score for each truth image.

    score = sum(1 - angle / pi) / n_pred * min(1, n_match / min(10, n_truth)); 0 without predictions or matches. With
    sentinels, an image whose one row has a = -1 is empty: 1 if both sides are, 0 if one is.
    """
    real_t, real_p = truth.where("a > 0 and b > 0"), pred.where("a > 0 and b > 0")
    sums = match_rows(greedy_matches(measured_pairs(real_t, real_p, guard=guard, cell=cell))).groupBy("image_no").agg(F.count(F.lit(1)).alias("n_match"), F.sum(1.0 - F.col("dga") / PI).alias("good"))
    rows = counts(truth, "n_truth").join(counts(pred, "n_pred"), "image_no", "left").join(sums, "image_no", "left")
    rows = rows.withColumns({"n_pred": F.coalesce("n_pred", F.lit(0)), "n_match": F.coalesce("n_match", F.lit(0)), "n_pred_empty": F.coalesce("n_pred_empty", F.lit(False))})
    score = F.coalesce(F.try_divide("good", "n_pred") * F.least(F.lit(1.0), F.col("n_match") / F.least(F.lit(10), "n_truth")), F.lit(0.0))
    if sentinels:
        t, p = F.col("n_truth_empty"), F.col("n_pred_empty") & (F.col("n_pred") > 0)
        score = F.when(F.col("n_pred") == 0, F.lit(0.0)).when(t & p, F.lit(1.0)).when(t != p, F.lit(0.0)).otherwise(score)
    return rows.select("image_no", "n_truth", "n_pred", "n_match", score.alias("score"))


def dataset_score(scores: DataFrame) -> DataFrame:
    """100 times the mean over the truth images."""
    return scores.agg(F.count(F.lit(1)).alias("images"), F.sum("n_match").alias("matches"), (100.0 * F.avg("score")).alias("dataset_score"))


def prediction_details(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """For each prediction whether it is matched and with which score."""
    found = match_rows(greedy_matches(measured_pairs(truth, pred))).select("image_no", "p_seq", (1.0 - F.col("dga") / PI).alias("good"))
    rows = pred.select("image_no", F.col("seq").alias("p_seq")).join(found, ["image_no", "p_seq"], "left")
    return rows.select("image_no", "p_seq", F.col("good").isNotNull().cast("int").alias("matched"), F.coalesce("good", F.lit(0.0)).alias("match_score"))


def expected_and_matched(truth: DataFrame, pred: DataFrame, least: float = 5.0) -> DataFrame:
    """For each image with predictions: truths with b >= least, matched predictions, recall, and a flag below 0.3."""
    wanted = truth.where(F.col("b") >= least).groupBy("image_no").agg(F.count(F.lit(1)).alias("expected"))
    got = prediction_details(truth, pred).groupBy("image_no").agg(F.count(F.lit(1)).alias("candidates"), F.sum("matched").alias("matched"))
    rows = got.join(wanted, "image_no", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    recall = F.coalesce(F.try_divide("matched", "expected"), F.lit(0.0))
    return rows.select("image_no", "candidates", "expected", "matched", recall.alias("recall"), (recall < 0.3).alias("low"))
