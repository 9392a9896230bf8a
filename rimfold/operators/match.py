"""Joining truth and predicted ellipses, and assigning them one to one.

Both sides have image_no, seq (the row order that decides ties) and cx, cy, a, b, rot. The equi-join key is the image and
a cell of a grid over its plane, so that dense images make no more pairs than neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimfold.functions.geometry import PI, XI2_LIMIT, angle_between, configuration, near, xi_squared

SHAPE, MATRIX, CELL = ["cx", "cy", "a", "b", "rot"], ["y11", "y12", "y22"], 256.0


def sides(truth: DataFrame, pred: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with prefixed columns and their matrices, once a row."""

    def named(rows: DataFrame, side: str, *more: str) -> DataFrame:
        matrix = [y.alias(f"{side}_{m}") for m, y in zip(MATRIX, configuration("a", "b", "rot"))]
        return rows.select("image_no", F.col("seq").alias(f"{side}_seq"), *[F.col(c).alias(f"{side}_{c}") for c in (*SHAPE, *more)], *matrix)

    return named(truth, "t", *keep), named(pred, "p")


def candidate_pairs(truth: DataFrame, pred: DataFrame, *keep: str, cell: float | None = CELL) -> DataFrame:
    """Pairs that pass the gate. A prediction that passes has its centre within the truth's smaller semi-axis: a truth is in
    all cells that this square touches (mostly one to four), a prediction in one. Without a cell the key is the image."""
    left, right = sides(truth, pred, *keep)
    t, p = tuple(f"t_{c}" for c in SHAPE), tuple(f"p_{c}" for c in SHAPE)
    if cell is None:
        return left.join(right, "image_no").where(near(t, p))
    r = F.least("t_a", "t_b")
    touched = {g: F.explode(F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell))) for g, c in (("gx", "t_cx"), ("gy", "t_cy"))}
    for g, cells in touched.items():
        left = left.withColumn(g, cells)
    right = right.withColumns({"gx": F.floor(F.col("p_cx") / cell), "gy": F.floor(F.col("p_cy") / cell)})
    return left.join(right, ["image_no", "gx", "gy"]).where(near(t, p)).drop("gx", "gy")


def measured_pairs(truth: DataFrame, pred: DataFrame, *keep: str, guard: float | None = None, cell: float | None = CELL) -> DataFrame:
    """candidate_pairs with dga and xi2."""
    t, p = (tuple(f"{side}_{c}" for c in ("cx", "cy", *MATRIX)) for side in "tp")
    pairs = candidate_pairs(truth, pred, *keep, cell=cell).withColumn("dga", angle_between(t, p, guard))
    return pairs.withColumn("xi2", xi_squared("dga", "t_a", "t_b"))


def greedy_matches(pairs: DataFrame, limit: float = XI2_LIMIT) -> DataFrame:
    """image_no and matches (t_seq, p_seq, dga): each truth in order takes the free prediction of least angle, if its
    xi2 is below the limit; a rejected best is not taken and no second one tried.

    For one truth xi2 grows with the angle, so pairs over the limit can be left out first without changing a choice. A
    truth whose best prediction no other truth can take is sure of it; the fold in order runs over the truths of an
    image that compete, which are few however dense the image is.
    """
    fine = pairs.where(F.col("xi2") < limit).select("image_no", "t_seq", "p_seq", "dga").repartition("image_no")
    rivals = fine.withColumn("rivals", F.count(F.lit(1)).over(Window.partitionBy("image_no", "p_seq")))
    options = rivals.groupBy("image_no", "t_seq").agg(F.array_sort(F.collect_list(F.struct("dga", "p_seq", "rivals"))).alias("options"))
    best = F.get("options", 0)
    sure = F.struct("t_seq", best["p_seq"].alias("p_seq"), best["dga"].alias("dga"))
    sides = options.withColumn("alone", best["rivals"] == 1).groupBy("image_no").agg(
        F.collect_list(F.when(F.col("alone"), sure)).alias("sure"), F.array_sort(F.collect_list(F.when(~F.col("alone"), F.struct("t_seq", "options")))).alias("truths"),
    )
    none = F.array().cast("array<struct<t_seq:bigint,p_seq:bigint,dga:double>>")
    start = F.struct(none.alias("done"), F.array().cast("array<bigint>").alias("used"))

    def step(state, truth):
        best = F.get(F.filter(truth["options"], lambda o: ~F.array_contains(state["used"], o["p_seq"])), 0)
        match = F.struct(truth["t_seq"].alias("t_seq"), best["p_seq"].alias("p_seq"), best["dga"].alias("dga"))
        taken = F.struct(F.concat(state["done"], F.array(match)).alias("done"), F.concat(state["used"], F.array(best["p_seq"])).alias("used"))
        return F.when(best.isNull(), state).otherwise(taken)

    return sides.select("image_no", F.concat("sure", F.aggregate("truths", start, step)["done"]).alias("matches"))


def match_rows(matches: DataFrame) -> DataFrame:
    return matches.select("image_no", F.explode("matches").alias("m")).select("image_no", "m.t_seq", "m.p_seq", "m.dga")


def best_truth(truth: DataFrame, pred: DataFrame, limit: float = XI2_LIMIT) -> DataFrame:
    """For each prediction the truth of least angle (the earlier of equals, not exclusive): target_score, target_xi2,
    target_class; without one under the limit 0, the xi2 (infinite if none was compared) and -1."""
    pairs = measured_pairs(truth, pred, "cls")
    best = pairs.groupBy("image_no", "p_seq").agg(F.min(F.struct("dga", "t_seq", "xi2", "t_cls")).alias("x"))
    rows = pred.select("image_no", F.col("seq").alias("p_seq")).join(best, ["image_no", "p_seq"], "left")
    hit = F.coalesce(F.col("x.xi2") < limit, F.lit(False))
    return rows.select(
        "image_no", "p_seq", F.when(hit, 1.0 - F.col("x.dga") / PI).otherwise(0.0).alias("target_score"),
        F.coalesce("x.xi2", F.lit(float("inf"))).alias("target_xi2"), F.when(hit, F.col("x.t_cls")).otherwise(-1).alias("target_class"),
    )


def highest_score(truth: DataFrame, pred: DataFrame, limit: float = XI2_LIMIT) -> DataFrame:
    """For each prediction the best 1 - angle/pi over the truths under the limit, else 0."""
    pairs = measured_pairs(truth, pred).where(F.col("xi2") < limit)
    best = pairs.groupBy("image_no", "p_seq").agg(F.max(1.0 - F.col("dga") / PI).alias("best"))
    rows = pred.select("image_no", F.col("seq").alias("p_seq")).join(best, ["image_no", "p_seq"], "left")
    return rows.select("image_no", "p_seq", F.coalesce("best", F.lit(0.0)).alias("gold_score"))


def centre_recall(truth: DataFrame, pred: DataFrame, cell: float = CELL) -> DataFrame:
    """By image: truths, those with a prediction's centre closer than their smaller semi-axis, and the share."""
    left, right = sides(truth, pred)
    r = F.least("t_a", "t_b")
    for g, c in (("gx", "t_cx"), ("gy", "t_cy")):
        left = left.withColumn(g, F.explode(F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell))))
    right = right.withColumns({"gx": F.floor(F.col("p_cx") / cell), "gy": F.floor(F.col("p_cy") / cell)})
    dx, dy = F.col("t_cx") - F.col("p_cx"), F.col("t_cy") - F.col("p_cy")
    hit = left.join(right, ["image_no", "gx", "gy"]).where(dx * dx + dy * dy < r * r).select("image_no", "t_seq").distinct()
    found = hit.groupBy("image_no").agg(F.count(F.lit(1)).alias("hits"))
    all_ = truth.groupBy("image_no").agg(F.count(F.lit(1)).alias("truths")).join(found, "image_no", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return all_.withColumn("recall", F.col("hits") / F.col("truths"))
