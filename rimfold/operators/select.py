"""Choosing candidates: limits, thresholds, rescue, suppression, gates. Rows have image_no and seq; seq decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimfold.functions import geometry as G


def best_rows(rows: DataFrame, by: str, limit: int = 12) -> DataFrame:
    """The first `limit` rows of each image by `by` descending (0: all), with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("image_no").orderBy(F.desc(by), "seq")))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def ladder(top: float = 0.7, bottom: float = 0.6, step: float = 0.01) -> list[float]:
    """Thresholds by repeated subtraction, down to bottom - 1e-6 (so the floats are those of that loop)."""
    out = []
    while top >= bottom - 1e-6:
        out.append(top)
        top -= step
    return out


def adaptive_selection(rows: DataFrame, *, conf: str = "conf", enough: int = 10, top: float = 0.7, bottom: float = 0.6) -> DataFrame:
    """Rows at or over the image's threshold: the highest of the ladder with `enough` rows, else the lowest.

    One pass: the k-th highest confidence of an image tells which thresholds have enough rows.
    """
    steps = ladder(top, bottom)
    kth = Window.partitionBy("image_no").orderBy(F.desc(conf), "seq")
    per_image = rows.withColumn("_k", F.row_number().over(kth)).groupBy("image_no").agg(F.max(F.when(F.col("_k") == enough, F.col(conf))).alias("_kth"))
    fits = F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("_kth"))
    limits = per_image.select("image_no", F.coalesce(F.get(fits, 0), F.lit(steps[-1])).alias("threshold"))
    return rows.join(limits, "image_no").where(F.col(conf) >= F.col("threshold"))


def unselected(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(chosen.select("image_no", "seq"), ["image_no", "seq"], "left_anti")


def rescue_fill(chosen: DataFrame, rows: DataFrame, by: str, *, least: float = 0.85, enough: int = 10) -> DataFrame:
    """chosen, and for images with fewer than `enough` the best unselected rows with by >= least, up to that number."""
    have = chosen.groupBy("image_no").agg(F.count(F.lit(1)).alias("_have"))
    more = unselected(rows, chosen).where(F.col(by) >= least).join(have, "image_no", "left")
    nth = F.row_number().over(Window.partitionBy("image_no").orderBy(F.desc(by), "seq"))
    more = more.withColumn("_nth", nth).where(F.col("_nth") <= enough - F.coalesce("_have", F.lit(0))).select("image_no", "seq", F.lit("rescued").alias("origin"))
    return chosen.select("image_no", "seq", F.lit("selected").alias("origin")).unionByName(more)


def suppress_overlaps(rows: DataFrame, *, conf: str = "conf") -> DataFrame:
    """image_no, seq of the rows kept when, from the most confident down, a row goes that is near a kept one: distance
    below |r1 - r2| or 0.8 (r1 + r2), r = sqrt(ab). A fold over the candidates of one image."""
    item = F.struct((-F.col(conf)).alias("o"), F.col("seq").alias("s"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.sqrt(F.col("a") * F.col("b")).alias("r"))
    images = rows.groupBy("image_no").agg(F.array_sort(F.collect_list(item)).alias("c"))

    def near(q, c):
        d = F.sqrt((q["x"] - c["x"]) * (q["x"] - c["x"]) + (q["y"] - c["y"]) * (q["y"] - c["y"]))
        return d < F.greatest(F.abs(q["r"] - c["r"]), 0.8 * (q["r"] + c["r"]))

    kept = F.aggregate("c", F.filter("c", lambda x: F.lit(False)), lambda kept, c: F.when(F.exists(kept, lambda q: near(q, c)), kept).otherwise(F.concat(kept, F.array(c))))
    return images.select("image_no", F.explode(kept).alias("k")).select("image_no", F.col("k.s").alias("seq"))


def perimeter_samples(rows: DataFrame, n: int, width: int, height: int) -> DataFrame:
    """rows with k, x, y for n even angles on the perimeter; samples outside the image are left out."""
    every = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(n)])))
    x, y = G.perimeter_point("cx", "cy", "a", "b", "rot", F.lit(2 * G.PI) * F.col("k") / n)
    at = every.withColumns({"x": x, "y": y})
    inside = (F.col("x") > -1) & (F.col("x") < width) & (F.col("y") > -1) & (F.col("y") < height)
    return at.where(inside)


def visible(rows: DataFrame, width: int, height: int, *, least: float = 40.0, ratio: float = 0.6) -> DataFrame:
    """Rows large enough, small enough for the image and wholly inside it by the box of the rotated rectangle."""
    hw, hh = G.rectangle_half("a", "b", "rot")
    cx, cy = F.col("cx"), F.col("cy")
    inside = (cx - hw >= 0) & (cy - hh >= 0) & (cx + hw < width) & (cy + hh < height)
    return rows.where((F.least("a", "b") >= least) & (2 * hw + 2 * hh < ratio * min(width, height)) & inside)


def region_shape(rows: DataFrame, *, area: float = 40, ecc: float = 0.95, ecc_area: float = 200, solidity: float = 0.7, solidity_area: float = 150) -> DataFrame:
    size = F.col("area")
    fine = (size >= area) & (F.col("minor") >= F.greatest(F.lit(3.0), 0.02 * F.sqrt(size)))
    return rows.where(fine & ~((F.col("ecc") > ecc) & (size < ecc_area)) & ~((F.col("solidity") < solidity) & (size < solidity_area)))


def valid_axes(w, h, most: float = 4.0) -> Column:
    w, h = G.col(w), G.col(h)
    return (w >= 5) & (h >= 5) & (F.greatest(w, h) / (F.least(w, h) + 1e-6) < most)
