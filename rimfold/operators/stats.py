"""Aggregates over scored candidates: distributions, thresholds, classification and ranking metrics.

Where a running total over all rows is needed, values are first counted by value, then summed by bucket and within a
bucket, so no window spans the whole data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = {0: 0.0, 1: 0.6, 2: 1.5, 3: 2.7, 4: 4.0}  # fixed values: class -> ordinal target
CUTS = [0.3, 1.0, 2.1, 3.3]  # fixed values: ordinal -> class, lower bound included


def n_rows() -> Column:
    return F.count(F.lit(1))


def ordinal_target(cls: str) -> Column:
    out = F.lit(None).cast("double")
    for k, v in ORDINAL.items():
        out = F.when(F.col(cls) == k, F.lit(v)).otherwise(out)
    return out


def ordinal_class(value, cuts=CUTS) -> Column:
    return sum(((value if isinstance(value, Column) else F.col(value)) >= c).cast("int") for c in cuts)


def scaled(rows: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns whose name starts with a key of factors, multiplied."""
    return rows.withColumns({c: F.col(c) * k for c in rows.columns for p, k in factors.items() if c.startswith(p)})


def class_distribution(rows: DataFrame, cls: str = "cls") -> DataFrame:
    counts = rows.groupBy(cls).agg(n_rows().alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), (F.max("n") / F.min("n")).alias("imbalance"),
        F.max_by(cls, F.struct("n", -F.col(cls))).alias("largest"), F.min_by(cls, F.struct("n", cls)).alias("smallest"),
    )


def describe(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.percentile(c, 0.25).alias("q1"),
        F.percentile(c, 0.5).alias("q2"), F.percentile(c, 0.75).alias("q3"), F.max(c).alias("most"), F.count_if(c.isNull()).alias("missing"),
    )


def by_class(rows: DataFrame, column: str, cls: str = "cls") -> DataFrame:
    return rows.groupBy(cls).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.median(column).alias("median"))


def correlations(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """name, r for each column, by |r| descending; one aggregate for all."""
    wide = rows.agg(*[F.corr(c, target).alias(c) for c in columns])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.*")
    return long.orderBy(F.desc(F.abs("r")), "name")


def threshold_counts(rows: DataFrame, prob: str, thresholds: list[float]) -> DataFrame:
    """threshold, n, share of rows with prob >= threshold; one aggregate, then one row for each."""
    wide = rows.agg(n_rows().alias("all"), F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(prob) >= t).alias("n")) for t in thresholds]).alias("x"))
    return wide.select(F.explode("x").alias("x"), "all").select("x.threshold", "x.n", F.try_divide("x.n", "all").alias("share"))


def retention(rows: DataFrame, prob: str, threshold: float, cls: str = "cls") -> DataFrame:
    return rows.groupBy(cls).agg(n_rows().alias("before"), F.count_if(F.col(prob) >= threshold).alias("after")).withColumn("rate", F.col("after") / F.col("before"))


def discard_table(rows: DataFrame, prob: str, matched: str, thresholds: list[float]) -> DataFrame:
    """threshold, selected, tp, fp, precision (over max(1, selected))."""
    hit = F.col(matched) == 1
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(prob) >= t).alias("selected"), F.count_if((F.col(prob) >= t) & hit).alias("tp")) for t in thresholds]
    one = rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return one.withColumn("fp", F.col("selected") - F.col("tp")).withColumn("precision", F.col("tp") / F.greatest(F.lit(1), "selected"))


def top_of_image(rows: DataFrame, prob: str, score: str, thresholds: list[float], limit: int = 10) -> DataFrame:
    """For each threshold, over the best `limit` rows of each image with prob > threshold: sum of score, rows an image, misses.

    The best rows above a threshold are the best rows of the image that are above it, so one ranking serves all.
    """
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("image_no").orderBy(F.desc(prob), "seq"))).where(F.col("k") <= limit)
    images = rows.agg(F.count_distinct("image_no").alias("images"))
    parts = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(F.col(prob) > t, F.col(score)).otherwise(0.0)).alias("total"), F.count_if(F.col(prob) > t).alias("n"), F.count_if((F.col(prob) > t) & (F.col(score) == 0)).alias("misses")) for t in thresholds]
    wide = ranked.agg(F.array(*parts).alias("x")).join(images, F.lit(True))  # two one-row aggregates
    return wide.select(F.explode("x").alias("x"), "images").select("x.threshold", "x.total", "x.misses", (F.col("x.n") / F.col("images")).alias("per_image"))


def quality_buckets(rows: DataFrame, score: str = "target_score") -> DataFrame:
    s, n = F.col(score), n_rows()
    parts = {"high": F.count_if(s >= 0.9), "middle": F.count_if((s >= 0.7) & (s < 0.9)), "low": F.count_if((s > 0) & (s < 0.7)), "none": F.count_if(s == 0)}
    return rows.agg(n.alias("rows"), F.count_distinct("image_no").alias("images"), *[c.alias(k) for k, c in parts.items()], *[(c / n).alias(f"{k}_rate") for k, c in parts.items()])


def confusion(rows: DataFrame, true: str = "cls", guess: str = "guess") -> DataFrame:
    """true, guess, n and the share within the true class."""
    counts = rows.groupBy(F.col(true).alias("true"), F.col(guess).alias("guess")).agg(n_rows().alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def class_report(rows: DataFrame, classes: list[int], true: str = "cls", guess: str = "guess") -> DataFrame:
    """cls, precision, recall, f1, support for each given class; what has no rows is 0."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(guess).alias("g")).agg(n_rows().alias("n"))
    parts = []
    for c in classes:
        tp, got, real = (F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)) for w in ((F.col("t") == c) & (F.col("g") == c), F.col("g") == c, F.col("t") == c))
        parts.append(F.struct(F.lit(c).alias("cls"), tp.alias("tp"), got.alias("got"), real.alias("support")))
    each = cells.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    each = each.withColumns({"precision": F.coalesce(F.try_divide("tp", "got"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return each.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).select("cls", "precision", "recall", "f1", "support")


def averages(report: DataFrame) -> DataFrame:
    s = F.col("support")
    return report.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * s) / F.sum(s)).alias("weighted_f1"), (F.sum(F.col("recall") * s) / F.sum(s)).alias("accuracy"),
    )


def running(counts: DataFrame, value: str, sums: list[str], buckets: int = 4096) -> DataFrame:
    """counts (a row for each value in [0, 1]) with before_<s>: the sums of all rows of greater value."""
    c = counts.withColumn("_b", F.floor(F.col(value) * buckets))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # over at most `buckets` + 1 rows
    totals = c.groupBy("_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums]).select("_b", *[F.coalesce(F.sum(f"_t_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy("_b").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    rows = c.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_i_{s}") for s in sums]).join(totals, "_b")
    return rows.withColumns({f"before_{s}": F.col(f"_o_{s}") + F.col(f"_i_{s}") for s in sums}).select(*counts.columns, *[f"before_{s}" for s in sums])


def ranking_metrics(rows: DataFrame, prob: str, matched: str) -> DataFrame:
    """auc (ties count half) and average precision."""
    counts = rows.groupBy(F.col(prob).alias("p")).agg(F.count_if(F.col(matched) == 1).alias("pos"), F.count_if(F.col(matched) == 0).alias("neg"))
    r = running(counts, "p", ["pos", "neg"])
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    wins = F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2.0))
    return r.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"), (F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")).alias("average_precision"))


def majority(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """The most frequent class (the smallest of equals) and the accuracy of always giving it."""
    counts = rows.groupBy(cls).agg(n_rows().alias("n"))
    return counts.agg(F.max_by(cls, F.struct("n", -F.col(cls))).alias("majority"), (F.max("n") / F.sum("n")).alias("accuracy"))


def balanced_weights(rows: DataFrame, cls: str = "cls") -> DataFrame:
    counts = rows.groupBy(cls).agg(n_rows().alias("n"))
    every = Window.partitionBy()  # over one row for each class
    return counts.select(cls, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def stage_report(rows: DataFrame) -> DataFrame:
    """stage, n, total, mean, most and share of rows (stage, seconds)."""
    per = rows.groupBy("stage").agg(n_rows().alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))  # over one row for each stage


def seeded_place(*keys: str, seed: int = 42) -> F.Column:
    """Where a row stands in the seeded order: a digest of its keys and the seed."""
    return F.md5(F.concat_ws(":", *keys, F.lit(seed)))


def folds(rows: DataFrame, k: int = 5, cls: str = "cls", seed: int = 42) -> DataFrame:
    """rows with a fold from 0 to k - 1, stratified: within a class rows go in the seeded order, dealt in turn inside buckets of
    that order's first three digits, so that no class meets in one task."""
    at = rows.withColumn("_h", seeded_place("image_no", "seq", seed=seed)).withColumn("_b", F.substring("_h", 1, 3))
    nth = F.row_number().over(Window.partitionBy(cls, "_b").orderBy("_h", "seq"))
    return at.withColumn("fold", F.pmod(nth + F.conv("_b", 16, 10).cast("int"), F.lit(k)).cast("int")).drop("_h", "_b")


def threshold_search(rows: DataFrame, value: str, grid: list[list[float]], cls: str = "cls") -> DataFrame:
    """t0 < t1 < t2 < t3 of the grid with the highest macro F1 of ordinal_class (the first of equals).

    Rows are first counted by class and interval between grid values; the grid then meets that small table.
    """
    from itertools import product

    classes = list(range(len(grid) + 1))
    cuts = sorted({c for g in grid for c in g})
    cells = rows.groupBy(F.col(cls).alias("cls"), sum((F.col(value) >= c).cast("int") for c in cuts).alias("cell")).agg(n_rows().alias("n"))
    combos = [(i, *[float(x) for x in t], [sum(t[j] <= cuts[c - 1] for j in range(len(t))) if c else 0 for c in range(len(cuts) + 1)]) for i, t in enumerate(product(*grid)) if list(t) == sorted(set(t))]
    names = [f"t{j}" for j in range(len(grid))]
    table = rows.sparkSession.createDataFrame(combos, "i int, " + ", ".join(f"{n} double" for n in names) + ", guess_of array<int>")
    wide = cells.agg(F.collect_list(F.struct("cls", "cell", "n")).alias("cells"))  # classes by cells
    every = table.join(F.broadcast(wide), F.lit(True)).select("i", *names, "guess_of", F.explode("cells").alias("x"))
    hits = every.select("i", *names, F.col("x.cls").alias("t"), F.get("guess_of", F.col("x.cell")).alias("g"), F.col("x.n").alias("n"))
    f1 = []
    for c in classes:
        tp, got, real = (F.sum(F.when(w, F.col("n")).otherwise(0)) for w in ((F.col("t") == c) & (F.col("g") == c), F.col("g") == c, F.col("t") == c))
        f1.append(F.coalesce(F.try_divide(2.0 * tp, got + real), F.lit(0.0)))
    return hits.groupBy("i", *names).agg((sum(f1) / len(classes)).alias("macro_f1")).orderBy(F.desc(F.round("macro_f1", 12)), "i").limit(1).select(*names, "macro_f1")


def focal_terms(target: str, guess: str, gamma: float = 2.0) -> tuple[Column, Column]:
    """Gradient and hessian of the focal squared error: w = (1 - exp(-|r|)) ** gamma, -2 w r and 2 w + 1e-6."""
    r = F.col(target) - F.col(guess)
    w = F.pow(1.0 - F.exp(-F.abs(r)), F.lit(gamma))
    return -2.0 * w * r, 2.0 * w + 1e-6
