"""Scoring of rankers and ordinal classifiers, oversampling, model files, mask metrics.

A tree ensemble is a table of nodes held in the plan as arrays (its size is the model's, not the data's); scoring walks
it with higher-order functions. Training is in boost.py.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimfold.sources import storage

NODE = "array<struct<feature:int,threshold:double,left:int,right:int,value:double>>"


def trees_literal(trees: list[list[tuple]]) -> Column:
    """trees: lists of nodes (feature, threshold, left, right, value); a leaf has feature -1."""
    return F.array(*[
        F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("threshold"), F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(float(v)).alias("value")) for f, t, a, b, v in tree])
        for tree in trees
    ])


def tree_score(features: Column, trees: list[list[tuple]], depth: int, shrinkage: float = 1.0) -> Column:
    """Sum over the trees of the leaf reached (left where x <= threshold), times shrinkage. Missing features are 0."""

    def leaf(tree):
        def step(node, _):
            at = F.get(tree, node)
            x = F.coalesce(F.get(features, at["feature"]), F.lit(0.0))
            return F.when(at["feature"] < 0, node).when(x <= at["threshold"], at["left"]).otherwise(at["right"])

        return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))["value"]

    return F.aggregate(F.transform(trees_literal(trees), leaf), F.lit(0.0), lambda s, v: s + v) * shrinkage


def ensemble(scores: list[Column], binary: bool) -> Column:
    mean = sum(scores) / len(scores)
    return 1.0 / (1.0 + F.exp(-mean)) if binary else mean


def feature_vector(values: str, names: list[str]) -> Column:
    """A map of named features in the order of names; what is missing is 0."""
    return F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(F.col(values), n), F.lit(0.0)))


def splits_of(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Where points are halved `depth` times, along the widest feature of each part: (feature, cut) by node, at most the cut goes
    left."""
    out, parts = [], [points]
    for _ in range(depth):
        halves = []
        for part in parts:
            f = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            cut = float(np.median(part[:, f])) if len(part) else 0.0
            out.append((f, cut))
            halves += [part[part[:, f] <= cut], part[part[:, f] > cut]]
        parts = halves
    return out


def nearest(x: np.ndarray, first: np.ndarray, keys: list, y: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For each row of y the `most` nearest rows, ties to the smaller key, of the points x, each of which stands for its keys (in
    order; first: the least): number in y, distance, key, number in x."""
    own = np.array([len(k) for k in keys])
    starts, flat, out = np.cumsum(own) - own, np.concatenate(keys), []
    step = max(1, 4_000_000 // (len(x) * x.shape[1]))
    for a in range(0, len(y), step):
        d = ((y[a : a + step, None, :] - x[None]) ** 2).sum(axis=2)
        if d.shape[1] > most:  # what is no farther than the last of the nearest, ties by the least key
            i, j = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most])
        else:
            i, j = (v.ravel() for v in np.indices(d.shape))
        order = np.lexsort((first[j], d[i, j], i))
        i, j = i[order], j[order]
        use = np.arange(len(i)) - np.searchsorted(i, i) < most
        i, j = i[use], j[use]
        n = own[j]
        at = np.repeat(starts[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i, j, k = np.repeat(i, n), np.repeat(j, n), flat[at]
        order = np.lexsort((k, d[i, j], i))
        i, j, k = i[order], j[order], k[order]
        use = np.arange(len(i)) - np.searchsorted(i, i) < most
        out.append((a + i[use], d[i[use], j[use]], k[use], j[use]))
    return tuple(np.concatenate(c) for c in zip(*out))


def oversample(rows: DataFrame, features: list[str], cls: str, key: str, *, neighbours: int = 5, seed: int = 42, block: int = 2048) -> DataFrame:
    """features, cls, base and other (keys): synthetic rows that bring every class to the size of the largest. Each is a base
    row moved a random share of the way to one of its nearest rows of the class (of min(neighbours, rows - 1); ties to the
    smaller key). Bases are dealt in turn over a seeded order of the class.

    The search is exact, and one for all rows of a point: a point keeps its `neighbours` + 1 least keys, more are never among the
    nearest of any row. The points of a class that lacks rows are halved into blocks of about `block`; a point is first held against
    its own block, then against those blocks whose box is no farther than the last of the nearest found there. Cuts come from a
    bounded number of points (they decide how even blocks are, not what is found). Rows with a feature that is null or not
    finite have no neighbours and are nobody's.
    """
    at = rows.select(cls, key, *[F.col(c).cast("double").alias(c) for c in features], F.xxhash64(key, F.lit(seed)).alias("_h")).withColumn("_b", F.pmod("_h", F.lit(1024)))
    counts = at.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    earlier = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy(cls, "_b").agg(F.count(F.lit(1)).alias("_m")).select(cls, "_b", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(cls, "_b").orderBy("_h", key)) - 1
    lack, few = F.lit(most) - F.col("_n"), F.broadcast(counts.where((F.col("_n") < most) & (F.col("_n") > 1)))  # a row for each class
    placed = at.join(few, cls).withColumn("_nth", nth).join(F.broadcast(before), [cls, "_b"])
    times = F.floor(lack / F.col("_n")) + (F.col("_nth") + F.col("_before") < lack % F.col("_n")).cast("long")
    wanted = placed.select(cls, F.col(key).alias("base"), *features, times.alias("_times")).where("_times > 0")

    finite = reduce(Column.__and__, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in features])
    nth_of_point = F.row_number().over(Window.partitionBy(cls, *features).orderBy(key))
    points = at.join(few, cls).where(finite).withColumn("_k", nth_of_point).where(F.col("_k") <= neighbours + 1)
    points = storage.stored(points.groupBy(cls, *features).agg(F.array_sort(F.collect_list(key)).alias("_keys")))
    near = nearest_of_points(points, features, cls, neighbours + 1, block)
    draw = lambda k: F.pmod(F.xxhash64(F.col("base"), F.col("_j"), F.lit(seed + k)), F.lit(1 << 30))
    others = F.slice(F.filter("_near", lambda o: o["other"] != F.col("base")), 1, neighbours)
    made = wanted.join(near.hint("merge"), [cls, *features]).select(cls, "base", F.array(*features).alias("_x"), others.alias("_near"), F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_j"))
    made = made.where(F.size("_near") > 0).select(cls, "base", "_x", F.get("_near", (draw(1) % F.size("_near")).cast("int")).alias("_o"), (draw(2) / (1 << 30)).alias("_gap"))
    point = [(F.get("_x", i) + F.col("_gap") * (F.get("_o.point", i) - F.get("_x", i))).alias(c) for i, c in enumerate(features)]
    return made.select(*point, cls, "base", F.col("_o.other").alias("other"))


def nearest_of_points(points: DataFrame, features: list[str], cls: str, most: int, block: int, sample: int = 100_000) -> DataFrame:
    """cls, features, and the `most` nearest rows of each point (an array of d, other, point; ties to the smaller key) of its class.
    points: cls, features, _keys."""
    sizes = {r[cls]: r["n"] for r in points.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts, place = {}, F.pmod(F.xxhash64(*features), F.lit(1 << 20))
    for c, n in sizes.items():  # one row a class
        depth = min(12, max(0, math.ceil(math.log2(n / block))))
        drawn = points.where((F.col(cls) == c) & (place < math.ceil((1 << 20) * sample / n))).select(*features).limit(2 * sample) if depth else None
        cuts[c] = (depth, splits_of(drawn.toPandas().to_numpy(float), depth) if depth else [])

    @F.pandas_udf("int")
    def block_of(c: pd.Series, wide: pd.DataFrame) -> pd.Series:
        x, out = wide.to_numpy(float), np.zeros(len(c), "int32")
        for name in c.unique():
            depth, own = cuts[name]
            at = np.flatnonzero(c.to_numpy() == name)
            node = np.zeros(len(at), int)
            for _ in range(depth):
                f, cut = np.array([own[k][0] for k in node], int), np.array([own[k][1] for k in node])
                node = 2 * node + 1 + (x[at, f] > cut)
            out[at] = node
        return pd.Series(out)

    dealt = storage.stored(points.withColumn("_block", block_of(F.col(cls), F.struct(*features))))
    box = lambda f, p: F.struct(*[f(c).alias(c) for c in features]).alias(p)
    boxes = dealt.groupBy(F.col(cls).alias("_cls"), F.col("_block").alias("_other")).agg(box(F.min, "_lo"), box(F.max, "_hi"))
    kind = dict(dealt.dtypes)
    found_type = f"struct<d:double,other:{kind['_keys'][6:-1]},point:array<double>>"

    def search(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame({**{c: pd.Series(dtype=asks[c].dtype) for c in [cls, *features]}, "_near": pd.Series(dtype=object)})
        x, y = (p[features].to_numpy(float) for p in (data, asks))
        keys = [np.asarray(k) for k in data["_keys"]]
        i, d, k, j = nearest(x, np.array([v[0] for v in keys]), keys, y, most)
        each = [{"d": a, "other": b, "point": x[q]} for a, b, q in zip(d.tolist(), k.tolist(), j)]
        ends = np.searchsorted(i, np.arange(len(y) + 1))
        return asks[[cls, *features]].assign(_near=[each[ends[q] : ends[q + 1]] for q in range(len(y))])

    schema = f"{cls} {kind[cls]}, " + ", ".join(f"{c} double" for c in features) + f", _near array<{found_type}>"
    own = dealt.groupBy(cls, "_block").applyInPandas(lambda data: search(data, data).assign(_block=data["_block"]), schema + ", _block int")
    own = storage.stored(own)
    last = F.when(F.size("_near") >= most, F.element_at("_near", most)["d"]).otherwise(float("inf"))
    gap = reduce(Column.__add__, [F.pow(F.greatest(F.col(f"_lo.{c}") - F.col(c), F.col(c) - F.col(f"_hi.{c}"), F.lit(0.0)), F.lit(2.0)) for c in features])
    further = own.join(F.broadcast(boxes), (F.col(cls) == F.col("_cls")) & (F.col("_block") != F.col("_other")) & (gap * (1 - 1e-9) <= last))  # boxes: a row for each block
    asks = further.select(F.col(cls), *features, F.col("_other").alias("_block"))
    more = dealt.groupBy(cls, "_block").cogroup(asks.groupBy(cls, "_block")).applyInPandas(search, schema)
    every = own.drop("_block").unionByName(more).groupBy(cls, *features).agg(F.flatten(F.collect_list("_near")).alias("_near"))
    return every.withColumn("_near", F.slice(F.array_sort("_near"), 1, most))


def read_trees(spark, path: str) -> tuple[list[list[tuple]], int]:
    """The trees of a boosted model's text dump, as tree_score takes them, and their depth. Lines are parsed and put together
    by tree in Spark; what comes to the driver is the model.

    In the text a tree is a line Tree=k and lines name=values: split_feature, threshold, left_child, right_child (a child
    -1 - i is leaf i) and leaf_value; a tree of one leaf has only the last.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\nTree=")).alias("part", "text")).where("part > 0")
    field = lambda n, kind: F.transform(F.filter(F.split(F.regexp_extract("text", rf"\n{n}=([^\n]*)", 1), " "), lambda v: v != ""), lambda v: v.cast(kind))
    trees = lines.select(
        F.regexp_extract("text", r"^(\d+)", 1).cast("int").alias("tree"), field("split_feature", "int").alias("feature"), field("threshold", "double").alias("threshold"),
        field("left_child", "int").alias("left"), field("right_child", "int").alias("right"), field("leaf_value", "double").alias("leaf"),
    )
    out, most = [], 1
    for r in trees.orderBy("tree").collect():
        inner = len(r["feature"])
        place = lambda c, inner=inner: c if c >= 0 else inner - 1 - c
        nodes = [(f, t, place(a), place(b), 0.0) for f, t, a, b in zip(r["feature"], r["threshold"], r["left"], r["right"])] + [(-1, 0.0, 0, 0, v) for v in r["leaf"]]
        depth = {0: 0}
        for i, (f, _, a, b, _) in enumerate(nodes):
            if f >= 0:
                depth[a] = depth[b] = depth.get(i, 0) + 1
        most = max(most, *depth.values())
        out.append(nodes)
    return out, most


def tree_text(trees: list[list[tuple]]) -> str:
    """Trees (inner nodes before leaves) in that text form."""
    parts = ["tree", "version=v3"]
    for k, nodes in enumerate(trees):
        inner = [n for n in nodes if n[0] >= 0]
        order = {i: j for j, i in enumerate([i for i, n in enumerate(nodes) if n[0] >= 0])}
        leaf = {i: j for j, i in enumerate([i for i, n in enumerate(nodes) if n[0] < 0])}
        child = lambda c, order=order, leaf=leaf: order[c] if c in order else -1 - leaf[c]
        rows = {"split_feature": [n[0] for n in inner], "threshold": [n[1] for n in inner], "left_child": [child(n[2]) for n in inner], "right_child": [child(n[3]) for n in inner], "leaf_value": [n[4] for n in nodes if n[0] < 0]}
        parts += [f"Tree={k}", *[f"{n}={' '.join(map(str, v))}" for n, v in rows.items()], ""]
    return "\n".join(parts)


def rim_overlap(pixels: DataFrame, key: str, guess: Column, real: Column) -> DataFrame:
    """Intersection over union of two masks by image, each + 1e-6."""
    both = pixels.groupBy(key).agg(F.count_if(guess & real).alias("i"), F.count_if(guess | real).alias("u"))
    return both.select(key, ((F.col("i") + 1e-6) / (F.col("u") + 1e-6)).alias("iou"))


def mask_metrics(pixels: DataFrame, key: str, p: str, t: str, gamma: float = 2.0) -> DataFrame:
    """Dice and focal loss of a probability plane against a 0/1 mask, by image."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    right = F.when(F.col(t) == 1, q).otherwise(1 - q)
    return pixels.groupBy(key).agg(
        (1 - (2 * F.sum(F.col(p) * F.col(t)) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice"), F.avg(-F.pow(1 - right, F.lit(gamma)) * F.log(right)).alias("focal"),
    )


def probability(logit) -> Column:
    """The sigmoid of a logit held within 20."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(logit)))))


def focal_loss(logit: str, t: str, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    """Mean over the pixels of alpha (1 - e^-c)^gamma c; c: the cross entropy of logit and 0/1 target."""
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(logit)))
    c = F.greatest(z, F.lit(0.0)) - z * F.col(t) + F.log1p(F.exp(-F.abs(z)))
    return F.avg(alpha * F.pow(1 - F.exp(-c), F.lit(gamma)) * c)


def dice_loss(logit: str, t: str, smooth: float = 1.0) -> Column:
    p = probability(logit)
    return 1 - (2 * F.sum(p * F.col(t)) + smooth) / (F.sum(p) + F.sum(t) + smooth)


def boundary_loss(logit: str, distance: str, mask: Column | None = None) -> Column:
    """Mean of probability times distance to the boundary (either sign), over all pixels or those of a mask."""
    far = probability(logit) * F.abs(distance)
    return F.avg(far) if mask is None else F.sum(F.when(mask, far).otherwise(0.0)) / (F.count_if(mask) + 1e-6)


def centreline_loss(p: str, t: str, p_skeleton: str, t_skeleton: str) -> Column:
    """1 - the harmonic mean of two shares: of the guess's skeleton inside the target, of the target's inside the guess."""
    share = lambda s, m: F.sum(F.col(s) * F.col(m)) / (F.sum(s) + 1e-6)
    a, b = share(p_skeleton, t), share(t_skeleton, p)
    return 1 - 2 * a * b / (a + b + 1e-6)


def weighted_losses(
    pixels: DataFrame, key: str, channels: list[tuple[str, str]], distance: str | None = None, *, s: list[float] | None = None, clamp: tuple[float, float] = (-5.0, 10.0)
) -> DataFrame:
    """key, loss_<logit> for each channel (logit, target), boundary and total: each channel's loss is 0.75 focal + 0.25 dice,
    weighed by its uncertainty s = log(sigma^2), held within clamp, as loss / (2 e^s) + s / 2. With distance the last channel is a rim
    of 0.7 focal + 0.3 dice, and 0.3 times its boundary loss inside its target is added."""
    total, out = F.lit(0.0), []
    for i, (logit, t) in enumerate(channels):
        share = 0.7 if distance is not None and i == len(channels) - 1 else 0.75
        out.append((share * focal_loss(logit, t) + (1 - share) * dice_loss(logit, t)).alias(f"loss_{logit}"))
        held = min(max(s[i] if s else 0.0, clamp[0]), clamp[1])
        total = total + F.col(f"loss_{logit}") * (0.5 * math.exp(-held)) + held / 2
    if distance is not None:
        logit, t = channels[-1]
        out.append(boundary_loss(logit, distance, F.col(t) > 0.5).alias("boundary"))
        total = total + 0.3 * F.col("boundary")
    return pixels.groupBy(key).agg(*out).withColumn("total", total)


def keep_ranked(rows: DataFrame, features: list[str], trees: list[list[tuple]], depth: int, *, threshold: float, points: str = "n", conf: str = "confidence", least: int = 5) -> DataFrame:
    """rows with rank_score >= threshold: the ensemble's probability, or the confidence where a candidate has too few rim points."""
    score = ensemble([tree_score(F.array(*map(F.col, features)), trees, depth)], True)
    return rows.withColumn("rank_score", F.when(F.col(points) < least, F.col(conf)).otherwise(score)).where(F.col("rank_score") >= threshold)


def classified(rows: DataFrame, features: list[str], trees: list[list[tuple]], depth: int, *, points: str = "n", least: int = 5, default: int = 2) -> DataFrame:
    """rows with cls: the ordinal ensemble's class, or the default with too few rim points."""
    from rimfold.operators.stats import ordinal_class

    value = ensemble([tree_score(F.array(*map(F.col, features)), trees, depth)], False)
    return rows.withColumn("cls", F.when(F.col(points) < least, default).otherwise(ordinal_class(value)))
