"""Histogram gradient boosting of many models at once, as Spark jobs.

Features are cut into bins once. Rows of equal bins, targets, fold, weight and class take the same way through every tree, so they
are grouped into one row with its count `n` before anything grows (not where a model draws rows, which goes by key). All models
(folds, trials, classes) grow together, a level of their trees at a time: a row carries its prediction by model, a level's job gives
gradient and hessian sums by model, node, feature and bin (NumPy over Arrow batches, then one grouping, whatever the number of
models), windows turn them into the gain of every split, and the best split of each node is a row of the model. The trees so
far travel with the tasks: their size is the models', not the data's. What comes to the driver is the best split of each node and
the confusion counts of each model.

Losses: squared; focal (squared, weighted by (1 - exp(-|r|)) ** gamma, that weight held fixed in the gradient); logistic. Each
row's weight multiplies both terms. A node's value is -T(G) / (H + l2), with T(G) = G drawn towards 0 by l1; the gain of a split is
what T(G)^2 / (H + l2) of both sides has over that of the node. Splits are ordered by gain (to 6 decimals), then by feature and
bin. A tree grows by level up to `depth`; in each level the best splits go first until it has `leaves` leaves.

Defined cases: null features are 0; rows whose target is null take no part; a node without a split of positive gain that leaves
`least` rows on both sides is a leaf; without training rows the base is 0 and no tree grows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.operators import stats
from rimfold.sources import storage

LOSSES = ("squared", "focal", "logistic")
#: The models as one row travel in this column.
MODELS = (
    "models array<struct<model:int,least:int,l1:double,l2:double,features:array<int>>>"
)


@dataclass(frozen=True)
class Spec:
    """One model: the fold it is validated on (-1: none), which target it learns, and its settings. rows and features are the
    shares drawn for each tree (rows anew every five trees)."""

    fold: int = -1
    target: int = 0
    rate: float = 0.1
    leaves: int = 31
    least: int = 20
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    features: float = 1.0
    seed: int = 42


@dataclass
class Boosted:
    """Models as rows. splits: (model, tree, node, feature, threshold, gain, n, value) of every node, a leaf's feature being -1; node 1 is
    a root, 2k and 2k + 1 are below node k. history: (model, tree, macro_f1, accuracy, mae) on the models' folds."""

    features: list[str]
    specs: list[Spec]
    base: list[float]
    depth: int
    splits: list[tuple] = field(default_factory=list)
    history: list[tuple] = field(default_factory=list)
    best: dict[int, int] = field(default_factory=dict)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.splits, "model int, tree int, node int, feature int, threshold double, gain double, n long, value double")

    def validation(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "model int, tree int, macro_f1 double, accuracy double, mae double")

    def trees(self, model: int) -> list[dict[int, tuple]]:
        """By tree: node -> (feature, threshold, value), up to the best tree."""
        out: dict[int, dict[int, tuple]] = {}
        for m, tree, node, feature, threshold, _, _, value in self.splits:
            if m == model and tree <= self.best.get(model, tree):
                out.setdefault(tree, {})[node] = (feature, threshold, value)
        return [out[k] for k in sorted(out)]

    def scores(self, rows: DataFrame, name: str = "scores") -> DataFrame:
        """rows with an array of the models' raw scores; batches of rows walk the trees."""
        models = [(self.base[m], s.rate, [Tree.of(tree, self.depth) for tree in self.trees(m)]) for m, s in enumerate(self.specs)]
        depth = self.depth

        @F.pandas_udf("struct<" + ",".join(f"m{m}:double" for m in range(len(models))) + ">")
        def total(wide: pd.DataFrame) -> pd.DataFrame:
            x = wide.to_numpy(float)
            return pd.DataFrame({f"m{m}": base + rate * sum((t.value[t.reached(x, depth)] for t in trees), np.zeros(len(x))) for m, (base, rate, trees) in enumerate(models)})

        walked = rows.withColumn("_m", total(F.struct(*[feature_value(c).alias(f"f{i}") for i, c in enumerate(self.features)])))
        return walked.withColumn(name, F.array(*[F.col("_m")[f"m{m}"] for m in range(len(models))])).drop("_m")


@dataclass
class Tree:
    """A tree as arrays by node: feature (-1: a leaf, or no node), the cut (a bin or a threshold) that goes left, value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, nodes: dict[int, tuple], depth: int) -> Tree:
        size = 1 << (depth + 1)
        own = cls(np.full(size, -1), np.zeros(size), np.zeros(size))
        for k, (feature, cut, value) in nodes.items():
            own.feature[k], own.cut[k], own.value[k] = feature, cut or 0, value or 0
        return own

    def reached(self, x: np.ndarray, steps: int) -> np.ndarray:
        """The node that each row of x reaches; NaN goes right."""
        at, row = np.ones(len(x), int), np.arange(len(x))
        for _ in range(steps):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + ~(x[row, f] <= self.cut[at]))
        return at


def feature_value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def edges_of(rows: DataFrame, features: list[str], bins: int = 255) -> list[list[float]]:
    """Cut points of each feature: its values at equal shares of the rows; up to bins - 1 of them."""
    shares = [k / bins for k in range(1, bins)]
    wide = rows.agg(*[F.percentile_approx(feature_value(c), shares, 20 * bins).alias(c) for c in features]).first()
    return [sorted(set(wide[c] or [])) for c in features]


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """f0, f1, ...: the number of cut points below each feature; the feature is at most edge b where that is at most b."""

    @F.pandas_udf("struct<" + ",".join(f"f{i}:int" for i in range(len(features))) + ">")
    def places(wide: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: np.searchsorted(np.asarray(own, float), wide[c].to_numpy(float)).astype("int32") for c, own in zip(wide, edges)})

    return places(F.struct(*[feature_value(c).alias(f"f{i}") for i, c in enumerate(features)]))


def terms(loss: str, gamma: float, y: np.ndarray, guess: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian."""
    if loss == "logistic":
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-guess))
        return weight * (p - y), weight * p * (1.0 - p)
    r = y - guess
    if loss == "squared":
        return -2.0 * weight * r, 2.0 * weight
    w = weight * (1.0 - np.exp(-np.abs(r))) ** gamma
    return -2.0 * w * r, 2.0 * w + 1e-6


def drawn(share: Column, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < share * (1 << 20)


def soft(g: Column, l1: Column) -> Column:
    return F.signum(g) * F.greatest(F.lit(0.0), F.abs(g) - l1)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length, a row each; null elements of doubles become NaN."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def models_row(spark: SparkSession, out: Boosted, tree: int) -> DataFrame:
    """All models as one row; the features that a tree may use are those of the least digests."""
    from hashlib import md5

    rows, n = [], len(out.features)
    for m, s in enumerate(out.specs):
        own = sorted(range(n), key=lambda f: md5(f"{s.seed}:{tree}:{f}".encode()).digest())[: max(1, round(s.features * n))]  # noqa: B023
        rows.append((m, s.least, s.l1, s.l2, own))
    return spark.createDataFrame([(rows,)], MODELS)


def cell_sums(state: DataFrame, specs: list[Spec], trees: list[dict[int, tuple]], live: list[bool], bins: list[int], level: int, tree: int, depth: int, loss: str, gamma: float) -> DataFrame:
    """model, node, feature, bin and the sums g, h, n of the rows of the nodes of a level. A batch of rows gives a row for each
    cell that it meets."""
    draws = any(s.rows < 1 for s in specs)
    walk = [Tree.of(t, depth) for t in trees]
    if draws:
        state = state.withColumn("use", F.array(*[drawn(F.lit(s.rows), F.col("key"), F.lit(s.seed), F.lit(tree // 5)) for s in specs]))

    def cells(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, pred = matrix(b, "x"), matrix(b, "y"), matrix(b, "pred")
            known = ~b.column("y").flatten().is_null().to_numpy(zero_copy_only=False).reshape(y.shape)
            n, w = b.column("n").to_numpy(), b.column("weight").to_numpy(zero_copy_only=False)
            unweighed = b.column("weight").is_null().to_numpy(zero_copy_only=False)
            fold = b.column("fold").fill_null(0).to_numpy()
            no_fold = b.column("fold").is_null().to_numpy(zero_copy_only=False)
            took, out = matrix(b, "use") if draws else None, []
            for m, s in enumerate(specs):
                use = known[:, s.target].copy()
                if s.fold >= 0:
                    use &= (fold != s.fold) & ~no_fold
                if draws:
                    use &= took[:, m].astype(bool)
                at = np.flatnonzero(use) if live[m] else []
                if not len(at):
                    continue
                node = walk[m].reached(x[at], level)
                deep = node >= 1 << level
                at, node = at[deep], node[deep]
                g, h = terms(loss, gamma, y[at, s.target], pred[at, m], w[at])
                g, h = (np.where(unweighed[at], 0.0, v) * n[at] for v in (g, h))
                names, k = np.unique(node, return_inverse=True)
                for f, wide in enumerate(bins):
                    cell, size = k * wide + x[at, f], len(names) * wide
                    count = np.bincount(cell, n[at], size)
                    hit = np.flatnonzero(count)
                    same = np.full(len(hit), m), names[hit // wide], np.full(len(hit), f), hit % wide
                    out.append((*same, np.bincount(cell, g, size)[hit], np.bincount(cell, h, size)[hit], count[hit]))
            if out:
                kinds = ("int32", "int32", "int32", "int32", "float64", "float64", "int64")
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), kinds)], names=["model", "node", "feature", "bin", "g", "h", "n"])

    parts = state.mapInArrow(cells, "model int, node int, feature int, bin int, g double, h double, n long")
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(sums: DataFrame, models: DataFrame) -> DataFrame:
    """model, node, its sums g, h, n, and its best split (gain null if there is none)."""
    whole = Window.partitionBy("model", "node", "feature")
    left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.select("model", "node", "feature", "bin", *[F.sum(c).over(left).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    m = cut.crossJoin(F.broadcast(models)).withColumn("m", F.get("models", F.col("model"))).drop("models")
    score = lambda g, h: soft(g, F.col("m.l1")) ** 2 / (h + F.col("m.l2"))
    gain = score(F.col("lg"), F.col("lh")) + score(F.col("g") - F.col("lg"), F.col("h") - F.col("lh")) - score(F.col("g"), F.col("h"))
    fine = (F.col("ln") >= F.col("m.least")) & (F.col("n") - F.col("ln") >= F.col("m.least")) & (F.round(gain, 6) > 0) & F.array_contains("m.features", F.col("feature"))
    split = F.when(fine, F.struct(F.round(gain, 6).alias("gain"), (-F.col("feature")).alias("minus_feature"), (-F.col("bin")).alias("minus_bin"), "lg", "lh", "ln"))
    return m.groupBy("model", "node").agg(
        F.max(split).alias("s"), F.max_by(F.struct("g", "h", "n"), -F.col("feature")).alias("t"),
    ).select("model", "node", "t.*", "s.gain", (-F.col("s.minus_feature")).alias("feature"), (-F.col("s.minus_bin")).alias("bin"), "s.lg", "s.lh", "s.ln")


def boost(
    rows: DataFrame, features: list[str], targets: list[str], specs: list[Spec], *, key: str, fold: str | None = None, weight: str | None = None, cls: str | None = None, loss: str = "focal",
    gamma: float = 2.0, rounds: int = 20, depth: int = 4, bins: int = 255, edges: list[list[float]] | None = None, patience: int | None = None, from_mean: bool = True,
) -> Boosted:
    """The fitted models. cls: the class that stats.ordinal_class of a score is held against on a model's fold; with patience, a
    model stops when its macro F1 has not risen for so many trees, and keeps those up to its best."""
    spark = rows.sparkSession
    edges = edges or edges_of(rows, features, bins)
    one = lambda c, other: F.col(c) if c else F.lit(other)
    draws = any(s.rows < 1 for s in specs)
    xs, ys = [f"f{i}" for i in range(len(features))], [f"y{i}" for i in range(len(targets))]
    state = rows.select(
        *([F.xxhash64(key).alias("key")] if draws else []), binned(features, edges).alias("x"), *[F.col(t).cast("double").alias(y) for t, y in zip(targets, ys)],
        one(fold, -2).cast("int").alias("fold"), one(weight, 1.0).cast("double").alias("weight"), one(cls, None).cast("int").alias("cls"),
    ).select("x.*", "*").drop("x")
    state = state.withColumn("n", F.lit(1).cast("long")) if draws else state.groupBy(*state.columns).agg(F.count(F.lit(1)).alias("n"))
    state = storage.stored(state.withColumns({"x": F.array(*xs), "y": F.array(*ys)}).drop(*xs, *ys))
    all_of = F.col("weight") * F.col("n")
    sums = state.groupBy("fold").agg(*[f(t) for t in range(len(targets)) for f in (lambda t: F.sum(F.get("y", t) * all_of).alias(f"s{t}"), lambda t: F.sum(F.when(F.get("y", t).isNotNull(), all_of)).alias(f"w{t}"))]).collect()
    base = []
    for s in specs:
        own = [r for r in sums if s.fold < 0 or r["fold"] != s.fold]
        total = sum(r[f"w{s.target}"] or 0.0 for r in own)
        base.append(sum(r[f"s{s.target}"] or 0.0 for r in own) / total if from_mean and loss != "logistic" and total else 0.0)
    out = Boosted(features, specs, base, depth)
    live, top, state = [True] * len(specs), [(-1.0, 0)] * len(specs), state.withColumn("pred", F.array(*map(F.lit, base)).cast("array<double>"))
    for tree in range(1, rounds + 1):
        state = storage.stored(moved(state, specs, grow(state, out, edges, live, tree, loss, gamma), live, depth))
        if cls and any(s.fold >= 0 for s in specs):
            for m, f1, accuracy, mae in validated(state, specs):
                if live[m]:
                    out.history.append((m, tree, f1, accuracy, mae))
                    if f1 > top[m][0] + 1e-12:
                        top[m] = (f1, tree)
                    if patience is not None and tree - top[m][1] >= patience:
                        live[m] = False
        if not any(live):
            break
    if patience is not None:
        out.best = {m: t for m, (f, t) in enumerate(top) if f >= 0}
    return out


def grow(state: DataFrame, out: Boosted, edges: list[list[float]], live: list[bool], tree: int, loss: str, gamma: float) -> list[dict[int, tuple]]:
    """One tree of every live model: node -> (feature, bin, value); also noted in out."""
    specs, trees = out.specs, [{} for _ in out.specs]
    notes: dict[tuple, list] = {}
    value = lambda m, g, h: (-1.0 if g > 0 else 1.0) * max(0.0, abs(g) - specs[m].l1) / (h + specs[m].l2) if h + specs[m].l2 > 0 else 0.0
    for level in range(out.depth):
        sums = cell_sums(state, specs, trees, live, [len(e) + 1 for e in edges], level, tree, out.depth, loss, gamma)
        found = best_splits(sums, models_row(state.sparkSession, out, tree)).collect()
        if level == 0:
            for r in found:
                trees[r["model"]][1] = (-1, 0, value(r["model"], r["g"], r["h"]))
                notes[r["model"], 1] = [-1, None, None, r["n"], trees[r["model"]][1][2]]
        splits = sorted((r for r in found if r["gain"] is not None), key=lambda r: (r["model"], -r["gain"], r["node"]))
        for r in splits:
            m, k = r["model"], r["node"]
            if sum(f < 0 for f, _, _ in trees[m].values()) >= specs[m].leaves:
                continue
            sides = [(r["lg"], r["lh"], r["ln"]), (r["g"] - r["lg"], r["h"] - r["lh"], r["n"] - r["ln"])]
            trees[m][k] = (r["feature"], r["bin"], 0.0)
            notes[m, k] = [r["feature"], edges[r["feature"]][r["bin"]], r["gain"], r["n"], None]
            for side, (g, h, n) in zip((2 * k, 2 * k + 1), sides):
                trees[m][side] = (-1, 0, value(m, g, h))
                notes[m, side] = [-1, None, None, n, trees[m][side][2]]
        if not splits:
            break
    out.splits += [(m, tree, k, *own) for (m, k), own in sorted(notes.items())]
    return trees


def moved(state: DataFrame, specs: list[Spec], trees: list[dict[int, tuple]], live: list[bool], depth: int) -> DataFrame:
    """The state with the trees' leaves added to its predictions."""
    walk = [Tree.of(t, depth) for t in trees]

    def step(batches):
        for b in batches:
            x, pred = matrix(b, "x"), matrix(b, "pred").copy()
            for m, s in enumerate(specs):
                if live[m]:
                    pred[:, m] += s.rate * walk[m].value[walk[m].reached(x, depth)]
            ends = pa.array(np.arange(b.num_rows + 1) * len(specs), pa.int32())
            yield b.set_column(b.schema.get_field_index("pred"), "pred", pa.ListArray.from_arrays(ends, pa.array(pred.ravel())))

    return state.mapInArrow(step, state.schema)


def validated(state: DataFrame, specs: list[Spec]) -> list[tuple]:
    """model, macro F1, accuracy, mean absolute error of the target, of each model with a fold, on that fold."""
    told = [(m, s.fold, s.target) for m, s in enumerate(specs) if s.fold >= 0]
    own = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("fold"), F.lit(t).alias("target")) for m, f, t in told])
    each = state.where(F.col("cls").isNotNull()).select("cls", "n", "y", "pred", F.explode(F.filter(own, lambda m: m["fold"] == F.col("fold"))).alias("m"))
    guess = F.get("pred", F.col("m.model"))
    cells = each.groupBy("m.model", "cls", stats.ordinal_class(guess).alias("guess")).agg(F.sum("n").alias("n"), F.sum(F.abs(F.get("y", F.col("m.target")) - guess) * F.col("n")).alias("off"))
    by: dict[int, list] = {}
    for r in cells.collect():
        by.setdefault(r["model"], []).append(r)
    out = []
    for m, rows in sorted(by.items()):
        total, f1 = sum(r["n"] for r in rows), []
        for c in range(len(stats.CUTS) + 1):
            hit, got, real = (sum(r["n"] for r in rows if ok(r)) for ok in (lambda r: r["cls"] == c == r["guess"], lambda r: r["guess"] == c, lambda r: r["cls"] == c))  # noqa: B023
            f1.append(2 * hit / (got + real) if got + real else 0.0)
        out.append((m, sum(f1) / len(f1), sum(r["n"] for r in rows if r["cls"] == r["guess"]) / total, sum(r["off"] or 0.0 for r in rows) / total))
    return out


def trial_specs(grid: dict[str, list], trials: int, *, seed: int = 42, **fixed) -> list[Spec]:
    """Settings drawn from the grid: each value by a digest of trial, name and seed, so that draws are the same everywhere."""
    import hashlib

    pick = lambda t, name, values: values[int(hashlib.md5(f"{t}:{name}:{seed}".encode()).hexdigest(), 16) % len(values)]
    return [Spec(**fixed, **{name: pick(t, name, values) for name, values in grid.items()}) for t in range(trials)]
