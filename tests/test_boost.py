"""Boosted models: what SQL does not grow (draws, early stops, learnt cut points), and the walk of the models."""

import math
import random

from pyspark.sql import functions as F

from rimfold.operators import boost
from rimfold.operators.boost import Spec


def table(spark, n=600):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        u, v = rng.random(), rng.choice([None, 0.0, 1.0, 2.0])
        cls = min(4, int(3 * u + (v or 0)))
        rows.append((k, u, v, cls, float([0, 0.6, 1.5, 2.7, 4][cls]) if k % 50 else None, k % 5))
    return spark.createDataFrame(rows, "key long, u double, v double, cls int, target double, fold int")


def test_models_learn_stop_and_score_alike(spark):
    rows = table(spark)
    specs = [Spec(fold=f, rate=0.5, leaves=6, least=5, rows=0.8, features=0.5, seed=f) for f in range(2)] + [Spec(rate=0.5, leaves=3, least=5)]
    model = boost.boost(rows, ["u", "v"], ["target"], specs, key="key", fold="fold", cls="cls", rounds=6, depth=3, bins=16, patience=2)
    shown = {(m, t): f1 for m, t, f1, _, _ in model.history}
    assert {m for m, _ in shown} == {0, 1} and max(shown.values()) > 0.5
    for m in (0, 1):  # stopped two trees after the best one, or at the end
        last = max(t for k, t in shown if k == m)
        assert last in (6, model.best[m] + 2) and shown[m, model.best[m]] == max(f for (k, _), f in shown.items() if k == m)
        assert len(model.trees(m)) == model.best[m]
    nodes = model.nodes(spark)
    assert nodes.where("model = 2").groupBy("tree").agg(F.count_if(F.col("feature") < 0).alias("n")).agg(F.max("n")).first()[0] <= 3
    assert {r["feature"] for r in nodes.where("model = 0 and tree = 1 and feature >= 0").collect()} <= {0} or {r["feature"] for r in nodes.where("model = 0 and tree = 1 and feature >= 0").collect()} <= {1}
    for r in model.scores(rows).limit(40).collect():  # the plan's walk against a plain one
        for m in range(3):
            total = model.base[m]
            for tree in model.trees(m):
                k = 1
                while tree[k][0] >= 0:
                    k = 2 * k + ((r["u"], r["v"] or 0.0)[tree[k][0]] > tree[k][1])
                total += specs[m].rate * tree[k][2]
            assert math.isclose(total, r["scores"][m], abs_tol=1e-9)


def test_no_rows_and_equal_rows(spark):
    rows = table(spark)
    empty = boost.boost(rows.limit(0), ["u"], ["target"], [Spec()], key="key", edges=[[0.5]], rounds=2, depth=2)
    assert empty.base == [0.0] and not empty.splits
    same = boost.boost(rows.withColumn("u", F.lit(1.0)), ["u"], ["target"], [Spec(least=1)], key="key", rounds=1, depth=2)
    assert [s[3] for s in same.splits] == [-1]  # nothing to split on


def test_squared_loss_reaches_the_means(spark):
    rows = spark.createDataFrame([(k, float(k % 2), 10.0 * (k % 2)) for k in range(60)], "key long, u double, y double")
    model = boost.boost(rows, ["u"], ["y"], [Spec(rate=1.0, least=1)], key="key", loss="squared", rounds=1, depth=1)
    assert {(r["u"], round(r["scores"][0], 9)) for r in model.scores(rows).collect()} == {(0.0, 0.0), (1.0, 10.0)}


def test_equal_rows_are_one(spark, monkeypatch):
    """What is kept between levels and trees grows with the different rows, not with their copies; counts weigh as copies do."""
    kept, stored = [], boost.storage.stored
    monkeypatch.setattr(boost.storage, "stored", lambda rows: (kept.append(out := stored(rows)), out)[1])
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 4).cast("double").alias("u"), (F.col("id") % 8).cast("double").alias("y"), (F.col("id") % 2).alias("fold"), F.lit(1).alias("cls"))
    found = []
    for table in (rows, rows.where("key < 40")):
        model = boost.boost(table, ["u"], ["y"], [Spec(rate=1.0, least=1), Spec(rate=0.5, least=1, fold=1)], key="key", fold="fold", cls="cls", loss="squared", rounds=2, depth=2, edges=[[0.0, 1.0, 2.0]])
        found.append([(m, t, k, f, e, None if v is None else round(v, 9)) for m, t, k, f, e, _, _, v in model.splits])
    assert found[0] == found[1] and all(k.count() == 8 for k in kept)
    drawn = len(kept)
    boost.boost(rows, ["u"], ["y"], [Spec(rows=0.5, least=1)], key="key", loss="squared", rounds=1, depth=1)
    assert all(k.count() == 400 for k in kept[drawn:])
