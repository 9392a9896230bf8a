"""Operators whose results SQL only checks in part, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimfold.operators import models, raster, segment
from rimfold.sources import ellipses, images


def test_oversampling_is_exact(spark):
    """Each synthetic row lies between a base and one of its true nearest rows of the class, in a class of many blocks."""
    rng = np.random.default_rng(1)
    rows = [(i, 0, *map(float, rng.random(2))) for i in range(900)] + [(i, 1, *map(float, rng.random(2))) for i in range(2000, 2700)] + [(5000, 2, 0.5, 0.5), (5001, 3, 0.1, 0.1), (5002, 3, 0.1, 0.1)]
    table = spark.createDataFrame(rows, "key long, cls int, u double, v double")
    got = models.oversample(table, ["u", "v"], "cls", "key", block=64).collect()
    at = {r[0]: r for r in rows}
    made = {}
    for r in got:
        made.setdefault(r["cls"], []).append(r)
        base, other = np.array(at[r["base"]][2:]), np.array(at[r["other"]][2:])
        own = sorted(((at[k][2] - base[0]) ** 2 + (at[k][3] - base[1]) ** 2, k) for k in at if at[k][1] == r["cls"] and k != r["base"])[:5]
        assert r["other"] in [k for _, k in own]
        gap = (np.array([r["u"], r["v"]]) - base) @ (other - base) / max(((other - base) ** 2).sum(), 1e-300)
        assert -1e-9 <= gap <= 1 + 1e-9 and np.allclose(base + gap * (other - base), [r["u"], r["v"]])
    assert {c: len(x) for c, x in made.items()} == {1: 200, 3: 898}  # a class of one has no neighbour
    assert len({r["base"] for r in made[1]}) == 200
    assert models.oversample(table.limit(0), ["u", "v"], "cls", "key").count() == 0


def test_oversampling_searches_points_not_rows(spark, monkeypatch):
    """Copies of a point are searched once, and their neighbours are those of the smallest keys; a null feature has none."""
    kept, stored = [], models.storage.stored
    monkeypatch.setattr(models.storage, "stored", lambda rows: (kept.append(out := stored(rows)), out)[1])
    rows = [(i, 0, 0.0, 0.0) for i in range(1500)] + [(i, 1, float(i % 12), float(i % 9)) for i in range(2000, 2720)] + [(9000, 1, None, 1.0)]
    got = models.oversample(spark.createDataFrame(rows, "key long, cls int, u double, v double"), ["u", "v"], "cls", "key", block=8).collect()
    assert {k.count() for k in kept} == {36}
    at = {r[0]: r[2:] for r in rows if 2000 <= r[0] < 9000}
    for r in got:
        (u, v), near = at[r["base"]], sorted((a - at[r["base"]][0]) ** 2 + (b - at[r["base"]][1]) ** 2 for k, (a, b) in at.items() if k != r["base"])[4]
        own = sorted(((a - u) ** 2 + (b - v) ** 2, k) for k, (a, b) in at.items() if k != r["base"])[:5]
        assert r["other"] in [k for _, k in own] and near == 0
    assert 0 < len(got) <= 1500 - 721


@pytest.mark.parametrize("method", ["direct", "taubin", "geometric"])
def test_fits_of_noisy_points(method):
    rng = np.random.default_rng(4)
    t = rng.random(200) * 2 * np.pi
    c, s = math.cos(0.5), math.sin(0.5)
    u, v = 40 * np.cos(t), 25 * np.sin(t)
    points = np.stack([100 + c * u - s * v, 80 + s * u + c * v], 1) + rng.normal(0, 0.3, (200, 2))
    cx, cy, a, b, rot = segment.FITS[method](points)
    assert (cx, cy, a, b) == pytest.approx((100, 80, 40, 25), abs=0.5) and rot == pytest.approx(math.degrees(0.5), abs=1)
    line = np.stack([np.arange(20.0), np.arange(20.0)], 1)
    assert segment.FITS[method](points[:4]) is None and (segment.FITS[method](line) is None or all(map(math.isfinite, segment.FITS[method](line))))


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(40):
        h, w = rng.integers(1, 12, 2)
        mask = rng.random((h, w)) < rng.choice([0.3, 0.8, 1.0])
        out = np.argwhere(~mask)
        want = [[min((math.dist((y, x), o) for o in out), default=h + w) for x in range(w)] for y in range(h)]
        assert np.allclose(segment.distance(mask), want)


def test_whole_images(spark):
    """Planes of a real image's size pass through the NumPy operators."""
    rng = np.random.default_rng(3)
    p = rng.random((600, 800))
    rows = spark.createDataFrame([(0, p.ravel().tolist()), (1, None)], "k long, plane array<double>")
    height, gradient = raster.height_and_gradient("plane", 600, 800)
    got = rows.select("k", raster.gradient_map("plane", 600, 800).alias("g"), height.alias("z"), gradient.alias("zg"), raster.resize_linear("plane", 600, 800, 300, 400).alias("r"), raster.extreme("plane", 600, 800, True, 2).alias("m")).orderBy("k").collect()
    assert got[1]["g"] is None and len(got[0]["r"]) == 300 * 400
    gx, gy = (x[0] for x in raster.sobel(p[None]))
    m = np.hypot(gx, gy)
    assert np.allclose(got[0]["g"], (m / (m.max() + 1e-6)).ravel()) and np.allclose(got[0]["zg"], got[0]["g"])
    assert np.allclose(got[0]["z"], segment.height_from_gradient(p).ravel())
    y, x = 50, 70
    assert np.array(got[0]["m"]).reshape(600, 800)[y, x] == p[y - 2 : y + 3, x - 2 : x + 3].max()
    assert gx[y, x] == pytest.approx((p[y - 1 : y + 2, x - 1 : x + 2] * [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]).sum())


def test_settings_and_model_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("FIXED: 1\nLIMIT: 5  # few\nrim_thresh: 0.5\n")
    got = images.Settings.read(spark, str(tmp_path / "s.yaml"), ["--limit=7", "--odd"])
    assert (got.limit, got.rim_thresh, got.scale_steps) == (7, 0.5, 40)
    trees = [[(0, 0.5, 1, 2, 0), (1, 2.0, 3, 4, 0), (-1, 0, 0, 0, 0.3), (-1, 0, 0, 0, -0.4), (-1, 0, 0, 0, 0.1)], [(-1, 0, 0, 0, 0.25)]]
    (tmp_path / "m.txt").write_text(models.tree_text(trees))
    read, depth = models.read_trees(spark, str(tmp_path / "m.txt"))
    rows = spark.createDataFrame([(0.1, 1.0), (0.5, 3.0), (0.6, 0.0)], "u double, v double")
    scores = [models.tree_score(F.array("u", "v"), t, depth) for t in (trees, read)]
    assert depth == 2 and all(r[0] == pytest.approx(r[1]) for r in rows.select(*scores).collect())


def test_positional_files_keep_large_ellipses_of_validation(spark, tmp_path):
    head = "x,y,major,minor,angle,file"
    group = "altitude01/longitude10/orientation01_light01"
    (tmp_path / "t.csv").write_text("\n".join([head, f"1,2,9,8,0,{group}", f"1,2,9,4.9,0,{group}", "1,2,9,8,0,altitude01/longitude11/o"]) + "\n")
    assert [(r["a"], r["b"]) for r in ellipses.read_positional(spark, str(tmp_path / "t.csv")).collect()] == [(9.0, 8.0)]


def test_every_feature_of_the_full_vector_is_measured(spark):
    """44 distinct names, the classifier's among them, none constant but the closed forms; without a table of stability its defaults."""
    from rimfold.operators import features
    from rimfold.plans import rasters

    points, pixels = rasters.candidate_planes(spark, "/root/testdata/sf0.001")
    full = lambda s: features.full_vector(points, pixels, "vec_id", 8, 8, F.avg("v") * 255, region="region", stability=s, least=4)
    assert len(set(features.FULL)) == 44 and set(features.CLASSIFIER) < set(features.FULL)
    rows = full(segment.stability(points, ["vec_id"])).toPandas()
    assert len(rows) == 500 and not rows.isna().any().any()
    constant = {n for n in features.FULL if rows[n].nunique() == 1}
    assert constant <= {"morph_solidity", "morph_convexity", "morph_extent"}, constant
    still = full(None).select(*features.STABILITY).distinct().collect()
    assert [tuple(r) for r in still] == [(0.0, 0.0, 0.0, 0.0, 1.0)]
