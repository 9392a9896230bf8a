"""Operators on literal rows: empty sides, sentinels, ties, missing values."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimfold.functions import geometry as G
from rimfold.operators import features, match, models, raster, score, segment, select, stats
from rimfold.sources import ellipses, images

ELLIPSE = "image_no long, seq long, cx double, cy double, a double, b double, rot double"


def table(spark, rows, schema=ELLIPSE):
    return spark.createDataFrame(rows, schema)


def test_identical_ellipses_score_one(spark):
    t = table(spark, [(1, k, 100.0 * k, 50.0, 20.0, 15.0, 30.0) for k in range(10)])
    r = score.image_scores(t, t).first()
    assert (r["n_match"], r["score"]) == (10, pytest.approx(1.0, abs=1e-6))


def test_fewer_than_ten_matches_scale_by_truths(spark):
    t = table(spark, [(1, k, 100.0 * k, 50.0, 20.0, 15.0, 30.0) for k in range(4)])
    assert score.image_scores(t, t.where("seq < 2")).first()["score"] == pytest.approx(0.5, abs=1e-6)


def test_sentinels_and_missing_images(spark):
    empty = (-1.0,) * 5
    t = table(spark, [(1, 0, *empty), (2, 0, *empty), (3, 0, 5.0, 5.0, 9.0, 9.0, 0.0), (4, 0, 5.0, 5.0, 9.0, 9.0, 0.0)])
    p = table(spark, [(1, 0, *empty), (2, 0, 5.0, 5.0, 9.0, 9.0, 0.0), (3, 0, *empty)])
    got = {r["image_no"]: r["score"] for r in score.image_scores(t, p).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert score.dataset_score(score.image_scores(t, p)).first()["dataset_score"] == pytest.approx(25.0)


def test_a_taken_prediction_is_not_taken_twice(spark):
    t = table(spark, [(1, 0, 50.0, 50.0, 20.0, 20.0, 0.0), (1, 1, 50.5, 50.0, 20.0, 20.0, 0.0)])
    p = table(spark, [(1, 7, 50.4, 50.0, 20.0, 20.0, 0.0)])
    rows = match.match_rows(match.greedy_matches(match.measured_pairs(t, p))).collect()
    assert [(r["t_seq"], r["p_seq"]) for r in rows] == [(0, 7)]  # the earlier truth has it, though the later is nearer


def test_equal_candidates_go_to_the_earlier(spark):
    t = table(spark, [(1, 0, 50.0, 50.0, 20.0, 20.0, 0.0)])
    p = table(spark, [(1, k, 50.0, 50.0, 20.0, 20.0, 0.0) for k in (9, 3, 5)])
    assert match.match_rows(match.greedy_matches(match.measured_pairs(t, p))).first()["p_seq"] == 3


def test_grid_cells_give_the_same_pairs(spark):
    rng = np.random.default_rng(0)
    make = lambda n: table(spark, [(int(i % 2), i, *map(float, rng.uniform(0, 300, 2)), 20.0, float(rng.uniform(10, 20)), 0.0) for i in range(n)])
    t, p = make(150).cache(), make(150).cache()
    pairs = lambda cell: {(r["t_seq"], r["p_seq"]) for r in match.candidate_pairs(t, p, cell=cell).collect()}
    assert pairs(None) == pairs(20.0) and pairs(None)


def test_empty_sides(spark):
    t, none = table(spark, [(1, 0, 50.0, 50.0, 20.0, 20.0, 0.0)]), table(spark, [])
    assert score.image_scores(t, none).first()["score"] == 0.0
    assert score.image_scores(none, t).count() == 0
    assert match.centre_recall(t, none).first()["recall"] == 0.0


def test_orthogonal_distance(spark):
    rows = spark.createDataFrame([(0.0, 15.0, 5.0), (30.0, 0.0, 10.0), (0.0, 0.0, 10.0), (25.0, 15.0, None)], "x double, y double, want double")
    d = G.orthogonal_distance("x", "y", F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(10.0), F.lit(0.0))
    for r in rows.withColumn("d", d).collect():
        angles = np.linspace(0, 2 * np.pi, 200_001)
        want = np.hypot(20 * np.cos(angles) - r["x"], 10 * np.sin(angles) - r["y"]).min()
        assert r["d"] == pytest.approx(want, abs=1e-3)


def test_ladder_is_the_float_loop():
    steps = select.ladder()
    assert len(steps) == 11 and steps[2] == 0.6799999999999999 and steps[-1] == 0.5999999999999999


def test_adaptive_selection_falls_to_the_lowest(spark):
    rows = spark.createDataFrame([(1, k, 0.65) for k in range(3)] + [(2, k, 0.9 - k / 1000) for k in range(12)], "image_no long, seq long, conf double")
    got = {(r["image_no"], round(r["threshold"], 3)): r["n"] for r in select.adaptive_selection(rows).groupBy("image_no", "threshold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(1, 0.6): 3, (2, 0.7): 12}


def test_ranking_metrics_with_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 0), (0.1, 1)], "p double, y int")
    r = stats.ranking_metrics(rows, "p", "y").first()
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in (0.9, 0.5, 0.1) for b in (0.5, 0.5, 0.1)) / 9
    assert r["auc"] == pytest.approx(wins) and r["average_precision"] == pytest.approx((1 * 1 + 2 / 4 + 3 / 6) / 3)


def test_report_of_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1)], "cls int, guess int")
    got = {r["cls"]: r for r in stats.class_report(rows, [0, 1, 2]).collect()}
    assert got[0]["recall"] == 0.5 and got[1]["precision"] == 0.0 and got[2]["f1"] == 0.0


def test_folds_are_even(spark):
    rows = spark.range(5000).select(F.lit(1).alias("image_no"), F.col("id").alias("seq"), (F.col("id") % 2).alias("cls"))
    n = [r["count"] for r in stats.folds(rows).groupBy("cls", "fold").count().collect()]
    assert len(n) == 10 and min(n) > 400 and sum(n) == 5000


def test_components_and_distance():
    mask = np.array([[0, 1, 1, 1, 0], [1, 1, 0, 1, 1], [1, 0, 0, 0, 1], [1, 1, 0, 1, 1], [0, 1, 1, 1, 0]], bool)
    assert segment.components(mask).max() == 1 and segment.components(~mask, 1).max() == 5
    assert segment.thickness(np.ones((5, 5), bool)) == 6
    d = segment.distance(np.pad(np.ones((3, 3), bool), 1))
    assert d[2, 2] == 2 and d[1, 1] == 1 and d[0, 0] == 0


def test_watershed_parts_two_basins():
    image = np.array([[0.0, 1, 2, 1, 0]])
    got = segment.watershed(image, np.array([[1, 0, 0, 0, 2]]), np.ones((1, 5), bool))
    assert got[0, 1] == 1 and got[0, 3] == 2 and (got > 0).all()


def test_hull():
    assert segment.hull_area(np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)) == 4.0


@pytest.mark.parametrize("rot", [0, 30, 100])
def test_fits_recover_an_ellipse(rot):
    k = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    t = np.radians(rot)
    x = 5 + 30 * np.cos(k) * np.cos(t) - 20 * np.sin(k) * np.sin(t)
    y = -3 + 30 * np.cos(k) * np.sin(t) + 20 * np.sin(k) * np.cos(t)
    cx, cy, a, b, angle = segment.fit_ellipse(np.stack([x, y], 1))
    assert (cx, cy, a, b) == (pytest.approx(5), pytest.approx(-3), pytest.approx(30), pytest.approx(20)) and angle == pytest.approx(rot, abs=1e-6)
    r, theta = np.hypot(x - 5, y + 3), np.arctan2(y + 3, x - 5)
    (a, b, phi), = segment.refine_polar(theta, r[None], np.ones((1, len(r)), bool))[0]
    assert a == pytest.approx(30, rel=1e-3) and b == pytest.approx(20, rel=1e-3) and abs(np.sin(phi - t)) < 1e-2
    assert segment.fit_ellipse(np.zeros((3, 2))) is None and segment.fit_ellipse(np.stack([k, k], 1)) is None


def test_one_point_has_the_widest_gap(spark):
    rows = spark.createDataFrame([([1.0],), ([0.0, math.pi],)], "angles array<double>")
    assert [r[0] for r in rows.select(features.widest_gap("angles")).collect()] == [1.0, pytest.approx(0.5)]


def test_tiles_cover_every_pixel():
    for size, tile, overlap in ((64, 32, 8), (100, 32, 8), (33, 32, 16), (32, 32, 8)):
        origins = raster.tile_origins(size, tile, overlap)
        assert origins[0] == 0 and origins[-1] == size - tile and {p for o in origins for p in range(o, o + tile)} == set(range(size))
    with pytest.raises(ValueError):
        raster.corner_origins(4, 4, 5, 5)


def test_blending_one_plane_gives_it_back(spark):
    plane = [float(k) for k in range(64)]
    rows = spark.createDataFrame([(1, plane)], "vec_id long, plane array<double>")
    cut = raster.tiles(rows, "plane", 8, [(y, x) for y in (0, 3) for x in (0, 3)], 5, 5)
    g = raster.gaussian(5)
    got = {(r["y"], r["x"]): r["v"] for r in raster.blend(cut, "vec_id", "tile", 5, raster.window_plane(g, g)).collect()}
    assert all(got[y, x] == pytest.approx(8 * y + x) for y in range(8) for x in range(8))


def test_missing_features_are_zero(spark):
    rows = spark.createDataFrame([({"a": 2.0},), ({},)], "m map<string,double>")
    assert [r[0] for r in rows.select(models.feature_vector("m", ["a", "b"])).collect()] == [[2.0, 0.0], [0.0, 0.0]]


def png(gray: np.ndarray, kind: int) -> bytes:
    h, w = gray.shape
    raw, before = b"", np.zeros(w, int)
    for row in gray.astype(int):
        left, corner = np.append(0, row[:-1]), np.append(0, before[:-1])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        raw += bytes([kind]) + ((row - [0, left, before, (left + before) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        before = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    gray = np.random.default_rng(1).integers(0, 256, (9, 7)).astype(np.uint8)
    for kind in range(5):
        assert (images.decode_png(png(gray, kind)) == gray).all()
    (tmp_path / "a" / "truth").mkdir(parents=True)
    (tmp_path / "a" / "x.png").write_bytes(png(gray, 4))
    (tmp_path / "a" / "bad.png").write_bytes(b"no image")
    (tmp_path / "a" / "truth" / "y.png").write_bytes(png(gray, 0))
    rows = images.find_images(spark, str(tmp_path)).select("path", images.gray_plane("content").alias("g")).orderBy("path").collect()
    assert len(rows) == 2 and rows[0]["g"]["h"] is None and rows[1]["g"]["plane"] == gray.ravel().astype(float).tolist()


def test_settings():
    s = images.Settings.of({"limit": "5", "rim_thresh": 0.3, "other": 1})
    assert (s.limit, s.rim_thresh, s.target_size) == (5, 0.3, 1296)


def test_csv_keeps_bad_rows_out(spark, tmp_path):
    head = ",".join(ellipses.COLUMNS)
    (tmp_path / "t.csv").write_text(f"{head}\n1,2,3,4,5,img,2\nx,2,3,4,5,img,2\n-1,-1,-1,-1,-1,empty,-1\n")
    rows = ellipses.read_csv(spark, str(tmp_path / "t.csv")).orderBy("seq").collect()
    assert [(r["cx"], r["image"], r["cls"]) for r in rows] == [(1.0, "img", 2), (-1.0, "empty", -1)]


def test_files_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    got = images.union_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(repr, got.select("x", "y", "z").collect())) == ["Row(x=1, y=2, z=None)", "Row(x=None, y=3, z=4)"]


def test_arrivals_are_scored_once(spark, tmp_path):
    from rimfold.streaming.ingest import score_arrivals

    t = table(spark, [(i, 0, 50.0, 50.0, 20.0, 20.0, 0.0) for i in (1, 2)])
    for i in (1, 2):
        t.where(F.col("image_no") == i).write.mode("append").parquet(f"{tmp_path}/in")
        score_arrivals(spark, f"{tmp_path}/in", t.schema, t, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["image_no"] for r in got) == [1, 2] and {r["batch"] for r in got} == {0, 1}
