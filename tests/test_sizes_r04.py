"""Queries on rim points: results against SQL on small tables of their own, and that no point is a row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rimfold.operators import features, segment, sets
from rimfold.plans import catalog, fixtures, rasters
from tests.test_sizes_r03 import differs, written

LINES = [(o, ln, (o * 31 + ln * 17) % 211, o % 5) for o in range(60) for ln in range(1, 5)]


def moved(spark, folder: str, name: str, capsys) -> str:
    catalog.QUERIES[name](spark, folder).explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["sg12_polar_fit", "fe10_classifier_vector", "fe7_slopes"])
def test_points_are_no_rows(spark, tmp_path, capsys, name):
    """Rows of lineitem move once, points are made and asked in one batch; a row given twice is one candidate, a row without order none."""
    folder = written(spark, tmp_path, [*LINES, *LINES[:9], (None, 1, 3, 4)])
    plan = moved(spark, folder, name, capsys)
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert not differs(spark, folder, name)


def test_polar_fits_take_few_steps(monkeypatch):
    """Newton's steps near the end: the former ones alone took 54 a profile on such profiles."""
    rng, theta = np.random.default_rng(2), (np.arange(36) + 0.5) * 2 * np.pi / 36 - np.pi
    a, b, phi = 40 + 80 * rng.random((300, 1)), 30 + 8 * rng.random((300, 1)), rng.random((300, 1)) * 3
    radius = a * b / np.hypot(b * np.cos(theta - phi), a * np.sin(theta - phi)) * (1 + rng.integers(-10, 11, (300, 36)) / 100)
    use, n, terms = rng.random((300, 36)) < 0.6, [0], segment.polar_terms

    def counted(p, *more):
        n[0] += len(p)
        return terms(p, *more)

    monkeypatch.setattr(segment, "polar_terms", counted)
    found, _ = segment.refine_polar(theta, radius, use)
    assert n[0] < 20 * 300
    for row in (found[:, 0], found[:, 1]):
        assert np.isfinite(row).all()
    p = np.column_stack([np.log(found[:, :2]), found[:, 2]])
    _, slope, _ = terms(p, np.cos(2 * theta), np.sin(2 * theta), np.where(use, 1 / radius, 0.0))
    assert np.abs(slope).max() < 1e-8


def test_matrices_are_those_of_the_cost():
    """Gradient and second derivatives against differences of the cost."""
    theta = (np.arange(24) + 0.5) * 2 * np.pi / 24
    p, inverse = np.array([[4.0, 3.7, 0.4]]), 1 / (45 + 8 * np.cos(3 * theta))[None]
    at = lambda q: segment.polar_terms(q, np.cos(2 * theta), np.sin(2 * theta), inverse, True)
    _, slope, m = at(p)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert (at(p + step)[0] - at(p - step)[0])[0] / 2e-6 == pytest.approx(slope[k, 0], rel=1e-5)
        column = [m[i, 0] for i in ((0, 1, 3), (1, 2, 4), (3, 4, 5))[k]]
        assert (at(p + step)[1] - at(p - step)[1])[:, 0] / 2e-6 == pytest.approx(column, rel=1e-4)


def test_pieces_hold_whole_groups():
    """Rows of one value come together, however batches cut them."""
    rng = np.random.default_rng(5)
    k = np.sort(rng.integers(0, 300, 2000))
    k[500:900] = k[500]
    k = np.sort(k)
    for size in (1, 7, 64, 3000):
        batches = [pa.RecordBatch.from_pydict({"k": k[i : i + size]}) for i in range(0, len(k), size)]
        got = [t["k"].to_numpy() for t in sets.pieces(iter(batches), "k", 50)]
        assert (np.concatenate(got) == k).all() and all(p[-1] < q[0] for p, q in zip(got, got[1:]))


def test_rows_of_one_key_are_one_set():
    """Points of rows of one key are asked as one set, each about its own row's ellipse."""
    table = pa.table({"seq": [1, 1, 2, None], "cx": [0.0, 9.0, 5.0, 0.0], "cy": [0.0] * 4, "a": [2.0, 3.0, 4.0, 5.0], "b": [1.0] * 4, "rot": [0.0] * 4})
    draw = lambda c: (np.stack([c["cx"], c["cx"] + c["a"]], 1), np.zeros((4, 2)), np.zeros((4, 2)), np.ones((4, 2), bool))
    one, two = sets.sets_of(table, "seq", draw)
    assert one.key.to_pylist() == [2, None] and one.use.tolist() == [[True, True], [False, False]]
    assert two.rows.tolist() == [[0, 1]] and two.local()[0].tolist() == [[0.0, 2.0, 0.0, 3.0]]


def test_the_whole_classifier_vector(spark, tmp_path):
    """All features of a batch's sets against those of points as rows."""
    folder = written(spark, tmp_path, LINES)
    points = rasters.rim_points(spark, folder)
    slopes = features.slopes(points.withColumns({"g": F.col("p"), "g_mean": F.lit(0.6 - 1e-6)}), "seq")
    want = features.assembled([features.geometry(points, "seq", 2048, 2592), features.rim_probability(points, "seq"), slopes], "seq", features.CLASSIFIER).orderBy("seq").toPandas()
    ask = lambda z: {"seq": z.key} | sets.geometry(z, 2048, 2592) | sets.rim_probability(z) | sets.slopes(z, z.p, 0.6 - 1e-6)
    names = features.CLASSIFIER[:23]
    got = rasters.rim_asked(fixtures.truth(spark, folder, dealt=True), sets.each(ask), "seq long, " + ", ".join(f"{n} double" for n in names)).orderBy("seq").toPandas()
    assert got["seq"].tolist() == want["seq"].tolist()
    for n in names:
        assert np.allclose(got[n], want[n], rtol=1e-9, atol=1e-9), n


def test_guarded_refits_are_those_of_points_as_rows(spark, tmp_path, capsys):
    """One exchange and no points as rows; what the guard lets through, and rows without a key, as before."""
    folder = written(spark, tmp_path, [*LINES, *LINES[:9], (None, 1, 3, 4)])
    plan = moved(spark, folder, "sg13_guarded_refit", capsys)
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    points = rasters.rim_points(spark, folder)
    refit = segment.polar_fits(points, ["seq"], 24).drop("n").join(points.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "seq")
    want = segment.guarded_refit(fixtures.truth(spark, folder).select("seq", *features.ELLIPSE), refit, ["seq"], 2592, 2048)
    want = want.select("seq", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "refitted").collect()
    got = catalog.QUERIES["sg13_guarded_refit"](spark, folder).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and 0 < sum(r["refitted"] for r in got) and len(got) == 241


def test_stability_refits_random_parts(spark, tmp_path, capsys):
    """Parts are int(0.8 n) different points, drawn evenly; their fits are those of fit_ellipse, one by one."""
    plan = moved(spark, written(spark, tmp_path, LINES), "fe5_smp4_stability", capsys)
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    rng, n = np.random.default_rng(1), 200
    use = rng.random((n, 24)) < 0.85
    use[0] = np.arange(24) < 9
    t = rng.random((n, 24)) * 7
    e = np.column_stack([300 + rng.random((n, 2)) * 900, 60 + 50 * rng.random(n), 30 + 20 * rng.random(n), 180 * rng.random(n)])
    c, s = np.cos(np.radians(e[:, 4:])), np.sin(np.radians(e[:, 4:]))
    u, v = e[:, 2:3] * np.cos(t), e[:, 3:4] * np.sin(t)
    x, y = e[:, :1] + c * u - s * v + rng.normal(size=(n, 24)), e[:, 1:2] + s * u + c * v + rng.normal(size=(n, 24))
    draw = rng.integers(0, 2**63, n).astype(np.uint64)
    parts = segment.parts_of(draw, use, 5, 0.8)
    assert (parts.sum(axis=2) == (0.8 * use.sum(axis=1)).astype(int)[:, None]).all() and not (parts & ~use[:, None]).any()
    share = parts[use.sum(axis=1) == 20].mean(axis=(0, 1)) / use[use.sum(axis=1) == 20].mean(axis=0)
    assert np.abs(share - 0.8).max() < 0.15
    got = segment.stability_rows(x, y, use, e, draw)
    assert (got[0] == 1).all()
    for k in range(1, n):
        fits = [segment.fit_ellipse(np.column_stack([x[k], y[k]])[m]) for m in parts[k]]
        f = np.array([z for z in fits if z is not None])
        turn = np.abs(np.radians(f[:, 4]) - np.radians(e[k, 4]))
        ja, jb = (np.mean(np.abs(f[:, i] - e[k, i]) / (e[k, i] + 1e-6)) for i in (2, 3))
        shift = np.mean(np.hypot(f[:, 0] - e[k, 0], f[:, 1] - e[k, 1])) / (np.sqrt(e[k, 2] * e[k, 3]) + 1e-6)
        assert got[k] == pytest.approx([ja, jb, np.mean(np.minimum(turn, np.pi - turn)), shift, 1 / (1 + ja + jb)], rel=1e-6, abs=1e-8)
