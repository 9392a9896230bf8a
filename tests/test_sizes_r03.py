"""Queries on small tables of their own: results against SQL, and how the work is dealt."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rimfold.operators import segment
from rimfold.plans import catalog
from tests.test_queries import plain


def written(spark, tmp_path, lines: list[tuple]) -> str:
    """A folder whose lineitem has the rows (order, line, part, supplier)."""
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def differs(spark, folder: str, name: str) -> list:
    df = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
    want = sorted(repr([plain(r[rel.columns.index(n)]) for n in names]) for r in rel.fetchall())
    return [pair for pair in zip(got, want) if pair[0] != pair[1]] + [None] * abs(len(got) - len(want))


@pytest.mark.parametrize("name", ["sg12_polar_fit"])
def test_axes_of_turned_ellipses(spark, tmp_path, name):
    """Sectors go by the ellipse's own frame: one part in 40 orders gives ellipses of many places, all turned by 29 degrees."""
    assert not differs(spark, written(spark, tmp_path, [(o, ln, 1, 1) for o in range(40) for ln in range(1, 4)]), name)


@pytest.mark.parametrize("name", ["sg8_angular_samples", "wn1_circular_gap", "ra20_angle_histogram", "fe1_geometry", "sg9_direct_fit"])
def test_points_stay_where_they_are_made(spark, tmp_path, capsys, name):
    """Only rows of lineitem move, once, not the points made of them; and no partition grows with the table."""
    folder = written(spark, tmp_path, [(o, ln, o % 7, o % 5) for o in range(30) for ln in range(1, 4)])
    catalog.QUERIES[name](spark, folder).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert not differs(spark, folder, name)


@pytest.mark.parametrize("method", ["direct", "taubin", "geometric"])
def test_a_batch_of_fits_equals_fits_alone(method):
    rng = np.random.default_rng(3)
    sets = [rng.random((k, 2)) for k in (0, 3, 4, 5, 9, 200)] + [np.stack([np.arange(20.0), np.arange(20.0)], 1)]
    for n in (6, 24, 24, 70):
        t = rng.random(n) * 7
        sets.append(np.stack([100 + 40 * np.cos(t), 80 + 25 * np.sin(t)], 1) + rng.normal(0, 0.1, (n, 2)))
    got = segment.TOGETHER[method](sets)
    want = np.array([segment.FITS[method](s) or (np.nan,) * 5 for s in sets], float)
    assert (np.isnan(got) == np.isnan(want)).all() and np.allclose(got[-4:, :4], want[-4:, :4], rtol=1e-7)
    if method != "geometric":
        assert np.allclose(got[:, :4], want[:, :4], rtol=1e-9, equal_nan=True)


def test_distances_take_one_batch_of_rows(spark, capsys):
    """The halving runs over whole batches; nulls stay null, points without extent go to the centre."""
    from rimfold.functions import geometry

    rows = spark.createDataFrame([(3.0, 4.0, 2.0, 1.0), (3.0, 4.0, 0.0, 0.0), (0.0, 2.0, 2.0, 2.0), (None, 1.0, 2.0, 1.0)], "x double, y double, a double, b double")
    zero = F.lit(0.0)
    found = rows.select(geometry.orthogonal_distance("x", "y", zero, zero, "a", "b", zero).alias("d"))
    found.explain()
    assert "ArrowEvalPython" in capsys.readouterr().out
    got = [r["d"] for r in found.collect()]
    t = np.linspace(0, np.pi / 2, 200_001)
    assert got[0] == pytest.approx(np.hypot(2 * np.cos(t) - 3, np.sin(t) - 4).min(), abs=1e-8) and got[1:] == [5.0, pytest.approx(0.0, abs=1e-12), None]


def test_images_in_a_partition_do_not_grow_with_the_table(spark):
    from rimfold.plans import rasters

    for n in (1000, 8000):
        rows = rasters.spread(spark.range(n).withColumnRenamed("id", "vec_id"), most=rasters.IMAGES)
        assert rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 2 * rasters.IMAGES


def test_stored_planes_come_in_files_of_few_images(spark):
    """A reader's batch is of one file and takes up to 4096 rows of it: with long files it is as large as the table."""
    from rimfold.operators import extract

    h, w, n = 48, 96, 200
    y, x = np.mgrid[:h, :w]
    soft = np.clip(1.6 - np.hypot((x - 40) / 12, (y - 20) / 9), 0, 1).ravel().tolist()
    plane = F.when(F.col("id") == 7, F.lit(soft)).otherwise(F.array_repeat(F.lit(0.0), h * w))
    images = spark.range(n).coalesce(1).select(F.col("id").alias("image_no"), *[plane.alias(c) for c in ("core", "whole", "rim")])
    planes = extract.labelled_planes(images, "image_no", h, w, core="core", whole="whole", rim="rim", threshold=0.6)
    files = planes.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == n and max(r["count"] for r in files) * h * w * 40 <= 16_000_000
    found = extract.region_pixels(planes, "image_no", w).collect()
    inside = np.reshape(soft, (h, w)) > 0.6
    assert {(r["y"], r["x"]) for r in found} == set(zip(*np.nonzero(inside))) and {r["image_no"] for r in found} == {7}
    around = [np.roll(inside, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert {(r["y"], r["x"]) for r in found if r["edge"]} == set(zip(*np.nonzero(inside & ~np.all(around, axis=0))))
    assert all(r["c"] == r["p"] == soft[r["y"] * w + r["x"]] and r["label"] == 1 for r in found)


def test_edges_lie_between_labels_and_at_the_side():
    from rimfold.operators import extract

    labels = np.array([[[1, 1, 1, 2, 2], [1, 1, 1, 2, 2], [1, 1, 1, 2, 2], [1, 1, 1, 0, 2], [1, 1, 1, 2, 2]]])
    inner = {(1, 1), (2, 1), (3, 1)}
    assert {(y, x) for y, x in np.ndindex(5, 5) if not extract.edges(labels)[0, y, x]} == inner
