"""The extraction on images of its own: order by confidence, what is stored, batches against images alone."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimfold.operators import extract, segment
from rimfold.plans import catalog
from tests.test_queries import plain

#: Images whose right ellipse, of the weaker rim, was the more confident one by samples cut to whole pixels: the first by the direct
#: fit (row 13692 of check_l), the others by the polar one.
NEAR_TIES = [
    [0.04, -0.143, -0.102, -0.146, 0.203, -0.135, -0.111, 0.054, -0.122, -0.223], [0.054, -0.04, -0.092, -0.21, 0.217, 0.048, 0.071, 0.12, 0.155, -0.368],
    [-0.021, -0.268, -0.169, -0.373, 0.104, -0.062, 0.029, -0.025, 0.135, -0.209], [-0.262, -0.043, -0.121, -0.187, 0.215, 0.135, -0.043, -0.023, -0.142, -0.183],
]


def embedded(spark, tmp_path, vectors: list) -> str:
    rows = [(i, [float(x) for x in v] + [0.0] * (64 - len(v))) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["sg15_extraction", "sg16_polar_extraction"])
def test_the_stronger_rim_comes_first(spark, tmp_path, name):
    folder = embedded(spark, tmp_path, NEAR_TIES)
    df = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*rel.columns).collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["sg15_extraction", "sg16_polar_extraction"])
def test_planes_are_not_stored(spark, tmp_path, monkeypatch, name):
    """Only candidates are written, not planes or their pixels."""
    kept, stored = [], extract.storage.stored
    monkeypatch.setattr(extract.storage, "stored", lambda rows, *more, **how: kept.append(rows) or stored(rows, *more, **how))
    catalog.QUERIES[name](spark, embedded(spark, tmp_path, NEAR_TIES)).collect()
    assert kept and all(not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for rows in kept for f in rows.schema)
    assert sum(rows.count() for rows in kept) <= 2 * 2 * len(NEAR_TIES)


def planes(n: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n images of 40 x 52 with up to three soft discs that may touch, the first image empty."""
    rng, (y, x) = np.random.default_rng(seed), np.mgrid[:40, :52]
    z = np.full((n, 40, 52), 9.0)
    for k in range(1, n):
        for cx, cy, a, b in zip(rng.random(3) * 52, rng.random(3) * 40, 7 + 5 * rng.random(3), 6 + 4 * rng.random(3)):
            z[k] = np.minimum(z[k], np.hypot((x - cx) / a, (y - cy) / b))
    return np.clip(1.2 - z, 0, 1), np.clip(1.6 - z, 0, 1), np.exp(-((z - 1) ** 2) / 0.02)


def test_planes_flooded_together_are_those_flooded_alone():
    core, whole, _ = planes(12)
    labels, before = segment.basins_all(core, whole, 0.6)
    for k in range(12):
        assert (np.where(labels[k] > 0, labels[k] - before[k], 0) == segment.basins(core[k], whole[k], 0.6)).all()
    assert (segment.distances(whole > 0.6)[3] == segment.distance(whole[3] > 0.6)).all()


@pytest.mark.parametrize("method", ["direct", "taubin", "polar"])
def test_images_together_are_images_alone(method):
    how = {"method": method, "polar_bins": 36, "completeness": 0.1}
    z = planes(9)
    together = extract.found_in(*z, **how)
    alone = [extract.found_in(*(p[k : k + 1] for p in z), **how) for k in range(9)]
    assert len(together["seq"]) > 8 and 0 not in together["image"]
    for name in together:
        want = np.concatenate([f[name] + (k if name == "image" else 0) for k, f in enumerate(alone)])
        assert np.allclose(together[name], want, rtol=1e-9, atol=1e-9), name


def test_candidates_of_given_planes(spark):
    """Planes as columns give the same as planes in NumPy, with the key they came with."""
    z = planes(5)
    rows = [(f"i{k}", *[p[k].ravel().tolist() for p in z]) for k in range(5)]
    images = spark.createDataFrame(rows, "name string, core array<double>, whole array<double>, rim array<double>")
    got = {(r["name"], r["seq"]): r["confidence"] for r in extract.candidates(images, "name", 40, 52).collect()}
    want = extract.found_in(*z)
    assert got == pytest.approx({(f"i{i}", s): c for i, s, c in zip(want["image"], want["seq"], want["confidence"])})


def test_shapes_are_those_of_pixel_rows(spark):
    """Areas, boxes, centres and gates as region_properties, hulls and region_shape have them for pixels as rows."""
    from rimfold.operators import select

    core, whole, _ = planes(6, 8)
    labels, _ = segment.basins_all(core, whole, 0.6)
    i, y, x = (v.tolist() for v in np.nonzero(labels))
    px = spark.createDataFrame(list(zip([0] * len(i), y, x, labels[i, y, x].tolist())), "g int, y int, x int, label int")
    both = segment.region_properties(px, "g").join(segment.hulls(px, "g").select("g", "label", "solidity"), ["g", "label"]).withColumn("ecc", F.col("eccentricity"))
    want = {r["label"]: r for r in select.region_shape(both).collect()}
    shape, fine = extract.shapes(labels)
    assert set(np.flatnonzero(fine)) == set(want)
    for k, r in want.items():
        assert [shape[c][k] for c in ("area", "x0", "x1", "y0", "y1")] == [r[c] for c in ("area", "x0", "x1", "y0", "y1")]
        assert (shape["cx"][k], shape["cy"][k]) == pytest.approx((r["cx"], r["cy"]))
