"""Images in tiles give what the same images give in one plane."""

import numpy as np
import pytest

from rimfold.operators import mosaic, segment

H, W = 6, 5


def tiled(spark, images, missing=()):
    rows = []
    for image, plane in images.items():
        for ty in range(plane.shape[0] // H):
            for tx in range(plane.shape[1] // W):
                part = plane[ty * H : ty * H + H, tx * W : tx * W + W].ravel()
                if (image, ty, tx) not in missing:
                    rows.append((image, ty, tx, [None if np.isnan(v) else float(v) for v in part]))
    return spark.createDataFrame(rows, "image int, ty long, tx long, plane array<double>")


def together(rows, name, shape):
    out = {}
    for r in rows.collect():
        plane = out.setdefault(r["image"], np.full(shape[r["image"]], -1.0))
        plane[r["ty"] * H : r["ty"] * H + H, r["tx"] * W : r["tx"] * W + W] = np.asarray(r[name]).reshape(H, W)
    return out


def pictures():
    rng = np.random.default_rng(5)
    spiral = np.zeros((24, 25))
    spiral[::4], spiral[2::8, 0], spiral[1::8, 0], spiral[3::8, 0] = 1, 1, 1, 1
    for k in (5, 6, 7, 13, 14, 15):
        spiral[k, -1] = 1  # one snake through all tiles
    out = {1: spiral, 2: np.ones((12, 10)), 3: np.zeros((12, 10)), 7: np.ones((6, 5))}
    for k, share in enumerate((0.3, 0.45, 0.6, 0.9)):
        out[10 + k] = (rng.random((30, 35)) < share).astype(float)
    out[20] = np.where(rng.random((12, 15)) < 0.2, np.nan, 1.0)
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels_are_those_of_one_plane(spark, connectivity):
    images = pictures()
    got = together(mosaic.label_tiles(tiled(spark, images), H, W, 0.5, connectivity), "labels", {k: p.shape for k, p in images.items()})
    for k, plane in images.items():
        assert np.array_equal(got[k], segment.components(plane > 0.5, connectivity)), k


def test_distances_are_those_of_one_plane(spark):
    images = pictures()
    got = together(mosaic.distance_tiles(tiled(spark, images), H, W, 0.5), "distance", {k: p.shape for k, p in images.items()})
    for k, plane in images.items():
        assert np.allclose(got[k], segment.distance(plane > 0.5), atol=1e-12), k
    assert got[2].max() == got[2].min() == 22


def test_missing_tiles_and_null_planes_are_empty(spark):
    whole = np.ones((18, 15))
    rows = tiled(spark, {4: whole}, {(4, 1, 0), (4, 1, 2)}).unionAll(spark.createDataFrame([(5, 0, 0, None), (5, 0, 1, [1.0] * 30)], "image int, ty long, tx long, plane array<double>"))
    left = whole.copy()
    left[6:12, 0:5] = left[6:12, 10:15] = 0
    other = np.concatenate([np.zeros((6, 5)), np.ones((6, 5))], axis=1)
    d = together(mosaic.distance_tiles(rows, H, W, 0.5, band=4), "distance", {4: (18, 15), 5: (6, 10)})
    assert np.allclose(d[4], segment.distance(left > 0)) and np.allclose(d[5], segment.distance(other > 0))
    labels = {(r["image"], r["ty"], r["tx"]): set(r["labels"]) for r in mosaic.label_tiles(rows, H, W, 0.5).collect()}
    assert len(labels) == 9 and labels.pop((5, 0, 0)) == {0} and set(map(tuple, labels.values())) == {(1,)}
    assert mosaic.label_tiles(rows.limit(0), H, W, 0.5).count() == 0 and mosaic.distance_tiles(rows.limit(0), H, W, 0.5).count() == 0


def test_stars_of_long_chains_and_hubs(spark):
    rng = np.random.default_rng(2)
    order = rng.permutation(200)
    pairs = [(1, int(a), int(b)) for a, b in zip(order, order[1:])] + [(2, 500, k) for k in range(300)] + [(2, 1000 + k, 2000 + k) for k in range(5)] + [(3, 9, 9)]
    got = {(r["image"], r["a"]): r["b"] for r in mosaic.united(spark.createDataFrame(pairs, "image long, a long, b long")).collect()}
    want = {(1, k): 0 for k in range(1, 200)} | {(2, k): 0 for k in [*range(1, 300), 500]} | {(2, 2000 + k): 1000 + k for k in range(5)}
    assert got == want
