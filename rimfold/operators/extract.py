"""From probability planes to candidates: NumPy over Arrow batches of images up to the candidates, columns and joins from there on.

core and whole planes -> regions by watershed (the whole plane's mask, flooded from the core's parts) -> shape gates -> rim
points on the regions' borders -> ellipse or polar fit -> scale of the rim's crest -> eccentricity floor -> confidence ->
gates; then overlaps, adaptive threshold and rescue.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimfold.operators import segment, select
from rimfold.operators.raster import reached
from rimfold.operators.segment import basins
from rimfold.sources import storage


#: Bytes of planes that one read of stored planes may bring into memory at once; Parquet's reader takes up to 4096 rows of a file.
READ = 16_000_000


def edges(labels: np.ndarray) -> np.ndarray:
    """Whether a pixel of planes of labels (planes, h, w) has a neighbour of another label, or is at the side."""
    out = reached(labels, np.maximum) != reached(labels, np.minimum)
    out[:, [0, -1]] = out[:, :, [0, -1]] = True
    return out


def labelled_planes(images: DataFrame, key: str, h: int, w: int, *, core: str, whole: str, rim: str, threshold: float) -> DataFrame:
    """key, rim, and z: place in the plane, label, edge, c and p (core and rim planes) of the pixels of all regions. Written once,
    read by all that follows, in files of few planes."""

    @F.pandas_udf("struct<i:array<int>,label:array<int>,edge:array<boolean>,c:array<double>,p:array<double>>")
    def pixels(cores: pd.Series, wholes: pd.Series, rims: pd.Series) -> pd.DataFrame:
        out = []
        for c, g, p in zip(cores, wholes, rims):
            c, g, p = (np.asarray(x, float) for x in (c, g, p))
            labels = basins(c.reshape(h, w), g.reshape(h, w), threshold)
            i = np.flatnonzero(labels)
            out.append((i.astype(np.int32), labels.ravel()[i].astype(np.int32), edges(labels[None]).ravel()[i], c[i], p[i]))
        return pd.DataFrame(out, columns=["i", "label", "edge", "c", "p"])

    found = images.select(key, F.col(rim).alias("rim"), pixels(core, whole, rim).alias("_z"))
    return storage.stored(found.select(key, "rim", F.arrays_zip(*[F.col(f"_z.{n}").alias(n) for n in ("i", "label", "edge", "c", "p")]).alias("z")), most=max(1, READ // (40 * h * w)))


def region_pixels(planes: DataFrame, key: str, w: int) -> DataFrame:
    """key, y, x, label, edge (the pixel has a neighbour of another label, or is at the image's side), c and p (core and rim
    planes) of the pixels of all regions, as rows; the extraction itself needs none."""
    px = planes.select(key, F.explode("z").alias("z"))
    return px.select(key, F.floor(F.col("z.i") / w).cast("int").alias("y"), (F.col("z.i") % w).cast("int").alias("x"), "z.label", "z.edge", "z.c", "z.p")


def shapes(labels: np.ndarray, *, least_area: int = 40, small: int = 200) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Properties by label (0, which is no region, to the greatest) of planes of labels that go on from plane to plane, as
    segment.region_properties has them, and which labels pass the gates of shape of select.region_shape."""
    plane, y, x = np.nonzero(labels)
    k = labels[plane, y, x]
    n = int(k.max(initial=0)) + 1
    size = np.bincount(k, minlength=n)
    some = np.maximum(size, 1)
    by = lambda v: np.bincount(k, v, n) / some
    cy, cx = by(y), by(x)
    dy, dx = y - cy[k], x - cx[k]
    vy, vx, vxy = by(dy * dy), by(dx * dx), by(dx * dy)
    root = np.hypot((vy - vx) / 2, vxy)
    major, minor = (4 * np.sqrt(np.maximum(0.0, (vy + vx) / 2 + r)) for r in (root, -root))
    ecc = np.sqrt(np.maximum(0.0, 1 - (minor / np.where(major > 0, major, np.inf)) ** 2)) * (major > 0)
    box = {}
    for name, v in (("x", x), ("y", y)):
        box[f"{name}0"], box[f"{name}1"] = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(box[f"{name}0"], k, v)
        np.maximum.at(box[f"{name}1"], k, v)
    fine = (size >= least_area) & (minor >= np.maximum(3.0, 0.02 * np.sqrt(size))) & ~((ecc > 0.95) & (size < 200))
    fine[0] = False
    for label in np.flatnonzero(fine & (size < min(small, 150))):
        at = k == label
        fine[label] = not size[label] / segment.hull_area(np.column_stack([x[at], y[at]]).astype(float)) < 0.7
    return {"area": size, "cx": cx, "cy": cy, **box}, fine


def outermost(k: np.ndarray, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points are the outermost of their sector of their set k, the first by (y, x) of equals, by set and sector, and the
    sets' numbers there; see segment.angular_samples."""
    sector = np.minimum(bins - 1, np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * bins)).astype(int)
    order = np.lexsort((x, y, -(dx * dx + dy * dy), sector, k))
    key = (k * bins + sector)[order]
    at = order[np.append(True, key[1:] != key[:-1])[: len(order)]]
    return at, k[at]


def profiles(k: np.ndarray, dx: np.ndarray, dy: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The largest radius in each sector of sets 0 to n - 1 (lines), nan where there is no point."""
    sector = np.clip(np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi / bins)).astype(int), 0, bins - 1)
    out = np.full(n * bins, -1.0)
    np.maximum.at(out, k * bins + sector, np.hypot(dx, dy))
    return np.where(out < 0, np.nan, out).reshape(n, bins)


def perimeters(e: np.ndarray, planes: np.ndarray, plane: np.ndarray, scales: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of planes (planes, h, w) on the perimeters of ellipses (rows of cx, cy, a, b, degrees) at some scales, 0 outside the
    image, and which samples are inside: (ellipses, scales, samples). A sample has the value of the pixel it is nearest to, as
    centres and fits take a pixel to be where its whole numbers are."""
    angle, (cx, cy, a, b, rot) = 2 * np.pi * np.arange(samples) / samples, (v[:, None, None] for v in e.T)
    t, s = np.radians(rot), scales[..., None]
    u, v = a * s * np.cos(angle), b * s * np.sin(angle)
    x, y = cx + u * np.cos(t) - v * np.sin(t), cy + u * np.sin(t) + v * np.cos(t)
    x, y = np.floor(x + 0.5), np.floor(y + 0.5)
    inside = (x >= 0) & (y >= 0) & (x < planes.shape[2]) & (y < planes.shape[1])
    return np.where(inside, planes[plane[:, None, None], np.where(inside, y, 0).astype(int), np.where(inside, x, 0).astype(int)], 0.0), inside


def confidences(value: np.ndarray, inside: np.ndarray, bins: int = 36) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """confidence, completeness and mean of perimeters' samples (lines), as features.confidence gives them."""
    n = value.shape[1]
    m = inside.sum(axis=1)
    some = np.maximum(m, 1)
    mean, share, complete = value.sum(axis=1) / some, (inside & (value > 0.5)).sum(axis=1) / some, (inside & (value > 0.2)).sum(axis=1) / some
    angle = 2 * np.pi * np.arange(n) / n
    sector = np.minimum(bins - 1, np.floor(angle / (2 * np.pi) * bins)).astype(int)
    squares = ((inside[:, :, None] & (sector[:, None] == np.arange(bins))).sum(axis=1) ** 2).sum(axis=1)
    each = m / bins
    spread = np.sqrt(np.maximum(0.0, squares / bins - each * each))
    uneven = np.minimum(spread / (np.sqrt(each * (bins - 1)) + 1e-6), 1.0)
    # the widest gap: from one sample inside to the next, around
    twice, last, gap = np.tile(inside, 2), np.full(len(m), -1), np.zeros(len(m), int)
    for k in range(2 * n):
        here = twice[:, k]
        gap = np.where(here & (last >= 0), np.maximum(gap, k - last), gap)
        last = np.where(here, k, last)
    value = 0.4 * mean + 0.3 * share + 0.15 * (1 - uneven) + 0.15 * (1 - np.where(m > 1, gap / n, 1.0))
    return np.where(2 * m < n, 0.0, value), complete, mean


def found_in(
    cores: np.ndarray, wholes: np.ndarray, rims: np.ndarray, *, method: str = "direct", threshold: float = 0.6, rim_threshold: float = 0.25, least_area: int = 40, bins: int = 64, least_points: int = 16,
    most_area: int | None = None, scales: tuple = (1.0, 1.4, 40), scale_samples: int = 72, samples: int = 120, floor: float = 0.15, completeness: float = 0.35, polar_bins: int = 120, polar_support: float = 0.4,
) -> dict[str, np.ndarray]:
    """The candidates of images whose planes are (images, h, w); image: the place of each one's image. See candidates."""
    labels, before = segment.basins_all(cores, wholes, threshold)
    shape, fine = shapes(labels, least_area=least_area)
    if most_area:
        fine &= shape["area"] <= most_area
    image, y, x = np.nonzero(labels)
    k, edge, c, p = labels[image, y, x], edges(labels)[image, y, x], cores[image, y, x], rims[image, y, x]
    dx, dy = x - shape["cx"][k], y - shape["cy"][k]
    outer = fine[k] & edge & (p > rim_threshold)
    n = len(fine)
    enough = np.bincount(k[outer], minlength=n) >= 20
    outer &= enough[k]
    at, own = outermost(k[outer], x[outer], y[outer], dx[outer], dy[outer], bins)
    xy = np.column_stack([x[outer], y[outer]]).astype(float)[at]
    count = np.bincount(own, minlength=n)
    sampled = np.flatnonzero(count >= least_points)
    ends = np.searchsorted(own, sampled)
    fits = np.full((n, 5), np.nan)
    if len(sampled):
        fits[sampled] = segment.TOGETHER["direct" if method == "polar" else method]([xy[i : i + count[s]] for s, i in zip(sampled, ends)])
    taken = np.zeros(n, bool)
    taken[sampled] = True
    if method == "polar":
        own = np.flatnonzero(enough)
        line = np.full(n, -1)
        line[own] = np.arange(len(own))
        inner = (line[k] >= 0) & (c > threshold)
        radius, core = profiles(line[k[outer]], dx[outer], dy[outer], len(own), polar_bins), profiles(line[k[inner]], dx[inner], dy[inner], len(own), polar_bins)
        polar, _ = segment.polar_rows(radius, core, np.isfinite(core).any(axis=1))
        good = (np.isfinite(radius).sum(axis=1) >= polar_support * polar_bins) & (polar[:, 1] >= segment.POLAR_LEAST)
        fits[own[good]] = np.column_stack([np.full((good.sum(), 2), np.nan), polar[good, :2], np.degrees(polar[good, 2])])
        taken[own[good]] = True
    taken = np.flatnonzero(taken)
    e, own = fits[taken], {c: v[taken] for c, v in shape.items()}
    w2, h2 = 2 * e[:, 2], 2 * e[:, 3]
    valid = (w2 >= 5) & (h2 >= 5) & (np.maximum(w2, h2) / (np.minimum(w2, h2) + 1e-6) < 4.0)
    e = np.column_stack([
        np.where(np.isnan(e[:, 0]), own["cx"], e[:, 0]), np.where(np.isnan(e[:, 1]), own["cy"], e[:, 1]), np.where(valid, e[:, 2], (own["x1"] - own["x0"] + 1) / 2),
        np.where(valid, e[:, 3], (own["y1"] - own["y0"] + 1) / 2), np.nan_to_num(e[:, 4]),
    ])
    image = np.searchsorted(before, taken, "left") - 1
    steps = np.linspace(scales[0], scales[1], int(scales[2]))
    scale = np.full(len(e), 1.14)
    for i in range(0, len(e), 256):
        part = slice(i, i + 256)
        value, inside = perimeters(e[part], rims, image[part], np.broadcast_to(steps, (len(e[part]), len(steps))), scale_samples)
        m = inside.sum(axis=2)
        mean = np.where(2 * m >= scale_samples, np.round(value.sum(axis=2) / np.maximum(m, 1), 12), 0.0)
        best = mean.argmax(axis=1)
        scale[part] = np.where(mean[np.arange(len(best)), best] > 0, steps[best], 1.14)
    a, b = e[:, 2] * scale, e[:, 3] * scale
    big, little = np.maximum(a, b), np.minimum(a, b)
    b = np.where(np.sqrt(np.maximum(0.0, 1 - (little / big) ** 2)) < floor, b * (big * np.sqrt(1 - floor * floor) / little), b)
    e = np.column_stack([e[:, :2], a, b, e[:, 4]])
    value, inside = perimeters(e, rims, image, np.ones((len(e), 1)), samples)
    confidence, complete, mean = confidences(value[:, 0], inside[:, 0])
    out = {"image": image, "seq": taken - before[image]} | dict(zip(("cx", "cy", "a", "b", "rot"), e.T)) | {"scale": scale, "confidence": confidence, "completeness": complete, "rim_score": mean}
    keep = inside[:, 0].any(axis=1) & (complete >= completeness)
    return {name: v[keep] for name, v in out.items()}


def candidates(images: DataFrame, key: str, h: int, w: int, *, core: str = "core", whole: str = "whole", rim: str = "rim", draw: Callable | None = None, **how) -> DataFrame:
    """key, seq (the label), cx, cy, a, b, rot, scale, confidence, completeness, rim_score of the candidates of images (key and
    the planes core, whole, rim). Planes are worked on where they are: neither they nor their pixels move or are stored.

    draw: makes the three planes (images, h, w) from a batch of rows (key and numbers), where images have none yet. how: method: a fit of segment.FITS over one point in each of `bins` sectors, or polar: the fit of outer and inner profiles, with
    the direct one where that has none. A region without a valid fit is taken by its box. scales: least, most, number.
    """
    names = ["cx", "cy", "a", "b", "rot", "scale", "confidence", "completeness", "rim_score"]
    most = max(1, READ // (40 * h * w))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                cores, wholes, rims = draw(part) if draw else (part[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w) for c in (core, whole, rim))
                found = found_in(cores, wholes, rims, **how)
                yield pa.RecordBatch.from_pydict({key: part[key].take(pa.array(found["image"])), "seq": pa.array(found["seq"], pa.int32()), **{n: found[n] for n in names}})

    returns = f"{key} {images.schema[key].dataType.simpleString()}, seq int, " + ", ".join(f"{n} double" for n in names)
    return (images if draw else images.select(key, *[F.col(c).cast("array<double>") for c in (core, whole, rim)])).mapInArrow(run, returns)


def chosen(found: DataFrame, *, overlaps: bool = True, rescue: bool = True, top: float = 0.7, bottom: float = 0.6, enough: int = 10, rescue_least: float = 0.85) -> DataFrame:
    """The candidates (image_no, seq, ...) that are reported, with origin: without overlaps, over the image's threshold, filled up
    by the best of the others."""
    found = storage.stored(found)
    if overlaps:
        found = found.join(select.suppress_overlaps(found, conf="confidence"), ["image_no", "seq"], "left_semi")
    first = select.adaptive_selection(found, conf="confidence", enough=enough, top=top, bottom=bottom)
    if not rescue:
        return first.withColumn("origin", F.lit("selected")).drop("threshold")
    other = F.when(F.col("completeness") > 0.7, F.greatest("confidence", (F.col("confidence") + F.col("completeness")) / 2)).otherwise(F.col("confidence"))
    return found.join(select.rescue_fill(first, found.withColumn("_rescue", other), "_rescue", least=rescue_least, enough=enough), ["image_no", "seq"])
