"""Rasters as rows: a plane is an array of h * w doubles in row order, one row for each image or tile.

Stencils, resizing and index maps are NumPy over Arrow batches, some planes at a time as one array (whole images have
millions of pixels, which interpreted array expressions do not reach in time); what is one formula a pixel stays a column expression.
Neither needs a shuffle. Pixel rows (y, x, v) are only made where tiles must meet. A null pixel is NaN, a null plane null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT_ONCE = 2_000_000  # pixels that one NumPy call sees, or a whole plane


def grid(h: int, w: int, f: Callable[[Column, Column], Column]) -> Column:
    """An h by w plane of f(y, x)."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: f(F.floor(i / w).cast("int"), (i % w).cast("int")))


def at(plane, w: int, y, x) -> Column:
    return F.get(F.col(plane) if isinstance(plane, str) else plane, (y * w + x).cast("int"))


def pixels(rows: DataFrame, key: str, plane: str, w: int, name: str = "v") -> DataFrame:
    out = rows.select(key, F.posexplode(plane).alias("_i", name))
    return out.select(key, F.floor(F.col("_i") / w).cast("int").alias("y"), (F.col("_i") % w).cast("int").alias("x"), name)


def by_numpy(f: Callable[[np.ndarray], np.ndarray], plane, h: int, w: int) -> Column:
    """f of arrays (planes, h, w), as planes again."""

    @F.pandas_udf("array<double>")
    def run(planes: pd.Series) -> pd.Series:
        out, there = [None] * len(planes), np.flatnonzero(planes.notna().to_numpy())
        each = max(1, AT_ONCE // (h * w))
        for k in range(0, len(there), each):
            own = there[k : k + each]
            stack = np.stack([np.asarray(planes.iloc[i], np.float64) for i in own]).reshape(len(own), h, w)
            for i, row in zip(own, f(stack).reshape(len(own), -1)):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run(F.col(plane) if isinstance(plane, str) else plane)


def sobel(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives along x and y of (planes, h, w), as two passes each; borders are reflected without repeating the edge."""
    wide = np.pad(p, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    across, down = wide[:, :, 2:] - wide[:, :, :-2], wide[:, 2:] - wide[:, :-2]
    return across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:], down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]


def sobel_magnitude(plane: str, h: int, w: int) -> Column:
    return by_numpy(lambda p: np.hypot(*sobel(p)), plane, h, w)


def gradient_map(plane: str, h: int, w: int) -> Column:
    """Sobel magnitude over (its greatest + 1e-6)."""

    def over(p):
        m = np.hypot(*sobel(p))
        return m / (m.max(axis=(1, 2), keepdims=True) + 1e-6)

    return by_numpy(over, plane, h, w)


def central_gradient(plane: str, h: int, w: int) -> tuple[Column, Column]:
    """Differences along y and x: central inside, one-sided at the border."""
    return tuple(by_numpy(lambda p, axis=axis: np.gradient(p, axis=axis), plane, h, w) for axis in (1, 2))


def reached(p: np.ndarray, pick: np.ufunc, reach: int = 1) -> np.ndarray:
    """pick over the square around each pixel of planes, by rows and then columns; what lies outside takes no part."""
    for axis in (1, 2):
        out = p.copy()
        for d in range(1, reach + 1):
            lo, hi = [slice(None)] * 3, [slice(None)] * 3
            lo[axis], hi[axis] = slice(None, -d), slice(d, None)
            pick(out[tuple(lo)], p[tuple(hi)], out=out[tuple(lo)])
            pick(out[tuple(hi)], p[tuple(lo)], out=out[tuple(hi)])
        p = out
    return p


def extreme(plane: str, h: int, w: int, largest: bool, reach: int = 1) -> Column:
    """Dilation or erosion with a square element."""
    return by_numpy(lambda p: reached(p, np.maximum if largest else np.minimum, reach), plane, h, w)


def soft_skeleton(plane: str, h: int, w: int, steps: int = 5) -> Column:
    """A probability plane, in each step multiplied by its maximum over 3 x 3."""

    def value(p):
        for _ in range(steps):
            p = p * reached(p, np.maximum)
        return p

    return by_numpy(value, plane, h, w)


def resize_nearest(plane: str, h: int, w: int, oh: int, ow: int) -> Column:
    y, x = (np.minimum(n - 1, np.floor(np.arange(o) * (n / o)).astype(int)) for n, o in ((h, oh), (w, ow)))
    return by_numpy(lambda p: p[:, y[:, None], x], plane, h, w)


def resize_linear(plane: str, h: int, w: int, oh: int, ow: int) -> Column:
    """Pixel centres map to pixel centres; the border is clamped."""

    def axis(n: int, o: int):
        f = np.maximum(0.0, (np.arange(o) + 0.5) * (n / o) - 0.5)
        lo = np.minimum(n - 1, np.floor(f).astype(int))
        return lo, np.minimum(n - 1, lo + 1), np.minimum(f - lo, 1.0)

    (y0, y1, fy), (x0, x1, fx) = axis(h, oh), axis(w, ow)

    def value(p):
        rows = p[:, y0] * (1 - fy)[:, None] + p[:, y1] * fy[:, None]
        return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx

    return by_numpy(value, plane, h, w)


def resize_area(plane: str, h: int, w: int, by: int) -> Column:
    """Means of by x by blocks."""
    return by_numpy(lambda p: p[:, : h // by * by, : w // by * by].reshape(-1, h // by, by, w // by, by).mean(axis=(2, 4)), plane, h, w)


def tile_origins(size: int, tile: int, overlap: int) -> list[int]:
    """Starts of tiles along one side; the last ones are moved back inside."""
    step = tile - overlap
    return [max(0, min(k * step, size - tile)) for k in range((size - tile + step - 1) // step + 1)]


def origins(size: str, tile: str, overlap: int) -> Column:
    """The same from columns: sizes and tiles by row."""
    n, t = F.col(size), F.col(tile)
    step = t - overlap
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((n - t + step - 1) / step))), lambda k: F.greatest(F.lit(0), F.least(k * step, n - t)).cast("long"))


def tiles(rows: DataFrame, plane: str, w: int, origins: list[tuple[int, int]], th: int, tw: int) -> DataFrame:
    """rows with tile_no, y0, x0 and tile (th by tw) for each origin."""
    place = F.array(*[F.struct(F.lit(i).alias("tile_no"), F.lit(y).alias("y0"), F.lit(x).alias("x0")) for i, (y, x) in enumerate(origins)])
    each = rows.withColumn("_o", F.explode(place)).select("*", "_o.*").drop("_o")
    return each.withColumn("tile", grid(th, tw, lambda y, x: at(plane, w, F.col("y0") + y, F.col("x0") + x)))


def corner_origins(h: int, w: int, th: int, tw: int) -> list[tuple[int, int]]:
    """The four corners; one tile where the image has the tile's size."""
    if h < th or w < tw:
        raise ValueError("the image is smaller than a tile")
    return list(dict.fromkeys([(0, 0), (0, w - tw), (h - th, 0), (h - th, w - tw)]))


def tukey(n: int, overlap: int) -> list[float]:
    """A tapered cosine window; its outermost weights are 0 where tiles overlap."""
    alpha = min(2 * overlap / n, 1.0)
    edge = alpha * (n - 1) / 2
    out = []
    for k in range(n):
        d = min(k, n - 1 - k)
        out.append(0.5 * (1 - math.cos(math.pi * d / edge)) if edge > 0 and d < edge else 1.0)
    return out


def gaussian(n: int, ratio: float = 0.25) -> list[float]:
    c, s = (n - 1) / 2, ratio * n
    return [math.exp(-((k - c) ** 2) / (2 * s * s)) for k in range(n)]


def window_plane(col: list[float], row: list[float]) -> Column:
    return F.array(*[F.lit(a * b) for a in col for b in row])


def blend(tiled: DataFrame, key: str, tile: str, tw: int, weights: Column) -> DataFrame:
    """key, y, x, v: tiles (key, y0, x0, tile) added with weights, over the sum of weights (at least 1e-8)."""
    px = tiled.select(key, "y0", "x0", F.posexplode(F.arrays_zip(F.col(tile).alias("v"), weights.alias("k"))).alias("_i", "p"))
    spots = px.select(key, (F.col("y0") + F.floor(F.col("_i") / tw).cast("int")).alias("y"), (F.col("x0") + (F.col("_i") % tw).cast("int")).alias("x"), F.col("p.v").alias("v"), F.col("p.k").alias("k"))
    return spots.groupBy(key, "y", "x").agg((F.sum(F.col("v") * F.col("k")) / F.greatest(F.sum("k"), F.lit(1e-8))).alias("v"))


def pad(plane: str, h: int, w: int, oh: int, ow: int, replicate: bool = False) -> Column:
    """Bottom and right padding, with zeros or with the nearest edge."""
    return by_numpy(lambda p: np.pad(p, ((0, 0), (0, oh - h), (0, ow - w)), mode="edge" if replicate else "constant"), plane, h, w)


def strip(plane: str, w: int, oh: int, ow: int) -> Column:
    return grid(oh, ow, lambda y, x: at(plane, w, y, x))


def fixed_point(plane: str) -> Column:
    return F.transform(plane, lambda v: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 65535).cast("int"))


def centred(plane: str) -> Column:
    return F.transform(plane, lambda v: (v - 0.5) / 0.5)


def instance_normal(plane: str, least: float = 0.1) -> Column:
    """(v - mean) / max(std, least), std with n - 1."""
    p = F.col(plane)
    n = F.size(p)
    stat = F.struct((F.aggregate(p, F.lit(0.0), lambda s, v: s + v) / n).alias("m"), F.lit(0).alias("z"))

    def normal(s):
        std = F.sqrt(F.aggregate(p, F.lit(0.0), lambda t, v: t + (v - s["m"]) * (v - s["m"])) / (n - 1))
        return F.transform(F.array(std), lambda d: F.transform(p, lambda v: (v - s["m"]) / F.greatest(d, F.lit(least))))[0]

    return F.transform(F.array(stat), normal)[0]


def ellipse_masks(h: int, w: int, cx, cy, a, b, rot) -> dict[str, Column]:
    """core (0.3 of the axes, at most 40), rim (a band of the outline) and whole, as planes of 0 and 255."""
    from rimfold.functions.geometry import col, local_frame

    a, b = col(a), col(b)
    thick = F.greatest(F.floor(0.05 * (a + b)), F.lit(1))

    def inside(y, x, p, q):
        u, v = local_frame(x.cast("double"), y.cast("double"), cx, cy, rot)
        return (u / p) * (u / p) + (v / q) * (v / q) <= 1.0

    def plane(test):
        return grid(h, w, lambda y, x: F.when(test(y, x), 255).otherwise(0))

    core_a, core_b = F.least(F.lit(40.0), 0.3 * a), F.least(F.lit(40.0), 0.3 * b)
    out_a, out_b, in_a, in_b = a + thick / 2, b + thick / 2, F.greatest(a - thick / 2, F.lit(1e-4)), F.greatest(b - thick / 2, F.lit(1e-4))
    return {
        "core": plane(lambda y, x: inside(y, x, core_a, core_b)), "whole": plane(lambda y, x: inside(y, x, in_a, in_b)),
        "rim": plane(lambda y, x: inside(y, x, out_a, out_b) & ~inside(y, x, in_a, in_b)),
    }


def mirrored(plane: str, h: int, w: int, horizontal: bool) -> Column:
    return by_numpy(lambda p: p[:, :, ::-1] if horizontal else p[:, ::-1], plane, h, w)


def quarter_turn(plane: str, n: int) -> Column:
    """A square plane turned by 90 degrees against the clock."""
    return by_numpy(lambda p: np.rot90(p, axes=(1, 2)), plane, n, n)


def affine(plane: str, h: int, w: int, degrees: float, zoom: float = 1.0, shift: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Turned about the centre by degrees (at most 30 in training), zoomed and shifted (y, x), by linear interpolation; 0 outside."""
    t = math.radians(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    dy, dx = np.mgrid[0:h, 0:w].astype(float) - np.array([cy + shift[0], cx + shift[1]])[:, None, None]
    y, x = cy + (math.cos(t) * dy + math.sin(t) * dx) / zoom, cx + (math.cos(t) * dx - math.sin(t) * dy) / zoom
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0

    def value(p):
        out = np.zeros_like(p)
        for v, u, k in ((y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)):
            inside = (v >= 0) & (v < h) & (u >= 0) & (u < w)
            out += np.where(inside, k, 0.0) * p[:, np.clip(v, 0, h - 1), np.clip(u, 0, w - 1)]
        return out

    return by_numpy(value, plane, h, w)


def unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def brightened(plane: str, by: float) -> Column:
    return F.transform(plane, lambda v: unit(v + by))


def contrasted(plane: str, factor: float) -> Column:
    """Distances from the plane's mean times factor."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v) / F.size(p)
    return F.transform(F.array(mean(F.col(plane))), lambda m: F.transform(plane, lambda v: unit(m + (v - m) * factor)))[0]


def gamma_of(plane: str, power: float) -> Column:
    return F.transform(plane, lambda v: F.pow(unit(v), F.lit(power)))


def noisy(plane: str, key: str, spread: float, seed: int = 42) -> Column:
    """Noise by pixel: a hash of seed, key and place as a uniform draw of standard deviation `spread`; the same each time."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), F.lit(1 << 30)) / (1 << 30) - 0.5
    return F.transform(plane, lambda v, i: unit(v + draw(i) * (spread * math.sqrt(12))))


def height_and_gradient(plane: str, h: int, w: int) -> tuple[Column, Column]:
    """The pseudo elevation (in [0, 1]) and the gradient map of a plane from one Sobel pass, laid behind one another in one
    array and cut apart."""
    from rimfold.operators.segment import frequencies

    def value(p):
        gx, gy = sobel(p)
        kx, ky, k2 = frequencies(h, w)
        z = np.real(np.fft.ifft2(-1j * (kx * np.fft.fft2(gx) + ky * np.fft.fft2(gy)) / k2))
        lo, hi = z.min(axis=(1, 2), keepdims=True), z.max(axis=(1, 2), keepdims=True)
        m = np.hypot(gx, gy)
        return np.stack([(z - lo) / (hi - lo + 1e-6), m / (m.max(axis=(1, 2), keepdims=True) + 1e-6)], axis=1)

    both = by_numpy(value, plane, h, w)
    return F.slice(both, 1, h * w), F.slice(both, h * w + 1, h * w)
