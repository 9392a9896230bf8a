"""Labels, distances, regions and fits.

What is inherently sequential or needs dense linear algebra runs as NumPy over Arrow batches, a raster or point set a
row; everything that aggregates pixels by region is grouping in Spark.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = {1: [(-1, 0), (0, -1), (0, 1), (1, 0)], 2: [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]}


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each class once the classes of each pair of a and b are one."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, further := label[label]):
            label = further


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and last column + 1 of each run of pixels, in raster order."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    y, x0 = np.nonzero(step == 1)
    return y, x0, np.nonzero(step == -1)[1]


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, w: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (a below b) of neighbouring rows that touch; reach: 1 with diagonals, 0 without."""
    big = w + 2
    lo = np.searchsorted(y * big + x1, (y - 1) * big + x0 - reach, "right")
    hi = np.searchsorted(y * big + x0, (y - 1) * big + x1 + reach, "left")
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(y)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def components(mask: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Labels from 1 in raster order of each component's first pixel: runs of pixels that touch are one."""
    y, x0, x1 = runs_of(mask)
    label = joined(np.arange(len(y)), *touching(y, x0, x1, mask.shape[1], connectivity - 1))
    out = np.zeros(mask.shape, int)
    out[mask.astype(bool)] = np.repeat(np.searchsorted(np.unique(label), label) + 1, x1 - x0)
    return out


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest pixel outside the mask, exactly: by columns, then in each row the lower envelope of
    the parabolas that stand on the columns' distances. All rows go in step, and memory is a few planes."""
    return distances(mask[None])[0]


def distances(masks: np.ndarray) -> np.ndarray:
    """The same for masks (planes, h, w), each on its own."""
    n, h, w = masks.shape
    far = float(h + w)
    g = np.where(masks, far, 0.0)
    for y in range(1, h):
        np.minimum(g[:, y], g[:, y - 1] + 1, out=g[:, y])
    for y in range(h - 2, -1, -1):
        np.minimum(g[:, y], g[:, y + 1] + 1, out=g[:, y])
    return by_rows((g * g).reshape(n * h, w), far).reshape(n, h, w)


def by_rows(f: np.ndarray, far: float) -> np.ndarray:
    """The root of the least of (x - v)^2 + f[y, v] over v, at most far, for each x of each row y."""
    h, w = f.shape
    row, top = np.arange(h), np.zeros(h, int)
    at, start = np.zeros((h, w), int), np.full((h, w + 1), np.inf)  # parabolas of the envelope, and where each begins
    start[:, 0] = -np.inf
    for x in range(1, w):
        live = row
        while len(live):
            v = at[live, top[live]]
            cross = (f[live, x] + x * x - f[live, v] - v * v) / (2.0 * (x - v))
            back = cross <= start[live, top[live]]
            done = live[~back]
            top[done] += 1
            at[done, top[done]], start[done, top[done]] = x, cross[~back]
            start[done, top[done] + 1] = np.inf
            live = live[back]
            top[live] -= 1
    out, k = np.empty((h, w)), np.zeros(h, int)
    for x in range(w):
        while (ahead := start[row, k + 1] < x).any():
            k += ahead
        v = at[row, k]
        out[:, x] = (x - v) ** 2 + f[row, v]
    return np.sqrt(np.minimum(out, far * far))


def watershed(image: np.ndarray, markers: np.ndarray, mask: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Flooding from the markers inside the mask, in order of value, then of arrival. A plateau (all waiting pixels of the least
    value) is labelled as a whole, then its neighbours queue up, each for the first that reaches it; so a step is one
    array operation over a plateau."""
    h, w = image.shape
    wide = w + 2
    inside, value, out = np.zeros((h + 2, wide), bool), np.zeros((h + 2, wide)), np.zeros((h + 2, wide), int)
    inside[1:-1, 1:-1], value[1:-1, 1:-1], out[1:-1, 1:-1] = mask, image, np.where(mask, markers, 0)
    inside, value, out = inside.ravel(), value.ravel(), out.ravel()
    free, around = inside & (out == 0), np.array([dy * wide + dx for dy, dx in NEAR[connectivity]])
    level, waiting, levels = np.unique(value, return_inverse=True)[1].ravel(), {}, []

    def queue(pixels: np.ndarray) -> None:
        near = (pixels[:, None] + around).ravel()
        by = np.repeat(out[pixels], len(around))
        use = free[near]
        near, by = near[use], by[use]
        first = np.sort(np.unique(near, return_index=True)[1])
        near, by = near[first], by[first]
        free[near] = False
        at = level[near]
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            k = int(at[part[0]])
            if k not in waiting:
                waiting[k] = []
                heapq.heappush(levels, k)
            waiting[k].append((near[part], by[part]))

    queue(np.flatnonzero(out))
    while levels:
        parts = waiting.pop(heapq.heappop(levels))
        pixels = np.concatenate([p for p, _ in parts])
        out[pixels] = np.concatenate([b for _, b in parts])
        queue(pixels)
    return out.reshape(h + 2, wide)[1:-1, 1:-1]


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of pixel squares' corners."""
    corners = np.unique(np.concatenate([points + d for d in ((-0.5, -0.5), (-0.5, 0.5), (0.5, -0.5), (0.5, 0.5))]), axis=0)
    if len(corners) < 3:
        return 0.0

    def half(rows):
        out = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(corners.tolist()) + half(corners[::-1].tolist()))
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def thickness(mask: np.ndarray) -> int:
    """Twice the greatest number of steps from the outside in."""
    depth, left = 0, mask.copy()
    while left.any():
        wide = np.pad(left, 1)
        left = left & np.all([wide[1 + dy : 1 + dy + left.shape[0], 1 + dx : 1 + dx + left.shape[1]] for dy, dx in NEAR[1]], axis=0)
        depth += 1
    return 2 * depth


@lru_cache(4)
def frequencies(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angular frequencies along x and y and their squared length (1 at 0); kept for the sizes a worker meets."""
    kx, ky = np.meshgrid(2 * np.pi * np.fft.fftfreq(w), 2 * np.pi * np.fft.fftfreq(h))
    k2 = kx * kx + ky * ky
    k2[0, 0] = 1.0
    return kx, ky, k2


def height_from_gradient(plane: np.ndarray) -> np.ndarray:
    """A pseudo elevation: Sobel gradients integrated in the frequency domain, scaled to [0, 1]."""
    from rimfold.operators.raster import sobel

    gx, gy = (g[0] for g in sobel(plane[None]))
    kx, ky, k2 = frequencies(*plane.shape)
    z = np.real(np.fft.ifft2(-1j * (kx * np.fft.fft2(gx) + ky * np.fft.fft2(gy)) / k2))
    return (z - z.min()) / (z.max() - z.min() + 1e-6)


def fit_ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Direct least squares with the ellipse constraint: cx, cy, a, b (a >= b), degrees; None if it fails."""
    if len(points) < 5:
        return None
    mean, spread = points.mean(axis=0), points.std() + 1e-12
    x, y = ((points - mean) / spread).T
    d1, d2 = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
    s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = np.linalg.solve(np.array([[0, 0, 2], [0, -1, 0], [2, 0, 0]], float), s1 + s2 @ t)
        values, vectors = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors[:, np.isreal(values)])
    fine = 4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0
    if not fine.any():
        return None
    p = vectors[:, np.argmax(fine)]
    a, b, c = p
    d, e, f = t @ p
    q = np.array([[a, b / 2], [b / 2, c]])
    try:
        centre = np.linalg.solve(-2 * q, np.array([d, e]))
    except np.linalg.LinAlgError:
        return None
    level = -(f + 0.5 * (d * centre[0] + e * centre[1]))
    values, vectors = np.linalg.eigh(q)
    axes2 = level / values
    if not (axes2 > 0).all():
        return None
    k = int(np.argmax(axes2))
    long, short = np.sqrt(axes2[k]) * spread, np.sqrt(axes2[1 - k]) * spread
    angle = np.degrees(np.arctan2(vectors[1, k], vectors[0, k])) % 180
    return float(centre[0] * spread + mean[0]), float(centre[1] * spread + mean[1]), float(long), float(short), float(angle)


def conic_to_ellipse(p: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """cx, cy, a >= b, degrees of the conic p . (x2, xy, y2, x, y, 1); None if it is no ellipse."""
    q = np.array([[p[0], p[1] / 2], [p[1] / 2, p[2]]])
    if np.linalg.det(q) <= 0:
        return None
    centre = np.linalg.solve(-2 * q, p[3:5])
    axes2 = -(p[5] + 0.5 * p[3:5] @ centre) / (found := np.linalg.eigh(q))[0]
    if not (axes2 > 0).all():
        return None
    k = int(np.argmax(axes2))
    v = found[1][:, k]
    return float(centre[0]), float(centre[1]), float(np.sqrt(axes2[k])), float(np.sqrt(axes2[1 - k])), float(np.degrees(np.arctan2(v[1], v[0])) % 180)


def fit_taubin(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """The conic of least algebraic distance over its mean squared gradient (Taubin); the direct fit where that is no ellipse."""
    if len(points) < 5:
        return None
    mean, spread = points.mean(axis=0), points.std() + 1e-12
    x, y = ((points - mean) / spread).T
    o, z = np.ones_like(x), np.zeros_like(x)
    d = np.stack([x * x, x * y, y * y, x, y, o], 1)
    gx, gy = np.stack([2 * x, y, z, o, z, z], 1), np.stack([z, x, 2 * y, z, o, z], 1)
    m, n = d.T @ d / len(x), (gx.T @ gx + gy.T @ gy) / len(x)
    # the constant has no gradient: it follows from the other five
    inner = m[:5, :5] - np.outer(m[:5, 5], m[5, :5]) / m[5, 5]
    try:
        values, vectors = np.linalg.eig(np.linalg.solve(n[:5, :5], inner))
    except np.linalg.LinAlgError:
        return fit_ellipse(points)
    own = np.real(vectors[:, np.argmin(np.where(np.isreal(values), np.real(values), np.inf))])
    found = conic_to_ellipse(np.append(own, -(m[5, :5] @ own) / m[5, 5]))
    if found is None:
        return fit_ellipse(points)
    cx, cy, a, b, rot = found
    return cx * spread + mean[0], cy * spread + mean[1], a * spread, b * spread, rot


def padded(points: list[np.ndarray]):
    """(which sets, their points, which of these are real), sets of like sizes together, in blocks of bounded size."""
    size = np.array([len(p) for p in points], int)
    order = np.argsort(size, kind="stable")
    k = 0
    while k < len(order):
        n = max(1, min(4096, 200_000 // max(1, int(size[order[min(k + 4095, len(order) - 1)]]))))
        own = order[k : k + n]
        use = np.arange(max(1, int(size[own].max())))[None] < size[own][:, None]
        xy = np.zeros((*use.shape, 2))
        if use.any():
            xy[use] = np.concatenate([points[i] for i in own])
        yield own, xy, use
        k += n


def ellipses_of(p: np.ndarray) -> np.ndarray:
    """cx, cy, a >= b, degrees of conics (rows), nan where they are no ellipses."""
    out = np.full((len(p), 5), np.nan)
    fine = np.flatnonzero(np.isfinite(p).all(axis=1) & (p[:, 0] * p[:, 2] - p[:, 1] ** 2 / 4 > 0))
    p = p[fine]
    q = np.stack([p[:, 0], p[:, 1] / 2, p[:, 1] / 2, p[:, 2]], 1).reshape(-1, 2, 2)
    centre = np.linalg.solve(-2 * q, p[:, 3:5, None])[:, :, 0]
    values, vectors = np.linalg.eigh(q)
    axes2 = -(p[:, 5] + 0.5 * (p[:, 3:5] * centre).sum(axis=1))[:, None] / values
    real, k = (axes2 > 0).all(axis=1), np.argmax(axes2, axis=1)
    rows = np.arange(len(p))
    with np.errstate(invalid="ignore"):
        found = np.column_stack([centre, np.sqrt(axes2[rows, k]), np.sqrt(axes2[rows, 1 - k]), np.degrees(np.arctan2(vectors[rows, 1, k], vectors[rows, 0, k])) % 180])
    out[fine[real]] = found[real]
    return out


def centred(xy: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y about their mean over their spread (0 where not used), ones where used, mean and spread of each set."""
    o = use.astype(float)
    n = o.sum(axis=1)
    mean = (xy * o[:, :, None]).sum(axis=1) / n[:, None]
    spread = np.sqrt((((xy - mean.mean(axis=1)[:, None, None]) ** 2) * o[:, :, None]).sum(axis=(1, 2)) / (2 * n)) + 1e-12
    x, y = np.moveaxis((xy - mean[:, None]) / spread[:, None, None] * o[:, :, None], 2, 0)
    return x, y, o, mean, spread


def direct_conics(x: np.ndarray, y: np.ndarray, o: np.ndarray) -> np.ndarray:
    d1, d2 = np.stack([x * x, x * y, y * y], 2), np.stack([x, y, o], 2)
    across = d1.transpose(0, 2, 1)
    s2 = across @ d2
    t = -np.linalg.solve(d2.transpose(0, 2, 1) @ d2, s2.transpose(0, 2, 1))
    values, vectors = np.linalg.eig(np.linalg.solve(np.array([[0, 0, 2], [0, -1, 0], [2, 0, 0]], float), across @ d1 + s2 @ t))
    real = np.real(vectors)
    fine = np.isreal(values) & (4 * real[:, 0] * real[:, 2] - real[:, 1] ** 2 > 0)
    own = real[np.arange(len(x)), :, np.argmax(fine, axis=1)]
    own[~fine.any(axis=1)] = np.nan
    return np.column_stack([own, (t @ own[:, :, None])[:, :, 0]])


def taubin_conics(x: np.ndarray, y: np.ndarray, o: np.ndarray) -> np.ndarray:
    z, count = np.zeros_like(x), o.sum(axis=1)[:, None, None]
    d = np.stack([x * x, x * y, y * y, x, y, o], 2)
    gx, gy = np.stack([2 * x, y, z, o, z], 2), np.stack([z, x, 2 * y, z, o], 2)
    m, n = d.transpose(0, 2, 1) @ d / count, (gx.transpose(0, 2, 1) @ gx + gy.transpose(0, 2, 1) @ gy) / count
    inner = m[:, :5, :5] - m[:, :5, 5:] * m[:, 5:, :5] / m[:, 5:, 5:]
    values, vectors = np.linalg.eig(np.linalg.solve(n, inner))
    k = np.argmin(np.where(np.isreal(values), np.real(values), np.inf), axis=1)
    own = np.real(vectors[np.arange(len(x)), :, k])
    return np.column_stack([own, -(m[:, 5, :5] * own).sum(axis=1) / m[:, 5, 5]])


def fit_all(points: list[np.ndarray], conics=direct_conics, alone=fit_ellipse) -> np.ndarray:
    """The fits (rows of cx, cy, a, b, degrees; nan: none) of many point sets, as `alone` fits one; what the batch cannot fit
    goes through `alone`."""
    out = np.full((len(points), 5), np.nan)
    for own, xy, use in padded([p if len(p) >= 5 else p[:0] for p in points]):
        own, xy, use = own[use.any(axis=1)], xy[use.any(axis=1)], use[use.any(axis=1)]
        if not len(own):
            continue
        try:
            x, y, o, mean, spread = centred(xy, use)
            found = ellipses_of(conics(x, y, o))
            out[own] = np.column_stack([found[:, :2] * spread[:, None] + mean, found[:, 2:4] * spread[:, None], found[:, 4]])
        except np.linalg.LinAlgError:
            pass
        for i in own[np.isnan(out[own, 0])]:
            out[i] = alone(points[i]) or (np.nan,) * 5
    return out


def foot_points(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of axis-parallel ellipses to (u, v), all 0 or more, a >= b: the root t of (a u / (t + a^2))^2 +
    (b v / (t + b^2))^2 = 1 above -b^2, which falls and is convex, so that Newton's steps from its left end never pass the root.
    Steps end when none moves by more than rounding does."""
    tiny = 1e-12 * a
    v = np.maximum(v, tiny)
    a2, b2 = a * a, b * b
    au, bv, t, least = a * u, b * v, -b2 + b * v, 1e-16 * a2
    for _ in range(steps):
        ta, tb = t + a2, t + b2
        p, q = (au / ta) ** 2, (bv / tb) ** 2
        move = np.maximum((p + q - 1) / (2 * (p / ta + q / tb)), 0)
        t = t + move
        if not (move > least).any():
            break
    x = np.minimum(a2 * u / (t + a2), a)
    return x, b * np.sqrt(np.maximum(1 - (x / a) ** 2, 0))


def fit_geometric_all(points: list[np.ndarray], steps: int = 60) -> np.ndarray:
    """Least squares of orthogonal distances from the direct fits on: Levenberg-Marquardt for all point sets together, each with
    its own damping. A distance changes with the ellipse as its foot point moves along the normal, which gives the slopes."""
    out = fit_all(points)
    some = np.flatnonzero(np.isfinite(out).all(axis=1) & (out[:, 2:4].min(axis=1) > 1e-9))
    for part, xy, use in padded([points[i] for i in some]):
        own, use = some[part], use.astype(float)
        p = np.column_stack([out[own, :2], np.log(out[own, 2:4]), np.radians(out[own, 4])])

        def distances(q: np.ndarray, xy: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b, c, s = np.exp(q[:, 2:3]), np.exp(q[:, 3:4]), np.cos(q[:, 4:5]), np.sin(q[:, 4:5])
            dx, dy = xy[:, :, 0] - q[:, 0:1], xy[:, :, 1] - q[:, 1:2]
            u, v = c * dx + s * dy, c * dy - s * dx
            long = a >= b
            pu, pv = np.where(long, np.abs(u), np.abs(v)), np.where(long, np.abs(v), np.abs(u))
            fu, fv = foot_points(pu, pv, np.maximum(a, b), np.minimum(a, b))
            x, y = np.copysign(np.where(long, fu, fv), u), np.copysign(np.where(long, fv, fu), v)
            nx, ny = x / (a * a), y / (b * b)
            size = np.hypot(nx, ny) + 1e-300
            nx, ny = nx / size, ny / size
            r = ((u - x) * nx + (v - y) * ny) * use
            turn = nx * y - ny * x  # of the foot point with the angle, against the normal
            j = np.stack([-(c * nx - s * ny), -(s * nx + c * ny), -nx * x, -ny * y, turn], axis=2) * use[:, :, None]
            return r, j

        live, damp = np.arange(len(own)), np.full(len(own), 1e-3)
        r, j = distances(p, xy, use)
        for _ in range(steps):
            across = j[live].transpose(0, 2, 1)
            lhs, rhs = across @ j[live], across @ r[live][:, :, None]
            diag = np.einsum("nii->ni", lhs)
            lhs = lhs + np.eye(5) * (damp[live, None] * diag + 1e-12)[:, :, None]
            step = -np.linalg.solve(lhs, rhs)[:, :, 0]
            new, slopes = distances(p[live] + step, xy[live], use[live])
            better = (new * new).sum(axis=1) < (r[live] ** 2).sum(axis=1)
            took = live[better]
            p[took] += step[better]
            r[took], j[took] = new[better], slopes[better]
            damp[live] = np.where(better, damp[live] / 3, damp[live] * 4)
            # after a step of no size more damping only makes it smaller
            live = live[~((np.abs(step).max(axis=1) < 1e-10) | (~better & (damp[live] > 1e10)))]
            if not len(live):
                break
        a, b, rot = np.exp(p[:, 2]), np.exp(p[:, 3]), np.degrees(p[:, 4])
        out[own] = np.column_stack([p[:, :2], np.maximum(a, b), np.minimum(a, b), np.where(a >= b, rot, rot + 90) % 180])
    return out


def fit_geometric(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    found = fit_geometric_all([points])[0]
    return None if np.isnan(found).any() else tuple(map(float, found))


#: Ways to fit an ellipse to points; each falls back on, or starts from, the direct one.
FITS = {"direct": fit_ellipse, "taubin": fit_taubin, "geometric": fit_geometric}
#: The same for a whole batch: rows, nan where there is none.
TOGETHER = {"direct": fit_all, "taubin": lambda points: fit_all(points, taubin_conics, fit_taubin), "geometric": fit_geometric_all}


#: Least and largest axis of a polar fit, weight of log(a / b), width of the quadratic part of the loss (fixed values).
POLAR_LEAST, POLAR_MOST, POLAR_RATIO, POLAR_WIDTH = 3.0, 500.0, 0.05, 0.05


def polar_start(theta: np.ndarray, radius: np.ndarray, use: np.ndarray) -> np.ndarray:
    """log a, log b, phi from the mean of log radius and its second harmonic, within the bounds."""
    n = use.sum(axis=1)
    log = np.where(use, np.log(np.where(use, radius, 1.0)), 0.0)
    mean = log.sum(axis=1) / n
    c, s = (((log - mean[:, None]) * np.where(use, f(2 * theta), 0.0)).sum(axis=1) * 2 / n for f in (np.cos, np.sin))
    size = np.hypot(c, s)
    axes = np.clip(np.stack([mean + size, mean - size], 1), np.log(POLAR_LEAST), np.log(POLAR_MOST))
    return np.column_stack([axes, np.arctan2(s, c) / 2])


def polar_terms(p: np.ndarray, cos: np.ndarray, sin: np.ndarray, inverse: np.ndarray, bent: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, gradient and matrix (xx, xy, yy, xz, yz, zz in log a, log b, phi) of profiles (rows): Huber's loss of the relative
    residuals of the radius and half the squared ratio term. The matrix weighs residuals beyond the width down, or (bent) holds the
    second derivatives. cos, sin: of twice the angles; inverse: 1 / radius, 0 where there is none.

    With d the angle from phi, D = b^2 cos^2 d + a^2 sin^2 d: log q = log(a b / sqrt(D) / radius) has the slopes x = b^2 cos^2 d / D,
    1 - x and t = (a^2 - b^2) cos d sin d / D; what x and t change by with phi is 2 (b^2 cos d sin d / D + x t) and
    2 t^2 - (a^2 - b^2) cos 2d / D."""
    a2, b2, c, s = np.exp(2 * p[:, 0:1]), np.exp(2 * p[:, 1:2]), np.cos(2 * p[:, 2:3]), np.sin(2 * p[:, 2:3])
    ahead, side, half = cos * c + sin * s, sin * c - cos * s, (a2 - b2) / 2
    below = 1 / ((a2 + b2) / 2 - half * ahead)
    q = np.sqrt(a2 * b2 * below) * inverse
    r = q - (inverse > 0)
    x, side, ahead = (ahead + 1) * below * (b2 / 2), side * below, ahead * below
    t = side * half
    pull = np.clip(r, -POLAR_WIDTH, POLAR_WIDTH)
    force, q2 = pull * q, q * q
    total = lambda v, w: np.einsum("np,np->n", v, w)

    def matrix(weight: np.ndarray) -> np.ndarray:
        wx, wt = weight * x, weight * t
        n, sx, st, xx, xt, tt = weight.sum(axis=1), wx.sum(axis=1), wt.sum(axis=1), total(wx, x), total(wx, t), total(wt, t)
        return np.stack([xx, sx - xx, n - 2 * sx + xx, xt, st - xt, tt])

    steep = POLAR_RATIO**2
    apart = steep * (p[:, 0] - p[:, 1])
    f, gx, gt = force.sum(axis=1), total(force, x), total(force, t)
    cost = total(pull, r) - 0.5 * total(pull, pull) + 0.5 * apart * (p[:, 0] - p[:, 1])
    ratio, size = np.array([steep, -steep, steep, 0.0, 0.0, 0.0])[:, None], np.abs(r)
    if bent:
        fx = force * x
        bend, turn = 2 * (gx - total(fx, x)), 2 * (total(force, side) * b2[:, 0] / 2 + total(fx, t))
        m = matrix((size <= POLAR_WIDTH) * q2 + force) + np.stack([-bend, bend, -bend, turn, -turn, 2 * total(force * t, t) - 2 * half[:, 0] * total(force, ahead)])
    else:
        m = matrix(POLAR_WIDTH / np.maximum(size, POLAR_WIDTH) * q2)
    return cost, np.stack([gx + apart, f - gx - apart, gt]), m + ratio


def solved(m: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The solutions (rows) of symmetric systems (xx, xy, yy, xz, yz, zz) of three, and which matrices are positive definite."""
    xx, xy, yy, xz, yz, zz = m
    minor, u, v, w = xx * yy - xy * xy, yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * u + xy * v + xz * w
    fine = (xx > 0) & (minor > 0) & (det > 0)
    k, l = xx * zz - xz * xz, xy * xz - xx * yz
    by = np.stack([u * g[0] + v * g[1] + w * g[2], v * g[0] + k * g[1] + l * g[2], w * g[0] + l * g[1] + minor * g[2]], 1)
    return by / np.where(fine, det, np.inf)[:, None], fine


def refine_polar(theta: np.ndarray, radius: np.ndarray, use: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, phi) with a >= b and phi in [0, pi), and the cost, of profiles (rows) of radii at the angles theta where `use`:
    Levenberg-Marquardt on (log a, log b, phi) within the bounds, all profiles together, each with its own damping, until steps are
    small; then Newton's steps. Where these do not settle, or at the bounds, the former go on to the end. Only profiles that
    still move are worked on."""
    low, high = np.log(POLAR_LEAST), np.log(POLAR_MOST)
    p = polar_start(theta, radius, use)
    order = np.argsort(~use, axis=1, kind="stable")[:, : max(1, int(use.sum(axis=1).max(initial=0)))]
    cos, sin = np.cos(2 * theta)[order], np.sin(2 * theta)[order]
    inverse = np.take_along_axis(np.where(use, 1 / np.where(use, radius, 1.0), 0.0), order, axis=1)
    cost = np.empty(len(p))

    def bounded(q: np.ndarray) -> np.ndarray:
        q[:, :2] = np.clip(q[:, :2], low, high)
        return q

    def damped(live: np.ndarray, little: float) -> None:
        damp, at, own = np.full(len(live), 1e-3), p[live], (cos[live], sin[live], inverse[live])
        price, slope, lhs = polar_terms(at, *own)
        for _ in range(steps):
            more = lhs.copy()
            more[[0, 2, 5]] += damp * lhs[[0, 2, 5]] + 1e-12
            new = bounded(at - solved(more, slope)[0])
            fresh, g, m = polar_terms(new, *own)
            better, moved = fresh < price, np.abs(new - at).max(axis=1)
            at[better], price[better], slope[:, better], lhs[:, better] = new[better], fresh[better], g[:, better], m[:, better]
            damp = np.where(better, damp / 3, damp * 4)
            go = ~np.where(better, moved < little, damp > 1e6)
            if not go.all():
                p[live], cost[live] = at, price
                live, at, price, slope, lhs, damp, own = live[go], at[go], price[go], slope[:, go], lhs[:, go], damp[go], tuple(z[go] for z in own)
            if not len(live):
                return
        p[live], cost[live] = at, price

    def shrunk(live: np.ndarray, newton: bool) -> np.ndarray:
        """Steps that shrink slopes, which still tell where costs are equal to the last digit; which profiles did not settle."""
        at, own, loose = p[live], (cos[live], sin[live], inverse[live]), []
        price, slope, m = polar_terms(at, *own, newton)
        for _ in range(40):
            step, fine = solved(m, slope)
            new = bounded(at - step)
            fresh, g, n = polar_terms(new, *own, newton)
            better = fine & (np.abs(g).max(axis=0) < np.abs(slope).max(axis=0)) & (fresh <= price + 1e-9 * (1 + price))
            loose.append(live[~better & (~fine | (np.abs(step).max(axis=1) > 1e-11))])
            live, at, own, price, slope, m = live[better], new[better], tuple(z[better] for z in own), fresh[better], g[:, better], n[:, better]
            p[live], cost[live] = at, price
            if not len(live):
                break
        return np.concatenate([*loose, live])

    damped(np.arange(len(p)), 3e-3)
    inside = ((p[:, :2] > low) & (p[:, :2] < high)).all(axis=1)
    left = np.concatenate([np.flatnonzero(~inside), shrunk(np.flatnonzero(inside), True)])
    if len(left):
        damped(left, 1e-8)
        shrunk(left, False)
    a, b, phi = np.exp(p[:, 0]), np.exp(p[:, 1]), p[:, 2]
    swap = a < b
    return np.column_stack([np.where(swap, b, a), np.where(swap, a, b), (phi + np.where(swap, np.pi / 2, 0.0)) % np.pi]), cost


def plane_udf(f, returns: str):
    """A column function of (plane, h, w) from a NumPy function of an h by w array."""

    @F.pandas_udf(returns)
    def run(planes: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(np.asarray(p, float).reshape(int(y), int(x)))).ravel().tolist() for p, y, x in zip(planes, h, w)])

    return run


def labels_of(plane, h: int, w: int, threshold: float, connectivity: int = 2) -> Column:
    return plane_udf(lambda a: components(a > threshold, connectivity), "array<int>")(plane, F.lit(h), F.lit(w))


def distance_of(plane, h: int, w: int, threshold: float) -> Column:
    return plane_udf(lambda a: distance(a > threshold), "array<double>")(plane, F.lit(h), F.lit(w))


def signed_distance_of(plane, h: int, w: int, threshold: float) -> Column:
    """(Distance outside - distance inside) over the diagonal, in [-1, 1]; 50 where the mask is empty or full."""

    def signed(a):
        m = a > threshold
        return np.full(a.shape, 50.0) if m.all() or not m.any() else np.clip((distance(~m) - distance(m)) / np.hypot(*a.shape), -1, 1)

    return plane_udf(signed, "array<double>")(plane, F.lit(h), F.lit(w))


def basins(core: np.ndarray, whole: np.ndarray, threshold: float) -> np.ndarray:
    """Regions of the whole plane's mask, flooded by its distance from the parts of the core plane's mask."""
    mask = whole > threshold
    return watershed(-distance(mask), components(core > threshold), mask)


def basins_all(cores: np.ndarray, wholes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for planes (planes, h, w), flooded together on one canvas with a line between them: labels that go on from plane
    to plane, and the last label before each plane. Values and arrivals of a plane keep their order among the others'."""
    canvas = lambda planes: np.pad(planes, ((0, 0), (0, 1), (0, 0))).reshape(-1, planes.shape[2])
    mask, markers = wholes > threshold, components(canvas(cores > threshold))
    labels = watershed(canvas(-distances(mask)), markers, canvas(mask))
    last = np.maximum.accumulate(markers.reshape(len(mask), -1).max(axis=1, initial=0))
    return labels.reshape(len(mask), -1, mask.shape[2])[:, :-1], np.append(0, last[:-1])


def watershed_of(core, whole, h: int, w: int, threshold: float) -> Column:
    """Regions of the whole plane's mask, flooded by its distance from the parts of the core plane's mask."""

    @F.pandas_udf("array<int>")
    def flooded(cores: pd.Series, wholes: pd.Series) -> pd.Series:
        return pd.Series([basins(*(np.asarray(p, float).reshape(h, w) for p in planes), threshold).ravel().tolist() for planes in zip(cores, wholes)])

    return flooded(core, whole)


def height_of(plane, h: int, w: int) -> Column:
    return plane_udf(height_from_gradient, "array<double>")(plane, F.lit(h), F.lit(w))


def thickness_of(plane, h: int, w: int, threshold: float) -> Column:
    return plane_udf(lambda a: [thickness(a > threshold)], "array<int>")(plane, F.lit(h), F.lit(w))[0]


def region_properties(labelled: DataFrame, key: str) -> DataFrame:
    """For each label of pixel rows (key, y, x, label > 0): area, box, centroid, axes and eccentricity from moments."""
    rows = labelled.where("label > 0")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    sums = rows.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"),
        F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("vxy"),
    )
    half, diff = (F.col("vy") + F.col("vx")) / 2, (F.col("vy") - F.col("vx")) / 2
    root = F.sqrt(diff * diff + F.col("vxy") * F.col("vxy"))
    long, short = F.sqrt(F.greatest(F.lit(0.0), half + root)) * 4, F.sqrt(F.greatest(F.lit(0.0), half - root)) * 4
    out = sums.withColumns({"major": long, "minor": short})
    ratio = F.try_divide("minor", "major")
    return out.withColumn("eccentricity", F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio)), F.lit(0.0))).drop("vy", "vx", "vxy")


def hulls(labelled: DataFrame, key: str) -> DataFrame:
    """key, label, area, hull area and solidity of each label; the pixels of one region come together."""
    rows = labelled.where("label > 0").groupBy(key, "label").agg(F.collect_list(F.struct("x", "y")).alias("points"))

    @F.pandas_udf("double")
    def area(points: pd.Series) -> pd.Series:
        return pd.Series([hull_area(np.array([[p["x"], p["y"]] for p in ps], float)) for ps in points])

    return rows.select(key, "label", F.size("points").alias("area"), area("points").alias("hull")).withColumn("solidity", F.col("area") / F.col("hull"))


def angular_samples(points: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """The outermost point (x, y) about (cx, cy) in each of `bins` sectors, in their order; the first by (y, x) of equals."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    angle = F.atan2(dy, dx)
    sector = F.least(F.lit(bins - 1), F.floor((angle + F.lit(np.pi)) / (2 * np.pi) * bins)).cast("int")
    best = points.select(*keys, "x", "y", sector.alias("sector"), (dx * dx + dy * dy).alias("r2")).groupBy(*keys, "sector").agg(F.max(F.struct("r2", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m"))
    return best.select(*keys, "sector", (-F.col("m.nx")).alias("x"), (-F.col("m.ny")).alias("y"))


def fits(points: DataFrame, keys: list[str], method: str = "direct") -> DataFrame:
    """keys and fit (cx, cy, a, b, rot; null if it fails) of each point set; the points of one candidate come together."""
    together = TOGETHER[method]
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))

    @F.pandas_udf("struct<cx:double,cy:double,a:double,b:double,rot:double>")
    def fit(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = together([np.column_stack([p, q]).astype(float) for p, q in zip(x, y)])
        return pd.DataFrame(found, columns=["cx", "cy", "a", "b", "rot"]).astype(object).where(np.isfinite(found), None)

    return rows.select(*keys, fit("points.x", "points.y").alias("fit"))


def angular_profile_of(points: DataFrame, keys: list[str], bins: int, name: str) -> DataFrame:
    """keys, name and <name>_sector: the largest radius about (cx, cy) in each sector that has points, and the sectors, as arrays."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sector = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.atan2(dy, dx) + F.lit(np.pi)) / (2 * np.pi / bins)).cast("int")))
    radii = points.select(*keys, sector.alias("sector"), F.sqrt(dx * dx + dy * dy).alias("r")).groupBy(*keys, "sector").agg(F.max("r").alias("r"))
    both = radii.groupBy(*keys).agg(F.collect_list(F.struct("sector", "r")).alias("_p"))
    return both.select(*keys, F.col("_p.r").alias(name), F.col("_p.sector").alias(f"{name}_sector"))


def profile_rows(radii: pd.Series, sectors: pd.Series, bins: int) -> np.ndarray:
    """Profiles (rows) by sector, nan where there is none; a null is a profile without any."""
    out = np.full((len(radii), bins), np.nan)
    size = [0 if r is None else len(r) for r in radii]
    if sum(size):
        rows = np.repeat(np.arange(len(radii)), size)
        out[rows, np.concatenate([s for s in sectors if s is not None])] = np.concatenate([r for r in radii if r is not None])
    return out


def polar_rows(radius: np.ndarray, core: np.ndarray, cored: np.ndarray, share: float = 0.3, margin: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """a, b, phi, cost (nan: none) and counted sectors of profiles (lines; nan: no point) over core profiles where there are any
    (cored); see polar_fits."""
    bins = radius.shape[1]
    theta, out = (np.arange(bins) + 0.5) * 2 * np.pi / bins - np.pi, np.full((len(radius), 4), np.nan)
    use = np.isfinite(radius) & (~cored[:, None] | (radius > core + margin))
    n = use.sum(axis=1)
    middle = np.sort(np.where(use, radius, np.inf), axis=1)[np.arange(len(radius)), np.minimum(n // 2, bins - 1)]
    fine = np.flatnonzero((n >= max(10, int(share * bins))) & (middle >= POLAR_LEAST))
    if len(fine):
        out[fine] = np.column_stack(refine_polar(theta, radius[fine], use[fine]))
    return out, n


def polar_fits(points: DataFrame, keys: list[str], bins: int = 120, *, core: DataFrame | None = None, support: float = 0.5, share: float = 0.3, margin: float = 1.0) -> DataFrame:
    """keys, a, b, phi, cost, n of the polar fit to each candidate's outer profile: the largest radius of its points about (cx, cy)
    in each sector. With core points (keys, x, y, cx, cy) a sector counts only where the outer radius exceeds the core's by
    more than `margin`; candidates without core points count every sector. Left out are candidates with outer points in under
    `support` of the sectors, with under `share` of them (or ten) counted, with a median radius under 3, or of a plane's noise
    (an axis under 3)."""
    outer = angular_profile_of(points, keys, bins, "outer")
    inner = angular_profile_of(core, keys, bins, "inner") if core is not None else None
    rows = outer.join(inner, keys, "left") if inner is not None else outer.withColumns({"inner": F.lit(None).cast("array<double>"), "inner_sector": F.lit(None).cast("array<int>")})

    @F.pandas_udf("struct<a:double,b:double,phi:double,cost:double,n:int>")
    def fit(outer: pd.Series, outer_at: pd.Series, inner: pd.Series, inner_at: pd.Series) -> pd.DataFrame:
        out, count = np.full((len(outer), 4), np.nan), np.zeros(len(outer), int)
        for k in range(0, len(outer), 2048):
            part = slice(k, k + 2048)
            radius, core = profile_rows(outer.iloc[part], outer_at.iloc[part], bins), profile_rows(inner.iloc[part], inner_at.iloc[part], bins)
            out[part], count[part] = polar_rows(radius, core, np.array([r is not None for r in inner.iloc[part]]), share, margin)
        return pd.DataFrame({**dict(zip(("a", "b", "phi", "cost"), out.T)), "n": count})

    found = rows.where(F.size("outer") >= support * bins)
    return found.select(*keys, fit("outer", "outer_sector", "inner", "inner_sector").alias("fit")).select(*keys, "fit.*").where("not isnan(a) and b >= 3")


def mixed(z: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits mixed (the finalizer of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def parts_of(draw: np.ndarray, use: np.ndarray, trials: int, share: float) -> np.ndarray:
    """Random parts (lines, trials, points) of int(share n) of the n points of each line: those whose number, mixed from the line's
    draw, trial and place, is least."""
    n, m = use.shape
    place = np.arange(1, trials * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = mixed(mixed(draw.astype(np.uint64))[:, None] + place).reshape(n, trials, m) >> np.uint64(1)
    drawn = np.where(use[:, None], drawn, np.uint64(2**64 - 1))
    take = (share * use.sum(axis=1)).astype(int)
    last = np.sort(drawn, axis=2)[np.arange(n), :, np.maximum(take - 1, 0)]
    return (drawn <= last[:, :, None]) & (take > 0)[:, None, None]


def ellipses_of_moments(q: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The direct fits (last axis cx, cy, a >= b, radians; nan: none) to point sets given by the sums of x^i y^k, i + k up to 4. The
    conic is the one vector of S - l C without extent for the one l > 0, S the scatter of x2, xy, y2 once the linear part is
    taken out and C the constraint; l is the largest root of a cubic."""
    a, b, c, d, e, f = q[2, 0], q[1, 1], q[1, 0], q[0, 2], q[0, 1], q[0, 0]
    i00, i01, i02, i11, i12, i22 = d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b
    with np.errstate(all="ignore"):
        det = a * i00 + b * i01 + c * i02
        rows = [(q[3, 0], q[2, 1], q[2, 0]), (q[2, 1], q[1, 2], q[1, 1]), (q[1, 2], q[0, 3], q[0, 2])]
        t = [(-(i00 * x + i01 * y + i02 * z) / det, -(i01 * x + i11 * y + i12 * z) / det, -(i02 * x + i12 * y + i22 * z) / det) for x, y, z in rows]
        out_of = lambda k, m: rows[k][0] * t[m][0] + rows[k][1] * t[m][1] + rows[k][2] * t[m][2]
        s00, s01, s02 = q[4, 0] + out_of(0, 0), q[3, 1] + out_of(0, 1), q[2, 2] + out_of(0, 2)
        s11, s12, s22 = q[2, 2] + out_of(1, 1), q[1, 3] + out_of(1, 2), q[0, 4] + out_of(2, 2)
        c0 = s11 * (s00 * s22 - s02 * s02) - s00 * s12 * s12 - s01 * s01 * s22 + 2 * s01 * s12 * s02
        c1, c2 = s00 * s22 - 4 * s01 * s12 - s02 * s02 + 4 * s02 * s11, 4 * (s02 - s11)
        third = c2 / 12
        down, side = np.maximum(c1 / 4 + 3 * third * third, 0.0), 2 * third**3 + third * c1 / 4 + c0 / 4
        root = third + 2 * np.sqrt(down / 3) * np.cos(np.arccos(np.clip(1.5 * side / down * np.sqrt(3 / down), -1, 1)) / 3)
        for _ in range(2):
            slope = c1 + root * (2 * c2 - 12 * root)
            root = root - (c0 + root * (c1 + root * (c2 - 4 * root))) / np.where(slope == 0, np.inf, slope)
        m02, m11 = s02 - 2 * root, s11 + root
        adjoint = [(m11 * s22 - s12 * s12, s12 * m02 - s01 * s22, s01 * s12 - m11 * m02), (s12 * m02 - s01 * s22, s00 * s22 - m02 * m02, s01 * m02 - s00 * s12), (s01 * s12 - m11 * m02, s01 * m02 - s00 * s12, s00 * m11 - s01 * s01)]
        size = np.stack([x * x + y * y + z * z for x, y, z in adjoint])
        best = np.argmax(np.nan_to_num(size), axis=0)
        xx, xy, yy = (np.choose(best, [v[k] for v in adjoint]) for k in range(3))
        sign = np.sign(xx + yy) / np.sqrt(size.max(axis=0))
        xx, xy, yy = xx * sign, xy * sign, yy * sign
        x, y, o = (xx * t[0][k] + xy * t[1][k] + yy * t[2][k] for k in range(3))
        area = 4 * xx * yy - xy * xy
        cx, cy = (xy * y - 2 * yy * x) / area, (xy * x - 2 * xx * y) / area
        level = -(o + 0.5 * (x * cx + y * cy))
        large = (xx + yy) / 2 + np.hypot((xx - yy) / 2, xy / 2)
        found = np.stack([cx, cy, np.sqrt(4 * level * large / area), np.sqrt(level / large), (np.arctan2(xy, xx - yy) + np.pi) / 2], axis=-1)
        found[~((area > 0) & (level > 0) & np.isfinite(found).all(axis=-1))] = np.nan
    return found


STABILITY = [f"stab_{n}" for n in ("jitter_a", "jitter_b", "jitter_theta", "center_shift", "iou_subsample")]


def stability_rows(x: np.ndarray, y: np.ndarray, use: np.ndarray, e: np.ndarray, draw: np.ndarray, trials: int = 5, share: float = 0.8) -> np.ndarray:
    """The five values of `stability` for point sets (lines, where `use`) and their ellipses (cx, cy, a, b, degrees)."""
    out = np.ones((len(x), 5))
    own = np.flatnonzero(use.sum(axis=1) >= 10)
    if not len(own):
        return out
    x, y, o, mean, size = centred(np.stack([x[own], y[own]], 2), use[own])
    real, place, parts = e[own][:, None], [(i, k) for i in range(5) for k in range(5 - i)], parts_of(draw[own], use[own], trials, share)
    px, py = [o, x, x * x, x**3, x**4], [o, y, y * y, y**3, y**4]
    sums = parts.astype(float) @ np.stack([px[i] * py[k] for i, k in place], 2)
    found = ellipses_of_moments({p: sums[:, :, n] for n, p in enumerate(place)})
    size, mean = size[:, None], mean[:, None]
    shift = np.hypot(found[..., 0] * size + mean[..., 0] - real[..., 0], found[..., 1] * size + mean[..., 1] - real[..., 1]) / (np.sqrt(real[..., 2] * real[..., 3]) + 1e-6)
    turn = np.abs(found[..., 4] % np.pi - np.radians(real[..., 4]) % np.pi)
    axes = [np.abs(found[..., c] * size - real[..., c]) / (real[..., c] + 1e-6) for c in (2, 3)]
    moved, fine = np.stack([*axes, np.minimum(turn, np.pi - turn), shift], 2), ~np.isnan(found[..., 0])
    some = fine.any(axis=1)
    mean = np.where(fine[..., None], moved, 0.0).sum(axis=1)[some] / fine.sum(axis=1)[some, None]
    out[own[some]] = np.column_stack([mean, 1 / (1 + mean[:, 0] + mean[:, 1])])
    return out


def stability(points: DataFrame, keys: list[str], *, trials: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """How far fits to random parts of a candidate's points (x, y) lie from its ellipse (a, b, rot about cx, cy): mean
    relative change of the axes, of the angle, of the centre, and 1 / (1 + both axes' changes); 1 under 10 points."""
    rows = points.groupBy(*keys).agg(F.first(F.struct("cx", "cy", "a", "b", "rot")).alias("e"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"), F.xxhash64(*[F.first(k) for k in keys], F.lit(seed)).alias("draw"))

    @F.pandas_udf(", ".join(f"{n} double" for n in STABILITY))
    def refit(e: pd.DataFrame, x: pd.Series, y: pd.Series, draw: pd.Series) -> pd.DataFrame:
        out, ours, draws = np.ones((len(draw), 5)), e[["cx", "cy", "a", "b", "rot"]].to_numpy(float), draw.to_numpy(np.int64).view(np.uint64)
        for own, xy, use in padded([np.column_stack([p, q]).astype(float) for p, q in zip(x, y)]):
            out[own] = stability_rows(xy[:, :, 0], xy[:, :, 1], use, ours[own], draws[own], trials, share)
        return pd.DataFrame(out, columns=STABILITY)

    return rows.select(*keys, refit("e", "points.x", "points.y", "draw").alias("s")).select(*keys, "s.*")


def guarded(rows: DataFrame, width: int, height: int, *, least: int = 20) -> DataFrame:
    """rows (an ellipse; _a, _b, _phi, _n: its refit and number of points, null where there is none) with the refitted axes where
    there are `least` points, both are 3 or more, the box lies inside the image and no axis exceeds 0.6 of the longer side; else
    the original; refitted: which."""
    r = F.greatest("_a", "_b")
    inside = (F.col("cx") - r >= 0) & (F.col("cy") - r >= 0) & (F.col("cx") + r < width) & (F.col("cy") + r < height)
    fine = F.coalesce((F.col("_n") >= least) & (F.least("_a", "_b") >= 3) & inside & (r <= 0.6 * max(width, height)), F.lit(False))
    pick = {c: F.when(fine, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("a", "b")} | {"rot": F.when(fine, F.degrees("_phi")).otherwise(F.col("rot")), "refitted": fine}
    return rows.withColumns(pick).drop("_a", "_b", "_phi", "_n")


def guarded_refit(original: DataFrame, refit: DataFrame, keys: list[str], width: int, height: int, *, least: int = 20) -> DataFrame:
    """The refitted axes (a, b, phi, n points) where the guard lets them; else the original."""
    new = refit.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("a", "b", "phi", "n")])
    return guarded(original.join(new, keys, "left"), width, height, least=least).select(*original.columns, "refitted")
