"""Ellipse geometry as columns. An ellipse is (cx, cy, a, b, rot): centre, semi-axes, rotation in degrees.

Null inputs give null; but for the orthogonal distance, NumPy over Arrow batches, all stays in generated code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

XI2_LIMIT, PIXEL_RATIO, AXIS_FACTOR = 13.277, 0.07, 0.85  # fixed values of the scoring rule
PI = 3.141592653589793


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if not isinstance(c, Column) else c


def configuration(a, b, rot) -> tuple[Column, Column, Column]:
    """y11, y12, y22 of R diag(1/a^2, 1/b^2) R^T."""
    a, b, t = col(a), col(b), F.radians(col(rot))
    p, q = 1.0 / (a * a), 1.0 / (b * b)
    c, s = F.cos(t), F.sin(t)
    return c * c * p + s * s * q, c * s * (p - q), s * s * p + c * c * q


def gaussian_angle(t: tuple, p: tuple, guard: float | None = None, guarded: float = PI) -> Column:
    """Gaussian angle between two ellipses (cx, cy, a, b, rot). Where det(Yi + Yj) < guard the angle is `guarded`."""
    return angle_between((*t[:2], *configuration(*t[2:])), (*p[:2], *configuration(*p[2:])), guard, guarded)


def angle_between(t: tuple, p: tuple, guard: float | None = None, guarded: float = PI) -> Column:
    """The same from centres and matrices (cx, cy, y11, y12, y22), which a join should find ready as columns: a filter on
    the angle is pushed below it, with all that the angle is made of."""
    i11, i12, i22, j11, j12, j22 = map(col, (*t[2:], *p[2:]))
    dx, dy = col(t[0]) - col(p[0]), col(t[1]) - col(p[1])
    s11, s12, s22 = i11 + j11, i12 + j12, i22 + j22
    det = s11 * s22 - s12 * s12
    v1, v2 = j11 * dx + j12 * dy, j12 * dx + j22 * dy
    w1, w2 = i11 * dx + i12 * dy, i12 * dx + i22 * dy
    e = -0.5 * (s22 * v1 * w1 - s12 * (v2 * w1 + v1 * w2) + s11 * v2 * w2) / det
    scale = 4.0 * F.sqrt((i11 * i22 - i12 * i12) * (j11 * j22 - j12 * j12)) / det
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scale * F.exp(e))))
    return angle if guard is None else F.when(det < guard, F.lit(guarded)).otherwise(angle)


def xi_squared(angle, a, b, soft: float = 0.0, floor: float = 0.0) -> Column:
    """Squared angle in units of the truth's tolerance; soft and floor keep degenerate axes finite."""
    a, b = col(a), col(b)
    ref = AXIS_FACTOR / (F.sqrt(a * b) + soft) * PIXEL_RATIO * F.least(a, b)
    return F.pow(col(angle), F.lit(2.0)) / (ref * ref + floor)


def near(t: tuple, p: tuple) -> Column:
    """The cheap gate before the angle: small axes within a factor 1.5 and centres within the smaller one."""
    rt, rp = F.least(col(t[2]), col(t[3])), F.least(col(p[2]), col(p[3]))
    r = F.least(rt, rp)
    return (rt <= 1.5 * rp) & (rp <= 1.5 * rt) & (F.abs(col(t[0]) - col(p[0])) <= r) & (F.abs(col(t[1]) - col(p[1])) <= r)


def local_frame(x, y, cx, cy, rot) -> tuple[Column, Column]:
    t, dx, dy = F.radians(col(rot)), col(x) - col(cx), col(y) - col(cy)
    return F.cos(t) * dx + F.sin(t) * dy, F.cos(t) * dy - F.sin(t) * dx


def algebraic_distance(x, y, cx, cy, a, b, rot) -> Column:
    u, v = local_frame(x, y, cx, cy, rot)
    p, q = u / F.greatest(col(a), F.lit(1e-4)), v / F.greatest(col(b), F.lit(1e-4))
    return F.abs(p * p + q * q - 1.0)


def perimeter_point(cx, cy, a, b, rot, angle) -> tuple[Column, Column]:
    t, k = F.radians(col(rot)), col(angle)
    u, v = col(a) * F.cos(k), col(b) * F.sin(k)
    return col(cx) + u * F.cos(t) - v * F.sin(t), col(cy) + u * F.sin(t) + v * F.cos(t)


def bounding_half(a, b, rot) -> tuple[Column, Column]:
    """Half width and height of the rotated ellipse's box."""
    a, b, t = col(a), col(b), F.radians(col(rot))
    c, s = F.cos(t), F.sin(t)
    return F.sqrt(a * a * c * c + b * b * s * s), F.sqrt(a * a * s * s + b * b * c * c)


def rectangle_half(a, b, rot) -> tuple[Column, Column]:
    """Half width and height of the box of the rotated rectangle around the ellipse."""
    a, b, t = col(a), col(b), F.radians(col(rot))
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    return a * c + b * s, a * s + b * c


def polar_radius(theta, a, b, phi=0.0) -> Column:
    d = col(theta) - col(phi)
    p, q = col(b) * F.cos(d), col(a) * F.sin(d)
    return col(a) * col(b) / (F.sqrt(p * p + q * q) + 1e-9)


def eccentricity(a, b) -> Column:
    r = col(b) / (col(a) + 1e-6)
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - r * r))


def eccentricity_floor(a, b, least: float = 0.15) -> Column:
    """The second axis, scaled so that the eccentricity is at least `least`."""
    a, b = col(a), col(b)
    big, small = F.greatest(a, b), F.least(a, b)
    e = F.sqrt(F.greatest(F.lit(0.0), 1.0 - (small / big) * (small / big)))
    return F.when(e < least, b * (big * F.sqrt(F.lit(1.0 - least * least)) / small)).otherwise(b)


def overlap(x1, y1, a1, b1, x2, y2, a2, b2) -> Column:
    """A rough overlap: the ratio of areas where centres are near, else 0."""
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    d = F.sqrt(dx * dx + dy * dy)
    r = F.greatest(F.greatest(col(a1), col(b1)), F.greatest(col(a2), col(b2)))
    s1, s2 = col(a1) * col(b1), col(a2) * col(b2)
    return F.when(d < 0.8 * r, F.least(s1, s2) / F.greatest(s1, s2)).otherwise(F.lit(0.0))


def perimeter(a, b) -> Column:
    """Ramanujan's first approximation."""
    a, b = col(a), col(b)
    return F.lit(PI) * (3.0 * (a + b) - F.sqrt((3.0 * a + b) * (a + 3.0 * b)))


def circularity(area, length) -> Column:
    return F.when(col(length) > 0, 4.0 * PI * col(area) / (col(length) * col(length))).otherwise(F.lit(0.0))


def continuity(area, length) -> Column:
    return F.when(col(area) > 0, col(length) / col(area)).otherwise(F.lit(0.0))


def sigmoid(x, clamp: float | None = None) -> Column:
    x = col(x) if clamp is None else F.greatest(F.lit(-clamp), F.least(F.lit(clamp), col(x)))
    return 1.0 / (1.0 + F.exp(-x))


def orthogonal_distance(x, y, cx, cy, a, b, rot, steps: int = 60) -> Column:
    """Distance from a point to the ellipse. With u, v the point in the ellipse's frame (by symmetry 0 or more, u along the longer
    axis) the foot point belongs to the one root t > -b^2 of (a u / (t + a^2))^2 + (b v / (t + b^2))^2 = 1, whose left side falls
    all the way; it is halved in from both sides, which no point, shape or start can mislead. Of an ellipse without extent the
    distance to its centre."""
    u, v = local_frame(x, y, cx, cy, rot)

    @F.pandas_udf("double")
    def nearest(u: pd.Series, v: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        u, v, a, b = (np.abs(c.to_numpy(float)) if k < 2 else c.to_numpy(float) for k, c in enumerate((u, v, a, b)))
        with np.errstate(all="ignore"):
            u, v, a, b = np.where(a < b, v, u), np.where(a < b, u, v), np.maximum(a, b), np.minimum(a, b)
            a2, b2, au, bv = a * a, b * b, a * u, b * v
            lo, hi = bv - b2, np.hypot(au, bv) - b2
            for _ in range(steps):
                t = (lo + hi) / 2
                p, q = au / (t + a2), bv / (t + b2)
                above = p * p + q * q > 1
                lo, hi = np.where(above, t, lo), np.where(above, hi, t)
            foot = a2 * u / (hi + a2)
            foot = np.minimum(a, np.where(np.isfinite(foot), foot, 0.0))
            far = np.hypot(foot - u, b * np.sqrt(np.maximum(0.0, 1 - (foot / a) ** 2)) - v)
            out = pd.Series(np.where(b < 1e-6, np.hypot(u, v), far))
        return out.astype(object).where(~(np.isnan(u) | np.isnan(v) | np.isnan(a) | np.isnan(b)), None)

    return nearest(u, v, col(a), col(b))


def polar_score(support, residual, separation, gap) -> Column:
    """Composite score of a polar candidate: hard gates, then a weighted sum of bounded terms."""
    support, residual, separation, gap = map(col, (support, residual, separation, gap))
    one = F.lit(1.0)
    total = 0.35 * support + 0.30 * (1.0 - F.least(one, residual)) + 0.20 * (1.0 - F.least(one, separation)) + 0.15 * (1.0 - F.least(one, gap))
    return F.when((support < 0.6) | (residual > 0.5) | (gap > 0.25), F.lit(0.0)).otherwise(total)
