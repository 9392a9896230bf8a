"""Point sets of many candidates as padded NumPy blocks: a line is a candidate, a column a point.

Points that a query makes from a candidate's row never become rows in Spark: `asked` makes them batch by batch with one function,
asks them with another, and gives back a row for each candidate. Features and fits here are those of features.py and segment.py
over points as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rimfold.operators import segment
from rimfold.operators.features import CLASSIFIER, ELLIPSE, GEOMETRY, RIM

TURN = 2 * np.pi


@dataclass
class Sets:
    """The points of candidates: x, y, p where `use`; cx, cy, a, b, rot are one column, or one for each point where rows of one key
    are one set. rows: the rows (lines of the columns) that each set is made of; key as Arrow, and as numbers (0 for null)."""

    rows: np.ndarray
    key: pa.Array
    number: np.ndarray
    e: dict[str, np.ndarray]
    x: np.ndarray
    y: np.ndarray
    p: np.ndarray
    use: np.ndarray

    def own(self, name: str) -> np.ndarray:
        return self.e[name][:, 0]

    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """The points in the frame of their ellipse."""
        t, dx, dy = np.radians(self.e["rot"]), self.x - self.e["cx"], self.y - self.e["cy"]
        c, s = np.cos(t), np.sin(t)
        return c * dx + s * dy, c * dy - s * dx


def numbers(column: pa.Array) -> np.ndarray:
    """Integers with 0 for null, doubles with nan."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.fill_null(0) if pa.types.is_integer(column.type) else column).to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch], whole: str, most: int) -> Iterator[pa.Table]:
    """The rows, sorted by `whole`, in tables of about `most` that hold all rows of one value."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = numbers(batch[whole])
        start = np.flatnonzero(np.append(not rest or numbers(rest[-1][whole])[-1] != k[0], k[1:] != k[:-1]))
        end = int(start[0]) if len(start) else batch.num_rows
        if end:
            rest.append(batch.slice(0, end))
        if not len(start):
            continue
        if rest:
            yield pa.Table.from_batches(rest)
        at, last = end, int(start[-1])
        while at < last:
            to = int(start[min(np.searchsorted(start, at + most), len(start) - 1)])
            yield pa.Table.from_batches([batch.slice(at, to - at)])
            at = to
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def sets_of(table: pa.Table, key: str, draw: Callable) -> Iterator[Sets]:
    """The sets of rows sorted by key, those of equally many rows together."""
    columns = {n: numbers(table[n]) for n in table.column_names}
    keys = table[key].combine_chunks()
    known = keys.is_valid().to_numpy(zero_copy_only=False)
    x, y, p, use = draw(columns)
    use = use & known[:, None]
    k = columns[key]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (known[1:] != known[:-1])))
    size = np.diff(np.append(first, len(k)))
    for times in np.unique(size):
        rows = first[size == times][:, None] + np.arange(times)
        e = {c: columns[c][rows] if times == 1 else np.repeat(columns[c][rows], x.shape[1], axis=1) for c in ELLIPSE}
        yield Sets(rows, keys.take(pa.array(rows[:, 0])), k[rows[:, 0]], e, *[z[rows].reshape(len(rows), -1) for z in (x, y, p, use)])


def asked(rows: DataFrame, key: str, draw: Callable, ask: Callable, returns: str, *, whole: str | None = None, most: int = 2048) -> DataFrame:
    """What `ask` finds (columns by name, for each list of sets) in the sets of rows (key, cx, cy, a, b, rot). Rows of one `whole`
    (the key where none is given) are in one partition already, and all sets of it come to `ask` together."""
    whole = whole or key

    def run(batches):
        for table in pieces(batches, whole, most):
            for found in ask([s for s in sets_of(table, key, draw)]):
                yield pa.RecordBatch.from_pydict({n: v if isinstance(v, pa.Array) else pa.array(v, from_pandas=True) for n, v in found.items()})

    return rows.sortWithinPartitions(*dict.fromkeys((whole, key))).mapInArrow(run, returns)


def each(f: Callable[[Sets], dict]) -> Callable:
    """An `ask` for sets on their own, those that have points."""
    return lambda found: (f(some(s)) for s in found if s.use.any())


def quantile(ordered: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Of the first n values of sorted lines, between neighbours in proportion."""
    at = np.maximum(n - 1, 0) * q
    low = np.floor(at).astype(int)
    lines = np.arange(len(n))
    below, above = ordered[lines, low], ordered[lines, np.minimum(low + 1, np.maximum(n - 1, 0))]
    return np.where(at > low, (low + 1 - at) * below + (at - low) * above, below)


def sums(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    return np.where(use, values, 0.0).sum(axis=1)


def spread(values: np.ndarray, use: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the lines."""
    mean = sums(values, use) / n
    return mean, np.sqrt(sums((values - mean[:, None]) ** 2, use) / n)


def geometry(s: Sets, height: int, width: int, bins: int = 36) -> dict[str, np.ndarray]:
    """The eleven geometry features of features.geometry, with an area ratio of 1."""
    u, v = s.local()
    n = s.use.sum(axis=1)
    d = np.abs((u / np.maximum(s.e["a"], 1e-4)) ** 2 + (v / np.maximum(s.e["b"], 1e-4)) ** 2 - 1)
    angle = np.fmod(np.arctan2(s.y - s.e["cy"], s.x - s.e["cx"]) + TURN, TURN)
    sector = np.minimum(bins - 1, np.nan_to_num(angle / TURN * bins)).astype(int) + np.arange(len(n))[:, None] * bins
    count = np.bincount(sector[s.use], minlength=len(n) * bins).reshape(-1, bins)
    ordered = np.sort(np.where(s.use, angle, np.inf), axis=1)
    ahead = np.append(ordered[:, 1:], np.full((len(n), 1), np.inf), axis=1)
    ahead[np.arange(len(n)), n - 1] = ordered[:, 0] + TURN
    with np.errstate(invalid="ignore"):
        gap = np.where(np.arange(s.use.shape[1]) < n[:, None], ahead - ordered, 0.0).max(axis=1)
    a, b, mean = s.own("a"), s.own("b"), n / bins
    around = np.sqrt(np.maximum(0.0, (count * count).sum(axis=1) / bins - mean * mean))
    ratio = b / (a + 1e-6)
    found = [
        np.sqrt(np.maximum(0.0, 1 - ratio * ratio)), ratio, np.pi * a * b / (height * width), np.ones(len(n)), np.sqrt(sums(d * d, s.use) / n),
        quantile(np.sort(np.where(s.use, d, np.inf), axis=1), n, 0.9), n / (TURN * np.sqrt((a * a + b * b) / 2) + 1e-6), (count > 0).sum(axis=1) / bins,
        around / (n + 1e-6), np.where(n > 1, gap / TURN, 1.0), a / (b + 1e-6),
    ]
    return dict(zip(GEOMETRY, found))


def rim_probability(s: Sets) -> dict[str, np.ndarray]:
    p = np.clip(s.p, 1e-6, 1 - 1e-6)
    n = s.use.sum(axis=1)
    ordered = np.sort(np.where(s.use, p, np.inf), axis=1)
    share = lambda most: (s.use & (p > most)).sum(axis=1) / n
    return dict(zip(RIM, [*spread(p, s.use, n), ordered[:, 0], quantile(ordered, n, 0.2), quantile(ordered, n, 0.8), share(0.5), share(0.7), -sums(p * np.log(p), s.use) / n]))


def slopes(s: Sets, gradient: np.ndarray, mean: np.ndarray | float) -> dict[str, np.ndarray]:
    """Median, std, range and mean of the gradient over the image's mean gradient (a column, or one number)."""
    v, n = gradient / (mean + 1e-6), s.use.sum(axis=1)
    ordered = np.sort(np.where(s.use, v, np.inf), axis=1)
    middle, std = spread(v, s.use, n)
    return dict(zip(CLASSIFIER[19:23], [quantile(ordered, n, 0.5), std, ordered[np.arange(len(n)), n - 1] - ordered[:, 0], middle]))


def profile(x: np.ndarray, y: np.ndarray, use: np.ndarray, bins: int) -> np.ndarray:
    """The largest radius in each sector (lines), nan where there is no point."""
    sector = np.clip(np.nan_to_num(np.floor((np.arctan2(y, x) + np.pi) / (TURN / bins))).astype(int), 0, bins - 1)
    r = np.where(use, np.sqrt(x * x + y * y), np.nan)
    out, lines = np.full((len(x), bins), np.nan), np.arange(len(x))
    for k in range(x.shape[1]):
        at = sector[:, k]
        out[lines, at] = np.fmax(out[lines, at], r[:, k])
    return out


def polar(x: np.ndarray, y: np.ndarray, use: np.ndarray, bins: int, *, core: tuple[np.ndarray, np.ndarray] | None = None, cored: np.ndarray | None = None, support: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """a, b, phi, cost (nan: none) and counted sectors of the polar fits to points about 0, over those of the core where `cored`; as
    segment.polar_fits."""
    outer = profile(x, y, use, bins)
    cored = np.zeros(len(outer), bool) if cored is None else cored
    inner = np.full_like(outer, np.nan)
    if cored.any():
        inner[cored] = profile(core[0][cored], core[1][cored], use[cored], bins)
    found, n = segment.polar_rows(outer, inner, cored)
    found[(np.isfinite(outer).sum(axis=1) < support * bins) | ~(found[:, 1] >= segment.POLAR_LEAST)] = np.nan
    return found, n


def some(s: Sets) -> Sets:
    """The sets that have points."""
    rows = s.use.any(axis=1)
    return s if rows.all() else Sets(s.rows[rows], s.key.filter(pa.array(rows)), s.number[rows], {c: v[rows] for c, v in s.e.items()}, *[z[rows] for z in (s.x, s.y, s.p, s.use)])
