"""Labels and distances of images that are stored as tiles; no task sees more than a tile, or some rows of an image.

An image is rows (image, ty, tx, plane) of tiles h high and w wide, row by row; a tile that is missing, and a plane that is
null, is empty. A place is a pixel's row and column in one long, so that places are in raster order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimfold.operators import segment
from rimfold.sources.storage import stored

TILE = ["image", "ty", "tx"]
BITS = 31  # of a place's column
AHEAD = {1: [(0, 1), (1, 0)], 2: [(0, 1), (1, -1), (1, 0), (1, 1)]}


def typed(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.col("image").cast("long"), F.col("ty").cast("int"), F.col("tx").cast("int"), "plane")


def plane_of(values, h: int, w: int) -> np.ndarray:
    return np.full((h, w), np.nan) if values is None else np.asarray(values, float).reshape(h, w)


def places_of(plane: str, h: int, w: int, threshold: float, connectivity: int) -> Column:
    """The place of the first pixel of each pixel's component within its tile; -1 outside the mask."""

    @F.pandas_udf("array<long>")
    def run(planes: pd.Series, ty: pd.Series, tx: pd.Series) -> pd.Series:
        out = []
        for p, y, x in zip(planes, ty, tx):
            label = segment.components(plane_of(p, h, w) > threshold, connectivity).ravel()
            first = np.unique(label, return_index=True)
            start = np.full(label.max() + 1, -1, np.int64)
            start[first[0]] = (int(y) * h + first[1] // w << BITS) + int(x) * w + first[1] % w
            start[0] = -1
            out.append(start[label])
        return pd.Series(out, dtype=object)

    return run(plane, "ty", "tx")


def border(rows: DataFrame, h: int, w: int) -> DataFrame:
    """image, y, x and label of the labelled pixels on the borders of tiles."""
    line = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    places = F.array_distinct(F.concat(line(w, lambda x: x), line(w, lambda x: x + (h - 1) * w), line(h, lambda y: y * w), line(h, lambda y: y * w + w - 1)))
    found = rows.select(*TILE, F.explode(F.transform(places, lambda i: F.struct(i.alias("i"), F.get("labels", i).alias("label")))).alias("p")).where("p.label >= 0")
    y, x = F.col("ty") * h + F.floor(F.col("p.i") / w), F.col("tx") * w + F.col("p.i") % w
    return found.select("image", y.cast("long").alias("y"), x.cast("long").alias("x"), F.col("p.label").alias("label"))


def united(pairs: DataFrame) -> DataFrame:
    """image, a and b: each node that is not the least of its component, with the least; pairs are image, a, b.

    Rounds of stars: the larger neighbours of a node go to its least neighbour, then the smaller ones and itself. Each round is
    written to the shared folder; it ends when the pairs stay as they are. The least neighbour is an aggregate joined back,
    so a node with very many neighbours is never one group of rows.
    """
    now, before = stored(ordered(pairs)), None
    while (mark := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image", "a", "b").cast("decimal(38,0)"))).first()) != before:
        before = mark
        both = now.select("image", F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("image", F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("image", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = ordered(both.where("v > u").join(least, ["image", "u"]).select("image", F.col("v").alias("a"), F.col("m").alias("b")))
        least = now.groupBy("image", "a").agg(F.min("b").alias("m"))
        inner = now.join(least, ["image", "a"]).select("image", F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(ordered(inner.unionAll(least.select("image", "a", F.col("m").alias("b")))))
    return now


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select("image", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def label_tiles(tiles: DataFrame, h: int, w: int, threshold: float, connectivity: int = 2) -> DataFrame:
    """image, ty, tx and labels: components of the pixels over the threshold across the whole image, numbered from 1 in raster
    order of their first pixels (0: outside), as for an image in one plane. Labels are found in each tile, joined where pixels
    touch across the borders of tiles, and numbered by counts over rows of the image."""
    rows = stored(typed(tiles).select(*TILE, places_of("plane", h, w, threshold, connectivity).alias("labels")))
    edge = border(rows, h, w)
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AHEAD[connectivity]]))
    ahead = edge.withColumn("s", step).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("label").alias("a"))
    merged = united(ahead.join(edge.withColumnRenamed("label", "b"), ["image", "y", "x"]).select("image", "a", "b"))
    parts = rows.select(*TILE, F.explode(F.array_distinct("labels")).alias("label")).where("label >= 0")
    parts = parts.join(merged.select("image", F.col("a").alias("label"), F.col("b").alias("root")), ["image", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    roots = parts.where("root = label").select("image", "root", F.shiftright("root", BITS).alias("y"))
    above = Window.partitionBy("image").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    counts = roots.groupBy("image", "y").agg(F.count(F.lit(1)).alias("n")).select("image", "y", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("image", "y").orderBy("root"))
    numbers = roots.withColumn("nth", nth).join(counts, ["image", "y"]).select("image", "root", (F.col("before") + F.col("nth")).alias("number"))
    named = parts.join(numbers, ["image", "root"]).groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("label", "number"))).alias("names"))

    @F.pandas_udf("array<long>")
    def renamed(labels: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for own, a, b in zip(labels, old, new):
            number = np.zeros(len(own), np.int64)
            if a is not None:
                number[own >= 0] = b[np.searchsorted(a, own[own >= 0])]
            out.append(number)
        return pd.Series(out, dtype=object)

    return rows.join(named, TILE, "left").select(*TILE, renamed("labels", "names.label", "names.number").alias("labels"))


def whole_grid(tiles: DataFrame) -> DataFrame:
    """tiles, and a null plane for each that is missing from its image's rectangle; high and wide: the rectangle in tiles."""
    size = tiles.groupBy("image").agg((F.max("ty") + 1).cast("int").alias("high"), (F.max("tx") + 1).cast("int").alias("wide"))
    rows = size.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("high") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    return rows.join(tiles.select(*TILE, "plane"), TILE, "left")


def distance_tiles(tiles: DataFrame, h: int, w: int, threshold: float, band: int = 8) -> DataFrame:
    """image, ty, tx and distance: each pixel's exact distance to the nearest of the image not over the threshold; the image's
    height plus width where there is none. Columns first: each tile tells the first and last such pixel of its columns, and a
    window down the image carries them on. Then rows: `band` rows of an image at a time, over all its tiles."""
    rows = stored(whole_grid(typed(tiles)))

    @F.pandas_udf("struct<first:array<long>,last:array<long>>")
    def ends(planes: pd.Series, ty: pd.Series) -> pd.DataFrame:
        first, last = [], []
        for p, y in zip(planes, ty):
            out = ~(plane_of(p, h, w) > threshold)
            some, top = out.any(axis=0), int(y) * h
            first.append([int(v) + top if s else None for v, s in zip(out.argmax(axis=0), some)])
            last.append([top + h - 1 - int(v) if s else None for v, s in zip(out[::-1].argmax(axis=0), some)])
        return pd.DataFrame({"first": first, "last": last})

    columns = rows.select(*TILE, ends("plane", "ty").alias("e")).select(*TILE, F.posexplode(F.arrays_zip("e.first", "e.last")).alias("x", "z"))
    down = Window.partitionBy("image", "tx", "x").orderBy("ty")
    near = columns.select(
        *TILE, "x", F.max("z.last").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("up"), F.min("z.first").over(down.rowsBetween(1, Window.unboundedFollowing)).alias("low"),
    )
    near = near.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("x", "up", "low"))).alias("near"))

    @F.pandas_udf("array<array<double>>")
    def squared(planes: pd.Series, ty: pd.Series, up: pd.Series, low: pd.Series, high: pd.Series, wide: pd.Series) -> pd.Series:
        out = []
        for p, y, a, b, rh, rw in zip(planes, ty, up, low, high, wide):
            far, top = float(rh * h + rw * w), int(y) * h
            zero = lambda v: np.array([np.nan if i is None else i for i in v], float)
            a, b = np.nan_to_num(top - zero(a), nan=np.inf), np.nan_to_num(zero(b) - top, nan=np.inf)  # steps from the tile's first row
            k = np.arange(h)[:, None]
            g = np.where(plane_of(p, h, w) > threshold, np.minimum(np.minimum(a + k, b - k), far), 0.0)
            for i in range(1, h):
                np.minimum(g[i], g[i - 1] + 1, out=g[i])
            for i in range(h - 2, -1, -1):
                np.minimum(g[i], g[i + 1] + 1, out=g[i])
            out.append([part.ravel() for part in np.split(g * g, range(band, h, band))])
        return pd.Series(out, dtype=object)

    cut = rows.join(near, TILE).select(*TILE, (F.col("high") * h + F.col("wide") * w).alias("far"), F.posexplode(squared("plane", "ty", "near.up", "near.low", "high", "wide")).alias("k", "f"))

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tx")
        d = segment.by_rows(np.concatenate([np.asarray(f).reshape(-1, w) for f in part["f"]], axis=1), float(part["far"].iloc[0]))
        return part[[*TILE, "k"]].assign(d=[d[:, i : i + w].ravel() for i in range(0, d.shape[1], w)])

    done = cut.groupBy("image", "ty", "k").applyInPandas(across, "image long, ty int, tx int, k int, d array<double>")
    in_order = F.sort_array(F.collect_list(F.struct("k", "d")))
    return done.groupBy(*TILE).agg(F.flatten(F.transform(in_order, lambda b: b["d"])).alias("distance"))
