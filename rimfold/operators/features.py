"""Features of candidates from rim points and planes.

Points are rows (key, x, y, p) with the candidate's cx, cy, a, b, rot. The points of one candidate are bounded by its
sampling, so a feature group is one grouping by candidate; nothing here needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimfold.functions import geometry as G

TURN = 2 * G.PI
ELLIPSE = ["cx", "cy", "a", "b", "rot"]


def grouped(points: DataFrame, key: str, *aggs: Column) -> DataFrame:
    return points.groupBy(key, *ELLIPSE).agg(F.count(F.lit(1)).alias("n"), *aggs)


def full_angle(dy, dx) -> Column:
    return F.pmod(F.atan2(dy, dx) + F.lit(TURN), F.lit(TURN))


def histogram(angles: str, bins: int) -> Column:
    """Counts of the angles in [0, 2 pi] by even sectors."""
    sector = lambda v: F.least(F.lit(bins - 1), F.floor(v / TURN * bins)).cast("int")
    own = F.transform(angles, sector)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(own, lambda s: s == k)))


def filled_and_squares(angles: str, bins: int) -> tuple[Column, Column]:
    """Even sectors of [0, 2 pi] that hold any of the sorted angles, and the sum of the squares of their counts: a sector of n adds
    1 + 3 + ... + (2 n - 1)."""
    sectors = F.transform(angles, lambda v: F.least(F.lit(bins - 1), F.floor(v / TURN * bins)).cast("int"))

    def step(t, sector):
        run = F.when(t["at"] == sector, t["run"] + 1).otherwise(1)
        return F.struct(sector.alias("at"), run.alias("run"), (t["squares"] + 2 * run - 1).alias("squares"))

    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("squares"))
    return F.size(F.array_distinct(sectors)), F.aggregate(sectors, start, step, lambda t: t["squares"])


def widest_gap(angles: str) -> Column:
    """The largest step between neighbours of the sorted angles around the circle, as a share; 1 for one point."""
    a = F.col(angles)
    ahead = F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.get(a, 0) + TURN))
    return F.when(F.size(a) > 1, F.array_max(F.zip_with(ahead, a, lambda p, q: p - q)) / TURN).otherwise(F.lit(1.0))


def geometry(points: DataFrame, key: str, height: int, width: int, region: str | None = None) -> DataFrame:
    """The eleven geometry features; region: a column with the area of the candidate's region (without it the area ratio is 1)."""
    d = G.algebraic_distance("x", "y", *ELLIPSE)
    angle = full_angle(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    rows = grouped(points, key, F.sqrt(F.avg(d * d)).alias("resid_rms"), F.percentile(d, 0.9).alias("resid_p90"), F.array_sort(F.collect_list(angle)).alias("angles"), F.first(region or F.lit(None)).alias("region"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    filled, squares = filled_and_squares("angles", 36)
    mean = n / 36
    spread = F.sqrt(F.greatest(F.lit(0.0), squares / 36 - mean * mean))
    return rows.select(
        key, G.eccentricity(a, b).alias("geometry_eccentricity"), (b / (a + 1e-6)).alias("geometry_axis_ratio"), (G.PI * a * b / (height * width)).alias("geometry_ellipse_area"),
        (F.lit(1.0) if region is None else F.col("region") / (G.PI * a * b + 1e-6)).alias("geometry_area_ratio"), F.col("resid_rms").alias("geometry_resid_rms"), F.col("resid_p90").alias("geometry_resid_p90"),
        (n / (TURN * F.sqrt((a * a + b * b) / 2) + 1e-6)).alias("geometry_support_ratio"), (filled / 36).alias("geometry_angular_coverage"),
        (spread / (n + 1e-6)).alias("geometry_angular_std"), widest_gap("angles").alias("geometry_max_gap"), (a / (b + 1e-6)).alias("geometry_condition"),
    )


def rim_probability(points: DataFrame, key: str) -> DataFrame:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    return points.groupBy(key).agg(
        F.avg(p).alias("rim_prob_mean"), F.stddev_pop(p).alias("rim_prob_std"), F.min(p).alias("rim_prob_min"), F.percentile(p, 0.2).alias("rim_prob_p20"), F.percentile(p, 0.8).alias("rim_prob_p80"),
        F.avg((p > 0.5).cast("double")).alias("rim_prob_frac_above_50"), F.avg((p > 0.7).cast("double")).alias("rim_prob_frac_above_70"), (-F.avg(p * F.log(p))).alias("rim_prob_entropy"),
    )


def angular_profile(points: DataFrame, key: str, bins: int = 36) -> DataFrame:
    """key, the ellipse, n and r: the greatest local radius by sector from -pi, null where there is none. One grouping, with
    a maximum for each sector, so that points are reduced before they move."""
    u, v = G.local_frame("x", "y", "cx", "cy", "rot")
    sector = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.atan2(v, u) + G.PI) / TURN * bins))).cast("int")
    placed = points.select(key, *ELLIPSE, sector.alias("sector"), F.sqrt(u * u + v * v).alias("r"))
    rows = placed.groupBy(key, *ELLIPSE).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("sector") == k, F.col("r"))).alias(f"_{k}") for k in range(bins)])
    return rows.select(key, *ELLIPSE, "n", F.array(*[f"_{k}" for k in range(bins)]).alias("r"))


def polar(points: DataFrame, key: str, bins: int = 36) -> DataFrame:
    """Support, asymmetry of opposite sectors and roughness of the profile; under 5 points 0 and 1."""
    rows = angular_profile(points, key, bins)
    expected = lambda k: G.polar_radius(-G.PI + (k + 0.5) * (TURN / bins), "a", "b")
    pair = lambda k: F.abs(F.get("r", k) - F.get("r", k + bins // 2)) / (expected(k) + 1e-6)
    asym = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(bins // 2 - 1)), pair))
    resid = F.array_compact(F.transform("r", lambda r, k: (r - expected(k)) / (expected(k) + 1e-6)))
    rows = rows.withColumns({"asym": asym, "resid": resid, "held": F.size(F.array_compact("r"))})
    steps = F.zip_with(F.slice("resid", 2, F.greatest(F.size("resid") - 1, F.lit(0))), F.slice("resid", 1, F.greatest(F.size("resid") - 1, F.lit(0))), lambda p, q: (p - q) * (p - q))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    rough = total(steps) / (total(F.transform("resid", lambda v: v * v)) + 1e-10)
    few, none = F.col("n") < 5, F.size("asym") == 0
    return rows.select(
        key, F.when(few, 0.0).otherwise(F.col("held") / bins).alias("polar_angular_support"),
        F.when(few | none, 1.0).otherwise(total("asym") / F.size("asym")).alias("polar_mean_asymmetry"), F.when(few | none, 1.0).otherwise(F.array_max("asym")).alias("polar_max_asymmetry"),
        F.when(few | (F.col("held") < 10), 1.0).otherwise(rough).alias("polar_roughness_ratio"),
    )


def empty_run(r: str, bins: int) -> Column:
    """The longest circular run of empty sectors, at most all of them."""
    twice = F.concat(F.col(r), F.col(r))
    state = F.aggregate(twice, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, v: F.struct(
        F.when(v.isNull(), s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(v.isNull(), s["now"] + 1).otherwise(0)).alias("most")))
    return F.least(F.lit(bins), state["most"])


def profile_residuals(points: DataFrame, key: str, bins: int = 36) -> DataFrame:
    """support, rmse, mae, relative, gap_bins, axis_ratio of the profile against its ellipse."""
    rows = angular_profile(points, key, bins)
    expected = lambda k: G.polar_radius(-G.PI + (k + 0.5) * (TURN / bins), "a", "b")
    rows = rows.withColumn("e", F.array_compact(F.transform("r", lambda r, k: F.struct((r - expected(k)).alias("d"), r.alias("r"), (r + k).alias("ok")))))
    e = F.filter("e", lambda x: x["ok"].isNotNull())
    mean = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda s, v: s + v) / F.size(e)
    return rows.select(
        key, (F.size(e) / bins).alias("support"), F.sqrt(mean(lambda x: x["d"] * x["d"])).alias("rmse"), mean(lambda x: F.abs(x["d"])).alias("mae"),
        mean(lambda x: F.abs(x["d"]) / (x["r"] + 1e-9)).alias("relative"), empty_run("r", bins).alias("gap_bins"), (F.col("a") / F.col("b")).alias("axis_ratio"),
    )


def polar_library(rim: DataFrame, core: DataFrame, key: str, bins: int = 36) -> DataFrame:
    """The fifteen features of a candidate's outer profile (points of its rim) and inner profile (of its core) about its ellipse:
    support, residuals, separation of the profiles (null under 10 common sectors), the widest gap, axis ratio, asymmetry of
    opposite sectors (null under 5 pairs), roughness (null under 20 sectors)."""
    rows = angular_profile(rim, key, bins).join(angular_profile(core, key, bins).select(key, F.col("r").alias("inner")), key, "left")
    expected = lambda k: G.polar_radius(-G.PI + (k + 0.5) * (TURN / bins), "a", "b")
    resid = F.array_compact(F.transform("r", lambda r, k: r - expected(k)))
    apart = F.array_compact(F.zip_with("r", F.coalesce("inner", F.array_repeat(F.lit(None).cast("double"), bins)), lambda p, q: p - q))
    pair = lambda k: F.abs(F.get("r", k) - F.get("r", k + bins // 2)) / ((F.get("r", k) + F.get("r", k + bins // 2)) / 2 + 1e-9)
    asym = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(bins // 2 - 1)), pair))
    rows = rows.select(key, "a", "b", "r", F.array_compact("r").alias("held"), resid.alias("resid"), apart.alias("apart"), asym.alias("asym"), empty_run("r", bins).alias("gap"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    mean = lambda arr: F.try_divide(total(arr), F.size(arr))
    n = F.size("resid")
    rows = rows.withColumns({
        "rmse": F.coalesce(F.sqrt(mean(F.transform("resid", lambda v: v * v))), F.lit(0.0)), "mae": F.coalesce(mean(F.transform("resid", F.abs)), F.lit(0.0)), "mean_r": F.coalesce(mean("held"), F.lit(0.0)),
        "sep": F.when(F.size("apart") >= 10, mean("apart")), "energy": total(F.transform("resid", lambda v: v * v)),
        "steps": F.aggregate(F.zip_with(F.slice("resid", 2, F.greatest(n - 1, F.lit(0))), F.slice("resid", 1, F.greatest(n - 1, F.lit(0))), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v),
    })
    rows = rows.withColumn("sep_std", F.sqrt(mean(F.transform("apart", lambda v: (v - F.col("sep")) * (v - F.col("sep"))))))
    pairs, enough = F.size("asym") >= 5, n >= 20
    return rows.select(
        key, (n / bins).alias("angular_support"), F.col("rmse").alias("residual_rmse"), F.col("mae").alias("residual_mae"), (F.col("rmse") / (F.col("mean_r") + 1e-9)).alias("residual_relative_rmse"),
        F.col("sep").alias("separation_mean"), F.when(F.col("sep").isNotNull(), F.col("sep_std")).alias("separation_std"), (F.col("sep_std") / (F.col("sep") + 1e-9)).alias("separation_cv"),
        (F.col("gap") * 360.0 / bins).alias("largest_gap_degrees"), (F.col("gap") / bins).alias("largest_gap_fraction"), F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("axis_ratio"),
        F.when(pairs, mean("asym")).alias("mean_asymmetry"), F.when(pairs, F.array_max("asym")).alias("max_asymmetry"), F.when(pairs, F.size(F.filter("asym", lambda v: v > 0.2)) / F.size("asym")).alias("asymmetry_fraction"),
        F.when(enough, F.col("steps") / (F.col("energy") + 1e-10)).alias("roughness_ratio"), F.when(enough, F.col("steps")).alias("high_freq_energy"),
    )


#: The inputs of the ranker and of the classifier, in the order of their models.
GEOMETRY = [f"geometry_{n}" for n in ("eccentricity", "axis_ratio", "ellipse_area", "area_ratio", "resid_rms", "resid_p90", "support_ratio", "angular_coverage", "angular_std", "max_gap", "condition")]
RIM = [f"rim_prob_{n}" for n in ("mean", "std", "min", "p20", "p80", "frac_above_50", "frac_above_70", "entropy")]
RANKER = [*GEOMETRY, *RIM, "meta_log_radius", "meta_log_area"]
CLASSIFIER = [*GEOMETRY, *RIM, *[f"mahanti_{n}" for n in ("median_slope", "slope_std", "depth_ratio", "rim_sharpness")], *[f"ctx_{n}" for n in ("inside_mean", "outside_mean", "diff", "grad_mean", "grad_std")], *[f"snr_{n}" for n in ("raw", "x_illumination", "illumination_level")]]


def rim_search(candidates: DataFrame, key: str, plane: str, h: int, w: int, *, samples: int = 48, reach: int = 4, over: float = 0.2, least: int = 5) -> DataFrame:
    """key, y, x, p of the pixels with p over `over` near the outline: those at most `reach` from one of its samples (rounded
    half to even). Pixels are told apart before they look into the plane; a candidate with under `least` is left out."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    at = candidates.select(key, *ELLIPSE, k.alias("_k"))
    x, y = G.perimeter_point("cx", "cy", "a", "b", "rot", F.lit(TURN) * F.col("_k") / samples)
    step = lambda c, n: F.sequence(F.greatest(F.bround(c).cast("int") - reach, F.lit(0)), F.least(F.bround(c).cast("int") + reach, F.lit(n - 1)))
    inside = lambda c, n: (F.bround(c) + reach >= 0) & (F.bround(c) - reach <= n - 1)
    spots = at.where(inside(x, w) & inside(y, h)).select(key, F.explode(step(y, h)).alias("y"), x.alias("_x")).select(key, "y", F.explode(step(F.col("_x"), w)).alias("x")).distinct()
    own = spots.groupBy(key).agg(F.collect_list(F.struct("y", "x")).alias("_s")).join(candidates.select(key, plane), key)
    found = F.filter(F.transform("_s", lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), F.get(plane, s["y"] * w + s["x"]).alias("p"))), lambda s: s["p"] > over)
    rows = own.select(key, found.alias("_s")).where(F.size("_s") >= least)
    return rows.select(key, F.explode("_s").alias("_s")).select(key, "_s.*")


def rim_ring(candidates: DataFrame, key: str, plane: str, h: int, w: int, *, over: float = 0.2, width: float = 1.5) -> DataFrame:
    """key, y, x, p of the pixels with p over `over` in the outline of the ellipse (with axes as whole numbers, about its whole
    centre), drawn `width` pixels to either side and dilated by one pixel up, down, left and right."""
    from rimfold.operators import raster

    whole = candidates.select(key, plane, *[F.floor(c).cast("double").alias(c) for c in ("cx", "cy", "a", "b")], "rot")

    def drawn(y, x):
        u, v = G.local_frame(x.cast("double"), y.cast("double"), "cx", "cy", "rot")
        far = lambda d: (u / F.greatest(F.col("a") + d, F.lit(0.5))) * (u / F.greatest(F.col("a") + d, F.lit(0.5))) + (v / F.greatest(F.col("b") + d, F.lit(0.5))) * (v / F.greatest(F.col("b") + d, F.lit(0.5)))
        return F.when((far(width) <= 1) & (far(-width) >= 1), 1.0).otherwise(0.0)

    def cross(p):
        import numpy as np

        out = p.copy()
        for lo, hi in (((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(None), slice(None), slice(1, None)), (slice(None), slice(None), slice(None, -1)))):
            np.maximum(out[lo], p[hi], out=out[lo])
            np.maximum(out[hi], p[lo], out=out[hi])
        return out

    ringed = whole.withColumn("_ring", raster.grid(h, w, drawn)).withColumn("_ring", raster.by_numpy(cross, "_ring", h, w))
    px = raster.pixels(ringed.withColumn("_z", F.arrays_zip(F.col(plane).alias("p"), F.col("_ring").alias("ring"))), key, "_z", w, "z")
    return px.where((F.col("z.ring") > 0) & (F.col("z.p") > over)).select(key, "y", "x", F.col("z.p").alias("p"))


def angle_histogram(points: DataFrame, key: str, bins: int = 36) -> DataFrame:
    """key, bin, n: points by sector of [0, 2 pi) about the centre; sectors without any have no row."""
    angle = full_angle(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    return points.groupBy(key, F.least(F.lit(bins - 1), F.floor(angle / TURN * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def meta(height: int, width: int) -> dict[str, Column]:
    area = F.col("a") * F.col("b")
    return {"meta_log_radius": F.log(F.sqrt(area) / F.sqrt(F.lit(float(height * width))) + 1e-6), "meta_log_area": F.log(G.PI * area / (height * width) + 1e-6)}


def morphology(height: int, width: int) -> dict[str, Column]:
    """Closed forms for an ellipse."""
    a, b = F.col("a"), F.col("b")
    area, length = G.PI * a * b, G.perimeter("a", "b")
    return {
        "morph_solidity": F.lit(1.0), "morph_convexity": F.lit(1.0), "morph_extent": F.lit(G.PI / 4), "morph_perimeter": length / (F.sqrt(area) + 1e-6),
        "morph_minor": 2 * F.least(a, b) / (F.sqrt(area) + 1e-6), "morph_log_area": F.log(area / (height * width) + 1e-6),
    }


def zone(x: str = "x", y: str = "y") -> Column:
    """Normalized radius of a pixel in its ellipse: 1 on the outline."""
    u, v = G.local_frame(x, y, "cx", "cy", "rot")
    return F.sqrt((u / F.col("a")) * (u / F.col("a")) + (v / F.col("b")) * (v / F.col("b")))


def signal_to_noise(pixels: DataFrame, key: str, brightness: Column, least: int = 10) -> DataFrame:
    """(mean of the rim, 0.8 to 1.2, - mean inside 0.8) / std of the ring, 1.2 to 1.5; 0 with under `least` pixels in a zone.
    Means go up to 255 if the image does not."""
    z, v = zone(), F.col("v")
    rim, inside, ring = (z >= 0.8) & (z <= 1.2), z < 0.8, (z > 1.2) & (z <= 1.5)
    rows = pixels.groupBy(key).agg(
        F.avg(F.when(rim, v)).alias("r"), F.count_if(rim).alias("nr"), F.avg(F.when(inside, v)).alias("i"), F.count_if(inside).alias("ni"), F.stddev_pop(F.when(ring, v)).alias("s"), F.count_if(ring).alias("ns"), brightness.alias("light"),
    )
    fine = (F.col("nr") >= least) & (F.col("ni") >= least) & (F.col("ns") >= least)
    raw = F.when(fine, (F.col("r") - F.col("i")) / (F.col("s") + 1e-6)).otherwise(0.0)
    return rows.select(key, raw.alias("snr_raw"), (raw * F.col("light") / 255).alias("snr_x_illumination"), (F.col("light") / 255).alias("snr_illumination_level"))


def context(pixels: DataFrame, key: str, gradient: str | None = None) -> DataFrame:
    """Means inside 0.8 and in the ring from 1.0 to 1.2, and their difference; with a gradient column also its mean and
    standard deviation on the rim (0.95 to 1.05) over those of all pixels."""
    z, v = zone(), F.col("v")
    aggs = [F.coalesce(F.avg(F.when(z < 0.8, v)), F.lit(0.0)).alias("ctx_inside_mean"), F.coalesce(F.avg(F.when((z > 1.0) & (z <= 1.2), v)), F.lit(0.0)).alias("ctx_outside_mean")]
    if gradient:
        g, rim = F.col(gradient), (z >= 0.95) & (z <= 1.05)
        aggs += [F.coalesce(f(F.when(rim, g)) / (f(g) + 1e-6), F.lit(0.0)).alias(f"ctx_grad_{n}") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return pixels.groupBy(key).agg(*aggs).withColumn("ctx_diff", F.col("ctx_inside_mean") - F.col("ctx_outside_mean"))


def slopes(points: DataFrame, key: str, gradient: str = "g", mean: str = "g_mean") -> DataFrame:
    """Median, std, range and mean of the gradient at rim points over the image's mean gradient."""
    s = F.col(gradient) / (F.col(mean) + 1e-6)
    return points.groupBy(key).agg(F.median(s).alias("mahanti_median_slope"), F.stddev_pop(s).alias("mahanti_slope_std"), (F.max(s) - F.min(s)).alias("mahanti_depth_ratio"), F.avg(s).alias("mahanti_rim_sharpness"))


def confidence(samples: DataFrame, key: str, n: int, *, signal: str = "p", over: float = 0.5, bins: int = 36) -> DataFrame:
    """confidence, completeness and rim_score (the mean) from the samples (k of n, signal) of a perimeter that lie in the image:
    0.4 mean + 0.3 share over `over` + 0.15 (1 - unevenness of the sectors) + 0.15 (1 - widest gap); 0 with under half."""
    s, angle = F.col(signal), F.lit(TURN) * F.col("k") / n
    rows = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("m"), F.avg(s).alias("mean"), F.avg((s > over).cast("double")).alias("share"),
        F.avg((s > 0.2).cast("double")).alias("completeness"), F.array_sort(F.collect_list(angle)).alias("angles"),
    )
    _, squares = filled_and_squares("angles", bins)
    each = F.col("m") / bins
    spread = F.sqrt(F.greatest(F.lit(0.0), squares / bins - each * each))
    uneven = F.least(spread / (F.sqrt(each * (bins - 1)) + 1e-6), F.lit(1.0))
    value = 0.4 * F.col("mean") + 0.3 * F.col("share") + 0.15 * (1 - uneven) + 0.15 * (1 - widest_gap("angles"))
    return rows.select(key, F.when(F.col("m") * 2 < n, 0.0).otherwise(value).alias("confidence"), "completeness", F.col("mean").alias("rim_score"))


def hybrid_signal(rim: str, gradient: str, p95: str) -> Column:
    """The rim probability where it is clear, and scaled gradient where it is weak."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    alpha = clip((F.col(rim) - 0.2) / 0.3)
    return alpha * F.col(rim) + (1 - alpha) * clip(F.col(gradient) / (F.col(p95) + 1e-6)) * 0.7


def deployed_confidence(rim: DataFrame, disc: DataFrame, key: str, weights: tuple = (0.5, 0.3, 0.2)) -> DataFrame:
    """Weighted sum of the rim's mean, the share of rim samples over 0.2 and that of disc samples over 0.5; the weights
    of the earlier formula are (0.8, 0.1, 0.1)."""
    r = rim.groupBy(key).agg(F.avg("p").alias("rim_score"), F.avg((F.col("p") > 0.2).cast("double")).alias("completeness"))
    d = disc.groupBy(key).agg(F.avg((F.col("q") > 0.5).cast("double")).alias("coverage"))
    both = r.join(d, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    parts = zip(weights, ("rim_score", "completeness", "coverage"))
    return both.withColumn("confidence", sum(w * F.col(c) for w, c in parts))


def rescue_confidence(conf: str = "confidence", radius: str = "radius", coverage: str = "coverage", completeness: str = "completeness", mean: str = "rim_score") -> Column:
    c = F.col(conf)
    c = F.when((F.col(radius) > 15) & (F.col(coverage) > 0.6), F.greatest(c, 0.9 * F.col(coverage))).otherwise(c)
    return F.when(F.col(completeness) > 0.7, F.greatest(c, F.col(mean))).otherwise(c)


def best_scale(samples: DataFrame, key: str, default: float = 1.14) -> DataFrame:
    """scale and mean of the scale whose perimeter has the highest mean p (the smallest of equals); samples: key, scale, p."""
    means = samples.groupBy(key, "scale").agg(F.round(F.avg("p"), 12).alias("m"))
    best = means.groupBy(key).agg(F.max(F.struct("m", (-F.col("scale")).alias("s"))).alias("x"))
    found = F.col("x.m") > 0
    return best.select(key, F.when(found, -F.col("x.s")).otherwise(default).alias("scale"), F.when(found, F.col("x.m")).otherwise(0.0).alias("score"))


def interactions(rows: DataFrame, pairs: dict[str, tuple[str, str, str]]) -> DataFrame:
    """rows with products and ratios (name: (kind, left, right)); only those whose columns are there."""
    made = {}
    for name, (kind, left, right) in pairs.items():
        if {left, right} <= set(rows.columns):
            made[name] = F.col(left) * F.col(right) if kind == "product" else F.col(left) / (F.col(right) + 1e-6)
    return rows.withColumns(made)


def assembled(parts: list[DataFrame], key: str, names: list[str] | None = None) -> DataFrame:
    """Feature groups of one key joined, as columns; with names in that order, what is missing as 0."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out if names is None else out.select(key, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) if n in out.columns else F.lit(0.0).alias(n) for n in names])


MORPHOLOGY = [f"morph_{n}" for n in ("solidity", "convexity", "extent", "perimeter", "minor", "log_area")]
STABILITY = [f"stab_{n}" for n in ("jitter_a", "jitter_b", "jitter_theta", "center_shift", "iou_subsample")]
FULL = [*GEOMETRY, *RIM, *MORPHOLOGY, *STABILITY, *CLASSIFIER[19:28], "meta_log_radius", "meta_log_area", *CLASSIFIER[28:]]


def full_vector(points: DataFrame, pixels: DataFrame, key: str, height: int, width: int, brightness: Column, *, region: str | None = None, stability: DataFrame | None = None, least: int = 10) -> DataFrame:
    """key and the 44 features FULL (CLASSIFIER is part of them), every group measured. points: rim points with p, the gradient g
    there and its image's mean g_mean (region: a column of theirs, as in geometry); pixels: v and gradient g around each candidate; stability: its table, or what holds of a
    candidate that does not move. The area of meta is that of morphology. A candidate without rim points has no row."""
    own = points.groupBy(key).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    shape = morphology(height, width)
    shapes = own.select(key, *[c.alias(n) for n, c in shape.items()], meta(height, width)["meta_log_radius"].alias("meta_log_radius"), shape["morph_log_area"].alias("meta_log_area"))
    parts = [shapes, geometry(points, key, height, width, region), rim_probability(points, key), slopes(points, key), context(pixels, key, "g"), signal_to_noise(pixels, key, brightness, least)]
    parts.append(own.select(key, *[F.lit(float(n.endswith("subsample"))).alias(n) for n in STABILITY]) if stability is None else stability)
    return assembled(parts, key, FULL)
