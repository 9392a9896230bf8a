"""Ellipse tables: CSV in and out, image paths and groups, size arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column names of the exchange format and the validation groups.
COLUMNS = {
    "ellipseCenterX(px)": "cx", "ellipseCenterY(px)": "cy", "ellipseSemimajor(px)": "a", "ellipseSemiminor(px)": "b",
    "ellipseRotation(deg)": "rot", "inputImage": "image", "crater_classification": "cls",
}
VALIDATION = ["altitude01_longitude10", "altitude01_longitude14", "altitude04_longitude13", "altitude06_longitude13", "altitude09_longitude08"]
OVERLAPS = {(544, 416, 1024): (32, 11), (672, 544, 1296): (24, 32)}
DEFAULT_OVERLAP = (32, 32)


def schema(classes: bool = True) -> T.StructType:
    kinds = {"image": T.StringType(), "cls": T.IntegerType()}
    fields = [T.StructField(k, kinds.get(v, T.DoubleType())) for k, v in COLUMNS.items() if classes or v != "cls"]
    return T.StructType([*fields, T.StructField("_bad", T.StringType())])


def read_csv(spark: SparkSession, paths: str | list[str], *, classes: bool = True) -> DataFrame:
    """The rows of one or more files with short names and seq (file, then place in it). Rows that do not parse stay out."""
    rows = spark.read.schema(schema(classes)).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(paths)
    named = rows.select(*[F.col(f"`{k}`").alias(v) for k, v in COLUMNS.items() if classes or v != "cls"], "_bad", F.monotonically_increasing_id().alias("seq"))
    return named.where("_bad is null").drop("_bad")


def read_positional(spark: SparkSession, paths: str | list[str], *, least: float = 5.0, groups: list[str] | None = None) -> DataFrame:
    """Rows of files whose columns are known by place (cx, cy, a, b, rot, image), whatever the header calls them: those with
    b >= least, of the groups (by default those for validation)."""
    rows = spark.read.schema("cx double, cy double, a double, b double, rot double, image string").option("header", True).option("enforceSchema", True).csv(paths)
    return rows.where((F.col("b") >= least) & in_validation("image", groups or VALIDATION))


def write_csv(rows: DataFrame, path: str, digits: int = 2) -> None:
    """Rows (short names) in the exchange format."""
    out = [F.format_string(f"%.{digits}f", v).alias(k) if v not in ("image", "cls") else F.col(v).alias(k) for k, v in COLUMNS.items()]
    rows.select(*out).write.mode("errorifexists").option("header", True).csv(path)


def solution_rows(images: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each selected ellipse; an image without any has one row of -1."""
    joined = images.join(rows, "image_no", "left")
    return joined.select("image_no", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("seq", "cx", "cy", "a", "b", "rot")])


def low_counts(images: DataFrame, rows: DataFrame, least: int = 10) -> DataFrame:
    n = rows.groupBy("image_no").agg(F.count(F.lit(1)).alias("n"))
    return images.join(n, "image_no", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def tested_subset(truth: DataFrame, tested: DataFrame) -> DataFrame:
    return truth.join(tested.select("image_no"), "image_no", "left_semi")


def with_class(rows: DataFrame, classes: DataFrame, default: int = 4) -> DataFrame:
    """rows with the class of the same candidate, or the default; keyed by candidate, so a later sort cannot mix them."""
    return rows.drop("cls").join(classes, ["image_no", "seq"], "left").withColumn("cls", F.coalesce("cls", F.lit(default)))


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a centre and positive axes (NaN counts as missing)."""
    return rows.na.drop(subset=["cx", "cy", "a", "b"]).where("a > 0 and b > 0")


def padded(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def with_paths(rows: DataFrame) -> DataFrame:
    n = F.col("image_no")
    parts = [F.concat(F.lit("altitude"), padded(1 + n % 9)), F.concat(F.lit("longitude"), padded(1 + F.floor(n / 9) % 20)), F.concat(F.lit("orientation"), padded(n), F.lit("_light01"))]
    return rows.withColumn("path", F.concat_ws("/", *parts))


def flat_id(path: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(path), r"\.png$", ""), "/", "_")


def path_of(flat: str) -> Column:
    parts = F.split(F.col(flat), "_")
    return F.concat_ws("/", F.get(parts, 0), F.get(parts, 1), F.concat_ws("_", F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2))))


def group_of(path: str) -> Column:
    parts = F.split(F.col(path), "/")
    return F.concat_ws("_", F.get(parts, 0), F.get(parts, 1))


def in_validation(path: str, groups: list[str] = VALIDATION) -> Column:
    return group_of(path).isin(groups)


def resize_dims(w: str, h: str, target: int, *, half_even: bool = True) -> tuple[Column, Column]:
    """Width and height with the longer side at target; the other rounded half to even, or half away from zero."""
    near = F.bround if half_even else F.round
    w, h = F.col(w), F.col(h)
    scaled = lambda a, b: near(a.cast("double") * target / b, 0).cast("long")
    return F.when(w >= h, F.lit(target).cast("long")).otherwise(scaled(w, h)), F.when(w >= h, scaled(h, w)).otherwise(F.lit(target).cast("long"))


def parse_size(text: str) -> tuple[Column, Column]:
    """Width and height of '672x544', '672,544' or '672'."""
    parts = F.split(F.col(text), "[x,]")
    w = F.get(parts, 0).cast("int")
    return w, F.coalesce(F.get(parts, 1).cast("int"), w)


def default_overlap(w: str, h: str, target) -> tuple[Column, Column]:
    out = []
    for k in (0, 1):
        c = F.lit(DEFAULT_OVERLAP[k])
        for (tw, th, size), found in OVERLAPS.items():
            c = F.when((F.col(w) == tw) & (F.col(h) == th) & (target == size), found[k]).otherwise(c)
        out.append(c)
    return tuple(out)
