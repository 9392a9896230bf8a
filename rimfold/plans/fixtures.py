"""Inputs derived from the driver's tables by integer arithmetic, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem in a partition of what is dealt by seq: what queries make of a row (points, samples) stays small in every task.
DEALT = 60_000


def base(spark: SparkSession, sf_dir: str, dealt: bool | Column = False) -> DataFrame:
    """ok, ln, pk, sk. dealt: with seq and in partitions by seq, as many as the table's size asks for, so that what rows become in a
    query is grouped and joined by seq where it is made, without moving; or by a column made of ok and ln, kept as `whole`."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"), "l_partkey", "l_suppkey")
    keys = ["ok", "ln"]
    if dealt is not False:
        n = max(2 * spark.sparkContext.defaultParallelism, rows.count() // DEALT)
        by, value = ("whole", dealt) if isinstance(dealt, Column) else ("seq", F.col("ok") * 8 + F.col("ln"))
        rows, keys = rows.withColumn(by, value).repartition(n, by), ["ok", "ln", by]
    return rows.groupBy(*keys).agg(F.min("l_partkey").cast("long").alias("pk"), F.min("l_suppkey").cast("long").alias("sk"))


def _shape(rows: DataFrame) -> DataFrame:
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    a = (40 + (pk * 7 + ln * 13) % 80).cast("double")
    return rows.select(
        *[c for c in rows.columns if c != "seq"], F.floor(ok / 10).alias("image_no"), F.col("seq") if "seq" in rows.columns else (ok * 8 + ln).alias("seq"),
        (200 + (pk * 37 + ln * 411 + ok * 97) % 2192).cast("double").alias("cx"), (200 + (pk * 53 + ok * 131 + ln * 277) % 1648).cast("double").alias("cy"),
        a.alias("a"), (a * (0.70 + 0.30 * ((pk * 11) % 100) / 100)).alias("b"), ((pk * 29) % 180).cast("double").alias("rot"), ((pk + ln) % 5).cast("int").alias("cls"),
    )


KEEP = ["image_no", "seq", "cx", "cy", "a", "b", "rot"]


def truth(spark: SparkSession, sf_dir: str, dealt: bool | Column = False) -> DataFrame:
    rows = _shape(base(spark, sf_dir, dealt))
    return rows.select(*KEEP, "cls", *[c for c in rows.columns if c == "whole"])


def pred(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    pk, sk = F.col("pk"), F.col("sk")
    far = F.when(pk % 10 >= 8, 400).otherwise(0)
    return _shape(base(spark, sf_dir, dealt)).where(sk % 8 != 0).select(
        "image_no", "seq", (F.col("cx") + (sk % 25 - 12) * 0.5 + far).alias("cx"), (F.col("cy") + ((sk * 7) % 25 - 12) * 0.5).alias("cy"),
        (F.col("a") * (0.90 + 0.01 * (sk % 20))).alias("a"), "b", ((pk * 29 + sk % 15) % 180).cast("double").alias("rot"),
        (0.550 + ((pk * 17 + sk * 3) % 450) / 1000).alias("conf"),
    )


def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, y, x, v: each embedding as an 8 x 8 raster."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))


def patch01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same brought to [0, 1]."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") + 0.6) / 1.2))
    return patch(spark, sf_dir).withColumn("v", v)


BASE_SQL = """base as (select l_orderkey::bigint as ok, l_linenumber::bigint as ln, min(l_partkey)::bigint as pk, min(l_suppkey)::bigint as sk from lineitem group by 1, 2),
shape as (select ok, ln, pk, sk, (ok // 10)::bigint as image_no, ok * 8 + ln as seq, (200 + (pk * 37 + ln * 411 + ok * 97) % 2192)::double as cx,
  (200 + (pk * 53 + ok * 131 + ln * 277) % 1648)::double as cy, (40 + (pk * 7 + ln * 13) % 80)::double as a,
  (40 + (pk * 7 + ln * 13) % 80)::double * (0.70e0 + 0.30e0 * ((pk * 11) % 100) / 100) as b, ((pk * 29) % 180)::double as rot, ((pk + ln) % 5)::int as cls from base),
truth as (select image_no, seq, cx, cy, a, b, rot, cls from shape),
pred as (select image_no, seq, cx + (sk % 25 - 12) * 0.5e0 + case when pk % 10 >= 8 then 400 else 0 end as cx, cy + ((sk * 7) % 25 - 12) * 0.5e0 as cy,
  a * (0.90e0 + 0.01e0 * (sk % 20)) as a, b, ((pk * 29 + sk % 15) % 180)::double as rot, 0.550e0 + ((pk * 17 + sk * 3) % 450) / 1000 as conf from shape where sk % 8 <> 0)"""

PAIRS_SQL = BASE_SQL + """,
cand as (select t.image_no, t.seq as t_seq, p.seq as p_seq, t.cx as tx, t.cy as ty, t.a as ta, t.b as tb, t.rot as tr, t.cls as t_cls, p.cx as px, p.cy as py, p.a as pa, p.b as pb, p.rot as pr
  from truth t join pred p on t.image_no = p.image_no where least(t.a, t.b) <= 1.5e0 * least(p.a, p.b) and least(p.a, p.b) <= 1.5e0 * least(t.a, t.b)
  and abs(t.cx - p.cx) <= least(t.a, t.b, p.a, p.b) and abs(t.cy - p.cy) <= least(t.a, t.b, p.a, p.b)),
ymat as (select *, cos(radians(tr))**2 / ta**2 + sin(radians(tr))**2 / tb**2 as i11, cos(radians(tr)) * sin(radians(tr)) * (1 / ta**2 - 1 / tb**2) as i12,
  sin(radians(tr))**2 / ta**2 + cos(radians(tr))**2 / tb**2 as i22, cos(radians(pr))**2 / pa**2 + sin(radians(pr))**2 / pb**2 as j11,
  cos(radians(pr)) * sin(radians(pr)) * (1 / pa**2 - 1 / pb**2) as j12, sin(radians(pr))**2 / pa**2 + cos(radians(pr))**2 / pb**2 as j22 from cand),
ydet as (select *, (i11 + j11) * (i22 + j22) - (i12 + j12)**2 as det, j11 * (tx - px) + j12 * (ty - py) as v1, j12 * (tx - px) + j22 * (ty - py) as v2 from ymat),
yvec as (select *, ((i22 + j22) * v1 - (i12 + j12) * v2) / det as u1, ((i11 + j11) * v2 - (i12 + j12) * v1) / det as u2 from ydet),
ang as (select *, acos(greatest(-1, least(1, 4 * sqrt((i11 * i22 - i12**2) * (j11 * j22 - j12**2)) / det
  * exp(-0.5e0 * ((tx - px) * (i11 * u1 + i12 * u2) + (ty - py) * (i12 * u1 + i22 * u2)))))) as dga from yvec),
pairs as (select *, dga**2 / (0.85e0 / sqrt(ta * tb) * 0.07e0 * least(ta, tb))**2 as xi2 from ang)"""

MATCH_SQL = PAIRS_SQL + """,
opts as (select image_no, t_seq, list({'d': dga, 'p': p_seq} order by dga, p_seq) as options from pairs where xi2 < 13.277e0 group by 1, 2),
nth as (select *, row_number() over (partition by image_no order by t_seq) as k from opts),
fold as (select image_no, 0::bigint as k, []::bigint[] as used, null::bigint as t_seq, null::bigint as p_seq, null::double as dga from (select distinct image_no from nth)
  union all select image_no, k, case when best.p is null then used else list_append(used, best.p) end, t_seq, best.p, best.d
  from (select f.image_no, f.used, n.k, n.t_seq, list_filter(n.options, lambda o: not list_contains(f.used, o.p))[1] as best from fold f join nth n on n.image_no = f.image_no and n.k = f.k + 1) q),
matches as (select image_no, t_seq, p_seq, dga from fold where p_seq is not null)"""

PATCH_SQL = """patch as (select vec_id, ((i - 1) // 8)::int as y, ((i - 1) % 8)::int as x, v::double as v from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)),
patch01 as (select vec_id, y, x, greatest(0, least(1, (v + 0.6e0) / 1.2e0)) as v from patch)"""
