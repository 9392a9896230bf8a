"""Queries on aggregates, metrics, targets and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.operators import stats
from rimfold.plans.fixtures import BASE_SQL, pred

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SQL = "with " + BASE_SQL + """,
scored as (select image_no, seq, a, conf as prob, case when seq % 3 = 0 then 0 else 0.501e0 + ((seq * 7) % 499) / 1000 end as target_score, (seq % 3 <> 0)::int as matched,
  ((seq * 5 + image_no) % 5)::int as cls, ((seq * 3 + image_no * 7 + seq // 11) % 5)::int as guess, ((seq * 13) % 400) / 100 as value from pred)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, i = F.col("seq"), F.col("image_no")
    return pred(spark, sf_dir).select(
        "image_no", "seq", "a", F.col("conf").alias("prob"), F.when(s % 3 == 0, 0.0).otherwise(0.501 + ((s * 7) % 499) / 1000).alias("target_score"), (s % 3 != 0).cast("int").alias("matched"),
        ((s * 5 + i) % 5).cast("int").alias("cls"), ((s * 3 + i * 7 + F.floor(s / 11)) % 5).cast("int").alias("guess"), (((s * 13) % 400) / 100).alias("value"),
    )


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(SQL + """, c as (select cls, count(*) as n from scored group by 1) select sum(n)::bigint as rows, count(*) as classes, round(max(n) / min(n), 9) as imbalance,
(select cls from c order by n desc, cls limit 1) as largest, (select cls from c order by n, cls limit 1) as smallest from c""")
def ag5_class_distribution(spark, sf_dir):
    return rounded(stats.class_distribution(scored(spark, sf_dir)))


@query(SQL + """ select count(prob) as n, round(avg(prob), 9) as mean, round(stddev_samp(prob), 9) as std, min(prob) as least, round(quantile_cont(prob, 0.25), 9) as q1, round(quantile_cont(prob, 0.5), 9) as q2,
round(quantile_cont(prob, 0.75), 9) as q3, max(prob) as most, count(*) filter (where prob is null) as missing from scored""")
def ag6_describe(spark, sf_dir):
    return rounded(stats.describe(scored(spark, sf_dir), "prob"))


@query(SQL + " select cls, round(avg(prob), 9) as mean, round(stddev_samp(prob), 9) as std, round(median(prob), 9) as median from scored group by 1")
def ag7_by_class(spark, sf_dir):
    return rounded(stats.by_class(scored(spark, sf_dir), "prob"))


@query(SQL + " select name, round(r, 9) as r from (select unnest(['a', 'prob', 'value']) as name, unnest([corr(a, cls), corr(prob, cls), corr(value, cls)]) as r from scored) order by abs(r) desc, name")
def ag8_correlations(spark, sf_dir):
    return rounded(stats.correlations(scored(spark, sf_dir), ["a", "prob", "value"], "cls"))


@query(SQL + " select t as threshold, count(*) filter (where prob >= t) as n, round(count(*) filter (where prob >= t) / count(*), 9) as share from scored, (select unnest([0.1e0, 0.6e0, 0.7e0, 0.85e0, 0.95e0]) as t) group by 1")
def ag9_threshold_ladder(spark, sf_dir):
    return rounded(stats.threshold_counts(scored(spark, sf_dir), "prob", [0.1, 0.6, 0.7, 0.85, 0.95]))


@query(SQL + " select cls, count(*) as before, count(*) filter (where prob >= 0.75e0) as after, round(count(*) filter (where prob >= 0.75e0) / count(*), 9) as rate from scored group by 1")
def ag10_retention(spark, sf_dir):
    return rounded(stats.retention(scored(spark, sf_dir), "prob", 0.75))


@query(SQL + """, ts as (select unnest([0.6e0, 0.8e0, 0.95e0]) as t), k as (select t, image_no, seq, target_score, row_number() over (partition by t, image_no order by prob desc, seq) as k from scored, ts where prob > t)
select t as threshold, round(sum(target_score), 6) as total, count(*) filter (where target_score = 0) as misses, round(count(*) / (select count(distinct image_no) from scored), 6) as per_image from k where k <= 10 group by 1""")
def ag11_top_of_image(spark, sf_dir):
    return rounded(stats.top_of_image(scored(spark, sf_dir), "prob", "target_score", [0.6, 0.8, 0.95]), 6)


@query(SQL + """ select t as threshold, count(*) filter (where prob >= t) as selected, count(*) filter (where prob >= t and matched = 1) as tp, count(*) filter (where prob >= t and matched = 0) as fp,
round(count(*) filter (where prob >= t and matched = 1) / greatest(1, count(*) filter (where prob >= t)), 9) as precision from scored, (select unnest([0.6e0, 0.8e0, 0.999e0]) as t) group by 1""")
def ag12_discard_table(spark, sf_dir):
    return rounded(stats.discard_table(scored(spark, sf_dir), "prob", "matched", [0.6, 0.8, 0.999]))


@query(SQL + """ select count(*) as rows, count(distinct image_no) as images, count(*) filter (where target_score >= 0.9e0) as high, count(*) filter (where target_score >= 0.7e0 and target_score < 0.9e0) as middle,
count(*) filter (where target_score > 0 and target_score < 0.7e0) as low, count(*) filter (where target_score = 0) as none, round(high / rows, 9) as high_rate, round(middle / rows, 9) as middle_rate,
round(low / rows, 9) as low_rate, round(none / rows, 9) as none_rate from scored""")
def ag13_14_quality_buckets(spark, sf_dir):
    return rounded(stats.quality_buckets(scored(spark, sf_dir)))


@query(SQL + " select cls as true, guess, count(*) as n, round(count(*) / sum(count(*)) over (partition by cls), 9) as share from scored group by 1, 2")
def ag15_confusion(spark, sf_dir):
    return rounded(stats.confusion(scored(spark, sf_dir)))


REPORT = SQL + """, r0 as (select c as cls, count(*) filter (where cls = c and guess = c) as tp, count(*) filter (where guess = c) as got, count(*) filter (where cls = c) as support from scored, (select unnest(range(6)) as c) group by 1),
r1 as (select cls, coalesce(tp / nullif(got, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, support from r0),
r as (select cls, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support from r1)"""


@query(REPORT + " select cls::int as cls, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from r")
def ag16_class_report(spark, sf_dir):
    return rounded(stats.class_report(scored(spark, sf_dir), list(range(6))))


@query(REPORT + """ select round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1,
round(sum(recall * support) / sum(support), 9) as accuracy from r""")
def ag16_averages(spark, sf_dir):
    return rounded(stats.averages(stats.class_report(scored(spark, sf_dir), list(range(6)))))


TARGET = "(case cls when 0 then 0 when 1 then 0.6e0 when 2 then 1.5e0 when 3 then 2.7e0 else 4 end)"
CLASS = "((value >= 0.3e0)::int + (value >= 1)::int + (value >= 2.1e0)::int + (value >= 3.3e0)::int)"


@query(SQL + f" select round(avg(abs({TARGET} - value)), 9) as target_mae, round(avg(abs(cls - {CLASS})), 9) as class_mae from scored")
def ag17_mean_errors(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(s.agg(F.avg(F.abs(stats.ordinal_target("cls") - F.col("value"))).alias("target_mae"), F.avg(F.abs(F.col("cls") - stats.ordinal_class("value"))).alias("class_mae")))


@query(SQL + """, c as (select prob, count(*) filter (where matched = 1) as pos, count(*) filter (where matched = 0) as neg from scored group by 1),
w as (select *, coalesce(sum(pos) over (order by prob desc rows between unbounded preceding and 1 preceding), 0) as bp, coalesce(sum(neg) over (order by prob desc rows between unbounded preceding and 1 preceding), 0) as bn from c)
select round((sum(neg * (bp + pos / 2)) / (sum(pos) * sum(neg)))::double, 9) as auc, round((sum(pos * (bp + pos) / (bp + pos + bn + neg)) / sum(pos))::double, 9) as average_precision from w""")
def ag18_ranking_metrics(spark, sf_dir):
    return rounded(stats.ranking_metrics(scored(spark, sf_dir), "prob", "matched"))


@query(SQL + ", c as (select cls, count(*) as n from scored group by 1) select (select cls from c order by n desc, cls limit 1) as majority, round(max(n) / sum(n), 9) as accuracy from c")
def ag19_majority(spark, sf_dir):
    return rounded(stats.majority(scored(spark, sf_dir)))


@query(SQL + ", f as (select image_no % 5 as fold, avg(prob) as m from scored group by 1) select round(avg(m), 9) as mean, round(stddev_pop(m), 9) as std from f")
def ag20_fold_summary(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy((F.col("image_no") % 5).alias("fold")).agg(F.avg("prob").alias("m"))
    return rounded(per.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")))


@query(SQL + ", c as (select cls, count(*) as n from scored group by 1) select cls, round(sum(n) over () / (count(*) over () * n), 9) as weight from c")
def ag21_balanced_weights(spark, sf_dir):
    return rounded(stats.balanced_weights(scored(spark, sf_dir)))


@query(SQL + " select round(count(*) filter (where matched = 0) / count(*) filter (where matched = 1), 9) as scale_pos_weight from scored")
def ag22_imbalance_weight(spark, sf_dir):
    return rounded(scored(spark, sf_dir).agg((F.count_if(F.col("matched") == 0) / F.count_if(F.col("matched") == 1)).alias("scale_pos_weight")))


@query(SQL + " select count(distinct image_no) as images, count(*) as craters, round(count(*) / count(distinct image_no), 9) as per_image, round(avg(target_score), 9) as mean_score from scored")
def ag24_summary(spark, sf_dir):
    n, i = F.count(F.lit(1)), F.count_distinct("image_no")
    return rounded(scored(spark, sf_dir).agg(i.alias("images"), n.alias("craters"), (n / i).alias("per_image"), F.avg("target_score").alias("mean_score")))


@query(SQL + """, s as (select case seq % 3 when 0 then 'load' when 1 then 'infer' else 'extract' end as stage, prob as seconds from scored)
select stage, count(*) as n, round(sum(seconds), 6) as total, round(avg(seconds), 9) as mean, max(seconds) as most, round(sum(seconds) / sum(sum(seconds)) over (), 9) as share from s group by 1""")
def snk7_stage_report(spark, sf_dir):
    s = F.col("seq") % 3
    rows = scored(spark, sf_dir).select(F.when(s == 0, "load").when(s == 1, "infer").otherwise("extract").alias("stage"), F.col("prob").alias("seconds"))
    return rounded(stats.stage_report(rows).withColumn("total", F.round("total", 6)))


@query(SQL + " select seq, prob * 1.8e0 as mahanti_p, a * 0.85e0 as geometry_a, value from scored")
def prj1_group_scaling(spark, sf_dir):
    rows = scored(spark, sf_dir).select("seq", F.col("prob").alias("mahanti_p"), F.col("a").alias("geometry_a"), "value")
    return stats.scaled(rows, {"mahanti_": 1.8, "geometry_": 0.85})


@query(SQL + " select seq, round(prob * value, 9) as inter_product, round(value / (prob + 1e-6), 6) as inter_ratio from scored")
def prj2_interactions(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", F.round(F.col("prob") * F.col("value"), 9).alias("inter_product"), F.round(F.col("value") / (F.col("prob") + 1e-6), 6).alias("inter_ratio"))


@query(SQL + f" select seq, {TARGET}::double as target, {CLASS} as cls_of_value, matched from scored")
def prj3_5_targets(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", stats.ordinal_target("cls").alias("target"), stats.ordinal_class("value").alias("cls_of_value"), (F.col("target_score") > 0).cast("int").alias("matched"))


@query(SQL + " select seq from scored where cls >= 0 and target_score >= 0.9e0")
def flt11_class_and_quality(spark, sf_dir):
    return scored(spark, sf_dir).where((F.col("cls") >= 0) & (F.col("target_score") >= 0.9)).select("seq")


@query(SQL + f", r as (select {TARGET} - value as r from scored) select round(sum(-2 * (1 - exp(-abs(r)))**2 * r), 4) as gradient, round(sum(2 * (1 - exp(-abs(r)))**2 + 1e-6), 4) as hessian from r")
def mod4_focal_terms(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("t", stats.ordinal_target("cls"))
    g, h = stats.focal_terms("t", "value")
    return rows.agg(F.round(F.sum(g), 4).alias("gradient"), F.round(F.sum(h), 4).alias("hessian"))


GRID = [[0.2, 0.3, 0.4, 0.5, 0.6], [0.8, 0.9, 1.0, 1.1, 1.2], [1.8, 1.95, 2.1, 2.25, 2.4], [3.0, 3.15, 3.3, 3.45, 3.6]]
_G = ["[" + ", ".join(f"{x}e0" for x in g) + "]" for g in GRID]


@query(SQL + f""", g as (select t0, t1, t2, t3 from (select unnest({_G[0]}) as t0), (select unnest({_G[1]}) as t1), (select unnest({_G[2]}) as t2), (select unnest({_G[3]}) as t3) where t0 < t1 and t1 < t2 and t2 < t3),
h as (select cls, value, count(*) as n from scored group by 1, 2), c as (select t0, t1, t2, t3, cls, (value >= t0)::int + (value >= t1)::int + (value >= t2)::int + (value >= t3)::int as guess, n from h, g),
k as (select unnest(range(5)) as k), f as (select t0, t1, t2, t3, k, coalesce(2 * sum(n) filter (where cls = k and guess = k) / nullif(coalesce(sum(n) filter (where guess = k), 0) + coalesce(sum(n) filter (where cls = k), 0), 0), 0) as f1 from c, k group by all)
select t0, t1, t2, t3, round(avg(f1)::double, 9) as macro_f1 from f group by all order by round(avg(f1)::double, 12) desc, t0, t1, t2, t3 limit 1""")
def smp6_threshold_search(spark, sf_dir):
    return rounded(stats.threshold_search(scored(spark, sf_dir), "value", GRID))


@query(SQL + """, h as (select seq, cls, md5(concat(image_no, ':', seq, ':', 42)) as h from scored)
select seq, cls, ((row_number() over (partition by cls, substring(h, 1, 3) order by h, seq) + ('0x' || substring(h, 1, 3))::int) % 5)::int as fold from h""")
def smp2_stratified_folds(spark, sf_dir):
    return stats.folds(scored(spark, sf_dir)).select("seq", "cls", "fold")


@query(SQL + " select seq, md5(concat(seq, ':', 42)) as place from scored order by 2, 1")
def smp1_seeded_order(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", stats.seeded_place("seq").alias("place")).orderBy("place", "seq")
