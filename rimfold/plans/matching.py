"""Queries on joins, assignment, scores, geometry and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.functions import geometry as G
from rimfold.operators import match, score, select
from rimfold.plans.fixtures import BASE_SQL, MATCH_SQL, PAIRS_SQL, pred, truth
from rimfold.sources import ellipses, storage

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WITH, PAIRS, MATCH = "with " + BASE_SQL, "with " + PAIRS_SQL, "with recursive " + MATCH_SQL


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return truth(spark, sf_dir), pred(spark, sf_dir)


@query(WITH + """ select t.image_no, t.n_truth, coalesce(p.n_pred, 0) as n_pred from (select image_no, count(*) as n_truth from truth group by 1) t
left join (select image_no, count(*) as n_pred from pred group by 1) p using (image_no)""")
def jn1_truth_left_predictions(spark, sf_dir):
    t, p = both(spark, sf_dir)
    right = p.groupBy("image_no").agg(F.count(F.lit(1)).alias("n_pred"))
    return t.groupBy("image_no").agg(F.count(F.lit(1)).alias("n_truth")).join(right, "image_no", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))


@query(PAIRS + " select image_no, t_seq, p_seq from cand")
def jn2_range_join(spark, sf_dir):
    return match.candidate_pairs(*both(spark, sf_dir)).select("image_no", "t_seq", "p_seq")


@query(PAIRS + " select image_no, t_seq, p_seq from cand")
def jn2_grid_join(spark, sf_dir):
    return match.candidate_pairs(*both(spark, sf_dir), cell=128.0).select("image_no", "t_seq", "p_seq")


@query(PAIRS + " select image_no, t_seq, p_seq, round(dga, 6) as dga, round(xi2, 4) as xi2 from pairs")
def jn3_gaussian_angle(spark, sf_dir):
    return match.measured_pairs(*both(spark, sf_dir)).select("image_no", "t_seq", "p_seq", F.round("dga", 6).alias("dga"), F.round("xi2", 4).alias("xi2"))


@query(MATCH + " select image_no, t_seq, p_seq, round(dga, 6) as dga from matches")
def jn4_greedy_assignment(spark, sf_dir):
    return match.match_rows(match.greedy_matches(match.measured_pairs(*both(spark, sf_dir)))).withColumn("dga", F.round("dga", 6))


@query(PAIRS + """, best as (select image_no, p_seq, dga, xi2, t_cls from pairs qualify row_number() over (partition by image_no, p_seq order by dga, t_seq) = 1)
select p.image_no, p.seq as p_seq, round(case when xi2 < 13.277e0 then 1 - dga / pi() else 0 end, 6) as target_score, round(coalesce(xi2, -1), 4) as target_xi2,
case when xi2 < 13.277e0 then t_cls else -1 end as target_class from pred p left join best b on b.image_no = p.image_no and b.p_seq = p.seq""")
def jn5_best_truth(spark, sf_dir):
    xi2 = F.when(F.col("target_xi2") == float("inf"), -1.0).otherwise(F.round("target_xi2", 4))
    return match.best_truth(*both(spark, sf_dir)).select("image_no", "p_seq", F.round("target_score", 6).alias("target_score"), xi2.alias("target_xi2"), "target_class")


@query(PAIRS + """, g as (select image_no, p_seq, max(1 - dga / pi()) as best from pairs where xi2 < 13.277e0 group by 1, 2)
select p.image_no, p.seq as p_seq, round(coalesce(best, 0), 6) as gold_score from pred p left join g on g.image_no = p.image_no and g.p_seq = p.seq""")
def jn6_highest_score(spark, sf_dir):
    return match.highest_score(*both(spark, sf_dir)).withColumn("gold_score", F.round("gold_score", 6))


@query(WITH + """ select t.image_no, count(*) as truths, count(*) filter (where h) as hits, count(*) filter (where h) / count(*) as recall from
(select t.image_no, exists (select 1 from pred p where p.image_no = t.image_no and sqrt((t.cx - p.cx)**2 + (t.cy - p.cy)**2) < least(t.a, t.b)) as h from truth t) t group by 1""")
def jn7_centre_recall(spark, sf_dir):
    return match.centre_recall(*both(spark, sf_dir))


@query(WITH + " select seq from truth where image_no in (select image_no from pred where conf > 0.99)")
def jn8_tested_truth(spark, sf_dir):
    t, p = both(spark, sf_dir)
    return ellipses.tested_subset(t, p.where("conf > 0.99")).select("seq")


@query(WITH + " select seq from pred p where not exists (select 1 from pred q where q.conf >= 0.7 and q.image_no = p.image_no and q.seq = p.seq)")
def jn9_rescue_anti_join(spark, sf_dir):
    p = pred(spark, sf_dir)
    return select.unselected(p, p.where("conf >= 0.7")).select("seq")


@query(MATCH + """, w as (select image_no, count(*) as expected from truth where b >= 5 group by 1),
c as (select p.image_no, count(*) as candidates, count(m.p_seq) as matched from pred p left join matches m on m.image_no = p.image_no and m.p_seq = p.seq group by 1)
select c.image_no, candidates, coalesce(expected, 0) as expected, matched, round(coalesce(matched / nullif(expected, 0), 0), 9) as recall, coalesce(matched / nullif(expected, 0), 0) < 0.3e0 as low
from c left join w using (image_no)""")
def jn10_expected_and_matched(spark, sf_dir):
    return score.expected_and_matched(*both(spark, sf_dir)).withColumn("recall", F.round("recall", 9))


@query(WITH + " select p.image_no, p.seq, coalesce(t.cls, 4) as cls from pred p left join truth t on t.image_no = p.image_no and t.seq = p.seq and t.cls < 3")
def jn11_class_lookup(spark, sf_dir):
    t, p = both(spark, sf_dir)
    return ellipses.with_class(p, t.where("cls < 3").select("image_no", "seq", "cls")).select("image_no", "seq", "cls")


SCORES = """, s as (select image_no, count(*) as n_match, sum(1 - dga / pi()) as good from matches group by 1),
sc as (select t.image_no, n_truth, coalesce(n_pred, 0) as n_pred, coalesce(n_match, 0) as n_match,
coalesce(good / n_pred * least(1, n_match / least(10, n_truth)), 0) as score from (select image_no, count(*) as n_truth from truth group by 1) t
left join (select image_no, count(*) as n_pred from pred group by 1) p using (image_no) left join s using (image_no))"""


@query(MATCH + SCORES + " select image_no, n_truth, n_pred, n_match, round(score, 6) as score from sc")
def ag1_image_score(spark, sf_dir):
    return score.image_scores(*both(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(MATCH + SCORES + " select count(*) as images, sum(n_match)::bigint as matches, round(100 * avg(score), 6) as dataset_score from sc")
def ag2_dataset_score(spark, sf_dir):
    return score.dataset_score(score.image_scores(*both(spark, sf_dir))).withColumn("dataset_score", F.round("dataset_score", 6))


@query(MATCH.replace("pairs as (select *, dga", "pairs as (select * replace (case when det < 1e-9 then pi() else dga end as dga), dga").replace("select image_no, t_seq, list(", "select image_no, t_seq, list(")
       + SCORES + " select image_no, n_match, round(score, 6) as score from sc")
def ag3_guarded_score(spark, sf_dir):
    return score.image_scores(*both(spark, sf_dir), sentinels=False, guard=1e-9).select("image_no", "n_match", F.round("score", 6).alias("score"))


@query(MATCH + """ select p.image_no, p.seq as p_seq, (m.p_seq is not null)::int as matched, round(coalesce(1 - dga / pi(), 0), 6) as match_score
from pred p left join matches m on m.image_no = p.image_no and m.p_seq = p.seq""")
def ag4_prediction_details(spark, sf_dir):
    return score.prediction_details(*both(spark, sf_dir)).withColumn("match_score", F.round("match_score", 6))


# --- geometry ---
SHAPE = ("a", "b", "rot")


@query(WITH + """ select seq, round(1e4 * (cos(radians(rot))**2 / a**2 + sin(radians(rot))**2 / b**2), 6) as y11, round(1e4 * cos(radians(rot)) * sin(radians(rot)) * (1 / a**2 - 1 / b**2), 6) + 0.0 as y12,
round(1e4 * (sin(radians(rot))**2 / a**2 + cos(radians(rot))**2 / b**2), 6) as y22 from truth""")
def geo1_configuration(spark, sf_dir):
    y = G.configuration(*SHAPE)
    return truth(spark, sf_dir).select("seq", *[(F.round(1e4 * c, 6) + 0.0).alias(n) for c, n in zip(y, ("y11", "y12", "y22"))])


@query(PAIRS + " select t_seq, p_seq, round(case when det < 1e-6 then 1.57e0 else dga end, 6) as dga, round(case when det < 1e-6 then 1.57e0 else dga end**2 / ((0.85e0 / (sqrt(ta * tb) + 1e-6) * 0.07e0 * least(ta, tb))**2 + 1e-12), 4) as xi2 from pairs")
def geo4_guarded_angle(spark, sf_dir):
    t, p = tuple(f"t_{c}" for c in match.SHAPE), tuple(f"p_{c}" for c in match.SHAPE)
    rows = match.candidate_pairs(*both(spark, sf_dir)).withColumn("d", G.gaussian_angle(t, p, 1e-6, 1.57))
    return rows.select("t_seq", "p_seq", F.round("d", 6).alias("dga"), F.round(G.xi_squared("d", "t_a", "t_b", 1e-6, 1e-12), 4).alias("xi2"))


@query(PAIRS + """ select t_seq, p_seq, round(abs(((cos(radians(tr)) * (px - tx) + sin(radians(tr)) * (py - ty)) / ta)**2 + ((cos(radians(tr)) * (py - ty) - sin(radians(tr)) * (px - tx)) / tb)**2 - 1), 6) as d from cand""")
def geo5_algebraic_distance(spark, sf_dir):
    d = G.algebraic_distance("p_cx", "p_cy", "t_cx", "t_cy", "t_a", "t_b", "t_rot")
    return match.candidate_pairs(*both(spark, sf_dir)).select("t_seq", "p_seq", F.round(d, 6).alias("d"))


@query(WITH + """ select seq, k, round(cx + a * cos(2 * pi() * k / 8) * cos(radians(rot)) - b * sin(2 * pi() * k / 8) * sin(radians(rot)), 6) as x,
round(cy + a * cos(2 * pi() * k / 8) * sin(radians(rot)) + b * sin(2 * pi() * k / 8) * cos(radians(rot)), 6) as y from truth, (select unnest(range(8))::int as k)
where trunc(x) between 0 and 2591 and trunc(y) between 0 and 2047""".replace("where trunc(x)", "where trunc(cx + a * cos(2 * pi() * k / 8) * cos(radians(rot)) - b * sin(2 * pi() * k / 8) * sin(radians(rot)))").replace("and trunc(y)", "and trunc(cy + a * cos(2 * pi() * k / 8) * sin(radians(rot)) + b * sin(2 * pi() * k / 8) * cos(radians(rot)))"))
def geo7_perimeter_samples(spark, sf_dir):
    return select.perimeter_samples(truth(spark, sf_dir), 8, 2592, 2048).select("seq", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(WITH + """ select seq, round(case when sqrt(greatest(0, 1 - (least(a, b) / greatest(a, b))**2)) < 0.5e0 then b * (greatest(a, b) * sqrt(1 - 0.5e0 * 0.5e0) / least(a, b)) else b end, 6) as b2 from truth""")
def geo8_eccentricity_floor(spark, sf_dir):
    return truth(spark, sf_dir).select("seq", F.round(G.eccentricity_floor("a", "b", 0.5), 6).alias("b2"))


@query(WITH + " select seq, round(a * b / (sqrt((b * cos(1 - radians(rot)))**2 + (a * sin(1 - radians(rot)))**2) + 1e-9), 6) as r from truth")
def geo9_polar_radius(spark, sf_dir):
    return truth(spark, sf_dir).select("seq", F.round(G.polar_radius(F.lit(1.0), "a", "b", F.radians("rot")), 6).alias("r"))


@query(WITH + """ select seq, round(sqrt(a**2 * cos(radians(rot))**2 + b**2 * sin(radians(rot))**2), 6) as ux, round(sqrt(a**2 * sin(radians(rot))**2 + b**2 * cos(radians(rot))**2), 6) as uy from truth""")
def geo10_bounding_box(spark, sf_dir):
    return truth(spark, sf_dir).select("seq", *[F.round(c, 6).alias(n) for c, n in zip(G.bounding_half(*SHAPE), ("ux", "uy"))])


@query(PAIRS + """ select t_seq, p_seq, round(case when sqrt((tx - px)**2 + (ty - py)**2) < 0.8e0 * greatest(ta, tb, pa, pb) then least(ta * tb, pa * pb) / greatest(ta * tb, pa * pb) else 0 end, 6) as overlap from cand""")
def geo11_overlap(spark, sf_dir):
    o = G.overlap("t_cx", "t_cy", "t_a", "t_b", "p_cx", "p_cy", "p_a", "p_b")
    return match.candidate_pairs(*both(spark, sf_dir)).select("t_seq", "p_seq", F.round(o, 6).alias("overlap"))


@query(WITH + """ select image_no, round(avg(conf), 9) as mean, round(stddev_pop(conf), 9) as std, round(median(conf), 9) as median, round(quantile_cont(conf, 0.2), 9) as p20,
round(sum(conf) / (count(*) + 1e-6), 9) as ratio from pred group by 1""")
def geo12_statistics(spark, sf_dir):
    r = lambda c, n: F.round(c, 9).alias(n)
    return pred(spark, sf_dir).groupBy("image_no").agg(
        r(F.avg("conf"), "mean"), r(F.stddev_pop("conf"), "std"), r(F.median("conf"), "median"), r(F.percentile("conf", 0.2), "p20"), r(F.sum("conf") / (F.count(F.lit(1)) + 1e-6), "ratio"),
    )


@query(WITH + """, q as (select seq, a, b, pi() * a * b as area, pi() * (3 * (a + b) - sqrt((3 * a + b) * (a + 3 * b))) as len from truth)
select seq, round(len, 6) as perimeter, round(4 * pi() * area / (len * len), 6) as circularity, round(len / area, 6) as continuity, round(1 / (1 + exp(-(a - b) / 10)), 6) as sig from q""")
def geo13_15_shape_numbers(spark, sf_dir):
    area, length = F.lit(G.PI) * F.col("a") * F.col("b"), G.perimeter("a", "b")
    rows = truth(spark, sf_dir).select("seq", "a", "b", area.alias("area"), length.alias("len"))
    return rows.select("seq", F.round("len", 6).alias("perimeter"), F.round(G.circularity("area", "len"), 6).alias("circularity"),
                       F.round(G.continuity("area", "len"), 6).alias("continuity"), F.round(G.sigmoid((F.col("a") - F.col("b")) / 10, 88.0), 6).alias("sig"))


@query(WITH + """, q as (select seq, conf as s, (1 - conf) as r, abs(a - b) / a as p, (rot % 30) / 100 as g from pred)
select seq, round(case when s < 0.6e0 or r > 0.5e0 or g > 0.25e0 then 0 else 0.35e0 * s + 0.30e0 * (1 - least(1, r)) + 0.20e0 * (1 - least(1, p)) + 0.15e0 * (1 - least(1, g)) end, 6) as score from q""")
def geo16_polar_score(spark, sf_dir):
    p = pred(spark, sf_dir)
    return p.select("seq", F.round(G.polar_score("conf", 1 - F.col("conf"), F.abs(F.col("a") - F.col("b")) / F.col("a"), (F.col("rot") % 30) / 100), 6).alias("score"))


@query()
def geo6_orthogonal_distance(spark, sf_dir):
    d = G.orthogonal_distance("p_cx", "p_cy", "t_cx", "t_cy", "t_a", "t_b", "t_rot")
    return match.candidate_pairs(*both(spark, sf_dir)).select("t_seq", "p_seq", F.round(d, 6).alias("d"))


# --- selection ---
@query(WITH + " select image_no, seq, row_number() over (partition by image_no order by conf desc, seq) as rank from pred qualify rank <= 12")
def tk1_2_best_by_confidence(spark, sf_dir):
    return select.best_rows(pred(spark, sf_dir), "conf", 12).select("image_no", "seq", "rank")


@query(WITH + " select image_no, seq, row_number() over (partition by image_no order by rot desc, seq) as rank from pred qualify rank <= 3")
def tk3_other_sort_key(spark, sf_dir):
    return select.best_rows(pred(spark, sf_dir), "rot", 3).select("image_no", "seq", "rank")


LADDER = """, ladder as (select unnest([0.7e0, 0.69e0, 0.6799999999999999e0, 0.6699999999999999e0, 0.6599999999999999e0, 0.6499999999999999e0, 0.6399999999999999e0, 0.6299999999999999e0, 0.6199999999999999e0, 0.6099999999999999e0, 0.5999999999999999e0]) as t),
n as (select image_no, t, count(*) filter (where conf >= t) as n from pred, ladder group by 1, 2),
th as (select image_no, coalesce(max(t) filter (where n >= 10), min(t)) as t from n group by 1),
picked as (select p.image_no, p.seq, th.t from pred p join th using (image_no) where p.conf >= th.t)"""


@query(WITH + LADDER + " select image_no, seq, round(t, 9) as threshold from picked")
def tk4_adaptive_threshold(spark, sf_dir):
    return select.adaptive_selection(pred(spark, sf_dir)).select("image_no", "seq", F.round("threshold", 9).alias("threshold"))


@query(WITH + LADDER + """, c as (select image_no, count(*) as n from picked group by 1),
r as (select p.image_no, p.seq, coalesce(c.n, 0) as n, row_number() over (partition by p.image_no order by (p.conf * 1.4e0) desc, p.seq) as k from pred p left join c using (image_no)
where p.conf * 1.4e0 >= 0.85e0 and not exists (select 1 from picked q where q.image_no = p.image_no and q.seq = p.seq))
select image_no, seq, 'selected' as origin from picked union all select image_no, seq, 'rescued' from r where k <= 10 - n""")
def tk5_rescue(spark, sf_dir):
    p = pred(spark, sf_dir).withColumn("rescue", F.col("conf") * 1.4)
    return select.rescue_fill(select.adaptive_selection(p), p, "rescue").select("image_no", "seq", "origin")


@query(WITH + " select seq, round(a * b, 6) as area from truth order by a * b desc, seq limit 20")
def tk6_global_top(spark, sf_dir):
    return truth(spark, sf_dir).select("seq", (F.col("a") * F.col("b")).alias("area")).orderBy(F.desc("area"), "seq").limit(20).withColumn("area", F.round("area", 6))


@query(WITH + " select image_no, seq from (select *, conf - 0.6e0 as s from pred) where s > 0 qualify row_number() over (partition by image_no order by s desc, seq) <= 10")
def tk7_positive_scores(spark, sf_dir):
    rows = pred(spark, sf_dir).withColumn("s", F.col("conf") - 0.6).where("s > 0")
    return select.best_rows(rows, "s", 10).select("image_no", "seq")


@query(WITH + " select distinct image_no from truth order by 1 limit 10")
def tk8_listing_limit(spark, sf_dir):
    return truth(spark, sf_dir).select("image_no").distinct().orderBy("image_no").limit(10)


@query("with recursive " + BASE_SQL + """, o as (select image_no, list({'s': seq, 'x': cx, 'y': cy, 'r': sqrt(a * b)} order by conf desc, seq) as c from pred group by 1),
f as (select image_no, c, 1::bigint as k, [c[1]] as kept from o union all
select image_no, c, k + 1, case when len(list_filter(kept, lambda q: sqrt((q.x - c[k + 1].x)**2 + (q.y - c[k + 1].y)**2) < greatest(abs(q.r - c[k + 1].r), 0.8e0 * (q.r + c[k + 1].r)))) > 0 then kept else list_append(kept, c[k + 1]) end from f where k < len(c))
select image_no, unnest(kept).s as seq from f where k = len(c)""")
def sg14_overlap_suppression(spark, sf_dir):
    return select.suppress_overlaps(pred(spark, sf_dir))


# --- filters ---
@query(WITH + " select seq from truth where b >= 50")
def flt1_minimum_size(spark, sf_dir):
    return truth(spark, sf_dir).where("b >= 50").select("seq")


@query(WITH + " select seq from (select seq, case when seq % 7 = 0 then null else cx end as cx, case when seq % 11 = 0 then -1 else a end as a, b from truth) where cx is not null and a > 0 and b > 0")
def flt2_3_missing_and_degenerate(spark, sf_dir):
    t = truth(spark, sf_dir).withColumns({"cx": F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("cx")), "a": F.when(F.col("seq") % 11 == 0, -1.0).otherwise(F.col("a"))})
    return ellipses.usable(t).select("seq")


PATHS = """, paths as (select seq, 'altitude' || lpad((1 + image_no % 9)::varchar, 2, '0') || '/longitude' || lpad((1 + (image_no // 9) % 20)::varchar, 2, '0') || '/orientation' || lpad(image_no::varchar, greatest(2, length(image_no::varchar))::int, '0') || '_light01' as path from truth)"""


@query(WITH + PATHS + " select seq, split_part(path, '/', 1) || '_' || split_part(path, '/', 2) in ('altitude01_longitude10', 'altitude01_longitude14', 'altitude04_longitude13', 'altitude06_longitude13', 'altitude09_longitude08') as validation from paths")
def flt4_5_group_split(spark, sf_dir):
    return ellipses.with_paths(truth(spark, sf_dir)).select("seq", ellipses.in_validation("path").alias("validation"))


@query(WITH + PATHS + " select distinct path from paths where path like '%altitude04%' and path like '%longitude13%'")
def flt6_path_parts(spark, sf_dir):
    return ellipses.with_paths(truth(spark, sf_dir)).where(F.col("path").contains("altitude04") & F.col("path").contains("longitude13")).select("path").distinct()


@query(WITH + """ , r as (select seq, cx, cy, least(a, b) as m, a * abs(cos(radians(rot))) + b * abs(sin(radians(rot))) as hw, a * abs(sin(radians(rot))) + b * abs(cos(radians(rot))) as hh from pred)
select seq from r where m >= 40 and 2 * hw + 2 * hh < 0.6e0 * least(2592, 2048) and cx - hw >= 0 and cy - hh >= 0 and cx + hw < 2592 and cy + hh < 2048""")
def flt7_visible(spark, sf_dir):
    return select.visible(pred(spark, sf_dir), 2592, 2048).select("seq")


@query(WITH + """, r as (select seq, a * b as area, 2 * b as minor, sqrt(greatest(0, 1 - (b / (a + 1e-6))**2)) as ecc, 0.6e0 + (seq % 40) / 100.0e0 as solidity from truth)
select seq from r where area >= 40 and minor >= greatest(3, 0.02e0 * sqrt(area)) and not (ecc > 0.6e0 and area < 2000) and not (solidity < 0.7e0 and area < 3000)""")
def flt8_region_shape(spark, sf_dir):
    rows = truth(spark, sf_dir).select("seq", (F.col("a") * F.col("b")).alias("area"), (2 * F.col("b")).alias("minor"), G.eccentricity("a", "b").alias("ecc"), (0.6 + (F.col("seq") % 40) / 100.0).alias("solidity"))
    return select.region_shape(rows, ecc=0.6, ecc_area=2000, solidity_area=3000).select("seq")


@query(WITH + " select count(*) filter (where conf >= 0.7) as at_least, count(*) filter (where conf > 0.7) as above from pred")
def flt10_threshold(spark, sf_dir):
    return pred(spark, sf_dir).agg(F.count_if(F.col("conf") >= 0.7).alias("at_least"), F.count_if(F.col("conf") > 0.7).alias("above"))


@query(WITH + " select seq, round(case when a >= 5 and b >= 5 and greatest(a, b) / (least(a, b) + 1e-6) < 1.2e0 then a else cx / 10 end, 6) as w from truth")
def flt12_valid_ellipse(spark, sf_dir):
    return truth(spark, sf_dir).select("seq", F.round(F.when(select.valid_axes("a", "b", 1.2), F.col("a")).otherwise(F.col("cx") / 10), 6).alias("w"))


# --- paths, sizes, sets ---
@query(WITH + PATHS + " select seq, replace(path, '/', '_') as flat, path from paths")
def prj6_path_ids(spark, sf_dir):
    rows = ellipses.with_paths(truth(spark, sf_dir)).select("seq", ellipses.flat_id("path").alias("flat"))
    return rows.select("seq", "flat", ellipses.path_of("flat").alias("path"))


@query(WITH + """ select image_no, 100 + image_no * 37 % 3000 as w, 90 + image_no * 53 % 2500 as h,
(case when w >= h then 1296 else round_even(w::double * 1296 / h, 0) end)::bigint as rw, (case when w >= h then round_even(h::double * 1296 / w, 0) else 1296 end)::bigint as rh from (select distinct image_no from truth)""")
def prj7_resize_dims(spark, sf_dir):
    rows = truth(spark, sf_dir).select("image_no").distinct().select("image_no", (100 + F.col("image_no") * 37 % 3000).alias("w"), (90 + F.col("image_no") * 53 % 2500).alias("h"))
    rw, rh = ellipses.resize_dims("w", "h", 1296)
    return rows.select("image_no", "w", "h", rw.alias("rw"), rh.alias("rh"))


@query(WITH + " select seq from truth where seq % 2 = 0 union all select seq from pred")
def set1_union(spark, sf_dir):
    t, p = both(spark, sf_dir)
    return t.where("seq % 2 = 0").unionByName(p, allowMissingColumns=True).select("seq")


@query(WITH + " select distinct cls, floor(rot / 30)::bigint as sector from truth")
def set2_distinct(spark, sf_dir):
    return truth(spark, sf_dir).select("cls", F.floor(F.col("rot") / 30).alias("sector")).distinct()


@query(WITH + """ select t.image_no, round(coalesce(p.cx, -1), 2) as x, round(coalesce(p.cy, -1), 2) as y, coalesce(p.seq, -1) as seq from (select distinct image_no from truth) t
left join (select * from pred where conf > 0.98) p using (image_no)""")
def snk1_solution_rows(spark, sf_dir):
    t, p = both(spark, sf_dir)
    rows = ellipses.solution_rows(t.select("image_no").distinct(), p.where("conf > 0.98"))
    return rows.select("image_no", F.round("cx", 2).alias("x"), F.round("cy", 2).alias("y"), "seq")


@query(WITH + " select t.image_no, count(p.seq) as n from (select distinct image_no from truth) t left join (select * from pred where conf > 0.8) p using (image_no) group by 1 having count(p.seq) < 10")
def snk4_low_counts(spark, sf_dir):
    t, p = both(spark, sf_dir)
    return ellipses.low_counts(t.select("image_no").distinct(), p.where("conf > 0.8"))


# --- sources and sinks ---
@query(WITH + PATHS + " select t.seq as row_seq, round(t.cx, 2) as cx, round(t.a, 2) as a, p.path as image, t.cls from truth t join paths p using (seq)")
def src1_snk1_csv_round_trip(spark, sf_dir):
    rows = ellipses.with_paths(truth(spark, sf_dir)).withColumnRenamed("path", "image").withColumn("cy", F.col("seq").cast("double"))
    path = storage.folder(spark)
    ellipses.write_csv(rows, path)
    return ellipses.read_csv(spark, path).select(F.col("cy").cast("long").alias("row_seq"), "cx", "a", "image", "cls")


@query(WITH + " select seq, cls from truth where cls in (1, 3)")
def src7_snk8_tile_store(spark, sf_dir):
    path = storage.folder(spark)
    storage.write_tiles(truth(spark, sf_dir).select("seq", "cls"), path, "cls")
    return storage.read_tiles(spark, path, [1, 3], "cls").select("seq", "cls")


@query(WITH + " select image_no, count(*) as truths, round(avg(b), 9) as mean_b from truth where b >= 50 group by 1")
def snk2_per_image_rows(spark, sf_dir):
    t = truth(spark, sf_dir).where("b >= 50")
    return t.groupBy("image_no").agg(F.count(F.lit(1)).alias("truths"), F.round(F.avg("b"), 9).alias("mean_b"))
