"""Queries on boosted models: rankers, ordinal and multiclass models, cross-validation, random search. The SQL grows the same trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.operators import boost, stats
from rimfold.operators.boost import Spec
from rimfold.plans.analysis import CLASS, SQL as SCORED, TARGET, scored

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FEATURES = ["prob", "value", "a"]
EDGES = [[0.55 + 0.0225 * k for k in range(1, 20)], [0.2 * k for k in range(1, 20)], [40.0 + 4 * k for k in range(1, 20)]]
#: Class weights of the balanced focal loss, brought down by 100 (fixed values).
WEIGHTS = {0: 2.0, 1: 1.0, 2: 0.2, 3: 0.1, 4: 0.01}
GRID = {"rate": [0.2, 0.4, 0.6, 1.0], "leaves": [2, 3, 4], "least": [20, 30, 50, 100], "l1": [0.0, 0.1, 1.0, 5.0], "l2": [0.0, 0.1, 1.0, 5.0]}


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates with folds and targets that the inputs decide in part."""
    rows = stats.folds(scored(spark, sf_dir).withColumn("cls", easy_class()))
    weight = F.create_map(*[x for c, w in WEIGHTS.items() for x in (F.lit(c), F.lit(w))])
    multi = {f"is{c}": (F.when(F.col("prob") < 0.7, 0).when(F.col("value") < 2, 1).otherwise(2) == c).cast("double") for c in range(3)}
    return rows.withColumns({"target": stats.ordinal_target("cls"), "w": F.element_at(weight, F.col("cls")), "positive": F.col("matched").cast("double"), **multi})


def easy_class() -> F.Column:
    """The class that prob and value give, for two rows in three; the given one for the third."""
    return F.when(F.col("seq") % 3 == 0, F.col("cls")).otherwise(F.least(F.lit(4), F.floor((F.col("prob") - 0.55) * 6 + F.col("value") * 0.6)).cast("int"))


def rows_sql(targets: list[str], weight: str = "1.0e0") -> str:
    """d: seq, cls, fold, w, ys, and b: a feature's bin a row."""
    inputs = " union all ".join(f"select seq, {f} as feature, len(list_filter([{', '.join(f'{e!r}::double' for e in cuts)}], lambda c: c < {name})) as bin from d" for f, (name, cuts) in enumerate(zip(FEATURES, EDGES)))
    return (
        SCORED + """, r as (select image_no, seq, a, prob, value, matched, case when seq % 3 = 0 then cls else least(4, floor((prob - 0.55e0) * 6 + value * 0.6e0)::int) end as cls from scored),
hs as (select *, md5(concat(image_no, ':', seq, ':', 42)) as h from r),
d as materialized (select seq, cls, prob, value, a, ((row_number() over (partition by cls, substring(h, 1, 3) order by h, seq) + ('0x' || substring(h, 1, 3))::int) % 5)::int as fold, """
        + f"{weight} as w, [{', '.join(targets)}] as ys from hs),\nb as materialized ({inputs})"
    )


def boosted_sql(rows: str, specs: list[Spec], *, rounds: int, depth: int, loss: str = "focal", from_mean: bool = True) -> str:
    """CTEs that grow the models on d and b: p<k> has predictions after k trees, n<k> the nodes of tree k, v<k> what the fold shows."""
    values = ", ".join(f"({m}, {s.fold}, {s.target}, {s.rate}e0, {s.leaves}, {s.least}, {s.l1}e0, {s.l2}e0)" for m, s in enumerate(specs))
    edges = ", ".join(f"({f}, {k}, {e!r}::double)" for f, cuts in enumerate(EDGES) for k, e in enumerate(cuts))
    train, w = "(k.fold < 0 or d.fold <> k.fold)", "d.w * (1 - exp(-abs(d.ys[k.target + 1] - p.pred)))**2"
    r = "(d.ys[k.target + 1] - p.pred)"
    terms = {"focal": (f"-2 * {w} * {r}", f"2 * {w} + 1e-6"), "logistic": (f"d.w * (1 / (1 + exp(-p.pred)) - d.ys[k.target + 1])", "d.w / (1 + exp(-p.pred)) * (1 - 1 / (1 + exp(-p.pred)))")}[loss]
    base = f"sum(d.ys[k.target + 1] * d.w) filter (where {train}) / sum(d.w) filter (where {train})" if from_mean and loss != "logistic" else "0.0e0"
    soft = lambda g: f"(sign({g}) * greatest(0, abs({g}) - k.l1))"
    out = f"""{rows},
spec(model, fold, target, rate, leaves, least, l1, l2) as (values {values}), e(feature, bin, edge) as (values {edges}),
p0 as materialized (select k.model, d.seq, m.base as pred from d, spec k join (select k.model, {base} as base from spec k, d group by 1) m using (model))"""
    for t in range(1, rounds + 1):
        out += f""",
g{t} as materialized (select p.model, p.seq, {terms[0]} as g, {terms[1]} as h from p{t - 1} p join d using (seq) join spec k using (model) where {train}),
a{t}_0 as (select model, seq, 1 as node from p{t - 1})"""
        for level in range(depth):
            before = " + ".join(["1", *[f"(select count(*) from s{t}_{x} o where o.model = z.model)" for x in range(level)]])
            out += f""",
h{t}_{level} as materialized (select a.model, a.node, b.feature, b.bin, sum(g) as g, sum(h) as h, count(*) as n from a{t}_{level} a join g{t} using (model, seq) join b using (seq) where a.node >= {1 << level} group by all),
c{t}_{level} as (select model, node, feature, bin, sum(g) over l as lg, sum(h) over l as lh, sum(n) over l as ln, sum(g) over f as g, sum(h) over f as h, sum(n) over f as n from h{t}_{level}
 window f as (partition by model, node, feature), l as (partition by model, node, feature order by bin rows between unbounded preceding and current row)),
x{t}_{level} as (select c.*, round({soft('lg')}**2 / (lh + k.l2) + {soft('g - lg')}**2 / (h - lh + k.l2) - {soft('g')}**2 / (h + k.l2), 6) as gain, k.leaves from c{t}_{level} c join spec k using (model) where ln >= k.least and n - ln >= k.least),
y{t}_{level} as (select * from x{t}_{level} where gain > 0 qualify row_number() over (partition by model, node order by gain desc, feature, bin) = 1),
s{t}_{level} as materialized (select * exclude (k, leaves) from (select *, row_number() over (partition by model order by gain desc, node) as k from y{t}_{level}) z where k <= leaves - ({before})),
a{t}_{level + 1} as materialized (select a.model, a.seq, case when s.node is null then a.node when b.bin <= s.bin then 2 * a.node else 2 * a.node + 1 end as node from a{t}_{level} a left join s{t}_{level} s using (model, node) left join b on b.seq = a.seq and b.feature = s.feature)"""
        splits = " union all ".join(f"select * from s{t}_{x}" for x in range(depth))
        out += f""",
w{t} as materialized ({splits}),
n{t} as materialized (select q.model, q.node, coalesce(w.feature, -1) as feature, e.edge as threshold, w.gain, q.n, case when w.node is null then -1 * {soft('q.g')} / (q.h + k.l2) end as value
 from (select model, 1 as node, sum(g) as g, sum(h) as h, count(*) as n from g{t} group by 1 union all select model, 2 * node, lg, lh, ln from w{t} union all select model, 2 * node + 1, g - lg, h - lh, n - ln from w{t}) q
 join spec k using (model) left join w{t} w using (model, node) left join e on e.feature = w.feature and e.bin = w.bin),
p{t} as materialized (select a.model, a.seq, p.pred + k.rate * n.value as pred from a{t}_{depth} a join p{t - 1} p using (model, seq) join spec k using (model) join n{t} n using (model, node)),
u{t} as (select p.model, d.cls, {CLASS.replace('value', 'p.pred')} as guess, abs(d.ys[k.target + 1] - p.pred) as off from p{t} p join d using (seq) join spec k using (model) where d.fold = k.fold),
v{t} as (select model, {t} as tree, avg(f1) as macro_f1, any_value(accuracy) as accuracy, any_value(mae) as mae from (select model, c, coalesce(2 * count(*) filter (where cls = c and guess = c)::double / nullif(count(*) filter (where cls = c) + count(*) filter (where guess = c), 0), 0) as f1,
 avg((cls = guess)::int) as accuracy, avg(off) as mae from u{t}, (select unnest(range(5)) as c) group by 1, 2) group by 1)"""
    return out


def union(name: str, rounds: int, tree: bool = True) -> str:
    return " union all ".join(f"select {f'{t} as tree, ' if tree else ''}* from {name}{t}" for t in range(1, rounds + 1))


TREE = [Spec(leaves=6, rate=0.3, l1=0.5, l2=1.0)]


@query(boosted_sql(rows_sql([TARGET], f"case cls {' '.join(f'when {c} then {w}e0' for c, w in WEIGHTS.items())} end"), TREE, rounds=3, depth=3) + f" select tree, node, feature, round(threshold, 6) as threshold, round(gain, 3) as gain, n, round(value, 6) as value from ({union('n', 3)})")
def mod3_trees(spark, sf_dir):
    """The nodes of three trees of the class-balanced focal loss: splits, gains and leaf values."""
    model = boost.boost(examples(spark, sf_dir), FEATURES, ["target"], TREE, key="seq", weight="w", rounds=3, depth=3, edges=EDGES)
    return model.nodes(spark).select("tree", "node", "feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 3).alias("gain"), "n", F.round("value", 6).alias("value"))


ORDINAL = [Spec(rate=0.6, leaves=8)]


@query(boosted_sql(rows_sql([TARGET]), ORDINAL, rounds=4, depth=3) + f" select seq, round(pred, 6) as ordinal, {CLASS.replace('value', 'pred')} as cls from p4")
def mod3_ordinal(spark, sf_dir):
    rows = examples(spark, sf_dir)
    model = boost.boost(rows, FEATURES, ["target"], ORDINAL, key="seq", rounds=4, depth=3, edges=EDGES)
    return model.scores(rows).select("seq", F.round(F.col("scores")[0], 6).alias("ordinal"), stats.ordinal_class(F.col("scores")[0]).alias("cls"))


RANKER = [Spec(rate=0.3, leaves=8, least=10)]


@query(boosted_sql(rows_sql(["matched::double"], "case when matched = 1 then (select count(*) filter (where matched = 0) / count(*) filter (where matched = 1)::double from r) else 1.0e0 end"), RANKER, rounds=4, depth=3, loss="logistic") + " select seq, round(1 / (1 + exp(-pred)), 6) as rank_score from p4")
def mod2_ranker(spark, sf_dir):
    """A binary ranker; positives weigh negatives over positives."""
    rows = examples(spark, sf_dir)
    share = rows.agg((F.count_if(F.col("matched") == 0) / F.count_if(F.col("matched") == 1)).alias("s")).first()["s"]
    rows = rows.withColumn("w", F.when(F.col("matched") == 1, share).otherwise(1.0))
    model = boost.boost(rows, FEATURES, ["positive"], RANKER, key="seq", weight="w", loss="logistic", rounds=4, depth=3, edges=EDGES)
    return model.scores(rows).select("seq", F.round(1 / (1 + F.exp(-F.col("scores")[0])), 6).alias("rank_score"))


MULTI = [Spec(target=c, rate=0.5, leaves=4) for c in range(3)]


@query(boosted_sql(rows_sql([f"((case when prob < 0.7e0 then 0 when value < 2 then 1 else 2 end) = {c})::int::double" for c in range(3)]), MULTI, rounds=4, depth=2, loss="logistic") + " select seq, arg_max(model, struct_pack(p := round(pred, 6), m := -model))::int as cls, round(max(pred), 6) as score from p4 group by 1")
def mod5_multiclass(spark, sf_dir):
    """A model for each class against the rest, all grown together; the highest score decides."""
    rows = examples(spark, sf_dir)
    model = boost.boost(rows, FEATURES, ["is0", "is1", "is2"], MULTI, key="seq", loss="logistic", rounds=4, depth=2, edges=EDGES)
    best = F.array_max(F.transform("scores", lambda s, m: F.struct(F.round(s, 6).alias("score"), (-m).alias("minus"))))
    return model.scores(rows).select("seq", best.alias("b")).select("seq", (-F.col("b.minus")).alias("cls"), "b.score")


FOLDS = [Spec(fold=f, rate=0.6, leaves=8, l1=1.0, seed=42 + f) for f in range(5)]


@query(boosted_sql(rows_sql([TARGET]), FOLDS, rounds=4, depth=3) + f" select model as fold, tree, round(macro_f1, 9) as macro_f1, round(accuracy, 9) as accuracy, round(mae, 6) as mae from ({union('v', 4, False)})")
def mod6_cross_validation(spark, sf_dir):
    """Every tree's scores on the fold that its model does not see, five folds at once."""
    model = boost.boost(examples(spark, sf_dir), FEATURES, ["target"], FOLDS, key="seq", fold="fold", cls="cls", rounds=4, depth=3, edges=EDGES)
    return model.validation(spark).select(F.col("model").alias("fold"), "tree", F.round("macro_f1", 9).alias("macro_f1"), F.round("accuracy", 9).alias("accuracy"), F.round("mae", 6).alias("mae"))


@query(boosted_sql(rows_sql([TARGET]), FOLDS, rounds=4, depth=3) + f""", best as (select model, arg_max(tree, struct_pack(f := round(macro_f1, 12), t := -tree)) as tree from ({union('v', 4, False)}) group by 1),
every as ({union('p', 4)}) select seq, round(avg(pred), 6) as ordinal, {CLASS.replace('value', 'round(avg(pred), 6)')} as cls from every join best using (model, tree) group by 1""")
def mod6_fold_ensemble(spark, sf_dir):
    """The mean score of the five folds' models, each up to its best tree."""
    rows = examples(spark, sf_dir)
    model = boost.boost(rows, FEATURES, ["target"], FOLDS, key="seq", fold="fold", cls="cls", rounds=4, depth=3, edges=EDGES, patience=4)
    mean = F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / len(FOLDS), 6)
    return model.scores(rows).select("seq", mean.alias("ordinal"), stats.ordinal_class(mean).alias("cls"))


TRIALS = boost.trial_specs(GRID, 20, fold=0)


@query(boosted_sql(rows_sql([TARGET]), TRIALS, rounds=3, depth=2) + f""", best as (select model, max(round(macro_f1, 9)) as macro_f1 from ({union('v', 3, False)}) group by 1)
select b.model as trial, k.rate, k.leaves, k.least, k.l1, k.l2, b.macro_f1, row_number() over (order by b.macro_f1 desc, b.model)::int as place from best b join spec k using (model)""")
def smp5_random_search(spark, sf_dir):
    """Twenty settings drawn from the grid, grown together on the first fold, ranked by their best macro F1."""
    model = boost.boost(examples(spark, sf_dir), FEATURES, ["target"], TRIALS, key="seq", fold="fold", cls="cls", rounds=3, depth=2, edges=EDGES)
    told = spark.createDataFrame([(m, s.rate, s.leaves, s.least, s.l1, s.l2) for m, s in enumerate(TRIALS)], "trial int, rate double, leaves int, least int, l1 double, l2 double")
    best = model.validation(spark).groupBy(F.col("model").alias("trial")).agg(F.max(F.round("macro_f1", 9)).alias("macro_f1"))
    from pyspark.sql import Window

    return told.join(best, "trial").withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "trial")))  # a row for each trial
