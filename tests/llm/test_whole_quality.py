"""False rejection of all rules together, and the choice of a setting against a plain version."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rimfold.llm import quality


def measured(spark, rows):
    """rows: (doc_id, lang, values of the six rules), as counts of texts of 1000 words and 1000 lines."""
    names = ["doc_id", "lang", *[f"_{c}" for c in quality.COUNTS]]
    made = [(i, lang, 1000, int(1000 * max(v[5], 1)), int(1000 * max(v[5], 1) * v[0]), int(1000 * v[1]), int(1000 * v[2]), 1000, int(1000 * max(v[5], 1) * v[3]), int(1000 * v[4])) for i, lang, v in rows]
    return spark.createDataFrame(made, ", ".join(f"{n} {'string' if n == 'lang' else 'long'}" for n in names))


def test_six_defects_together_stay_under_the_risk(spark):
    """Each of six independent defects is in 0.6 % of the good documents: any one rule alone would pass."""
    rng = random.Random(5)
    lax = [g[0] + 0.001 if k < 5 else g[0] + 1 for k, g in enumerate(quality.RULES.values())]
    rows, labels = [], []
    for i in range(30_000):
        good = i % 5 > 0
        v = [x if rng.random() < (0.006 if good else 0.4) else 0.0 for x in lax]
        rows.append((i, "xx", v))
        labels.append((i, int(good), 0))
    table = measured(spark, rows)
    cutoffs = quality.fit_cutoffs(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), risk=0.01)
    judged = quality.verdicts(table, cutoffs).withColumn("good", F.col("doc_id") % 5 > 0)
    share = {r["good"]: r["kept"] for r in judged.groupBy("good").agg(F.avg(F.col("_kept").cast("int")).alias("kept")).collect()}
    assert cutoffs.count() == 1  # a second rule would make 1.2 %
    assert 1 - share[True] <= 0.01 and share[False] < 0.65


def plain_path(rows, grid):
    """rows: (passed cutoffs of each rule, good). The same path, by documents and exact fractions."""
    setting, path = [m + 1 for m in grid], []
    while True:
        left = [(above, good) for above, good in rows if not any(a >= s for a, s in zip(above, setting))]
        options = []
        for rule in range(len(grid)):
            steps = [above[rule] for above, good in left if not good and 0 < above[rule]]
            if steps:
                out = [good for above, good in left if above[rule] >= max(steps)]
                options.append((Fraction(len(out) - sum(out), sum(out) + 1), -rule, max(steps)))
        if not options:
            return path
        _, rule, j = max(options)
        setting = [j if r == -rule else s for r, s in enumerate(setting)]
        path.append(setting)


def test_path_and_choice_are_the_plain_ones():
    for seed in range(6):
        rng = random.Random(seed)
        grid = [3, 2, 4]
        rows = [tuple(min(g, int(rng.expovariate(9 if good else 1.2))) for g in grid) + (good,) for good in (rng.random() < 0.7 for _ in range(600))]
        guide, hold = rows[:300], [r for r in rows[300:] if r[3]]
        keys = sorted({r[:3] for r in rows})
        good, bad = (np.array([sum(r == (*k, side) for r in guide) for k in keys]) for side in (True, False))
        held = np.array([sum(r[:3] == k for r in hold) for k in keys])
        path = quality.setting_path(np.array(keys), good, bad, grid)
        want = plain_path([(r[:3], int(r[3])) for r in guide], grid)
        assert [p.tolist() for p in path] == want
        chosen, risk, level = None, Fraction(1, 5), Fraction(1, 80)
        for setting in want:
            k = sum(any(a >= s for a, s in zip(r, setting)) for r in hold)
            if sum(math.comb(len(hold), x) * risk**x * (1 - risk) ** (len(hold) - x) for x in range(k + 1)) > level:
                break
            chosen = setting
        got = quality.tested_setting(path, np.array(keys), held, 0.2, 1 / 80)
        assert (got is None) == (chosen is None) and (got is None or got.tolist() == chosen)
        assert chosen is not None


def test_strata_exceed_the_risk_no_oftener_than_allowed():
    """Many strata of 600 good documents whose defects are as frequent in good ones as the risk: a choice that rejects over the
    risk is to be as rare as delta."""
    rng, over, some, n = np.random.default_rng(11), 0, 0, 400
    for _ in range(n):
        defect = rng.random((900, 3)) < np.array([0.004, 0.02, 0.05])
        good = np.arange(900) < 600
        defect[~good] |= rng.random((300, 3)) < 0.5
        above, which = np.unique(defect.astype(int), axis=0, return_inverse=True)
        guide = np.arange(900) % 4 == 0
        count = lambda mask: np.bincount(which.ravel()[mask], minlength=len(above))
        path = quality.setting_path(above, count(good & guide), count(~good), [1, 1, 1])
        chosen = quality.tested_setting(path, above, count(good & ~guide), 0.02, 0.05)
        some += chosen is not None
        over += chosen is not None and 1 - np.prod(1 - np.array([0.004, 0.02, 0.05])[chosen == 1]) > 0.02
    assert over <= 0.05 * n + 3 * (0.05 * 0.95 * n) ** 0.5 and some > 0.2 * n


def test_every_verdict_is_that_of_the_setting(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), [rng.choice([0, 0, 0, x]) for x in (0.35, 0.85, 0.21, 0.65, 0.25, 18)]) for i in range(9000)]
    labels = [(i, int(sum(x > 0 for x in v) < 2), 0) for i, _, v in rows] + [(0, 0, 0), (1, None, 0)]
    table = measured(spark, rows)
    cutoffs = quality.fit_cutoffs(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), risk=0.3)
    by = {(r["stratum"], r["rule"]): r["level"] for r in cutoffs.collect()}
    assert by
    values = {r["doc_id"]: r for r in table.collect()}
    for r in quality.verdicts(table, cutoffs).collect():
        x = values[r["doc_id"]]
        share = [x["_n_symbols"] / x["_word_chars"], x["_n_dup_lines"] / x["_n_lines"], x["_n_repeat_words"] / x["_n_words"], x["_n_upper"] / x["_word_chars"], x["_n_bangs"] / x["_n_words"], x["_word_chars"] / x["_n_words"]]
        lang = "null" if r["lang"] is None else "=" + r["lang"]
        out = [sum(v > c for c in g) >= by.get((lang, rule), 99) for (rule, g), v in zip(quality.RULES.items(), share)]
        assert r["_kept"] == (not any(out) and 100 * x["_n_repeat_words"] <= 30 * x["_n_words"])
    assert not list(itertools.chain(k for k in by if k[0] not in ("=a", "=b", "null")))
