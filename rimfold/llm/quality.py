"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose statistic lies above a cutoff of a fixed grid. A setting is a cutoff (or none) for each of
the rules; it rejects what any of its rules rejects. For each stratum (language; null is a stratum of its own) a setting is
chosen whose false rejection rate on good documents, of all rules together, is at most `risk`.

Labelled good documents are split by a hash of their id. A quarter of them, with all bad ones, set a path of settings, from no
rule at all to stricter ones: time and again one rule goes to its next cutoff that rejects more bad documents, the rule for
which these are most for each further good one (earlier rules first), until none is left. The other three quarters, the
holdout, test the settings of the path in this order, each by an exact binomial test: with k of n rejected,
P(X <= k | n, risk) <= delta / strata (that is the Clopper-Pearson upper bound at that level lying below `risk`). The first that
fails ends the stratum, and the last that passed is chosen. As the path is fixed before the holdout is seen, testing in
sequence needs no correction for its length: a stratum's choice exceeds the risk only if the first setting on its path that
does so passes. Bonferroni over the strata makes the probability of any such stratum at most delta.

A stratum can reject anything only with a holdout of ln(delta / strata) / ln(1 - risk) good documents, about 217 of 290 labelled
ones at the defaults and four strata; below that all is kept.

Defined cases: null text has no words and fails the base rules; null quality is no label; a document labelled more
than once is good only if each label is 1; repeated document rows are each measured. Other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimfold.llm.common import MIX, mix64, read, slices, stored, tidied

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Rules and their grids, laxest cutoff first.
RULES = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bang_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02],
    "word_length": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0],
}
#: The false rejection rate that is allowed for good documents.
RISK = 0.02
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def repeated_words(lengths: np.ndarray, ids: np.ndarray, width: int = 8) -> np.ndarray:
    """For texts laid end to end (lengths in words, ids of words): words in windows that their text holds twice."""
    n = len(ids)
    if n < width:
        return np.zeros(len(lengths), np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    windows = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        windows = windows * MIX + ids[k : n - width + 1 + k]
    inside = text[: n - width + 1] == text[width - 1 :]
    start = np.flatnonzero(inside)
    key = mix64(windows[start] ^ mix64(text[start].astype(np.uint64) + MIX))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start[twice], 1)
    np.add.at(edge, start[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(text[covered], minlength=len(lengths))


def measure(texts: list[str]) -> np.ndarray:
    """Rows of COUNTS."""
    out, lengths, words = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        lengths[i] = len(own)
        words += map(hash, own)
        filled = [x for x in text.split("\n") if x.strip(WHITE)]
        octets = np.frombuffer(raw, np.uint8)
        out[i] = (
            len(own), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), 0,
            len(filled), np.count_nonzero((octets >= 65) & (octets <= 90)), text.count("!"),
        )
    out[:, 4] = repeated_words(lengths, np.array(words, np.int64).view(np.uint64))
    return out


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch):
            kept = part.drop(columns="text").reset_index(drop=True)
            counts = pd.DataFrame(measure(part["text"].fillna("").tolist()), columns=[f"_{c}" for c in COUNTS])
            yield pd.concat([kept, counts], axis=1)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs, then the counts of each text (null: empty), prefixed with an underscore."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"_{c}", T.LongType()) for c in COUNTS])
    return docs.select(*keep, "text").mapInPandas(tidied(_measure), schema)


def rule_values() -> dict[str, F.Column]:
    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return {
        "symbol_share": share("_n_symbols", "_word_chars"),
        "dup_line_share": share("_n_dup_lines", "_n_lines"),
        "repeat_share": share("_n_repeat_words", "_n_words"),
        "upper_share": share("_n_upper", "_word_chars"),
        "bang_share": share("_n_bangs", "_n_words"),
        "word_length": share("_word_chars", "_n_words"),
    }


def levels() -> F.Column:
    """For each rule, how many cutoffs of its grid the document lies above."""
    values = rule_values()
    return F.array(*[
        F.struct(F.lit(rule).alias("rule"), sum((values[rule] > F.lit(x)).cast("int") for x in grid).alias("above"))
        for rule, grid in RULES.items()
    ])


def stratum(column: str = "lang") -> F.Column:
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def base_failed() -> F.Column:
    return (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X <= k) for X ~ Binomial(n, p), exactly: the sum's log terms by blocks, largest first to a relative 1e-17."""
    from math import lgamma, log, log1p

    out = np.ones(len(k))
    for i, (a, b) in enumerate(zip(k.astype(np.int64), n.astype(np.int64))):
        if a >= b:
            continue
        # from k downwards each term is the one above times a ratio under 1 where k < n p
        if a >= b * p:
            continue  # at least a half: never below a test's level
        term = lgamma(b + 1) - lgamma(a + 1) - lgamma(b - a + 1) + a * log(p) + (b - a) * log1p(-p)
        total, x, j = 0.0, 1.0, int(a)
        while x > 1e-17 * max(total, 1e-300):
            total += x
            if j == 0:
                break
            x *= j / (b - j + 1) * (1 - p) / p
            j -= 1
        out[i] = min(1.0, np.exp(term) * total)
    return out


def setting_path(above: np.ndarray, good: np.ndarray, bad: np.ndarray, grid: list[int]) -> list[np.ndarray]:
    """Settings from lax to strict. A setting has for each rule the least number of cutoffs to lie above for a rejection (one
    more than there are: off).

    above: rows of how many cutoffs of each rule are passed, with numbers of good and bad documents.
    """
    setting, gone, path = np.array(grid) + 1, np.zeros(len(good), bool), []
    while True:
        best = None
        for rule, now in enumerate(setting):
            left = ~gone & (bad > 0) & (above[:, rule] < now) & (above[:, rule] > 0)
            if not left.any():
                continue
            j = int(above[left, rule].max())  # the next cutoff that rejects more
            more = ~gone & (above[:, rule] >= j)
            gain, lost = int(bad[more].sum()), int(good[more].sum())
            if best is None or gain * (best[1] + 1) > best[0] * (lost + 1):
                best = (gain, lost, rule, j)
        if best is None:
            return path
        setting = setting.copy()
        setting[best[2]] = best[3]
        gone |= above[:, best[2]] >= best[3]
        path.append(setting)


def tested_setting(path: list[np.ndarray], above: np.ndarray, held: np.ndarray, risk: float, level: float) -> np.ndarray | None:
    """The last setting before the first that fails its test on the holdout (held: numbers of its good documents)."""
    chosen, n = None, np.array([int(held.sum())])
    for setting in path:
        k = int(held[(above >= setting).any(axis=1)].sum())
        if binomial_cdf(np.array([k]), n, risk)[0] > level:
            break
        chosen = setting
    return chosen


def fit_cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = 0.05) -> DataFrame:
    """stratum, rule, level: a document is rejected where it lies above at least that many cutoffs of the rule's grid.

    Labelled documents are counted by stratum and by what they lie above of each rule; a stratum's choice sees these
    counts, of which there are no more than settings (2,471,040) whatever the corpus.
    """
    quality = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    guide = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(4)) == 0
    sides = [F.count_if(c).alias(n) for n, c in (("good", (F.col("_quality") == 1) & guide), ("held", (F.col("_quality") == 1) & ~guide), ("bad", F.col("_quality") != 1))]
    each = [F.get(levels(), i)["above"].alias(rule) for i, rule in enumerate(RULES)]
    counted = stored(measured.where(~base_failed()).join(quality, "doc_id").select("doc_id", stratum().alias("stratum"), "_quality", *each).groupBy("stratum", *RULES).agg(*sides))
    strata = counted.agg(F.count_distinct("stratum")).first()[0]  # one number
    grid = [len(g) for g in RULES.values()]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        above = rows[list(RULES)].to_numpy()
        path = setting_path(above, rows["good"].to_numpy(), rows["bad"].to_numpy(), grid)
        found = tested_setting(path, above, rows["held"].to_numpy(), risk, delta / max(1, strata))
        found = np.array(grid) + 1 if found is None else found
        return pd.DataFrame({"stratum": rows["stratum"].iloc[0], "rule": list(RULES), "level": found})[found <= grid]

    return counted.groupBy("stratum").applyInPandas(choose, "stratum string, rule string, level int")


def verdicts(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with _base_failed and _kept. The cutoffs have at most one row for each stratum here after the pivot."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("_levels"))
    rejected = F.exists(levels(), lambda x: F.coalesce(x["above"] >= F.try_element_at(F.col("_levels"), x["rule"]), F.lit(False)))
    joined = measured.withColumn("stratum", stratum()).join(wide, "stratum", "left")
    return joined.withColumn("_base_failed", base_failed()).withColumn("_kept", ~F.col("_base_failed") & ~rejected)


def apply_rules(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = 0.05) -> DataFrame:
    """doc_id, lang, the counts, _base_failed and _kept of every row of docs."""
    measured = stored(statistics(docs, ["doc_id", "lang"]))
    return verdicts(measured, fit_cutoffs(measured, labels, risk=risk, delta=delta))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", F.col("_n_words").alias("n_words"), *[F.col(f"_{c}").alias(c) for c in COUNTS[1:5]],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )
