"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists, in blocks.

All vectors are dealt into blocks by a hash, the queries into shards; each pair of block and shard is one group. In a
block every dimension has its list of rows sorted by component. A query walks all lists at once, from the largest
components down where its own is positive, from the smallest up where negative, in growing steps; each row met is
scored in full. Unmet rows score at most the sum over dimensions of the query's component times the component where the
walk stands, so the walk ends when that bound is below the k-th score found (at equality a row of smaller id could
still tie). Each query first walks one block; its k-th score there is the bound it takes to all others, where walks end
below it and rows below it are left out. What the blocks give meets in one ranking for each query; at most k rows a block.

Rows are numbered once, in a stored table, so rows are told apart by more than their ids. Each vector goes to
every shard of `shard` queries and each query to every block of `block` vectors; both sizes are what a task holds.

Defined cases: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part; a
shorter vector counts as padded with zeros; ties go to the smaller id; a query skips its own row only, and rows of equal
id are queries and candidates each, with rankings of their own (told apart by query_row); fewer than k candidates give
fewer rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.llm.common import groups_for, read, stored

BLOCK, SHARD = 16_384, 4096


def integers(rows: DataFrame, vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & ~bad).select("vec_id", scaled.alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def threshold_search(rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> np.ndarray:
    """Places in rows of the k best for the query that score `least` or more; own: the place of the query's own row (-1: not
    here); lists: by dimension, places from the largest component down."""
    n = len(rows)
    use = np.flatnonzero(query)
    ways = np.where(query[use] > 0, 1, -1)
    met, found, scores, depth, step = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 16
    if own >= 0:
        met[own] = True
    while depth < n:
        stop = min(n, depth + step)
        at = np.concatenate([lists[depth:stop, use[ways > 0]].ravel(), lists[n - stop : n - depth, use[ways < 0]].ravel()]) if len(use) else np.arange(n)
        fresh = np.zeros(n, bool)
        fresh[at] = True
        fresh &= ~met
        met |= fresh
        new = np.flatnonzero(fresh)
        found = np.concatenate([found, new])
        scores = np.concatenate([scores, rows[new] @ query])
        good = np.flatnonzero(scores >= least)
        best = good[np.lexsort((ids[found[good]], -scores[good]))[:k]]
        found, scores = found[best], scores[best]
        depth, step = stop if len(use) else n, step * 4
        if depth < n:
            edge = np.where(ways > 0, depth, n - 1 - depth)
            bound = int((query[use] * rows[lists[edge, use], use]).sum())
            if bound < least or len(found) >= k and bound < scores.min():
                break
    return found


def top_k(rows: DataFrame, asked: str, k: int, *, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """query_row, query_id, rank, vec_id, score for each of the rows (vec_id, v: integers) that meet the condition `asked`."""
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    queries = numbered.where(asked).toDF("q_id", "q_v", "q_row")
    blocks, shards = groups_for(numbered.count(), block), groups_for(queries.count(), shard)
    home = F.pmod(F.xxhash64("q_row", F.lit(5)), F.lit(blocks))
    data = numbered.withColumn("b", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)))
    asks = queries.withColumns({"q_b": home, "q_s": F.pmod(F.xxhash64("q_row", F.lit(4)), F.lit(shards))})

    def search(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asks):
            width = max(max(map(len, data["v"])), max(map(len, asks["q_v"])), 1)
            x, ids, place = matrix(data["v"], width), data["vec_id"].to_numpy(), {r: i for i, r in enumerate(data["row"])}
            lists = np.argsort(-x, axis=0, kind="stable")
            for row, q, least, v in zip(asks["q_row"], asks["q_id"], asks["least"], matrix(asks["q_v"], width)):
                best = threshold_search(x, ids, lists, v, place.get(row, -1), k, -np.inf if np.isnan(least) else least)
                out.append(pd.DataFrame({"query_row": row, "query_id": q, "vec_id": ids[best], "score": x[best] @ v}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_row", "query_id", "vec_id", "score")}, dtype="int64")

    schema = "query_row long, query_id long, vec_id long, score long"
    first = asks.select("q_row", "q_id", "q_v", "q_b", F.lit(None).cast("double").alias("least"))
    start = stored(data.groupBy("b").cogroup(first.groupBy("q_b")).applyInPandas(search, schema))
    bound = start.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    others = asks.join(bound.hint("merge"), asks["q_row"] == bound["query_row"], "left").select("q_row", "q_id", "q_v", "q_s", "least", F.col("q_b").alias("home"))
    others = others.withColumn("q_b", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).where("q_b <> home")
    dealt = data.withColumn("s", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    rest = dealt.groupBy("b", "s").cogroup(others.groupBy("q_b", "q_s")).applyInPandas(search, schema)
    found = start if blocks == 1 else start.unionByName(rest)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integers(read(spark, sf_dir, "embeddings")), "vec_id % 100 = 0", 10).drop("query_row")


OP7_SQL = """
with e as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (select q.n, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
      from e q join e c on q.n <> c.n where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10
"""
