r"""Centroid clustering in exact integers: Lloyd's rounds by kd-tree filtering.

Vectors of exactly `width` finite components become integers, floor(scale * x). Every partition cuts its vectors into
blocks of up to BLOCK and builds a kd-tree over each, once: a node holds its vectors' count, their integer sums and their box.
The trees are a stored table, a row each, that all rounds read; only the centroids (k of them) change and travel. A round
walks each tree from the root with the centroids that may still be nearest: the one nearest to the middle of a node's box
stays, and another goes if even at the box's corner that suits it best it is strictly farther than that one. A node with one
centroid left is assigned as a whole, by count and sums; in leaves every vector is held against the centroids left, exactly,
ties to the smaller number. Blocks give k rows of counts and sums each, which Spark adds up; new centroids are floor(sum /
count) in whole numbers, and one without vectors stays where it is. The last pass assigns the vectors themselves.

Boxes in many dimensions are wide, so on data without structure most vectors reach the leaves; there, distances of a leaf's
vectors to the centroids left are one product of matrices, in doubles where all sums stay below 2^53, else in longs.

Defined cases: rows whose vector is null, of another width, or holds null or non-finite components take no part; integers are
held within +-LIMIT, so that a squared distance fits a long; fewer kept vectors than k give as many centroids; rows without an
id are clustered but start no centroid (if no row has an id there are no centroids and no rows); repeated rows are rows each,
and equal ids with different vectors start by the order of their vectors; sums of distances beyond a long are null. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import read, stored, tidied

#: Vectors in a tree; vectors in a leaf; the largest integer of a component.
BLOCK, LEAF, LIMIT = 16_384, 64, 1 << 26


def integers(rows: DataFrame, vector: str = "embedding", *, width: int = 64, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return rows.where((F.size(vector) == width) & ~bad).select("vec_id", held.alias("v"))


# ---- trees ------------------------------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Nodes by level from the root: start and stop in the ordered vectors, the left child (the right one follows; -1: a leaf)."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    child: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    total: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The kd-tree of the rows of x: each node is halved where its box is widest."""
    order, start, stop, child, lo, hi, total = np.arange(len(x)), [0], [len(x)], [], [], [], []
    at = 0
    while at < len(start):
        own = x[order[start[at] : stop[at]]]
        lo.append(own.min(axis=0))
        hi.append(own.max(axis=0))
        total.append(own.sum(axis=0, dtype=np.int64))
        wide = int(np.argmax(hi[-1] - lo[-1]))
        if len(own) <= leaf or hi[-1][wide] == lo[-1][wide]:
            child.append(-1)
        else:
            half = len(own) // 2
            order[start[at] : stop[at]] = order[start[at] : stop[at]][np.argpartition(own[:, wide], half)]
            child.append(len(start))
            start += [start[at], start[at] + half]
            stop += [start[at] + half, stop[at]]
        at += 1
    return Tree(order, *(np.array(c) for c in (start, stop, child)), *(np.array(c, np.int64) for c in (lo, hi, total)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The whole numbers a @ b.T: in doubles only where they hold every sum exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and of b."""
    norm = lambda x: (x.astype(np.int64) ** 2).sum(axis=1)
    return norm(a)[:, None] - 2 * product(a, b) + norm(b)[None]


def dominated(lo: np.ndarray, hi: np.ndarray, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """left (nodes by centroids) without those that are strictly farther than another one everywhere in the node's box."""
    middle = np.where(left, squares(lo + hi, 2 * centroids), np.iinfo(np.int64).max)
    star = middle.argmin(axis=1)
    out = left.copy()
    for a in range(0, len(lo), 256):
        z, s = centroids[None], centroids[star[a : a + 256]][:, None]
        corner = np.where(z > s, hi[a : a + 256][:, None], lo[a : a + 256][:, None])
        out[a : a + 256] &= ((z - s) * (z + s - 2 * corner)).sum(axis=2) <= 0
    return out


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, centroids left): every vector is in one node given; several centroids are left in leaves only."""
    nodes, left = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(nodes):
        left = dominated(tree.lo[nodes], tree.hi[nodes], left, centroids)
        inner = (left.sum(axis=1) > 1) & (tree.child[nodes] >= 0)
        for node, own in zip(nodes[~inner], left[~inner]):
            yield int(node), np.flatnonzero(own)
        nodes, left = np.repeat(tree.child[nodes[inner]], 2), np.repeat(left[inner], 2, axis=0)
        nodes[1::2] += 1


def nearest(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Places in x of the vectors held one by one, their centroids, and (node, centroid) of the nodes assigned whole."""
    places, numbers, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for node, own in filtered(tree, centroids):
        if len(own) == 1:
            whole.append((node, int(own[0])))
        else:
            places.append(tree.order[tree.start[node] : tree.stop[node]])
            numbers.append(own[squares(x[places[-1]], centroids[own]).argmin(axis=1)])
    return np.concatenate(places), np.concatenate(numbers), whole


def gathered(tree: Tree, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by centroid."""
    places, numbers, whole = nearest(tree, x, centroids)
    counts, sums = np.bincount(numbers, minlength=len(centroids)), np.zeros((len(centroids), x.shape[1]), np.int64)
    order = np.argsort(numbers, kind="stable")
    own, at = np.unique(numbers[order], return_index=True)
    if len(own):
        sums[own] = np.add.reduceat(x[places[order]].astype(np.int64), at, axis=0)
    for node, k in whole:
        counts[k] += tree.stop[node] - tree.start[node]
        sums[k] += tree.total[node]
    return counts, sums


# ---- Spark jobs -------------------------------------------------------------------------------------------------------

FIELDS = {"order": np.int32, "start": np.int32, "stop": np.int32, "child": np.int32, "lo": np.int32, "hi": np.int32, "total": np.int64}
TREES = "ids array<long>, x binary, " + ", ".join(f"{f} binary" for f in FIELDS)


def trees(kept: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row for each block of vectors of a partition: ids, vectors and tree. No shuffle."""

    def pack(parts: list[pd.DataFrame]) -> pd.DataFrame:
        own = pd.concat(parts)
        x = np.array(own["v"].tolist(), np.int32)
        tree = build(x, leaf)
        ids = [None if i is pd.NA else int(i) for i in own["vec_id"].astype("Int64")]
        cells = {f: [getattr(tree, f).astype(kind).tobytes()] for f, kind in FIELDS.items()}
        return pd.DataFrame({"ids": [ids], "x": [x.tobytes()], **cells})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for a in range(0, len(batch), block):
                part = batch.iloc[a : a + block]
                if n + len(part) > block:
                    yield pack(held)
                    held, n = [], 0
                if len(part):
                    held.append(part)
                    n += len(part)
        if held:
            yield pack(held)

    return kept.select("vec_id", "v").mapInPandas(tidied(run), TREES)


def unpacked(row, width: int) -> tuple[Tree, np.ndarray]:
    parts = {f: np.frombuffer(row[f], kind).astype(np.int64) for f, kind in FIELDS.items()}
    return Tree(**{f: v.reshape(-1, width) if f in ("lo", "hi", "total") else v for f, v in parts.items()}), np.frombuffer(row["x"], np.int32).reshape(-1, width)


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of least hash of salt and id, in that order."""
    ranked = kept.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"))
    return np.array([r["v"] for r in ranked.orderBy("h", "v").limit(k).collect()], np.int64)


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                counts, sums = gathered(*unpacked(row, width), centroids)
                own = np.flatnonzero(counts)
                yield pd.DataFrame({"cluster": own.astype(np.int32), "n": counts[own], "sums": list(sums[own])})

    parts = blocks.mapInPandas(tidied(run), "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for r in added.collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                tree, x = unpacked(row, width)
                places, numbers, whole = nearest(tree, x, centroids)
                cluster = np.zeros(len(x), np.int64)
                cluster[places] = numbers
                for node, k in whole:
                    cluster[tree.order[tree.start[node] : tree.stop[node]]] = k
                distance = ((x.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
                yield pd.DataFrame({"vec_id": pd.array(list(row["ids"]), "Int64"), "cluster": cluster.astype(np.int32), "distance": distance})

    return blocks.mapInPandas(tidied(run), "vec_id long, cluster int, distance long")


def cluster(kept: DataFrame, *, k: int = 40, rounds: int = 5, salt: str = "2:", block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each of the rows vec_id, v; the centroids)."""
    blocks, centroids = stored(trees(kept, block, leaf)), first_centroids(kept, k, salt)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = next_centroids(blocks, centroids)
    return stored(assigned(blocks, centroids)), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(integers(read(spark, sf_dir, "embeddings")))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    by = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    known = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(by, "cluster")  # k rows
    total = by.agg(F.try_sum("cluster_inertia").alias("inertia"))
    facts = F.broadcast(known.crossJoin(F.broadcast(total)))
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


OP12_SQL = """
with e as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
c0 as (select row_number() over (order by h, v) - 1 as c, v from (select v, sha256('2:' || vec_id::varchar) as h from e where vec_id is not null order by h, v limit 40)),
""" + "".join(
    f"""
a{r} as materialized (select n, min(struct_pack(d := d, c := c)) as best from (select n, c, list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - k.v[i]) * (e.v[i] - k.v[i])))::bigint as d from e cross join c{r} k) group by n),
"""
    + (
        f"""m{r} as (select best.c as c, i, (floor(sum(e.v[i])::decimal(38,0)::double / count(*)))::bigint as x from a{r} join e using (n) cross join range(1, 65) t(i) group by 1, 2),
c{r + 1} as materialized (select k.c, coalesce(l.v, k.v) as v from c{r} k left join (select c, list(x order by i) as v from m{r} group by c) l using (c)),
"""
        if r < 5
        else ""
    )
    for r in range(6)
) + """
f as (select best.c as c, best.d as d, n from a5),
s as (select c, sum(d)::bigint as cluster_inertia from f group by c)
select e.vec_id, f.c::integer as cluster, f.d as distance, s.cluster_inertia, (select sum(d)::bigint from f) as inertia, sha256(array_to_string(k.v, ',')) as centroid_sha256
from f join e using (n) join s using (c) join c5 k using (c)
"""
