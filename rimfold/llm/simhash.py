r"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees over shards of fingerprints.

Texts are lower-cased (A-Z only) and cut into words `[^\x20\x09-\x0D]+`; every three words in a row, joined by spaces, are
a shingle (all words are one if there are fewer). A bit of the fingerprint is set if it is set in over half of the
shingles' XXH64. Equal fingerprints are one node; nodes link at RADIUS or fewer differing bits.

Which nodes can link: of PARTS = RADIUS + 1 pieces of the 64 bits, two near fingerprints agree in one at least, so a node
belongs to one bucket for each piece (a mask of bits, and the node's bits under it). A bucket of over SHARD nodes is
dealt again by pieces of the bits that its mask leaves, which hold all the differences; up to LEVELS times. What is still
larger then is cut into shards of its own. A shard (several small buckets, or a part of one) is what one task indexes: a
BK-tree for each bucket, where a child hangs at its distance to its parent, so a search follows only the edges within
RADIUS of the distance found. Trees are never gathered on the driver: a shard's nodes go to the tasks that search it, the
shards of a large bucket to a task for each pair of them. Tasks give a tree of links, not all pairs.

Defined cases: null and empty texts, and those without words, have fingerprint zero and link like others; repeated rows are
rows each; rows without doc_id take part and are in the component of least doc_id among the others (null if there is none);
very long texts are counted in pieces of PIECE shingles. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import groups_for, read, slices, stored, tidied
from rimfold.llm.neardup import components

WIDTH, RADIUS, SEED = 3, 3, 42
#: Nodes that a task indexes; times that large buckets are dealt anew; shingles counted at once; pairs looked at in one step.
SHARD, LEVELS, PIECE, STEP = 8192, 3, 200_000, 250_000


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """The shingles' hashes, PIECE at a time."""
    words, digest = (text or "").encode().lower().split(), xxhash.xxh64_intdigest
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    if 0 < len(words) < WIDTH:
        yield np.array([digest(line, SEED)], np.uint64)
    starts = np.concatenate([[0], ends])[: max(0, len(words) - WIDTH + 1)]
    stops = ends[WIDTH - 1 :] - 1
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at : at + PIECE].tolist(), stops[at : at + PIECE].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None) -> int:
    total, n = np.zeros(64, np.int64), 0
    for piece in hashes(text):
        for at in range(0, len(piece), 20_000):
            bits = np.unpackbits(piece[at : at + 20_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        n += len(piece)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t) for t in part["text"]], np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fp})

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(tidied(run), docs.select("doc_id").schema.add("fp", "long"))


# ---- BK-trees ---------------------------------------------------------------------------------------------------------


class Forest:
    """A BK-tree for each bucket, as arrays: node i holds fps[i]; the children of a node lie side by side in the order of
    their edge, which is their distance to it."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray) -> None:
        """bucket: a number from 0 for each of the fps; a bucket's fps are distinct."""
        self.fps = fps
        order = np.argsort(bucket, kind="stable")
        self.parent, self.edge = np.full(len(fps), -1), np.zeros(len(fps), np.int64)
        left, group, above = order, bucket[order], np.full(len(fps), -1)
        edge = np.zeros(len(fps), np.int64)
        while len(left):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            heads = left[first]  # the first of each group is a node, the others go below it by their distance
            self.parent[heads], self.edge[heads] = above[first], edge[first]
            head = heads[np.cumsum(first) - 1][~first]
            left, group = left[~first], (np.cumsum(first) - 1)[~first]
            edge = np.bitwise_count(fps[left] ^ fps[head]).astype(np.int64)
            by = np.argsort(group * 65 + edge, kind="stable")
            left, above, edge, group = left[by], head[by], edge[by], (group * 65 + edge)[by]
        roots = np.flatnonzero(self.parent < 0)
        self.roots = np.full(int(bucket.max(initial=-1)) + 1, -1)
        self.roots[bucket[roots]] = roots
        below = np.flatnonzero(self.parent >= 0)
        self.children = below[np.lexsort((self.edge[below], self.parent[below]))]
        self.keys = self.parent[self.children] * 65 + self.edge[self.children]

    def search(self, asked: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in asked, nodes) within the radius, in the asked one's bucket; STEP pairs are looked at at a time. Of a node's
        children 2 * radius + 1 are followed at most."""
        todo = [(np.arange(len(asked)), self.roots[bucket])]
        while todo:
            q, node = todo.pop()
            if len(q) > STEP:
                todo.append((q[STEP:], node[STEP:]))
                q, node = q[:STEP], node[:STEP]
            d = np.bitwise_count(asked[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            if total := int(n.sum()):
                todo.append((np.repeat(q, n), self.children[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)]))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (least place of each class) once the classes of each pair of a and b are one."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, further := label[label]):
            label = further


def links(tree: np.ndarray, tree_bucket: np.ndarray, asked: np.ndarray, asked_bucket: np.ndarray, radius: int) -> pd.DataFrame:
    """a, b: links that join what the search joins. Fingerprints as longs; every asked one's bucket has a tree."""
    every, place = np.unique(np.concatenate([tree, asked]), return_inverse=True)
    label = np.arange(len(every))
    if len(tree) and len(asked):
        for q, node in Forest(tree.view(np.uint64), tree_bucket).search(asked.view(np.uint64), asked_bucket, radius):
            label = joined(label, place[len(tree) + q], place[node])
    moved = np.flatnonzero(label != np.arange(len(every)))
    return pd.DataFrame({"a": every[label[moved]], "b": every[moved]})


# ---- buckets and shards -----------------------------------------------------------------------------------------------


def pieces(mask: int, parts: int) -> list[int]:
    """mask with one of `parts` nearly equal pieces of the bits that it leaves, for each piece."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, masks: dict[int, list[int]], shard: int) -> DataFrame:
    """fp, mask, value, n (the bucket's size) of the rows (fp, mask) under the finer masks, where others share the bucket."""
    finer = F.create_map(*[x for m, own in masks.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in own]))])
    each = rows.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
    each = stored(each.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))
    sizes = each.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(each.join(sizes.hint("merge"), ["mask", "value"]).select("fp", "mask", "value", "n"))


def near_links(nodes: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """a, b: links between the distinct fingerprints (fp) that have the components of all pairs within the radius."""
    masks, rows, settled = {0: pieces(0, radius + 1)}, nodes.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level in range(levels + 1):
        rows = dealt(rows, masks, shard)
        last = level == levels
        settled.append(rows if last else rows.where(F.col("n") <= shard))
        rows = rows.where(F.col("n") > shard).select("fp", "mask")
        if last or not rows.limit(1).count():
            break
        masks = {m: pieces(m, radius + 1) for own in masks.values() for m in own}
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)

    def within(group: pd.DataFrame) -> pd.DataFrame:
        fps, bucket = group["fp"].to_numpy(), group.groupby(["mask", "value"]).ngroup().to_numpy()
        return links(fps, bucket, fps, bucket, radius)

    def across(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        t, a = trees["fp"].to_numpy(np.int64), asked["fp"].to_numpy(np.int64)
        return links(t, np.zeros(len(t), np.int64), a, np.zeros(len(a), np.int64), radius)

    schema, small = "a long, b long", every.where(F.col("n") <= shard)
    shards = groups_for(small.count(), shard)
    found = small.withColumn("g", F.pmod(F.xxhash64("mask", "value", F.lit(1)), F.lit(shards))).groupBy("g").applyInPandas(within, schema)
    large = every.where(F.col("n") > shard)
    if large.limit(1).count():
        count = F.ceil(F.col("n") / shard).cast("int")
        own = large.withColumns({"s": count, "own": F.pmod(F.xxhash64("fp", F.lit(2)), count).cast("int")})
        trees = own.select("mask", "value", F.col("own").alias("i"), F.explode(F.expr("sequence(own, s - 1)")).alias("j"), "fp")
        asked = own.select(F.col("mask").alias("mask_"), F.col("value").alias("value_"), F.explode(F.expr("sequence(0, own)")).alias("i_"), F.col("own").alias("j_"), F.col("fp").alias("fp"))
        found = found.unionByName(trees.groupBy("mask", "value", "i", "j").cogroup(asked.groupBy("mask_", "value_", "i_", "j_")).applyInPandas(across, schema))
    return found


def near_components(docs: DataFrame, *, text: str = "text", radius: int = RADIUS, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    every = stored(fingerprints(docs, text))
    nodes = stored(every.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(near_links(nodes, radius=radius, shard=shard, levels=levels)).toDF("fp", "label")
    labelled = stored(nodes.join(label.hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = labelled.select("fp", "label").join(least.hint("merge"), "label").select("fp", "component_id")
    return every.join(of_node.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
