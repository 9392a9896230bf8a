"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row of the lower-cased text (a shorter text with words is one shingle). Its weight is its
count in the text times the damped mean inverse document frequency of its words, (mean of ln(1 + N / df)) ** damping.
Document frequencies are counted over all documents. Part of the weight's definition is that the frequency of words
whose df is at most 1 / IDF_WORDS of the sum of all df saturates there: a share, alike at every size of a corpus, and fewer
than IDF_WORDS words need an entry of their own, which is the proven bound of the table that tasks get. The damping
(a quarter: near copies that change a few rare words are still near copies) is a parameter.

Signatures: sample k of a document is the shingle, and its t, of least ln a = ln c - r (t - beta) - r over its
shingles, with t = floor(ln w / r + beta), r and c from Gamma(2, 1) and beta uniform. The variates of a shingle come
from seeded tables, another row of them in each band, picked by its hash: two shingles share a band's variates with
probability 1 / TABLE and all bands' never but by equal hashes. A sample is told by shingle and t, so unlike shingles do not
agree by value. BANDS bands of ROWS samples are the buckets.

Texts of the same words are one node, whatever their ids. In each bucket every node is compared with its hub: first each
node's most promising hub, which links nearly all, then its other hubs; then every pair of a bucket whose nodes are
still in different classes. So a pair that shares a bucket is left out only if both are in one class already. Pairs are
first held against the whole signatures (agreement of at least `hint`, five standard deviations below the threshold),
then verified: weighted Jaccard similarity of the texts' shingles of at least `threshold`. In buckets of over SMALL nodes
the pairs still apart are verified inside tasks, block against block, and only links come out. Classes are the connected
components of the verified links, found by large-star and small-star rounds.

Defined cases: texts without words (null, empty) are classes of one, with no class_key; rows of one doc_id with different
texts are told apart, each in its text's class (two such classes may have one class_id, but not one class_key); a row without
doc_id is in the class of its text, and a class of such rows alone has no class_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import MIX, mix64, read, slices, stored, tidied

WIDTH, THRESHOLD, BANDS, ROWS, IDF_WORDS, DAMPING, HINT, PROBES = 5, 0.8, 16, 4, 1 << 16, 0.25, 0.55, 4
TABLE = 1 << 15
SMALL, CROSS = 64, 1024


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts end to end as places in a list of different words, their number by text, hashes of the list."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split()
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), counts, np.zeros(0, np.uint64)
    which, different = pd.factorize(np.array(words, dtype=object))
    return which, counts, pd.util.hash_array(different, categorize=False)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (64-bit hash), df."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, most=3_000_000):
                which, counts, hashes = word_ids(part["text"].fillna("").tolist())
                doc = np.repeat(np.arange(len(counts)), counts)
                pairs = np.unique(which * np.int64(len(counts)) + doc) // max(1, len(counts))
                found, df = np.unique(pairs, return_counts=True)
                yield pd.DataFrame({"word": hashes[found].view(np.int64), "df": df})

    return docs.select(F.col(text).alias("text")).mapInPandas(tidied(count), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))


class Weights:
    """Inverse document frequencies: those of frequent words, and the one at which rarer words saturate."""

    def __init__(self, words: np.ndarray, df: np.ndarray, docs: int, least: float, damping: float):
        order = np.argsort(words)
        self.words = words[order]
        self.idf = np.log1p(docs / np.maximum(df[order], 1)).astype(np.float64)
        self.rare, self.damping = float(np.log1p(docs / max(least, 1.0))), damping

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.rare)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[k] == hashes
            out[hit] = self.idf[k[hit]]
        return out


def learn_weights(docs: DataFrame, *, text: str = "text", damping: float = DAMPING) -> Weights:
    counts = stored(document_counts(docs, text))
    total = counts.agg(F.sum("df")).first()[0] or 0
    least = total / IDF_WORDS
    frequent = counts.where(F.col("df") > least).toPandas()  # fewer than IDF_WORDS rows
    n = docs.count()
    return Weights(frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["df"].to_numpy(np.float64), n, least, damping)


def shingles(texts: list[str], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' different shingles, ordered by text and hash: text, hash (44 bits), weight; and two hashes of each
    text's words (0 without words)."""
    which, counts, hashes = word_ids(texts)
    n = len(which)
    doc = np.repeat(np.arange(len(counts)), counts)
    idf, ids = weights.of(hashes)[which], hashes[which]
    stop = np.cumsum(counts)
    whole = np.zeros((2, len(texts)), np.uint64)
    if not n:
        return doc, ids, idf, whole
    some = np.flatnonzero(counts)
    for k in range(2):
        nth = (np.arange(n) - np.repeat(stop - counts, counts)).astype(np.uint64)
        mixed = mix64(ids ^ mix64(nth + np.uint64(k * 7919 + 1)))
        whole[k, some] = np.add.reduceat(mixed, (stop - counts)[some])
    size = np.minimum(WIDTH, counts)[doc]
    nth = np.arange(n) - np.repeat(stop - counts, counts)
    start = np.flatnonzero(nth + size <= counts[doc])
    h, weight = np.zeros(len(start), np.uint64), np.zeros(len(start))
    for k in range(WIDTH):
        inside = k < size[start]
        at = np.where(inside, start + k, 0)
        h = np.where(inside, h * MIX + ids[at], h)
        weight += np.where(inside, idf[at], 0.0)
    weight = (weight / size[start]) ** weights.damping
    key = (doc[start].astype(np.uint64) << np.uint64(44)) | (mix64(h) >> np.uint64(20))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(44)).astype(np.int64), key[first] & np.uint64((1 << 44) - 1), weight[order][first] * times, whole


class Sampler:
    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        shape = (bands * TABLE, rows)  # a block of TABLE rows for each band
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.lnc = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32) - self.r
        self.beta = rng.random(shape, np.float32)

    def signatures(self, n: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A hash of the sampled shingle and its t for each document and sample (0 without shingles); doc ascends. Of
        equal values the greatest hash counts, so the order of shingles makes no difference."""
        samples = self.bands * self.rows
        best, out = np.full((n, samples), np.inf, np.float32), np.zeros((n, samples), np.uint64)
        lnw, salts = np.log(weight).astype(np.float32), MIX * np.arange(1, self.bands + 1, dtype=np.uint64)
        blocks = np.arange(self.bands, dtype=np.int64) * TABLE
        for a in range(0, len(doc), 4096):
            own, keys = doc[a : a + 4096], key[a : a + 4096]
            salted = mix64(keys[:, None] + salts)
            at = ((salted & np.uint64(TABLE - 1)).astype(np.int64) + blocks).ravel()
            r, lnc, beta = (np.take(x, at, axis=0).reshape(len(own), samples) for x in (self.r, self.lnc, self.beta))
            t = lnw[a : a + 4096, None] / r
            t += beta
            np.floor(t, out=t)
            value = np.subtract(beta, t, out=beta)
            value *= r
            value += lnc
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            docs = own[starts]
            least = np.minimum(np.minimum.reduceat(value, starts, axis=0), best[docs])
            out[docs] = np.where(least < best[docs], np.uint64(0), out[docs])
            best[docs] = least
            row, k = np.divmod(np.flatnonzero(value == np.repeat(least, np.diff(np.append(starts, len(own))), axis=0)), samples)
            np.maximum.at(out, (own[row], k), mix64(salted[row, k // self.rows] + MIX * (t[row, k].astype(np.int64).view(np.uint64) + np.uint64(1))))
        return out


def row_of(text: str) -> F.Column:
    """Rows of equal doc_id and text share it."""
    return F.xxhash64("doc_id", F.coalesce(F.col(text), F.lit("")), F.lit(11))


def signed(docs: DataFrame, weights: Weights, *, bands: int, rows: int, seed: int, text: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), h1, h2 (hashes of all words; null without words), keys (a hash for each band), digest (a byte a sample)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(bands, rows, seed)
        for batch in batches:
            for part in slices(batch, most=2_000_000):
                doc, key, weight, whole = shingles(part["text"].fillna("").tolist(), weights)
                mixed = sampler.signatures(len(part), doc, key, weight)
                keys = np.zeros((len(part), bands), np.uint64)
                for k in range(rows):
                    keys = keys * MIX + mixed[:, k::rows]
                empty = whole[0] == 0
                frame = pd.DataFrame({c: part[c].to_numpy() for c in ("doc_id", "known", "row")})
                frame["h1"] = pd.array(whole[0].view(np.int64), dtype="Int64").copy()
                frame["h2"] = pd.array(whole[1].view(np.int64), dtype="Int64").copy()
                frame.loc[empty, ["h1", "h2"]] = pd.NA
                frame["keys"] = list(keys.view(np.int64))
                frame["digest"] = [d.tobytes() for d in (mixed & np.uint64(255)).astype(np.uint8)]
                yield frame

    schema = "doc_id long, known boolean, row long, h1 long, h2 long, keys array<long>, digest binary"
    known = F.col("doc_id").isNotNull().alias("known")  # beside a null, ids would come as floats
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), known, row_of(text).alias("row"), F.col(text).alias("text")).mapInPandas(tidied(sign), schema)
    return found.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def agreement(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("da", "db"))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "hint": (a == b).mean(axis=1) if len(batch) else 0.0})


def hinted(pairs: DataFrame, nodes: DataFrame, hint: float) -> DataFrame:
    """a, b, hint of the pairs whose signatures agree enough."""
    digests = nodes.select("node", "digest")
    both = pairs.join(digests.toDF("a", "da"), "a").join(digests.toDF("b", "db"), "b")
    return both.select("a", "b", "da", "db").mapInPandas(agreement, "a long, b long, hint double").where(F.col("hint") >= hint)


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that meet the threshold; texts: node, text."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "ta", 2_000_000):
                sides = []
                for text in ("ta", "tb"):
                    doc, key, weight, _ = shingles(part[text].fillna("").tolist(), weights)
                    sides.append((doc.astype(np.uint64) << np.uint64(44) | key, weight, doc))
                (ka, wa, da), (kb, wb, db) = sides
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                common = np.bincount(da[i], np.minimum(wa[i], wb[j]), len(part))
                whole = np.bincount(da, wa, len(part)) + np.bincount(db, wb, len(part)) - common
                out = pd.DataFrame({"a": part["a"].to_numpy(), "b": part["b"].to_numpy(), "similarity": common / np.maximum(whole, 1e-300)})
                yield out[out["similarity"] >= threshold]

    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(tidied(check), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of the edges (a, b)."""
    now, seen = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.toDF("u", "v"))
        now = stored(small.where("u <> v").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def ordered(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def hub_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a < b: each member of a bucket with the bucket's hub, the member whose signature agrees best with the probes (a
    few members by hash). Copies of a text are all near that text, but may be too far from one another: the hub is
    what links them. In a bucket of two the hub is either."""
    probe = F.explode(F.array(*[F.col(f"p{k}") for k in range(PROBES)])).alias("probe")
    asked = members.where("n > 2").select("band", "key", "node", probe).where("node <> probe").distinct()
    agreed = hinted(asked.select(*ordered("node", "probe")).distinct(), nodes, 0.0)
    means = asked.select("band", "key", "node", *ordered("node", "probe")).join(agreed, ["a", "b"]).groupBy("band", "key", "node").agg(F.avg("hint").alias("mean"))
    hubs = means.groupBy("band", "key").agg(F.max(F.struct("mean", (-F.col("node")).alias("minus"))).alias("x")).select("band", "key", (-F.col("x.minus")).alias("hub"))
    led = members.select("band", "key", "node", "lead").join(hubs, ["band", "key"], "left").withColumn("hub", F.coalesce("hub", "lead"))
    return led.where("node <> hub").select(*ordered("node", "hub")).distinct()


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
    both = pairs.join(la, "a", "left").join(lb, "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def mixed_buckets(tagged: DataFrame) -> DataFrame:
    """band, key, node, label, main (the bucket's most frequent label), n of the buckets with more than one label. One node
    of any pair that is still apart is not of the main label, so only those are held against the whole bucket."""
    counts = tagged.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("band", "key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("n")).where("labels > 1")
    return stored(tagged.join(main, ["band", "key"]).select("band", "key", "node", "label", "main", "n"))


def crossing(mixed: DataFrame) -> DataFrame:
    """a < b: the pairs with different labels of buckets of up to SMALL nodes."""
    small = mixed.where(F.col("n") <= SMALL)
    few = small.where("label <> main").select("band", "key", F.col("node").alias("x"), F.col("label").alias("lx"))
    return few.join(small.select("band", "key", F.col("node").alias("y"), F.col("label").alias("ly")), ["band", "key"]).where("lx <> ly").select(*ordered("x", "y")).distinct()


def block_links(mixed: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b of verified pairs with different labels in buckets of over SMALL nodes. The nodes off the main label meet all
    others block by block inside tasks, and only links leave them: for a node one to each label it reaches."""
    large = mixed.where(F.col("n") > SMALL).join(texts, "node")
    blocks = F.ceil(F.col("n") / CROSS).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    own = F.pmod(F.xxhash64("node", F.lit(17)), blocks).cast("int")
    left = large.where("label <> main").select("band", "key", own.alias("i"), other.alias("j"), "node", "label", "text")
    there = left.select("band", "key", "i").distinct().toDF("band_", "key_", "i_")  # the other side goes to blocks that exist
    right = large.select(F.col("band").alias("band_"), F.col("key").alias("key_"), own.alias("j_"), "node", "label", "text").join(there, ["band_", "key_"])

    def compare(few: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(few) and len(all_):
            dx, kx, wx, _ = shingles(few["text"].fillna("").tolist(), weights)
            dy, ky, wy, _ = shingles(all_["text"].fillna("").tolist(), weights)
            order = np.argsort(ky, kind="stable")
            dy, ky, wy = dy[order], ky[order], wy[order]
            whole, edges = np.bincount(dy, wy, len(all_)), np.searchsorted(dx, np.arange(len(few) + 1))
            nodes, labels = all_["node"].to_numpy(), all_["label"].to_numpy()
            lo, hi = np.searchsorted(ky, kx, "left"), np.searchsorted(ky, kx, "right")
            for i, (x, label) in enumerate(zip(few["node"], few["label"])):
                a, b = edges[i], edges[i + 1]
                n = hi[a:b] - lo[a:b]
                at = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(dy[at], np.minimum(np.repeat(wx[a:b], n), wy[at]), len(all_))
                near = np.flatnonzero((common >= threshold * (wx[a:b].sum() + whole - common)) & (labels != label))
                for y in near[np.unique(labels[near], return_index=True)[1]]:
                    out.append((min(x, nodes[y]), max(x, nodes[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("band", "key", "i", "j").cogroup(right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy("band_", "key_", "i_", "j_")).applyInPandas(compare, "a long, b long").distinct()


def keyed_classes(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, hint: float = HINT, damping: float = DAMPING, seed: int = 5) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_key (a hash of its texts) for every row of docs."""
    weights = learn_weights(docs, text=text, damping=damping)
    every = stored(signed(docs, weights, bands=bands, rows=rows, seed=seed, text=text))
    # numbered as written; read back, they stay
    nodes = stored(
        every.where("h1 is not null").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("keys").alias("keys"), F.first("digest").alias("digest"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    probes = [F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PROBES)]
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), *probes).where("n > 1")
    members = stored(banded.join(buckets, ["band", "key"]))
    star = stored(hinted(hub_pairs(members, nodes), nodes, hint))
    # texts of the nodes that any pair can need, written once; pairs are between nodes of one bucket. The ids grow with
    # the corpus, so they are never broadcast, in a small run either
    wanted = members.where("n > 2").select("node").unionByName(star.select(F.col("a").alias("node"))).unionByName(star.select(F.col("b").alias("node"))).distinct()
    asked = nodes.select("node", "row").join(wanted.hint("merge"), "node")
    whole = docs.select(row_of(text).alias("row"), F.col(text).alias("text")).join(asked.hint("merge"), "row")
    texts = stored(whole.dropDuplicates(["row", "node"]).select("node", "text"))
    best = star.groupBy("b").agg(F.max(F.struct("hint", (-F.col("a")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("a"), "b")
    links = stored(verified(best, texts, weights, threshold)).select("a", "b")
    others = stored(apart(star.select("a", "b"), components(links)).join(best, ["a", "b"], "left_anti"))
    links = links.unionByName(stored(verified(others, texts, weights, threshold)).select("a", "b"))
    label = components(links)
    tagged = members.select("band", "key", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = mixed_buckets(tagged)
    rest = crossing(mixed).join(best.unionByName(others), ["a", "b"], "left_anti")
    links = links.unionByName(stored(verified(hinted(rest, nodes, hint), texts, weights, threshold)).select("a", "b"))
    if mixed.where(F.col("n") > SMALL).limit(1).count():
        links = links.unionByName(stored(block_links(mixed, texts, weights, threshold)))
    label = components(links)
    of_node = nodes.select("h1", "h2", "doc_id", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = of_node.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("h1").alias("class_key"))
    of_text = of_node.select("h1", "h2", "label").join(named.hint("merge"), "label").drop("label")
    return every.select("doc_id", "h1", "h2").join(of_text, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "class_key")


def classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id of keyed_classes."""
    return keyed_classes(docs, **settings).select("doc_id", "class_id")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
