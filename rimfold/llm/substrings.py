"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts elsewhere are removed.

Every window of LENGTH bytes has an anchor: of its GRAM-byte strings the one of least hash (the leftmost of equals).
Equal windows have equal anchors at the same place in them, so the anchor's string is a bucket that no match leaves.
A run of windows with one anchor is a context (the bytes from the first window's start to the last one's end).

1. Contexts are counted by hash; those found twice are copies as a whole. A bucket with one context found once has no
   match, which settles most of the corpus. What remains are buckets with different contexts.
2. Those are sorted blockwise, some whole buckets at a time, by the difference-cover method. Positions, counted from
   the anchor, whose residue modulo PERIOD lies in the cover form the sample. All positions are ranked by their first
   PERIOD bytes (prefix doubling from 8); the sample's ranks are then doubled by steps of PERIOD, in which the sample
   is closed, to beyond LENGTH. A window's suffix is ordered by its first PERIOD bytes, long ties by the precomputed
   rank of the next sample position. As contexts are laid from their anchors, equal windows are congruent and that
   position is the same distance away in both. Neighbours in this order are compared over LENGTH bytes (the exact
   check); windows in a run of equals are matches. Memory is bounded by the block.
3. A bucket of more than LARGE different contexts is not brought to one task: its windows are buckets of their own,
   told apart by two hashes of all their bytes.
4. The matched windows of each document are joined with it and cut out.

Defined cases: null text is empty; texts under LENGTH bytes keep everything; a text's own repeats and overlaps count;
rows of equal doc_id and text match each other; texts of over PART
bytes are taken in parts that overlap by LENGTH - 1, at any length. Anchors, and the contexts of one anchor, are told apart by
64-bit hashes, windows of large buckets by two of them: of n contexts, a pair is taken for equal by chance with a
probability of about n^2 / 2^129 (under 1e-14 for 1e12 contexts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import groups_for, mix64, read, stored, tidied

LENGTH, GRAM, PERIOD, LARGE, BLOCK, PIECE, PART = 400, 96, 64, 2048, 1_500_000, 2_000_000, 4_000_000
CONTEXT = ["key", "c1"]


@lru_cache(1)
def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An odd base's powers, its inverse's powers, and a random number for each byte."""
    rng = np.random.default_rng(1000 + which)
    base = int(rng.integers(1 << 62)) * 2 + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1], rng.integers(0, 1 << 64, 256, np.uint64)


class Prefixes:
    """Hashes of any substrings of the bytes."""

    def __init__(self, octets: np.ndarray, which: int):
        size = max(PIECE * 2, 1 << int(len(octets) + 1).bit_length())
        self.up, self.down, table = powers(size, which)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(table[octets] * self.up[: len(octets)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    full = np.concatenate([values, np.full(-n % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes]) -> pd.DataFrame:
    """text (place), key, c1, lo (first window) and shape (anchor - lo, last window - lo: 10 bits) of all contexts."""
    octets = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(octets) < LENGTH:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", *CONTEXT, "lo", "shape")})
    one = Prefixes(octets, 1)
    grams = one.grams(GRAM)
    low = np.uint64((1 << 26) - 1)  # hash above, place below: the least is the leftmost of the least hash
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    stop = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= stop[text])
    at = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])])[: len(start)])
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at = start[first], start[last], at[first]
    shape = (at - lo) * 1024 + (hi - lo)
    begin = (stop - sizes)[text[lo]]
    context = one.of(lo, hi + LENGTH) ^ mix64(shape.astype(np.uint64))
    return pd.DataFrame({"text": text[lo], "key": grams[at].view(np.int64), "c1": context.view(np.int64), "lo": lo - begin, "shape": shape})


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # long texts go in parts that share LENGTH - 1 bytes, so that each of their windows is in one part
        texts, owner, begin = [], [], []
        for i, t in enumerate(map(bytes, batch["octets"])):
            for at in range(0, max(1, len(t) - LENGTH + 1), PART - LENGTH + 1):
                texts.append(t[at : at + PART])
                owner.append(i)
                begin.append(at)
        owner, begin = np.array(owner), np.array(begin)
        ends = np.cumsum([len(t) for t in texts]) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            found = anchors(texts[a:b])
            part = found["text"].to_numpy() + a
            found["lo"] += begin[part]
            found["doc"], found["t"] = batch["doc"].to_numpy()[owner[part]], batch["t"].to_numpy()[owner[part]]
            yield found[["doc", "t", *CONTEXT, "lo", "shape"]]


def ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def block_matches(texts: list[bytes], anchor: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For contexts laid end to end (anchor places and numbers of windows), which windows have an equal one."""
    raw = np.frombuffer(b"".join(texts) + b"\0" * (LENGTH + 8), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    n, stop = int(sizes.sum()), np.cumsum(sizes)
    begin = stop - sizes
    word = raw.astype(np.uint64)
    for k in (1, 2, 4):
        word = (word[:-k] << np.uint64(8 * k)) | word[k:]
    rank, depth = ranked(word[: n + 1]), 8
    while depth < PERIOD:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-depth] = rank[depth:] + 1
        rank, depth = ranked(rank * np.int64(len(rank) + 2) + ahead), depth * 2
    step = int(PERIOD**0.5)
    cover = np.zeros(PERIOD, bool)  # 0..step-1 and all multiples of step: every difference is one of two of these
    cover[:step], cover[::step] = True, True
    delta = np.array([next(d for d in range(PERIOD) if cover[(c + d) % PERIOD]) for c in range(PERIOD)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    residue = (np.arange(n) - (begin + anchor)[owner]) % PERIOD
    sample = np.flatnonzero(cover[residue])
    place = np.full(n + 1, -1, np.int64)
    place[sample] = np.arange(len(sample))
    ranks, depth = ranked(rank[sample]), PERIOD
    while depth < LENGTH:
        to = sample + depth
        inside = to < stop[owner[sample]]
        ahead = np.zeros(len(sample), np.int64)
        ahead[inside] = ranks[place[to[inside]]] + 1
        ranks, depth = ranked(ranks * np.int64(len(sample) + 2) + ahead), depth * 2
    window = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    own = residue[window]
    tie = ranks[place[window + delta[own]]]
    order = np.lexsort((tie, rank[window], own))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((own[a] == own[b]) & (rank[window[a]] == rank[window[b]]))
    view = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    found = np.zeros(len(window), bool)
    for k in range(0, len(near), 20_000):
        x, y = a[near[k : k + 20_000]], b[near[k : k + 20_000]]
        same = (view[window[x]] == view[window[y]]).all(axis=1)
        found[x[same]] = True
        found[y[same]] = True
    return found


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in the order of key; each block is some whole keys."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        windows = rows["windows"].to_numpy(np.int64)
        found = block_matches([bytes(x) for x in rows["octets"]], rows["anchor"].to_numpy(np.int64), windows)
        owner = np.repeat(np.arange(len(rows)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(owner)) - 1
        keep = found[first] & (rows["n"].to_numpy()[owner[first]] == 1)
        first, last = first[keep], last[keep]
        out = rows[CONTEXT].iloc[owner[first]].reset_index(drop=True)
        out["a"], out["b"] = offset[first], offset[last]
        return out

    held, size = [], 0
    for batch in batches:
        edges = np.flatnonzero(np.concatenate([[True], batch["key"].to_numpy()[1:] != batch["key"].to_numpy()[:-1]]))
        for x, y in zip(edges, np.append(edges[1:], len(batch))):
            rows = batch.iloc[x:y]
            if size >= BLOCK and rows["key"].iloc[0] != held[-1]["key"].iloc[0]:
                yield work(pd.concat(held))
                held, size = [], 0
            held.append(rows)
            size += int(rows["octets"].map(len).sum())
    if held:
        yield work(pd.concat(held))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """doc, t, start, stop: bytes covered by repeated windows of rows (doc, t, octets; none is null)."""
    found = stored(rows.mapInPandas(tidied(_anchors), "doc long, t long, key long, c1 long, lo int, shape int"))
    place = F.struct("doc", "t", "lo", "shape")
    contexts = found.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))
    buckets = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.sum("n").alias("all")).where(F.col("all") > 1)
    contexts = stored(contexts.join(buckets, "key").select(*CONTEXT, "n", "rep.*", "m", "least"))
    last = F.col("shape") % 1024
    mixed = contexts.where("m > 1 and least = 1").select(*CONTEXT, "n", "m", F.col("doc").alias("d"), F.col("t").alias("u"), "lo", "shape")
    same = (rows["doc"] == F.col("d")) & (rows["t"] == F.col("u"))
    cut = rows.join(mixed, same).select(
        *CONTEXT, "n", "m", F.floor(F.col("shape") / 1024).cast("int").alias("anchor"), (last + 1).alias("windows"),
        F.substring("octets", F.col("lo") + 1, last + LENGTH).alias("octets"),
    )
    small, large = cut.where(F.col("m") <= LARGE), cut.where(F.col("m") > LARGE)
    size = mixed.agg(F.sum(last + LENGTH)).first()[0]
    blocks = small.repartition(groups_for(size, 16_000_000), "key").sortWithinPartitions("key").mapInPandas(tidied(_blocks), "key long, c1 long, a int, b int")
    some = stored(blocks)
    if mixed.where(F.col("m") > LARGE).limit(1).count():
        window = F.substring("octets", F.col("a") + 1, F.lit(LENGTH))
        each = large.select(*CONTEXT, "n", "octets", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("a")).select(*CONTEXT, "n", "a", F.xxhash64(window).alias("w1"), F.xxhash64(window, F.lit(1)).alias("w2"))
        each = stored(each)
        twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("s")).where("s > 1").drop("s")
        some = some.unionByName(each.where("n = 1").join(twice, ["w1", "w2"]).select(*CONTEXT, "a", F.col("a").alias("b")))
    whole = contexts.where("n > 1").select(*CONTEXT, F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    hits = found.join(whole.unionByName(some), CONTEXT)
    return hits.select("doc", "t", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.coalesce("b", last) + LENGTH).alias("stop"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for octets, spans in zip(batch["octets"], batch["spans"]):
            octets, merged = bytes(octets), []
            for a, b in sorted((int(s["start"]), int(s["stop"])) for s in spans) if spans is not None else []:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(octets[at:a])
                at = b
            kept = b"".join([*kept, octets[at:]])
            rows.append((len(octets), len(octets) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out["doc"], out["none"] = batch["doc"].to_numpy(), batch["none"].to_numpy()
        yield out


def remove_repeats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of each row of docs."""
    # pandas makes all ids of a batch doubles where one is null: no id goes on as 0 with a flag, which t holds too
    none = F.col("doc_id").isNull()
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("octets")
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), none.alias("none"), F.xxhash64(none, text).alias("t"), octets)
    spans = repeated_windows(rows.where(F.length("octets") >= LENGTH).drop("none"))
    of_doc = spans.groupBy("doc", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).toDF("d", "u", "spans")
    joined = rows.join(of_doc, (rows["doc"] == F.col("d")) & (rows["t"] == F.col("u")), "left")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, doc long, none boolean"
    cut = joined.select("doc", "none", "octets", "spans").mapInPandas(tidied(_cut), schema)
    return cut.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), *columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
