"""Mixing sources to target weights.

The words of a source, its documents laid end to end in a pseudorandom order, are packed into blocks of `block` words
(the last may be shorter). The output is shards of SLOTS slots, a slot holding a block.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ...; they share the words of all documents by weight;
none gets more than `most` times its words, and the excess goes to the others by weight until none is above. A source
gets its target in slots, to the nearest whole one. All slots are dealt to the shards by one seeded permutation, so the
counts of sources in a shard are a multinomial draw given each source's total. (Draws without that condition miss the
targets of small sources and take blocks more than `most` times.)

The slots of a source are numbered; number j is pass j div n over its n blocks, and the place in the pass goes through a
permutation of the blocks that source, pass and seed determine (a Feistel network on the next even power of two, walked
until it falls inside). Slots and pieces of documents are then joined by source and block index, without texts; the
pieces found are gathered by document, meet its text once, and the text is cut. A slot's content is the text of its rows
in the order of `at`; a document's pieces, in the order of their words, are its text as it was.

Sources, slots and documents are all rows: there is no list of sources on the driver and no bound on their number.
Prefix sums go by range partitions or hash buckets, so no source meets in one task. A row for a document holds the
list of its own pieces.

Defined cases: null text has no words and is never taken; null source is a source; without any words nothing is taken.
Repeated rows are documents of their own. Equal input and seed give the same mix. Rows are told apart by two 64-bit
hashes of doc_id, source and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimfold.llm.common import MIX, WORD, groups_for, mix64, read, stored, tidied

BLOCK, SLOTS, BUCKET, CHUNK, SLICE = 32, 1 << 15, 2000, 1 << 18, 2_000_000
ROW = ["_k1", "_k2"]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index through a permutation of range(n) that key determines; by element."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = index.astype(np.uint64), np.arange(len(index))
    while len(live):
        x, h, m, k = out[live], half[live], mask[live], key[live]
        a, b = x >> h, x & m
        for turn in range(4):
            a, b = b, a ^ (mix64(b + k + np.uint64(turn * 0x632BE5AB + 1)) & m)
        out[live] = (a << h) | b
        live = live[out[live] >= n[live].astype(np.uint64)]
    return out.astype(np.int64)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the two hashes that tell their rows apart."""
    own = [F.col("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.col(text)]
    return docs.withColumns({"_k1": F.xxhash64(*own), "_k2": F.xxhash64(F.lit(1), *own)})


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, _k1, _k2, size (words) of every row."""
    return keyed(docs, text).select("doc_id", "source", *ROW, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def before(rows: DataFrame, value: str) -> F.Column:
    """The sum of value over the rows before each, in the order of _id (monotonic ids of sorted rows), with `_offset`,
    the sum over earlier partitions."""
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))


def with_offsets(rows: DataFrame, value: str) -> DataFrame:
    """rows with _offset; the window has a row for each partition of the sorted rows."""
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")), "_part")


def sources_of(rows: DataFrame, *, block: int = BLOCK, most: int = 3) -> DataFrame:
    """source, source_no (by code point, null last), source_size, target, blocks, slots and first (of all sources' slots)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.asc_nulls_last("source"))
    laid = stored(totals.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_id", 33), "_one": F.lit(1)})
    known = with_offsets(laid, "_one").withColumn("source_no", before(laid, "_one")).drop("_offset", "_one")
    known = stored(known.withColumn("_weight", F.col("source_no") % 3 + 1))
    # what is above its bound at one share is so at every larger share, and the share only grows
    share, capped = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(share) > most * F.col("source_size")
        now = known.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, most * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(above, 0).otherwise(F.col("_weight"))).alias("open"), F.count_if(above).alias("capped"),
        ).first()
        if now["capped"] == capped or not now["open"]:
            break
        share, capped = (now["all"] - now["fixed"]) / now["open"], now["capped"]
    target = F.least(F.col("_weight") * F.lit(share), (most * F.col("source_size")).cast("double"))
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.least(F.round(F.try_divide(target * blocks, F.col("source_size"))), most * blocks)
    due = known.withColumns({"target": target, "blocks": blocks, "slots": F.coalesce(slots, F.lit(0)).cast("long")})
    found = with_offsets(due, "slots").withColumn("first", before(due, "slots"))
    return stored(found.select("source", "source_no", "source_size", "target", "blocks", "slots", "first"))


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """_k1, _k2, nth (of equal rows), size, source_no and begin, the words before the row in its source: sums by bucket,
    then within a bucket; for rows with words."""
    own = rows.where("size > 0").groupBy(*ROW, "source").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    numbers = sources.select(F.col("source").alias("_source"), "source_no")
    own = own.join(numbers, own["source"].eqNullSafe(numbers["_source"])).drop("source", "_source")
    own = own.withColumns({"bucket": F.pmod("_k1", F.lit(groups_for(rows.count(), BUCKET))), "words": F.col("n") * F.col("size")})
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = own.groupBy("source_no", "bucket").agg(F.sum("words").alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(*ROW).rowsBetween(Window.unboundedPreceding, -1)
    laid = own.withColumn("inner", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(buckets, ["source_no", "bucket"])
    nth = laid.select(*ROW, "size", "source_no", (F.col("offset") + F.col("inner")).alias("start"), F.explode(F.expr("sequence(0L, n - 1)")).alias("nth"))
    return nth.select(*ROW, "nth", "size", "source_no", (F.col("start") + F.col("nth") * F.col("size")).alias("begin"))


def _slots(seed: int, total: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, n, first, a, b in batch[["source_no", "blocks", "first", "a", "b"]].itertuples(index=False):
                j = np.arange(a, b, dtype=np.int64)
                each = np.full(len(j), n, np.int64)
                key = mix64(mix64(np.full(len(j), seed * 1_000_003 + source, np.uint64)) + (j // n).astype(np.uint64))
                place = permuted(first + j, np.full(len(j), total, np.int64), np.full(len(j), mix64(np.array([seed + 17], np.uint64) * MIX)[0], np.uint64))
                yield pd.DataFrame({"source_no": source, "block": permuted(j % n, each, key), "pass": j // n, "shard": place // SLOTS, "slot": place % SLOTS})

    return run


def drawn_slots(sources: DataFrame, *, seed: int = 1) -> DataFrame:
    """source_no, block, pass, shard, slot of every slot of the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    chunk = F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK}L)")).alias("a")
    chunks = sources.where("slots > 0").select("source_no", "blocks", "first", "slots", chunk).withColumn("b", F.least(F.col("a") + CHUNK, "slots"))
    return chunks.repartition(groups_for(total, CHUNK)).mapInPandas(tidied(_slots(seed, total)), "source_no long, block long, pass long, shard long, slot long")


def drawn_pieces(laid: DataFrame, slots: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """_k1, _k2 and pieces: for each piece of the row's words in a block and each slot of that block, the piece's first
    word and number of words in the text, the slot, and how many words of the block stand before it."""
    end = F.col("begin") + F.col("size")
    blocks = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))))
    start = F.greatest("begin", F.col("block") * block)
    blocks = blocks.select(
        *ROW, "nth", "source_no", "block", (start - F.col("begin")).cast("int").alias("a"), (F.least(end, (F.col("block") + 1) * block) - start).cast("int").alias("m"),
        (start - F.col("block") * block).cast("int").alias("at"),
    )
    # (merge joins: what comes out of a Python function is estimated too small to be broadcast on trust)
    return blocks.join(slots.hint("merge"), ["source_no", "block"]).groupBy(*ROW).agg(F.collect_list(F.struct("a", "m", "at", "nth", "shard", "slot", "block", "pass")).alias("pieces"))


def _cut(names: list[str]):
    """Batches of text, pieces and other columns: a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            stops = np.cumsum([0] + [len(t.as_buffer()) for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(stops[1:] // SLICE)) + 1), len(batch)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                own, lists = batch.slice(x, y - x), batch.column(1).slice(x, y - x)
                text, edges = b"".join(t.as_py() for t in texts.slice(x, y - x)), stops[x : y + 1] - stops[x]
                octets = np.frombuffer(text, np.uint8)
                black = (octets != 32) & ((octets < 9) | (octets > 13))
                head = black.copy()
                head[1:] &= ~black[:-1]
                head[edges[:-1]] = black[edges[:-1]]
                words = np.append(np.flatnonzero(head), len(octets))
                first = np.searchsorted(words, edges)
                owner = np.repeat(np.arange(y - x), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                piece = {f.name: flat.field(k).to_numpy() for k, f in enumerate(flat.type)}
                a, b = piece["a"], piece["a"].astype(np.int64) + piece["m"]
                lo = np.where(a == 0, edges[owner], words[first[owner] + a])
                hi = np.where(first[owner] + b == first[owner + 1], edges[owner + 1], words[np.minimum(first[owner] + b, len(words) - 1)])
                count = np.searchsorted(words[:-1], hi) - np.searchsorted(words[:-1], lo)
                for k in range(0, len(owner), 65_536):
                    part = slice(k, k + 65_536)
                    cut = pa.array([text[s:e] for s, e in zip(lo[part].tolist(), hi[part].tolist())], pa.binary()).cast(pa.string())
                    rest = own.select(names).take(pa.array(owner[part]))
                    numbers = [pa.array(piece[c][part].astype(np.int64)) for c in ("shard", "slot", "at", "nth", "block", "pass")]
                    yield pa.RecordBatch.from_arrays([*rest.columns, *numbers, pa.array(count[part].astype(np.int64)), cut], [*names, "shard", "slot", "at", "nth", "block", "pass", "words", "piece"])

    return run


def mixed_shards(docs: DataFrame, rows: DataFrame, sources: DataFrame, *, keep: list[str], text: str = "text", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix, a row for each piece of a document in a slot: keep's columns of docs, shard, slot, at (words of the slot
    before it), nth (of equal rows), block, pass, words (their number) and piece (the text)."""
    pieces = drawn_pieces(placed(rows, sources), drawn_slots(sources, seed=seed), block=block)
    nth = F.row_number().over(Window.partitionBy(*ROW).orderBy(*ROW))
    one = keyed(docs, text).where(F.col(text).isNotNull()).withColumn("_nth", nth).where("_nth = 1")
    both = one.join(pieces.hint("merge"), ROW).select(F.col(text).alias("_text"), "pieces", *keep)
    added = [T.StructField(c, T.LongType()) for c in ("shard", "slot", "at", "nth", "block", "pass", "words")]
    schema = T.StructType([both.schema[c] for c in keep] + added + [T.StructField("piece", T.StringType())])
    return both.mapInArrow(tidied(_cut(keep)), schema)


def mix(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, block: int = BLOCK, seed: int = 1, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixed shards of docs (see mixed_shards), the sized rows and the sources."""
    rows = stored(sized(docs, text))
    sources = sources_of(rows, block=block, most=most)
    return mixed_shards(docs, rows, sources, keep=keep or ["doc_id", *ROW], text=text, block=block, seed=seed), rows, sources


def taken_words(shards: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the shards hold of it) of every row."""
    got = shards.groupBy(*ROW, "nth").agg(F.sum("words").alias("got"))
    nth = F.row_number().over(Window.partitionBy(*ROW).orderBy(*ROW)).cast("long") - 1
    numbers = sources.select(F.col("source").alias("_source"), "source_size", "target")
    held = rows.withColumn("nth", nth).join(got.hint("merge"), [*ROW, "nth"], "left")
    held = held.join(numbers, held["source"].eqNullSafe(numbers["_source"]))
    return held.select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(*mix(read(spark, sf_dir, "documents"))).drop("source")
