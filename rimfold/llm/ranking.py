r"""Ranked lexical search: impact-ordered postings, read score at a time.

Terms are the maximal matches of TERM in the whole text, A-Z lower-cased. N counts the documents with a term, L all their
terms; a document of n terms has m = 100 - B + ((B * n * N) div L), a term of df documents the weight
w = floor(1000 * ln((2N + 2) / (2df + 1))). The impact of a term in a document is w * ((1000000000 * tf) div (1000 * tf + 20m)),
and a document's score for an item is the sum of the impacts of the item's terms. Each item gets its k best documents.

Documents are read once: a row of theirs keeps n and the counts of the terms that some item asks for. (What is not asked for is
left out by a bit map of the items' terms, of fixed size; what the map lets through by chance is told apart by the terms
themselves.) Document frequencies are a grouped count of these rows. Documents are dealt into shards by a hash, so that a
shard has about SHARD postings, items into groups of ITEMS; each pair of shard and group is one task, which builds the shard's
index: for each term its postings in falling order of exact impact. An item's search goes down through the impacts of all
its terms together, always by whole groups of equal impact, adding them to the documents' sums. What a document can still gain
is at most the sum of the next impacts of the terms. The walk stops when that is below the k-th best sum found: then no
document unmet can enter, and those met whose sum and that bound together reach the k-th best are the candidates, whose
scores are completed from their own rows. Shards give k rows an item at most, which meet in one ranking.

Defined cases: null and empty texts and those without terms are no documents (not in N) and are never found; items without
terms have no rows; repeated documents (and those without id) are documents each, in the order of their ids, no id first;
items are told apart by row, so those of equal item_id have rankings of their own (item_row); documents of over
2^63 / (50 N) terms are computed in longer integers. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimfold.llm.common import groups_for, read, slices, stored, tidied

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, B = 50, 50
#: Postings in a shard, items in a group, bits of the map of asked terms.
SHARD, ITEMS, MAP = 1_000_000, 1024, 1 << 20


def terms(text: str | None) -> list[bytes]:
    return re.findall(TERM, (text or "").encode().lower())


def bit(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 9) % MAP


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_row, item_id, term: the distinct terms of each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [(r, i, t.decode(), bit(t)) for r, i, x in zip(batch["item_row"], batch["item_id"].astype("Int64"), batch["text"]) for t in sorted(set(terms(x)))]
            out = pd.DataFrame(own, columns=["item_row", "item_id", "term", "bit"])
            yield out.astype({"item_id": "Int64"})

    numbered = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), F.col(text).alias("text"))
    return numbered.mapInPandas(run, "item_row long, item_id long, term string, bit int")


def asked_map(asked: DataFrame) -> bytes:
    """A bit for each hash of an asked term: MAP bits, however many terms there are."""
    bits = np.zeros(MAP, np.uint8)
    bits[[r["bit"] for r in asked.select("bit").distinct().collect()]] = 1  # MAP rows at most
    return np.packbits(bits).tobytes()


def counted(docs: DataFrame, asked: bytes, text: str = "text") -> DataFrame:
    """doc_row, doc_id, n, terms, tf of the documents with a term: n counts all terms, the arrays hold the asked ones."""
    schema = "doc_row long, doc_id long, n long, terms array<string>, tf array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(np.frombuffer(asked, np.uint8)).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for row, doc, text in zip(part["doc_row"], part["doc_id"].astype("Int64"), part["text"]):
                    count = Counter(terms(text))
                    own = {t: c for t, c in count.items() if wanted[xxhash.xxh64_intdigest(t, 9) % MAP]}
                    if count:
                        rows.append((row, doc, sum(count.values()), [t.decode() for t in own], list(own.values())))
                yield pd.DataFrame(rows, columns=["doc_row", "doc_id", "n", "terms", "tf"]).astype({"doc_id": "Int64"})

    numbered = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return numbered.mapInPandas(tidied(run), schema)


# ---- one shard --------------------------------------------------------------------------------------------------------


class Shard:
    """Postings of one shard's documents: by document, and by term in falling order of impact."""

    def __init__(self, offsets: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        """offsets: where each document's postings begin, and the end; term: a number from 0 to n_terms, or -1 (not asked)."""
        self.offsets, self.term, self.impact = offsets, term, impact
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        use = np.flatnonzero((term >= 0) & (impact > 0))
        order = use[np.lexsort((-impact[use], term[use]))]
        self.listed, self.falling = doc[order], -impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.size, self.n_terms = len(offsets) - 1, n_terms

    def complete(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The documents' whole scores for the terms `own`, from their own postings."""
        asked = np.zeros(self.n_terms + 1, np.int64)
        asked[own] = 1
        n = self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(n)
        at = np.repeat(self.offsets[docs] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(self.impact[at] * asked[self.term[at]])])
        return sums[ends] - sums[ends - n]

    def search(self, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents above 0 and their scores, ties by ids; and how many postings were read."""
        at, stop = self.begin[own].copy(), self.begin[own + 1]
        sums, read, share = np.zeros(self.size, np.int64), 0, 0.75
        while True:
            ahead = np.array([-self.falling[a] if a < b else 0 for a, b in zip(at, stop)], np.int64)
            rest = int(ahead.sum())
            least = int(np.partition(sums, self.size - k)[self.size - k]) if self.size > k else 0
            if rest == 0 or least > rest:
                break
            down = -int(share * ahead.max())  # all impacts of at least that much: whole groups of equal impact
            for i in np.flatnonzero(ahead):
                to = at[i] + int(np.searchsorted(self.falling[at[i] : stop[i]], down, "right"))
                sums[self.listed[at[i] : to]] += -self.falling[at[i] : to]  # a term lists a document once
                read += to - at[i]
                at[i] = to
            share *= 0.9
        found = np.flatnonzero((sums > 0) & (sums + rest >= least))
        scores = self.complete(found, own) if rest else sums[found]
        best = np.lexsort((ids[found], -scores))[:k]
        return found[best], scores[best], read


def damped(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """m of documents of n terms."""
    wide = n if B * docs * int(n.max(initial=0)) < 1 << 63 else n.astype(object)
    return (100 - B + B * wide * docs // length).astype(np.int64)


def rank(docs: DataFrame, items: DataFrame, k: int = K, *, text: str = "text", item_text: str = "text", shard: int = SHARD, group: int = ITEMS) -> DataFrame:
    """item_row, item_id, rank, doc_id, score for each item's k best documents."""
    asked = stored(item_terms(items, item_text))
    rows = stored(counted(docs, asked_map(asked), text))
    n_docs, length, postings = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("item_row", "item_id", "term", "df")
    shards, groups = groups_for(postings, shard), groups_for(asked.select("item_row").distinct().count(), group)
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("doc_row", F.lit(6)), F.lit(shards))).withColumn("g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    asks = weighed.withColumn("g_", F.pmod(F.xxhash64("item_row", F.lit(7)), F.lit(groups))).withColumn("s_", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    out = pa.schema([("item_row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(data: pa.Table, asks: pa.Table) -> pa.Table:
        if not data.num_rows or not asks.num_rows:
            return out.empty_table()
        data, asks = data.combine_chunks(), asks.combine_chunks()
        known = pc.unique(asks["term"])
        number = lambda x: pc.fill_null(pc.index_in(x, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lists, tfs = (data[c].chunk(0) for c in ("terms", "tf"))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        term, tf = number(lists.flatten()), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = number(asks["term"].chunk(0))
        weight = np.zeros(len(known) + 1, np.int64)
        weight[place] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in asks["df"].to_pylist()]
        m = np.repeat(damped(data["n"].to_numpy(), n_docs, length), np.diff(offsets))
        index = Shard(offsets, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m)), len(known))
        ids = pc.fill_null(data["doc_id"], np.iinfo(np.int64).min).to_numpy()  # no id first
        item_row, item_id, found = asks["item_row"].to_numpy(), asks["item_id"].chunk(0), []
        order = np.argsort(item_row, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(item_row[order])) + 1):
            best, scores, _ = index.search(place[own], ids, k)
            some = pa.array(best)
            found.append(pa.table([pa.array(np.repeat(item_row[own[0]], len(best))), item_id.take(pa.array(np.repeat(own[0], len(best)))), data["doc_id"].chunk(0).take(some), pa.array(scores)], schema=out))
        return pa.concat_tables(found)

    pairs = dealt.groupBy("s", "g").cogroup(asks.groupBy("s_", "g_"))
    found = pairs.applyInArrow(search, "item_row long, item_id long, doc_id long, score long")
    best = F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("item_row", "item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_row")


OP13_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
c as (select count(*) as n, sum(len(t)) as l from d where len(t) > 0),
p as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by 1, 2),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from p group by 1), c),
m as (select r, doc_id, 50 + (50 * len(t) * n)::bigint // l::bigint as m from d, c),
s as (select q, item_id, r, any_value(m.doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
      from i join p using (term) join w using (term) join m using (r) group by 1, 2, 3),
k as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from k where rank <= 50
"""
