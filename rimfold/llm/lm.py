"""LM scoring by a weighted backoff automaton.

Tokens: A-Z lower-cased, runs of [^\\x20\\x09-\\x0D]+, then one end. Training documents count; the others are held out.
The model is of order three and interpolates with absolute discounts:
    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | v) = max(c(vw) - D, 0) / c(v) + D T(v) / c(v) P(w), and P(w) where v was not seen
    P(w | uv) = max(c(uvw) - D, 0) / c(uv) + D T(uv) / c(uv) P(w | v), and P(w | v) where uv was not seen
with T the number of different words seen after a context. As an automaton: a state for each context (two words, one
word, or none: the root), an arc with its logarithm for each n-gram seen in training, once is enough, and a failure arc from
each state to that of its last word, and from there to the root, of weight D T / c. A text is one traversal from left to right
from the start's state: take the arc, or else failure arcs up to a state that has one; the state is then that of the last words.

Counts cover all training documents and nothing of the model is cut: the automaton is never held as a whole. Documents
are packed in groups (a table in the shared folder: different words as 64-bit hashes, tokens as places in that list).
Each group asks for the n-grams it has; a request goes to the part of the hash of its context, which sums the counts
over all groups and answers every request in its order. Then each group builds the part of the automaton that its
texts can reach, and walks it. Requests of a group are rows only for parts that it asks, so there are never more rows
than n-grams; sizes of groups and parts are parameters. Orders go one after the other: what an order counts over PART / 2 times
is a hot context of the next (no more than two for each part, as all counts add up to the tokens), and hot contexts, like
the root, are dealt by the following word instead. What their parts find of followers is summed by a grouping and joined
to the groups that meet the context, as rows. So a part has no context of more than about PART tokens whole, however
large the corpus. In a part, contexts are told apart by 48 bits, and followers of one context by 48 bits at order one, 40
at two and three: of n followers that meet in a part about n^2 / 2^41 merge with another, two of PART.

Defined cases: null and empty texts are one end token; a null doc_id is training; repeated rows each count and are
each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import MIX, groups_for, let_go, mix64, read, release, slices, stored, tidied

DISCOUNT, GROUP, PART = 0.75, 6_000_000, 1_200_000
START, END = np.uint64(1), np.uint64(2)  # hashes of the start (never a token) and the end
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = {1: 48, 2: 40, 3: 40}  # of a follower's hash, by order


def pack(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (ends included) of the texts end to end, and their number by text."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        counts[i] = len(own)
        words += own
    out = np.full(len(words) + len(texts), END, np.uint64)
    if words:
        which, different = pd.factorize(np.array(words, dtype=object))
        hashes = pd.util.hash_array(np.array([w.decode("utf-8", "surrogatepass") for w in different], dtype=object), categorize=False)
        hashes[hashes <= END] += MIX
        place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)
        out[place] = hashes[which]
    return out, counts + 1


def _group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, number, held = TaskContext.get().partitionId(), 0, []

    def done() -> pd.DataFrame:
        nonlocal number, held
        tokens = np.concatenate([h[0] for h in held])
        words, ids = np.unique(np.append(tokens, START), return_inverse=True)
        row = {
            "g": (part << 24) + number, "n": len(tokens), "docs": pack(np.concatenate([h[2] for h in held])), "flags": pack(np.concatenate([h[3] for h in held])),
            "counts": pack(np.concatenate([h[1] for h in held])), "words": pack(words), "ids": pack(ids[:-1].astype(np.uint32)),
        }
        number, held = number + 1, []
        return pd.DataFrame([row])

    size = 0
    for batch in batches:
        for own in slices(batch, most=1_500_000):
            tokens, counts = token_hashes(own["text"].fillna("").tolist())
            missing = own["doc_id"].isna().to_numpy()
            flags = (own["held_out"].to_numpy().astype(np.uint8)) | (missing.astype(np.uint8) << 1)
            held.append((tokens, counts, own["doc_id"].fillna(0).to_numpy(np.int64), flags))
            size += own["text"].str.len().sum()
            if size >= GROUP:
                size = 0
                yield done()
    if held:
        yield done()


def grouped(docs: DataFrame, held_out) -> DataFrame:
    """The documents as groups of about GROUP characters: a row each."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return stored(rows.mapInPandas(tidied(_group), "g long, n long, docs binary, flags binary, counts binary, words binary, ids binary"))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(u + MIX * mix64(v ^ MIX))


class Group:
    """What a group's row says: its words, tokens and n-grams, in a fixed order."""

    def __init__(self, row: pd.Series):
        self.docs, self.flags, self.counts = unpack(row["docs"], np.int64), unpack(row["flags"], np.uint8), unpack(row["counts"], np.int64)
        self.words, self.ids = unpack(row["words"], np.uint64), unpack(row["ids"], np.uint32).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.training = np.repeat((self.flags & 1) == 0, self.counts)
        self.before = np.empty(len(self.ids), np.int64)
        self.before[1:] = self.ids[:-1]
        self.before[self.first] = np.searchsorted(self.words, START)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.before * len(self.words) + self.ids, return_inverse=True)

    @property
    def bigrams(self) -> np.ndarray:
        """Different bigrams: context place * words + word place."""
        return self.pairs[0]

    @property
    def bigram(self) -> np.ndarray:
        """Which of them each token ends."""
        return self.pairs[1]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that are not first in their text; the different trigrams (place of a bigram * words + word place) and
        which of them these tokens end."""
        inner = np.ones(len(self.ids), bool)
        inner[self.first] = False
        inner = np.flatnonzero(inner)
        found, which = np.unique(self.bigram[inner - 1] * len(self.words) + self.ids[inner], return_inverse=True)
        return inner, found, which

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of an order: places of their contexts and words, and their counts in training here."""
        n = len(self.words)
        if order == 1:
            return np.zeros(n, np.int64), np.arange(n), np.bincount(self.ids[self.training], minlength=n)
        if order == 2:
            found, seen = self.bigrams, np.bincount(self.bigram[self.training], minlength=len(self.bigrams))
        else:
            inner, found, which = self.trigrams()
            seen = np.bincount(which[self.training[inner]], minlength=len(found))
        return found // n, found % n, seen

    def dealt(self, order: int, context: np.ndarray, word: np.ndarray, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams: their order by part and context, and in it their parts, 48-bit contexts and whether these are hot;
        hot: the keys (gram_key) of the hot contexts."""
        mixed = mix64(self.words)
        if order == 1:
            h, is_hot = np.zeros(1, np.uint64), np.ones(1, bool)
        elif order == 2:
            h, is_hot = mixed, np.isin(gram_key(1, np.uint64(0), mixed), hot)
        else:
            u, v = self.bigrams // len(self.words), self.bigrams % len(self.words)
            h, is_hot = pair_hash(self.words[u], self.words[v]), np.isin(gram_key(2, mixed[u] >> np.uint64(16), mixed[v]), hot)
        own = np.where(is_hot[context], mixed[word], h[context]) % np.uint64(parts)
        short = h[context] >> np.uint64(16)
        at = np.lexsort((short, own))
        return at, own[at].astype(np.int64), short[at], is_hot[context[at]]


def gram_key(order: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What an n-gram is known by as a context of the next order: from its 48-bit context and its word's mixed hash."""
    return mix64(context + MIX * mix64((word >> np.uint64(64 - BITS[order])) ^ MIX))


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change: the first of each run."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


#: The start is the context of every text's first word: always hot.
FIRST = gram_key(1, np.zeros(1, np.uint64), mix64(np.array([START])))


def _requests(order: int, parts: int, hot: np.ndarray):
    """A row for each part that a group asks, and one of the hot contexts that it meets (o < 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                group = Group(row)
                context, word, seen = group.grams(order)
                at, part, short, is_hot = group.dealt(order, context, word, parts, hot)
                followers, seen = mix64(group.words)[word[at]] >> np.uint64(64 - BITS[order]), seen[at]
                cuts = changes(part) if len(part) else np.zeros(0, np.int64)
                met = np.unique(short[is_hot]) if order > 1 else short[:0]
                rows = [(-order, row["g"] % parts, row["g"], pack(met), None, None, None, None)] if len(met) else []
                for a, b in zip(cuts, np.append(cuts[1:], len(part))):  # parts that are asked
                    runs = changes(short[a:b], is_hot[a:b])
                    lengths = np.diff(np.append(runs, b - a))
                    own = short[a:b][runs]
                    rows.append((order, part[a], row["g"], pack(np.diff(own, prepend=np.uint64(0))), pack(is_hot[a:b][runs].astype(np.uint8)), pack(lengths.astype(np.uint32)), pack(followers[a:b]), pack(seen[a:b].astype(np.uint32))))
                del group, context, word, seen, at, part, short, followers, is_hot
                yield pd.DataFrame(rows, columns=["o", "p", "g", "contexts", "hot", "runs", "followers", "seen"])
                del rows
                release()

    return run


def _answers(least: int):
    """Counts for every request in its order; besides, without a group, what the part has of each hot context (context, t:
    followers, n: at the root, tokens), and the n-grams counted over `least` times (gram)."""
    columns = ["g", "o", "p", "times", "after", "context", "t", "n", "gram"]

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns, dtype=object)  # numbers beside nulls, whole
        return out.assign(**{c: pd.array(out[c].tolist(), "Int64") for c in columns if c not in ("times", "after")})

    def run(key, asked: pd.DataFrame) -> pd.DataFrame:
        order = int(key[0])
        if order < 0:
            rows = [(g, order, key[1], None, c, None, 0, 0, None) for g, c in zip(asked["g"], asked["contexts"])]
            return table(rows)
        bits = np.uint64(BITS[order])
        contexts, runs = [np.cumsum(unpack(x, np.uint64)) for x in asked["contexts"]], [unpack(x, np.uint32) for x in asked["runs"]]
        context, of = np.unique(np.concatenate(contexts), return_inverse=True)
        hot = np.zeros(len(context), bool)
        hot[of[np.concatenate([unpack(x, np.uint8) for x in asked["hot"]]) > 0]] = True
        gram = np.repeat(of.astype(np.uint64) << bits, np.concatenate(runs))
        gram |= np.concatenate([unpack(x, np.uint64) for x in asked["followers"]])
        different, which = np.unique(gram, return_inverse=True)
        del gram
        times = np.bincount(which, np.concatenate([unpack(x, np.uint32) for x in asked["seen"]]), len(different)).astype(np.int64)
        owner = (different >> bits).astype(np.int64)
        after = np.bincount(owner[times > 0], minlength=len(context))
        rows, c, q = [], 0, 0
        for g, own, lengths in zip(asked["g"], contexts, runs):
            n = int(lengths.sum())
            rows.append((g, order, key[1], pack(times[which[q : q + n]].astype(np.uint32)), pack(after[of[c : c + len(own)]].astype(np.uint32)), None, 0, 0, None))
            c, q = c + len(own), q + n
        rows += [(None, order, key[1], None, None, int(context[k]), int(after[k]), int(times.sum()) if order == 1 else 0, None) for k in np.flatnonzero(hot)]
        big = np.flatnonzero(times > least)
        keys = gram_key(order, context[owner[big]], different[big] << (np.uint64(64) - bits)).view(np.int64)
        rows += [(None, order, key[1], None, None, None, 0, 0, int(k)) for k in keys]
        del which, different, context, of, contexts, runs, owner
        release()
        return table(rows)

    return run


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """g, o, context: the hot contexts that a group meets, a row each."""
    for batch in batches:
        for g, o, packed in zip(batch["g"], batch["o"], batch["after"]):
            yield pd.DataFrame({"g": g, "o": -o, "context": unpack(packed, np.uint64).astype(np.int64)})


class Automaton:
    """Arcs by n-gram and failure weights by state; log10."""

    def __init__(self, words: int, tokens: int, types: int, total: np.ndarray, bigrams: np.ndarray, times2: np.ndarray, after2: np.ndarray, trigrams: np.ndarray, times3: np.ndarray, after3: np.ndarray, last2: np.ndarray):
        """total: counts of words as contexts and words (the start's is that of the end); last2: the bigram at a trigram's end."""
        root = (total + 0.5) / (tokens + 0.5 * (types + 1))
        v, w = bigrams // words, bigrams % words
        fail2, two = self.level(total, after2, v, times2, root[w])
        uv = trigrams // words
        fail3, three = self.level(times2, after3, uv, times3, two[last2])
        self.root, self.fail2, self.fail3 = (np.log10(x) for x in (root, fail2, fail3))
        self.arc2, self.arc3 = np.where(times2 > 0, np.log10(two), np.nan), np.where(times3 > 0, np.log10(three), np.nan)

    @staticmethod
    def level(count: np.ndarray, after: np.ndarray, context: np.ndarray, times: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Failure weights of the contexts (1 for one that is no state) and the interpolated probabilities of the n-grams."""
        fail = np.where(count > 0, DISCOUNT * after / np.maximum(count, 1), 1.0)
        return np.maximum(fail, 1e-300), np.maximum(times - DISCOUNT, 0.0) / np.maximum(count[context], 1) + fail[context] * lower

    def walk(self, ids: np.ndarray, before: np.ndarray, bigram: np.ndarray, inner: np.ndarray, trigram: np.ndarray) -> np.ndarray:
        """The weight of every token on the way through the texts: its bigram's place, and where it is not first (inner) its
        trigram's. The state before a token is that of the two tokens before it."""
        low = np.where(np.isnan(self.arc2[bigram]), self.fail2[before] + self.root[ids], self.arc2[bigram])
        high = self.arc3[trigram]
        low[inner] = np.where(np.isnan(high), self.fail3[bigram[inner - 1]] + low[inner], high)
        return low


def _scores(parts: int, hot: dict[int, np.ndarray], tokens: int, types: int):
    def run(key, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group = Group(row.iloc[0])
        told, answers = answers[answers["context"].notna()], answers[answers["context"].isna()]
        n, answers, found = len(group.words), answers.sort_values(["o", "p"]), {}
        inner, trigrams, trigram = group.trigrams()
        sizes = {1: 1, 2: n, 3: len(group.bigrams)}
        for order in (1, 2, 3):
            context, word, _ = group.grams(order)
            at, part, short, is_hot = group.dealt(order, context, word, parts, hot[order])
            own = answers[answers["o"] == order]
            times, after = np.zeros(len(word), np.int64), np.zeros(sizes[order], np.int64)
            times[at] = np.concatenate([unpack(x, np.uint32) for x in own["times"]] or [np.zeros(0, np.uint32)])
            runs = changes(part, short, is_hot) if len(part) else np.zeros(0, np.int64)
            after[context[at[runs]]] = np.concatenate([unpack(x, np.uint32) for x in own["after"]] or [np.zeros(0, np.uint32)])
            if order > 1:
                k, whole = runs[is_hot[runs]], told[told["o"] == order].sort_values("context")
                after[context[at[k]]] = whole["t"].to_numpy(np.int64)[np.searchsorted(whole["context"].to_numpy(np.int64), short[k].astype(np.int64))]
            found[order] = (times, after)
        total = found[1][0]
        total[np.searchsorted(group.words, START)] = 0
        end = np.searchsorted(group.words, END)
        base = np.log10((total + 0.5) / (tokens + 0.5 * (types + 1)))[group.ids]
        known = (total > 0)[group.ids].astype(np.int64)
        total[np.searchsorted(group.words, START)] = total[end]  # a text has one start and one end
        last2 = np.zeros(len(trigrams), np.int64)
        last2[trigram] = group.bigram[inner]
        automaton = Automaton(n, tokens, types, total, group.bigrams, *found[2], trigrams, *found[3], last2)
        weights = automaton.walk(group.ids, group.before, group.bigram, inner, trigram)
        del automaton, found
        release()
        return pd.DataFrame({
            "doc_id": pd.array(group.docs, dtype="Int64").copy() if not (group.flags & 2).any() else pd.array([None if f & 2 else d for d, f in zip(group.docs.tolist(), group.flags)], dtype="Int64"),
            "held_out": (group.flags & 1) == 1, "n_tokens": group.counts, "n_known": np.add.reduceat(known, group.first),
            "train_tokens": tokens, "base_score": np.add.reduceat(base, group.first), "score": np.add.reduceat(weights, group.first),
        })

    return run


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs; held_out: a condition."""
    groups = grouped(docs, held_out)
    size = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    parts = groups_for(size["n"], PART)
    request = "o int, p long, g long, contexts binary, hot binary, runs binary, followers binary, seen binary"
    answer = "g long, o int, p long, times binary, after binary, context long, t long, n long, gram long"
    hot, answers = {1: np.zeros(0, np.uint64)}, None
    for order in (1, 2, 3):  # one after the other: what is asked of an order is gone before the next is asked
        asked = groups.drop("n").mapInPandas(tidied(_requests(order, parts, hot[order])), request)
        own = stored(asked.repartition(parts, "o", "p").groupBy("o", "p").applyInPandas(_answers(PART // 2), answer))
        answers = own if answers is None else answers.unionByName(own)
        found = own.where("gram is not null").select("gram").collect()  # two for each part at most, as counts add up to the tokens
        hot[order + 1] = np.append(np.array([r["gram"] for r in found], np.int64).view(np.uint64), FIRST if order == 1 else np.zeros(0, np.uint64))
        del asked, own
    let_go(docs.sparkSession)
    root = answers.where("o = 1 and context is not null").agg(F.sum("t").alias("types"), F.sum("n").alias("tokens")).first()
    tokens, types = root["tokens"] or 0, root["types"] or 0
    sums = answers.where("o > 1 and context is not null").groupBy("o", "context").agg(F.sum("t").alias("t"))
    met = answers.where("o < 0").select("g", "o", "after").mapInPandas(_met, "g long, o int, context long").join(sums, ["o", "context"])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    many = groups_for(size["groups"], 2)
    none = {"p": F.lit(0).cast("long"), "times": F.lit(None).cast("binary"), "after": F.lit(None).cast("binary")}
    counts = answers.where("g is not null and o > 0").select("g", "o", "p", "times", "after", "context", "t")
    back = counts.unionByName(met.withColumns(none)).repartition(many, "g")
    return groups.drop("n").repartition(many, "g").groupBy("g").cogroup(back.groupBy("g")).applyInPandas(_scores(parts, hot, tokens, types), schema)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
