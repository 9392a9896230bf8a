"""SentencePiece encoding by sampling, and decoding.

The lattice of a text (with one space put before it) has a node between any two characters and an edge for each piece
that the vocabulary holds, its weight falling with the piece's rank as in Zipf's law; a character that no piece covers
alone has an edge for its UTF-8 bytes. Forward filtering sums the weights of all ways to each node; backward sampling
then draws the edges from the end, each with its share of the sum, so a segmentation comes up with the probability
that its product of weights has among all. Draws are a hash of seed, row key, chunk and step: a row always gets the
same segmentation, wherever it is computed.

No piece has a space after another character, and none has a line feed, so every way passes the borders of chunks
(spaces and what follows them, or a line feed). The forward sums of a chunk are computed once for all its occurrences
in a slice of rows, all chunks in step; the draws run over all occurrences at once.

A chunk of over LONG characters (a long text without spaces or line feeds) goes by itself, in windows: the forward sums take a
number for each character, and edges are made anew for the window where the draws stand.

Decoding joins the bytes of the pieces and drops the space put before: it gives back each text exactly, which the
encoder checks for every row.

Defined cases: a null text gives null ids and is not lossless-checked (null); an empty one gives no ids; a null key is
a key of its own; rows of equal key and text get equal ids; a literal U+2581 goes by bytes, unlike a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rimfold.llm.common import MIX, mix64, read, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
SLICE = 1_200_000
LONG, WINDOW = 100_000, 20_000


def vocabulary(path: str = MODEL) -> tuple[list[str], list[float]]:
    """Pieces (spaces for U+2581; empty where not text; bytes as \\x00 and the hex digits) and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        pieces.append("\x00" + name[3:5] if model.is_byte(i) else name.replace("▁", " ") if plain else "")
        scores.append(model.get_score(i))
    return pieces, scores


class Lattice:
    """Tables of the vocabulary as arrays."""

    def __init__(self, pieces: list[str], scores: list[float], sharpness: float = 1.0):
        words = {p: i for i, p in enumerate(pieces) if p and p[0] != "\x00"}
        self.byte_ids = np.zeros(256, np.int64)
        raw = [b""] * len(pieces)
        for i, p in enumerate(pieces):
            if p[:1] == "\x00":
                self.byte_ids[int(p[1:], 16)] = i
                raw[i] = bytes([int(p[1:], 16)])
            else:
                raw[i] = p.encode()
        self.longest = max(map(len, words))
        rank = np.array([-scores[i] for i in words.values()])
        self.weights = np.full(len(pieces), -np.inf)
        self.weights[list(words.values())] = -sharpness * np.log(rank - rank.min() + 10)
        self.unknown = self.weights[np.isfinite(self.weights)].min() - 2.0
        keys = np.array([self.key(np.array([ord(c) for c in p], np.uint64)) for p in words], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(words.values()))[order]
        assert (np.diff(self.keys) > 0).all()
        slot, begin, count = np.unique(self.keys >> np.uint64(44), return_index=True, return_counts=True)
        self.first, self.deepest = np.zeros(1 << 20, np.int64), int(count.max())
        self.first[slot] = begin
        self.keys = np.append(self.keys, np.full(self.deepest, 2**64 - 1, np.uint64))
        self.ids = np.append(self.ids, np.zeros(self.deepest, self.ids.dtype))
        self.room = (np.zeros((0, self.longest), np.int32), np.zeros((0, self.longest), np.float32))
        self.slots, self.heads = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.slots[keys >> np.uint64(44)] = True
        heads = {p[:k] for p in words for k in range(1, len(p))}
        self.heads[np.array([self.key(np.array([ord(c) for c in p], np.uint64)) for p in heads], np.uint64) >> np.uint64(44)] = True
        self.sizes = np.array([len(r) for r in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.octets = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def key(codes: np.ndarray) -> int:
        h = 1
        for c in codes.tolist():
            h = (h * int(MIX) + c + 1) % (1 << 64)
        return int(mix64(np.array([h], np.uint64))[0])

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For characters laid end to end, with `left` characters up to the chunk's end from each: the ids (-1: none)
        and weights of the pieces that end after character k and are L + 1 long, at [k, L]."""
        n = len(codes)
        if len(self.room[0]) < n:
            self.room = (np.empty((n * 5 // 4, self.longest), np.int32), np.empty((n * 5 // 4, self.longest), np.float32))
        ids, weights = (x[:n] for x in self.room)
        ids.fill(-1)
        weights.fill(-np.inf)
        h = np.ones(n, np.uint64)
        at = np.arange(n)
        for length in range(1, self.longest + 1):
            inside = left[at] >= length
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * MIX + codes[at + length - 1] + np.uint64(1)
            key = mix64(h)
            slot = key >> np.uint64(44)
            maybe = np.flatnonzero(self.slots[slot])
            k = self.first[slot[maybe]]
            for _ in range(self.deepest - 1):
                k += self.keys[k] < key[maybe]
            hit = self.keys[k] == key[maybe]
            end = at[maybe[hit]] + length - 1
            ids[end, length - 1] = self.ids[k[hit]]
            weights[end, length - 1] = self.weights[self.ids[k[hit]]]
            longer = self.heads[slot]  # only what begins a longer piece can still match
            at, h = at[longer], h[longer]
        alone = ids[:, 0] < 0
        ids[alone, 0] = -2 - codes[alone].astype(np.int64)
        weights[alone, 0] = self.unknown
        return ids, weights

    def forward(self, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each character, the running shares over length of the edges that end after it; overwrites weights."""
        first = np.cumsum(lengths) - lengths
        alpha = np.full(len(weights) + 1, -np.inf, np.float32)
        order = np.argsort(-lengths, kind="stable")
        deep = -lengths[order]
        back = np.arange(self.longest)
        for t in range(int(lengths.max(initial=0))):
            here = first[order[: np.searchsorted(deep, -t, side="left")]] + t
            wide = min(t + 1, self.longest)
            reach = alpha[np.maximum(here[:, None] - 1 - back[:wide], 0)]
            if t < self.longest:
                reach[:, t] = 0.0  # the chunk's start
            ways = reach + weights[here, :wide]
            top = ways.max(axis=1)
            share = np.exp(ways - top[:, None])
            total = share.sum(axis=1)
            alpha[here] = top + np.log(total)
            weights[here, :wide] = np.cumsum(share / total[:, None], axis=1)
            weights[here, wide:] = 2.0
        return weights

    def encode(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, and their number for each text."""
        chunks, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = CHUNK.findall(" " + text) if text else []
            counts[i] = len(own)
            chunks += own
        if not chunks:
            return np.zeros(0, np.int32), counts
        which, different = pd.factorize(np.array(chunks, dtype=object))
        del chunks
        lengths = np.array([len(c) for c in different], np.int64)
        far = np.flatnonzero(lengths > LONG)
        far_codes = {int(k): self.codes(different[k]) for k in far}
        lengths[far] = 0  # they take no part in what follows
        codes = self.codes("".join(c for c, n in zip(different, lengths) if n))
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(codes))
        ids, weights = self.edges(codes, left)
        shares = self.forward(lengths, weights)
        start, node = (ends - lengths)[which], ends[which] - 1
        row = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        draw = mix64(mix64(keys + MIX * np.uint64(seed + 1))[row] + MIX * nth.astype(np.uint64))
        live, sizes, steps = np.flatnonzero(lengths[which]), np.zeros(len(which), np.int64), []
        apart = {int(i): self.encode_long(far_codes[int(which[i])], draw[i]) for i in np.flatnonzero(lengths[which] == 0)}
        for i, own in apart.items():
            sizes[i] = len(own)
        while len(live):
            draw_now = (mix64(draw[live] + np.uint64(len(steps))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = node[live]
            pick = np.minimum((draw_now[:, None] >= shares[at]).sum(axis=1), self.longest - 1)
            code = ids[at, pick]
            lost = code == -1  # a share rounded to 1 early: the longest edge there is
            if lost.any():
                pick[lost] = self.longest - 1 - np.argmax(ids[at[lost], ::-1] != -1, axis=1)
                code = ids[at, pick]
            steps.append((live, code))
            sizes[live] += 1
            node[live] = at - pick - 1
            live = live[node[live] >= start[live]]
        out, stop = np.zeros(sizes.sum(), np.int64), np.cumsum(sizes)
        for k, (own, code) in enumerate(steps):
            out[stop[own] - 1 - k] = code
        for i, own in apart.items():
            out[stop[i] - len(own) : stop[i]] = own
        row = np.repeat(row, sizes)
        return self.with_bytes(out, row, len(texts))

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def window(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and weights of the pieces that end after characters a to b - 1 of one chunk."""
        low = max(0, a - self.longest + 1)
        ids, weights = self.edges(codes[low:b], np.arange(b - low, 0, -1))
        return ids[a - low :].copy(), weights[a - low :].astype(np.float64)

    def encode_long(self, codes: np.ndarray, draw: np.uint64) -> np.ndarray:
        """ids of one chunk, by windows: a sum of ways for each character, then draws from the end."""
        n, back = len(codes), np.arange(self.longest)
        sums = np.full(n + 1, -np.inf)
        sums[0] = 0.0
        for a in range(0, n, WINDOW):
            _, weights = self.window(codes, a, min(n, a + WINDOW))
            for k in range(a, min(n, a + WINDOW)):
                wide = min(k + 1, self.longest)
                ways = sums[k - back[:wide]] + weights[k - a, :wide]
                top = ways.max()
                sums[k + 1] = top + np.log(np.exp(ways - top).sum())
        out, at, low = [], n, n
        while at:
            if at <= low:
                low = (at - 1) // WINDOW * WINDOW
                ids, weights = self.window(codes, low, at)
            wide = min(at, self.longest)
            shares = np.cumsum(np.exp(sums[at - 1 - back[:wide]] + weights[at - 1 - low, :wide] - sums[at]))
            u = float(mix64(np.array([draw], np.uint64) + np.uint64(len(out)))[0] >> np.uint64(11)) * 2.0**-53
            pick = min(int((u * shares[-1] >= shares).sum()), wide - 1)
            while ids[at - 1 - low, pick] == -1:
                pick -= 1
            out.append(int(ids[at - 1 - low, pick]))
            at -= pick + 1
        return np.array(out[::-1], np.int64)

    def with_bytes(self, out: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that go by bytes (-2 - code point) become the ids of their bytes."""
        loose = np.flatnonzero(out < -1)
        if len(loose):
            points, inverse = np.unique(-2 - out[loose], return_inverse=True)
            raw = [chr(p).encode("utf-8", "surrogatepass") for p in points]
            size = np.ones(len(out), np.int64)
            size[loose] = np.array([len(r) for r in raw])[inverse]
            stop = np.cumsum(size)
            table = np.zeros((len(raw), 4), np.int64)
            for i, r in enumerate(raw):
                table[i, : len(r)] = self.byte_ids[list(r)]
            wide, row = np.repeat(out, size), np.repeat(row, size)
            for k in range(4):
                has = size[loose] > k
                wide[(stop - size)[loose[has]] + k] = table[inverse[has], k]
            out = wide
        return out.astype(np.int32), np.bincount(row, minlength=n)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces, the space put before included."""
        size = self.sizes[ids]
        begin = self.starts[ids] - (np.cumsum(size) - size)
        return self.octets[np.repeat(begin, size) + np.arange(size.sum())].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids)[1:].decode("utf-8", "surrogatepass")


def encoder(pieces: list[str], scores: list[float], sharpness: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, scores, sharpness)
        for batch in batches:
            texts, keys = batch.column(0), batch.column(1)
            sizes = np.cumsum([0] + [len(t.as_py() or "") for t in texts]) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(texts)]
            for a, b in sorted(set(zip(cuts, cuts[1:]))):
                if a == b:
                    continue
                own = texts.slice(a, b - a).to_pylist()
                plain = [t or "" for t in own]
                key = np.array([0x5EED if k is None else k for k in keys.slice(a, b - a).to_pylist()], np.int64).view(np.uint64)
                ids, counts = lattice.encode(plain, key, seed)
                edges = np.concatenate([[0], np.cumsum(counts)])
                whole = "".join(" " + t for t in plain if t).encode("utf-8", "surrogatepass")
                same = [True] * len(own)
                if lattice.decode(ids) != whole:
                    same = [not t or lattice.decode_text(ids[x:y]) == t for t, x, y in zip(plain, edges, edges[1:])]
                null = np.array([t is None for t in own])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[2:]), lists, pa.array(counts, pa.int64()), pa.array([None if t is None else s for t, s in zip(own, same)])],
                    [*batch.schema.names[2:], "ids", "n_ids", "lossless"],
                )

    return run


def encode(docs: DataFrame, keep: list[str], *, text: str = "text", key: str = "doc_id", model: str = MODEL, sharpness: float = 1.0, seed: int = 0) -> DataFrame:
    """keep's columns of docs, with ids, n_ids and lossless (decoding gives the text back)."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("lossless", T.BooleanType())]
    from pyspark.sql import functions as F

    ready = docs.select(F.col(text).alias("_text"), F.col(key).cast("long").alias("_key"), *keep)
    return ready.mapInArrow(tidied(encoder(*vocabulary(model), sharpness, seed)), T.StructType([docs.schema[c] for c in keep] + added))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ["doc_id"])
