"""Images: finding PNG files, decoding gray values, settings.

The decoder covers what a gray raster needs: 8-bit gray, gray with alpha, RGB and RGBA without interlacing.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """The defaults of the deployed extractor."""

    target_size: int = 1296
    rim_thresh: float = 0.25
    min_confidence: float = 0.7
    min_confidence_min: float = 0.6
    scale_steps: int = 40
    downsample_factor: float = 1.0
    limit: int = 12

    @classmethod
    def read(cls, spark: SparkSession, path: str, flags: list[str] | None = None) -> Settings:
        """Defaults, over them the `name: value` lines of a file, over these flags such as --limit=5."""
        lines = [r["value"] for r in spark.read.text(path).collect()]  # a settings file
        given = dict(line.split("#")[0].split(":", 1) for line in lines if ":" in line.split("#")[0])
        flagged = dict(f.removeprefix("--").split("=", 1) for f in flags or [] if "=" in f)
        return cls.of({k.strip().lower(): v.strip() for k, v in (given | flagged).items()})

    @classmethod
    def of(cls, given: dict) -> Settings:
        """Defaults with what is given; unknown names are ignored."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in given.items() if k in known})


def find_images(spark: SparkSession, path: str, *, without: str = "truth", groups: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """path and content of all PNG files below path, without those with `without` in their path. With groups (such as
    altitude01_longitude10) only those that have both parts of one as folders of exactly these names. A limit takes the first by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    rows = rows.where(~F.col("path").contains(without)).select("path", "content")
    if groups is not None:
        parts = [g.split("_", 1) for g in groups if "_" in g]
        inside = [F.col("path").contains(f"/{a}/") & F.col("path").contains(f"/{b}/") for a, b in parts]
        rows = rows.where(reduce(Column.__or__, inside, F.lit(False)))
    if limit is None:
        return rows
    return rows.join(F.broadcast(rows.select("path").orderBy("path").limit(limit)), "path", "left_semi")  # contents are not sorted


def write_images(rows: DataFrame, folder: str) -> int:
    """Writes content to folder/path for each row (path, content), in the folder that all executors share; how many were written.
    Each file gets its name when it is whole, and a task that runs again writes the same files."""

    def write(batches):
        import posixpath
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                to = posixpath.join(base, path)
                above = posixpath.dirname(to)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                part = posixpath.join(above, f".{uuid.uuid4().hex}")
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, to)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def decode_png(data: bytes) -> np.ndarray:
    """Gray values (height, width) of a PNG; colours by the usual luma weights."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit gray and colour without interlacing")
    raw, size = zlib.decompress(b"".join(packed)), w * channels
    out, before = np.zeros((h, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(h):
        kind, line = raw[y * (size + 1)], np.frombuffer(raw, np.uint8, size, y * (size + 1) + 1)
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):  # each byte needs the one before it
            line = np.frombuffer(unfiltered(kind, line.tobytes(), before.tobytes(), channels), np.uint8)
        out[y] = before = line
    pixels = out.reshape(h, w, channels)
    if channels < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def unfiltered(kind: int, line: bytes, before: bytes, channels: int) -> bytes:
    """A line of a PNG coded by average (3) or Paeth (4) differences."""
    out = bytearray(channels) + bytearray(line)
    above = bytes(channels) + before
    for i in range(channels, len(out)):
        a, b = out[i - channels], above[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = above[i - channels]
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        out[i] = (out[i] + guess) & 255
    return bytes(out[channels:])


def encode_png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG; line y is coded by filter y mod 5."""
    h, w = gray.shape
    wide = np.zeros((h + 1, w + 1), np.int16)
    wide[1:, 1:] = gray
    own, left, up, corner = wide[1:, 1:], wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    p, q, r = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    guess = [np.zeros_like(own), left, up, (left + up) >> 1, np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))]
    lines = b"".join(bytes([y % 5]) + (own[y] - guess[y % 5][y]).astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_of(plane, h: int, w: int) -> Column:
    """A gray PNG of a plane of values from 0 to 255."""

    @F.pandas_udf("binary")
    def encoded(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: None if p is None else encode_png(np.asarray(p, float).astype(np.uint8).reshape(h, w)))

    return encoded(plane)


def gray_plane(content: str) -> Column:
    """Height, width and gray values of each image; null where it does not decode."""

    @F.pandas_udf("struct<h:int,w:int,plane:array<double>>")
    def decode(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                gray = decode_png(bytes(data))
                rows.append((gray.shape[0], gray.shape[1], gray.ravel().astype(float).tolist()))
            except (ValueError, struct.error, zlib.error):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["h", "w", "plane"])

    return decode(content)


def union_files(spark: SparkSession, paths: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Feature tables of several CSV files, united by name; columns that a file lacks are null. Files of equal names (which
    their first lines tell) are one scan. kinds are the types of columns, double where not named; without kinds types are
    inferred, which reads the files twice."""
    by: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        names = tuple(spark.read.option("header", True).csv(path).columns)
        by.setdefault(names, []).append(path)
    out = None
    for names, same in by.items():
        reader = spark.read.option("header", True)
        reader = reader.option("inferSchema", True) if kinds is None else reader.schema(", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names))
        rows = reader.csv(same)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
