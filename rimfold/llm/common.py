"""What several operators share: reading, tables in the shared folder, words and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words as the contracts count them: runs of anything but ASCII white space (what bytes.split() gives).
WORD = r"[^\x20\x09-\x0D]+"
_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="rimfold-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of what nothing refers to any more when the driver collects its garbage, which an idle
    driver hardly does by itself."""
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: cuts lineage and outlives lost executors. The folder is the
    job's to clear, as with checkpoints."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rimfold-{uuid.uuid4().hex}"
    let_go(spark)
    df.write.parquet(path)
    let_go(spark)
    return spark.read.schema(df.schema).parquet(path)


def groups_for(total: int, each: int, least: int = 1) -> int:
    """How many groups of about `each` a total makes; the count follows the data."""
    return max(least, -(-int(total or 0) // each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on unsigned arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on, and the next stage's need adds to what they hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run):
    """A batch function that ends with release()."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(frame: pd.DataFrame, column: str = "text", most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The frame in runs of rows with about `most` characters each, so that work arrays stay small."""
    if not len(frame):
        return
    ends = frame[column].str.len().fillna(0).to_numpy().cumsum()
    group = (ends / most).astype(np.int64)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        yield frame.iloc[a:b]
