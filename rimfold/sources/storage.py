"""Tables and tiles in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset and all runs on this machine,
    as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="rimfold-"))
        base = _own[0]
    return f"{base.rstrip('/')}/rimfold-{uuid.uuid4().hex}"


def stored(rows: DataFrame, most: int = 0) -> DataFrame:
    """rows, computed once and written there: cuts lineage and outlives lost executors. most: so many rows in a file, for long rows,
    as a reader's batch is of one file (0: any number)."""
    path = folder(rows.sparkSession)
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_tiles(tiles: DataFrame, path: str, group: str) -> None:
    """Tiles as Parquet, a folder for each group, so that a split by group prunes files."""
    tiles.write.partitionBy(group).parquet(path)


def tile_batches(tiles: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """tiles with index (from 0, in order within its group) and batch (index div size): the listing that a loader walks."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return tiles.withColumn("index", nth.cast("long")).withColumn("batch", F.floor(F.col("index") / size))


def read_tiles(spark: SparkSession, path: str, groups: list[str] | None = None, group: str = "group") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if groups is None else rows.where(rows[group].isin(groups))
