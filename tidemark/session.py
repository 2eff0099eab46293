"""Session helpers: the shared folder for cut lineage and versioned tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session may do without that setting (tests): it gets a new
    temporary folder.  A cluster has to name a folder all executors can reach.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one run."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_by_sort(df: DataFrame) -> DataFrame:
    """The same rows, with a hint that their next join sorts both sides.

    For stored tables whose values repeat: they are many times larger in memory than on disk.  Before a query runs
    Spark knows their files only, and would send millions of rows through the driver as a broadcast.
    """
    return df.hint("merge")


def stored(df: DataFrame, name: str, codec: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write the rows once below the shared folder and read them back.

    For a table that several branches of a query need: each branch then reads
    only its columns instead of computing all rows again.  ``codec`` is Parquet's, else the session's.
    A reader takes up to 4,096 rows of a row group at once: ``group_rows`` bounds them where rows are wide.
    """
    path = run_folder(df.sparkSession, name)
    writer = df.write.option("compression", codec) if codec else df.write
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_wide(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for rows of whole vectors (11 kB each), of which a reader takes 1,000 at once."""
    return stored(df, name, group_rows=1_000)
