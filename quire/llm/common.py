"""Helpers shared by the training-data operators: reading tables, staging
intermediate tables on shared storage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"[\x20\x09-\x0D]"
TERM_GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

# Largest measured size of a table that is broadcast; anything larger is joined
# by sort-merge.
BROADCAST_BYTES = 16 * 1024 * 1024

# Memory size of staged rows that fill a writing task, and the fewest tasks that
# `in_few` leaves.
TASK_BYTES = 16 * 1024 * 1024
FEWEST_TASKS = 24

_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def space_words(c: Column | str) -> Column:
    """Runs of characters other than ASCII white space (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+"), "")


def term_words(c: Column | str) -> Column:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), f"{TERM_GAP_CLASS}+"), "")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).  Unset only in
    local runs, which get one temporary folder per process."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quire-llm-")
    return _local_root


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage
    ends there, so a lost executor costs no recomputation of earlier stages."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged_bytes(df: DataFrame) -> int:
    """Stored size of a staged table."""
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def in_few(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """`df`, made from these staged tables and about as large at most, in no more
    tasks than they fill by TASK_BYTES, FEWEST_TASKS at least.  A small table that
    many shuffle partitions would write as so many tiny files (on a local disk
    each costs three `chmod` processes started by the executor) gets a few; from
    larger tables all partitions stay, as they do if no source is named."""
    if not sources:
        return df
    return df.coalesce(max(FEWEST_TASKS, -(-sum(map(staged_bytes, sources)) * 4 // TASK_BYTES)))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's stored size is at most a quarter of `limit`
    (Parquet holds rows in about a quarter of their memory size)."""
    return staged_bytes(df) * 4 <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`broadcast()` a staged table that is small; a larger one keeps the sort-merge join."""
    return F.broadcast(df) if is_small(df, limit) else df
