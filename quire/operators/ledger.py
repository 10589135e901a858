"""The processing ledger as an append-only table of versions.

A row per post is never updated in place: every claim, result or release is
a new version and readers take the latest version per key.  That replaces the
source's `INSERT OR REPLACE` / `UPDATE` (parquet has no row-level update)
and makes every write an idempotent append.

Latest-by-key is `max(struct(version, ...))` per key: a partial + final
aggregate (sort-based, since the kept row carries strings), so a key that
holds a third of all versions is reduced to one row per task before the
shuffle and no task ever holds a key's versions together.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import measured_keys

LEDGER_SCHEMA = (
    "post_id STRING, processed_at TIMESTAMP, category STRING, page_id STRING, "
    "raw_data STRING, status STRING, version BIGINT"
)
PAYLOAD = ["processed_at", "category", "page_id", "raw_data", "status"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read a ledger folder with the current schema.  Files written before
    `status` existed read it as NULL, which means `completed`."""
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return df.withColumn("status", F.coalesce("status", F.lit("completed")))


def create_ledger(spark: SparkSession, table: str, path: str) -> None:
    """Create the ledger table over `path` if absent.  It is partitioned as the
    jobs write it, one folder a batch; `add_batches` takes in new folders."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({LEDGER_SCHEMA}, batch_id BIGINT) "
        f"USING parquet PARTITIONED BY (batch_id) LOCATION '{path}'"
    )


def add_batches(spark: SparkSession, table: str) -> None:
    """Register the batch folders that a job has written since in a table
    partitioned by `batch_id` (the ledger or the published table)."""
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def append_bucketed(versions: DataFrame, table: str, path: str, buckets: int) -> None:
    """Append versions to a table bucketed by post id and sorted by id and version
    (made if absent).  Latest-by-key and the joins on the id then read a bucket's
    rows where they lie: nothing of the ledger is shuffled, however long its
    history, and the other side of a join is dealt to the buckets.  Rows are dealt
    out before the write, so an append adds one file a bucket."""
    (
        versions.repartition(buckets, "post_id")
        .sortWithinPartitions("post_id", "version")
        .write.format("parquet")
        .bucketBy(buckets, "post_id")
        .sortBy("post_id", "version")
        .option("path", path)
        .mode("append")
        .saveAsTable(table)
    )


def current(versions: DataFrame, columns: list[str] = PAYLOAD) -> DataFrame:
    """Latest version per post id.  Only `columns` are carried through the
    aggregate and its shuffle; ask for those needed, the stored payload is large."""
    latest = versions.groupBy("post_id").agg(F.max(F.struct("version", *columns)).alias("v"))
    return latest.select("post_id", F.col("v.version").alias("version"), *[F.col(f"v.{c}").alias(c) for c in columns])


def current_for(versions: DataFrame, posts: DataFrame, id_col: str = "id", columns: list[str] = PAYLOAD) -> DataFrame:
    """Latest version of only the keys present in `posts`.

    A poll touches a small batch of ids while the ledger holds all history.
    The batch's ids are measured: a small set is broadcast, so only the batch's
    versions are aggregated and shuffled.  A larger set is met after the
    aggregate, which has reduced each key per task before the shuffle and shares
    its partitioning with the join; a hot key is one row per task either way.
    `columns` are cut first, so no payload is shuffled for a status.
    """
    keys, small = measured_keys(posts.select(F.col(id_col).alias("post_id")).distinct())
    cut = versions.select("post_id", "version", *columns)
    if small:
        return current(cut.join(keys, "post_id", "left_semi"), columns)
    return current(cut, columns).join(keys, "post_id", "left_semi")


def ever_failed(versions: DataFrame) -> DataFrame:
    """Ids (`id`) with a failed version.  With `claim` these are the retries:
    it drops those whose latest version is no longer a failure."""
    return versions.where(F.col("status") == "failed").select(F.col("post_id").alias("id")).distinct()


def compact(spark: SparkSession, versions: DataFrame, path: str) -> DataFrame:
    """Write the latest versions to a new folder and read them back (cuts the
    lineage on shared storage; the old folder stays until the caller swaps)."""
    current(versions).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert-or-replace by post id: newer versions win."""
    columns = [c for c in PAYLOAD if c in base.columns]
    return current(base.unionByName(changes.select(base.columns)), columns)


def _status(c: str = "status") -> F.Column:
    return F.coalesce(F.col(c), F.lit("completed"))


def processed(cur: DataFrame) -> DataFrame:
    """Keys whose status is completed (or NULL, which means completed)."""
    return cur.where(_status() == "completed").select("post_id")


def locked(cur: DataFrame) -> DataFrame:
    """Keys currently claimed."""
    return cur.where(F.col("status") == "processing").select("post_id")


def blocked(cur: DataFrame) -> DataFrame:
    """Keys that may not be claimed: completed, processing or NULL."""
    return cur.where(_status().isin("completed", "processing")).select("post_id")


def new_posts(posts: DataFrame, cur: DataFrame) -> DataFrame:
    """Posts neither processed nor claimed (absent, or last attempt failed)."""
    return posts.join(blocked(cur).withColumnRenamed("post_id", "id"), "id", "left_anti")


def claim(posts: DataFrame, cur: DataFrame, claimed_at: dt.datetime, version: int) -> DataFrame:
    """Claim versions for every claimable post: category `review`, raw `{}`,
    no page, status `processing`."""
    return new_posts(posts, cur).select(
        F.col("id").alias("post_id"),
        F.lit(claimed_at).cast("timestamp").alias("processed_at"),
        F.lit("review").alias("category"),
        F.lit(None).cast("string").alias("page_id"),
        F.lit("{}").alias("raw_data"),
        F.lit("processing").alias("status"),
        F.lit(version).cast("bigint").alias("version"),
    )


def release(cur: DataFrame, keys: DataFrame, status: str = "failed", version: int | None = None) -> DataFrame:
    """Set `status` on the rows of `keys` (an update by key): left join of
    the distinct change keys, `coalesce(new, old)`.  To append the result as new
    versions give a `version` above those stored; changed rows carry it, so
    `upsert` prefers them."""
    newer = F.col("version") if version is None else F.when(F.col("__new_status").isNotNull(), F.lit(version).cast("bigint")).otherwise(F.col("version"))
    change = keys.select("post_id").distinct().withColumn("__new_status", F.lit(status))
    return (
        cur.join(change, "post_id", "left")
        .withColumn("version", newer)
        .withColumn("status", F.coalesce("__new_status", "status"))
        .drop("__new_status")
    )


def blocked_flags(posts: DataFrame, cur: DataFrame) -> DataFrame:
    """posts + boolean `blocked` (a left join on distinct ledger keys)."""
    b = blocked(cur).select(F.col("post_id").alias("id"), F.lit(True).alias("blocked"))
    return posts.join(b, "id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
