"""Session helpers.

Every job pins the session to UTC (processed_at comparisons are defined on
UTC instants) and keeps ANSI mode, AQE, skew-join splitting and parquet
aggregate pushdown on.  Nothing here overrides settings a cluster already
provides except the time zone, which is part of the query semantics.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that shape plans at any scale.  Shuffle partition count is left to
# the cluster (AQE coalesces small partitions at run time).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Broadcast only on a measured size: no plan-time broadcast from size
    # estimates; AQE broadcasts a join side once its shuffle output is known
    # to be below the limit.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def pin(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the queries rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "quire") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOT: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is.  Only when it is unset (local tests) is one folder created under /tmp
    for this process and reused by later callers.
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_ROOT is None:
            _LOCAL_ROOT = tempfile.mkdtemp(prefix="quire-ckpt-")
        root = _LOCAL_ROOT
    path = os.path.join(root, name) if "://" not in root else f"{root.rstrip('/')}/{name}"
    return path


# Largest measured size of a key set that is broadcast.
KEY_BYTES = 32 * 1024 * 1024


def measured_keys(keys):
    """Mark a set of string keys as a broadcast side when its measured size
    (characters plus 32 bytes a key) is at most KEY_BYTES, so the large side of a
    semi-join isn't shuffled to meet a small batch.  Returns (keys, is_small)."""
    from pyspark.sql import functions as F

    size = keys.agg(F.sum(F.octet_length(keys.columns[0]) + 32)).first()[0] or 0
    return (F.broadcast(keys), True) if size <= KEY_BYTES else (keys, False)


def stage(df):
    """Materialise `df` once on the shared checkpoint folder and continue
    from the stored rows (`checkpoint()`, never a local checkpoint).  Used
    where one intermediate feeds several branches of a plan: the branches
    read the stored rows instead of recomputing the whole lineage, and a lost
    executor does not force recomputation from the sources."""
    spark = df.sparkSession
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions manage the folder themselves
        sc = None
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark, "rdd"))
    return df.checkpoint(eager=True)
