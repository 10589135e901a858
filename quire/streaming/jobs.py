"""Structured Streaming versions of the poll loop and the weekly statistics.

* `ingest_to_ledger`: file source -> ledger rows -> parquet sink.  The file
  sink's commit log makes each micro-batch land exactly once.
* `claim_stream`: new posts per micro-batch are anti-joined with the current
  ledger (read again in every batch, so claims of batch N block batch N+1)
  and their claim versions appended; a replayed batch overwrites only its own
  `batch_id` partition, so a retry after executor loss writes nothing twice.
  Rows whose last attempt failed are claimable again, completed and processing
  rows are not; with `retry_failed` every batch also takes up failed ledger rows
  that don't come in again.
* `first_within`: the state store's bounded dedup in front of the ledger check.
* `ingest_stream`: raw post texts with two sinks, posts and quarantine.
* `weekly_closed` and `late_counts`: 7-day windows in append mode with a
  watermark, each written once when it closes, and what came too late for them.
* `weekly_digests`: one digest for every week that closes.
* `weekly_windows`: 7-day tumbling windows by category.  Each batch writes its
  own counts and readers add them up, so a row counts however late it comes and
  no state is kept between batches.

Every job runs with `trigger(availableNow=True)` by default (backfill, then
stop); pass a processing-time interval for a standing poll.  Checkpoints and
outputs live under the shared `spark.checkpoint.dir`.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import digest, ingest
from quire.operators import ledger as L
from quire.session import shared_dir

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def scratch(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def as_files(df: DataFrame, path: str, files: int) -> str:
    """Write `df` as `files` parquet files, the input of a stream of as many
    micro-batches."""
    df.repartition(files).write.parquet(path)
    return path


def as_slices(df: DataFrame, path: str, time_col: str, files: int) -> str:
    """Write `df` as up to `files` parquet files that each hold an equal stretch of
    `time_col`, one after the other: the input of a stream that takes files by
    their age, so that rows arrive in the order of that column."""
    seconds = F.unix_seconds(F.col(time_col).cast("timestamp"))
    lo, hi = df.agg(F.min(seconds), F.max(seconds)).first()
    slices = df.withColumn("__s", seconds - F.lit(lo)).withColumn("__s", F.expr(f"(__s * {files}) div {hi - lo + 1}"))
    for i in range(files):
        part = slices.where(F.col("__s") == i).drop("__s")
        if not part.isEmpty():
            part.coalesce(1).sortWithinPartitions(time_col).write.mode("append").parquet(path)
    return path


def first_within(posts: DataFrame, delay: str, key: str = "id", time_col: str = "created_at") -> DataFrame:
    """Drops a streamed row whose key came in at most `delay` before, in event
    time; the keys live in the state store until the watermark has passed them by
    `delay`, so the state is bounded by the rows of that time.  Rows older than the
    watermark are dropped too.  Later repeats pass: the ledger decides on them."""
    return posts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def append_files(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> None:
    """Append a stream to a parquet folder (exactly once, by the sink's own log)."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream the parquet files under `path`: a folder, or a single file,
    which is given to the source as a one-file glob (the source treats a
    plain path as the partition base folder)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"
    return reader.parquet(path)


def ingest_to_ledger(
    rows: DataFrame, ledger_path: str, checkpoint: str, interval: str | None = None
) -> None:
    """Append streamed ledger rows to a parquet folder (exactly once)."""
    writer = (
        rows.withColumn("processed_date", F.to_date("processed_at"))
        .writeStream.format("parquet")
        .option("path", ledger_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("processed_date")
        .outputMode("append")
    )
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def claim_stream(
    spark: SparkSession,
    posts: DataFrame,
    ledger_path: str,
    checkpoint: str,
    interval: str | None = None,
    retry_failed: bool = False,
    dedup_within: str | None = None,
) -> None:
    """Claim new posts of every micro-batch against the ledger at
    `ledger_path` (a folder of versions partitioned by batch).  A claim's time
    is the newest post's of the batch (now, for a batch without posts).  With
    `dedup_within` repeats within that time don't reach the ledger check."""
    if dedup_within:
        posts = first_within(posts, dedup_within)

    def claim_batch(batch: DataFrame, batch_id: int) -> None:
        # only ids are claimed; the batch is read by three jobs below
        posts = batch.select("id", "created_at").persist()
        asked = ingest.first_of_batch(posts).select("id")
        # a replayed batch doesn't see the claims of its first attempt
        prior = spark.read.schema(L.LEDGER_SCHEMA + ", batch_id BIGINT").parquet(ledger_path)
        prior = prior.where(F.col("batch_id") != batch_id).drop("batch_id")
        if retry_failed:
            asked = asked.unionByName(L.ever_failed(prior)).distinct()
        cur = L.current_for(prior, asked, columns=["status"])
        at = posts.agg(F.max("created_at")).first()[0] or dt.datetime.now(dt.timezone.utc)
        claims = L.claim(asked, cur, at, version=(batch_id + 1) << 40)
        claims.write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch_id}")
        posts.unpersist()

    writer = posts.writeStream.foreachBatch(claim_batch).option("checkpointLocation", checkpoint)
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def weekly_windows(rows: DataFrame, out_path: str, checkpoint: str, interval: str | None = None) -> None:
    """Counts per 7-day window (epoch-aligned) and category, in one folder per
    micro-batch, which a replay replaces."""

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window("processed_at", f"{fixed.WEEK_DAYS} days"), "category").agg(F.count(F.lit(1)).alias("n"))
        counts.select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "n"
        ).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def window_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """Count per (window, category) over all micro-batches written so far."""
    parts = spark.read.parquet(out_path)
    return parts.groupBy("window_start", "window_end", "category").agg(F.sum("n").alias("n"))


def ingest_stream(raw: DataFrame, out_path: str, checkpoint: str, interval: str | None = None) -> None:
    """Validate streamed post texts (column `raw`): accepted posts go to `posts`,
    the others with their reason to `quarantine`, one folder per micro-batch in
    each, which a replay replaces."""

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by both sinks
        posts, bad = ingest.ingest(batch)
        for kind, rows in (("posts", posts), ("quarantine", bad)):
            rows.write.mode("overwrite").parquet(f"{out_path}/{kind}/batch_id={batch_id}")
        batch.unpersist()

    writer = raw.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def _week() -> F.Column:
    return F.window("processed_at", f"{fixed.WEEK_DAYS} days")


def weekly_closed(rows: DataFrame, out_path: str, checkpoint: str, delay: str, interval: str | None = None) -> None:
    """Counts per 7-day window (epoch-aligned) and category, appended to a parquet
    folder once the watermark (newest row less `delay`) has passed a window's end.
    The state holds the open windows only; rows of a window that was given out are
    dropped, and counted by `late_counts`."""
    counts = rows.withWatermark("processed_at", delay).groupBy(_week(), "category").agg(F.count(F.lit(1)).alias("n"))
    closed = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "n")
    append_files(closed, out_path, checkpoint, interval)


def late_counts(
    spark: SparkSession, rows: DataFrame, out_path: str, checkpoint: str, delay: str, interval: str | None = None
) -> None:
    """Counts per window and category of the rows that `weekly_closed` drops, for a
    stream with the same micro-batches (one file each).  A window is given out with
    the watermark of the batches before; so in batch n a row is late if its window
    ends by the newest row of the batches up to n - 2, less `delay`.  Every batch
    writes its newest row's time and its late counts in folders of its own."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("processed_at", "category").persist()
        batch.agg(F.max("processed_at").alias("newest")).write.mode("overwrite").parquet(f"{out_path}/newest/batch_id={batch_id}")
        late = batch.select(_week().alias("w"), "category")
        if batch_id < 2:
            late = late.limit(0)
        else:
            before = spark.read.parquet(f"{out_path}/newest").where(F.col("batch_id") <= batch_id - 2)
            mark = before.agg(F.max("newest") - F.expr(f"interval {delay}")).first()[0]
            late = late.where(F.col("w.end") <= F.lit(mark))
        late.groupBy(F.col("w.start").alias("window_start"), "category").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
            f"{out_path}/late/batch_id={batch_id}"
        )
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()


def weekly_digests(
    spark: SparkSession, ledger_path: str, outbox_path: str, checkpoint: str, delay: str, max_files: int | None = None, interval: str | None = None
) -> None:
    """A digest for every 7-day window of the ledger at `ledger_path` (as
    `ingest_to_ledger` writes it), emitted when the watermark closes the window.
    The outbox has one folder per window, which a replayed batch replaces and no
    later batch meets, so every week is sent once.  The digest is made from all
    ledger rows of the week that are stored by then."""
    rows = read_stream(spark, ledger_path, L.LEDGER_SCHEMA + ", processed_date DATE", max_files)
    closed = rows.withWatermark("processed_at", delay).groupBy(_week()).agg(F.count(F.lit(1)).alias("n"))

    def emit(batch: DataFrame, batch_id: int) -> None:
        for start, end in batch.select("window.start", "window.end").collect():  # the weeks that close: a few
            week = spark.read.schema(L.LEDGER_SCHEMA + ", processed_date DATE").parquet(ledger_path).where(
                (F.col("processed_date") >= F.lit(start).cast("date")) & (F.col("processed_at") >= F.lit(start)) & (F.col("processed_at") < F.lit(end))
            )
            made = digest.rule_digest(digest.digest_input(week)).select(digest.render(F.col("digest")).alias("markdown"))
            digest.outbox(made, "markdown", "Markdown").write.mode("overwrite").parquet(f"{outbox_path}/week={start:%Y-%m-%d}")

    writer = closed.writeStream.outputMode("append").foreachBatch(emit).option("checkpointLocation", checkpoint)
    q = _trigger(writer, interval).start()
    if interval is None:
        q.awaitTermination()
