"""Bounded dedup, watermarked weeks, weekly digests and the two-sink ingest."""

import datetime as dt

from pyspark.sql import functions as F

from quire.sources import fixtures as fx
from quire.streaming import jobs as S

T0 = dt.datetime(2024, 1, 4)  # a window starts here (weeks are counted from 1970-01-01)
SAVED = "id string, created_at timestamp"
LEDGER = "post_id string, processed_at timestamp, category string, page_id string, raw_data string, status string, version bigint"


def hour(n):
    return T0 + dt.timedelta(hours=n)


def add_file(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_repeats_within_the_delay_are_dropped_and_state_is_bounded(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", hour(0)), ("b", hour(0))], [("a", hour(1))], [("c", hour(50))], [("d", hour(51))], [("a", hour(52)), ("c", hour(52))], [("late", hour(1))]]
    for rows in batches:
        add_file(spark, rows, SAVED, src)
    saved = S.first_within(S.read_stream(spark, src, SAVED, max_files=1), "2 hours")
    q = saved.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["id"], r["created_at"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", hour(0)), ("a", hour(52)), ("b", hour(0)), ("c", hour(50)), ("d", hour(51))]
    # what the watermark has passed is forgotten
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_claims_with_bounded_dedup_happen_once_over_a_restart(spark, tmp_path):
    ledger, src, ckpt = str(tmp_path / "ledger"), str(tmp_path / "in"), str(tmp_path / "ckpt")
    spark.createDataFrame([("old", hour(0), "review", None, "{}", "completed", 1)], LEDGER).write.parquet(ledger + "/batch_id=-1")
    add_file(spark, [("a", hour(0)), ("old", hour(0))], SAVED, src)
    add_file(spark, [("a", hour(1)), ("b", hour(1))], SAVED, src)

    def run():
        S.claim_stream(spark, S.read_stream(spark, src, SAVED, max_files=1), ledger, ckpt, dedup_within="2 hours")
        rows = spark.read.parquet(ledger).where("batch_id >= 0").collect()
        return sorted(r["post_id"] for r in rows)

    assert run() == ["a", "b"]
    assert run() == ["a", "b"]  # nothing new
    add_file(spark, [("a", hour(2)), ("b", hour(90)), ("c", hour(90))], SAVED, src)
    assert run() == ["a", "b", "c"]  # b comes again long after: the ledger stops it


def test_closed_weeks_equal_the_batch_and_late_rows_are_counted(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "processed_at timestamp, category string"
    batches = [
        [(hour(1), "x"), (hour(100), "y")],
        [(hour(7 * 24 + 1), "x"), (hour(2), "x")],  # hour 2 is older, but its week is open
        [(hour(9 * 24 + 2), "x"), (hour(3), "y")],  # the watermark passes the week's end after this batch
        [(hour(10 * 24), "x")],
        [(hour(4), "x"), (hour(10 * 24), "y")],  # too late
        [(hour(30 * 24), "x")],
    ]
    for rows in batches:
        add_file(spark, rows, schema, src)
    rows = S.read_stream(spark, src, schema, max_files=1)

    def run():
        S.weekly_closed(rows, out, out + "-ckpt", "2 days")
        S.late_counts(spark, rows, out + "-late", out + "-late-ckpt", "2 days")
        closed = {(r["window_start"], r["category"]): r["n"] for r in spark.read.parquet(out).collect()}
        late = {(r["window_start"], r["category"]): r["n"] for r in spark.read.parquet(out + "-late/late").collect()}
        return closed, late, spark.read.parquet(out).count()

    first = run()
    assert first == ({(T0, "x"): 2, (T0, "y"): 2, (hour(168), "x"): 3, (hour(168), "y"): 1}, {(T0, "x"): 1}, 4)
    assert run() == first
    total = sum(len(b) for b in batches)
    assert sum(first[0].values()) + sum(first[1].values()) == total - 1  # the last week is still open


def test_every_closed_week_is_sent_once(spark, tmp_path):
    src, ledger, outbox = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "outbox")

    def events(first, last):
        return [(i, hour(i), i % 7, "view", 1.0, '{"k": %d}' % (i % 100)) for i in range(first, last)]

    def run():
        S.ingest_to_ledger(fx.ledger_rows_of(S.read_stream(spark, src, S.EVENT_SCHEMA, max_files=1)), ledger, ledger + "-ckpt")
        S.weekly_digests(spark, ledger, outbox, outbox + "-ckpt", "1 day", max_files=5)
        return {r["week"]: r["text"] for r in spark.read.schema("seq bigint, text string, week string").parquet(outbox).where("seq = 0").collect()}

    add_file(spark, events(0, 200), S.EVENT_SCHEMA, src)
    one = run()
    assert sorted(one) == ["2024-01-04"] and "168 posts saved this week" in one["2024-01-04"]
    assert run() == one
    add_file(spark, events(200, 3 * 168 + 30), S.EVENT_SCHEMA, src)
    three = run()
    assert sorted(three) == ["2024-01-04", "2024-01-11", "2024-01-18"]
    assert three["2024-01-04"] == one["2024-01-04"]
    assert run() == three
    assert spark.read.parquet(outbox).groupBy("week", "seq").count().where("count > 1").isEmpty()


def test_two_sink_ingest_loses_nothing_and_replays_replace(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    good = '{"id": "%d", "text": "t", "createdAt": "2024-01-01T00:00:00.000Z", "author": {"username": "u", "name": "n"}}'
    for k in range(3):
        spark.createDataFrame([(good % k,), ("{",), ("[]",), (None,)], "value string").coalesce(1).write.mode("append").text(src)
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(src).withColumnRenamed("value", "raw")
    S.ingest_stream(raw, out, out + "-ckpt")
    S.ingest_stream(raw, out, out + "-ckpt")
    posts, bad = spark.read.parquet(out + "/posts"), spark.read.parquet(out + "/quarantine")
    assert sorted(r["id"] for r in posts.collect()) == ["0", "1", "2"]
    assert bad.count() == 9 and {r["batch_id"] for r in bad.collect()} == {0, 1, 2}
    assert {r["reason"] for r in bad.collect()} == {"malformed_json", "not_object"}


def test_slices_arrive_in_order(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("x%d" % i, hour(i * i)) for i in range(30)]
    S.as_slices(spark.createDataFrame(rows, SAVED), path, "created_at", 4)
    seen = []
    q = (S.read_stream(spark, path, SAVED, max_files=1).writeStream
         .foreachBatch(lambda b, i: seen.append(b.agg(F.min("created_at"), F.max("created_at")).first()))
         .option("checkpointLocation", path + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
