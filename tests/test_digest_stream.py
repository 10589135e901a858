"""Digest rendering (FIXTURES.md 31) and stream-equals-batch checks."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators import digest, stats
from quire.streaming import jobs as S

SCHEMA = "post_id string, processed_at timestamp, category string, page_id string, raw_data string, status string, version bigint"


def test_empty_week_gives_no_digest_and_title_survives(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digest.digest_input(empty).count() == 0
    d = spark.createDataFrame([("x", [], [], [])], "digest string, patterns array<string>, recommendations array<string>, "
                              "topPicks array<struct<summary:string,why:string>>")
    md = d.select(digest.render(F.struct(*d.columns)).alias("m")).first()["m"]
    assert md.startswith("# 📚 Weekly Bookmark Digest") and md.endswith("x")


def test_outbox_pieces(spark):
    msgs = spark.createDataFrame([("m1", "Line\n" * 1000)], "id string, body string")
    out = digest.outbox(msgs, "body", "Markdown").orderBy("seq").collect()
    assert [len(r["text"]) for r in out] == [3999, 1000] and out[0]["parse_mode"] == "Markdown"


def test_weekly_stream_over_many_files_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    src = tmp_path / "events"
    rows = [(i, start + dt.timedelta(hours=7 * i), i % 13, ["view", "click", "error"][i % 3], 1.0, '{"k": %d}' % (i % 100))
            for i in range(300)]
    # one file per day, written in time order (the source takes files by age)
    for day in range(0, 300 * 7 // 24 + 1, 3):
        part = [r for r in rows if day * 24 <= r[0] * 7 < (day + 3) * 24]
        if part:
            spark.createDataFrame(part, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    from quire.sources import fixtures as fx

    out = str(tmp_path / "out")
    ev = S.read_stream(spark, str(src), S.EVENT_SCHEMA, max_files=2)
    S.weekly_windows(fx.ledger_rows_of(ev), out, out + "-ckpt")
    streamed = {(r["window_start"], r["category"]): r["n"] for r in S.window_totals(spark, out).collect()}
    batch_rows = fx.ledger_rows_of(spark.read.parquet(str(src)))
    batch = (batch_rows.groupBy(F.window("processed_at", "7 days"), "category").count()
             .select(F.col("window.start").alias("ws"), "category", "count").collect())
    assert streamed == {(r["ws"], r["category"]): r["count"] for r in batch}
    assert len(spark.read.parquet(out).select("batch_id").distinct().collect()) > 1


def test_outbox_loses_no_text(spark):
    from quire.operators import digest

    texts = ["x" * 5000, "", "a\n" + "y" * 9000 + "\nb", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = digest.outbox(df, "text", "HTML").collect()
    assert all(r["text"] and len(r["text"]) <= 4096 for r in rows)
    for i, t in enumerate(texts):
        mine = sorted((r["seq"], r["text"]) for r in rows if r["id"] == i)
        assert "".join(x for _, x in mine).replace("\n", "") == (t or "").replace("\n", "")
        assert [n for n, _ in mine] == list(range(len(mine)))


def test_stream_takes_up_failed_rows_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    t = dt.datetime(2024, 1, 1)
    old = [("f", t, "review", None, "{}", "failed", 5), ("g", t, "review", None, "{}", "failed", 1),
           ("g", t, "review", None, "{}", "completed", 2), ("p", t, "review", None, "{}", "processing", 1)]
    spark.createDataFrame(old, SCHEMA).write.parquet(ledger + "/batch_id=-1")
    src = str(tmp_path / "in")
    for ids in (["a", "p", "a"], ["a", "b", "g"], ["f", "c"]):
        spark.createDataFrame([(i, t) for i in ids], "id string, created_at timestamp").coalesce(1).write.mode("append").parquet(src)
    posts = S.read_stream(spark, src, "id string, created_at timestamp", max_files=1)
    S.claim_stream(spark, posts, ledger, str(tmp_path / "ckpt"), retry_failed=True)
    got = spark.read.parquet(ledger).where("batch_id >= 0").collect()
    assert sorted(r["post_id"] for r in got) == ["a", "b", "c", "f"]
    assert {r["status"] for r in got} == {"processing"}
    assert {r["batch_id"] for r in got if r["post_id"] == "f"} == {0}
