"""Bucketed ledger, key filters and spread conversations: where rows move."""

import contextlib
import io
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.operators import enrich, keyfilter, ledger


def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def above_scan(plan, location):
    """The operators over the scan of a table, from the scan up."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and location in x)
    depth, out = len(re.match(r"[\s:+\-*()\d]*", lines[at])[0]), []
    for line in reversed(lines[:at]):
        mark = len(re.match(r"[\s:+\-*()\d]*", line)[0])
        if mark < depth and line.strip():
            depth = mark
            out.append(line.strip(" :+-*()0123456789"))
    return out


VERSIONS = "post_id string, processed_at timestamp, category string, page_id string, status string, version bigint"


def test_no_exchange_above_a_bucketed_ledger(spark, tmp_path):
    name, path = "ledger_" + uuid.uuid4().hex[:8], str(tmp_path / "ledger")
    first = [(str(i % 50), None, "tool", None, "completed", i) for i in range(200)]
    ledger.append_bucketed(spark.createDataFrame(first, VERSIONS), name, path, 4)
    later = [(str(i), None, "tool", None, "failed", 1000 + i) for i in range(10)]
    ledger.append_bucketed(spark.createDataFrame(later, VERSIONS), name, path, 4)
    posts = spark.createDataFrame([(str(i),) for i in range(60)], "id string")
    cur = ledger.current(spark.table(name), ["status"])
    new = ledger.new_posts(posts, cur)
    plan = plan_of(new)
    up = above_scan(plan, "ledger")
    assert "Aggregate" in plan and any("Join" in x for x in up)
    assert not any(x.startswith("Exchange") for x in up[: next(i for i, x in enumerate(up) if "Join" in x)]), plan
    assert sorted(int(r["id"]) for r in new.collect()) == [*range(10), *range(50, 60)]
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("bound", [1 << 25, 0])
def test_wanted_rows_with_either_key_set(spark, monkeypatch, bound):
    monkeypatch.setattr(session, "KEY_BYTES", bound)
    heavy = spark.range(20_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("x" * 50).alias("html"))
    wanted = heavy.where("substring(url, 2) % 10 = 0").select("url").unionByName(spark.createDataFrame([("u-1",), (None,), ("u0",)], "url string"))
    got = keyfilter.wanted_rows(heavy, wanted, "url")
    assert got.count() == 2000 and got.where("substring(url, 2) % 10 <> 0").isEmpty()
    plan = plan_of(got)
    assert ("bit_or" in plan) == (bound == 0)


def test_the_filter_lets_few_other_rows_through(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("url"))
    blocks = max(1, -(-3000 * keyfilter.BITS_PER_KEY // 512))
    made = keyfilter.key_filter(keys, blocks)
    heavy = spark.range(60_000).select(F.col("id").cast("string").alias("url"))
    passed = keyfilter.may_hold(heavy, "url", made, blocks)
    assert passed.where("cast(url as int) < 3000").count() == 3000
    assert passed.count() < 3000 * 1.05 + 57_000 * 0.005
    assert "BroadcastHashJoin" in plan_of(passed)


def test_pages_shuffled_for_a_large_key_set_are_the_wanted_ones(spark, monkeypatch):
    """With no broadcast of keys, what reaches the exchange of HTML."""
    monkeypatch.setattr(session, "KEY_BYTES", 0)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html")
    wanted = pages.where("length(url) % 3 = 0").select("url")
    got = keyfilter.wanted_rows(pages, wanted, "url")
    n = wanted.distinct().count()
    keys = wanted.distinct()
    blocks = max(1, -(-n * keyfilter.BITS_PER_KEY // 512))
    passed = keyfilter.may_hold(pages, "url", keyfilter.key_filter(keys, blocks), blocks)
    assert n <= passed.count() <= 1.05 * n + 1
    assert got.count() == pages.join(keys, "url", "left_semi").count()


def test_a_hot_conversation_spreads_over_many_tasks(spark):
    n = 3000
    members = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("conversation_id"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("member_id"), F.col("id").cast("int").alias("turn"),
        F.lit("t").alias("text"), (F.col("id") != 1).alias("valid"),
    )
    marks = spark.createDataFrame([("m0", "hot", True), ("m3", "hot", True), ("m4", "c4", True), ("m1", "c1", True), ("x", "hot", False)], "id string, conversation_id string, is_thread boolean")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = enrich.expand_threads(marks, members, hot=500)
        rows = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plain = enrich.expand_threads(marks, members, hot=n).collect()
    shown = lambda rs: sorted((r["post_id"], r["member_id"], r["turn"]) for r in rs)
    assert shown(rows) == shown(plain) and len(rows) > 1990
    assert not any(r["conversation_id"] == "c1" for r in rows)  # one bad member loses the thread
    tasks = {}
    for r in rows:
        if r["conversation_id"] == "hot":
            tasks[r["task"]] = tasks.get(r["task"], 0) + 1
    assert len(tasks) >= 16 and max(tasks.values()) < 500
