"""Plan policy: no pair-producing joins, no row-at-a-time Python, partial
aggregation under a hot key."""

import contextlib
import io
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from quire.operators import ledger  # noqa: E402
from quire.plans.catalog import QUERIES  # noqa: E402
from show_plans import summarise  # noqa: E402

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
FORBIDDEN = {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"}


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_no_row_udfs(spark, name):
    nodes = summarise(QUERIES[name](spark, SF))["nodes"]
    assert not (FORBIDDEN & set(nodes)), nodes
    if "MapInPandas" in nodes:
        assert name == "triage_model"


def test_hot_key_latest_version_is_partially_aggregated(spark):
    n = 30000
    versions = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("post_id"),
        F.current_timestamp().alias("processed_at"), F.lit("tool").alias("category"),
        F.lit(None).cast("string").alias("page_id"), F.lit("{}").alias("raw_data"),
        F.lit("completed").alias("status"), F.col("id").alias("version"),
    )
    cur = ledger.current(versions)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        cur.explain()
    assert "partial_max" in buf.getvalue()
    hot = cur.where(F.col("post_id") == "hot").first()
    assert hot["version"] == max(i for i in range(n) if i % 3 == 0)
    assert cur.count() == 1 + len([i for i in range(n) if i % 3 != 0])


@pytest.mark.parametrize("bound", [1 << 25, 0])
def test_current_for_meets_a_hot_key_before_the_shuffle(spark, monkeypatch, bound):
    from quire import session

    monkeypatch.setattr(session, "KEY_BYTES", bound)
    n = 9000
    versions = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("post_id"),
        F.lit("{}").alias("raw_data"), F.lit("completed").alias("status"), F.col("id").alias("version"),
    )
    posts = spark.createDataFrame([("hot",), ("1",), ("none",), (None,)], "id string")
    cur = ledger.current_for(versions, posts, columns=["status"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        cur.explain()
    plan = buf.getvalue()
    # bottom up, the versions are reduced before anything of theirs is shuffled
    assert "partial_max" in plan and "raw_data" not in plan
    assert ("BroadcastHashJoin" in plan) == (bound > 0)
    assert sorted((r["post_id"], r["version"]) for r in cur.collect()) == [("1", 1), ("hot", n - 3)]


def test_words_of_a_post_are_counted_within_its_row(spark):
    from quire.operators import inference

    posts = spark.createDataFrame(
        [("a", "Later apple later APPLE short zebra"), ("a", "zebra zebra"), ("b", "one two"), ("c", None), ("d", "élève Élève above")],
        "id string, text string",
    )
    tags = inference.word_tags(posts, k=3)
    assert {r["id"]: r["tags"] for r in tags.collect()} == {"a": ["zebra", "apple", "later"], "d": ["élève", "above"]}
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        tags.explain("formatted")
    # posts are grouped as wholes: no rows for (post, word), neither counted, sorted nor shuffled
    assert "Window" not in buf.getvalue() and "count(1)" not in buf.getvalue()
    keys = [line for line in buf.getvalue().splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert keys and not any("word" in line for line in keys), keys
