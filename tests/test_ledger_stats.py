"""Ledger and weekly statistics golden cases (FIXTURES.md 15-19, 28) and
properties of the versioned ledger."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quire.operators import ledger as L
from quire.operators import stats

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = "post_id string, processed_at timestamp, category string, page_id string, raw_data string, status string, version bigint"


def raw(summary, tags, score):
    return json.dumps({"analysis": {"summary": summary, "tags": tags, "relevanceScore": score}})


def ledger(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_same_id_twice_latest_wins(spark):
    v = ledger(spark, [
        ("1", NOW, "tool", None, raw("a", [], 5), "completed", 1),
        ("1", NOW, "article", None, raw("b", [], 5), "completed", 2),
    ])
    cur = L.current(v)
    assert cur.count() == 1
    assert cur.first()["category"] == "article"
    cats = {r["category"]: r["n"] for r in stats.by_category(cur).collect()}
    assert cats == {"article": 1}


def test_weekly_golden(spark):
    v = ledger(spark, [
        ("1", NOW, "tool", None, raw("Great AI tool", ["ai", "dev"], 9), "completed", 1),
        ("2", NOW - dt.timedelta(hours=1), "tool", None, raw("x", ["ai", "ml"], 7), "completed", 2),
        ("3", NOW - dt.timedelta(hours=2), "article", None, raw("y", ["typescript"], 6), "completed", 3),
        ("4", NOW - dt.timedelta(days=14), "article", None, raw("old", ["ai"], 9), "completed", 4),
    ])
    rep = stats.weekly_report(v, as_of=NOW).first()
    assert rep["total_processed"] == 3
    assert json.loads(rep["by_category"]) == {"article": 1, "tool": 2}
    assert json.loads(rep["top_tags"])[0] == {"tag": "ai", "count": 2}
    hl = json.loads(rep["highlights"])
    assert [h["summary"] for h in hl] == ["Great AI tool"]


def test_malformed_json_still_counted(spark):
    v = ledger(spark, [
        ("1", NOW, "tool", None, "not valid json", "completed", 1),
        ("2", NOW, "tool", None, raw("s", ["one"], 3), "completed", 2),
    ])
    rep = stats.weekly_report(v, as_of=NOW).first()
    assert rep["total_processed"] == 2
    assert json.loads(rep["top_tags"]) == [{"tag": "one", "count": 1}]


def test_highlights_threshold_and_string_score(spark):
    v = ledger(spark, [(str(i), NOW - dt.timedelta(minutes=i), "tool", None, raw(f"s{i}", [], s), "completed", i)
                       for i, s in enumerate([5, 6, 7, 8, 9])])
    assert stats.highlights(stats.week_slice(v, NOW)).count() == 2
    v2 = ledger(spark, [("9", NOW, "tool", None, '{"analysis":{"relevanceScore":"9","summary":"s"}}', "completed", 1)])
    assert stats.highlights(stats.week_slice(v2, NOW)).count() == 1


def test_top_tag_ties_follow_newest_first_scan(spark):
    v = ledger(spark, [
        ("1", NOW - dt.timedelta(hours=1), "tool", None, raw("a", ["old"], 1), "completed", 1),
        ("2", NOW, "tool", None, raw("b", ["new", "newer"], 1), "completed", 2),
    ])
    tags = [r["tag"] for r in stats.top_tags(v).orderBy("rank").collect()]
    assert tags == ["new", "newer", "old"]


def test_claimable_states(spark):
    v = ledger(spark, [
        ("failed", NOW, "review", None, "{}", "failed", 1),
        ("processing", NOW, "review", None, "{}", "processing", 1),
        ("completed", NOW, "review", None, "{}", "completed", 1),
        ("null", NOW, "review", None, "{}", None, 1),
    ])
    posts = spark.createDataFrame([(k,) for k in ["absent", "failed", "processing", "completed", "null"]], "id string")
    got = sorted(r["id"] for r in L.new_posts(posts, L.current(v)).collect())
    assert got == ["absent", "failed"]
    claims = L.claim(posts, L.current(v), NOW, version=99)
    assert {r["status"] for r in claims.collect()} == {"processing"}


def test_upsert_idempotent_and_claims_partition(spark):
    base = ledger(spark, [(str(i), NOW, "tool", None, "{}", "completed" if i % 2 else "failed", i) for i in range(20)])
    changes = ledger(spark, [(str(i), NOW, "article", None, "{}", "completed", 100 + i) for i in range(0, 20, 3)])
    once = L.upsert(base, changes)
    twice = L.upsert(once, changes)
    assert sorted(once.collect()) == sorted(twice.collect())
    posts = spark.createDataFrame([(str(i),) for i in range(30)], "id string")
    cur = L.current(base)
    claimed = {r["id"] for r in L.new_posts(posts, cur).collect()}
    blocked = {r["post_id"] for r in L.blocked(cur).collect()}
    assert claimed | blocked == {str(i) for i in range(30)} and not (claimed & blocked)


def test_release_sets_status(spark):
    cur = L.current(ledger(spark, [("a", NOW, "t", None, "{}", "processing", 1), ("b", NOW, "t", None, "{}", "completed", 1)]))
    out = {r["post_id"]: r["status"] for r in L.release(cur, L.locked(cur)).collect()}
    assert out == {"a": "failed", "b": "completed"}
