"""End-to-end poll job, sinks, migration and small helpers."""

import datetime as dt
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import enrich, inference, ingest, ledger, publish
from quire.plans import poll
from quire.sources import fixtures as fx
from quire.sources.tables import read

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 2, 1)


def stores(spark):
    return poll.Stores(
        pages=read(spark, SF, "pages"),
        captions=fx.transcripts(spark, SF),
        image_texts=fx.image_texts(spark, SF),
        labels=read(spark, SF, "labels"),
        published=fx.published(spark, SF),
    )


def test_poll_end_to_end_idempotent(spark, tmp_path):
    raw = fx.raw_posts_pages(spark, SF)
    lp, pp = str(tmp_path / "ledger"), str(tmp_path / "pages")
    m0 = poll.run_poll(spark, raw, stores(spark), lp, pp, batch_id=0, now=NOW)
    assert m0["skipped"] == 0 and m0["fetched"] > 0
    assert m0["triage_skipped"] + m0["already_published"] + m0["failed"] + m0["completed"] == m0["fetched"]
    cur = ledger.current(ledger.read_ledger(spark, lp))
    st = {r["status"] for r in cur.collect()}
    assert st <= {"completed", "failed"} and "completed" in st
    n_pages = spark.read.parquet(pp).count()
    # retrying batch 0 rewrites the same partitions: same ledger, same pages
    m0b = poll.run_poll(spark, raw, stores(spark), lp, pp, batch_id=0, now=NOW)
    assert m0b == m0
    assert spark.read.parquet(pp).count() == n_pages
    # the next poll sees everything completed (nothing failed in the rule model)
    m1 = poll.run_poll(spark, raw, stores(spark), lp, pp, batch_id=1, now=NOW)
    assert m1["skipped"] == m0["completed"] + m0["triage_skipped"] + m0["already_published"]
    # the digest statistics read the ledger the poll wrote
    from quire.operators import stats
    rep = stats.weekly_report(ledger.read_ledger(spark, lp), as_of=NOW).first()
    assert rep["total_processed"] > 0 and json.loads(rep["top_tags"])


def test_poll_with_threads(spark, tmp_path):
    members = fx.conversation_members(spark, SF)
    st = poll.Stores(pages=read(spark, SF, "pages"), captions=fx.transcripts(spark, SF),
                     image_texts=fx.image_texts(spark, SF), members=members)
    raw = fx.raw_posts_conversations(spark, SF).select("raw")
    lp, pp = str(tmp_path / "ledger"), str(tmp_path / "pages")
    m = poll.run_poll(spark, raw, st, lp, pp, batch_id=0, now=NOW)
    assert m["completed"] > 0
    review = [r for r in ledger.read_ledger(spark, lp).collect() if r["status"] == "completed" and r["category"] == "review"]
    assert review  # thread replies are analysed as threads


def test_ledger_migration_and_create(spark, tmp_path):
    old = tmp_path / "old"
    spark.createDataFrame([("1", NOW, "tool", None, "{}", 1)],
                          "post_id string, processed_at timestamp, category string, page_id string, raw_data string, version bigint"
                          ).write.parquet(str(old))
    assert ledger.read_ledger(spark, str(old)).first()["status"] == "completed"
    ledger.create_ledger(spark, "ledger_t", str(tmp_path / "lt"))
    ledger.create_ledger(spark, "ledger_t", str(tmp_path / "lt"))
    assert spark.catalog.tableExists("ledger_t")
    assert publish.ensure_published_table(spark, "pages_t", str(tmp_path / "pt")) is False
    assert publish.ensure_published_table(spark, "pages_t", str(tmp_path / "pt")) is True
    spark.sql("DROP TABLE ledger_t")
    spark.sql("DROP TABLE pages_t")


def test_page_sink_overwrites_own_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "tool"), ("b", "article")], "page_id string, category string")
    p = str(tmp_path / "pages")
    publish.write_pages(rows, p, 0)
    publish.write_pages(rows, p, 1)
    publish.write_pages(rows, p, 0)
    assert spark.read.parquet(p).count() == 4
    # a retry with a changed category leaves no second page, an empty one none
    publish.write_pages(rows.withColumn("category", F.lit("fun")), p, 0)
    assert spark.read.parquet(p).count() == 4
    publish.write_pages(rows.limit(0), p, 0)
    assert spark.read.parquet(p).count() == 2


def test_poll_stores_the_whole_answer_and_loses_no_post(spark, tmp_path):
    from quire.plans.catalog import _faulty_analysis, _faulty_triage

    raw = fx.raw_posts_pages(spark, SF)
    lp, pp = str(tmp_path / "ledger"), str(tmp_path / "pages")
    m = poll.run_poll(spark, raw, stores(spark), lp, pp, 0, NOW,
                      triage_model=_faulty_triage(read(spark, SF, "labels")), analysis_model=_faulty_analysis)
    assert m["failed"] > 0 and m["already_published"] > 0
    assert m["triage_skipped"] + m["already_published"] + m["failed"] + m["completed"] == m["fetched"]
    cur = ledger.current(ledger.read_ledger(spark, lp)).collect()
    assert len(cur) == m["fetched"] and "processing" not in {r["status"] for r in cur}
    done = [json.loads(r["raw_data"])["analysis"] for r in cur if r["page_id"]]
    assert all(("articleContent" in a) == a["hasArticle"] and "imageAnalysis" in a for a in done)
    assert max(len(a.get("articleContent", "")) for a in done) > 0
    assert any(a["imageAnalysis"] for a in done)


def test_thread_counts_equal_expanded_members(spark):
    members, marks = fx.conversation_members(spark, SF), fx.conversation_bookmarks(spark, SF)
    want = {r["post_id"]: r["count"] for r in enrich.expand_threads(marks, members).groupBy("post_id").count().collect()}
    got = {r["post_id"]: r["n"] for r in enrich.thread_counts(marks, members).collect() if r["n"]}
    assert got == want and want


def test_first_of_batch(spark):
    rows = [("1", NOW, "old"), ("1", NOW + dt.timedelta(1), "new"), ("2", None, "x"), ("2", None, "x")]
    posts = spark.createDataFrame(rows, "id string, created_at timestamp, text string")
    assert sorted((r["id"], r["text"]) for r in ingest.first_of_batch(posts).collect()) == [("1", "new"), ("2", "x")]


def test_triage_validation(spark):
    good = {"needsArticleScrape": [{"url": "u", "reason": "r", "priority": "high"}], "needsYoutubeTranscript": [],
            "needsImageAnalysis": [], "needsThreadExpansion": False, "contentType": "tweet", "estimatedValue": "low"}
    bad_value = dict(good, estimatedValue="maybe")
    bad_prio = dict(good, needsArticleScrape=[{"url": "u", "reason": "r", "priority": "urgent"}])
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad_value)), (3, json.dumps(bad_prio)), (4, "{x")],
                               "id int, output string")
    ok, bad = inference.validate_triage(df)
    assert [r["id"] for r in ok.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "estimatedValue", 3: "needsArticleScrape", 4: "malformed_json"}


def test_legacy_context_and_text_fallback(spark):
    posts = spark.createDataFrame(
        [("1", "art", "", ["d1", "d2"], ["t2", "t3"], "u", "U", "post")],
        "id string, article_content string, youtube_transcript string, image_descriptions array<string>, "
        "thread array<string>, author_username string, author_name string, text string",
    )
    triage, arts, trs, imgs, threads = inference.legacy_context(posts)
    assert [tuple(r) for r in threads.select("post_id", "turn", "text").collect()] == [("1", 0, "t2"), ("1", 1, "t3")]
    assert inference.legacy_context(posts.drop("thread"))[4].count() == 0
    prompt = inference.enriched_prompt(posts, triage, arts, trs, imgs, threads).first()["prompt"]
    assert "(2 more tweets)\n[2] t2\n\n[3] t3" in prompt and "### \nart" in prompt
    assert arts.count() == 1 and trs.count() == 0 and imgs.count() == 2
    assert triage.first()["triage"]["estimatedValue"] == "medium"
    df = spark.createDataFrame([(None, None, "full"), (None, "note", "full"), ("art", "note", "full")], "a string, n string, f string")
    assert [r[0] for r in df.select(ingest.post_text(F.col("a"), F.col("n"), F.col("f"))).collect()] == ["full", "note", "art"]


def test_first_per_id_and_model_adapter(spark):
    posts = spark.createDataFrame([("1", 2), ("1", 1), ("2", 5)], "id string, pos int")
    assert sorted(tuple(r) for r in ingest.first_per_id(posts, "pos").collect()) == [("1", 1), ("2", 5)]

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "label": ["x"] * len(batch)})

    out = inference.run_model(posts, model, "id string, label string")
    assert out.count() == 3 and {r["label"] for r in out.collect()} == {"x"}


def test_poll_without_posts_counts_nothing(spark, tmp_path):
    raw = spark.createDataFrame([], "raw string")
    m = poll.run_poll(spark, raw, stores(spark), str(tmp_path / "l"), str(tmp_path / "p"), batch_id=0, now=NOW)
    assert m == dict.fromkeys(poll.COUNTERS, 0)


def test_tables_over_the_jobs_folders_follow_a_changed_batch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    row = lambda post, status, version: (post, NOW, "tool", None, "{}", status, version)
    write = lambda rows, batch: spark.createDataFrame(rows, ledger.LEDGER_SCHEMA).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")
    write([row("1", "processing", 1), row("2", "failed", 2)], 0)
    ledger.create_ledger(spark, "ledger_folders", path)
    ledger.add_batches(spark, "ledger_folders")
    write([row("1", "completed", 3)], 1)
    ledger.add_batches(spark, "ledger_folders")
    latest = lambda: {r["post_id"]: r["status"] for r in ledger.current(spark.table("ledger_folders"), ["status"]).collect()}
    assert latest() == {"1": "completed", "2": "failed"}
    write([row("1", "failed", 3)], 1)
    spark.catalog.refreshTable("ledger_folders")
    assert latest() == {"1": "failed", "2": "failed"}
    spark.sql("DROP TABLE ledger_folders")


def test_rule_analysis_keeps_all_sentences_and_the_page_cuts_them(spark):
    from quire.operators import inference

    posts, _, analyses = _ruled(spark, "One. " * 4 + "Two words. " * 3 + "alpha1 bravo charlie delta echoes foxtrot golfer hotels indigo juliet kilos")
    a = analyses.first()["analysis"]
    assert len(a["keyInsights"]) == 8 and a["keyInsights"][0] == "One."
    assert len(a["tags"]) == 9
    flags = inference.merge_flags(analyses, spark.createDataFrame([], "id string, n_articles long, n_transcripts long, n_images long, n_thread long, first_title string, first_article string, first_transcript string, image_texts array<string>"))
    ok = analyses.join(flags, "id")
    assert len(publish.publish_rows(posts, ok, NOW).first()["tags"]) == 7
    assert publish.page_blocks(posts, ok).where("block_type = 'bulleted_list_item'").count() == 5


def _ruled(spark, text):
    from quire.operators import inference

    posts = fx.posts_pages(spark, SF).limit(1).withColumn("text", F.lit(text)).withColumn("urls", F.array().cast("array<string>"))
    posts = spark.createDataFrame(posts.collect(), posts.schema)
    triage = inference.legacy_context(posts.select("id", F.lit("").alias("article_content"), F.lit("").alias("youtube_transcript"), F.lit(None).cast("array<string>").alias("image_descriptions")))[0]
    counts = spark.createDataFrame([], "id string, n_articles long, n_transcripts long, n_images long, n_thread long, first_title string, first_article string, first_transcript string, image_texts array<string>")
    return posts, triage, inference.rule_analysis(posts, triage, counts)
