"""One poll of saved posts, end to end, as a batch job.

    raw JSON -> validate (quarantine) -> batch dedup -> anti-join ledger
    -> claim versions -> published check -> triage (validated; skip branch)
    -> enrichment joins -> analysis (rule model or a model fed with prompts)
    -> output validation -> page rows -> final ledger versions

No post is lost: fetched = skipped + already published + skipped by triage +
failed + completed.  A post without a valid triage or analysis gets a `failed`
version and is claimable in the next poll.  Model answers are stored once
(`stage`), so every later branch sees the same answer.

All writes go to the folder of their `batch_id` and replace it whole, so
re-running a batch replaces exactly what that batch wrote, also when an answer
changed or nothing is left to write.  Versions are `(batch_id + 1) << 40` plus
the step, above any earlier batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.functions import urls as U
from quire.functions.timefmt import iso
from quire.operators import enrich, inference, ingest, ledger, publish

Model = Callable[[DataFrame], DataFrame]

COUNTERS = ["fetched", "skipped", "quarantined", "failed", "triage_skipped", "already_published", "completed"]


@dataclass
class Stores:
    """Enrichment sources: stored pages (url, html), captions (video_id,
    vtt), image descriptions (url, description), optional labels and the
    published table (post_url)."""

    pages: DataFrame
    captions: DataFrame
    image_texts: DataFrame
    labels: DataFrame | None = None
    published: DataFrame | None = None
    members: DataFrame | None = None  # thread members (conversation_id, member_id, turn, text, valid)


def _versions(df: DataFrame, status: str, category, page_id, raw, at: dt.datetime, version: int) -> DataFrame:
    return df.select(
        F.col("id").alias("post_id"),
        F.lit(at).cast("timestamp").alias("processed_at"),
        category.alias("category"),
        page_id.cast("string").alias("page_id"),
        raw.alias("raw_data"),
        F.lit(status).alias("status"),
        F.lit(version).cast("bigint").alias("version"),
    )


def _post_struct() -> F.Column:
    return F.struct(
        F.col("id"), F.col("text"), F.col("author_username").alias("authorUsername"),
        F.col("author_name").alias("authorName"), iso("created_at").alias("createdAt"),
        F.col("urls"), F.col("images"), F.col("is_thread").alias("isThread"),
    )


def run_poll(
    spark: SparkSession,
    raw: DataFrame,
    stores: Stores,
    ledger_path: str,
    pages_path: str,
    batch_id: int,
    now: dt.datetime,
    limit: int | None = None,
    triage_model: Model | None = None,
    analysis_model: Model | None = None,
    enrich_fn: Callable[[DataFrame], DataFrame] | None = None,
    markdown: bool = False,
    image_model: Model | None = None,
) -> dict[str, int]:
    """Run one poll; returns the run counters.  They are observed by the jobs that read the
    posts, settle which are new, and write the versions, so no job only counts.

    `triage_model` maps posts to (id, triage); `analysis_model` maps prompts
    (id, prompt) to (id, output JSON).  Without them the rule models answer.
    `image_model` maps image URLs (url) to (url, output JSON) in place of stored image texts; an
    image without a valid answer gives no text.  With `markdown` articles are fetched as Markdown."""
    base = (batch_id + 1) << 40
    read, settled, wrote = Observation(), Observation(), Observation()
    posts, _ = ingest.ingest(raw, seen=read)
    if limit is not None:
        posts = ingest.newest(posts, limit)
    posts = ingest.first_of_batch(posts)
    if enrich_fn is not None:
        posts = posts.transform(enrich_fn)

    cur = ledger.current_for(_prior_versions(spark, ledger_path, batch_id), posts, columns=["status"])
    published = stores.published if stores.published is not None else spark.createDataFrame([], "post_url string")
    # staged, so the final write does not read the ledger
    flags = publish.split_published(ledger.blocked_flags(posts, cur), published)
    flagged = session.stage(
        flags.observe(settled, F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("blocked")).alias("skipped"))
    )
    new = flagged.where(~F.col("blocked")).drop("blocked")
    claims = _versions(new, "processing", F.lit("review"), F.lit(None), F.lit("{}"), now, base)
    tweet = new.select("id", _post_struct().alias("tweet"))
    known_rows = _versions(
        new.where("already_published").select("id").join(tweet, "id"), "completed", F.lit("review"), F.lit(None),
        F.to_json(F.struct("tweet", F.lit(True).alias("alreadyPublished"))), now, base + 1,
    )
    todo = new.where(~F.col("already_published")).drop("already_published")

    answers = triage_model(todo) if triage_model is not None else inference.rule_triage(todo, stores.labels)
    triage = session.stage(
        answers.where(inference.triage_reason(F.col("triage")).isNull()).join(todo.select("id"), "id", "left_semi")
    )
    skip = F.col("triage.estimatedValue") == "skip"
    skipped, live = triage.where(skip), triage.where(~skip)
    skip_rows = _versions(
        skipped.join(tweet, "id"), "completed", F.lit("review"), F.lit(None),
        F.to_json(F.struct("tweet", "triage", F.lit(True).alias("skipped"))), now, base + 1,
    )

    wanted_a = enrich.wanted_from_triage(live, "needsArticleScrape").where(U.is_scrapable("url"))
    arts = enrich.fetch_articles(wanted_a, stores.pages, markdown)
    wanted_v = enrich.wanted_from_triage(live, "needsYoutubeTranscript").withColumn("video_id", U.video_id("url"))
    trs = enrich.fetch_transcripts(wanted_v.where(F.col("video_id").isNotNull()), stores.captions)
    wanted_i = enrich.wanted_from_triage(live, "needsImageAnalysis")
    described = stores.image_texts if image_model is None else inference.describe_images(wanted_i, image_model)[0]
    imgs = enrich.fetch_image_texts(wanted_i, described)
    threads = None
    if stores.members is not None:
        wanted_t = todo.join(live.select("id", F.col("triage.needsThreadExpansion").alias("wants")), "id")
        threads = wanted_t.withColumn("is_thread", F.col("is_thread") | F.col("wants"))
    thread_counts = None if threads is None else enrich.thread_counts(threads, stores.members)
    counts = session.stage(enrich.context_summary(arts, trs, imgs, thread_counts))
    if analysis_model is None:
        outputs = inference.rule_analysis(todo, triage, counts, stores.labels).select("id", F.to_json("analysis").alias("output"))
    else:
        members = None if threads is None else enrich.expand_threads(threads, stores.members)
        prompts = inference.enriched_prompt(todo, live, arts, trs, imgs, members)
        outputs = analysis_model(prompts).select("id", "output").join(live.select("id"), "id", "left_semi")
    ok, _ = inference.validate_analysis(session.stage(outputs))
    ok = ok.select("id", "analysis")
    ok = session.stage(inference.merge_flags(ok, counts).join(ok, "id"))
    # whatever has no valid answer of either model fails, so no post stays claimed
    answered = skipped.select("id").unionByName(ok.select("id"))
    failed_rows = _versions(
        todo.select("id").join(answered, "id", "left_anti"), "failed", F.lit("review"), F.lit(None), F.lit("{}"), now, base + 1
    )
    publish.write_pages(publish.publish_rows(todo, ok, now), pages_path, batch_id)

    analysis = (
        F.col("analysis")
        .withField("hasArticle", F.col("has_article"))
        .withField("hasVideo", F.col("has_video"))
        .withField("hasThread", F.col("has_thread"))
        .withField("youtubeTranscript", F.col("youtube_transcript"))
        .withField("articleContent", F.col("article_content"))
        .withField("imageAnalysis", F.col("image_texts"))
    )
    done_rows = _versions(
        ok.join(tweet, "id").join(triage, "id"), "completed", F.col("analysis.category"), F.sha2(F.col("id"), 256),
        F.to_json(F.struct("tweet", "triage", analysis.alias("analysis"))), now, base + 1,
    )
    written = f"{ledger_path}/batch_id={batch_id}"
    batch = claims.unionByName(known_rows).unionByName(skip_rows).unionByName(failed_rows).unionByName(done_rows)
    completed = (F.col("version") == base + 1) & (F.col("status") == "completed")
    true_in = lambda key: F.coalesce(F.get_json_object("raw_data", f"$.{key}") == "true", F.lit(False))
    counted = batch.observe(
        wrote,
        F.count_if((F.col("version") == base + 1) & (F.col("status") == "failed")).alias("failed"),
        F.count_if(completed & true_in("skipped")).alias("triage_skipped"),
        F.count_if(completed & true_in("alreadyPublished")).alias("already_published"),
        F.count_if(completed & F.col("page_id").isNotNull()).alias("completed"),
    )
    counted.write.mode("overwrite").parquet(written)
    seen = {**settled.get, **read.get, **wrote.get}
    # a plan that Spark finds to be empty observes nothing
    return {k: seen.get(k) or 0 for k in COUNTERS}


def _prior_versions(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Ledger versions written before this batch (an earlier attempt of the
    same batch is ignored, so a retry sees the same ledger); empty when the
    ledger does not exist yet."""
    try:
        df = spark.read.schema(ledger.LEDGER_SCHEMA + ", batch_id BIGINT").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ledger.LEDGER_SCHEMA)
    return df.where(F.col("batch_id") != batch_id).drop("batch_id").withColumn(
        "status", F.coalesce("status", F.lit("completed"))
    )
