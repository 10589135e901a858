"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the given tables through the fixture views and runs one
operator (or a short chain) of the library over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.functions import fixed
from quire.functions import text as T
from quire.functions import urls as U
from quire.functions.text import extract_handles
from quire.functions.transcript import chunk_lines, clean_vtt
from quire.functions.timefmt import iso
from quire.plans import poll
from quire.operators import alerts, digest, enrich, inference, ingest, ledger, publish, stats
from quire.sources import fixtures as fx
from quire.streaming import jobs as S
from quire.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.pin(spark)
        return fn(spark, sf_dir)

    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = wrapped
    return wrapped


# --- step 1: statistics -----------------------------------------------------------


@query
def weekly_by_category(spark, sf_dir):
    return stats.by_category(stats.week_slice(fx.ledger_rows(spark, sf_dir)))


@query
def weekly_top_tags(spark, sf_dir):
    return stats.top_tags(stats.week_slice(fx.ledger_rows(spark, sf_dir)))


@query
def weekly_highlights(spark, sf_dir):
    return stats.highlights(stats.week_slice(fx.ledger_rows(spark, sf_dir)))


@query
def weekly_report(spark, sf_dir):
    return stats.weekly_report(fx.ledger_rows(spark, sf_dir))


@query
def ledger_stats(spark, sf_dir):
    return stats.lifetime_stats(fx.ledger_rows(spark, sf_dir))


@query
def ledger_health(spark, sf_dir):
    return stats.health(fx.ledger_rows(spark, sf_dir))


# --- step 2: ledger ---------------------------------------------------------------


SHOWN = ["processed_at", "category", "status", "page_id"]


def _ledger_out(df: DataFrame) -> DataFrame:
    return df.select(
        "post_id", "version", iso("processed_at").alias("processed_at"), "category", "status", "page_id"
    )


@query
def ledger_current(spark, sf_dir):
    return _ledger_out(ledger.current(fx.ledger_versions(spark, sf_dir), SHOWN))


@query
def ledger_upsert(spark, sf_dir):
    """Older history compacted to its latest rows, then the last week's
    versions applied on top: equal to the latest over all versions."""
    versions = fx.ledger_versions(spark, sf_dir)
    cutoff = stats.latest_time(versions) - dt.timedelta(days=7)
    base = ledger.current(versions.where(F.col("processed_at") < F.lit(cutoff)), SHOWN)
    changes = versions.where(F.col("processed_at") >= F.lit(cutoff))
    return _ledger_out(ledger.upsert(base, changes))


@query
def ledger_release(spark, sf_dir):
    """Stuck claims (status processing) released to failed."""
    cur = ledger.current(fx.ledger_versions(spark, sf_dir), ["status"])
    return ledger.release(cur, ledger.locked(cur)).select("post_id", "version", "status")


@query
def new_posts(spark, sf_dir):
    """Posts of the batch not blocked by the ledger; only the batch's keys
    are aggregated (semi-join before latest-by-key)."""
    posts = fx.posts_pages(spark, sf_dir)
    cur = ledger.current_for(fx.ledger_versions(spark, sf_dir), posts, columns=["status"])
    return ledger.new_posts(posts, cur).select("id", "author_username")


@query
def claimable_posts(spark, sf_dir):
    versions = fx.ledger_versions(spark, sf_dir)
    cur = ledger.current(versions, ["status"])
    at = stats.latest_time(versions)
    claims = ledger.claim(fx.posts_pages(spark, sf_dir), cur, at, version=1 << 40)
    return _ledger_out(claims).withColumn("raw_data", F.lit("{}"))


@query
def processed_posts(spark, sf_dir):
    cur = ledger.current(fx.ledger_versions(spark, sf_dir), ["status"])
    keys = ledger.processed(cur).withColumnRenamed("post_id", "id")
    return fx.posts_pages(spark, sf_dir).join(keys, "id", "left_semi").select("id")


@query
def locked_posts(spark, sf_dir):
    return ledger.locked(ledger.current(fx.ledger_versions(spark, sf_dir), ["status"]))


# --- step 3: ingest ---------------------------------------------------------------


def _post_out(posts: DataFrame) -> DataFrame:
    return posts.select(
        "id",
        "author_username",
        "author_name",
        iso("created_at").alias("created_at"),
        F.size("urls").cast("bigint").alias("n_urls"),
        F.array_join("urls", " ").alias("urls"),
        F.array_join("images", " ").alias("images"),
        "is_thread",
    )


@query
def ingest_valid(spark, sf_dir):
    valid, _ = ingest.ingest(fx.raw_posts_pages(spark, sf_dir))
    return _post_out(valid)


@query
def ingest_quarantine(spark, sf_dir):
    _, bad = ingest.ingest(fx.raw_posts_pages(spark, sf_dir))
    return bad.select("page_id", "reason")


@query
def post_lookup(spark, sf_dir):
    """Many point lookups at once: toxic-labelled documents, by post URL for
    even ids and by bare id for odd ones."""
    lab = read(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    keys = lab.select(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://x.com/someone/status/"), F.col("doc_id").cast("string")))
        .otherwise(F.col("doc_id").cast("string"))
        .alias("key")
    )
    return ingest.lookup_posts(fx.posts_pages(spark, sf_dir), keys).select("id", "author_username")


@query
def post_urls(spark, sf_dir):
    return fx.posts_pages(spark, sf_dir).select("id", F.posexplode("urls").alias("pos", "url")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query
def post_mentions(spark, sf_dir):
    posts = fx.posts_pages(spark, sf_dir)
    return posts.select("id", F.posexplode(extract_handles("text")).alias("pos", "handle")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query
def post_media(spark, sf_dir):
    media = ingest.extract_media(fx.raw_media_entities(spark, sf_dir))
    return media.select("post_id", F.posexplode("media").alias("pos", "m")).select(
        "post_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("m.type").alias("type"),
        F.col("m.url").alias("url"),
        F.col("m.previewUrl").alias("preview_url"),
        F.col("m.width").alias("width"),
        F.col("m.height").alias("height"),
        F.col("m.videoUrl").alias("video_url"),
        F.col("m.durationMs").cast("double").alias("duration_ms"),
    )


@query
def best_variant(spark, sf_dir):
    media = ingest.extract_media(fx.raw_media_entities(spark, sf_dir))
    return media.select("post_id", F.explode("media").alias("m")).where(F.col("m.videoUrl").isNotNull()).select(
        "post_id", F.col("m.videoUrl").alias("video_url")
    )


@query
def newest_posts(spark, sf_dir):
    return ingest.newest(fx.posts_pages(spark, sf_dir), 20).select("id", iso("created_at").alias("created_at"))


# --- step 4: URL and text columns ---------------------------------------------------


@query
def url_classes(spark, sf_dir):
    """Every URL found in posts, classified."""
    urls = fx.posts_pages(spark, sf_dir).select("id", F.posexplode("urls").alias("pos", "url"))
    return urls.select(
        "id",
        F.col("pos").cast("bigint").alias("pos"),
        "url",
        U.url_host("url").alias("host"),
        U.is_scrapable("url").alias("is_scrapable"),
        U.is_scrapable_strict("url").alias("is_scrapable_strict"),
        U.is_video_url("url").alias("is_video"),
        U.video_id("url").alias("video_id"),
        U.url_title("url").alias("url_title"),
        U.site_name(F.lit(None).cast("string"), "url").alias("site_name"),
    )


@query
def video_ids(spark, sf_dir):
    urls = fx.posts_pages(spark, sf_dir).select("id", F.explode("urls").alias("url"))
    return urls.select("id", U.video_id("url").alias("video_id")).where(F.col("video_id").isNotNull())


@query
def truncate_text(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        "doc_id",
        T.truncate("text", fixed.TOPIC_WIDTH).alias("t50"),
        T.truncate("text", fixed.TLDR_WIDTH).alias("t280"),
        T.truncate("text", fixed.SUMMARY_WIDTH).alias("t2000"),
        T.truncate_marked("text", fixed.ARTICLE_PROMPT_CUT).alias("cut8000"),
        T.truncate_marked("text", fixed.TRANSCRIPT_PROMPT_CUT).alias("cut6000"),
    )


@query
def transcript_clean(spark, sf_dir):
    return clean_vtt(fx.transcripts(spark, sf_dir), "vtt", "transcript").select("video_id", "transcript")


@query
def message_chunks(spark, sf_dir):
    """Every document packed into message pieces of at most 4000 units."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(chunk_lines("text", fixed.DIGEST_CHUNK)).alias("chunk_no", "chunk")).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), T.utf16_length("chunk").alias("chunk_len")
    )


@query
def html_escape(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", T.html_escape("text").alias("escaped"))


@query
def caption_files(spark, sf_dir):
    """Captions read back from files of JSON lines, many videos a file, then cleaned."""
    path = S.scratch(spark, "captions")
    fx.transcripts(spark, sf_dir).select("video_id", "vtt").write.json(path)
    return clean_vtt(ingest.read_caption_lines(spark, path), "vtt", "transcript").select("video_id", "transcript")


@query
def post_texts(spark, sf_dir):
    """Post text: a long article's, else a note's, else the plain text (empty ones count as present)."""
    n = F.col("doc_id")
    given = lambda kind: F.concat(F.lit(kind + " "), n.cast("string"))
    article = F.when(n % 6 == 0, "").when(n % 3 == 0, given("article"))
    return read(spark, sf_dir, "documents").select(
        n.cast("string").alias("post_id"), ingest.post_text(article, F.when(n % 4 == 0, given("note")), F.col("text")).alias("text")
    )


@query
def bookmark_files(spark, sf_dir):
    """Posts read from bookmark files with one JSON post a line, then validated."""
    path = S.scratch(spark, "bookmarks")
    fx.raw_posts_pages(spark, sf_dir).select("raw").write.text(path)
    valid, _ = ingest.ingest(ingest.read_bookmark_lines(spark, path))
    return _post_out(valid)


@query
def bookmark_arrays(spark, sf_dir):
    """Posts read from bookmark files that hold one JSON array each, by blocks, then validated."""
    path = S.scratch(spark, "arrays")
    raw = fx.raw_posts_pages(spark, sf_dir).where(F.try_parse_json("raw").isNotNull())
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "raw"))), lambda x: x["raw"]), ",\n")
    files = raw.groupBy(F.floor(F.col("page_id") / 500).alias("file")).agg(F.concat(F.lit("["), in_order, F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(path)
    valid, _ = ingest.ingest(ingest.split_bookmarks(spark, path))
    return _post_out(valid)


# --- step 5: enrichment -------------------------------------------------------------


def _context_tables(spark, sf_dir):
    """Posts, rule triage and the three fetched context tables.  Posts and
    triage feed every later branch, so they are staged once."""
    posts = session.stage(fx.posts_pages(spark, sf_dir))
    labels = read(spark, sf_dir, "labels")
    triage = session.stage(inference.rule_triage(posts, labels))
    arts = enrich.fetch_articles(enrich.wanted_from_triage(triage, "needsArticleScrape"), read(spark, sf_dir, "pages"))
    wanted_v = enrich.wanted_from_triage(triage, "needsYoutubeTranscript").withColumn("video_id", U.video_id("url"))
    trs = enrich.fetch_transcripts(wanted_v, fx.transcripts(spark, sf_dir))
    imgs = enrich.fetch_image_texts(enrich.wanted_from_triage(triage, "needsImageAnalysis"), fx.image_texts(spark, sf_dir))
    return posts, labels, triage, arts, trs, imgs


@query
def article_parse(spark, sf_dir):
    parsed = enrich.parse_articles(read(spark, sf_dir, "pages"))
    return parsed.select("url", "title", F.length("content").cast("bigint").alias("content_len"),
                         F.sha2("content", 256).alias("content_sha"), "excerpt", "site_name")


@query
def article_markdown(spark, sf_dir):
    """Every stored page as Markdown: headings, paragraphs, lists, links, marks and code."""
    return enrich.parse_articles(read(spark, sf_dir, "pages"), markdown=True).select("url", "title", "content")


@query
def enriched_articles(spark, sf_dir):
    _, _, _, arts, _, _ = _context_tables(spark, sf_dir)
    return arts.select("post_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "content",
                       F.col("content_len").cast("bigint").alias("content_len"))


@query
def enriched_transcripts(spark, sf_dir):
    _, _, _, _, trs, _ = _context_tables(spark, sf_dir)
    return trs.select("post_id", F.col("pos").cast("bigint").alias("pos"), "url", "video_id", "transcript")


@query
def enriched_images(spark, sf_dir):
    _, _, _, _, _, imgs = _context_tables(spark, sf_dir)
    return imgs.select("post_id", F.col("pos").cast("bigint").alias("pos"), "url", "description")


@query
def image_descriptions(spark, sf_dir):
    return fx.image_texts(spark, sf_dir)


def _faulty_images(urls):
    """An unreliable image model: no JSON, an unknown kind or no key elements for some lengths of url."""
    n = F.length("url") % 5
    good = F.struct(
        F.concat(F.lit("image at "), F.col("url")).alias("description"), F.lit(False).alias("hasText"),
        F.when(n == 1, "painting").otherwise("photo").alias("contentType"),
        F.when(n != 2, F.array(F.lit("sky"), F.lit("sea"))).alias("keyElements"), F.lit("attached").alias("relevance"),
    )
    return urls.select("url", F.when(n == 0, "{x").otherwise(F.to_json(good)).alias("output"))


@query
def image_model(spark, sf_dir):
    """Every extracted image described by a model that spoils answers: text, or why it is rejected."""
    media = ingest.extract_media(fx.raw_media_entities(spark, sf_dir)).select(F.explode("media.url").alias("url"))
    described, rejected = inference.describe_images(media, _faulty_images)
    return described.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected.select("url", F.lit(None).cast("string").alias("description"), "reason")
    )


def _digest_answers(requests):
    """A digest model's stand-in: reads the request and answers by it."""
    total = F.regexp_extract("prompt", r"Total processed: (\d+)", 1)
    first = F.regexp_extract("prompt", r"\n- \[([^\]]*)\]", 1)
    answer = F.struct(
        F.concat(total, F.lit(" posts were saved.")).alias("digest"),
        F.array(F.concat(F.lit("first: "), first)).alias("patterns"),
        F.array().cast("array<string>").alias("recommendations"),
        F.array(F.struct(first.alias("summary"), F.lit("newest").alias("why"))).alias("topPicks"),
    )
    return requests.select(F.to_json(answer).alias("output"))


@query
def digest_model(spark, sf_dir):
    """The week's digest by a model that is given the request, validated and rendered."""
    inp = digest.digest_input(stats.week_slice(fx.ledger_rows(spark, sf_dir)))
    ok, _ = digest.model_digest(inp, _digest_answers)
    return ok.select(digest.render(F.col("digest")).alias("markdown"))


@query
def thread_expand(spark, sf_dir):
    members = fx.conversation_members(spark, sf_dir)
    bookmarks = fx.conversation_bookmarks(spark, sf_dir)
    return enrich.expand_threads(bookmarks, members).select("post_id", "member_id", "turn", "text")


def _thread_posts(spark, sf_dir):
    return fx.conversation_bookmarks(spark, sf_dir), fx.conversation_members(spark, sf_dir)


@query
def thread_prompt(spark, sf_dir):
    """Analysis requests of saved conversation posts by the call in which a caller brings the
    article text itself (here the post's own text), with the thread's members."""
    posts, members = _thread_posts(spark, sf_dir)
    none = F.lit(None)
    given = posts.select(
        "id", F.col("text").alias("article_content"), none.cast("string").alias("youtube_transcript"),
        none.cast("array<string>").alias("image_descriptions"),
    )
    triage, arts, trs, imgs, _ = inference.legacy_context(given)
    threads = enrich.expand_threads(posts, members)
    return inference.enriched_prompt(posts, triage, arts, trs, imgs, threads).withColumnRenamed("id", "post_id")


@query
def thread_flags(spark, sf_dir):
    """The flags of saved conversation posts: what a caller's answer says, or the context found."""
    posts, members = _thread_posts(spark, sf_dir)
    given = posts.select(
        "id", F.lit(None).cast("string").alias("article_content"), F.col("text").alias("youtube_transcript"),
        F.lit(None).cast("array<string>").alias("image_descriptions"),
    )
    _, arts, trs, imgs, _ = inference.legacy_context(given)
    counts = enrich.context_summary(arts, trs, imgs.withColumn("title", F.lit(None).cast("string")), enrich.thread_counts(posts, members))
    says = F.struct(
        (F.length("text") % 2 == 0).alias("hasArticle"), F.lit(None).cast("boolean").alias("hasVideo"), F.lit(False).alias("hasThread")
    )
    flags = inference.merge_flags(posts.select("id", says.alias("analysis")), counts)
    return flags.select(F.col("id").alias("post_id"), "has_article", "has_video", "has_thread", F.length("youtube_transcript").cast("bigint").alias("transcript_len"))


@query
def video_info(spark, sf_dir):
    return enrich.parse_video_info(fx.video_info_raw(spark, sf_dir))


# --- step 6: inference ----------------------------------------------------------------


@query
def triage_rules(spark, sf_dir):
    posts = fx.posts_pages(spark, sf_dir)
    t = inference.rule_triage(posts, read(spark, sf_dir, "labels"))
    return t.select(
        F.col("id").alias("post_id"),
        F.col("triage.contentType").alias("content_type"),
        F.col("triage.estimatedValue").alias("estimated_value"),
        F.size("triage.needsArticleScrape").cast("bigint").alias("n_articles"),
        F.size("triage.needsYoutubeTranscript").cast("bigint").alias("n_transcripts"),
        F.size("triage.needsImageAnalysis").cast("bigint").alias("n_images"),
        F.col("triage.needsThreadExpansion").alias("needs_thread"),
        F.col("triage.skipReason").alias("skip_reason"),
    )


@query
def triage_skip(spark, sf_dir):
    posts = fx.posts_pages(spark, sf_dir)
    t = inference.rule_triage(posts, read(spark, sf_dir, "labels"))
    at = stats.latest_time(fx.ledger_rows(spark, sf_dir))
    return inference.triage_skipped(t, at).select("post_id", "category", "status", "page_id", "skip_reason")


def _analysis(spark, sf_dir):
    posts, labels, triage, arts, trs, imgs = _context_tables(spark, sf_dir)
    counts = session.stage(enrich.context_summary(arts, trs, imgs))
    return posts, triage, counts, session.stage(inference.rule_analysis(posts, triage, counts, labels))


@query
def analysis_rules(spark, sf_dir):
    _, _, _, a = _analysis(spark, sf_dir)
    return a.select(
        F.col("id").alias("post_id"),
        F.col("analysis.category").alias("category"),
        F.col("analysis.relevanceScore").alias("score"),
        F.array_join("analysis.tags", ",").alias("tags"),
        F.col("analysis.topic").alias("topic"),
        F.col("analysis.tldr").alias("tldr"),
        F.col("analysis.topAction").alias("top_action"),
        F.col("analysis.primaryLink").alias("primary_link"),
        F.get("analysis.actionItems", 0)["priority"].alias("priority"),
        F.size("analysis.keyInsights").cast("bigint").alias("n_insights"),
        F.size("analysis.extractedLinks").cast("bigint").alias("n_links"),
    )


def _model_outputs(spark, sf_dir, a=None):
    """Analysis JSON as a model would return it, with faults on a rule:
    unknown category when page_id % 10 = 4, score 0 when % 10 = 6, cut-off
    JSON when % 25 = 9."""
    if a is None:
        _, _, _, a = _analysis(spark, sf_dir)
    pid = F.col("id").cast("bigint")
    good = F.to_json("analysis")
    bad_cat = F.to_json(F.col("analysis").withField("category", F.lit("misc")))
    bad_score = F.to_json(F.col("analysis").withField("relevanceScore", F.lit(0.0)))
    out = (
        F.when(pid % 25 == 9, F.substring(good, 1, 30))
        .when(pid % 10 == 4, bad_cat)
        .when(pid % 10 == 6, bad_score)
        .otherwise(good)
    )
    return T.with_computed(a, out, "output").select("id", "output")


@query
def analysis_valid(spark, sf_dir):
    ok, _ = inference.validate_analysis(_model_outputs(spark, sf_dir))
    return ok.select(F.col("id").alias("post_id"), F.col("analysis.category").alias("category"),
                     F.col("analysis.relevanceScore").alias("score"))


@query
def analysis_quarantine(spark, sf_dir):
    _, bad = inference.validate_analysis(_model_outputs(spark, sf_dir))
    return bad.select(F.col("id").alias("post_id"), "reason")


@query
def analysis_flags(spark, sf_dir):
    _, _, counts, a = _analysis(spark, sf_dir)
    f = inference.merge_flags(a, counts)
    return f.select(
        F.col("id").alias("post_id"), "has_article", "has_video", "has_thread",
        F.length("article_content").cast("double").alias("article_len"),
        F.length("youtube_transcript").cast("double").alias("transcript_len"),
        "n_image_texts",
    )


@query
def triage_prompt(spark, sf_dir):
    return inference.triage_prompt(fx.posts_pages(spark, sf_dir)).withColumnRenamed("id", "post_id")


@query
def enriched_prompt(spark, sf_dir):
    posts, _, triage, arts, trs, imgs = _context_tables(spark, sf_dir)
    live = triage.where(F.col("triage.estimatedValue") != "skip")
    return inference.enriched_prompt(posts, live, arts, trs, imgs).withColumnRenamed("id", "post_id")


def _faulty_triage(labels):
    """Rule triage as an unreliable model: no answer when id % 20 = 5, no
    value when id % 20 = 8."""

    def model(posts):
        n = F.col("id").cast("bigint") % 20
        value = F.when(n != 8, F.col("triage.estimatedValue"))
        return inference.rule_triage(posts, labels).where(n != 5).withColumn("triage", F.col("triage").withField("estimatedValue", value))

    return model


def _faulty_analysis(prompts):
    """An analysis model that sees only the prompt: the category follows from
    its sections.  No answer when id % 25 = 10, an unknown category when 14, no
    tags when 16."""
    n = F.col("id").cast("bigint") % 25
    category = (
        F.when(n == 14, "misc").when(F.contains("prompt", F.lit(fixed.PROMPT_ARTICLES)), "article")
        .when(F.contains("prompt", F.lit(fixed.PROMPT_TRANSCRIPTS)), "video").otherwise("knowledge")
    )
    texts = [F.lit(x).alias(x) for x in ("topic", "summary", "tldr", "forYou")]
    flags = [F.lit(False).alias(x) for x in ("hasArticle", "hasVideo", "hasThread")]
    lists = [F.array().cast("array<string>").alias(x) for x in ("keyInsights", "quotes", "extractedLinks", "actionItems")]
    tags = F.when(n != 16, F.array(F.lit("tag"))).alias("tags")
    answer = F.to_json(F.struct(category.alias("category"), *texts, *flags, *lists, tags, F.lit(7.0).alias("relevanceScore")))
    return prompts.where(n != 10).select("id", answer.alias("output"))


def _poll(spark, sf_dir):
    """One whole poll over the raw posts with models that leave out or spoil answers:
    its folder and its counters."""
    path = S.scratch(spark, "poll")
    stores = poll.Stores(
        pages=read(spark, sf_dir, "pages"), captions=fx.transcripts(spark, sf_dir),
        image_texts=fx.image_texts(spark, sf_dir), published=fx.published(spark, sf_dir),
    )
    counters = poll.run_poll(
        spark, fx.raw_posts_pages(spark, sf_dir), stores, path + "/ledger", path + "/pages", 0, dt.datetime(2024, 2, 1),
        triage_model=_faulty_triage(read(spark, sf_dir, "labels")), analysis_model=_faulty_analysis,
    )
    return path, counters


@query
def poll_outcome(spark, sf_dir):
    """One whole poll over the raw posts with models that leave out or spoil
    answers: the final state of every accepted post."""
    path, _ = _poll(spark, sf_dir)
    cur = ledger.current(ledger.read_ledger(spark, path + "/ledger"))
    pages = spark.read.parquet(path + "/pages").select("post_id", F.lit(True).alias("page"))
    return cur.join(pages, "post_id", "left").select(
        "post_id", "status", "category", F.coalesce("page", F.lit(False)).alias("has_page")
    )


@query
def poll_counters(spark, sf_dir):
    """The run counters of that poll, as its jobs observed them."""
    _, counters = _poll(spark, sf_dir)
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} bigint" for k in counters))


@query
def poll_payloads(spark, sf_dir):
    """The stored payload of every post of that poll: its parts, and the post in it."""
    path, _ = _poll(spark, sf_dir)
    cur = ledger.current(ledger.read_ledger(spark, path + "/ledger"))
    field = lambda p: F.get_json_object("raw_data", p)
    return cur.select(
        "post_id", F.array_join(F.json_object_keys("raw_data"), ",").alias("parts"), field("$.tweet.id").alias("tweet_id"),
        F.sha2(field("$.tweet.text"), 256).alias("text_sha"), F.coalesce(F.json_array_length(field("$.tweet.urls")), F.lit(0)).cast("bigint").alias("n_urls"),
        field("$.triage.estimatedValue").alias("estimated_value"), field("$.analysis.category").alias("category"),
    )


@query
def poll_tables(spark, sf_dir):
    """The ledger and the published pages of that poll through catalog tables over
    the job's own folders: every post's final state with its page."""
    path, _ = _poll(spark, sf_dir)
    versions, pages = (f"{kind}_{uuid.uuid4().hex}" for kind in ("ledger", "pages"))
    ledger.create_ledger(spark, versions, path + "/ledger")
    existed = [publish.ensure_published_table(spark, pages, path + "/pages") for _ in range(2)]
    for name in (versions, pages):
        ledger.add_batches(spark, name)
    shown = spark.table(pages).select("post_id", "page_id", F.col("category").alias("page_category"))
    return ledger.current(spark.table(versions), ["status", "category"]).join(shown, "post_id", "left").select(
        "post_id", "status", "category", "page_id", "page_category",
        F.lit(existed[0]).alias("existed_before"), F.lit(existed[1]).alias("exists_now"),
    )


@query
def ledger_added_column(spark, sf_dir):
    """A ledger whose older files lack the column `status`, read with the present schema."""
    path, rows = S.scratch(spark, "ledger"), fx.ledger_rows(spark, sf_dir)
    old = F.col("version") % 2 == 0
    rows.where(old).drop("status").write.parquet(path + "/batch_id=0")
    rows.where(~old).write.parquet(path + "/batch_id=1")
    return ledger.read_ledger(spark, path).select("post_id", "category", "status")


# --- step 7: publish, digest, alerts -------------------------------------------------------


def _publish_input(spark, sf_dir):
    """Posts and their validated analyses with merged flags and context."""
    posts, _, counts, a = _analysis(spark, sf_dir)
    ok, _ = inference.validate_analysis(_model_outputs(spark, sf_dir, a))
    flags = inference.merge_flags(ok.select("id", "analysis"), counts)
    return posts, ok.select("id", "analysis").join(flags, "id")


@query
def publish_rows(spark, sf_dir):
    posts, analyses = _publish_input(spark, sf_dir)
    at = stats.latest_time(fx.ledger_rows(spark, sf_dir))
    rows = publish.publish_rows(posts, analyses, at)
    return rows.withColumn("tags", F.array_join("tags", ","))


@query
def publish_dedup(spark, sf_dir):
    posts, analyses = _publish_input(spark, sf_dir)
    live = posts.join(analyses.select("id"), "id", "left_semi")
    return publish.split_published(live, fx.published(spark, sf_dir)).select(
        F.col("id").alias("post_id"), "already_published"
    )


@query
def publish_backlog(spark, sf_dir):
    cur = ledger.current(fx.ledger_versions(spark, sf_dir), SHOWN)
    return publish.backlog(cur).select("post_id", "category", iso("processed_at").alias("processed_at"))


@query
def page_blocks(spark, sf_dir):
    posts, analyses = _publish_input(spark, sf_dir)
    return publish.page_blocks(posts, analyses)


def _answered(spark, sf_dir):
    """Documents as posts, with their valid answers and the flags and context that came with them."""
    given = fx.answered_posts(spark, sf_dir)
    ok, _ = inference.validate_analysis(given.select("id", "output"))
    ok = ok.select("id", "analysis")
    _, arts, trs, imgs, _ = inference.legacy_context(given)
    flags = inference.merge_flags(ok, enrich.context_summary(arts, trs, imgs))
    return given.select("id", "text", "author_username", "created_at", "images"), ok.join(flags, "id")


@query
def answers_published(spark, sf_dir):
    """Published rows of answers with more tags and longer texts than a page shows."""
    posts, analyses = _answered(spark, sf_dir)
    rows = publish.publish_rows(posts, analyses, stats.latest_time(fx.ledger_rows(spark, sf_dir)))
    return rows.select(
        "post_id", "topic", "score", "score_visual", "category", "priority", F.size("tags").cast("bigint").alias("n_tags"),
        F.array_join("tags", ",").alias("tags"), "for_you", "tldr",
    )


@query
def answers_blocks(spark, sf_dir):
    """Page blocks of answers with quotes, more images, links and insights than a page shows."""
    return publish.page_blocks(*_answered(spark, sf_dir))


def _digest(spark, sf_dir):
    inp = digest.digest_input(stats.week_slice(fx.ledger_rows(spark, sf_dir)))
    d = digest.rule_digest(inp)
    ok = d.where(inference.digest_reason(F.col("digest")).isNull())
    return inp, ok.select(digest.render(F.col("digest")).alias("markdown"))


@query
def digest_markdown(spark, sf_dir):
    return _digest(spark, sf_dir)[1]


@query
def digest_prompt(spark, sf_dir):
    return digest.digest_prompt(_digest(spark, sf_dir)[0])


@query
def digest_outbox(spark, sf_dir):
    return digest.outbox(_digest(spark, sf_dir)[1], "markdown", "Markdown")


@query
def document_outbox(spark, sf_dir):
    """Every document as an outgoing message: no text is lost at the limits."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest.outbox(docs, "text", "HTML").select("doc_id", "seq", F.sha2("text", 256).alias("text_sha"), "parse_mode")


@query
def error_alerts(spark, sf_dir):
    return alerts.alerts(fx.errors(spark, sf_dir)).select("event_id", "code", "retryable", "alert_kind", "text")


@query
def run_metrics(spark, sf_dir):
    """Counters of one poll over all posts: blocked by the ledger, claimed,
    skipped by triage, analysed."""
    posts = fx.posts_pages(spark, sf_dir)
    cur = ledger.current(fx.ledger_versions(spark, sf_dir), ["status"])
    t = inference.rule_triage(posts, read(spark, sf_dir, "labels")).select(
        "id", (F.col("triage.estimatedValue") == "skip").alias("triage_skip")
    )
    flags = ledger.blocked_flags(posts.select("id"), cur).join(t, "id")
    return stats.run_counters(flags)


@query
def stats_message(spark, sf_dir):
    """The statistics message for the day of the newest ledger row."""
    rows = fx.ledger_rows(spark, sf_dir)
    return alerts.stats_message(rows, F.to_date(F.lit(stats.latest_time(rows))))


# --- step 8: streaming ----------------------------------------------------------------------

STREAM_FILES = 6


@query
def stream_ingest(spark, sf_dir):
    """Events streamed through the file source into a parquet ledger."""
    path = S.scratch(spark, "ledger")
    events = S.read_stream(spark, f"{sf_dir}/events.parquet", S.EVENT_SCHEMA, max_files=1)
    S.ingest_to_ledger(fx.ledger_rows_of(events), path, path + "-ckpt")
    out = spark.read.parquet(path)
    return out.select("post_id", iso("processed_at").alias("processed_at"), "category", "status", "version")


@query
def stream_new_posts(spark, sf_dir):
    """Pages streamed in as posts and claimed against the ledger; the
    result is the set of posts claimed by the stream."""
    path = S.scratch(spark, "claims")
    seed = fx.ledger_versions(spark, sf_dir).withColumn("batch_id", F.lit(-1))
    seed.write.partitionBy("batch_id").parquet(path)
    return _claims_of_stream(spark, sf_dir, path)


def _claims_of_stream(spark, sf_dir, path, **options):
    """The claims of a stream of all pages in STREAM_FILES micro-batches; a third
    of the pages comes in a second time."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    files = S.as_files(pages.unionByName(pages.where("page_id % 3 = 0")), path + "-in", STREAM_FILES)
    stream = S.read_stream(spark, files, "page_id BIGINT, url STRING", max_files=1)
    S.claim_stream(spark, fx.posts_pages(spark, sf_dir, stream), path, path + "-ckpt", **options)
    out = spark.read.parquet(path).where(F.col("batch_id") >= 0)
    return out.select("post_id", "status", "category")


@query
def stream_retry(spark, sf_dir):
    """The same stream against a ledger of all events, every micro-batch taking
    up failed ledger rows: they are claimed once, whether they come in again or
    not."""
    path = S.scratch(spark, "retries")
    seed = fx.ledger_rows(spark, sf_dir).withColumn("batch_id", F.lit(-1))
    seed.write.partitionBy("batch_id").parquet(path)
    return _claims_of_stream(spark, sf_dir, path, retry_failed=True)


@query
def stream_weekly(spark, sf_dir):
    """7-day windows by category over micro-batches that each hold rows of all
    weeks."""
    path = S.scratch(spark, "weekly")
    files = S.as_files(read(spark, sf_dir, "events"), path + "-in", STREAM_FILES)
    events = S.read_stream(spark, files, S.EVENT_SCHEMA, max_files=1)
    S.weekly_windows(fx.ledger_rows_of(events), path, path + "-ckpt")
    w = S.window_totals(spark, path)
    return w.select(iso("window_start").alias("window_start"), iso("window_end").alias("window_end"), "category", "n")


@query
def stream_dedup(spark, sf_dir):
    """Saved posts in the order they come in, some of them again within two hours
    and some long after: what the state store lets through."""
    path = S.scratch(spark, "dedup")
    files = S.as_slices(fx.saves(spark, sf_dir), path + "-in", "created_at", STREAM_FILES)
    saved = S.read_stream(spark, files, "id STRING, created_at TIMESTAMP", max_files=1)
    S.append_files(S.first_within(saved, "2 hours"), path, path + "-ckpt")
    return spark.read.parquet(path).select(F.col("id").alias("post_id"), iso("created_at").alias("saved_at"))


@query
def stream_weekly_watermark(spark, sf_dir):
    """Weeks closed by a watermark of two days over events of which some come in
    fifteen days late: the counts given out, and the late rows."""
    path = S.scratch(spark, "closed")
    files = S.as_slices(fx.arrivals(spark, sf_dir), path + "-in", "arrived", STREAM_FILES)
    rows = fx.ledger_rows_of(S.read_stream(spark, files, S.EVENT_SCHEMA, max_files=1))
    S.weekly_closed(rows, path, path + "-ckpt", "2 days")
    S.late_counts(spark, rows, path + "-late", path + "-late-ckpt", "2 days")
    late = spark.read.parquet(path + "-late/late").groupBy("window_start", "category").agg(F.sum("n").alias("n"))
    shown = ["kind", "window_start", "category", "n"]
    closed = spark.read.parquet(path).withColumn("kind", F.lit("closed")).select(*shown)
    both = closed.unionByName(late.withColumn("kind", F.lit("late")).select(*shown))
    return both.withColumn("window_start", iso("window_start"))


@query
def stream_digests(spark, sf_dir):
    """Events streamed into the ledger, and from there a digest for every week that
    closes: the outbox."""
    path = S.scratch(spark, "digests")
    events = S.read_stream(spark, f"{sf_dir}/events.parquet", S.EVENT_SCHEMA, max_files=1)
    S.ingest_to_ledger(fx.ledger_rows_of(events), path + "/ledger", path + "/ledger-ckpt")
    S.weekly_digests(spark, path + "/ledger", path + "/outbox", path + "/ckpt", "1 day", max_files=12)
    out = spark.read.schema("seq BIGINT, text STRING, parse_mode STRING, week STRING").parquet(path + "/outbox")
    return out.select("week", "seq", "text", "parse_mode")


@query
def stream_quarantine(spark, sf_dir):
    """Raw post texts streamed as lines `page id, tab, post`, validated with two
    sinks: the quarantine."""
    path = S.scratch(spark, "raw")
    lines = fx.raw_posts_pages(spark, sf_dir).select(F.concat(F.col("page_id").cast("string"), F.lit("\t"), "raw").alias("value"))
    lines.repartition(STREAM_FILES).write.text(path + "-in")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).option("lineSep", "\n").text(path + "-in")
    at = F.instr("value", "\t")
    raw = stream.select(F.substring("value", F.lit(1), at - 1).cast("bigint").alias("page_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("raw"))
    S.ingest_stream(raw, path, path + "-ckpt")
    return spark.read.parquet(path + "/quarantine").select("page_id", "reason")


@query
def new_posts_bucketed(spark, sf_dir):
    """Posts of the batch not blocked by a ledger stored in buckets: its versions
    are aggregated and joined without a shuffle."""
    path = S.scratch(spark, "buckets")
    table = "quire_ledger_" + path[-12:]
    versions = fx.ledger_versions(spark, sf_dir).drop("raw_data")
    ledger.append_bucketed(versions, table, path, buckets=16)
    cur = ledger.current(spark.table(table), ["status"])
    return ledger.new_posts(fx.posts_pages(spark, sf_dir), cur).select("id", "author_username")


@query
def triage_model(spark, sf_dir):
    """Triage prompts sent through the pandas model adapter (Arrow batches
    via mapInPandas), answers validated."""
    prompts = inference.triage_prompt(fx.posts_pages(spark, sf_dir))
    answers = inference.run_model(prompts, inference.prompt_stub_model, "id string, output string")
    ok, bad = inference.validate_triage(answers)
    return ok.select(
        F.col("id").alias("post_id"), F.col("triage.contentType").alias("content_type"),
        F.col("triage.estimatedValue").alias("estimated_value"),
    )
