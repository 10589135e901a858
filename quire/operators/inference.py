"""Triage, analysis and image description: pluggable batch models plus
built-in rule models, and validation of whatever a model returns.

* A language model is plugged in with `run_model`: `mapInPandas` over Arrow
  batches, with the declared output schema, so calls are batched per task
  and the result stays a DataFrame.
* The rule models (`rule_triage`, `rule_analysis`, `rule_image_text`) are
  column expressions and joins; they stand in for the model in tests and are
  labelled "rule model" in outputs.
* Every model output goes through `validate_*` (enums, ranges, required
  fields) and splits into valid rows and a quarantine with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.functions import urls as U
from quire.session import stage

TRIAGE_SCHEMA = (
    "needsArticleScrape ARRAY<STRUCT<url: STRING, reason: STRING, priority: STRING>>, "
    "needsYoutubeTranscript ARRAY<STRUCT<url: STRING, reason: STRING>>, "
    "needsImageAnalysis ARRAY<STRUCT<url: STRING, expectedContent: STRING>>, "
    "needsThreadExpansion BOOLEAN, contentType STRING, estimatedValue STRING, skipReason STRING"
)

ANALYSIS_SCHEMA = (
    "category STRING, topic STRING, summary STRING, tldr STRING, forYou STRING, topAction STRING, "
    "primaryLink STRING, hasArticle BOOLEAN, hasVideo BOOLEAN, hasThread BOOLEAN, "
    "keyInsights ARRAY<STRING>, quotes ARRAY<STRING>, "
    "extractedLinks ARRAY<STRUCT<url: STRING, title: STRING, type: STRING, description: STRING>>, "
    "tags ARRAY<STRING>, relevanceScore DOUBLE, "
    "actionItems ARRAY<STRUCT<action: STRING, priority: STRING, context: STRING>>, "
    "connections ARRAY<STRING>"
)

IMAGE_SCHEMA = (
    "description STRING, hasText BOOLEAN, extractedText STRING, contentType STRING, "
    "keyElements ARRAY<STRING>, relevance STRING"
)

DIGEST_SCHEMA = (
    "digest STRING, patterns ARRAY<STRING>, recommendations ARRAY<STRING>, "
    "topPicks ARRAY<STRUCT<summary: STRING, why: STRING>>"
)


# --- pluggable model ------------------------------------------------------------------


def run_model(
    df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply `model` (pandas batch in, pandas batch out with `schema`) to
    every Arrow batch of `df`.  One call per batch, on the executors."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(apply, schema)


# --- K1: rule triage --------------------------------------------------------------------


def rule_triage(posts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rule triage: articles = scrapable URLs, transcripts = video URLs,
    images = all images, expand = thread flag; content type by the first
    match of thread, video, article, image; skip blank or toxic posts, high
    when an article or transcript is wanted, else medium."""
    df = posts
    if labels is not None:
        tox = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic"))
        df = df.join(tox, "id", "left")
    else:
        df = df.withColumn("toxic", F.lit(None).cast("int"))
    articles = F.filter("urls", U.is_scrapable)
    videos = F.filter("urls", lambda u: U.video_id(u).isNotNull())
    blank = T.js_trim("text") == ""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    ctype = (
        F.when(F.col("is_thread"), "thread")
        .when(F.size(videos) > 0, "video_share")
        .when(F.size(articles) > 0, "article_share")
        .when(F.size("images") > 0, "image_post")
        .otherwise("tweet")
    )
    value = (
        F.when(blank | toxic, "skip")
        .when((F.size(articles) > 0) | (F.size(videos) > 0), "high")
        .otherwise("medium")
    )
    reason = F.when(blank, "blank text").when(toxic, "flagged toxic")
    triage = F.struct(
        F.transform(
            articles,
            lambda u: F.struct(u.alias("url"), F.lit("linked page").alias("reason"), F.lit("medium").alias("priority")),
        ).alias("needsArticleScrape"),
        F.transform(videos, lambda u: F.struct(u.alias("url"), F.lit("linked video").alias("reason"))).alias(
            "needsYoutubeTranscript"
        ),
        F.transform("images", lambda u: F.struct(u.alias("url"), F.lit("attached image").alias("expectedContent"))).alias(
            "needsImageAnalysis"
        ),
        F.col("is_thread").alias("needsThreadExpansion"),
        ctype.alias("contentType"),
        value.alias("estimatedValue"),
        reason.alias("skipReason"),
    )
    return df.select("id", triage.alias("triage"))


def triage_skipped(triage: DataFrame, processed_at) -> DataFrame:
    """Skipped posts become completed ledger rows in category `review` with
    no page; the stored payload records the triage and `skipped: true`."""
    skipped = triage.where(F.col("triage.estimatedValue") == "skip")
    return skipped.select(
        F.col("id").alias("post_id"),
        F.lit(processed_at).cast("timestamp").alias("processed_at"),
        F.lit("review").alias("category"),
        F.lit(None).cast("string").alias("page_id"),
        F.to_json(F.struct(F.col("id").alias("tweetId"), F.col("triage"), F.lit(True).alias("skipped"))).alias("raw_data"),
        F.lit("completed").alias("status"),
        F.col("triage.skipReason").alias("skip_reason"),
    )


# --- K2: rule analysis ------------------------------------------------------------------


def word_tags(posts: DataFrame, k: int = 9) -> DataFrame:
    """Per post: the k most frequent words of five or more letters
    (ties by word).  A post's words are counted within its row: sorted, so that
    equal words are runs, whose lengths are the counts.  No rows are made for
    (post, word), so a task holds the words of one post at a time.  Rows that
    repeat an id are one post.  A page shows fewer tags (`fixed.MAX_TAGS`)."""
    texts = posts.groupBy("id").agg(F.collect_list("text").alias("texts"))
    found = F.transform("texts", lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}{5,}"), 0))
    words = T.with_computed(texts, F.sort_array(F.flatten(found)), "words").select("id", "words").where(F.size("words") > 0)
    starts = F.array_compact(F.transform("words", lambda w, i: F.when(~w.eqNullSafe(F.get("words", i - 1)), i)))
    runs = T.with_computed(words, starts, "starts")
    end = lambda j: F.coalesce(F.get("starts", j + 1), F.size("words"))
    counts = F.transform("starts", lambda s, j: F.struct((s - end(j)).alias("minus_n"), F.get("words", s).alias("word")))
    return runs.select("id", F.transform(F.slice(F.sort_array(counts), 1, k), lambda x: x["word"]).alias("tags"))


def _link_type(u: Column) -> Column:
    return (
        F.when(U.video_id(u).isNotNull(), "video")
        .when(u.rlike(r"github\.com"), "repo")
        .when(U.is_scrapable(u), "article")
        .otherwise("other")
    )


def rule_analysis(posts: DataFrame, triage: DataFrame, counts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rule analysis for posts that were not skipped.

    `counts` has per post id the number of fetched articles, transcripts,
    image texts and thread members plus the first article title.  Score is
    a bounded formula of those counts and the quality label.  All sentences of
    the text are its insights; only the page cuts their number.
    """
    df = posts.join(triage.where(F.col("triage.estimatedValue") != "skip"), "id")
    df = df.join(counts, "id", "left").join(word_tags(posts), "id", "left")
    if labels is not None:
        df = df.join(labels.select(F.col("doc_id").cast("string").alias("id"), "quality"), "id", "left")
    else:
        df = df.withColumn("quality", F.lit(None).cast("int"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.least(
        F.lit(10),
        F.lit(2)
        + 2 * F.least(n("n_articles"), F.lit(1))
        + 2 * F.least(n("n_transcripts"), F.lit(1))
        + F.least(n("n_images"), F.lit(2))
        + F.when(F.col("quality") == 1, 3).otherwise(0)
        + F.when(n("n_thread") > 0, 1).otherwise(0),
    ).cast("double")
    ctype = F.col("triage.contentType")
    category = (
        F.when(ctype == "thread", "review")
        .when(ctype == "video_share", "video")
        .when(ctype == "article_share", "article")
        .when(ctype == "image_post", "fun")
        .otherwise("knowledge")
    )
    flat = T.js_trim(T.squeeze_space("text"))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    top_action = (
        F.when(category == "article", "Read the article")
        .when(category == "video", "Watch the video")
        .when(category == "review", "Read the thread")
        .otherwise("Skim the post")
    )
    priority = F.when(score >= 9, "now").when(score >= 7, "this-week").otherwise("someday")
    analysis = F.struct(
        category.alias("category"),
        T.truncate(F.coalesce(T.blank_to_null("first_title"), flat), fixed.TOPIC_WIDTH).alias("topic"),
        flat.alias("summary"),
        T.truncate(flat, fixed.TLDR_WIDTH).alias("tldr"),
        F.when(F.size(tags) > 0, F.concat(F.lit("Related to "), F.array_join(tags, ", "))).otherwise(F.lit("")).alias("forYou"),
        top_action.alias("topAction"),
        F.get("urls", 0).alias("primaryLink"),
        F.lit(False).alias("hasArticle"),
        F.lit(False).alias("hasVideo"),
        F.lit(False).alias("hasThread"),
        F.array_remove(F.split(F.regexp_replace(flat, r"([.!?]) ", "$1\n"), "\n"), "").alias("keyInsights"),
        F.array().cast("array<string>").alias("quotes"),
        F.transform(
            "urls",
            lambda u: F.struct(
                u.alias("url"), U.url_title(u).alias("title"), _link_type(u).alias("type"), F.lit("").alias("description")
            ),
        ).alias("extractedLinks"),
        tags.alias("tags"),
        score.alias("relevanceScore"),
        F.when(
            score >= 4,
            F.array(F.struct(top_action.alias("action"), priority.alias("priority"), F.lit(None).cast("string").alias("context"))),
        )
        .otherwise(F.array().cast("array<struct<action:string,priority:string,context:string>>"))
        .alias("actionItems"),
        F.lit(None).cast("array<string>").alias("connections"),
    )
    return df.select("id", analysis.alias("analysis"))


# --- validation ----------------------------------------------------------------------------


def analysis_reason(a: Column) -> Column:
    """First failed rule of a parsed analysis struct, NULL when valid."""
    bad_priority = F.exists(
        F.coalesce(a["actionItems"], F.array()), lambda x: ~F.coalesce(x["priority"].isin(*fixed.PRIORITIES), F.lit(False))
    )
    bad_link = F.exists(
        F.coalesce(a["extractedLinks"], F.array()), lambda x: ~F.coalesce(x["type"].isin(*fixed.LINK_TYPES), F.lit(False))
    )
    missing = F.lit(False)
    required = (
        "topic", "summary", "tldr", "forYou", "hasArticle", "hasVideo", "hasThread",
        "keyInsights", "quotes", "extractedLinks", "tags", "actionItems",
    )
    for field in required:
        missing = missing | a[field].isNull()
    return (
        F.when(a.isNull(), "malformed_json")
        .when(~F.coalesce(a["category"].isin(*fixed.CATEGORIES), F.lit(False)), "category")
        .when(missing, "required_field")
        .when(~F.coalesce(a["relevanceScore"].between(1, 10), F.lit(False)), "relevanceScore")
        .when(bad_priority, "actionItems")
        .when(bad_link, "extractedLinks")
    )


def _parsed(outputs: DataFrame, json_col: str, name: str, schema: str) -> DataFrame:
    """Parse model output JSON; text that is not JSON gives a NULL struct
    (from_json alone would give a struct of NULL fields)."""
    parsed = F.when(F.try_parse_json(F.col(json_col)).isNotNull(), F.from_json(json_col, schema))
    return T.with_computed(outputs, parsed, name)


def validate_analysis(outputs: DataFrame, json_col: str = "output") -> tuple[DataFrame, DataFrame]:
    """Model output JSON -> (valid analyses, quarantine with reason)."""
    parsed = _parsed(outputs, json_col, "analysis", ANALYSIS_SCHEMA).withColumn(
        "reason", analysis_reason(F.col("analysis"))
    )
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def triage_reason(t: Column) -> Column:
    bad_priority = F.exists(
        F.coalesce(t["needsArticleScrape"], F.array()),
        lambda x: ~F.coalesce(x["priority"].isin(*fixed.ARTICLE_PRIORITIES), F.lit(False)),
    )
    return (
        F.when(t.isNull(), "malformed_json")
        .when(~F.coalesce(t["contentType"].isin(*fixed.CONTENT_TYPES), F.lit(False)), "contentType")
        .when(~F.coalesce(t["estimatedValue"].isin(*fixed.ESTIMATED_VALUES), F.lit(False)), "estimatedValue")
        .when(t["needsThreadExpansion"].isNull(), "needsThreadExpansion")
        .when(
            t["needsArticleScrape"].isNull() | t["needsYoutubeTranscript"].isNull() | t["needsImageAnalysis"].isNull(),
            "required_field",
        )
        .when(bad_priority, "needsArticleScrape")
    )


def validate_triage(outputs: DataFrame, json_col: str = "output") -> tuple[DataFrame, DataFrame]:
    parsed = _parsed(outputs, json_col, "triage", TRIAGE_SCHEMA).withColumn(
        "reason", triage_reason(F.col("triage"))
    )
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def image_reason(i: Column) -> Column:
    return (
        F.when(i.isNull(), "malformed_json")
        .when(i["description"].isNull() | i["relevance"].isNull() | i["hasText"].isNull(), "required_field")
        .when(~F.coalesce(i["contentType"].isin(*fixed.IMAGE_KINDS), F.lit(False)), "contentType")
        .when(i["keyElements"].isNull(), "keyElements")
    )


def digest_reason(d: Column) -> Column:
    return (
        F.when(d.isNull(), "malformed_json")
        .when(d["digest"].isNull() | d["patterns"].isNull() | d["recommendations"].isNull(), "required_field")
        .when(d["topPicks"].isNull() | (F.size(d["topPicks"]) > fixed.MAX_TOP_PICKS), "topPicks")
    )


IMAGE_SCHEMA = (
    "description STRING, hasText BOOLEAN, extractedText STRING, contentType STRING, "
    "keyElements ARRAY<STRING>, relevance STRING"
)

DIGEST_SCHEMA = (
    "digest STRING, patterns ARRAY<STRING>, recommendations ARRAY<STRING>, "
    "topPicks ARRAY<STRUCT<summary: STRING, why: STRING>>"
)


def validate_images(outputs: DataFrame, json_col: str = "output") -> tuple[DataFrame, DataFrame]:
    """Image model output JSON (url, output) -> (valid images, quarantine with reason)."""
    parsed = _parsed(outputs, json_col, "image", IMAGE_SCHEMA).withColumn("reason", image_reason(F.col("image")))
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


def validate_digests(outputs: DataFrame, json_col: str = "output") -> tuple[DataFrame, DataFrame]:
    """Digest model output JSON -> (valid digests, quarantine with reason)."""
    parsed = _parsed(outputs, json_col, "digest", DIGEST_SCHEMA).withColumn("reason", digest_reason(F.col("digest")))
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull())


# --- image descriptions -------------------------------------------------------------------------


def rule_image_model(media: DataFrame) -> DataFrame:
    """Rule image model over extracted media items (url, type, width,
    height): the declared six fields, as a model would return them."""
    kind = F.when(F.col("type") == "photo", "photo").otherwise("other")
    return media.select(
        "url",
        F.struct(
            F.format_string("%s of %dx%d pixels", F.col("type"), F.col("width"), F.col("height")).alias("description"),
            (F.col("type") == "photo").alias("hasText"),
            F.when(F.col("type") == "photo", U.url_host("url")).alias("extractedText"),
            kind.alias("contentType"),
            F.array(F.col("type"), F.format_string("w%d", F.col("width"))).alias("keyElements"),
            F.lit("attached to the post").alias("relevance"),
        ).alias("image"),
    )


def render_image_text(image: Column) -> Column:
    """Description, optional extracted text, key elements (as one string)."""
    return F.concat(
        image["description"],
        F.when(T.blank_to_null(image["extractedText"]).isNotNull(), F.concat(F.lit("\n📝 Text: "), image["extractedText"])).otherwise(
            F.lit("")
        ),
        F.when(F.size(image["keyElements"]) > 0, F.concat(F.lit("\n🔑 Key elements: "), F.array_join(image["keyElements"], ", "))).otherwise(
            F.lit("")
        ),
    )


def image_texts(images: DataFrame) -> DataFrame:
    """Validated image outputs rendered to text; failures give ''."""
    ok = images.where(image_reason(F.col("image")).isNull())
    return ok.select("url", render_image_text(F.col("image")).alias("description"))


def describe_images(wanted: DataFrame, model: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Image texts by a model: each wanted URL is asked once.  `model` maps (url) to
    (url, output JSON); its answers are stored once, so both results see the same ones.  Returns
    (url, description) of the valid answers, the least by text where a model gives
    several, and the rejected answers with their reason."""
    answers = stage(model(wanted.select("url").where(F.col("url").isNotNull()).distinct()).select("url", "output"))
    ok, bad = validate_images(answers)
    described = image_texts(ok).groupBy("url").agg(F.min("description").alias("description"))
    return described, bad.select("url", "output", "reason")


# --- flags and prompts ---------------------------------------------------------------------------


def merge_flags(analysis: DataFrame, counts: DataFrame) -> DataFrame:
    """Model flags OR context present; first article and transcript kept,
    every image text kept and counted."""
    df = analysis.join(counts, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(
        "id",
        (F.coalesce(F.col("analysis.hasArticle"), F.lit(False)) | (n("n_articles") > 0)).alias("has_article"),
        (F.coalesce(F.col("analysis.hasVideo"), F.lit(False)) | (n("n_transcripts") > 0)).alias("has_video"),
        (F.coalesce(F.col("analysis.hasThread"), F.lit(False)) | (n("n_thread") > 0)).alias("has_thread"),
        F.col("first_article").alias("article_content"),
        F.col("first_transcript").alias("youtube_transcript"),
        n("n_images").cast("bigint").alias("n_image_texts"),
        F.coalesce("image_texts", F.array().cast("array<string>")).alias("image_texts"),
    )


DEFAULT_TRIAGE_HEAD = (
    "Decide which extra context this saved post needs before it can be "
    "categorised: articles to fetch, video transcripts, images to describe, "
    "and whether to expand the thread."
)
DEFAULT_TRIAGE_TAIL = (
    "Fetch only what adds value. Mark low-effort or spam posts as skip."
)
DEFAULT_USER_CONTEXT = "A software engineer who saves posts about tools, libraries and engineering practice."
DEFAULT_TASK = (
    "Produce the structured analysis of the post using all context above: "
    "category, topic, summary, tldr, why it matters to the reader, one action, "
    "the main link, tags and a 1-10 relevance score."
)


def triage_prompt(posts: DataFrame, head: str = DEFAULT_TRIAGE_HEAD, tail: str = DEFAULT_TRIAGE_TAIL) -> DataFrame:
    """The triage request for each post (template sections filled in)."""
    links = F.when(
        F.size("urls") > 0, F.concat(F.lit("LINKS FOUND:\n"), T.numbered("urls"))
    ).otherwise(F.lit("No links found."))
    images = F.when(
        F.size("images") > 0, F.concat(F.lit("IMAGES: "), F.size("images").cast("string"), F.lit(" image(s) attached"))
    ).otherwise(F.lit(""))
    thread = F.when(F.col("is_thread"), F.lit("NOTE: This appears to be part of a thread.")).otherwise(F.lit(""))
    prompt = F.concat(
        F.lit(head),
        F.lit("\n\nTWEET by @"), F.col("author_username"), F.lit(" ("), F.col("author_name"), F.lit("):\n"),
        F.col("text"), F.lit("\n\n"), links, F.lit("\n\n"), images, F.lit("\n\n"), thread,
        F.lit("\n\n"), F.lit(tail),
    )
    return posts.select("id", prompt.alias("prompt"))


def _nested(ctx: DataFrame, value: Column, name: str) -> DataFrame:
    """Long context rows (post_id, pos, ...) -> one ordered array per post.
    Groups hold one post's URLs or images, bounded by the post itself."""
    return ctx.groupBy("post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("v")))), lambda x: x["v"]).alias(name)
    ).withColumnRenamed("post_id", "id")


def enriched_prompt(
    posts: DataFrame,
    triage: DataFrame,
    articles: DataFrame,
    transcripts: DataFrame,
    images: DataFrame,
    threads: DataFrame | None = None,
    user_context: str = DEFAULT_USER_CONTEXT,
    task: str = DEFAULT_TASK,
) -> DataFrame:
    """The analysis request per post: sections joined by a rule, absent
    sections left out; article text cut at 8000 and transcripts at 6000 (only
    here: the context tables hold the full text), thread members numbered from 2 and
    images from 1."""
    art = _nested(
        articles,
        F.concat(F.lit("### "), F.coalesce(T.first_present("title", "url"), F.lit("")), F.lit("\n"), T.truncate_marked("content", fixed.ARTICLE_PROMPT_CUT)),
        "art",
    )
    trn = _nested(transcripts, F.concat(F.lit("### "), F.col("url"), F.lit("\n"), T.truncate_marked("transcript", fixed.TRANSCRIPT_PROMPT_CUT)), "trn")
    img = _nested(images, F.col("description"), "img")
    df = posts.join(triage, "id").join(art, "id", "left").join(trn, "id", "left").join(img, "id", "left")
    if threads is not None:
        thr = _nested(threads.withColumnRenamed("turn", "pos"), F.col("text"), "thr")
        df = df.join(thr, "id", "left")
    else:
        df = df.withColumn("thr", F.lit(None).cast("array<string>"))
    sep = fixed.PROMPT_SECTION_SEP
    original = F.concat(
        F.lit(fixed.PROMPT_ORIGINAL + "**@"), F.col("author_username"), F.lit("** ("), F.col("author_name"), F.lit(")\n\n"),
        F.col("text"),
        F.lit("\n\n_Content type identified: "), F.col("triage.contentType"),
        F.lit("_\n_Estimated value: "), F.col("triage.estimatedValue"), F.lit("_"),
    )
    thread = F.when(
        F.size("thr") > 0,
        F.concat(
            F.lit("## THREAD CONTINUATION ("), F.size("thr").cast("string"), F.lit(" more tweets)\n"),
            T.numbered("thr", start=2, sep="\n\n", fmt_prefix="[", fmt_mid="] "),
        ),
    )
    article = F.when(F.size("art") > 0, F.concat(F.lit(fixed.PROMPT_ARTICLES), F.array_join("art", sep)))
    transcript = F.when(F.size("trn") > 0, F.concat(F.lit(fixed.PROMPT_TRANSCRIPTS), F.array_join("trn", sep)))
    image = F.when(
        F.size("img") > 0,
        F.concat(
            F.lit(fixed.PROMPT_IMAGES),
            F.array_join(F.transform("img", lambda d, i: F.concat(F.lit("### Image "), (i + 1).cast("string"), F.lit("\n"), d)), "\n\n"),
        ),
    )
    sections = F.array(
        F.lit(fixed.PROMPT_USER_CONTEXT + user_context), original, thread, article, transcript, image,
        F.lit(fixed.PROMPT_TASK + task),
    )
    return df.select("id", F.array_join(F.filter(sections, lambda x: x.isNotNull()), sep).alias("prompt"))


def legacy_context(posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Context from optional per-post columns (`article_content`,
    `youtube_transcript`, `image_descriptions`) and a default triage, for
    callers that fetched context themselves: one-element lists when a text
    is non-empty, and the texts of an optional array column `thread` as thread members,
    in order.  Returns (triage, articles, transcripts, images, threads) long tables for
    `enriched_prompt`; the triage asks for no expansion, as the thread comes with the post."""
    default = F.struct(
        F.array().cast("array<struct<url:string,reason:string,priority:string>>").alias("needsArticleScrape"),
        F.array().cast("array<struct<url:string,reason:string>>").alias("needsYoutubeTranscript"),
        F.array().cast("array<struct<url:string,expectedContent:string>>").alias("needsImageAnalysis"),
        F.lit(False).alias("needsThreadExpansion"),
        F.lit("tweet").alias("contentType"),
        F.lit("medium").alias("estimatedValue"),
        F.lit(None).cast("string").alias("skipReason"),
    )
    triage = posts.select("id", default.alias("triage"))
    arts = posts.where(T.blank_to_null("article_content").isNotNull()).select(
        F.col("id").alias("post_id"), F.lit(0).alias("pos"), F.lit("").alias("url"),
        F.lit(None).cast("string").alias("title"), F.col("article_content").alias("content"),
    )
    trs = posts.where(T.blank_to_null("youtube_transcript").isNotNull()).select(
        F.col("id").alias("post_id"), F.lit(0).alias("pos"), F.lit("").alias("url"), F.col("youtube_transcript").alias("transcript"),
    )
    imgs = posts.select(F.col("id").alias("post_id"), F.posexplode(F.coalesce("image_descriptions", F.array().cast("array<string>"))).alias("pos", "description")).withColumn("url", F.lit(""))
    texts = F.col("thread") if "thread" in posts.columns else F.array().cast("array<string>")
    threads = posts.select(F.col("id").alias("post_id"), F.posexplode(texts).alias("turn", "text"))
    return triage, arts, trs, imgs, threads


def prompt_stub_model(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in triage model for the pandas adapter: reads only the prompt
    text (links listed, images attached, thread note), a whole batch at a time,
    and answers with the triage JSON a model would return.  Swap in a real
    client with the same signature."""
    holds = {name: batch["prompt"].str.contains(mark, regex=False) for name, mark in _PROMPT_MARKS.items()}
    kind = pd.Series("tweet", index=batch.index).mask(holds["images"], "image_post").mask(holds["links"], "article_share")
    kind = kind.mask(holds["thread"], "thread")
    value = pd.Series("medium", index=batch.index).mask(holds["links"], "high")
    expand = holds["thread"].map({True: "true", False: "false"})
    lists = '{"needsArticleScrape":[],"needsYoutubeTranscript":[],"needsImageAnalysis":[],"needsThreadExpansion":'
    output = lists + expand + ',"contentType":"' + kind + '","estimatedValue":"' + value + '"}'
    return pd.DataFrame({"id": batch["id"], "output": output})


_PROMPT_MARKS = {"links": "LINKS FOUND:", "images": "image(s) attached", "thread": "part of a thread"}
