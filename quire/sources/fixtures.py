"""Views over the given tables that stand in for the application's inputs.

The test data has no bookmarks, ledger or transcripts, so each input is
derived from a stored table by a fixed rule (the same rules appear as SQL in
`quire.plans.oracle`).  Every view grows with its source table.

* ledger rows / versions  <- events   (one row per event / key = user)
* posts                   <- pages JOIN documents, and conversations
* raw post JSON           <- the same, with rule-based broken rows
* transcripts (VTT)       <- pages JOIN documents (video id = md5 prefix)
* video info              <- documents
* errors                  <- events of type error
* published pages         <- posts with labels.quality = 1
* raw media entities      <- pages
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ingest import normalize_posts
from quire.sources.tables import read

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z
MEDIA_HOST = "https://pbs.example.com/media/"
VIDEO_HOST = "https://video.example.com/"
WATCH_PREFIX = "https://www.youtube.com/watch?v="

def _status_of_event() -> F.Column:
    return (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "processing")
        .otherwise("completed")
    )


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _raw_data() -> F.Column:
    """Stored analysis JSON: regular rows, rows with string tags and a string
    score, and rows that are not JSON at all."""
    k = F.col("k")
    good = F.format_string(
        '{"analysis":{"summary":"%s note %d","tags":["k%d","g%d"],"relevanceScore":%d}}',
        "event_type", "event_id", k, k % 7, 1 + k % 10,
    )
    stringy = F.format_string(
        '{"analysis":{"summary":"%s note %d","tags":"k%d","relevanceScore":"%d"}}',
        "event_type", "event_id", k, 1 + k % 10,
    )
    return F.when(k % 25 == 13, F.lit("not valid json")).when(k % 25 == 7, stringy).otherwise(good)


def _ledger_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_k(read(spark, sf_dir, "events"))


def _with_k(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", "ts", "user_id", "event_type", "props").withColumn("k", _k())


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per event (post id = event id)."""
    return ledger_rows_of(read(spark, sf_dir, "events"))


def ledger_rows_of(events: DataFrame) -> DataFrame:
    """Ledger rows from an events DataFrame (batch or streaming)."""
    return _with_k(events).select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("ts").cast("timestamp").alias("processed_at"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type").isin("purchase", "view"), F.concat(F.lit("page-"), F.col("event_id").cast("string"))).alias("page_id"),
        _raw_data().alias("raw_data"),
        _status_of_event().alias("status"),
        F.col("event_id").alias("version"),
    )


def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger versions keyed by user: every event is a new version of the
    row for its user (version = event id)."""
    return _ledger_base(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("post_id"),
        F.col("ts").cast("timestamp").alias("processed_at"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type").isin("purchase", "view"), F.concat(F.lit("page-"), F.col("event_id").cast("string"))).alias("page_id"),
        _raw_data().alias("raw_data"),
        _status_of_event().alias("status"),
        F.col("event_id").alias("version"),
    )


# --- posts ----------------------------------------------------------------------


def _page_docs(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    if pages is None:
        pages = read(spark, sf_dir, "pages")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return pages.select("page_id", "url").join(docs, F.col("page_id") == F.col("doc_id"))


def _page_media(page_id: F.Column) -> F.Column:
    pid = page_id.cast("string")
    photo = F.struct(
        F.lit("photo").alias("type"),
        F.concat(F.lit(MEDIA_HOST), pid, F.lit(".jpg")).alias("url"),
        F.lit(None).cast("string").alias("videoUrl"),
        F.lit(None).cast("bigint").alias("durationMs"),
    )
    video = F.struct(
        F.lit("video").alias("type"),
        F.concat(F.lit(MEDIA_HOST), pid, F.lit(".jpg")).alias("url"),
        F.concat(F.lit(VIDEO_HOST), pid, F.lit(".mp4")).alias("videoUrl"),
        (page_id * 1000).alias("durationMs"),
    )
    return F.when(page_id % 3 == 1, F.array(photo)).when(page_id % 3 == 2, F.array(video))


def _page_post_struct(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    pd = _page_docs(spark, sf_dir, pages)
    video = F.when(
        F.col("lang") == "de", F.concat(F.lit(" " + WATCH_PREFIX), F.substring(F.md5("url"), 1, 11))
    ).otherwise(F.lit(""))
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("page_id") * 3600)
    return pd.select(
        "page_id",
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.col("text"), F.lit(" "), F.col("url"), video).alias("text"),
        F.when(F.col("page_id") % 2 == 0, F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(created, "EEE MMM dd HH:mm:ss Z yyyy"))
        .alias("createdAt"),
        F.struct(F.col("source").alias("username"), F.upper("source").alias("name")).alias("author"),
        F.col("doc_id").cast("string").alias("conversationId"),
        _page_media(F.col("page_id")).alias("media"),
    )


def posts_pages(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Posts made from pages joined with documents: the page URL (and, for
    German documents, a video link) is appended to the document text.
    `pages` may be a stream of page rows (stream-static join)."""
    return normalize_posts(_page_post_struct(spark, sf_dir, pages))


def answered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts with up to six images, and the analysis a model gives of
    each as JSON (`output`): up to ten tags, all lines as insights, quotes for
    even ids, up to seven links; one in twenty names an unknown category."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    name = n.cast("string")
    numbers = lambda k: F.when(n % k > 0, F.sequence(F.lit(1), (n % k).cast("int"))).otherwise(F.array().cast("array<int>"))
    kinds = F.array(*[F.lit(x) for x in ("tool", "repo", "article", "video", "docs")])
    link = lambda i: F.struct(
        F.concat(F.lit("https://www.example.com/"), name, F.lit("/"), i).alias("url"), F.concat(F.lit("link "), i).alias("title"),
        F.get(kinds, i % 5).alias("type"), F.lit("").alias("description"),
    )
    lines = F.array_remove(F.split(text, "\n"), "")
    answer = F.struct(
        F.when(n % 20 == 13, "misc").when(n % 3 == 0, "article").when(n % 3 == 1, "video").otherwise("knowledge").alias("category"),
        F.when(n % 5 == 0, F.coalesce(F.get(lines, 0), F.lit(""))).otherwise(text).alias("topic"),
        text.alias("summary"), text.alias("tldr"), F.concat(text, text).alias("forYou"), F.lit("Read").alias("topAction"),
        F.lit(False).alias("hasArticle"), F.lit(False).alias("hasVideo"), F.lit(False).alias("hasThread"),
        lines.alias("keyInsights"), F.when(n % 2 == 0, lines).otherwise(F.array().cast("array<string>")).alias("quotes"),
        F.transform(numbers(8), link).alias("extractedLinks"),
        F.transform(numbers(11), lambda i: F.concat_ws("-", F.coalesce("lang", F.lit("any")), name, i.cast("string"))).alias("tags"),
        (1 + n % 10).cast("double").alias("relevanceScore"),
        F.array(F.struct(F.lit("Read").alias("action"), F.when(n % 4 == 1, "now").when(n % 4 == 2, "this-week").otherwise("someday").alias("priority"))).alias("actionItems"),
    )
    image = lambda i: F.concat(F.lit("https://img.example.com/"), name, F.lit("/"), i, F.lit(".jpg"))
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").select(
        name.alias("id"), text.alias("text"), F.coalesce("source", F.lit("nobody")).alias("author_username"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + n).alias("created_at"), F.transform(numbers(7), image).alias("images"),
        F.when(n % 6 == 0, text).otherwise(none).alias("youtube_transcript"), F.when(n % 9 == 0, text).otherwise(none).alias("article_content"),
        F.lit(None).cast("array<string>").alias("image_descriptions"), F.to_json(answer).alias("output"),
    )


def raw_posts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts as JSON texts, with rule-based broken rows: numeric id
    (page_id % 10 = 3), no author (% 10 = 7), unknown media type (% 20 = 11),
    cut-off JSON (% 50 = 29)."""
    s = _page_post_struct(spark, sf_dir)
    pid = F.col("page_id")
    sticker = F.array(F.struct(F.lit("sticker").alias("type"), F.lit(MEDIA_HOST + "s.webp").alias("url")))
    good = F.to_json(F.struct("id", "text", "createdAt", "author", "conversationId", "media"))
    numeric_id = F.to_json(F.struct(pid.alias("id"), "text", "createdAt", "author", "conversationId", "media"))
    no_author = F.to_json(F.struct("id", "text", "createdAt", "conversationId", "media"))
    bad_media = F.to_json(F.struct("id", "text", "createdAt", "author", "conversationId", sticker.alias("media")))
    raw = (
        F.when(pid % 50 == 29, F.substring(good, 1, 20))
        .when(pid % 20 == 11, bad_media)
        .when(pid % 10 == 3, numeric_id)
        .when(pid % 10 == 7, no_author)
        .otherwise(good)
    )
    return s.select("page_id", raw.alias("raw"))


def raw_posts_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw post JSON: id `conv-turn`, conversation id
    `conv-0`; system turns carry no author and therefore fail validation."""
    c = read(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    post_id = F.concat(cid, F.lit("-"), F.col("turn").cast("string"))
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    author = F.when(
        F.col("role") != "system", F.struct(F.col("role").alias("username"), F.initcap("role").alias("name"))
    )
    return c.select(
        "conv_id",
        "turn",
        "text",
        F.to_json(
            F.struct(
                post_id.alias("id"),
                F.col("text"),
                F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"),
                author.alias("author"),
                F.concat(cid, F.lit("-0")).alias("conversationId"),
            )
        ).alias("raw"),
    )


# --- enrichment sources ----------------------------------------------------------


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored caption files: one VTT per page, video id = first 11 hex
    characters of md5(url).  Each document line becomes a numbered cue whose
    text is tagged and then repeated, as auto-captions do."""
    pd = _page_docs(spark, sf_dir)
    cues = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(
            (i + 1).cast("string"),
            F.lit("\n00:00:01.000 --> 00:00:02.000\n<v S>"),
            l,
            F.lit("</v>\n"),
            l,
        ),
    )
    vtt = F.concat(
        F.lit("WEBVTT\nKind: captions\nLanguage: "), F.col("lang"), F.lit("\n\n"), F.array_join(cues, "\n\n")
    )
    return pd.select(F.substring(F.md5("url"), 1, 11).alias("video_id"), vtt.alias("vtt"))


def video_info_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed `title|||description|||duration` per video, with durations in
    several shapes (plain, padded with a unit, not a number, fractional)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    n = F.col("n_chars").cast("string")
    duration = (
        F.when(F.col("doc_id") % 4 == 0, n)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" "), n, F.lit("s")))
        .when(F.col("doc_id") % 4 == 2, F.lit("n/a"))
        .otherwise(F.concat(n, F.lit(".5")))
    )
    info = F.concat_ws("|||", F.col("text"), F.col("lang"), duration)
    return d.select(
        F.substring(F.md5(F.col("doc_id").cast("string")), 1, 11).alias("video_id"),
        F.concat(info, F.lit("\n")).alias("printed"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures raised while polling: error events, message by rule, and
    whether the user's login was still valid when the alert was routed."""
    ev = _ledger_base(spark, sf_dir).where(F.col("event_type") == "error")
    k = F.col("k")
    msg = (
        F.when(k % 4 == 0, F.lit("rate limit exceeded 429"))
        .when(k % 4 == 1, F.lit("connect ETIMEDOUT <proxy & dns>"))
        .when(k % 4 == 2, F.lit('unknown command "bookmarks"'))
        .otherwise(F.lit("HTTP 429 from upstream"))
    )
    return ev.select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        msg.alias("raw_message"),
        (k % 3 != 0).alias("from_source"),
        (F.col("user_id") % 5 != 0).alias("auth_valid"),
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages already in the published table: posts whose document has
    quality 1, identified by their post URL."""
    posts = posts_pages(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").where(F.col("quality") == 1).select(F.col("doc_id").cast("string").alias("id"))
    return posts.join(labels, "id", "left_semi").select(
        F.concat(F.lit("https://x.com/"), F.col("author_username"), F.lit("/status/"), F.col("id")).alias("post_url"),
        F.sha2(F.col("id"), 256).alias("page_id"),
    )


def raw_media_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw media entities per page in the source's API shape."""
    p = read(spark, sf_dir, "pages").select("page_id")
    pid = F.col("page_id")
    base = F.concat(F.lit(VIDEO_HOST), pid.cast("string"))
    mtype = F.when(pid % 3 == 0, "photo").when(pid % 3 == 1, "video").otherwise("animated_gif")

    def size(w):
        return F.struct(w.alias("w"), (w / 2).cast("bigint").alias("h"))

    sizes = F.struct(
        F.when(pid % 2 == 0, size(1000 + pid % 100)).alias("large"),
        size(600 + pid % 50).alias("medium"),
        F.when(pid % 5 != 0, size(340 + pid % 10)).alias("small"),
    )

    def variant(bitrate, ctype, suffix):
        return F.struct(
            bitrate.cast("bigint").alias("bitrate"),
            F.lit(ctype).alias("content_type"),
            F.concat(base, F.lit(suffix)).alias("url"),
        )

    variants = F.array(
        variant((pid % 4) * 1000, "video/mp4", "/a.mp4"),
        variant(F.lit(None), "application/x-mpegURL", "/pl.m3u8"),
        variant((pid % 3) * 1000 + 1000, "video/mp4", "/b.mp4"),
        variant(F.lit(2000), "video/mp4", "/c.mp4"),
    )
    item = F.struct(
        mtype.alias("type"),
        F.concat(F.lit(MEDIA_HOST), pid.cast("string"), F.lit(".jpg")).alias("media_url_https"),
        sizes.alias("sizes"),
        F.when(pid % 3 != 0, F.struct((pid * 1000).alias("duration_millis"), variants.alias("variants"))).alias(
            "video_info"
        ),
    )
    basic = F.array(item)
    extended = F.when(pid % 11 == 5, F.filter(F.array(item), lambda x: F.lit(False))).when(pid % 7 != 3, F.array(item))
    return p.select(F.col("page_id").cast("string").alias("post_id"), extended.alias("extended_media"), basic.alias("basic_media"))


def conversation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread members with their validation result (conversation id, member
    id, turn, text, valid)."""
    from quire.operators.ingest import rejection_reason

    raw = raw_posts_conversations(spark, sf_dir).withColumn("__v", F.try_parse_json("raw"))
    checked = raw.select("conv_id", "turn", "text", "raw", rejection_reason(F.col("__v")).isNull().alias("valid"))
    return checked.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-0")).alias("conversation_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("member_id"),
        "conv_id",
        "turn",
        "text",
        "valid",
        "raw",
    )


def conversation_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved posts from conversations: the newest turn of each conversation,
    when it is a valid post."""
    from quire.operators.ingest import ingest

    turns = raw_posts_conversations(spark, sf_dir)
    newest = turns.groupBy("conv_id").agg(F.max_by("raw", F.struct("turn", "raw")).alias("raw")).select("raw")
    posts, _ = ingest(newest)
    return posts


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored image descriptions: the rule image model over every extracted
    media item, validated and rendered."""
    from quire.operators.inference import image_texts as render, rule_image_model
    from quire.operators.ingest import extract_media

    media = extract_media(raw_media_entities(spark, sf_dir)).select(F.explode("media").alias("m")).select("m.*")
    return render(rule_image_model(media))


# --- streams ------------------------------------------------------------------------


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as they are saved (id, created_at = time of the save): every page at
    its hour, every third again an hour later, every fifth again 200 hours later."""
    p = read(spark, sf_dir, "pages").select("page_id")
    hours = F.array_compact(
        F.array(F.lit(0), F.when(F.col("page_id") % 3 == 0, F.lit(1)), F.when(F.col("page_id") % 5 == 0, F.lit(200)))
    )
    return p.select("page_id", F.explode(hours).alias("h")).select(
        F.col("page_id").cast("string").alias("id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + (F.col("page_id") + F.col("h")) * 3600).alias("created_at"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time they come in: their own, but 15 days later for every
    twentieth."""
    late = F.when(F.col("event_id") % 20 == 0, F.expr("interval 15 days")).otherwise(F.expr("interval 0 days"))
    return read(spark, sf_dir, "events").withColumn("arrived", F.col("ts") + late)
