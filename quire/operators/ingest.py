"""Post ingestion: strict validation with a quarantine, normalisation, media
extraction, point lookup and the newest-N scan.

Validation reads each JSON text once as VARIANT and tests the JSON type of
every field (a numeric id is rejected, unlike `from_json`, which would coerce
it).  Rows that fail are diverted with a reason instead of being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import extract_urls, with_computed
from quire.functions.timefmt import parse_source_time
from quire.functions.urls import status_id

RAW_POST_SCHEMA = (
    "id STRING, text STRING, createdAt STRING, "
    "author STRUCT<username: STRING, name: STRING>, "
    "replyCount BIGINT, retweetCount BIGINT, likeCount BIGINT, "
    "conversationId STRING, inReplyToStatusId STRING, authorId STRING, "
    "media ARRAY<STRUCT<type: STRING, url: STRING, previewUrl: STRING, width: BIGINT, "
    "height: BIGINT, videoUrl: STRING, durationMs: BIGINT>>"
)

_NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _vtype(v: Column, path: str) -> Column:
    """JSON type of `path` in variant `v`: 'STRING', 'BIGINT', 'OBJECT<…>',
    'ARRAY<…>', 'VOID' for JSON null, SQL NULL when absent."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _is_number(t: Column) -> Column:
    return t.isin(*_NUMBER_TYPES) | t.startswith("DECIMAL")


def _optional(t: Column, ok: Column) -> Column:
    return t.isNull() | ok


def _media_item_ok(m: Column) -> Column:
    t = lambda p: _vtype(m, p)
    return (
        t("$").startswith("OBJECT")
        & (F.variant_get(m, "$.type", "string").isin(*fixed.MEDIA_TYPES))
        & (t("$.type") == "STRING")
        & (t("$.url") == "STRING")
        & _optional(t("$.previewUrl"), t("$.previewUrl") == "STRING")
        & _optional(t("$.width"), _is_number(t("$.width")))
        & _optional(t("$.height"), _is_number(t("$.height")))
        & _optional(t("$.videoUrl"), t("$.videoUrl") == "STRING")
        & _optional(t("$.durationMs"), _is_number(t("$.durationMs")))
    )


def rejection_reason(v: Column) -> Column:
    """First failed rule for one parsed post (VARIANT, NULL when the text was
    not JSON); NULL when valid."""
    t = lambda p: _vtype(v, p)
    media = F.try_variant_get(v, "$.media", "array<variant>")
    counts_ok = F.lit(True)
    for name in ("replyCount", "retweetCount", "likeCount"):
        counts_ok = counts_ok & _optional(t(f"$.{name}"), _is_number(t(f"$.{name}")))
    ids_ok = F.lit(True)
    for name in ("conversationId", "inReplyToStatusId", "authorId"):
        ids_ok = ids_ok & _optional(t(f"$.{name}"), t(f"$.{name}") == "STRING")
    return (
        F.when(v.isNull(), "malformed_json")
        .when(~t("$").startswith("OBJECT"), "not_object")
        .when(F.coalesce(t("$.id"), F.lit("")) != "STRING", "id")
        .when(F.coalesce(t("$.text"), F.lit("")) != "STRING", "text")
        .when(F.coalesce(t("$.createdAt"), F.lit("")) != "STRING", "createdAt")
        .when(
            ~F.coalesce(t("$.author").startswith("OBJECT"), F.lit(False))
            | (F.coalesce(t("$.author.username"), F.lit("")) != "STRING")
            | (F.coalesce(t("$.author.name"), F.lit("")) != "STRING"),
            "author",
        )
        .when(~counts_ok, "counts")
        .when(~ids_ok, "ids")
        .when(
            t("$.media").isNotNull()
            & (
                ~t("$.media").startswith("ARRAY")
                | F.coalesce(F.exists(media, lambda m: ~F.coalesce(_media_item_ok(m), F.lit(False))), F.lit(False))
            ),
            "media",
        )
    )


def split_valid(raw_df: DataFrame, raw_col: str = "raw", seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows parsed to the raw post struct, quarantine with reason).  The first action that
    reads the valid rows fills `seen` with the number of rejected ones."""
    # The parsed value is its own column so every field test reads it
    # instead of parsing the text again.
    parsed = with_computed(raw_df, F.try_parse_json(F.col(raw_col)), "__v")
    checked = parsed.withColumn("reason", rejection_reason(F.col("__v")))
    quarantine = checked.where(F.col("reason").isNotNull()).drop("__v")
    if seen is not None:
        checked = checked.observe(seen, F.count_if(F.col("reason").isNotNull()).alias("quarantined"))
    valid = (
        checked.where(F.col("reason").isNull())
        .withColumn("post", F.from_json(F.col(raw_col), RAW_POST_SCHEMA))
        .select("*", "post.*")
        .drop("post", "reason", "__v")
    )
    return valid, quarantine


def normalize_posts(raw: DataFrame) -> DataFrame:
    """Raw post columns -> post: author flattened, URL list (text URLs then
    video URLs), image list, thread flag (a thread root is not flagged)."""
    media = F.coalesce(F.col("media"), F.array())
    video_urls = F.transform(
        F.filter(
            media,
            lambda m: m["type"].isin("video", "animated_gif") & m["videoUrl"].isNotNull(),
        ),
        lambda m: m["videoUrl"],
    )
    images = F.transform(F.filter(media, lambda m: m["type"].isin(*fixed.MEDIA_TYPES)), lambda m: m["url"])
    conv = F.col("conversationId")
    return raw.select(
        F.col("id"),
        F.col("text"),
        F.col("author.username").alias("author_username"),
        F.col("author.name").alias("author_name"),
        F.col("createdAt").alias("created_at_raw"),
        parse_source_time(F.col("createdAt")).alias("created_at"),
        F.concat(extract_urls(F.col("text")), video_urls).alias("urls"),
        images.alias("images"),
        F.coalesce((conv != "") & (conv != F.col("id")), F.lit(False)).alias("is_thread"),
        conv.alias("conversation_id"),
    )


def ingest(raw_df: DataFrame, raw_col: str = "raw", seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON texts -> (normalised valid posts, quarantine)."""
    valid, quarantine = split_valid(raw_df, raw_col, seen)
    return normalize_posts(valid), quarantine


def read_bookmarks(spark, path: str) -> DataFrame:
    """Bookmark files: one JSON array or object per file.  Each file is read
    whole and its elements become rows, so the validator sees every element
    (an object file gives one row)."""
    files = spark.read.text(path, wholetext=True)
    v = F.try_parse_json(F.col("value"))
    elems = F.when(
        F.schema_of_variant(v).startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")
    ).otherwise(F.array(v))
    return files.select(F.explode(elems).alias("v")).select(F.to_json(F.col("v")).alias("raw"))


def _outside(bare: Column, parity: int) -> Column:
    """Characters of a piece outside strings, if `parity` quotes (mod 2) stand before it.
    `bare` has no escapes, so every second part between quotes is outside."""
    parts = F.split(bare, '"')
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")


def _rise(outside: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def split_bookmarks(spark, path: str) -> DataFrame:
    """Bookmark files of any size, each one JSON array or object: one row per element
    (`raw`), the same elements as `read_bookmarks` gives.

    A file is read by blocks, as pieces that end at `}`.  A piece alone doesn't say whether it
    starts inside a string, so its change of depth is counted for both cases.  Sums over the
    pieces of a block, and over the blocks of a file (few rows), give each piece the quotes and the
    depth before it.  An element ends where the depth falls to that of the file's top; its
    pieces are gathered by (file, element), so no task gets more than a block of pieces or
    one element.  Elements that aren't objects come with the object after them.  What can't be parsed
    comes as its text, for the quarantine; a blank file gives one null row; a broken
    file may be one element, as in `read_bookmarks`.
    """
    pieces = (
        spark.read.text(path, lineSep="}")
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("seq"), "value",
        )
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = with_computed(pieces, bare, "bare").select(
        "file", "block", "bytes", "seq", "value",
        ((F.size(F.split("bare", '"')) - 1) % 2).alias("quotes"),
        _rise(_outside(F.col("bare"), 0)).alias("rise0"),
        _rise(_outside(F.col("bare"), 1)).alias("rise1"),
        F.octet_length("value").alias("width"),
    )
    # the closing bracket itself counts where the piece ends outside a string
    turn = F.col("quotes")
    pieces = pieces.withColumn("rise0", F.col("rise0") - (turn == 0).cast("int")).withColumn(
        "rise1", F.col("rise1") - (turn == 1).cast("int")
    )
    inside = Window.partitionBy("file", "block").orderBy("seq")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = pieces.withColumn("q", zero(F.sum("quotes").over(before)) % 2)
    # depth changes of a piece if the block starts outside (up0) or inside (up1) a string
    p = p.withColumn("up0", F.when(F.col("q") == 0, F.col("rise0")).otherwise(F.col("rise1")))
    p = p.withColumn("up1", F.when(F.col("q") == 0, F.col("rise1")).otherwise(F.col("rise0")))
    blocks = p.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("quotes"), F.sum("up0").alias("up0"), F.sum("up1").alias("up1"),
        F.sum(F.col("width") + 1).alias("width"), F.max("seq").alias("last"),
        F.min_by("value", "seq").alias("head"),
    )
    files = Window.partitionBy("file").orderBy("block")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", zero(F.sum("quotes").over(earlier)) % 2)
    blocks = blocks.withColumn("up", F.when(F.col("start") == 0, F.col("up0")).otherwise(F.col("up1")))
    whole = Window.partitionBy("file")
    is_array = F.first("head").over(files.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select(
        "file", "block", "start", zero(F.sum("up").over(earlier)).alias("depth"),
        F.btrim(is_array, F.lit(" \t\r\n\ufeff")).startswith("[").cast("int").alias("top"),
        F.when(F.col("block") == F.max("block").over(whole), F.col("last")).alias("last"),
        F.sum("width").over(whole).alias("width"),
    )
    at = p.drop("width").join(blocks, ["file", "block"])
    at = at.withColumn("up", F.when(F.col("start") == 0, F.col("up0")).otherwise(F.col("up1")))
    at = at.withColumn("after", F.col("depth") + F.sum("up").over(inside))
    # the last piece has no closing bracket unless the file's bytes say so
    at = at.withColumn("open_end", F.coalesce(F.col("seq") == F.col("last"), F.lit(False)) & (F.col("width") > F.col("bytes")))
    at = at.withColumn("ends", ((F.col("after") <= F.col("top")) & ((F.col("start") + F.col("q") + turn) % 2 == 0) & ~F.col("open_end")).cast("int"))
    marks = at.groupBy("file", "block").agg(F.sum("ends").alias("n")).withColumn("first", zero(F.sum("n").over(earlier)))
    at = at.join(marks.drop("n"), ["file", "block"]).withColumn("element", F.col("first") + zero(F.sum("ends").over(before)))
    text = F.concat("value", F.when(F.col("open_end"), "").otherwise("}"))
    whole_text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", text.alias("text")))), lambda x: x["text"]), ""
    )
    elements = at.groupBy("file", "element").agg(whole_text.alias("text"), F.first("top").alias("top"), F.max("open_end").alias("tail"))
    edge = F.regexp_replace("text", r"\A[\s\ufeff]*[\[,]?\s*", "")
    inner = F.when(F.col("top") == 0, F.col("text")).when(F.col("tail"), F.regexp_replace(edge, r"\]?\s*\z", "")).otherwise(edge)
    elements = with_computed(elements, inner, "inner").where(
        (F.btrim("inner", F.lit(" \t\r\n")) != "") | ((F.col("top") == 0) & (F.col("element") == 0))
    )
    listed = F.variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("inner"), F.lit("]"))), "$", "array<variant>")
    raws = F.coalesce(
        F.transform(listed, lambda v: F.to_json(v)),
        F.when(F.btrim("inner", F.lit(" \t\r\n")) == "", F.array(F.lit(None).cast("string"))).otherwise(F.array("inner")),
    )
    return elements.select(F.explode(raws).alias("raw"))


def read_bookmark_lines(spark, path: str) -> DataFrame:
    """Bookmark files with one JSON post per line: split across tasks by
    file blocks, so a large backfill is read in parallel (large files in the array form are
    read by `split_bookmarks`)."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.col("value").alias("raw"))


def read_captions(spark, path: str) -> DataFrame:
    """Caption files under `path`, each read whole: (video_id, vtt).  The id is
    the file name before its first dot (`<id>.en.vtt`, `<id>.vtt`); in a folder
    `video_id=<id>` the folder names it.  Blank files give no row."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    folder = F.regexp_extract(where, r"/video_id=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(where, r"([^/.]+)[^/]*$", 1)
    return files.where(F.trim("value") != "").select(
        F.when(folder != "", folder).otherwise(name).alias("video_id"), F.col("value").alias("vtt")
    )


def read_caption_lines(spark, path: str) -> DataFrame:
    """Captions stored as JSON lines of (video_id, vtt), many videos a file: the
    number of files doesn't grow with that of the videos.  Blank captions give no row."""
    rows = spark.read.schema("video_id string, vtt string").json(path)
    return rows.where(F.trim("vtt") != "")


# --- media extraction from the source's raw entities ---------------------------


def extract_media(entities: DataFrame) -> DataFrame:
    """Raw media entities -> media items.

    `extended_media` wins over `basic_media` when it is not NULL (an empty
    extended list therefore yields nothing).  Size from `large`, else
    `medium`; preview when a `small` size exists; for video and GIF the mp4
    variant with the highest bitrate (first one on ties) and the duration.
    """
    raw = F.coalesce(F.col("extended_media"), F.col("basic_media"))
    items = F.filter(raw, lambda m: m["type"].isNotNull() & m["media_url_https"].isNotNull())

    def best_mp4(m):
        mp4 = F.filter(
            m["video_info"]["variants"],
            lambda v: (v["content_type"] == "video/mp4") & v["bitrate"].isNotNull() & v["url"].isNotNull(),
        )
        # array_sort keeps equal elements in input order, so ties keep the first.
        ordered = F.array_sort(
            mp4,
            lambda a, b: F.when(a["bitrate"] > b["bitrate"], -1)
            .when(a["bitrate"] < b["bitrate"], 1)
            .otherwise(0),
        )
        return F.get(ordered, 0)["url"]

    def to_item(m):
        is_motion = m["type"].isin("video", "animated_gif") & m["video_info"]["variants"].isNotNull()
        size = F.coalesce(m["sizes"]["large"], m["sizes"]["medium"])
        duration = m["video_info"]["duration_millis"]
        return F.struct(
            m["type"].alias("type"),
            m["media_url_https"].alias("url"),
            F.when(m["sizes"]["small"].isNotNull(), F.concat(m["media_url_https"], F.lit(":small"))).alias(
                "previewUrl"
            ),
            size["w"].alias("width"),
            size["h"].alias("height"),
            F.when(is_motion, best_mp4(m)).alias("videoUrl"),
            F.when(is_motion & (F.coalesce(duration, F.lit(0)) != 0), duration).alias("durationMs"),
        )

    media = F.transform(items, to_item)
    return entities.select(
        "post_id", F.when(F.size(media) > 0, media).alias("media")
    )


# --- lookups and scans ---------------------------------------------------------


def lookup_posts(posts: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Point lookup by id or post URL, for a whole set of keys at once: the
    part after `/status/`, or the whole key, is the id; a semi-join keeps matching posts
    (the key side is deduplicated by the join itself)."""
    ids = keys.select(status_id(F.col(key_col)).alias("id")).where(F.col("id").isNotNull())
    return posts.join(ids, "id", "left_semi")


def newest(posts: DataFrame, n: int) -> DataFrame:
    """First `n` posts as the source returns them (newest first).  A top-k:
    each partition keeps its best n before the single merge."""
    return posts.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def first_per_id(posts: DataFrame, order_col: str) -> DataFrame:
    """Batch duplicates: keep the first occurrence of each id by `order_col`
    (deterministic, unlike dropDuplicates)."""
    best = posts.groupBy("id").agg(F.min(order_col).alias(order_col))
    return posts.join(best, ["id", order_col], "left_semi")


def first_of_batch(posts: DataFrame) -> DataFrame:
    """One row per id: the newest (the source lists newest first), ties by
    content, so a rerun keeps the same row."""
    order = F.struct("created_at", F.xxhash64(*posts.columns))
    return posts.groupBy("id").agg(F.max_by(F.struct(*posts.columns), order).alias("post")).select("post.*")


def post_text(article_text: Column, note_text: Column, full_text: Column) -> Column:
    """Post text: long-form article text, else long-note text, else the
    plain text (first one present; empty strings count as present)."""
    return F.coalesce(article_text, note_text, full_text)
