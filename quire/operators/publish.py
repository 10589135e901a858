"""Publishing: the published-table projection, page blocks, de-duplication
against what is already published, the publish backlog, and the sinks.

Page ids are `sha2(post_id)`, so re-running a batch rewrites the same pages;
the page sink replaces only the folder of the batch it writes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.functions import urls as U
from quire.functions.timefmt import iso

PUBLISHED_COLUMNS = (
    "post_id STRING, page_id STRING, topic STRING, score DOUBLE, score_visual STRING, author STRING, category STRING, "
    "for_you STRING, priority STRING, top_action STRING, primary_link STRING, has_article BOOLEAN, "
    "has_video BOOLEAN, has_thread BOOLEAN, tldr STRING, summary STRING, tags ARRAY<STRING>, "
    "post_url STRING, created_at STRING, processed_at STRING"
)


def ensure_published_table(spark: SparkSession, name: str, path: str) -> bool:
    """Get or create the published table over `path`; True when it already
    existed.  It is partitioned as `write_pages` writes it, one folder a batch."""
    existed = spark.catalog.tableExists(name)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({PUBLISHED_COLUMNS}, batch_id BIGINT) USING parquet "
        f"PARTITIONED BY (batch_id) LOCATION '{path}'"
    )
    return existed


def top_priority(actions: Column) -> Column:
    """First action's priority, else `someday`."""
    return F.coalesce(T.blank_to_null(F.get(actions, 0)["priority"]), F.lit(fixed.DEFAULT_PRIORITY))


def publish_rows(posts: DataFrame, analyses: DataFrame, processed_at: dt.datetime) -> DataFrame:
    """One published row per analysed post (17 written columns and the
    score band).  `analyses` has `id`, `analysis` and the merged flags."""
    a = F.col("analysis")
    df = posts.join(analyses, "id")
    return df.select(
        F.col("id").alias("post_id"),
        F.sha2(F.col("id"), 256).alias("page_id"),
        T.truncate(F.coalesce(T.first_present(a["topic"], a["tldr"]), a["summary"]), fixed.TOPIC_WIDTH).alias("topic"),
        a["relevanceScore"].alias("score"),
        T.score_marks(a["relevanceScore"]).alias("score_visual"),
        F.concat(F.lit("@"), F.col("author_username")).alias("author"),
        a["category"].alias("category"),
        T.truncate(F.coalesce(a["forYou"], F.lit("")), fixed.FOR_YOU_WIDTH).alias("for_you"),
        top_priority(a["actionItems"]).alias("priority"),
        T.truncate(F.coalesce(a["topAction"], F.lit("")), fixed.TOP_ACTION_WIDTH).alias("top_action"),
        T.blank_to_null(a["primaryLink"]).alias("primary_link"),
        F.coalesce("has_article", F.lit(False)).alias("has_article"),
        F.coalesce("has_video", F.lit(False)).alias("has_video"),
        F.coalesce("has_thread", F.lit(False)).alias("has_thread"),
        T.truncate(F.coalesce(a["tldr"], F.lit("")), fixed.TLDR_WIDTH).alias("tldr"),
        T.truncate(a["summary"], fixed.SUMMARY_WIDTH).alias("summary"),
        F.slice(a["tags"], 1, fixed.MAX_TAGS).alias("tags"),
        U.post_url("author_username", "id").alias("post_url"),
        iso("created_at").alias("created_at"),
        iso(F.lit(processed_at).cast("timestamp")).alias("processed_at"),
    )


def published_ids(published: DataFrame) -> DataFrame:
    """Post ids of published pages, taken from their post URL (an equi-join
    key, not a substring match)."""
    return published.select(
        F.regexp_extract("post_url", r"/status/([^/?#]+)", 1).alias("id")
    ).where(F.col("id") != "").distinct()


def split_published(posts: DataFrame, published: DataFrame) -> DataFrame:
    """posts + `already_published` (left join on distinct published ids)."""
    ids = published_ids(published).withColumn("already_published", F.lit(True))
    return posts.join(ids, "id", "left").withColumn(
        "already_published", F.coalesce("already_published", F.lit(False))
    )


def backlog(cur: DataFrame) -> DataFrame:
    """Completed rows without a page (publish failed or skipped): a
    re-publish candidate list."""
    return cur.where((F.coalesce("status", F.lit("completed")) == "completed") & F.col("page_id").isNull())


def _block(kind: str, text: Column | None = None, url: Column | None = None, detail: Column | None = None) -> Column:
    s = lambda c: c if c is not None else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), s(text).alias("text"), s(url).alias("url"), s(detail).alias("detail"))


def _link_icon(t: Column) -> Column:
    icon = F.lit(fixed.LINK_ICON_DEFAULT)
    for kind, mark in reversed(list(fixed.LINK_ICONS.items())):
        icon = F.when(t == kind, F.lit(mark)).otherwise(icon)
    return icon


def page_blocks(posts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Ordered content blocks of each page, in long form
    (post_id, block_no, type, text, url, detail)."""
    a = F.col("analysis")
    df = posts.join(analyses, "id")
    url = U.post_url("author_username", "id")
    header = F.concat(
        T.score_marks(a["relevanceScore"]), F.lit(" "), T.js_number(a["relevanceScore"]), F.lit("/10 • @"),
        F.col("author_username"), F.lit(" • "), a["category"],
    )
    none = F.array().cast("array<struct<type:string,text:string,url:string,detail:string>>")

    def opt(cond: Column, block: Column) -> Column:
        return F.when(cond, F.array(block)).otherwise(none)

    quotes = F.coalesce(a["quotes"], F.array().cast("array<string>"))
    extras = F.concat(
        opt(F.size(quotes) > 0, _block("toggle", F.lit("💎 Quotes"), detail=T.truncate(F.array_join(quotes, "\n\n"), fixed.TOGGLE_WIDTH))),
        opt(T.blank_to_null("youtube_transcript").isNotNull(), _block("toggle", F.lit("🎬 Transcript"), detail=T.truncate("youtube_transcript", fixed.TOGGLE_WIDTH))),
        opt(T.blank_to_null("article_content").isNotNull(), _block("toggle", F.lit("📄 Article"), detail=T.truncate("article_content", fixed.TOGGLE_WIDTH))),
    )
    blocks = F.concat(
        F.array(_block("paragraph", header, url), _block("paragraph", a["summary"])),
        opt(T.blank_to_null(a["forYou"]).isNotNull(), _block("paragraph", F.concat(F.lit("💡 "), a["forYou"]))),
        F.array(_block("divider"), _block("quote", T.truncate("text", fixed.QUOTE_WIDTH))),
        F.transform(F.slice("images", 1, fixed.MAX_IMAGES), lambda u: _block("image", url=u)),
        opt(T.blank_to_null(a["primaryLink"]).isNotNull(), _block("paragraph", F.concat(F.lit("🔗 "), a["primaryLink"]), a["primaryLink"])),
        F.transform(F.slice(F.coalesce(a["keyInsights"], F.array().cast("array<string>")), 1, fixed.MAX_INSIGHTS), lambda s: _block("bulleted_list_item", s)),
        F.transform(
            F.slice(F.coalesce(a["extractedLinks"], F.array().cast("array<struct<url:string,title:string,type:string,description:string>>")), 1, fixed.MAX_LINKS),
            lambda l: _block("bulleted_list_item", F.concat(_link_icon(l["type"]), F.lit(" "), l["title"]), l["url"]),
        ),
        extras,
    )
    return df.select(F.col("id").alias("post_id"), F.posexplode(blocks).alias("block_no", "b")).select(
        "post_id", F.col("block_no").cast("bigint").alias("block_no"),
        F.col("b.type").alias("block_type"), F.col("b.text").alias("text"), F.col("b.url").alias("url"),
        F.col("b.detail").alias("detail"),
    )


def write_pages(rows: DataFrame, path: str, batch_id: int) -> None:
    """Page sink: one folder per batch; a rerun of the batch replaces it
    whole, also when a category changed or no page is left."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
