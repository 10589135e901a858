"""Ledger statistics: trailing-week slice, counts by category, top tags,
highlights, the combined weekly report, lifetime stats and health.

Plan shape: the week filter is a literal bound on `processed_at`, so it
reaches the parquet scan (row-group skipping; partition pruning on a
date-partitioned ledger).  Counts are partial + final hash aggregates, and
both top-k lists are `TakeOrderedAndProject` (each task keeps its best k,
one merge of k x tasks rows), so no step moves more than one row per group
per task to a single place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import with_computed
from quire.functions.timefmt import iso


def parse_analysis(raw: Column) -> Column:
    """Tolerant read of the stored analysis JSON: tags (NULL unless an array
    of strings), score (numbers and numeric strings, as `>=` coerces them in
    the source) and summary.  Malformed JSON gives NULL fields."""
    v = F.try_parse_json(raw)
    return F.struct(
        F.try_variant_get(v, "$.analysis.tags", "array<string>").alias("tags"),
        F.try_variant_get(v, "$.analysis.relevanceScore", "double").alias("score"),
        F.try_variant_get(v, "$.analysis.summary", "string").alias("summary"),
    )


def latest_time(ledger: DataFrame) -> dt.datetime:
    """Default `as_of`: newest `processed_at` (one scalar aggregate)."""
    return ledger.agg(F.max("processed_at")).first()[0]


def week_slice(ledger: DataFrame, as_of: dt.datetime | None = None, days: int = fixed.WEEK_DAYS) -> DataFrame:
    """Rows processed in the `days` before `as_of` (inclusive bound)."""
    if as_of is None:
        as_of = latest_time(ledger)
    lower = as_of - dt.timedelta(days=days)
    return ledger.where(F.col("processed_at") >= F.lit(lower))


def by_category(rows: DataFrame) -> DataFrame:
    """Counts every row, readable JSON or not, whatever its status."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _parsed(rows: DataFrame, *cols: str) -> DataFrame:
    """rows + parsed analysis `a`, parsed once per row (filters inferred from
    later generators or predicates stay above the parse)."""
    return with_computed(rows.select(*cols, "raw_data"), parse_analysis(F.col("raw_data")), "a").drop("raw_data")


def _tag_rows(rows: DataFrame) -> DataFrame:
    parsed = _parsed(rows, "post_id", "processed_at")
    return parsed.select("post_id", "processed_at", F.posexplode("a.tags").alias("pos", "tag"))


def top_tags(rows: DataFrame, k: int = fixed.TOP_TAGS) -> DataFrame:
    """Most used tags; ties keep the order in which a newest-first scan of
    the rows meets each tag first (then the tag itself)."""
    counted = _tag_rows(rows).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("processed_at", "post_id", (-F.col("pos")).alias("neg_pos"))).alias("first_seen"),
    )
    order = [F.col("n").desc(), F.col("first_seen").desc(), F.col("tag")]
    top = counted.orderBy(*order).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "tag", "n"
    )


def highlights(rows: DataFrame, k: int = fixed.TOP_HIGHLIGHTS) -> DataFrame:
    """The k newest rows whose score is at least 8 (not the k best)."""
    scored = _parsed(rows, "post_id", "processed_at", "category").select(
        "post_id", "processed_at", "category", F.col("a.score").alias("score"), F.col("a.summary").alias("summary")
    ).where(F.col("score") >= fixed.HIGHLIGHT_SCORE)
    order = [F.col("processed_at").desc(), F.col("post_id").desc()]
    top = scored.orderBy(*order).limit(k)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "post_id",
        F.coalesce("summary", F.lit("")).alias("summary"),
        "category",
        iso("processed_at").alias("processed_at"),
    )


def category_map_json(counts: Column) -> Column:
    """collect_list(struct(category, n)) -> `{"cat": n, ...}` sorted by key."""
    return F.to_json(F.map_from_entries(F.array_sort(counts)))


def weekly_report(ledger: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """One row: total, counts by category, top tags, highlights.

    The three parts are small (<= categories, 10, 10 rows); they are put in
    one long table and folded by a single global aggregate, not joined.
    """
    rows = week_slice(ledger, as_of)
    cats = by_category(rows).select(
        F.lit("cat").alias("kind"), F.lit(None).cast("bigint").alias("rank"),
        F.col("category").alias("key"), "n",
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("category"),
    )
    tags = top_tags(rows).select(
        F.lit("tag").alias("kind"), "rank", F.col("tag").alias("key"), "n",
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("category"),
    )
    hls = highlights(rows).select(
        F.lit("hl").alias("kind"), "rank", F.col("post_id").alias("key"), F.lit(None).cast("bigint").alias("n"),
        "summary", "category",
    )
    parts = cats.unionByName(tags).unionByName(hls)
    kind = F.col("kind")
    return parts.agg(
        F.coalesce(F.sum(F.when(kind == "cat", F.col("n"))), F.lit(0)).cast("bigint").alias("total_processed"),
        category_map_json(F.collect_list(F.when(kind == "cat", F.struct(F.col("key"), F.col("n"))))).alias(
            "by_category"
        ),
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.when(kind == "tag", F.struct("rank", "key", "n")))),
                lambda x: F.struct(x["key"].alias("tag"), x["n"].alias("count")),
            )
        ).alias("top_tags"),
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.when(kind == "hl", F.struct("rank", "key", "summary", "category")))),
                lambda x: F.struct(
                    x["key"].alias("tweetId"), x["summary"].alias("summary"), x["category"].alias("category")
                ),
            )
        ).alias("highlights"),
    )


def lifetime_stats(ledger: DataFrame) -> DataFrame:
    """Total rows and counts by category over the whole ledger (one row)."""
    cats = by_category(ledger)
    return cats.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        category_map_json(F.collect_list(F.struct("category", "n"))).alias("by_category"),
    )


def health(ledger: DataFrame) -> DataFrame:
    """Readability check: row count, counts by status, newest row."""
    st = F.coalesce(F.col("status"), F.lit("completed"))
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == "completed").alias("n_completed"),
        F.count_if(st == "processing").alias("n_processing"),
        F.count_if(st == "failed").alias("n_failed"),
        iso(F.max("processed_at")).alias("latest_processed_at"),
    )


def run_counters(flags: DataFrame) -> DataFrame:
    """Run totals from per-post flags (one aggregate, no driver loop)."""
    return flags.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(F.col("blocked")).alias("skipped"),
        F.count_if(~F.col("blocked")).alias("claimed"),
        F.count_if(~F.col("blocked") & F.col("triage_skip")).alias("triage_skipped"),
        F.count_if(~F.col("blocked") & ~F.col("triage_skip")).alias("analysed"),
    )
