"""Weekly digest: a model (rule model by default) over the week's counts and
highlights, Markdown rendering, and the message outbox.

The digest input is one small row (counts per category, at most ten
highlights); everything before it is distributed (see `stats`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.functions.transcript import chunk_lines
from quire.operators import inference, stats
from quire.session import stage


def digest_input(rows: DataFrame) -> DataFrame:
    """One row: total, counts (sorted by category) and highlights (by rank)
    of a week slice; no row when the week is empty."""
    cats = stats.by_category(rows).select(
        F.lit("cat").alias("kind"), F.col("category").alias("key"), "n",
        F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("summary"),
    )
    hls = stats.highlights(rows).select(
        F.lit("hl").alias("kind"), F.col("category").alias("key"), F.lit(None).cast("bigint").alias("n"),
        "rank", "summary",
    )
    kind = F.col("kind")
    one = cats.unionByName(hls).agg(
        F.coalesce(F.sum(F.when(kind == "cat", F.col("n"))), F.lit(0)).cast("bigint").alias("total"),
        F.array_sort(F.collect_list(F.when(kind == "cat", F.struct(F.col("key").alias("category"), "n")))).alias("counts"),
        F.transform(
            F.array_sort(F.collect_list(F.when(kind == "hl", F.struct("rank", F.col("key").alias("category"), "summary")))),
            lambda h: F.struct(h["category"].alias("category"), h["summary"].alias("summary")),
        ).alias("highlights"),
    )
    return one.where(F.col("total") > 0)


def digest_prompt(inp: DataFrame) -> DataFrame:
    """The digest request: totals, counts as JSON, highlight list."""
    counts = F.to_json(F.map_from_entries(F.col("counts")))
    hl = F.array_join(
        F.transform("highlights", lambda h: F.concat(F.lit("- ["), h["category"], F.lit("] "), h["summary"])), "\n"
    )
    return inp.select(
        F.concat(
            F.lit("Generate a weekly digest for saved posts.\n\nSTATS:\n- Total processed: "),
            F.col("total").cast("string"), F.lit("\n- By category: "), counts,
            F.lit("\n\nTOP HIGHLIGHTS:\n"), hl,
        ).alias("prompt")
    )


def rule_digest(inp: DataFrame) -> DataFrame:
    """Rule digest model: a one-line summary, the three largest categories
    as patterns, a recommendation per highlight, the first three highlights
    as top picks.  Output has the declared digest fields."""
    by_size = F.array_sort(
        F.col("counts"),
        lambda l, r: F.when(l["n"] > r["n"], -1).when(l["n"] < r["n"], 1)
        .when(l["category"] < r["category"], -1).when(l["category"] > r["category"], 1).otherwise(0),
    )
    return inp.select(
        F.struct(
            F.format_string("%d posts saved this week across %d categories.", F.col("total"), F.size("counts")).alias("digest"),
            F.transform(F.slice(by_size, 1, 3), lambda c: F.format_string("%s: %d posts", c["category"], c["n"])).alias("patterns"),
            F.transform(F.col("highlights"), lambda h: F.concat(F.lit("Revisit: "), h["summary"])).alias("recommendations"),
            F.transform(
                F.slice("highlights", 1, fixed.MAX_TOP_PICKS),
                lambda h: F.struct(h["summary"].alias("summary"), F.concat(F.lit("high score in "), h["category"]).alias("why")),
            ).alias("topPicks"),
        ).alias("digest")
    )


def model_digest(inp: DataFrame, model) -> tuple[DataFrame, DataFrame]:
    """The digest by a model: `model` maps the request (prompt) to the answer (output JSON).
    Returns the valid digest (`digest`, for `render`) and the rejected answer with its reason;
    an empty week asks nothing."""
    ok, bad = inference.validate_digests(stage(model(digest_prompt(inp)).select("output")))
    return ok.select("digest"), bad.select("output", "reason")


def render(d: Column) -> Column:
    """Markdown: title, digest text, then top picks, patterns and
    recommendations when present."""
    picks = F.coalesce(d["topPicks"], F.array())
    patterns = F.coalesce(d["patterns"], F.array().cast("array<string>"))
    recs = F.coalesce(d["recommendations"], F.array().cast("array<string>"))
    return F.concat(
        F.lit(fixed.DIGEST_TITLE), d["digest"],
        F.when(
            F.size(picks) > 0,
            F.concat(
                F.lit(fixed.DIGEST_TOP_PICKS),
                F.array_join(F.transform(picks, lambda p: F.concat(F.lit("- **"), p["summary"], F.lit("**\n  _"), p["why"], F.lit("_"))), "\n"),
            ),
        ).otherwise(F.lit("")),
        F.when(F.size(patterns) > 0, F.concat(F.lit(fixed.DIGEST_PATTERNS), T.bulleted(patterns))).otherwise(F.lit("")),
        F.when(F.size(recs) > 0, F.concat(F.lit(fixed.DIGEST_RECOMMENDATIONS), T.bulleted(recs))).otherwise(F.lit("")),
    )


def outbox(messages: DataFrame, text_col: str, parse_mode: str, limit: int = fixed.DIGEST_CHUNK) -> DataFrame:
    """Messages -> ordered outbox rows: each text packed into pieces of at
    most `limit` units.  A piece beyond the hard limit (one long line) goes on
    in further rows, so no text is lost; empty pieces are left out."""
    cut = fixed.MESSAGE_HARD_CUT

    def rows(piece: Column) -> Column:
        last = F.floor((F.length(piece) - 1) / cut).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(piece, i * cut + 1, F.lit(cut)))

    pieces = T.with_computed(messages, F.filter(chunk_lines(text_col, limit), lambda p: p != ""), "__pieces")
    long = pieces.select("*", F.posexplode(F.flatten(F.transform("__pieces", rows))).alias("seq", "__text"))
    return long.select(
        *[c for c in messages.columns if c != text_col],
        F.col("seq").cast("bigint").alias("seq"),
        F.col("__text").alias("text"),
        F.lit(parse_mode).alias("parse_mode"),
    )
