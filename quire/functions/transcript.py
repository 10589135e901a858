"""Caption (VTT) cleaning and message chunking as array expressions.

Both run per text inside one row with higher-order functions, so a text is
processed whole, in order, without a shuffle or a Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import _col, js_trim, non_blank, squeeze_space, utf16_length, with_computed

_HEADER_PREFIXES = ("WEBVTT", "Kind:", "Language:")


def _is_caption_text(line: Column) -> Column:
    is_header = F.lit(False)
    for prefix in _HEADER_PREFIXES:
        is_header = is_header | line.startswith(prefix)
    is_cue_time = line.rlike(r"^\d{2}:\d{2}")
    is_numeric = line.rlike(rf"^[\d:.,{fixed.JS_SPACE}-]+$")
    return ~is_header & ~is_cue_time & ~is_numeric & non_blank(line)


def clean_vtt(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add column `out`: caption text of the VTT in `src`.

    Drops header, cue-timing and number-only lines, strips inline tags,
    collapses runs of equal consecutive lines, joins with spaces and squeezes
    whitespace.  Each line is paired with its predecessor by zipping the
    list with a copy shifted by one, so no lambda reads the list itself (an
    optimizer that inlines the list then costs 2x, not n x).
    """
    lines = F.filter(
        F.transform(
            F.filter(F.split(_col(src), "\n"), _is_caption_text),
            lambda l: js_trim(F.regexp_replace(l, "<[^>]+>", "")),
        ),
        lambda l: l != "",
    )
    # `lines` is its own column: the pairing below reads it twice.
    staged = with_computed(df, lines, "__vtt_lines")
    return with_computed(staged, collapse_repeats_joined(F.col("__vtt_lines")), out).drop("__vtt_lines")


def collapse_repeats_joined(lines: Column) -> Column:
    """Drop each line equal to the one before it, join with spaces, squeeze
    whitespace and trim."""
    prev = F.concat(F.array(F.lit(None).cast("string")), lines)
    pairs = F.zip_with(lines, prev, lambda cur, before: F.struct(cur.alias("cur"), before.alias("before")))
    kept = F.transform(
        F.filter(
            pairs,
            lambda p: p["cur"].isNotNull() & (p["before"].isNull() | (p["cur"] != p["before"])),
        ),
        lambda p: p["cur"],
    )
    return js_trim(squeeze_space(F.array_join(kept, " ")))


def chunk_lines(c, limit: int = fixed.DIGEST_CHUNK) -> Column:
    """Greedy line packing into pieces of at most `limit` UTF-16 units.

    Same fold as the source: a line that does not fit starts a new piece (the
    current one is emitted even when empty), a line is never split, and a
    trailing empty piece is dropped.
    """
    text = _col(c)
    init = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).cast("bigint").alias("n"),
    )

    def step(acc, line):
        n_line = utf16_length(line)
        overflow = acc["n"] + n_line + 1 > limit
        sep = F.when(acc["cur"] != "", F.lit("\n")).otherwise(F.lit(""))
        return F.when(
            overflow,
            F.struct(
                F.concat(acc["done"], F.array(acc["cur"])).alias("done"),
                line.alias("cur"),
                n_line.alias("n"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["cur"], sep, line).alias("cur"),
                (acc["n"] + F.when(acc["cur"] != "", 1).otherwise(0) + n_line).alias("n"),
            )
        )

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(
            acc["done"]
        )

    return F.aggregate(F.split(text, "\n"), init, step, finish)
