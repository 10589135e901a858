"""Time parsing and ISO formatting (session time zone pinned to UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _col

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(ts) -> Column:
    """`Date.toISOString()`: millisecond precision, `Z` suffix."""
    return F.date_format(_col(ts), ISO_FORMAT)


def parse_source_time(c) -> Column:
    """ISO-8601 text, or the `Wed Oct 10 20:19:24 +0000 2018` form the post
    source emits (weekday removed first; the parser rejects `EEE`)."""
    c = _col(c)
    no_weekday = F.regexp_replace(c, r"^[A-Za-z]{3} ", "")
    return F.coalesce(
        F.try_to_timestamp(c),
        F.try_to_timestamp(no_weekday, F.lit("MMM dd HH:mm:ss Z yyyy")),
    )
