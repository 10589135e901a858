"""Column functions over URLs (all native Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import _col, first_present


def url_host(c) -> Column:
    """Lower-cased host, NULL when the URL does not parse."""
    return F.lower(F.try_parse_url(_col(c), F.lit("HOST")))


def url_path(c) -> Column:
    return F.try_parse_url(_col(c), F.lit("PATH"))


def is_valid_url(c) -> Column:
    return url_host(c).isNotNull() & (url_host(c) != "")


def is_scrapable(c) -> Column:
    """Parses as a URL and matches none of the (unanchored) skip patterns."""
    c = _col(c)
    hit = F.lit(False)
    for pattern in fixed.SKIP_PATTERNS:
        hit = hit | c.rlike(pattern)
    return F.coalesce(is_valid_url(c) & ~hit, F.lit(False))


def is_scrapable_strict(c) -> Column:
    """Like `is_scrapable` but the host list is matched on the host itself
    (so `netflix.com` is not mistaken for `x.com`)."""
    c = _col(c)
    host = url_host(c)
    hit = F.lit(False)
    for h in fixed.SKIP_HOSTS:
        hit = hit | (host == h) | host.endswith("." + h)
    for pattern in fixed.SKIP_PATTERNS[4:]:
        hit = hit | c.rlike(pattern)
    return F.coalesce(is_valid_url(c) & ~hit, F.lit(False))


def video_id(c) -> Column:
    """11-character video id from watch, short-link and shorts URLs, or NULL."""
    return F.nullif(F.regexp_extract(_col(c), fixed.VIDEO_ID_PATTERN, 1), F.lit(""))


def is_video_url(c) -> Column:
    return F.coalesce(_col(c).rlike(fixed.VIDEO_ID_PATTERN), F.lit(False))


def url_title(c) -> Column:
    """Last non-empty path segment, dashes and underscores to spaces, one
    extension removed; else the host; else the URL itself."""
    c = _col(c)
    segment = F.try_element_at(
        F.filter(F.split(F.coalesce(url_path(c), F.lit("")), "/"), lambda s: s != ""), F.lit(-1)
    )
    titled = F.regexp_replace(
        F.regexp_replace(F.coalesce(segment, F.lit("")), "[-_]", " "), r"\.\w+$", ""
    )
    return F.when(is_valid_url(c), first_present(titled, url_host(c))).otherwise(c)


def site_name(og_site, c) -> Column:
    """Publisher name: og:site_name, else the host of the URL."""
    return first_present(og_site, url_host(c))


def status_id(c) -> Column:
    """Point lookup key: the part of a post URL after `/status/` up to the next
    `/`, `?` or `#`; a key without it is the id itself."""
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(_col(c), r"/status/([^/?#]+)", 1), F.lit("")), _col(c)), F.lit(""))


def post_url(author, post_id) -> Column:
    return F.concat(F.lit(fixed.POST_URL_PREFIX), _col(author), F.lit("/status/"), _col(post_id))
