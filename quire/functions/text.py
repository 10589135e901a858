"""Column functions over text.  All are built-in Spark expressions (no UDFs),
so they stay inside whole-stage codegen and run where the data is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """`String.prototype.trim`: strip the JavaScript whitespace set from both
    ends (character-set trim, no regex)."""
    return F.btrim(_col(c), F.lit(fixed.JS_SPACE_CHARS))


def non_blank(c) -> Column:
    """True when the text has a character outside the JavaScript whitespace
    set (`s.trim() !== ''` without building the trimmed string)."""
    return _col(c).rlike(f"[^{fixed.JS_SPACE}]")


def squeeze_space(c) -> Column:
    """`.replace(/\\s+/g, ' ')` with the JavaScript whitespace class."""
    return F.regexp_replace(_col(c), rf"[{fixed.JS_SPACE}]+", " ")


def blank_to_null(c) -> Column:
    """`''` counts as missing in `a || b` chains."""
    return F.nullif(_col(c), F.lit(""))


def first_present(*cols) -> Column:
    """`a || b || c` over strings: first value that is neither NULL nor ''."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def truncate(c, width: int) -> Column:
    """Cut to `width` characters, the last three replaced by '...'."""
    c = _col(c)
    return F.when(F.length(c) <= width, c).otherwise(
        F.concat(F.substring(c, 1, width - 3), F.lit("..."))
    )


def truncate_marked(c, width: int) -> Column:
    """Keep `width` characters and add the truncation marker when cut."""
    c = _col(c)
    return F.concat(
        F.substring(c, 1, width),
        F.when(F.length(c) > width, F.lit(fixed.TRUNCATED_MARKER)).otherwise(F.lit("")),
    )


def html_escape(c) -> Column:
    """Escape `&` first, then `<` and `>`."""
    c = _col(c)
    return F.replace(
        F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"),
        F.lit("&gt;"),
    )


def extract_urls(c) -> Column:
    """All `https?://` runs up to JavaScript whitespace, in text order."""
    return F.regexp_extract_all(_col(c), F.lit(fixed.URL_PATTERN), 0)


def extract_handles(c) -> Column:
    """All `@handle` mentions (word characters after '@')."""
    return F.regexp_extract_all(_col(c), F.lit(fixed.HANDLE_PATTERN), 1)


def js_number(c) -> Column:
    """Render a double the way JavaScript prints numbers in templates for the
    values scores take: integral values without a fraction."""
    c = _col(c)
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def numbered(arr, start: int = 1, sep: str = "\n", fmt_prefix: str = "", fmt_mid: str = ". ") -> Column:
    """`arr.map((x, i) => `${i + start}${fmt_mid}${x}`).join(sep)`."""
    return F.array_join(
        F.transform(
            _col(arr),
            lambda x, i: F.concat(F.lit(fmt_prefix), (i + start).cast("string"), F.lit(fmt_mid), x),
        ),
        sep,
    )


def bulleted(arr, sep: str = "\n") -> Column:
    """`arr.map((x) => `- ${x}`).join(sep)`."""
    return F.array_join(F.transform(_col(arr), lambda x: F.concat(F.lit("- "), x)), sep)


def score_marks(score) -> Column:
    """Score band: three marks at >= 9, two at >= 7, one at >= 4, else ''."""
    s = _col(score)
    expr = F.lit("")
    for threshold, marks in reversed(fixed.SCORE_BANDS):
        expr = F.when(s >= threshold, F.lit(fixed.SCORE_MARK * marks)).otherwise(expr)
    return expr


def utf16_length(c) -> Column:
    """Length in UTF-16 code units, as JavaScript counts `.length`."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("bigint")


def with_computed(df, expr: Column, name: str):
    """`df` plus column `name` = `expr`, emitted through a one-element
    generator.  Filters on `name` then stay above the generator, so a costly
    `expr` (whole-text regex work) is evaluated once per row, after earlier
    joins, instead of being copied into a filter pushed down to the scan."""
    return df.select("*", F.explode(F.array(expr)).alias(name))
