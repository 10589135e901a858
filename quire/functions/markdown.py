"""HTML to Markdown as one Spark expression.

The text is split into tokens (tags, text, whole script and style elements), each
token is classified, and a fold over the tokens keeps the open elements: nested
lists with their item numbers, quotes, preformatted text, skipped elements, and the
inline marks of the block being built.  A finished block goes to the output.

The fold runs over blocks of about sqrt(n) tokens, and each block's output is put in
a list once, so a long page isn't copied for every token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named character references that are decoded (`&amp;` comes last).
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "amp": "&",
}

# Elements whose content isn't text of the page; raw ones hold no tags.
RAW = "script|style|noscript|template|svg|title|textarea|iframe"
SKIP = ["head", "nav"]
MAIN = ["article", "main"]
BLOCK = [
    "p", "div", "section", "article", "main", "body", "header", "footer", "aside", "figure", "figcaption", "h1", "h2",
    "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "table", "tr", "dl", "dt", "dd", "hr", "form",
    "head", "nav",
]
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "a": "["}

_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({RAW})\b[^>]*>.*?</\1\s*>|</?[a-z][^>]*>|<![^>]*>|[^<]+|<"

_STATE = (
    "struct<out:string, cur:string, lead:string, last:string, marks:array<struct<tag:string,at:int,close:string,filled:boolean>>, "
    "lists:array<int>, quote:int, pre:int, skip:int, main:int>"
)


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _code_point(digits: Column, base: int) -> Column:
    n = F.conv(digits, base, 10).cast("bigint")
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & (F.length(digits) <= 8)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _numeric(piece: Column) -> Column:
    """What follows `&#`: the character of a valid reference and the rest, else as it stood."""
    hexa = F.regexp_extract(piece, "^[xX]([0-9a-fA-F]+);", 1)
    deci = F.regexp_extract(piece, "^([0-9]+);", 1)
    char = F.when(hexa != "", _code_point(hexa, 16)).when(deci != "", _code_point(deci, 10))
    rest = F.substring(piece, F.instr(piece, ";") + 1, F.length(piece))
    return F.coalesce(F.concat(char, rest), F.concat(F.lit("&#"), piece))


def unescape(text: Column) -> Column:
    """Character references decoded: numeric ones and those in ENTITIES; others stay."""
    out = text
    for name, char in ENTITIES.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    pieces = F.split(out, "&#")
    tail = F.transform(F.slice(pieces, 2, F.size(pieces)), _numeric)
    out = F.when(F.contains(out, F.lit("&#")), F.array_join(F.concat(F.slice(pieces, 1, 1), tail), "")).otherwise(out)
    return F.when(F.contains(text, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return unescape(F.regexp_replace(F.regexp_replace(quoted, r"""^["']|["']$""", ""), r"\s+", " "))


def _classify(t: Column) -> Column:
    """Token -> (op, name, shut, text): op is `t` text, `b` block boundary, `m` mark, `n` line
    break, `c` table cell, `s` skipped."""
    name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    raw = F.lower(F.regexp_extract(t, rf"(?i)^<({RAW})\b", 1)) != ""
    is_tag = t.startswith("<") & (F.length(t) > 1)
    op = (
        F.when(~is_tag, "t").when(raw | (name == ""), "s").when(name.isin(*BLOCK), "b").when(name.isin(*MARKS), "m")
        .when(name == "br", "n").when(name == "img", "t").when(name.isin("td", "th") & ~t.startswith("</"), "c").otherwise("s")
    )
    shut = t.startswith("</")
    image = F.concat(F.lit("!["), _attribute(t, "alt"), F.lit("]("), _attribute(t, "src"), F.lit(")"))
    text = (
        F.when(~is_tag, unescape(t)).when(name == "img", image).when(name == "a", _attribute(t, "href")).otherwise("")
    )
    return F.struct(op.alias("op"), name.alias("name"), shut.alias("shut"), text.alias("text"))


def _closers(marks: Column) -> Column:
    return F.array_join(F.reverse(F.transform(marks, lambda m: m["close"])), "")


def _flush(s: Column) -> Column:
    """State after the end of a block: its text, if any, is put out with its lead."""
    empty_marks = F.filter(s["marks"], lambda m: ~m["filled"])
    kept = F.when(F.size(empty_marks) > 0, F.left(s["cur"], F.get(empty_marks, 0)["at"])).otherwise(s["cur"])
    inline = F.btrim(F.regexp_replace(F.regexp_replace(kept, " {2,}", " "), " ?\n ?", "  \n"), F.lit(" \n"))
    body = F.when(s["pre"] > 0, F.regexp_replace(s["cur"], r"\A\n|\s+\z", "")).otherwise(
        F.concat(inline, _closers(F.filter(s["marks"], lambda m: m["filled"])))
    )

    def put(b: Column) -> Column:
        depth = F.size(s["lists"])
        fenced = F.when(s["pre"] > 0, F.concat(F.lit("```\n"), b, F.lit("\n```"))).otherwise(b)
        quotes = F.repeat(F.lit("> "), s["quote"])
        item = s["lead"].rlike(r"^([-]|\d+\.) $")
        inner = F.repeat(F.lit("  "), depth)
        first = F.concat(quotes, F.when(item, F.repeat(F.lit("  "), depth - 1)).otherwise(inner), s["lead"])
        line = F.concat(first, F.replace(fenced, F.lit("\n"), F.concat(F.lit("\n"), quotes, inner)))
        kind = F.when(item, "li").when(s["lead"] == "| ", "tr").otherwise("p")
        gap = F.when(s["last"] == "", "").when((s["last"] == kind) & (kind != "p"), "\n").otherwise("\n\n")
        empty = b == ""
        return F.struct(
            F.when(empty, s["out"]).otherwise(F.concat(s["out"], gap, line)).alias("out"),
            F.lit("").alias("cur"),
            F.when(empty, s["lead"]).otherwise("").alias("lead"),
            F.when(empty, s["last"]).otherwise(kind).alias("last"),
            F.slice(s["marks"], 1, 0).alias("marks"),
            *[s[c].alias(c) for c in ("lists", "quote", "pre", "skip", "main")],
        ).cast(_STATE)

    return _let(body, put)


def _boundary(s: Column, t: Column) -> Column:
    """A block boundary: the block before it is finished, then the element opens or closes."""

    def effect(f: Column) -> Column:
        name, shut = t["name"], t["shut"]
        step = lambda count, hit: F.when(hit & ~shut, count + 1).when(hit, F.greatest(count - 1, F.lit(0))).otherwise(count)
        depth = F.size(f["lists"])
        top = F.when(depth > 0, F.element_at(f["lists"], -1)).otherwise(-1)
        lists = (
            F.when(name.isin("ul", "ol") & shut, F.slice(f["lists"], 1, F.greatest(depth - 1, F.lit(0))))
            .when(name == "ul", F.concat(f["lists"], F.array(F.lit(-1))))
            .when(name == "ol", F.concat(f["lists"], F.array(F.lit(0))))
            .when((name == "li") & ~shut & (top >= 0), F.concat(F.slice(f["lists"], 1, depth - 1), F.array(top + 1)))
            .otherwise(f["lists"])
        )
        marker = F.when(top >= 0, F.concat((top + 1).cast("string"), F.lit(". "))).otherwise("- ")
        lead = (
            F.when(shut & name.isin("li", "ul", "ol", "tr", *[f"h{i}" for i in range(1, 7)]), "")
            .when((name == "li") & (depth > 0), marker).when(name == "tr", "| ")
            .when(name.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(name, 2, 1).cast("int")), F.lit(" ")))
            .otherwise(f["lead"])
        )
        opens_main = name.isin(*MAIN, "body") & ~shut
        return F.struct(
            f["out"].alias("out"),
            F.lit("").alias("cur"),
            lead.alias("lead"),
            f["last"].alias("last"),
            f["marks"].alias("marks"),
            lists.alias("lists"),
            step(f["quote"], name == "blockquote").alias("quote"),
            step(f["pre"], name == "pre").alias("pre"),
            F.when(opens_main, F.lit(0)).otherwise(step(f["skip"], name.isin(*SKIP))).alias("skip"),
            step(f["main"], name == "article").alias("main"),
        ).cast(_STATE)

    return _let(_flush(s), effect)


def _mark(s: Column, t: Column) -> Column:
    """An inline mark opens, or closes together with those opened after it."""
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), t["name"])
    end = F.when(t["name"] == "a", F.concat(F.lit("]("), t["text"], F.lit(")"))).otherwise(mark)
    linked = (t["name"] != "a") | (t["text"] != "")
    opened = F.struct(
        t["name"].alias("tag"), F.length(s["cur"]).alias("at"), end.alias("close"), F.lit(False).alias("filled")
    )
    size = F.size(s["marks"])
    at = F.array_position(F.transform(F.reverse(s["marks"]), lambda m: m["tag"]), t["name"])  # from the top, 1 = top
    gone = F.slice(s["marks"], size - at.cast("int") + 1, size)
    trimmed = F.rtrim(s["cur"])
    lowest = F.get(gone, 0)
    closed = F.when(~lowest["filled"], F.left(s["cur"], lowest["at"])).otherwise(
        F.concat(trimmed, _closers(F.filter(gone, lambda m: m["filled"])), F.when(trimmed != s["cur"], " ").otherwise(""))
    )
    opens = ~t["shut"] & linked
    shuts = t["shut"] & (at > 0)
    idle = s["pre"] > 0
    cur = F.when(idle, s["cur"]).when(opens, F.concat(s["cur"], mark)).when(shuts, closed).otherwise(s["cur"])
    marks = (
        F.when(idle, s["marks"]).when(opens, F.concat(s["marks"], F.array(opened)))
        .when(shuts, F.slice(s["marks"], 1, size - at.cast("int"))).otherwise(s["marks"])
    )
    return F.struct(
        s["out"].alias("out"), cur.alias("cur"), s["lead"].alias("lead"), s["last"].alias("last"), marks.alias("marks"),
        *[s[c].alias(c) for c in ("lists", "quote", "pre", "skip", "main")],
    ).cast(_STATE)


def _text(s: Column, t: Column) -> Column:
    squeezed = F.regexp_replace(t["text"], r"[ \t\r\n\f]+", " ")
    added = (
        F.when(t["op"] == "n", "\n").when(s["pre"] > 0, t["text"])
        .when(t["op"] == "c", F.when(s["cur"] == "", "").otherwise(" | ")).otherwise(squeezed)
    )
    filled = (t["op"] == "t") & (F.btrim(squeezed) != "")
    marks = F.when(filled, F.transform(s["marks"], lambda m: m.withField("filled", F.lit(True)))).otherwise(s["marks"])
    return F.struct(
        s["out"].alias("out"), F.concat(s["cur"], added).alias("cur"), s["lead"].alias("lead"), s["last"].alias("last"),
        marks.alias("marks"), *[s[c].alias(c) for c in ("lists", "quote", "pre", "skip", "main")],
    ).cast(_STATE)


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page: of its `<article>` elements (all, nested ones included), else of its
    body.  Script, style, navigation and head content is left out.

    Kept: headings, paragraphs, nested bullet and numbered lists, quotes, links (as written; an
    `<a>` without href is plain text), images, bold, italic, code, preformatted text (fenced),
    line breaks; table cells are parted by ` | `, one row a line.  A mark left open ends with its block.
    Characters that Markdown reads as marks aren't escaped.  Null gives null, a page without
    text the empty string; unknown and broken tags are dropped."""
    tokens = F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), _classify)
    has_main = html.rlike(r"(?i)<article[\s>]")

    def step(s: Column, t: Column) -> Column:
        shown = (s["skip"] == 0) & (~has_main | (s["main"] > 0))
        return (
            F.when(t["op"] == "b", _boundary(s, t)).when(~shown | (t["op"] == "s"), s)
            .when(t["op"] == "m", _mark(s, t)).otherwise(_text(s, t))
        )

    start = F.expr(
        "named_struct('out','', 'cur','', 'lead','', 'last','', "
        "'marks', cast(array() as array<struct<tag:string,at:int,close:string,filled:boolean>>), "
        "'lists', cast(array() as array<int>), 'quote',0, 'pre',0, 'skip',0, 'main',0)"
    ).cast(_STATE)
    outer = f"struct<done:array<string>, s:{_STATE}>"

    def fold(ts: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(ts))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(ts), F.lit(1)), width)

        def block(acc: Column, i: Column) -> Column:
            clean = acc["s"].withField("out", F.lit("")).cast(_STATE)
            after = F.aggregate(F.slice(ts, i, width), clean, step)
            return _let(
                after, lambda s: F.struct(F.concat(acc["done"], F.array(s["out"])).alias("done"), s.alias("s")).cast(outer)
            )

        def finish(acc: Column) -> Column:
            return F.array_join(F.concat(acc["done"], F.array(_flush(acc["s"].withField("out", F.lit("")).cast(_STATE))["out"])), "")

        first = F.struct(F.expr("cast(array() as array<string>)").alias("done"), start.alias("s")).cast(outer)
        return F.aggregate(starts, first, block, finish)

    return F.when(html.isNotNull(), _let(tokens, fold))
