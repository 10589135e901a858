"""URL filters with redirect equivalence.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's; the longest rule wins.  Urls that redirect to each other or
name each other as canonical form a component (distributed connected
components); a url without a rule takes its component's decision: allow if any
member is explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, staged, table
from quire.llm.components import connected_components

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
# <link rel="canonical" href="...">, attributes in any order and canonical among
# other words, <meta http-equiv="refresh" content="0; url=..."> and <base href="...">
_REL = r"""\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)"""
_HREF = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
_LINK = rf"""(?is)<link\b(?=[^>]*{_REL})[^>]*{_HREF}"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
_BASE = rf"""(?is)<base\b[^>]*{_HREF}"""
_AMPERSAND = r"(?i)&(?:amp|#38|#x26);"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource_of(url: Column) -> Column:
    """A url without scheme and fragment: what the server is asked for."""
    return F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))


def _with(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` steps."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def _joined(base: Column, to: Column) -> Column:
    site, scheme = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([^:]*:)//", 1)
    path = F.regexp_extract(base, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(site == "", F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), to))
        .otherwise(F.concat(site, folder, to))
    )


def _tidy(url: Column) -> Column:
    part = lambda k: F.regexp_extract(url, r"(?s)^([^:]*://[^/?#]*)([^?#]*)(.*)$", k)
    return F.concat(part(1), _with(part(2), _without_dots), part(3))


def resolved(base: Column, to: Column) -> Column:
    """The url that the reference `to` means in a document whose base is `base`;
    null if it has another form than `scheme://`, as `mailto:` has."""
    return _with(_with(F.struct(base.alias("base"), to.alias("to")), lambda x: _joined(x["base"], x["to"])), _tidy)


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst: a page's url and the targets of its canonical links and refresh
    redirects, relative ones resolved against the page's first `<base>`, else its url."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    targets = F.concat(F.regexp_extract_all(html, F.lit(_LINK), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1))
    plain = lambda c: F.regexp_replace(c, _AMPERSAND, "&")
    marked = pages.filter(html.rlike(r"(?i)canonical|http-equiv")).select(
        url.alias("src"), plain(F.regexp_extract(html, _BASE, 1)).alias("base"), F.explode(targets).alias("to")
    )
    base = F.when(F.col("base") == "", F.col("src")).otherwise(F.coalesce(resolved(F.col("src"), F.col("base")), F.col("src")))
    ends = marked.select("src", base.alias("base"), plain("to").alias("to"))
    return ends.select("src", resolved(F.col("base"), F.col("to")).alias("dst")).filter("src is not null and dst is not null")


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path) -> host, path, rule, action of the longest rule that
    fits; of two as long, allow, then the smaller string.  Every parent domain of
    a host is looked up by an equi-join, whatever the number of rules."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked_up = places.distinct().select("host", "path", F.explode(parents).alias("parent"))
    r = rules.select(F.col("host").alias("parent"), F.col("path").alias("rule_path"), "action")
    fits = looked_up.join(r, "parent").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("parent", "rule_path")
    best = F.struct((-F.length(rule)).alias("n"), F.col("action").alias("action"), rule.alias("rule"))
    return fits.groupBy("host", "path").agg(F.min(best).alias("b")).select("host", "path", "b.rule", "b.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict per row of `pages` (page_id, url, html).
    A page of any length is searched whole for links.

    rules: host, path, action (allow or block).  redirects: further edges
    (src, dst) of absolute urls.  A null url, or one without `://`, has an empty
    host and path, no rule and no aliases, and is allowed.  A null html has no
    links.  Repeated rows are judged each; other columns are ignored; an empty
    table gives no rows."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")).dropna())
    edges = staged(edges.distinct(), "url-edges")
    url = F.col("url").cast("string")
    own = staged(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, resource_of(url)).alias("node")), "url-pages")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    ends = ends.select(resource_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = staged(fitting_rules(own.select("host", "path").unionByName(ends.select("host", "path")), rules), "url-ruled")

    parts = connected_components(edges.select(resource_of(F.col("src")).alias("src"), resource_of(F.col("dst")).alias("dst")))
    decided = parts.join(ends.join(ruled, ["host", "path"]).select("node", "action").distinct(), "node")
    decision = decided.groupBy("component").agg(F.min("action").alias("decision"))  # allow before block
    aliases = parts.join(decision, "component").select("node", "decision")
    return (
        own.join(ruled, ["host", "path"], "left").join(aliases, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("action", "decision", F.lit("allow")).alias("verdict"))
    )


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
page AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM page),
fit AS (
  SELECT DISTINCT host, path, h || p AS rule, action FROM (SELECT DISTINCT host, path FROM parsed), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, rule, action FROM fit QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, action, rule) = 1)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(action, 'allow') AS verdict
FROM parsed LEFT JOIN best ON best.host = parsed.host AND best.path = parsed.path
"""
