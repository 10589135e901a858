"""Benchmark decontamination with a positional inverted index (DataFrame
functions only).

Every benchmark item gives its windows of `width` consecutive words.  The index
holds postings (term, document, position, the words around it) of the terms
that are needed: for each window its rarest term in the documents, counted over
all of them.  A posting moved back by the term's offset is a possible start of
the window; the remaining lists are intersected at their offsets by looking
into the words around the posting, so a frequent term's list is never read.
Term tables are broadcast in parts of bounded size, one pass over the documents
for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, in_few, staged, staged_bytes, table, term_words, unstage

WIDTH = 10


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, phrase (the window's words joined by spaces), n: distinct windows
    of each item; an item of fewer words, but not none, is one window.  Items
    without id or text have none."""
    words = items.filter("item_id is not null").select("item_id", term_words(F.col("text").cast("string")).alias("w")).filter("size(w) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("s")
    window = words.select("item_id", "w", start).select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("w"))
    return window.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).distinct()


def _parts(terms: DataFrame, limit: int) -> list[DataFrame]:
    """A staged table with column `k`, in broadcast parts of at most `limit` bytes."""
    n = max(1, -(-staged_bytes(terms) * 4 // limit))
    return [F.broadcast(terms.filter(F.pmod("k", F.lit(n)) == i) if n > 1 else terms) for i in range(n)]


def row_key() -> Column:
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key().alias("row_key"), term_words(F.col("text").cast("string")).alias("w"))


def _term_key(c: str | Column) -> Column:
    return F.xxhash64(c)


def rarest_terms(docs: DataFrame, phrases: DataFrame, limit: int, sources: tuple[DataFrame, ...] = ()) -> DataFrame:
    """phrases (phrase, n) -> k (rarest term's key), offset, phrase, n; a phrase
    with a term that no document has is left out.  `sources`: the staged tables
    that the phrases are made from, if their sizes may set the number of tasks."""
    terms = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).withColumn("k", _term_key("term"))
    vocabulary = staged(in_few(terms.select("k").distinct(), *sources), "dc-vocabulary")
    seen = docs.select(F.explode_outer(term_words(F.col("text").cast("string"))).alias("term")).select(_term_key("term").alias("k"))
    counted = reduce(DataFrame.unionByName, [seen.join(p, "k").groupBy("k").agg(F.count("*").alias("seen")) for p in _parts(vocabulary, limit)])
    counts = staged(in_few(counted, vocabulary), "dc-counts")
    ranked = terms.join(counts, "k", "left").groupBy("phrase", "n").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "k", "offset")).alias("r")
    )
    out = staged(in_few(ranked.filter("r.seen > 0").select("r.k", "r.offset", "phrase", "n"), *sources), "dc-rarest")
    unstage(vocabulary)
    unstage(counts)
    return out


def postings(docs: DataFrame, terms: DataFrame, width: int, limit: int, slop: int = 0) -> DataFrame:
    """The staged index.  A row per occurrence of a wanted term (k, pos, before:
    words before it in `around`, around: the words within width + slop - 1), and
    a row per document with k null; both with n_words and the document's row_key."""
    width += slop
    pos, word = F.col("pos"), F.col("word")
    each = _texts(docs).select("doc_id", "row_key", "w", F.posexplode_outer("w").alias("pos", "word"))
    wanted_terms, parts = staged(terms, "dc-terms"), []
    for i, part in enumerate(_parts(wanted_terms, limit)):
        hit = each.withColumn("k", _term_key(word)).join(part.withColumn("wanted", F.lit(True)), "k", "left")
        head = (F.coalesce(pos, F.lit(0)) == 0) if i == 0 else F.lit(False)
        around = F.slice("w", F.greatest(pos - width + 2, F.lit(1)), F.least(pos, F.lit(width - 1)) + width)
        rows = F.array(
            F.when(F.col("wanted"), F.struct(F.col("k"), pos.alias("pos"), F.least(pos, F.lit(width - 1)).alias("before"), around.alias("around"))),
            F.when(head, F.struct(F.lit(None).cast("long").alias("k"), pos.alias("pos"), F.lit(0).alias("before"), F.lit(None).cast("array<string>").alias("around"))),
        )
        kept = hit.filter(F.col("wanted") | head).select("doc_id", "row_key", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.array_compact(rows)).alias("r"))
        parts.append(kept.select("doc_id", "row_key", "n_words", "r.*"))
    out = staged(reduce(DataFrame.unionByName, parts), "dc-postings")
    unstage(wanted_terms)
    out._width = width
    return out


def matches(index: DataFrame, rarest: DataFrame, slop: int | None = None) -> DataFrame:
    """Windows that occur: doc_id, row_key, start, n, phrase, exact.  With a
    `slop`, windows whose words, as often as the window has them, all lie in a
    run of n + slop words that holds the rarest one, in any order, are returned
    too, with exact false (proximity); the index must reach n + slop - 1 words."""
    found = index.filter("k is not null").join(rarest, "k")
    begin = F.col("before") - F.col("offset")
    # a window that would begin before the text has no place
    here = F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ")
    exact = (begin >= 0) & (here == F.col("phrase"))
    if slop is None:
        kept = found.filter(exact).withColumn("exact", F.lit(True))
    else:
        longest = rarest.agg(F.max("n")).first()[0] or 0
        if longest + slop > index._width:
            raise ValueError(f"the index reaches {index._width - 1} words, a slop of {slop} needs {longest + slop - 1}")
        often = lambda xs: f"size(filter({xs}, x -> x = t))"
        run, words = f"slice(around, s + 1, n + {slop})", "split(phrase, ' ')"
        near = F.expr(
            f"exists(sequence(greatest(before - n - {slop} + 1, 0), before), "
            f"s -> forall(array_distinct({words}), t -> {often(run)} >= {often(words)}))"
        )
        kept = found.withColumn("exact", exact).filter(F.col("exact") | near)
    return kept.select("doc_id", "row_key", (F.col("pos") - F.col("offset")).alias("start"), "n", "phrase", "exact")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and row_key
    (xxhash64 of doc_id and text) per row of `docs`.

    A word inside any occurrence of an item's window is hit.  A null text has
    no words; items without id or text are ignored; without items nothing is
    hit.  Rows that repeat doc_id and text each get the same result.  Other
    columns are ignored; an empty table gives no rows."""
    windows = staged(item_windows(items, width), "dc-windows")
    rarest = rarest_terms(docs, windows.select("phrase", "n").distinct(), limit, (windows,))
    index = postings(docs, in_few(rarest.select("k").distinct(), rarest), width, limit)
    hits = staged(in_few(matches(index, rarest).select("row_key", "start", "n", "phrase").distinct(), index), "dc-hits")
    spots = hits.select("row_key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("p")).distinct()
    n_hit = spots.groupBy("row_key").agg(F.count("*").alias("n_hit"))
    named = hits.select("row_key", "phrase").distinct().join(windows.select("phrase", "item_id"), "phrase").select(
        "row_key", F.col("item_id").cast("string").alias("item")
    )
    n_items = named.distinct().groupBy("row_key").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256")
    )
    out = index.filter("k is null").select("doc_id", "row_key", "n_words")
    out = out.join(n_hit, "row_key", "left").join(n_items, "row_key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "row_key",
    )


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + 9) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, gram.n, s, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot ON spot.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""
