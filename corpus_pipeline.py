"""A corpus pipeline of five operators over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each stage's result as Parquet and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, mixing, neardup, suffix_dedup
from quire.llm.common import staged, table

# repeated strings from this length on are found; a repeated passage is cut if it
# has more than fifty words
REPEAT_BYTES = 240
REPEAT_WORDS = 51
MIN_SCORE = 0.5
# near copies share this part of their distinct five-word shingles
NEAR_PERCENT = 80


def _row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no helper column can meet their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs back from `row`."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or no letter, a posterior below
    MIN_SCORE, or n-grams less likely, on average, than langid.bounds allows for
    the best language (another language, letter noise).  Only rows with a lang
    teach: a table without any, or an empty one, keeps no row.  Repeated rows are
    judged each; other columns stay as they are."""
    model = langid.fit(docs.select("lang", "text"))
    least = langid.bounds(model, docs.select("lang", "text"))
    rows = docs.select(_row(docs).alias("row"), "text")
    found = langid.judged(model, rows, MIN_SCORE).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    if not least:
        return docs.limit(0)
    bound = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("lang_pred")]
    return found.filter(F.col("typical") >= bound).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies
    (NEAR_PERCENT or more); texts that share a doc_id are judged one by one.  Of
    rows that repeat doc_id and text, one stays: the least by a digest of all its
    columns as JSON.  Documents without a doc_id stay, as do those without words;
    an empty table gives no rows."""
    row = _row(docs).alias("row")
    named = docs.filter("doc_id is not null").select(row, "doc_id", "text", decontaminate.row_key().alias("key"))
    report = neardup.near_duplicates(named.select(F.col("key").alias("doc_id"), "text"), NEAR_PERCENT)
    ids = named.select("key", "doc_id").distinct().join(report.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.key")
    once = named.groupBy("key").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    kept = once.join(first, "key", "left_semi").select("row").unionByName(docs.filter("doc_id is null").select(row))
    return kept.select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of REPEAT_WORDS words or more, and REPEAT_BYTES bytes, that
    occur elsewhere, and renews n_chars.  Null texts stay null, empty ones empty;
    repeated rows lose their repeated text each; an empty table gives no rows."""
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES, REPEAT_WORDS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.  Rows
    are judged by doc_id and text, so repeated rows go or stay together; null and
    empty texts stay, and all rows if there are no items."""
    report = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    lost = report.filter("contaminated").select(F.col("row_key").alias("key")).distinct()
    keyed = docs.select(_row(docs).alias("row"), decontaminate.row_key().alias("key"))
    return keyed.join(lost, "key", "left_anti").select(*_columns(docs))


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies
    and taken (named `mix_...` where docs has a column of that name).  Documents
    without words, null texts among them, are never taken; of rows that repeat
    doc_id and text each stands for the copies of one; an empty table gives no
    rows."""
    plan = mixing.mixed(docs).filter("copies > 0").dropDuplicates(["doc_id", "text_hash"]).alias("m")
    rows = docs.select(_row(docs).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.hash") == F.col("m.text_hash"))
    taken = {c.lower() for c in docs.columns}
    new = [F.col(f"m.{c}").alias(f"mix_{c}" if c in taken else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return rows.join(plan, same).select(*_columns(docs), *new)


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("source mix", weighted_mix),
]

# the language model and the sketches have no SQL form; the pipeline is tested
# against brute force on a small fixture
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
