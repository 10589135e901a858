"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs hold snapshots: a conversation that another one goes on with.  Every turn
gets the hash of its conversation up to it (a running sum of turn hashes that
depend on the position, so blocks of turns are summed apart).  A conversation
whose full hash is a longer one's prefix hash, or that repeats one with a
smaller id, is left out by anti-joins; the others are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import staged, table, unstage

BLOCK = 256  # turns rendered into one string
_MODULUS = "decimal(38,0)"


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, pos: the turn's place in its conversation, from 0, by
    (turn, role, text), nulls first.  Places are counted inside ranges of turn
    numbers; a range's offset comes from the sums of the ranges before, so a very
    long conversation isn't sorted in one task."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))
    ranked = t.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.alias("a").join(starts.alias("b"), same).select("a.conv_id", "a.role", "a.text", (F.col("rank") + F.col("start")).alias("pos"))


def _prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds h1 and h2: 64-bit running sums of turn hashes up to each turn."""
    t = turns.withColumn("block", F.floor(F.col("pos") / BLOCK))
    # exact sums of 64-bit values: decimals don't overflow
    for i in (1, 2):
        t = t.withColumn(f"v{i}", F.xxhash64(F.lit(i), "pos", F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).cast(_MODULUS))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "block").agg(F.sum("v1").cast(_MODULUS).alias("s1"), F.sum("v2").cast(_MODULUS).alias("s2"))
    before = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).cast(_MODULUS).alias(f"b{i}") for i in (1, 2)])
    same = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.block") == F.col("y.block"))
    run = t.select("*", *[F.sum(f"v{i}").over(inside).cast(_MODULUS).alias(f"r{i}") for i in (1, 2)])
    return run.alias("x").join(before.alias("y"), same).select(
        "x.conv_id", "x.pos", "x.role", "x.text", "x.block", *[(F.col(f"r{i}") + F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]
    )


def maximal_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, block, n_turns of the conversations that are no
    prefix of a longer one and don't repeat one with a smaller conv_id.  Rows
    without conv_id are left out."""
    hashed = staged(_prefix_hashes(_numbered(turns.filter("conv_id is not null"))), "chat-prefixes")
    sizes = hashed.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    whole = staged(hashed.join(sizes, "conv_id").filter("pos = n_turns - 1").select("conv_id", "n_turns", "h1", "h2"), "chat-whole")
    first = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.join(whole.select("conv_id", "n_turns"), "conv_id").filter("pos < n_turns - 1")
    prefixes = inner.select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    kept = staged(first.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns"), "chat-kept")
    unstage(whole)
    return hashed.join(kept, "conv_id").select("conv_id", "pos", "role", "text", "block", "n_turns")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered: maximal conversations as text, a row for
    every BLOCK turns, each turn as `<|role|>`, newline, text, newline.

    turns: conv_id, turn, role, text.  A null role is `unknown`, a null text is
    empty.  Equal turn numbers go by role and text.  Repeated rows are turns of
    their own.  Other columns are ignored; an empty table gives no rows."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = maximal_turns(turns).groupBy("conv_id", "block", "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.col("block").cast("long").alias("part"), "n_turns", F.array_join(F.col("l.line"), "").alias("rendered"))


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT len(g) AS n, g FROM (SELECT list_slice(turns, 1, k) AS g FROM (SELECT turns, unnest(range(1, n)) AS k FROM c))),
kept AS (
  SELECT min(conv_id) AS conv_id, n FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = c.n AND p.g = c.turns) GROUP BY n, turns)
SELECT t.conv_id, CAST(floor(pos / 256) AS BIGINT) AS part, n AS n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept ON kept.conv_id = t.conv_id GROUP BY t.conv_id, part, n
"""
