"""Mixing sources to target weights by Pareto order sampling (DataFrame
functions only).

A source's share of the mix is its weight's share of all words, at most `cap`
times its own words; what is over goes to the others by weight.  A document's
expected number of copies is lambda = target * w / sum(w * size) with its
inclusion weight w (1 unless given), at most `cap`.  floor(lambda) copies are
certain; for the rest p, documents are ranked by Pareto's quantity
(u / (1 - u)) / (p / (1 - p)), u a hash of the document, and taken in that order
up to the source's remaining words; last, the document that brings a source
nearest to its target is added, NEAREST_ROUNDS times while one does.

The cut in the order is found by radix selection: sums of sizes by source and
leading digits of the rank, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import in_few, space_words, staged, table, unstage

CAP = 3.0
DIGIT_BITS = 12
LEVELS = 2
NEAREST_ROUNDS = 3  # documents added at the end, one at a time
_KEY_BITS = DIGIT_BITS * LEVELS


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source", ((F.row_number().over(order) - 1) % 3 + 1).cast("double").alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size), weights (source, weight) -> source,
    source_size, target.  Water filling in closed form: sources reach their cap
    in the order of size / weight, so one sorted pass over the sources finds the
    level at which the rest share what is left.  One row per source."""
    both = sizes.alias("a").join(weights.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "source_size", "weight")
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = both.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    # the first source below its cap sets the level for itself and all after it
    shared = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    return ranked.withColumn("level", shared["level"]).select(
        "source", "source_size", F.least(F.col("level") * F.col("weight"), cap * F.col("source_size")).cast("double").alias("target")
    )


def _rank_key(seed: int):
    """The rank as an integer of _KEY_BITS bits: v = q / (1 + q) for Pareto's q.  u
    hashes id, text and size, so rows that share or lack an id don't tie."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size"), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    return F.least(F.floor(odds / (1 + odds) * float(1 << _KEY_BITS)), F.lit((1 << _KEY_BITS) - 1)).cast("long")


def _taken_in_order(ranked: DataFrame, need: DataFrame, share: float) -> DataFrame:
    """Set `extra` to 1 for documents in the order of `key`, up to the words in
    need (source, need), among those with a key, not taken yet and not longer
    than the need.  The document at the cut is taken if `share` of it fits."""
    open_ = F.col("key").isNotNull() & (F.col("extra") == 0)
    left = staged(need.withColumn("prefix", F.lit(0).cast("long")).withColumn("most", F.col("need")), "mx-need")
    for level in range(1, LEVELS + 1):
        # words by source and next digit, among the ranks that start like the cut
        shift = _KEY_BITS - level * DIGIT_BITS
        here = (
            F.col("r.source").eqNullSafe(F.col("c.source"))
            & (F.shiftright("r.key", shift + DIGIT_BITS) == F.col("c.prefix"))
            & (F.col("r.size") <= F.col("c.most"))
        )
        digits = ranked.filter(open_).alias("r").join(left.alias("c"), here)
        words = digits.groupBy(F.col("r.source").alias("source"), F.shiftright("r.key", shift).alias("prefix"), "need", "most").agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        walked = words.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        # the digit in which the need is reached
        cut = walked.filter("before <= need").groupBy("source").agg(
            F.max(F.struct("prefix", (F.col("need") - F.col("before")).alias("need"), "most")).alias("m")
        )
        before, left = left, staged(cut.select("source", "m.prefix", "m.need", "m.most"), f"mx-cut{level}")
        unstage(before)
    at_cut = ranked.alias("r").join(left.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.*", "prefix", "need", "most")
    candidate = open_ & F.col("prefix").isNotNull() & (F.col("size") <= F.col("most"))
    in_order = Window.partitionBy("source").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tied = F.coalesce(candidate & (F.col("key") == F.col("prefix")), F.lit(False))
    ties = at_cut.filter(tied).withColumn(
        "extra", (F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") * share <= F.col("need")).cast("int")
    )
    others = at_cut.filter(~tied).withColumn("extra", F.when(F.coalesce(candidate & (F.col("key") < F.col("prefix")), F.lit(False)), 1).otherwise(F.col("extra")))
    return others.unionByName(ties).drop("prefix", "need", "most")


def _nearest(ranked: DataFrame) -> DataFrame:
    """Set `extra` to 1 for one more document of each source: the one whose size
    comes nearest to what its source still needs, if it brings the source nearer
    (ties: the first in the order of `key`)."""
    need = ranked.groupBy("source").agg((F.sum(F.col("part") * F.col("size")) - F.sum(F.col("extra") * F.col("size"))).alias("need"))
    gap = F.abs(F.col("n.need") - F.col("r.size"))
    open_ = ranked.filter(F.col("key").isNotNull() & (F.col("extra") == 0)).alias("r")
    best = (
        open_.join(need.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source"))).filter(gap < F.abs(F.col("n.need")))
        .groupBy("r.source").agg(F.min(F.struct(gap.alias("gap"), "r.key", "r.row")).alias("m")).select("m.row", F.lit(1).alias("more"))
    )
    return ranked.join(best, "row", "left").withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0))).drop("more")


def mixed(docs: DataFrame, weights: DataFrame | None = None, cap: float = CAP, seed: int = 4, weight_column: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, text_hash per row of `docs`.

    size: words of the text (null: 0); taken = copies * size.  `weights`
    (source, weight > 0) defaults to 1, 2, 3 in the order of the sources.  A null
    source is a source of its own.  Rows that repeat doc_id and text tie and
    are interchangeable.
    Documents without words are never taken.  Other columns are ignored; an
    empty table gives no rows.  The same table gives the same mix."""
    own = F.col(f"`{weight_column}`").cast("double") if weight_column else F.lit(1.0)
    sized = staged(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.col("source").cast("string").alias("source"),
            F.size(space_words(F.col("text").cast("string"))).cast("long").alias("size"),
            F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(0.0)).alias("w"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        ),
        "mx-sized",
    )
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("weighed")), "mx-sums")
    sizes = sums.select("source", "source_size")
    targets = source_targets(sizes, cycled_weights(sizes.select("source")) if weights is None else weights, cap)
    plan = staged(targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "weighed"), "mx-plan")
    d = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_size", "target", "weighed")
    copies = F.when((F.col("size") > 0) & (F.col("weighed") > 0), F.least(F.col("target") * F.col("w") / F.col("weighed"), F.lit(cap))).otherwise(0.0)
    d = d.withColumn("expected", copies).withColumn("certain", F.floor("expected")).withColumn("part", F.col("expected") - F.col("certain"))
    d = d.withColumn("key", F.when(F.col("part") > 0, _rank_key(seed)))
    ranked = staged(d.select("doc_id", "row", "text_hash", "source", "size", "source_size", "target", "certain", "part", "key"), "mx-ranked")

    need = ranked.groupBy("source").agg(F.sum(F.col("part") * F.col("size")).alias("need"))
    first = staged(_taken_in_order(ranked.withColumn("extra", F.lit(0)), need, 1.0), "mx-first")
    # the document at the cut may be long: what it would have filled goes to
    # later documents that fit, again in order; a few more may then come nearer
    rest = first.groupBy("source").agg((F.sum(F.col("part") * F.col("size")) - F.sum(F.col("extra") * F.col("size"))).alias("need"))
    chosen = staged(_taken_in_order(first, rest, 1.0), "mx-second")
    for i in range(NEAREST_ROUNDS):
        chosen = staged(in_few(_nearest(chosen), chosen), f"mx-near{i}")
    out = chosen.withColumn("copies", (F.col("certain") + F.col("extra")).cast("int"))
    for old in (sums, plan):
        unstage(old)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "text_hash")


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
