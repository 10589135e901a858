"""MinHash near-duplicate detection with SetSketch registers.

1. One pass over the texts gives each document its set size, a 128-bit set
   digest and its registers.  Documents with equal sets form one class, so a
   group of exact copies goes on as one representative.
2. Register bands deal the representatives into buckets.  Each member is
   paired with its bucket's smallest id (a star), never with all the others.
3. Pairs are kept if the sizes allow the threshold and the joint
   maximum-likelihood estimate is not far below it, then confirmed on the full
   shingle sets.
4. Members of one bucket that are still in different components are compared
   too: in small buckets as pairs, in large ones block against block by matrix
   products over their full sets, so no rows are made for the pairs.
5. Confirmed links and class membership give connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import setsketch as ss
from quire.llm.common import broadcast_if_small, in_few, staged, table, unstage
from quire.llm.components import NODE_BYTES, connected_components

BAND_ROWS = 5
BANDS = ss.REGISTERS // BAND_ROWS
# A pair whose estimate is this far (over five standard errors) below the
# threshold is not confirmed on the full sets.
MARGIN = 0.2
# Members of larger buckets are compared in blocks (step 4).
LARGE_BUCKET = 48
BLOCK = 128
SALTS = 64
_COLUMNS = 8192


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        size, high, low, regs = [], [], [], []
        for s in ss.shingle_sets(texts):
            a, b = ss.set_digest(s)
            size.append(len(s))
            high.append(a)
            low.append(b)
            regs.append(ss.registers(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(regs, pa.binary())],
            names=["doc_id", "n", "hi", "lo", "regs"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (set size), hi, lo (set digest), regs."""
    return docs.select("doc_id", "text").mapInArrow(_sketches, "doc_id long, n long, hi long, lo long, regs binary")


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, star, n_a, n_b, regs_a, regs_b = (batch.column(i) for i in range(7))
            both = [np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, ss.REGISTERS) for x in (regs_a, regs_b)]
            keep = ss.likely_jaccard(*both, n_a.to_numpy().astype(float), n_b.to_numpy().astype(float)) >= threshold
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (a, b, star)], names=["a", "b", "star"])

    return run


def likely_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, star) of representatives whose sizes allow the threshold
    and whose estimated similarity is within MARGIN of it."""
    side = lambda x: reps.select(
        F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")
    )
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return (
        sized.filter(fits)
        .select("a", "b", "star", "n_a", "n_b", "regs_a", "regs_b")
        .mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long, star boolean")
    )


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, {}
        for batch in batches:
            grp, a, b, texts = (batch.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for g, x, y, s in zip(grp, a, b, ss.shingle_sets(texts)):
                if g != group:
                    group, firsts = g, {}
                if y is None:
                    firsts.setdefault(x, []).append(s)
                    continue
                for first in firsts.get(x, ()):
                    both = len(np.intersect1d(first, s, assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(s) - both):
                        out_a.append(x)
                        out_b.append(y)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold.  A task holds one first
    text at a time; a first text with many partners is dealt to SALTS groups."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    grp = F.xxhash64("a", "salt").alias("grp")
    first = salted.select("a", "salt").distinct().select(grp, "a", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    sides = first.unionByName(salted.select(grp, "a", "b", F.col("b").alias("doc_id")))
    rows = sides.join(texts, "doc_id").select("grp", "a", "b", "text")
    return (
        rows.repartition("grp")
        .sortWithinPartitions("grp", "a", F.col("b").asc_nulls_first())
        .mapInArrow(_verify(percent), "a long, b long")
    )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of 0/1 matrices over
    _COLUMNS shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1  # shingles of one set only don't matter
    use = seen[column] > 1
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        first, last = np.searchsorted(column, (low, low + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[first:last], column[first:last] - low] = 1.0
        total += part @ part.T
    return total.astype(np.int64)


def _block_links(percent: int) -> Callable:
    """Rows sorted by pair of blocks: one link for each two components that meet."""

    def solve(ids: list[int], component: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        both, size, of = shared_counts(sets), np.array([len(s) for s in sets]), np.array(component)
        link = (both * 100 >= percent * (size[:, None] + size[None, :] - both)) & (of[:, None] < of[None, :])
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in zip(*np.nonzero(link)):
            first.setdefault((component[i], component[j]), (ids[i], ids[j]))
        return list(first.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, ([], [], [])

        def done() -> pa.RecordBatch:
            found = solve(*group) if len(group[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            pair, ids, component, texts = (batch.column(i).to_pylist() for i in range(4))
            for p, i, c, s in zip(pair, ids, component, ss.shingle_sets(texts)):
                if p != current:
                    yield done()
                    current, group = p, ([], [], [])
                for column, value in zip(group, (i, c, s)):
                    column.append(value)
        yield done()

    return run


def block_links(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """placed (cluster, doc_id, component): links (a, b) between documents of one
    cluster and different components.  Members are dealt into blocks of about
    BLOCK, large components into blocks of their own; a task compares two blocks
    by matrix products and returns one link for each two components, so neither
    pairs of documents nor a cluster as a whole are ever held as rows."""
    sizes = staged(in_few(placed.groupBy("cluster", "component").agg(F.count("*").alias("c")), placed), "nd-sizes")
    mixed = sizes.groupBy("cluster").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("c") < BLOCK / 2, F.col("c")).otherwise(0)).alias("pooled")).filter("kinds > 1")
    share = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / BLOCK))
    own = F.col("c") >= BLOCK / 2
    block = F.when(own, F.xxhash64("component", share("doc_id", "c"))).otherwise(F.xxhash64(F.lit("pool"), share("component", "pooled")))
    dealt = staged(
        placed.join(sizes, ["cluster", "component"]).join(mixed, "cluster")
        .select("cluster", "doc_id", "component", block.alias("block"), F.when(own, F.col("component")).alias("pure")),
        "nd-dealt",
    )
    blocks = dealt.select("cluster", "block", "pure").distinct()
    x, y = blocks.toDF("cluster", "block_a", "pure_a"), blocks.toDF("cluster", "block_b", "pure_b")
    pairs = staged(
        x.join(y, "cluster").filter("block_a <= block_b and (pure_a is null or pure_b is null or pure_a <> pure_b)")
        .select("cluster", "block_a", "block_b", F.xxhash64("cluster", "block_a", "block_b").alias("pair")),
        "nd-blocks",
    )
    sides = pairs.select("cluster", F.col("block_a").alias("block"), "pair").unionByName(pairs.select("cluster", F.col("block_b").alias("block"), "pair")).distinct()
    rows = dealt.join(sides, ["cluster", "block"]).select("pair", "doc_id", "component").join(texts, "doc_id").select("pair", "doc_id", "component", "text")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of distinct five-word shingles; component_id is the smallest doc_id
    reachable, kept marks it.  A null or empty text has n_shingles 0 and links
    with nothing.  Rows that repeat a doc_id are one document with several
    texts.  A null doc_id links with nothing, has a null component_id and is
    kept.  Other columns are ignored; an empty table gives no rows."""
    texts_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = staged(sketches(texts_in), "nd-sketch")
    sets = sk.filter("n > 0 and doc_id is not null")
    # equal sets have equal registers, so any member's stand for the class
    classes = sets.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"))
    reps = staged(in_few(classes, sk), "nd-reps")
    members = sets.select("doc_id", "hi", "lo", "n").join(reps.select("hi", "lo", "n", F.col("doc_id").alias("rep")), ["hi", "lo", "n"])
    bands = staged(
        reps.select(
            "doc_id",
            F.explode(
                F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {BAND_ROWS} + 1, {BAND_ROWS})))")
            ).alias("bucket"),
        ),
        "nd-bands",
    )
    buckets = bands.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
    heads = staged(in_few(buckets.filter("head < last").select("bucket", "head", "size"), bands), "nd-heads")
    crowded = staged(bands.join(broadcast_if_small(heads, NODE_BYTES), "bucket"), "nd-crowded")
    unstage(bands)
    small, large = crowded.filter(F.col("size") <= LARGE_BUCKET), crowded.filter(F.col("size") > LARGE_BUCKET)
    star = crowded.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    inside = small.select("bucket", F.col("doc_id").alias("a")).join(small.select("bucket", F.col("doc_id").alias("b")), "bucket").filter("a < b")
    pairs = star.withColumn("star", F.lit(True)).unionByName(inside.select("a", "b", F.lit(False).alias("star")))
    likely = staged(likely_pairs(pairs.groupBy("a", "b").agg(F.bool_or("star").alias("star")), reps, percent), "nd-likely")
    involved = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(large.select("doc_id")).distinct()
    texts = staged(texts_in.join(involved.hint("merge"), "doc_id", "left_semi"), "nd-texts")

    links = staged(in_few(confirmed(likely.filter("star"), texts, percent), likely, texts), "nd-links")
    parts = staged(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), sources=(links,)), "nd-parts")
    # pairs of small buckets that are still apart
    near = broadcast_if_small(parts, NODE_BYTES)
    part_of = lambda x: near.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    apart = likely.filter(~F.col("star")).join(part_of("a"), "a", "left").join(part_of("b"), "b", "left")
    apart = apart.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    more = staged(in_few(confirmed(apart, texts, percent), likely, texts), "nd-more")
    # large buckets, joined to clusters
    clusters = connected_components(large.select(F.col("doc_id").alias("src"), F.col("head").alias("dst")), sources=(crowded,))
    placed = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(part_of("doc_id"), "doc_id", "left")
    placed = staged(placed.select("cluster", "doc_id", F.coalesce("c_doc_id", "doc_id").alias("component")), "nd-placed")
    blocked = staged(block_links(placed, texts, percent), "nd-block-links")

    edges = parts.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(
        more.unionByName(blocked).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    edges = edges.unionByName(members.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")))
    found = connected_components(edges, sources=(parts, more, blocked, sk))
    component = F.coalesce("component", "doc_id")
    out = sk.select("doc_id", "n").join(found, sk.doc_id == found.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
    for old in (texts, crowded, heads, likely, links, placed):
        unstage(old)
    return out


def op3_minhash_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
