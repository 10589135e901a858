"""Rows of a heavy table that a key set asks for.

The key set is measured.  A small one is broadcast.  For a larger one the heavy
rows would be shuffled to meet it; so a blocked Bloom filter of the keys is made
first, by a `bit_or` aggregate, and broadcast as a table of blocks.  The scan of
the heavy side probes one block a row by an equi-join on the block's number, and
only rows that pass are shuffled to the exact semi-join, which drops the false
positives (about one in two hundred).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import session

BITS_PER_KEY = 16
WORDS = 8  # of 64 bits in a block
# Largest filter that is broadcast (about 57 million keys); beyond it the exact
# semi-join shuffles the heavy side.
FILTER_BYTES = 128 * 1024 * 1024


def key_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0 ... w7: the filter of the distinct keys in the only column of
    `keys`.  Partial aggregates, so a task holds its own blocks only."""
    key = keys.columns[0]
    return keys.groupBy(_block(key, blocks)).agg(*[F.bit_or(_bit(key, i)).alias(f"w{i}") for i in range(WORDS)])


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64(`{key}`), {blocks}L)").alias("__block")


def _bit(key: str, i: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(1, `{key}`), {6 * i}) & 63 as int))")


def may_hold(heavy: DataFrame, column: str, blocks_of: DataFrame, blocks: int) -> DataFrame:
    """The rows of `heavy` whose `column` the filter accepts: all wanted ones, and
    about one in two hundred of the others."""
    probe = blocks_of.withColumnRenamed("__block", "__b")
    hit = F.expr(f"pmod(xxhash64(`{column}`), {blocks}L)") == F.col("__b")
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(column, i)) != 0)
    return heavy.join(F.broadcast(probe), hit, "left_semi")


def wanted_rows(heavy: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of `heavy` whose `column` is among that of `wanted`."""
    keys, small = session.measured_keys(wanted.select(column).distinct())
    if not small:
        blocks = max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS)))
        if blocks * 8 * (WORDS + 1) <= FILTER_BYTES:
            heavy = may_hold(heavy, column, key_filter(keys, blocks), blocks)
    return heavy.join(keys, column, "left_semi")
