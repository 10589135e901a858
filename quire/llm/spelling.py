"""Spelling variant grouping: words one edit apart, found through Bloom filters.

1. Words and their counts come from all texts by one partial + final aggregate.
2. Every word length has a blocked Bloom filter (512-bit blocks, one bit in each
   of a block's eight 64-bit words).  The blocks are made by a `bit_or` aggregate,
   so no task holds the vocabulary.  All lengths' blocks stand in one address
   space, which is broadcast in passes of at most PASS_BLOCKS blocks.
3. Every word generates its edits: all single deletions, and all replacements by
   a greater character of the vocabulary's alphabet.  Insertions and the other
   replacements are the same pairs seen from the other word.  A rolling hash
   gives each edit's key in constant time, so no edit is spelled out before the
   filter accepts it.
4. Only accepted edits are shuffled, to an exact join with the vocabulary that
   drops the false positives.  A word has at most a few thousand possible
   neighbours, so no join key is heavier than that.
5. Forms point to words of ten times the count, so chains are as short as the
   decimal logarithm of the largest count; roots come by pointer doubling.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, staged, table, unstage

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_RATIO = 10
DROP_EVERY = 31

BITS_PER_WORD = 12
PASS_BLOCKS = 1 << 19  # 32 MB of filter at most in one broadcast
LONGEST_SHARD = 1024  # all longer words share one filter
_STEP = 1 << 21  # edits tested at once
_WORDS_PER_TASK = 20_000

_rng = np.random.default_rng(31_415_927)
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = int(_rng.integers(0, 2**62)) * 2 + 1
_INVERSE = np.uint64(pow(_FACTOR, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = h + np.uint64(length)
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Shards:
    """Where the filter of each word length lies in the common address space."""

    def __init__(self, counts: dict[int, int]):
        """`counts`: number of words of each length up to LONGEST_SHARD."""
        self.start, self.size, at = {}, {}, 0
        for length, n in sorted(counts.items()):
            self.start[length], self.size[length] = at, -(-n * BITS_PER_WORD // 512)
            at += self.size[length]
        self.blocks = at

    def address(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Block and 48 bits of position of the words of one length with hashes h
        (None: no word has this length)."""
        shard = min(length, LONGEST_SHARD)
        if shard not in self.start:
            return None
        m = _mixed(h, length)
        block = ((m >> np.uint64(32)) * np.uint64(self.size[shard])) >> np.uint64(32)
        return block + np.uint64(self.start[shard]), m * _MIX1 >> np.uint64(16)


def _bit(places: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1) << ((places >> np.uint64(6 * i)) & np.uint64(63))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, index in `words`, letters as a matrix) for each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        room = max(1, (1 << 22) // length)
        for i in range(0, len(at), room):
            part = at[i : i + room]
            data = "".join([words[j] for j in part.tolist()]).encode("latin-1")
            yield length, part, np.frombuffer(data, np.uint8).reshape(len(part), length)


def _marks(shards: Shards) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in _by_length(batch.column(0).to_pylist()):
                h = (_LETTER[letters] * _powers(length)).sum(axis=1, dtype=np.uint64)
                block, places = shards.address(h, length)
                columns = [block.view(np.int64), *(_bit(places, i).view(np.int64) for i in range(8))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", *(f"w{i}" for i in range(8))])

    return run


class Filter:
    """The blocks `first` to `first + len(blocks)` of all filters."""

    def __init__(self, shards: Shards, first: int, blocks: np.ndarray):
        self.shards, self.first, self.blocks = shards, np.uint64(first), blocks

    def accepted(self, h: np.ndarray, length: int) -> np.ndarray:
        """Indices of the hashes of words of one length that may be known."""
        found = self.shards.address(h, length)
        if found is None or not len(self.blocks):
            return np.empty(0, np.int64)
        block, places = found
        block = block - self.first  # lower blocks wrap round to large numbers
        at = np.flatnonzero(block < np.uint64(len(self.blocks)))
        for i in range(8):
            hit = self.blocks[block[at].astype(np.int64), i] & _bit(places[at], i)
            at = at[hit != 0]
        return at


def _deletions(letters: np.ndarray, known: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
    """(row, place, None) of accepted deletions; of a run of equal letters only
    the last, as all give the same word."""
    n, length = letters.shape
    value = _LETTER[letters] * _powers(length)
    before = np.cumsum(value, axis=1, dtype=np.uint64)
    h = (before - value) + (before[:, -1:] - before) * _INVERSE
    last = np.ones((n, length), bool)
    last[:, :-1] = letters[:, :-1] != letters[:, 1:]
    flat = np.flatnonzero(last)
    at = flat[known.accepted(h.ravel()[flat], length - 1)]
    yield at // length, at % length, None


def _replacements(letters: np.ndarray, alphabet: np.ndarray, known: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, new letter) of accepted replacements by a greater letter."""
    n, length = letters.shape
    power = _powers(length)
    own = _LETTER[letters] * power
    total = own.sum(axis=1, dtype=np.uint64)
    step = max(1, _STEP // max(1, n * len(alphabet)))
    for i in range(0, length, step):
        places = slice(i, min(length, i + step))
        rest = total[:, None] - own[:, places]
        h = rest[:, :, None] + (_LETTER[alphabet][None, :] * power[places, None])[None]
        flat = np.flatnonzero(alphabet[None, None, :] > letters[:, places, None])
        at = flat[known.accepted(h.ravel()[flat], length)]
        row, left = np.divmod(at, h.shape[1] * len(alphabet))
        place, new = np.divmod(left, len(alphabet))
        yield row, place + i, alphabet[new]


def _edits(alphabet: np.ndarray, known) -> Callable:
    """Words (word, n) -> accepted edits (word, n, near).  `known` is the
    broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = known.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], []]
            for length, at, letters in _by_length(words):
                room = max(1, _STEP // (length * 8))
                for i in range(0, len(at), room):
                    part = letters[i : i + room]
                    small = max(1, _STEP // max(1, len(alphabet) * min(length, 32)))
                    found = [_deletions(part, bloom)]
                    found += [((r + j, p, c) for r, p, c in _replacements(part[j : j + small], alphabet, bloom)) for j in range(0, len(part), small)]
                    for rows, places, new in (x for part_found in found for x in part_found):
                        fresh = [None] * len(rows) if new is None else new.tolist()
                        for r, p, c in zip(rows.tolist(), places.tolist(), fresh):
                            j = int(at[i + r])
                            word = words[j]
                            out[0].append(word)
                            out[1].append(counts[j])
                            out[2].append(word[:p] + ("" if c is None else chr(c)) + word[p + 1 :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["word", "n", "near"]
            )

    return run


def word_counts(docs: DataFrame, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, n: runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, A-Z
    lower-cased, with MIN_LETTERS or more and MIN_COUNT or more occurrences.  A
    run whose crc32 with its doc_id is divisible by `drop_every` loses one letter."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}"), F.lit(0))).alias("run"),
    )
    keyed = runs.select("id", ascii_lower("run").alias("run"))
    keyed = keyed.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = keyed.select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n for every pair of words one edit apart, in both
    directions.  `words` is a staged table (word, n) of distinct words with
    characters up to U+00FF."""
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD))
    sizes = words.groupBy(shard.alias("length")).agg(F.count("*").alias("n")).collect()  # LONGEST_SHARD rows at most
    shards = Shards({r["length"]: r["n"] for r in sizes})
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint8)  # 256 rows at most
    tasks = spark.sparkContext.defaultParallelism + sum(r["n"] for r in sizes) // _WORDS_PER_TASK
    dealt = words.select("word", "n").repartition(tasks)
    names = [f"w{i}" for i in range(8)]
    marks = words.select("word").mapInArrow(_marks(shards), "block long, " + ", ".join(f"{w} long" for w in names))
    blocks = staged(marks.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names]), "sp-blocks")
    found = None
    for first in range(0, max(shards.blocks, 1), PASS_BLOCKS):
        size = min(PASS_BLOCKS, shards.blocks - first)
        part = blocks.filter((F.col("block") >= first) & (F.col("block") < first + size)).toArrow()  # PASS_BLOCKS rows at most
        bits = np.zeros((size, 8), np.uint64)
        at = part.column("block").to_numpy() - first
        for i, w in enumerate(names):
            bits[at, i] = part.column(w).to_numpy().view(np.uint64)
        known = spark.sparkContext.broadcast(Filter(shards, first, bits))
        edits = dealt.mapInArrow(_edits(alphabet, known), "word string, n long, near string")
        found = edits if found is None else found.unionByName(edits)
    unstage(blocks)
    known_words = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = staged(found.join(known_words, "near").select("word", "n", "near", "near_n"), "sp-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variants(docs: DataFrame, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text).

    Two words are near if one inserted, deleted or replaced code point makes them
    equal.  A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that n is FORM_RATIO times its own or more, else null;
    root follows forms to the last.  Null and empty texts have no words, a null
    doc_id counts as an empty one, repeated rows count each, other columns are
    ignored, and an empty table gives no rows."""
    words = staged(word_counts(docs, drop_every), "sp-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    formed = F.col("best").isNotNull() & (-F.col("best.order") >= FORM_RATIO * F.col("n"))
    out = staged(
        words.join(best, "word", "left").select(
            "word",
            F.when(formed, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, -F.col("best.order")).alias("form_n"),
        ),
        "sp-forms",
    )
    most = out.agg(F.max("n")).first()[0] or 0
    longest = int(math.log10(max(1, most // MIN_COUNT))) + 1  # steps of the longest possible chain
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    unstage(words)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
