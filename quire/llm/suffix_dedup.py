"""Suffix-array dedup: remove every byte covered by a string of `min_bytes`
bytes that also starts anywhere else.

All suffixes are too many to shuffle, so the suffix array is sparse.  Anchors
are minimizers: the position of the least k-gram hash in each run of `w`
positions.  Every window of `min_bytes` bytes has exactly one anchor, found
from the window's bytes alone, so equal windows have equal anchors at equal
offsets, and all windows of an anchor contain its core, the bytes right after
it.  Thus:

1. One pass over the texts gives each text its anchors with a hash of the core.
2. Cores seen once are dropped: their windows occur once.
3. The suffixes at the other anchors meet in the task of their core.  A
   deep-shallow sort of what follows the core, and the bytes before the anchor,
   give the first and last window that another occurrence shares.
4. A core shared by more than HOT texts isn't gathered: its windows are counted
   by a 128-bit hash, with partial aggregation before the shuffle.
5. Covered intervals return to their texts.

Texts with equal bytes take part once; such a text of `min_bytes` or more is
removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import in_few, staged, table, unstage
from quire.llm.deepshallow import repeated_offsets

K = 16  # bytes of a k-gram
HOT = 512
HOT_SHARE = 1000
_BLOCK = 1 << 19
_rng = np.random.default_rng(60_221_407)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = [(1 << i, np.uint64(int(_rng.integers(0, 2**62)) * 2 + 1)) for i in range(4)]
_POSITION = np.uint64((1 << 20) - 1)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _span(min_bytes: int) -> int:
    """w: positions of which one is an anchor."""
    return max(1, min(min_bytes // 2, min_bytes - K + 1))


def anchors(data: bytes, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of a text, each with the smallest and largest offset of
    the windows it stands for (windows start at position - offset)."""
    n, w = len(data), _span(min_bytes)
    windows = n - min_bytes + 1
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(windows, 0), _BLOCK):
        count = min(_BLOCK, windows - at)  # windows that start in this block
        h = _BYTE[np.frombuffer(data, np.uint8, count + w - 1 + K - 1, at)]
        for step, factor in _STEPS:
            h = h[:-step] * factor + h[step:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= ~_POSITION
        h |= np.arange(len(h), dtype=np.uint64)  # the least value also tells its position; ties: the leftmost
        size = 1
        while size * 2 <= w:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if size < w:
            h = np.minimum(h[: size - w], h[w - size :])
        found = (h & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        last = np.concatenate((first[1:], [count])) - 1
        position = found[first]
        parts.append((position + at, position - last, position - first))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def _core(min_bytes: int) -> int:
    return min_bytes - _span(min_bytes) + 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_ANCHORS = "array<struct<key:long,at:int,low:int,high:int>>"
_INDEX = f"doc_id long, d1 long, d2 long, n_words long, anchors {_ANCHORS}"


def _index(min_bytes: int) -> Callable:
    core = _core(min_bytes)
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, bounds = [], [0]
            keys, ats, lows, highs = [], [], [], []
            for text in batch.column(3).to_pylist():
                data = text.encode("utf-8", "surrogatepass") if text else b""
                n_words.append(len(data.split()))
                at, low, high = anchors(data, min_bytes)
                view = memoryview(data)
                keys += [_signed(xxhash.xxh3_64_intdigest(view[a : a + core])) for a in at.tolist()]
                ats.append(at)
                lows.append(low)
                highs.append(high)
                bounds.append(bounds[-1] + len(at))
            flat = [np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32) for x in (ats, lows, highs)]
            rows = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, flat)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)],
                names=["doc_id", "d1", "d2", "n_words", "anchors"],
            )

    return run


_PIECE = "key long, core2 long, d1 long, d2 long, at int, low int, left binary, tail binary"


def _pieces(min_bytes: int) -> Callable:
    core = _core(min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y, text, found in zip(d1, d2, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                out = [[] for _ in range(8)]
                for r in found:
                    if r["hot"]:
                        continue
                    a, low, high = r["at"], r["low"], r["high"]
                    inner = data[a : a + core]
                    row = (r["key"], _signed(xxhash.xxh3_64_intdigest(inner, seed=1)), x, y, a, low,
                           data[a - high : a], data[a + core : a + min_bytes - low])
                    for column, value in zip(out, row):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(["key", "core2", "d1", "d2", "at", "low", "left", "tail"], out)), schema=_PIECE_SCHEMA
                    )

    return run


_PIECE_SCHEMA = pa.schema(
    [("key", pa.int64()), ("core2", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32()), ("low", pa.int32()),
     ("left", pa.binary()), ("tail", pa.binary())]
)
_SPAN = "d1 long, d2 long, s long, e long"


def _sorted_groups(min_bytes: int) -> Callable:
    """Rows sorted by (key, core2): each group's shared windows, as intervals."""
    slack = _span(min_bytes) - 1

    def solve(group: list[tuple], out: list[list]) -> None:
        if len(group) < 2:
            return
        found = repeated_offsets([g[2] for g in group], [g[3] for g in group], slack)
        for (x, y, _, _, at), offsets in zip(group, found):
            if offsets:
                for column, value in zip(out, (x, y, at - offsets[1], at - offsets[0] + min_bytes)):
                    column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            key, core2, d1, d2, at, _, left, tail = (batch.column(i).to_pylist() for i in range(8))
            for k, c, x, y, a, l, t in zip(key, core2, d1, d2, at, left, tail):
                if (k, c) != current:
                    solve(group, out)
                    current, group = (k, c), []
                group.append((x, y, l, t, a))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d1", "d2", "s", "e"])
        out = [[], [], [], []]
        solve(group, out)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["d1", "d2", "s", "e"])

    return run


def _hot_windows(min_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y, text, found in zip(d1, d2, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                view = memoryview(text.encode("utf-8", "surrogatepass"))
                starts = [a for r in found if r["hot"] for a in range(r["at"] - r["high"], r["at"] - r["low"] + 1)]
                for i in range(0, len(starts), 10_000):
                    part = starts[i : i + 10_000]
                    digest = np.frombuffer(
                        b"".join([xxhash.xxh3_128_digest(view[s : s + min_bytes]) for s in part]), np.int64
                    ).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])),
                         pa.array([x] * len(part), pa.int64()), pa.array([y] * len(part), pa.int64()), pa.array(part, pa.int64())],
                        names=["w1", "w2", "d1", "d2", "s"],
                    )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping or touching spans joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _cut(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for x, y, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                runs = [(s, e) for s, e in merged([(r["s"], r["e"]) for r in spans]) if not min_words or len(data[s:e].split()) >= min_words]
                kept, characters, at = [], [], 0
                for s, e in [*runs, (len(data), len(data))]:
                    kept.append(data[at:s])
                    # the text keeps a character of which a byte is kept
                    while at < s and at > 0 and data[at] & 0xC0 == 0x80:
                        at -= 1
                    end = s
                    while at < end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    characters.append(data[at:end])
                    at = e
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                row = (x, y, sum(e - s for s, e in runs), len(runs), digest.hexdigest(), b"".join(characters).decode("utf-8", "surrogatepass"))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["d1", "d2", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and two 64-bit digests that stand for the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(17), text).alias("d2"), text.alias("text")
    )


def repeats(docs: DataFrame, min_bytes: int = 400, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(texts, cut): texts has a row per different text of `min_bytes` or more (d1,
    d2, n_words, copies: documents with this text); cut has a row per text that
    loses bytes but has no exact copy: d1, d2, n_removed, n_spans, kept_sha256,
    kept_text.  Covered runs of fewer than `min_words` words stay."""
    named = _identified(docs)
    index = staged(named.select("doc_id", "d1", "d2", "text").mapInArrow(_index(min_bytes), _INDEX), "sd-index")
    different = (
        index.filter("size(anchors) > 0").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    )
    texts = staged(in_few(different, index), "sd-texts")
    rows = texts.select("d1", "d2", "rep", F.explode("anchors").alias("r")).select("d1", "d2", "rep", "r.*")
    counts = staged(in_few(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), texts), "sd-cores")
    wanted = (
        rows.join(counts, "key")
        .groupBy("d1", "d2", "rep")
        .agg(F.collect_list(F.struct("key", "at", "low", "high", (F.col("n") > HOT).alias("hot"))).alias("found"))
    )
    same = (F.col("w.d1") == F.col("t.d1")) & (F.col("w.d2") == F.col("t.d2")) & F.col("w.rep").eqNullSafe(F.col("t.doc_id"))
    holders = staged(
        named.filter(F.octet_length("text") >= min_bytes).alias("t").join(wanted.alias("w"), same)
        .select("t.d1", "t.d2", "t.text", "w.found"),
        "sd-holders",
    )
    unstage(counts)
    pieces = holders.mapInArrow(_pieces(min_bytes), _PIECE).repartition("key", "core2").sortWithinPartitions("key", "core2")
    spans = staged(pieces.mapInArrow(_sorted_groups(min_bytes), _SPAN), "sd-spans")
    hot = staged(
        holders.filter(F.exists("found", lambda r: r["hot"])).mapInArrow(_hot_windows(min_bytes), "w1 long, w2 long, d1 long, d2 long, s long"),
        "sd-hot",
    )
    twice = staged(in_few(hot.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), hot), "sd-twice")
    hot_spans = hot.join(twice, ["w1", "w2"]).select("d1", "d2", "s", (F.col("s") + min_bytes).alias("e"))
    # runs of consecutive windows of one text become one span before the shuffle by text
    single = texts.filter("copies = 1").select("d1", "d2")
    lists = (
        spans.unionByName(hot_spans).distinct().groupBy("d1", "d2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        .join(single, ["d1", "d2"], "left_semi")
    )
    shorter = (
        holders.select("d1", "d2", "text").dropDuplicates(["d1", "d2"]).join(lists, ["d1", "d2"])
        .mapInArrow(_cut(min_words), "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    )
    cut = staged(in_few(shorter, holders, spans, hot), "sd-cut")
    for old in (index, holders, spans, hot, twice):
        unstage(old)
    return texts.select("d1", "d2", "n_words", "copies"), cut


def _with_cuts(docs: DataFrame, carried: Column, min_bytes: int, min_words: int) -> DataFrame:
    """row (`carried`), text, whole (a copied text, removed), n_removed, n_spans,
    kept_sha256, kept_text (null: the text loses nothing) for every row of docs.

    Texts that are too short meet nothing.  Copied texts need no more than their
    digests: those with over 1/HOT_SHARE of all rows, HOT_SHARE at most, are
    broadcast, so that no task gets all copies of one text."""
    texts, cut = repeats(docs, min_bytes, min_words)
    text = F.col("text").cast("string")
    rows = docs.select(carried.alias("row"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("d1"), F.xxhash64(F.lit(17), F.coalesce(text, F.lit(""))).alias("d2"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= min_bytes
    copied = texts.filter((F.col("copies") > 1) & (F.col("n_words") >= min_words)).withColumn("whole", F.lit(True))
    bound = (texts.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(copied.filter(F.col("copies") > bound).select("d1", "d2", "whole"))
    met = rows.filter(long).join(hot, ["d1", "d2"], "left")
    none = {"n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}
    shown = ["row", "text", "whole", *none]
    empty = {c: F.lit(None).cast(t) for c, t in none.items()}
    changes = cut.withColumn("whole", F.lit(False)).unionByName(copied.filter(F.col("copies") <= bound).select("d1", "d2", "whole").withColumns(empty))
    rest = met.filter("whole is null").drop("whole").join(changes, ["d1", "d2"], "left").select(*shown)
    done = met.filter("whole").withColumns(empty).select(*shown)
    short = rows.filter(~long).withColumns({"whole": F.lit(None).cast("boolean"), **empty}).select(*shown)
    return rest.unionByName(done).unionByName(short).withColumn("whole", F.coalesce("whole", F.lit(False)))


def repeat_report(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row.

    A null text counts as empty; texts shorter than `min_bytes` lose nothing.
    Strings never cross documents.  Two rows with the same doc_id are two
    documents.  kept_sha256 is of the remaining bytes; kept_text is what of the
    text can be shown of them (a character stays if one of its bytes does).  Other
    columns are ignored; an empty table gives no rows."""
    found = _with_cuts(docs, F.col("doc_id").cast("long"), min_bytes, 0).withColumn("text", F.coalesce("text", F.lit("")))
    n_bytes = F.octet_length("text").cast("long")
    return found.select(
        F.col("row").alias("doc_id"),
        n_bytes.alias("n_bytes"),
        F.when(F.col("whole"), n_bytes).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.sha2("text", 256))).alias("kept_sha256"),
        F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce("kept_text", "text")).alias("kept_text"),
    )


def without_repeats(docs: DataFrame, min_bytes: int = 400, min_words: int = 0) -> DataFrame:
    """`docs` with repeated strings cut out of `text` and `n_chars` renewed; all
    columns and rows stay, whatever their names.  A character goes only if all its
    bytes go; runs of fewer than `min_words` words stay.  A null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    found = _with_cuts(docs, F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]), min_bytes, min_words)
    text = F.when(F.col("text").isNotNull(), F.when(F.col("whole"), F.lit("")).otherwise(F.coalesce("kept_text", "text"))).alias("text")
    changed = F.col("whole") | F.col("kept_text").isNotNull()
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c) if c != "text" else text
        if c == "n_chars":
            own = F.when(changed, F.length(text)).otherwise(own).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return found.select(*out)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), 400)
