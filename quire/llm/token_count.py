"""Token counts by finite-state transducers.

The tokenizer drops white space, so a run of other bytes (a unit) is tokenized
without regard to what is around it.  The library's normalizer and pre-tokenizer
cut a unit into words; a word's tokens are counted by a deterministic transducer
compiled from the vocabulary's merges (`transducer.py`), whose transitions carry
emitted-token counts.  The path of a whole unit is kept as one transition of the
outer transducer: inside a unit its state is the unit read so far, and white
space goes back to the start and emits the unit's count.

A chunk of a text is summed up as its state map: the bytes before its first
white space (they end the unit that was open on entry), the count emitted
inside, and the bytes after its last white space (open on exit).  Maps compose
associatively.  Chunks of long texts are rows of their own, mapped in parallel,
and their maps are composed in a tree of FAN.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, staged, table, unstage
from quire.llm.transducer import Transducer

CHUNK = 1 << 16
FAN = 64  # maps composed at once
LIMIT = 2048
_GAP = re.compile(rb"[\x20\x09-\x0d]")


class UnitCounts(dict):
    """Transitions compiled so far: unit -> tokens emitted at its end."""

    SIZE = 600_000
    LONGEST = 64  # longer units are not kept

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def _counted(self, units: list[bytes]) -> np.ndarray:
        """Tokens of each unit: one for every special string, and those of the
        words of the rest."""
        number, parts, counts = [], [], np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            text = unit.decode("utf-8")
            rest = self.special.split(text) if "<" in text else [text]
            counts[i] += len(rest) - 1
            for part in rest:
                number.append(i)
                parts.append(part.lower() if part.isascii() else self.tokenizer.normalizer.normalize_str(part))
        starts = np.cumsum([0, *[len(t) + 1 for t in parts]])
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(parts))
        of = np.searchsorted(starts, np.fromiter((a for _, (a, _) in words), np.int64, len(words)), side="right") - 1
        tokens = np.fromiter((self.words.count(w) for w, _ in words), np.int64, len(words))
        np.add.at(counts, np.array(number, np.int64)[of], tokens)
        return counts

    def compile(self, units: set[bytes]) -> dict[bytes, int]:
        """Counts of those `units` that are new."""
        new = [u for u in units if u not in self]
        if not new:
            return {}
        if len(self) + len(new) > self.SIZE:
            self.clear()
            new = list(units)
        counts = dict(zip(new, self._counted(new).tolist()))
        self.update((u, n) for u, n in counts.items() if len(u) <= self.LONGEST)
        return counts

    def total(self, units: list[bytes]) -> int:
        try:
            return sum(map(self.__getitem__, units))
        except KeyError:
            fresh = self.compile(set(units))
            return sum(self[u] if u in self else fresh[u] for u in units)


# head, emitted, tail; without any white space all bytes are in head and tail is None
StateMap = tuple[bytes, int, bytes | None]


def state_map(chunk: bytes, counts: UnitCounts) -> StateMap:
    first = _GAP.search(chunk)
    if not first:
        return chunk, 0, None
    units = chunk[first.start() :].split()
    tail = b"" if _GAP.match(chunk, len(chunk) - 1) else units.pop()
    return chunk[: first.start()], counts.total(units), tail


def composed(maps: list[StateMap], counts: UnitCounts) -> StateMap:
    """The map of the chunks one after the other.  A unit that goes on over several
    chunks is joined once."""
    head, emitted, open_unit = [], 0, None
    for first, inside, last in maps:
        (head if open_unit is None else open_unit).append(first)
        if last is None:
            continue
        if open_unit is not None and (unit := b"".join(open_unit)):
            emitted += counts.total([unit])
        emitted, open_unit = emitted + inside, [last]
    return b"".join(head), emitted, None if open_unit is None else b"".join(open_unit)


def closed(whole: StateMap, counts: UnitCounts) -> int:
    """Tokens of a text with this map: entered at the start state, closed at its end."""
    return whole[1] + counts.total([u for u in (whole[0], whole[2]) if u])


@functools.cache
def _compiled(path: str) -> UnitCounts:
    """One table per worker process and tokenizer."""
    return UnitCounts(path)


def lowered(data: bytes) -> bytes:
    """The tokenizer ignores case, but for the strings of special tokens, so
    upper-case letters share the units of lower-case ones."""
    return data if b"<|" in data else data.lower()


def _short(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _compiled(path)
        for batch in batches:
            tokens = [counts.total(lowered((t or "").encode("utf-8")).split()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


_MAP = "key string, no long, head binary, emitted long, tail binary"


def _map_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "no", "head", "emitted", "tail"]
    )


def _mapped(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _compiled(path)
        for batch in batches:
            key, no, data = (batch.column(i).to_pylist() for i in range(3))
            yield _map_batch([(k, n, *state_map(d, counts)) for k, n, d in zip(key, no, data)])

    return run


def _folded(path: str) -> Callable:
    """Rows sorted by key and no: one map for every FAN of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, group, maps = _compiled(path), None, []
        for batch in batches:
            done = []
            for key, no, *one in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (key, no // FAN) != group:
                    if maps:
                        done.append((*group, *composed(maps, counts)))
                    group, maps = (key, no // FAN), []
                maps.append(tuple(one))
            yield _map_batch(done)
        if maps:
            yield _map_batch([(*group, *composed(maps, counts))])

    return run


def _closed(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _compiled(path)
        for batch in batches:
            maps = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([closed(m, counts) for m in maps], pa.int64())], names=["key", "n_tokens"])

    return run


def long_counts(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """texts (key, text), equal texts under equal keys -> key, n_tokens, one row a
    key.  No task holds more than a few chunks, or FAN maps, of a text; a unit
    without white space that goes over several chunks is joined whole."""
    plain = F.when(F.instr("text", "<|") > 0, F.col("text")).otherwise(ascii_lower("text"))
    data = texts.select("key", plain.cast("binary").alias("data"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("data") - 1) / chunk)))
    pieces = data.select("key", "data", at.alias("no")).select("key", "no", F.expr(f"substring(data, cast(no * {chunk} + 1 as int), {chunk})").alias("data"))
    once = pieces.groupBy("key", "no").agg(F.first("data").alias("data"))
    maps = staged(once.mapInArrow(_mapped(path), _MAP), "tc-maps")
    last = maps.agg(F.max("no")).first()[0] or 0
    while last:
        fold = maps.repartition("key", F.floor(F.col("no") / FAN)).sortWithinPartitions("key", "no").mapInArrow(_folded(path), _MAP)
        before, maps, last = maps, staged(fold, "tc-maps"), last // FAN
        unstage(before)
    return maps.mapInArrow(_closed(path), "key string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs (doc_id, text).

    `tokenizer_path` names a `tokenizers` file of byte-level pairs whose
    pre-tokenizer drops white space; the executors read it.  Texts of more than
    `chunk` bytes are counted by chunks.  A null text counts as empty.  Repeated
    rows are counted each; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    short = rows.filter(F.col("n_bytes") <= chunk).mapInArrow(_short(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.filter(F.col("n_bytes") > chunk).withColumn("key", F.sha2("text", 256))
    found = keyed.select("doc_id", "n_bytes", "key").join(long_counts(keyed, tokenizer_path, chunk), "key")
    return short.unionByName(found.drop("key")).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
