"""Cross-tokenizer alignment: how two tokenizers cut the same bytes.

Tokens of both cut a text's bytes, so every stretch between two neighbouring
token ends (of either) lies in one token of each: these stretches are the links,
and the ends that both share close the groups.  How often a pair of ids is linked
in the whole corpus is counted through a minimal perfect hash:

1. First pass: tasks align their texts and give their distinct pairs with counts.
2. The distinct pairs are dealt into shards by hash; every shard's task builds the
   minimal perfect hash of its pairs.
3. The counts of a task become one dense vector a shard, indexed by the hash, and
   vectors are added up in a tree of FAN_IN, so no task meets those of all tasks.
4. Second pass: the texts are aligned again and every link's count is looked up by
   its pair's hash, after the key stored there was compared.  Hash, keys and
   counts are broadcast in parts of at most PART_PAIRS pairs, one pass a part.

Texts are cut before single spaces between visible ASCII or Latin letters.  No
token of either tokenizer goes over such a place, so the tokens of the units
between are the text's; a unit is aligned once, when a task first meets it.  Long
texts are taken in parts, and the units held are bounded.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import perfect_hash
from quire.llm.common import staged, table, unstage

FLUSH = 1 << 19  # characters taken at once
HELD = 1 << 22  # characters of units from which a task starts anew with none
LONG = 1 << 17  # characters of a unit that the fast tokenizer isn't given
SHARD_PAIRS = 1 << 14
PART_PAIRS = 1 << 22  # of 20 bytes each, broadcast at once
TASK_PAIRS = 1 << 20  # distinct pairs a task holds before it gives them out
FAN_IN = 16
_CUT = re.compile(r" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
_B = 1 << 20  # a pair is a * _B + b


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer's ids, the bytes of each and their decimal digits."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.tokens, self.encode = tokens, encode
        self.length = np.array([len(t) for t in tokens], np.int64)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.zeros((len(tokens), 8), np.uint8)
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)

    def spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_level_side(path: str) -> Side:
    """Side A from a byte-level `tokenizers` file whose ids are in merge order:
    encodes its texts without special tokens, whose strings are plain text.  The
    same ranks run in tiktoken, which is several times faster; a very long piece
    (no safe place to cut) goes to the file's own library."""
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    letters = _byte_letters()
    special = whole.get_added_tokens_decoder()
    ids = sorted((i, t) for t, i in whole.get_vocab(with_added_tokens=True).items())
    tokens = [b""] * (ids[-1][0] + 1)
    for i, t in ids:
        tokens[i] = t.encode() if i in special else bytes(map(letters.__getitem__, t))
    ranks = {tokens[i]: i for i, _ in ids if i not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [whole.encode(t, add_special_tokens=False).ids if len(t) > LONG else fast.encode_ordinary(t) for t in texts]

    return Side(tokens, encode)


def piece_side(path: str) -> Side:
    """Side B from a `sentencepiece` file, which adds the space before a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(tokens, lambda texts: model.encode(texts, num_threads=1))


@functools.cache
def _sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """One pair of tokenizers per worker process."""
    return byte_level_side(path_a), piece_side(path_b)


def pieces(text: str, size: int) -> list[str]:
    """The text cut at safe spaces, which go, into pieces of about `size`."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def _align(a: Side, b: Side, ids_a: list[list[int]], ids_b: list[list[int]]):
    """Units aligned at once: per unit its tokens and groups, its groups as text
    and its number of links, and the pair of every link."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
    end_a, end_b = np.cumsum(a.length[flat_a]), np.cumsum(b.length[flat_b])
    ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")
    twice = ends[1:] == ends[:-1]
    both, ends = ends[1:][twice], ends[np.append(True, ~twice)]
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    unit_of_a = np.repeat(np.arange(len(n_a)), n_a)
    n_links = np.bincount(unit_of_a[at_a], minlength=len(n_a))
    n_groups = np.bincount(unit_of_a[np.searchsorted(end_a, both)], minlength=len(n_a))
    # text of the groups: ids in order of (group, side), each with what follows it
    side = np.concatenate((np.searchsorted(both, end_a) * 2, np.searchsorted(both, end_b) * 2 + 1))
    order = np.argsort(side, kind="stable")
    side = side[order]
    digits = np.concatenate((a.digits[flat_a], b.digits[flat_b]))[order]
    width = np.concatenate((a.n_digits[flat_a], b.n_digits[flat_b]))[order]
    after = np.where(np.append(side[1:], -1) == side, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
    digits[np.arange(len(width)), width] = after
    text = digits[np.arange(8) <= width[:, None]].tobytes()
    written = np.cumsum(width + 1)
    bounds = np.concatenate(([0], written[np.cumsum(n_a + n_b) - 1])).tolist()
    texts = [text[s : e - 1] for s, e in zip(bounds, bounds[1:])]
    return n_a, n_b, n_groups, n_links, texts, flat_a[at_a] * _B + flat_b[at_b]


def _summed(pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their links."""
    order = np.argsort(pair, kind="stable")
    pair, links = pair[order], links[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    return pair[first], np.add.reduceat(links, first) if len(first) else links


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Units:
    """The units met so far: stretches between safe spaces.  Both tokenizers cut a
    unit without regard to what is around it, so it is aligned when first met.
    `counts` gives its links' figures in the second pass."""

    def __init__(self, a: Side, b: Side, counts: Counts | None = None):
        self.a, self.b, self.counts = a, b, counts
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size = 0  # characters held
        self.groups: list[bytes] = []
        self.valid = np.empty(0, bool)
        self.figures = np.empty((len(_FIGURES), 0), np.int64)
        self.pairs = np.empty(0, np.int64)

    def numbers(self, units: list[str]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if new:
            self._compile(new)
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    def _compile(self, new: list[str]) -> None:
        ids_a, ids_b = self.a.encode([" " + u for u in new]), self.b.encode(new)
        valid = np.zeros(len(new), bool)
        for i, u in enumerate(new):
            want = (" " + u).encode("utf-8", "surrogatepass")
            valid[i] = self.a.spelled(ids_a[i]) == want and self.b.spelled(ids_b[i]) == want
        good = np.flatnonzero(valid)
        figures = np.zeros((len(_FIGURES), len(new)), np.int64)
        groups = [b""] * len(new)
        if len(good):
            *four, texts, pairs = _align(self.a, self.b, [ids_a[i] for i in good], [ids_b[i] for i in good])
            figures[:4, good] = four
            for i, text in zip(good.tolist(), texts):
                groups[i] = text
            if self.counts:
                keys, at = np.unique(pairs, return_inverse=True)
                n, best = self.counts.of(keys)
                starts = np.cumsum(four[3]) - four[3]
                figures[4, good] = np.add.reduceat(best[at].astype(np.int64), starts)
                figures[5, good] = np.add.reduceat(n[at], starts)
            else:
                self.pairs = np.concatenate((self.pairs, pairs))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.size += sum(map(len, new))
        self.groups += groups
        self.valid = np.concatenate((self.valid, valid))
        self.figures = np.concatenate((self.figures, figures), axis=1)

    def links(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and their links, every unit taken `times`."""
        return _summed(self.pairs, np.repeat(times, self.figures[3]))


@dataclass
class Block:
    """Some texts as numbers of units, text by text from `starts`; or a part of
    one text, the last one or not."""

    rows: list[int]
    starts: np.ndarray
    numbers: np.ndarray
    part: bool = False
    last: bool = True

    def valid(self, units: Units) -> np.ndarray:
        return np.logical_and.reduceat(units.valid[self.numbers], self.starts)


def blocks(units: Units, texts: list[str | None], flush: int | None = None) -> Iterator[Block]:
    """All texts but null and empty ones."""
    flush = flush or FLUSH
    rows, starts, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        if len(text) > flush and len(parts := pieces(text, flush)) > 1:
            for i, part in enumerate(parts):
                yield Block([row], np.zeros(1, np.int64), units.numbers(_CUT.split(part)), True, i + 1 == len(parts))
            continue
        rows.append(row)
        starts.append(len(held))
        held += _CUT.split(text)
        size += len(text)
        if size >= flush:
            yield Block(rows, np.array(starts), units.numbers(held))
            rows, starts, held, size = [], [], [], 0
    if rows:
        yield Block(rows, np.array(starts), units.numbers(held))


class LinkCounts:
    """Links by pair, of which a bounded number is held."""

    def __init__(self):
        self.held = [(np.empty(0, np.int64),) * 2]  # the first: all so far, added up

    def add(self, keys: np.ndarray, links: np.ndarray) -> bool:
        """Whether more than TASK_PAIRS are held now."""
        self.held.append((keys, links))
        if sum(len(k) for k, _ in self.held[1:]) > max(1 << 18, len(self.held[0][0])):
            self.held = [self.total()]
        return len(self.held[0][0]) > TASK_PAIRS

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*self.held)))


def _count(paths: tuple[str, str]) -> Callable:
    """Pairs with their links, per task."""

    def out(part: int, keys: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            k, n = keys[i : i + (1 << 16)], links[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part, np.int64)), pa.array(k), pa.array(n)], names=["part", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = Units(*_sides(*paths)), TaskContext.get().partitionId()
        counts, times = LinkCounts(), np.empty(0, np.int64)
        of_text, text_valid = LinkCounts(), True  # of a text that comes in parts
        for batch in batches:
            for block in blocks(units, batch.column(0).to_pylist()):
                valid = block.valid(units)
                taken = np.bincount(block.numbers[np.repeat(valid, np.diff(block.starts, append=len(block.numbers)))], minlength=len(units.number))
                if block.part:
                    of_text.add(*units.links(taken))
                    text_valid = text_valid and bool(valid[0])
                    if block.last:
                        if text_valid:
                            counts.add(*of_text.total())
                        of_text, text_valid = LinkCounts(), True
                else:
                    taken[: len(times)] += times
                    times = taken
                if units.size > HELD:
                    times.resize(len(units.number))
                    counts.add(*units.links(times))
                    units.clear()
                    times = np.empty(0, np.int64)
                if len(counts.held[0][0]) > TASK_PAIRS:
                    yield from out(part, *counts.total())
                    counts = LinkCounts()
        times = np.append(times, np.zeros(len(units.number) - len(times), np.int64))
        counts.add(*units.links(times))
        yield from out(part, *counts.total())

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Batches of rows sorted by their first `by` columns, cut into runs."""
    open_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(by)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = tuple(keys[:, s].tolist())
            if key != open_key:
                if held:
                    yield open_key, held
                open_key, held = key, []
            held.append(batch.slice(s, e - s))
    if held:
        yield open_key, held


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, pair) sorted by shard -> each shard's perfect hash."""
    for (shard,), held in _runs(batches, 1):
        keys = np.concatenate([h.column(1).to_numpy() for h in held])
        sizes, words, ordered = perfect_hash.build(keys)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "sizes": sizes, "words": words.tobytes(), "pairs": ordered.tobytes()}],
            pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("pairs", pa.binary())]),
        )


def _vector_row(group: int, shard: int, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int64()), pa.array([shard], pa.int64()), pa.array([vector.tobytes()], pa.binary())], names=["node", "shard", "vector"]
    )


def _vectors(known, sizes) -> Callable:
    """Rows (node, shard, pair, n) sorted by both -> a dense vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = known.value
        for (node, shard), held in _runs(batches, 2):
            vector = np.zeros(sizes[shard], np.int64)
            for h in held:
                np.add.at(vector, hashes.number(h.column(2).to_numpy()) - hashes.first[shard], h.column(3).to_numpy())
            yield _vector_row(node, shard, vector)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shard, vector) sorted by both -> their sums."""
    for (node, shard), held in _runs(batches, 2):
        total = None
        for h in held:
            for vector in h.column(2):
                v = np.frombuffer(vector.as_buffer(), np.int64)
                total = v.copy() if total is None else np.add(total, v, out=total)
        yield _vector_row(node, shard, total)


_VECTOR = "node long, shard long, vector binary"


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards' (pairs, vector) -> the highest count of each b in a shard."""
    for batch in batches:
        for pairs, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b, n = np.frombuffer(pairs, np.int64) % _B, np.frombuffer(vector, np.int64)
            order = np.lexsort((n, b))
            last = np.append(b[order][1:] != b[order][:-1], True)
            yield pa.RecordBatch.from_arrays([pa.array(b[order][last]), pa.array(n[order][last])], names=["b", "n"])


class Counts:
    """Some shards' pairs and counts by perfect hash, and the highest count of
    every b."""

    def __init__(self, hashes: perfect_hash.Shards, pairs: np.ndarray, counts: np.ndarray, highest: np.ndarray):
        self.hashes, self.pairs, self.counts, self.highest = hashes, pairs, counts, highest

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, is the highest of its b) of each pair; 0 for pairs of others."""
        place = self.hashes.number(pairs)
        n = np.zeros(len(pairs), np.int64)
        at = np.flatnonzero(place >= 0)
        at = at[self.pairs[place[at]] == pairs[at]]  # the stored key tells whether it is this pair
        n[at] = self.counts[place[at]]
        return n, (n > 0) & (n == self.highest[pairs % _B])


def _look_up(paths: tuple[str, str], known) -> Callable:
    """(keys ..., text) -> (keys ..., figures, groups_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*_sides(*paths), known.value)
        for batch in batches:
            out = np.zeros((len(_FIGURES), batch.num_rows), np.int64)
            sha = [""] * batch.num_rows
            digest, text_valid = hashlib.sha256(), True  # of a text that comes in parts
            for block in blocks(units, batch.column(batch.num_columns - 1).to_pylist()):
                valid = block.valid(units)
                out[:, block.rows] += np.add.reduceat(units.figures[:, block.numbers], block.starts, axis=1)
                spelled = list(map(units.groups.__getitem__, block.numbers.tolist()))
                if block.part:
                    digest.update(b";".join(spelled) + (b"" if block.last else b";"))
                    text_valid = text_valid and bool(valid[0])
                    if block.last:
                        valid[0], sha[block.rows[0]] = text_valid, digest.hexdigest()
                        digest, text_valid = hashlib.sha256(), True
                else:
                    for row, s, e in zip(block.rows, block.starts.tolist(), [*block.starts[1:].tolist(), len(spelled)]):
                        sha[row] = hashlib.sha256(b";".join(spelled[s:e])).hexdigest()
                if block.last:
                    for row in np.asarray(block.rows)[~valid].tolist():
                        out[:, row], sha[row] = 0, ""
                if units.size > HELD:
                    units.clear()
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [batch.schema.field(i).name for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x) for x in out), pa.array(sha, pa.string())], names=[*names, *_FIGURES, "groups_sha256"])

    return run


def _tree_sum(vectors: DataFrame, tasks: int) -> DataFrame:
    """shard, vector: the vectors of `tasks` leaves added up, FAN_IN at a time."""
    while tasks > 1:
        up = vectors.select(F.floor(F.col("node") / FAN_IN).cast("long").alias("node"), "shard", "vector")
        vectors = up.repartition("node", "shard").sortWithinPartitions("node", "shard").mapInArrow(_added, _VECTOR)
        tasks = -(-tasks // FAN_IN)
    return vectors.select("shard", "vector")


def pair_counts(texts: DataFrame, paths: tuple[str, str]) -> tuple[DataFrame, int]:
    """(shard, sizes, words, pairs, vector) of the corpus, staged, and the number
    of shards.  `texts` has the column text."""
    spark = texts.sparkSession
    partial = staged(texts.mapInArrow(_count(paths), "part long, pair long, n long"), "ta-partial")
    distinct = staged(partial.select("pair").distinct(), "ta-pairs")
    n, tasks = distinct.count(), (partial.agg(F.max("part")).first()[0] or 0) + 1
    shards = max(1, -(-n // SHARD_PAIRS))

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = perfect_hash.shard_of(batch.column(0).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0)], names=["shard", "pair"])

    dealt = distinct.mapInArrow(with_shard, "shard long, pair long").repartition("shard").sortWithinPartitions("shard")
    hashes = staged(dealt.mapInArrow(_hashes, "shard long, sizes array<long>, words binary, pairs binary"), "ta-hashes")
    unstage(distinct)
    # under 4 bits a pair: 100 million pairs take 50 MB; more are hashed part by part
    leaves = None
    for some in _parts(hashes, PART_PAIRS * 8):
        rows = hashes.filter(F.col("shard").between(some[0], some[1])).select("shard", "sizes", "words", F.octet_length("pairs").alias("n")).collect()
        known = spark.sparkContext.broadcast(perfect_hash.Shards(shards, [(r["shard"], r["sizes"], bytes(r["words"])) for r in rows]))
        sizes = {r["shard"]: r["n"] // 8 for r in rows}

        def leaf(batches: Iterator[pa.RecordBatch], sizes=sizes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = perfect_hash.shard_of(batch.column(1).to_numpy(), shards)
                own = pa.array(np.isin(shard, np.fromiter(sizes, np.int64, len(sizes))))
                columns = [batch.column(0), pa.array(shard), batch.column(1), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shard", "pair", "n"]).filter(own)

        split = partial.mapInArrow(leaf, "node long, shard long, pair long, n long").repartition("node", "shard").sortWithinPartitions("node", "shard")
        vectors = split.mapInArrow(_vectors(known, sizes), _VECTOR)
        leaves = vectors if leaves is None else leaves.unionByName(vectors)
    if leaves is None:
        leaves = spark.createDataFrame([], _VECTOR)
    counted = staged(hashes.join(_tree_sum(leaves, tasks), "shard"), "ta-counts")
    unstage(partial)
    unstage(hashes)
    return counted, shards


def _parts(hashes: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of shards with at most `most` pairs each (one shard at least)."""
    out, size = [], 0
    for r in hashes.select("shard", (F.octet_length("pairs") / 8).alias("n")).orderBy("shard").collect():
        if out and size + r["n"] <= most:
            out[-1], size = (out[-1][0], r["shard"]), size + r["n"]
        else:
            out.append((r["shard"], r["shard"]))
            size = r["n"]
    return out


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for
    every row of `docs` (doc_id, text).

    `path_a` names a byte-level `tokenizers` file, `path_b` a `sentencepiece` file;
    the executors read both.  Null and empty texts, and texts that a tokenizer
    doesn't give back byte by byte after a space, have no tokens: zeros, no links
    and an empty hash.  Repeated rows count each, ties for the highest count are
    all best, other columns are ignored, and an empty table gives no rows."""
    spark, paths = docs.sparkSession, (path_a, path_b)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counted, shards = pair_counts(rows.select("text"), paths)
    best = counted.select("pairs", "vector").mapInArrow(_highest, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).toArrow()  # a row per id of B
    highest = np.zeros(max([0, *best.column("b").to_pylist()]) + 1, np.int64)
    highest[best.column("b").to_numpy()] = best.column("n").to_numpy()
    ranges = _parts(counted, PART_PAIRS) or [(0, 0)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in _FIGURES)
    if len(ranges) > 1:  # passes meet again by a row number, which only a written table keeps
        rows = staged(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "ta-rows")
    passes = []
    for first, last in ranges:
        held = counted.filter(F.col("shard").between(first, last)).orderBy("shard").collect()  # PART_PAIRS at most
        hashes = perfect_hash.Shards(shards, [(r["shard"], r["sizes"], bytes(r["words"])) for r in held])
        pairs, counts = (np.frombuffer(b"".join(bytes(r[c]) for r in held), np.int64) for c in ("pairs", "vector"))
        known = spark.sparkContext.broadcast(Counts(hashes, pairs, counts, highest))
        row = "row long, " if len(ranges) > 1 else ""
        passes.append(rows.mapInArrow(_look_up(paths, known), f"doc_id {kind}, {row}{figures}, groups_sha256 string"))
    unstage(counted)
    if len(passes) == 1:
        return passes[0]
    both = functools.reduce(DataFrame.unionByName, passes)
    summed = {"n_best", "count_sum"}
    total = both.groupBy("row").agg(*[(F.sum if c in summed else F.max)(c).alias(c) for c in ("doc_id", *_FIGURES, "groups_sha256")])
    return total.drop("row")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
