"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests
(DataFrame functions only).

A sketch of g groups has CELLS cells a group.  A paragraph digest belongs to one
group and to one cell in each of the group's three blocks; a cell holds the
number of its digests, their XOR, and the XOR of their check values.  Sketches
of two versions subtract cell by cell: what both have cancels.  Peeling takes a
cell with one digest left, removes the digest from its other cells, and so on;
it recovers the differing digests if all cells empty.  If not, both sketches
are made again with more groups; a difference too large for the most groups is
counted from the digests themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import staged, table, unstage

BLOCK = 5
CELLS = 3 * BLOCK
ROUNDS = 6
RETRIES = (4, 16, 64)  # groups of the larger sketches; beyond, the digests are intersected
_BUCKET_ROWS = 256
_MAX_BUCKETS = 1 << 16
_FAN = 256


def digests(text: str) -> str:
    """SQL: distinct 64-bit digests of the text's paragraphs (lines); an empty
    text has none."""
    return f"array_distinct(transform(split(nullif({text}, ''), '\\n'), x -> xxhash64(x)))"


def _check(k: str) -> str:
    return f"xxhash64({k}, 7L)"


def _cells_of(k: str, salt: int) -> str:
    """SQL: bits of the digest's three cells; sketches of another salt deal
    digests out anew."""
    h = f"xxhash64({k}, {salt}L)" if salt else k
    places = (f"pmod({h}, {BLOCK})", f"pmod(shiftright({h}, 16), {BLOCK}) + {BLOCK}", f"pmod(shiftright({h}, 32), {BLOCK}) + {2 * BLOCK}")
    return "(" + " | ".join(f"shiftleft(1, cast({x} as int))" for x in places) + ")"


_EMPTY = f"array_repeat(named_struct('c', 0L, 'k', 0L, 'h', 0L), {CELLS})"


def _added(cells: str, keyed: str, sign: str) -> str:
    """SQL: `cells` after adding (sign 1) or removing (-1) the entries of
    `keyed`, an array of (k, n, h, at: bits of the cells)."""
    return (
        f"transform({cells}, (x, i) -> aggregate(filter({keyed}, p -> (shiftright(p.at, i) & 1) = 1), x, "
        f"(a, p) -> named_struct('c', a.c + ({sign}) * p.n, 'k', a.k ^ p.k, 'h', a.h ^ p.h)))"
    )


def sketch(keys: str, salt: int = 0) -> str:
    """SQL: the cells of one group that holds the digests in array `keys`."""
    entries = f"transform({keys}, k -> named_struct('k', k, 'n', 1L, 'h', {_check('k')}, 'at', {_cells_of('k', salt)}))"
    return _added(_EMPTY, entries, "1L")


def difference(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells: str, salt: int = 0) -> str:
    """SQL: (cells, found): what is left after peeling, and the digests found."""
    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<bigint>))"
    pure = f"filter(s.cells, x -> abs(x.c) = 1L and x.h = {_check('x.k')})"
    taken = f"array_distinct(transform({pure}, x -> named_struct('k', x.k, 'n', x.c, 'h', x.h, 'at', {_cells_of('x.k', salt)})))"
    # one-element transforms bind a value that is used more than once
    step = (
        f"element_at(transform(array({taken}), t -> if(size(t) = 0, s, named_struct('cells', {_added('s.cells', 't', '-1L')}, "
        "'found', concat(s.found, transform(t, p -> p.k))))), 1)"
    )
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step})"


def _empty(cells: str) -> str:
    return f"forall({cells}, x -> x.c = 0L and x.k = 0L and x.h = 0L)"


def differing(a: str, b: str, groups: int) -> str:
    """SQL: the digests in just one of the arrays `a` and `b`, recovered from
    sketches of `groups` (a power of two) groups; null if peeling fails."""
    of = lambda keys: f"filter({keys}, k -> (shiftright(k, 48) & {groups - 1}L) = g)"
    one = f"element_at(transform(array({peel(difference(sketch(of(a), groups), sketch(of(b), groups)), groups)}), s -> if({_empty('s.cells')}, s.found, null)), 1)"
    # after a group that fails the rest isn't peeled
    return f"aggregate(sequence(0L, {groups - 1}L), cast(array() as array<bigint>), (f, g) -> if(f is null, f, concat(f, {one})))"


def written(cells: str, n: str) -> str:
    """SQL: the sketch as a string."""
    return (
        f"concat_ws(';', cast({n} as string), transform({cells}, x -> concat(cast(x.c as string), ':', lower(hex(x.k)), ':', lower(hex(x.h)))))"
    )


def _with_likeness(df: DataFrame, name: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """Adds `name`: Jaccard similarity of the paragraph sets, from the number of
    differing digests that peeling recovers or, if every size fails, from the
    digests that both have."""
    first = f"element_at(transform(array({peel(difference(cells_a, cells_b))}), s -> if({_empty('s.cells')}, s.found, null)), 1)"
    df = df.withColumn("__d0", F.when(F.expr(f"{cells_a} = {cells_b}"), F.expr("cast(array() as array<bigint>)")).otherwise(F.expr(first)))
    last = "__d0"
    for groups in RETRIES:
        again = F.expr(differing(a, b, groups))
        df = df.withColumn(f"__d{groups}", F.when(F.col(last).isNotNull(), F.col(last)).otherwise(again))
        last = f"__d{groups}"
    total = f"(size({a}) + size({b}))"
    found = f"size({last})"
    both = f"size(array_intersect({a}, {b}))"
    alike = f"element_at(transform(array({both}), n -> n / cast({total} - n as double)), 1)"
    value = f"case when {total} = 0 then 1D when {last} is null then {alike} else ({total} - {found}) / cast({total} + {found} as double) end"
    return df.withColumn(name, F.expr(value)).drop("__d0", *[f"__d{g}" for g in RETRIES])


def _bucket(bounds: list[int]) -> Column:
    """Number of `bounds` (sorted) at or below doc_id, found in two steps."""
    if not bounds:
        return F.lit(0)
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    literal = F.lit(bounds)
    coarse = F.greatest(below(F.lit(bounds[::_FAN])) - 1, F.lit(0)) * _FAN
    return F.coalesce(coarse + below(F.slice(literal, coarse + 1, F.lit(_FAN))), F.lit(0))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` (doc_id and `columns`) with next_<column>: the value of the next row
    by ascending doc_id (null first, equal ids by content); after the last, the
    first.

    Rows are dealt into ranges of doc_id.  The first row of a range also goes to
    the range before, so each range finds its successors by itself; the ranges'
    first rows, at most _MAX_BUCKETS, are the only rows in one task."""
    n = rows.count()
    wanted = min(_MAX_BUCKETS, n // _BUCKET_ROWS)
    bounds: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * wanted))).first()[0]
        bounds = sorted(set(found or []))
    keyed = rows.select("doc_id", *columns, F.xxhash64(*columns).alias("tie"), _bucket(bounds).alias("bucket"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    lowest = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie"))
    firsts = staged(keyed.groupBy("bucket").agg(lowest.alias("m")).select("bucket", "m.doc_id", "m.tie"), "fp-firsts")
    by_bucket = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.partitionBy()))
    to = F.broadcast(firsts.select(F.col("doc_id").alias("f_id"), F.col("tie").alias("f_tie"), before.alias("to")))
    copies = (
        keyed.join(to, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")))
        .select("doc_id", *columns, "tie", F.col("to").alias("bucket")).dropDuplicates(["bucket"])
    )
    both = keyed.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    w = Window.partitionBy("bucket").orderBy(F.col("copy"), *order)
    led = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.filter("copy = 0").select("doc_id", *columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next per row of docs (doc_id, text).

    The edited text has its last floor(n_chars / 4) code points replaced by as
    many (or all) first ones of the next row's text by ascending doc_id, after
    the last the first; a single row is its own next.  A null text counts as
    empty.  Rows that repeat a doc_id follow each other.  Other columns are
    ignored; an empty table gives no rows."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(text, ["text"])
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[F.coalesce(F.expr(digests(c)), F.expr("cast(array() as array<bigint>)")).alias(d) for c, d in (("text", "a"), ("edited", "e"), ("next_text", "b"))],
    )
    # the digests are used many times below: stage them, so that they are made once
    rows = staged(rows, "fp-digests")
    rows = rows.select("*", *[F.expr(sketch(d)).alias(f"cells_{d}") for d in "aeb"])
    rows = rows.withColumn("fingerprint", F.expr(written("cells_a", "size(a)"))).withColumn("edited_fingerprint", F.expr(written("cells_e", "size(e)")))
    rows = _with_likeness(rows, "near_edited", "a", "e", "cells_a", "cells_e")
    rows = _with_likeness(rows, "near_next", "a", "b", "cells_a", "cells_b")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
