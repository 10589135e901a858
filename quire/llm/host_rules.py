"""Host-level quality rules.

Every text is measured and tested against the rules; failures are added up by
host (partial aggregates, so a host with a third of all rows is one row a task
before the shuffle).  Small hosts say little, so each rule's rate is shrunk: an
empirical beta prior is fitted to all hosts by the method of moments, and a
host's rate is the posterior mean.  A host of which most documents fail a rule,
after shrinking, loses all its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import staged, table

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
WORD_LENGTH = (3, 10)
HOST_LIMIT = 0.5
HOT_SHARE = 1000  # a host with more than 1/HOT_SHARE of all rows is joined by broadcast

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BLOCK = 1 << 20
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _word_ids(data: bytes) -> np.ndarray:
    """A number per word, equal for equal words.  Long texts are split block by
    block, so only the distinct words and four bytes a word are held."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):  # a block ends at white space, wherever that is
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        parts.append(np.array([known.setdefault(w, len(known)) for w in data[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)
    key = pair[:-1].astype(np.int64) << 32 | ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(key)] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The values of _MEASURES for one text (null: all 0)."""
    if not text:
        return (0,) * len(_MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    ids = _word_ids(data)
    seen, lines = set(), 0
    start = 0
    while start <= len(data):
        end = data.find(b"\n", start)
        end = len(data) if end < 0 else end
        line = data[start:end]
        if line.strip():
            lines += 1
            seen.add(line)
        start = end + 1
    return (
        len(ids),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        lines - len(seen),
        repeated_words(ids),
        lines,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measures(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(_MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(_MEASURES)))],
            names=["doc_id", "host", *_MEASURES],
        )


def rules() -> dict[str, Column]:
    """Failed rules of a measured document."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_LENGTH[0] * words) | (F.col("word_chars") > WORD_LENGTH[1] * words),
    }


def prior(hosts: DataFrame, rule: str) -> list[Column]:
    """Sums over all hosts from which the beta prior of a rule follows."""
    k, n = F.col(f"k_{rule}").cast("double"), F.col("n").cast("double")
    return [F.sum(k).alias(f"k_{rule}"), F.sum(k * k / n).alias(f"q_{rule}")]


def beta(hosts: float, n: float, n2: float, k: float, q: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior by the moments of rates weighted by host
    size: `hosts` hosts, sums of n, n^2, failures k and k^2/n.  Hosts that differ
    no more than chance give an infinite strength: all have the mean rate."""
    mean = k / n
    spread = q - n * mean * mean  # sum of n (rate - mean)^2
    chance, room = mean * (1 - mean) * (hosts - 1), mean * (1 - mean) * (n - n2 / n - (hosts - 1))
    if room <= 0:
        return mean, float("inf")
    rho = min((spread - chance) / room, 1.0)
    return mean, float("inf") if rho <= 0 else (1 - rho) / rho


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, a shrunk rate per rule, host_failed: some rate is above `limit`.
    Documents without a host (null) belong to none."""
    named = rules()
    counted = staged(
        measured.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"k_{r}") for r, c in named.items()]),
        "hr-hosts",
    )
    sums = [s for r in named for s in prior(counted, r)]
    total = counted.agg(F.count("*").alias("hosts"), F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), *sums).first()
    rates = {}
    for r in named:
        mean, strength = beta(total["hosts"], total["n"], total["n2"], total[f"k_{r}"], total[f"q_{r}"]) if total["hosts"] else (0.0, 0.0)
        k, n = F.col(f"k_{r}"), F.col("n")
        rates[r] = F.lit(mean) if strength == float("inf") else (k + mean * strength) / (n + strength)
    out = counted.select("host", "n", *[v.cast("double").alias(f"rate_{r}") for r, v in rates.items()])
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in named], F.lit(0.0)) > limit)


def quality_report(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, host_failed, host_rate (the host's largest shrunk rate) for
    every row of `docs` (doc_id, text and the column `host`).

    A null or empty text has no words and fails.  A document without a host gets
    no host verdict (host_failed false, host_rate null).  Repeated rows are judged
    and counted each, ties don't arise, other columns are ignored, and an empty
    table gives no rows."""
    rows = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = staged(rows.mapInArrow(_measured, f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in _MEASURES)), "hr-measured")
    verdicts = host_verdicts(measured, limit)
    rate = F.greatest(*[F.col(f"rate_{r}") for r in rules()])
    verdicts = staged(verdicts.select("host", "n", rate.alias("host_rate"), "host_failed"), "hr-verdicts")
    hot = measured.count() // HOT_SHARE
    # at most HOT_SHARE hosts have so many rows: their rows stay where they are
    heavy = verdicts.filter(F.col("n") > hot).select("host", F.struct("host_rate", "host_failed").alias("heavy"))
    light = verdicts.filter(F.col("n") <= hot).select("host", F.struct("host_rate", "host_failed").alias("light"))
    met = measured.join(F.broadcast(heavy), "host", "left")
    rest = met.filter("heavy is null and host is not null").drop("heavy").join(light, "host", "left").withColumnRenamed("light", "verdict")
    done = met.filter("heavy is not null or host is null").withColumnRenamed("heavy", "verdict")
    named = rules()
    failed = named["short"] | named["repeats"]
    host_failed = F.coalesce("verdict.host_failed", F.lit(False))
    return done.unionByName(rest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~host_failed).alias("kept"), host_failed.alias("host_failed"), F.col("verdict.host_rate").alias("host_rate"),
    )


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("host_rate")


_FAILS = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def _rate_sql(rule: str) -> str:
    """A rule's prior from all hosts, as `beta` fits it, and the hosts' rates."""
    return f"""
p_{rule} AS (
  SELECT sum(k) / sum(n) AS mean, sum(k * k / n) - sum(n) * (sum(k) / sum(n)) * (sum(k) / sum(n)) AS spread,
    sum(n) AS total, sum(n * n) AS squares, count(*) AS hosts
  FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(k_{rule} AS DOUBLE) AS k FROM h)),
r_{rule} AS (
  SELECT *, CASE WHEN mean * (1 - mean) * (total - squares / total - (hosts - 1)) <= 0 THEN 0
    ELSE least((spread - mean * (1 - mean) * (hosts - 1)) / (mean * (1 - mean) * (total - squares / total - (hosts - 1))), 1) END AS rho
  FROM p_{rule}),
b_{rule} AS (
  SELECT source, CASE WHEN rho <= 0 THEN mean ELSE (k_{rule} + mean * (1 - rho) / rho) / (n + (1 - rho) / rho) END AS rate FROM h, r_{rule})"""


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM x),
z AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y WHERE n > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup, 0) AS n_dup_lines,
    coalesce(z.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM d LEFT JOIN z USING (doc_id) LEFT JOIN l USING (doc_id)),
h AS (
  SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS k_{r}" for r, c in _FAILS.items())}
  FROM m WHERE source IS NOT NULL GROUP BY source),
{",".join(map(_rate_sql, _FAILS))},
v AS (
  SELECT source, greatest({", ".join(f"b_{r}.rate" for r in _FAILS)}) > 0.5 AS host_failed
  FROM h {" ".join(f"JOIN b_{r} USING (source)" for r in _FAILS)}),
f AS (
  SELECT m.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(v.host_failed, false) AS host_failed
  FROM m LEFT JOIN v USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed FROM f
"""
