"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts are sums over all labelled documents, made per task as sparse
vectors and added up by Spark.  The log-probability matrix (languages x
BUCKETS floats) is broadcast; its size is bounded by MAX_LANGUAGES.  Scoring
multiplies a batch's sparse n-gram counts with the matrix in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256  # 16 MB of matrix at most
SMOOTHING = 0.5
UNKNOWN = "und"
# a text is unlike its language if its mean log probability per n-gram is this
# many standard deviations of the labelled rows, and this much, below their mean
SPREADS = 8.0
MIN_SPREAD = 2.5
_BLOCK = 1 << 18  # characters taken at once
_NOT_LETTERS = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F\d]+")
_FACTOR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, block by block.  Blocks overlap, so
    every n-gram of the text is in exactly one."""
    top = max(ORDERS)
    for at in range(0, len(text), _BLOCK):
        code = np.frombuffer(text[at : at + _BLOCK + top - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(_BLOCK, len(text) - at) if at + _BLOCK < len(text) else len(code)
        h = np.zeros(len(code), np.uint32)
        for order in ORDERS:
            h = h[: len(code) - order + 1] * np.uint32(0x01000193) + code[order - 1 :] * _FACTOR[0] if order > 1 else code * _FACTOR[0]
            mixed = (h ^ (h >> np.uint32(15))) * _FACTOR[order - 1]
            yield ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))[:own].astype(np.int64)


def gram_counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for buckets in gram_buckets(text):
        out += np.bincount(buckets, minlength=BUCKETS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def rows(lang: str, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], documents[lang]))],
            names=["lang", "bucket", "n"],
        )

    documents: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in totals:
                if len(totals) >= MAX_LANGUAGES:  # bounded memory: hand over what there is
                    for name, total in totals.items():
                        yield rows(name, total)
                    totals.clear()
                    documents.clear()
                totals[lang], documents[lang] = np.zeros(BUCKETS, np.int64), 0
            documents[lang] += 1
            if text:
                for buckets in gram_buckets(text):
                    totals[lang] += np.bincount(buckets, minlength=BUCKETS)
    for name, total in totals.items():
        yield rows(name, total)


class Model:
    """languages, and a (languages, BUCKETS) matrix of log probabilities."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_prob, self.log_prior = languages, log_prob, log_prior


def fit(labelled: DataFrame) -> Model:
    """labelled (lang, text): learn from all rows with a lang.  The driver gets
    one number per language and bucket, at most MAX_LANGUAGES * BUCKETS; more
    languages are an error."""
    rows = labelled.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_language = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    found = per_language.limit(MAX_LANGUAGES + 1).toArrow()
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    learned = sorted(zip(found.column("lang").to_pylist(), found.column("c").combine_chunks()), key=lambda x: x[0])
    total, documents = np.zeros((len(learned), BUCKETS)), np.ones(len(learned))
    for i, (_, cells) in enumerate(learned):
        bucket, n = (cells.values.field(k).to_numpy(zero_copy_only=False) for k in ("bucket", "n"))
        total[i, bucket[bucket >= 0]] = n[bucket >= 0]
        documents[i] = n[bucket < 0].sum()
    smooth = total + SMOOTHING
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(learned) else total
    return Model([x for x, _ in learned], log_prob, np.log(documents / documents.sum()) if len(learned) else documents)


def _best(model: Model, transposed: np.ndarray, text: str | None) -> tuple[int | None, float]:
    """Number of the text's most likely language (None: null, no letter, or nothing
    was learned) and its posterior probability."""
    if not text or not model.languages or not _letters(text):
        return None, 0.0
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    joint = counts[at] @ transposed[at] + model.log_prior
    odds = np.exp(joint - joint.max())
    best = int(joint.argmax())
    return best, float(odds[best] / odds.sum())


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        transposed = np.ascontiguousarray(model.log_prob.T)
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                best, odds = _best(model, transposed, text)
                lang.append(UNKNOWN if best is None else model.languages[best])
                score.append(odds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """rows (row struct, text) -> row, lang_pred, score (the posterior
    probability of lang_pred).  lang_pred is `und` with score 0 if the text is
    null, has no letter, or nothing was learned."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col("text").cast("string")).mapInArrow(_predictor(shared), f"row {kind}, lang_pred string, score double")


def _typical(model: Model, text: str, at_language: int) -> float:
    """Mean log probability per n-gram; digits and ASCII signs count as a space,
    so keys and numbers in a text don't weigh."""
    counts = gram_counts(_NOT_LETTERS.sub(" ", text))
    at = np.flatnonzero(counts)
    return float(counts[at] @ model.log_prob[at_language, at] / counts.sum())


def _typical_rows(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(shared.value.languages)}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [
                _typical(shared.value, t, number[x]) if x in number and t and _letters(t) else None for x, t in zip(langs, texts)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["row", "lang", "typical"])

    return run


def typical(model: Model, rows: DataFrame) -> DataFrame:
    """rows (row struct, lang, text) -> row, lang, typical: the text's mean log
    probability per n-gram in `lang`, null without letters or for a language
    that was not learned."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        _typical_rows(shared), f"row {kind}, lang string, typical double"
    )


def _judge(shared, min_score: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        transposed = np.ascontiguousarray(model.log_prob.T)
        for batch in batches:
            lang, score, found = [], [], []
            for text in batch.column(1).to_pylist():
                best, odds = _best(model, transposed, text)
                lang.append(UNKNOWN if best is None else model.languages[best])
                score.append(odds)
                found.append(None if best is None or odds < min_score else _typical(model, text, best))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.float64())],
                names=["row", "lang_pred", "score", "typical"],
            )

    return run


def judged(model: Model, rows: DataFrame, min_score: float = 0.0) -> DataFrame:
    """rows (row struct, text) -> row, lang_pred, score, typical: what `predict`
    and then `typical` in the predicted language return, in one pass, so a task
    needs one Python worker and sends its texts once.  typical is null for `und`
    and below `min_score`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col("text").cast("string")).mapInArrow(
        _judge(shared, min_score), f"row {kind}, lang_pred string, score double, typical double"
    )


def bounds(model: Model, labelled: DataFrame) -> dict[str, float]:
    """Least `typical` of a text of each language, from all labelled rows (lang,
    text); one number per language goes to the driver."""
    scores = typical(model, labelled.filter("lang is not null").select(F.struct(F.lit(0).alias("x")).alias("row"), "lang", "text"))
    found = scores.filter("typical is not null").groupBy("lang").agg(F.avg("typical"), F.stddev_pop("typical")).collect()
    return {lang: mean - max(MIN_SPREAD, SPREADS * spread) for lang, mean, spread in found}


def _bucket_of_five():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 0 and whose
    lang is not null.  A null doc_id is never learned from and not held out.
    Rows with the same doc_id are separate rows.  Other columns are ignored; an
    empty table gives no rows."""
    model = fit(docs.filter(_bucket_of_five() != 0))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    held = F.coalesce(_bucket_of_five() == 0, F.lit(False))
    return predict(model, rows).select("row.doc_id", "lang_pred", "score").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
