"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every label is learned. Fitting counts n-grams of a bounded sample of each label's texts in Spark tasks and sums them per label;
the driver receives one vector of log-probabilities per label (128 KB at 2^15 buckets). Scoring broadcasts the matrix of log-probabilities (languages x buckets) and sums the entries of a text's
n-grams in numpy, slice by slice, so that the n-grams of a long text are never held at once.

Rows: a null text, a text without a letter and an untrained model give ``und`` with score 0. Null labels, null ids and texts
without letters are not learned from. Equal texts get equal results; ties between languages go to the first in name order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns, column, fold, fresh, small_batches

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Characters per slice of a text that is hashed at once.
SLICE = 1 << 17


@dataclass(frozen=True)
class Config:
    """``rows_per_language``: at most so many distinct texts per language are learned from (the smallest text hashes)."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    alpha: float = 0.5
    rows_per_language: int = 3000
    salts: int = 8


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    config: Config


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with everything but letters as one kind of gap, framed by gaps."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    c[(c < 97) | ((c > 122) & (c < 192) & (c != 170) & (c != 181) & (c != 186)) | (c == 215) | (c == 247) | ((c >= 0x2000) & (c <= 0x206F))] = 32
    return c


def buckets(c: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram that is not all gap."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, dtype=np.uint32)
    gap = np.ones(n, dtype=bool)
    for k in range(order):
        part = c[k:k + n]
        h ^= part
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        gap &= part == 32
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits))[~gap].astype(np.int64)


def gram_buckets(text: str, config: Config):
    c = code_points(text)
    for at in range(0, len(c), SLICE):
        for order in config.orders:
            yield buckets(c[at:at + SLICE + order - 1], order, config.bits)


def fit(df: DataFrame, text: str = "text", label: str = "lang", config: Config = Config()) -> Model:
    """Learn from the rows of ``df`` that have a label and a letter; every text counts once per label."""
    small_batches(df.sparkSession)
    rows = (df.select(column(df, text).alias("text"), column(df, label).cast("string").alias("lang")).filter("lang is not null and text rlike '\\\\p{L}'")
            .select("lang", "text", F.xxhash64("text").alias("h")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = (rows.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= config.rows_per_language)
            .groupBy("lang").agg(F.max("h").alias("last")))
    sample = rows.join(F.broadcast(last), "lang").filter("h <= last").select("lang", "text", "h").dropDuplicates(["lang", "h"])

    def count(key, table):
        total = np.zeros(1 << config.bits, np.int64)
        for value in table.column("text").to_pylist():
            for b in gram_buckets(value, config):
                total += np.bincount(b, minlength=1 << config.bits)
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})

    salted = sample.withColumn("salt", F.pmod("h", F.lit(config.salts)))
    parts = salted.groupBy("lang", "salt").applyInArrow(count, "lang string, counts binary")

    def weigh(key, table):
        smooth = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()) + config.alpha
        return pa.table({"lang": pa.array([key[0].as_py()]), "weights": pa.array([np.log(smooth / smooth.sum()).astype(np.float32).tobytes()], pa.binary())})

    learned = sorted((r["lang"], r["weights"]) for r in parts.groupBy("lang").applyInArrow(weigh, "lang string, weights binary").collect())
    weights = np.zeros((1 << config.bits, len(learned)), np.float32)
    for i, (_, column_bytes) in enumerate(learned):
        weights[:, i] = np.frombuffer(column_bytes, np.float32)
    return Model([lang for lang, _ in learned], weights, config)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Best language and its posterior probability (equal priors) per text."""
    names, scores = [], []
    for text in texts:
        if not model.languages or text is None or not LETTER.search(text):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = np.zeros(len(model.languages))
        for b in gram_buckets(text, model.config):
            total += np.bincount(b, minlength=len(model.weights)) @ model.weights if len(b) > len(model.weights) else model.weights[b].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        best = int(p.argmax())
        names.append(model.languages[best])
        scores.append(float(p[best] / p.sum()))
    return names, scores


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its probability; one pass, no shuffle. ``names`` must be new columns."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def work(values):
            pred, score = score_texts(values.to_pylist(), model)
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return work

    return append_columns(df, [text], [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], make)


def training_rows(df: DataFrame, id: str = "doc_id", held_fold: int = 2, folds: int = 4) -> DataFrame:
    """The rows whose fold may be learned from."""
    return df.filter(fold(column(df, id), folds) != held_fold)


def keep_identified(df: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows with an identified language: not ``und``, and the language at least as likely as all others together."""
    pred, score = fresh(df, "lang_pred", "score")
    return predict(df, model, text, (pred, score)).filter((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).drop(pred, score)
