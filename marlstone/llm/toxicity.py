"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are learned from in a bounded sample, cut into three by a hash: the first part gives a lexicon of words and word
beginnings that mark label 1, the second fits the trees, the third the calibration; no part sees its own words counted. Features
per text: lexicon densities and strengths, lexicon words near a second-person word, capitals, punctuation, and obfuscation
(signs or digits inside words, repeated letters, hits only after undoing them).

Rows: a null text counts as empty; all features of an empty text are 0, and it is scored like any other. Null labels and null ids
are not learned from; of several labels of an id the highest counts. Without a lexicon the other features are
learned from. If a part lacks a label, trees and calibration learn from all three parts together. With one label or none in the
sample, every score is the share of label 1 (0 without rows). Equal texts have equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns, byte_list, column, fold, fresh, row_batches, small_batches
from marlstone.session import cut_lineage

WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$!*+|]*\p{L}[\p{L}\p{M}\p{N}@$!*+|]*")
#: Second-person words (English, German, French, Spanish).
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine deiner deinen deinem ihr euch euer eure tu te toi ton ta tes vous "
                          "votre vos tú ti tus tuyo usted ustedes vosotros vuestro vuestra".split())
#: Signs that stand for letters.
UNDO = str.maketrans("013457@$!|+", "oieastasilt")
REPEATED = regex.compile(r"(.)\1{2,}")
NEAR = 5
KEPT_WORDS = 1 << 17
FEATURES = ("hits", "hits_per_100", "strength", "strength_per_100", "strongest", "distinct", "near_second_person", "second_person_per_100",
            "undone_hits", "odd_words_per_100", "repeated_per_100", "capitals", "capital_words", "shouts", "punctuation", "log_words")


@dataclass(frozen=True)
class Config:
    """``sample_rows`` bounds the labelled rows that are learned from (expected number, by a hash of the id);
    ``lexicon_size`` bounds the lexicon, which is broadcast."""

    sample_rows: int = 24_000
    lexicon_size: int = 2000
    prefixes: tuple[int, ...] = (4, 5, 6)
    least_documents: int = 4
    least_odds: float = 2.5
    trees: int = 20
    depth: int = 3
    seed: int = 17


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float
    config: Config = field(default_factory=Config)


def terms(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word itself and its beginnings, marked apart."""
    return [word, *(word[:n] + "~" for n in prefixes if len(word) >= n)]


def undone(word: str) -> str:
    """The word with signs read as letters and long repeats cut to one letter."""
    return REPEATED.sub(r"\1", word.translate(UNDO)).replace("*", "")


class Words(dict):
    """What each word met brings: (word in lower case, strength, hit after undoing, odd, repeated letters, second person, capital,
    shouted). The strength is that of the strongest term in the lexicon. Up to KEPT_WORDS are kept."""

    def __init__(self, lexicon: dict[str, float], prefixes: tuple[int, ...]):
        super().__init__()
        self.lexicon, self.prefixes = lexicon, prefixes

    def strength(self, word: str) -> float:
        return max(self.lexicon.get(t, 0.0) for t in terms(word, self.prefixes))

    def __missing__(self, raw: str) -> tuple | None:
        word = raw.lower()
        w, undone_hit, inner = self.strength(word), False, word.rstrip("!*+|")
        odd = not word.isalpha() and not inner.isalpha()
        repeated = word.isalpha() and len(word) > 3 and REPEATED.search(word) is not None
        if (odd or repeated) and not w:
            w = self.strength(undone(inner))
            undone_hit = w > 0
        out = (word, w, undone_hit, odd, repeated, word in SECOND_PERSON, raw != word, len(raw) > 1 and raw.isupper())
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[raw] = out = out if any(out[1:]) else None
        return out


def features(text: str | None, words: Words) -> list[float]:
    """The values of FEATURES; all 0 for a text without words."""
    raw = WORD.findall(text or "")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    hits, strength, strongest, near, second, found = [], 0.0, 0.0, 0, [], set()
    undone_hits = odd = repeated = capitals = shouting = 0
    for i, known in enumerate(map(words.__getitem__, raw)):
        if known is None:
            continue
        word, w, by_undoing, is_odd, is_repeated, is_second, capital, shouted = known
        undone_hits += by_undoing
        odd += is_odd
        repeated += is_repeated
        capitals += capital
        shouting += shouted
        if w:
            hits.append(i)
            strength += w
            strongest = max(strongest, w)
            found.add(word)
        if is_second:
            second.append(i)
    j = 0
    for i in hits:
        while j < len(second) and second[j] < i - NEAR:
            j += 1
        near += j < len(second) and second[j] <= i + NEAR
    letters = sum(map(len, raw))
    marks = text.count("!")
    signs = marks + text.count("?") + text.count("*") + text.count("#")
    return [float(len(hits)), 100.0 * len(hits) / n, strength, 100.0 * strength / n, strongest, float(len(found)), float(near), 100.0 * len(second) / n,
            float(undone_hits), 100.0 * odd / n, 100.0 * repeated / n, capitals / n, shouting / n, 100.0 * marks / n, signs / max(letters, 1), math.log1p(n)]


def with_features(df: DataFrame, text: str, lexicon: dict[str, float], prefixes: tuple[int, ...], name: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        words = Words(held.value, prefixes)
        return lambda values: [pa.array([features(v, words) for v in values.to_pylist()], pa.list_(pa.float64()))]

    return append_columns(df, [text], [T.StructField(name, T.ArrayType(T.DoubleType()))], make)


def learn_lexicon(sample: DataFrame, config: Config) -> dict[str, float]:
    """Log-odds of the terms that mark label 1; ``sample`` is (text, label). Documents are counted per term, first within a batch."""
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return {}
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        for batch in batches:
            seen = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 - label].update({t for w in set(WORD.findall((text or "").lower())) for t in terms(w, config.prefixes)})
            yield from row_batches(((t, seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys()), schema, 1 << 15)

    counts = sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("b") + 0.5) / (totals[0] + 1.0))
    best = (counts.filter(F.col("a") >= config.least_documents).withColumn("odds", odds).filter(F.col("odds") >= config.least_odds)
            .orderBy(F.desc(F.col("odds") * F.sqrt("a")), "term").limit(config.lexicon_size).collect())
    return {r["term"]: r["odds"] for r in best}


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", config: Config = Config()) -> Model:
    """Learn from the labelled rows of ``docs``; filter ``labels`` first to keep rows out."""
    small_batches(docs.sparkSession)
    known = (labels.select(column(labels, id).alias("id"), column(labels, label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
             .groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id")))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).head()
    base = (ones or 0) / n if n else 0.0
    top = float(1 << 63) * (2 * min(1.0, config.sample_rows / max(n, 1)) - 1)
    # About sample_rows ids, whatever the size of the tables: small enough to be sent to every task.
    chosen = known.filter(F.col("h").cast("double") <= F.lit(top)).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)))
    sample = (docs.select(column(docs, id).alias("_id"), column(docs, text).alias("text"))
              .join(F.broadcast(chosen.select("id", "label", "part")), F.col("_id") == F.col("id")).select("text", "label", "part"))
    lexicon = learn_lexicon(sample.filter("part = 0"), config)

    def featured(rows):
        return cut_lineage(with_features(rows, "text", lexicon, config.prefixes, "values")
                           .select(array_to_vector("values").alias("features"), F.col("label").cast("double").alias("label"), "part").repartition(8))

    rest = featured(sample.filter("part > 0"))
    enough = {r["part"]: r["n"] for r in rest.groupBy("part").agg(F.countDistinct("label").alias("n")).collect()}
    to_fit, to_judge = rest.filter("part = 1"), rest.filter("part = 2")
    if enough.get(1, 0) < 2 or enough.get(2, 0) < 2:
        to_fit = to_judge = featured(sample)
        if to_fit.select("label").distinct().count() < 2:
            return Model(lexicon, None, None, float(base), config)
    trees = GBTClassifier(maxIter=config.trees, maxDepth=config.depth, stepSize=0.3, seed=config.seed, maxBins=32).fit(to_fit)
    judged = trees.transform(to_judge).select(vector_to_array("probability")[1].alias("p"), "label")
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(judged)
    return Model(lexicon, trees, calibration, float(base), config)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the calibrated probability of label 1; one pass over whole texts, no shuffle. ``name`` must be a new column."""
    if model.trees is None:
        return df.withColumn(name, F.lit(model.base))
    values, vector, raw, both, hard, p, out = fresh(df, "values", "vector", "raw", "probability", "prediction", "p", "calibrated")
    wide = with_features(df, text, model.lexicon, model.config.prefixes, values).withColumn(vector, array_to_vector(F.col(values)))
    trees = model.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(both).setPredictionCol(hard)
    judged = trees.transform(wide).withColumn(p, vector_to_array(F.col(both))[1])
    done = model.calibration.copy().setFeaturesCol(p).setPredictionCol(out).transform(judged)
    return done.select(*[F.col(f"`{c}`") for c in df.columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out))).alias(name))
