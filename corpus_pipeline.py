"""A corpus pipeline over ``documents``: language, lines, near duplicates, contamination, tokens.

Every stage takes what its predecessor kept and handles null, empty and repeated rows and columns of any name as its operator says;
an empty table gives an empty result. Stages 1 to 4 return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, langid, linededup, queries, simhash
from marlstone.llm.batches import fresh
from marlstone.session import Tables, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: no letter, or no language as likely as all others together."""
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut out of the texts; ``n_chars`` follows the text that is left."""
    lines, removed = fresh(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(docs, names=(lines, removed))
    return out.select(*[(F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`"))
                        for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are in benchmark windows go; the others stay as they are."""
    return decontaminate.keep_clean(docs, Tables(spark, sf_dir).benchmark)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document and the round trip: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    return queries.token_digests(bpe.round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN))


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", drop_contaminated), ("byte_bpe", tokenize)]

#: SQL has no naive Bayes fit, XXH64 or BPE; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        place = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
