"""A training corpus from ``documents``: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns
a DataFrame that is written as Parquet and read again. All but the last return the columns of
``documents``; the mixing stage's decision is the order of the rows. Files do not keep that order for sure
and have no column for it, so packing derives the slots again (they follow from ids and sources) and numbers
sequences by them: any prefix of sequence_id holds the sources in about their target weights.

Defined cases: null and empty texts go through every stage (quality scores them as one empty line, the
near-duplicate stage links them with nothing, packing makes them an end id); rows that repeat an id are
one document to the near-duplicate stage, which keeps all of them or none; a null id is kept; an empty
table stays empty; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import mixing, near_dedup, packing, quality, queries, secrets
from logweave.llm.common import drop_table, write_table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on ``labels``, rejects go."""
    return quality.keep_good(docs, quality.train(docs, queries.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return near_dedup.keep_one(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; n_chars follows."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of their slots: any prefix holds the sources in their target weights."""
    return mixing.in_order(docs, queries.SHARES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where each document's tokens stand in which sequence, the sequences in the order of the slots."""
    return packing.pack_documents(docs, queries.vocabulary(), order=lambda rows: mixing.mix(rows, queries.SHARES))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifiers cannot be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, written = write_table(stage(spark, docs, sf_dir), name)
        if before:
            drop_table(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
