"""A corpus from documents to sampled pieces: five stages, each over all that the one before kept.

Stages take (spark, docs, sf_dir) and return the columns of ``documents``; the
last returns the pieces. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from palimpsest.llm.common import read, stored
from palimpsest.llm.queries import PIECES_FILE, SEED


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is two rows."""
    rows = docs.select("doc_id", "text", F.array("source").alias("sources"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = mixing.mixed(rows, carry="row").filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's sampled segmentation; the rows of a document taken twice are sampled apart."""
    return pieces.sampled_pieces(pieces.numbered_copies(docs.select("doc_id", "text")), public_tokenizers.path(PIECES_FILE), seed=SEED, copy_col="copy")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: Centroids, sketches, flows and sampled segmentations are no matter of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
