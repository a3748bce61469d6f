"""A corpus from raw documents to packed sequences: each stage on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, packing, secrets, simhash, toxicity
from tablewright.llm.queries import RADIUS, SHINGLE, SIMHASH_PARTS, TOXIC, WORD_BPE, toxicity_model
from tablewright.llm.shared import stored
from tablewright.sources.parquet import scan

SECRET = "[secret]"


def _numbered(docs: DataFrame) -> DataFrame:
    """``row``, all columns as one so that no name meets another, and ``id``, which every later read repeats."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("id")), "rows")


def not_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose text scores below the threshold; learned from the labelled rows of ``docs``.

    NULL and empty texts score as texts without a sign; repeated rows stay or go together.
    """
    return toxicity.below(docs, toxicity_model(spark, folder, docs), TOXIC)


def distinct_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, then the smallest doc_id, then one of them.

    NULL texts are equal to empty ones; a NULL doc_id comes after all others.
    """
    rows = _numbered(docs)
    verdict = exact_dedup.duplicates(rows.select("row.doc_id", "row.text", "id"), carry=["id"])
    return rows.join(verdict.filter(~F.col("kept")).select("id"), "id", "left_anti").select("row.*")


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each class of fingerprints that are linked: the smallest doc_id (NULL after all others), then the first row.

    Shingles and bit distance are those of op6. Texts without words, NULL among them, are
    of one class.
    """
    rows = _numbered(docs)
    marked = simhash.fingerprints(rows.select("row.doc_id", "row.text", "id"), shingle=SHINGLE, carry=["id"])
    keys = simhash.all_within(radius=RADIUS, parts=SIMHASH_PARTS)
    classes = stored(simhash.near_duplicates(marked, radius=RADIUS, keys=keys, own_id="id"), "classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("best")
    kept = classes.groupBy("component_id").agg(best).select(F.col("best.id").alias("id"))
    return rows.join(kept.hint("shuffle_hash"), "id", "left_semi").select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows, with every secret replaced by a mark; n_chars follows the text. NULL stays NULL."""
    return secrets.mask_secrets(docs, secrets.learn(docs), SECRET)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; NULL texts are empty documents."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), end_id=1, window=2048)


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_fingerprints),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Learned scores and packing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, folder)
