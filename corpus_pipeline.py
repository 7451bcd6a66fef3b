"""Corpus preparation: language, quality, near duplicates, benchmark overlap, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it and read it back as the next
stage's docs. All stages but the last return the columns they got. Nulls: a document without text or letters has no
language and goes in the first stage; null and repeated ids are ordinary rows (stages go by row, not by id).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import decontaminate, language, pieces, quality, simhash
from terraloom.llm.common import fold, materialize, table, unused

#: below this probability no language is taken as found; four equal ones would have 0.25 each
LANGUAGE_SCORE = 0.3
#: near duplicates: five-word shingles of which four fifths are shared, as a Jaccard similarity, tested on what fingerprints find
SHINGLE, SIMILARITY = 5, (4, 5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language."""
    model = language.fit(docs, fold("doc_id", 4) != 2)
    lang, score = unused(docs, "lang_found"), unused(docs, "lang_score")
    found = language.identify(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier takes for good ones."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    score, good = unused(docs, "quality_score"), unused(docs, "quality_good")
    scored = quality.score(docs, model, keep=tuple(docs.columns), names=(score, good))
    return scored.where(F.col(good) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    row = unused(docs, "row_number")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = simhash.similar(rows.select(row, "text"), row, "text", SHINGLE, *SIMILARITY)
    first = groups.where(F.col(row) == F.col("component_id")).select(row)
    return rows.join(first, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the digest of the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, model, decoded="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

#: hashing, learned models and graph classes are outside SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
