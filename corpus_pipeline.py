"""A training corpus from raw documents: language, near-duplicates, benchmark, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.pin import stored
from larder.llm import pieces, ppm, simhash, surrogates, winnow
from larder.llm.queries import KEY, MODEL, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language stay; null texts and texts without a letter go."""
    return ppm.keep_identified(docs, ppm.fit(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints of three-word shingles, two bits apart at most, the one of the smallest id stays.

    Texts without a word share the fingerprint 0; of rows without an id, or repeated in full, one stays.
    """
    return simhash.keep_one(docs, shingle=3, radius=2, likeness=None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with an item of the benchmark go."""
    return winnow.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; ``n_chars`` follows the text."""
    return surrogates.anonymized(docs, KEY, count=None).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return pieces.encode(docs, pieces.load(MODEL)).drop("row_key")


STAGES = [
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

# SQL can state neither code lengths, nor fingerprints, nor merges of pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
