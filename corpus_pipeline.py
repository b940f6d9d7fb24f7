"""Training-data pipeline: quality, near duplicates, repeated passages, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the
next stage's documents, the last one the packed sequences.  Stages take and return the five
columns of ``documents``; any other column of a given table, whatever its name, is left out
before a stage begins.  Null and empty texts, null and repeated ids and empty tables pass as the
stages' operators define them: of rows equal in id and text one stays, null ids come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swapledger.llm import ngram_join, packing, quality_fm, secret_index, suffix_dedup
from swapledger.llm.common import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _own(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone."""
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (score of 0.5 or more)."""
    docs = _own(docs)
    model = quality_fm.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return quality_fm.with_quality(docs, model, output="_score").where(F.col("_score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return ngram_join.one_of_each(_own(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of which nothing is left go."""
    out = suffix_dedup.remove_repeats(_own(docs))
    return _measured(out.where((F.col("_n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != "")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by its kind."""
    return _measured(secret_index.mask_secrets(_own(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack_documents(_own(docs))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: The learned, graph and tokenizer stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
