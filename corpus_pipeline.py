"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``; the driver, and ``run``,
write each stage's rows and read them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covalens.llm import common, decontaminate, packing, quality, simhash, suffix_dedup
from covalens.session import ship

#: Any passage of over 50 words has at least so many bytes: 51 words and 50 gaps.
PASSAGE_BYTES = 101


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled quality classifier rejects."""
    return quality.kept(docs, common.table(ship(spark), sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: shingles of five words, likeness of 0.8."""
    ship(spark)
    return simhash.one_of_each(docs, shingle=5, bits=6, similarity=0.8)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id has, and counts the code points anew.

    A character that a cut leaves in pieces goes, and no other. Null texts stay null.
    """
    ship(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.suffix_dedup(docs, PASSAGE_BYTES, carry=others, whole=True)
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*[(columns[c] if c in columns else F.col(f"rest.{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text contains a benchmark item: 0.8 of its five-word shingles."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into training sequences of the permitted sizes."""
    ship(spark)
    return packing.packed(docs, packing.SIZES)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed_sequences),
]

#: Trained and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
