"""Two-stage motif search: a cheap test first, then the pattern on what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(seq: Column, pattern: str) -> Column:
    """All matches of the pattern, left to right."""
    return F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1))


def two_stage(df: DataFrame, seq: str, stage1: str, stage2: str, *by: str) -> DataFrame:
    """by, motif, n: matches of ``stage2`` in the texts that contain ``stage1``."""
    found = df.where(F.contains(F.col(seq), F.lit(stage1))).select(*by, F.explode(matches(F.col(seq), stage2)).alias("motif"))
    return found.groupBy(*by, "motif").agg(F.count("*").alias("n"))


def scaled(raw: Column, factor: int, total: Column) -> Column:
    """raw x factor / total in whole numbers; -1 without a total."""
    return F.when(total > 0, F.floor(raw * factor / total).cast("long")).otherwise(F.lit(-1).cast("long"))


def located(df: DataFrame, seq: str, literal: str, *by: str) -> DataFrame:
    """by, start, end of each occurrence of a literal, overlapping ones too: start counts from 0, end is not in it."""
    k = len(literal)
    places = F.filter(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(F.col(seq), i, F.lit(k)) == literal)
    hit = df.where(F.contains(F.col(seq), F.lit(literal)))
    return hit.select(*by, F.explode(places).alias("__i")).select(*by, (F.col("__i") - 1).cast("long").alias("start"), (F.col("__i") - 1 + k).cast("long").alias("end"))
