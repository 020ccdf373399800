"""Annotation joins: each input row gets fields of the first matching record of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covalens.operators.intervals import Spans, overlap_join


def first_match(rows: DataFrame, source: DataFrame, keys: list[str], order: list[str], fields: list[str], ignore_case: list[str] = ()) -> DataFrame:
    """``fields`` of the source's first row by ``order`` with equal keys; null where none matches.

    The source is reduced to one row a key before the join, so no match is multiplied.
    """
    key = lambda c: F.lower(c) if c in ignore_case else F.col(c)
    one = source.groupBy(*[key(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("__hit"))
    on = [key(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    own = [c for c in rows.columns if c not in fields]
    return rows.join(one, on, "left").select(*own, *[F.col(f"__hit.{f}").alias(f) for f in fields])


def annotated(rows: DataFrame, sources: list[tuple[DataFrame, list[str], list[str]]], keys: list[str]) -> DataFrame:
    """``first_match`` over several sources of (table, order, fields)."""
    for source, order, fields in sources:
        rows = first_match(rows, source, keys, order, fields)
    return rows


def info_text(fields: list[str]) -> Column:
    """name=value parts of the given columns, those that are null left out."""
    return F.concat_ws(";", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in fields])


def features_at(points: DataFrame, features: DataFrame, contig: str, at: str, key: str, kind: str, buffer: int = 0) -> DataFrame:
    """key and types: the sorted distinct types of the features that hold a point, joined by semicolons."""
    p = Spans(points.withColumn("__e", F.col(at)), contig, at, "__e")
    hit = overlap_join(p, Spans(features, contig, "start", "end"), buffer)
    return hit.groupBy(F.col(f"a.{key}").alias(key)).agg(F.array_join(F.array_sort(F.collect_set(f"b.{kind}")), ";").alias("types"))


def in_mask(variants: DataFrame, mask: DataFrame) -> DataFrame:
    """Adds REPEAT to the filter of variants (contig, start, end, filter) that touch a mask interval [start, end): its end is not in it."""
    closed = mask.select("contig", "start", (F.col("end") - 1).alias("end"))
    hit = overlap_join(Spans(variants), Spans(closed)).select("a.contig", "a.start", "a.end").distinct()
    hit = hit.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    joined = variants.join(hit, (F.col("contig") == F.col("__c")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left")
    marked = F.when(F.col("__c").isNull(), F.col("filter")).when(F.coalesce("filter", F.lit("")).isin("", ".", "PASS"), "REPEAT").otherwise(F.concat("filter", F.lit(";REPEAT")))
    return joined.withColumn("filter", marked).drop("__c", "__s", "__e")


def allele_trimmed(start: Column, ref: Column, alt: Column, db_start: Column, db_ref: Column, db_alt: Column) -> Column:
    """Whether a database allele that may start earlier equals the variant once the shared lead is cut off."""
    lead = (start - db_start).cast("int")
    same_lead = F.upper(F.substring(db_ref, F.lit(1), lead)) == F.upper(F.substring(db_alt, F.lit(1), lead))
    cut = lambda c: F.upper(F.substring(c, lead + 1, F.length(c)))
    return (lead >= 0) & same_lead & (cut(db_ref) == F.upper(ref)) & (cut(db_alt) == F.upper(alt))


def ranked_effect(effects: DataFrame, key: list[str], ranks: DataFrame) -> DataFrame:
    """Of each key's effects (key, term, length) the one with the least rank (term, rank), then the longest; unknown terms don't count."""
    known = effects.join(F.broadcast(ranks) if ranks.limit(10_001).count() <= 10_000 else ranks, "term")
    return known.groupBy(*key).agg(F.min_by(F.struct("term", "rank", "length"), F.struct(F.col("rank"), -F.col("length"), F.col("term"))).alias("best")).select(*key, "best.*")
