"""Set operations over the calls of several callers, files or samples: (source, key columns, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(calls: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """keys and members: the sorted sources that have the key, joined by commas."""
    return calls.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("members"))


def membership_counts(calls: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """How many keys exactly each set of sources has."""
    return membership(calls, source, keys).groupBy("members").agg(F.count("*").alias("n"))


def in_exactly(calls: DataFrame, source: str, keys: list[str], wanted: list[str]) -> DataFrame:
    return membership(calls, source, keys).where(F.col("members") == ",".join(sorted(wanted))).drop("members")


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and side: only_a, only_b or both. Null keys are keys like any other."""
    both = a.select(*keys).distinct().withColumn("__in", F.lit(1)).unionByName(b.select(*keys).distinct().withColumn("__in", F.lit(2)))
    return both.groupBy(*keys).agg(F.sum("__in").alias("__in")).select(*keys, F.when(F.col("__in") == 3, "both").when(F.col("__in") == 1, "only_a").otherwise("only_b").alias("side"))


def merged_alleles(calls: DataFrame, keys: list[str], alts: str) -> DataFrame:
    """keys and alts: the sorted distinct union of comma-joined alleles."""
    each = calls.select(*keys, F.explode(F.split(alts, ",")).alias("__a"))
    return each.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("__a")), ",").alias("alts"))


def reindexed(gt: Column, own: Column, union: Column) -> Column:
    """A genotype of allele numbers, renumbered from the own alleles to those of the union (both comma-joined)."""
    move = lambda x: F.when(x.isin("0", "."), x).otherwise(F.array_position(F.split(union, ","), F.get(F.split(own, ","), x.try_cast("int") - 1)).cast("string"))
    return F.array_join(F.transform(F.split(F.replace(gt, F.lit("|"), F.lit("/")), "/"), move), "/")


def missing_in(calls: DataFrame, source: str, keys: list[str], gt: str, sources: list[str]) -> DataFrame:
    """keys and source where a source lacks the key or has no genotype (null, ``.``, ``./.``)."""
    has = ~F.coalesce(F.col(gt).isin("", ".", "./.", ".|."), F.lit(True)) & F.col(gt).isNotNull()
    found = calls.groupBy(*keys).agg(F.collect_set(F.when(has, F.col(source))).alias("__has"))
    return found.select(*keys, F.explode(F.array_except(F.array(*map(F.lit, sources)), "__has")).alias(source))


def gold_standard(calls: DataFrame, source: str, keys: list[str], sources: list[str]) -> DataFrame:
    """The keys that all of ``sources`` have."""
    n = len(sources)
    return calls.where(F.col(source).isin(sources)).groupBy(*keys).agg(F.count_distinct(source).alias("__n")).where(F.col("__n") == n).drop("__n")


def agreement(calls: DataFrame, keys: list[str], gt: str) -> DataFrame:
    """keys and score: the size of the largest group of callers with one genotype, missing ones left out (0 if all are)."""
    known = F.when(~F.col(gt).isin("", ".", "./."), F.array_join(F.array_sort(F.split(F.replace(F.col(gt), F.lit("|"), F.lit("/")), "/")), "/"))
    return calls.withColumn("__g", known).groupBy(*keys, "__g").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.max(F.when(F.col("__g").isNull(), 0).otherwise(F.col("__n"))).alias("score"))


def control_test(control: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join by position, with in_control and in_test; the other columns get c_ and t_ before their names."""
    side = lambda df, p: df.select(*[F.col(k).alias(f"__{p}{k}") for k in keys], *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"__{p}"))
    c, t = side(control, "c"), side(test, "t")
    joined = c.join(t, [F.col(f"__c{k}") == F.col(f"__t{k}") for k in keys], "full")
    values = [x for x in (*c.columns, *t.columns) if not x.startswith("__")]
    return joined.select(*[F.coalesce(f"__c{k}", f"__t{k}").alias(k) for k in keys], F.coalesce("__c", F.lit(False)).alias("in_control"), F.coalesce("__t", F.lit(False)).alias("in_test"), *values)
