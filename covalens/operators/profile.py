"""Quality-control profiles: tallies and histograms over reads, sequences and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covalens.functions.sequence import kmers


def cycles(df: DataFrame, seq: str, *by: str) -> DataFrame:
    """by, cycle (from 1), value, n: how often each character stands at each place."""
    each = df.select(*by, F.posexplode(F.split(F.col(seq), "")).alias("cycle", "value"))
    return each.where("value <> ''").groupBy(*by, (F.col("cycle") + 1).alias("cycle"), "value").agg(F.count("*").alias("n"))


def kmer_counts(df: DataFrame, seq: str, k: int, *by: str) -> DataFrame:
    """by, kmer, n over all k-mers."""
    return df.select(*by, F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("n"))


def kmer_cycles(df: DataFrame, seq: str, k: int, *by: str) -> DataFrame:
    """by, cycle, kmer, n: k-mers by the place where they start, from 1."""
    each = df.select(*by, F.posexplode(kmers(F.col(seq), k)).alias("cycle", "kmer"))
    return each.groupBy(*by, (F.col("cycle") + 1).alias("cycle"), "kmer").agg(F.count("*").alias("n"))


def discarded(df: DataFrame, reasons: list[tuple[str, Column]], *by: str) -> DataFrame:
    """by, reason, n: each row counts for the first reason that holds, or for ``kept``."""
    reason = F.lit("kept")
    for name, holds in reversed(reasons):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.groupBy(*by, reason.alias("reason")).agg(F.count("*").alias("n"))


def pair_tallies(reads: DataFrame) -> DataFrame:
    """proper, orientation, size, n over pairs, each counted once: by its mate with tlen above 0, or the first of it at 0."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    once = reads.where(bit(1) & ~bit(4) & ~bit(8) & ((F.col("tlen") > 0) | ((F.col("tlen") == 0) & bit(64))))
    t = F.col("tlen")
    size = F.when(t == 0, "0").when(F.col("pnext") <= F.col("end"), "overlap").when(t < 1500, "<1500").when(t < 10000, "<10000").otherwise(">=10000")
    same = bit(16) == bit(32)
    # the read comes first, so it looks inward if it is forward
    orientation = F.when(same & (bit(16) == bit(64)), "F5F3").when(same, "F3F5").when(~bit(16), "inward").otherwise("outward")
    return once.groupBy(bit(2).alias("proper"), orientation.alias("orientation"), size.alias("size")).agg(F.count("*").alias("n"))


def binned(df: DataFrame, value: Column, width: float, *by: str) -> DataFrame:
    """by, bin, n over bins of a share; a value right on a border counts in the lower bin."""
    at = F.greatest(F.ceil(F.round(value / width, 9)) - 1, F.lit(0)).cast("long")
    return df.where(value.isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def flag_counts(reads: DataFrame) -> DataFrame:
    """flag, bits (as 12 binary digits), n."""
    return reads.groupBy("flag").agg(F.count("*").alias("n")).select("flag", F.lpad(F.bin("flag"), 12, "0").alias("bits"), "n")


def derivative(histogram: DataFrame, value: str, n: str, *by: str) -> DataFrame:
    """by, value, slope: difference of the natural logarithms of neighbouring counts."""
    own = W.partitionBy(*by).orderBy(value)
    return histogram.withColumn("slope", F.ln(n) - F.ln(F.lag(n).over(own))).where("slope is not null").select(*by, value, "slope")


def quartiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, q1, q3 at places p (n + 1) / 100 of the ordered values, between neighbours by their distance.

    Equal values are counted before they are ordered, so a group's window holds its distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    own = W.partitionBy(*by)
    ranked = counts.withColumns({"__hi": F.sum("__c").over(own.orderBy("__v")), "__n": F.sum("__c").over(own)})

    def at(p: int) -> Column:
        place = F.lit(p) * (F.col("__n") + 1) / 100
        lo = F.greatest(F.least(F.floor(place), F.col("__n")), F.lit(1))
        hi = F.greatest(F.least(F.floor(place) + 1, F.col("__n")), F.lit(1))
        held = lambda k: F.max(F.when((F.col("__hi") - F.col("__c") < k) & (k <= F.col("__hi")), F.col("__v")))
        share = F.max(place - F.floor(place))
        return held(lo) + share * (held(hi) - held(lo))

    return ranked.groupBy(*by).agg(at(25).alias("q1"), at(75).alias("q3"))


def low_outliers(df: DataFrame, value: str, factor: float, *by: str) -> DataFrame:
    """The rows whose value is below q1 - factor x (q3 - q1) of their group."""
    q = quartiles(df, value, *by).select(*[F.col(c).alias(f"__{c}") for c in by], "q1", "q3")
    joined = df.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else df.crossJoin(F.broadcast(q))
    return joined.where(F.col(value) < F.col("q1") - factor * (F.col("q3") - F.col("q1"))).select(*df.columns)


def transitions(variants: DataFrame, *by: str) -> DataFrame:
    """by, ti, tv, ratio over substitutions (ref, alt) of one base."""
    from covalens.functions.variants import is_transition

    one = variants.where("length(ref) = 1 and length(alt) = 1 and upper(ref) <> upper(alt)")
    ti = is_transition(F.col("ref"), F.col("alt"))
    out = one.groupBy(*by).agg(F.sum(ti.cast("int")).alias("ti"), F.sum((~ti).cast("int")).alias("tv"))
    return out.withColumn("ratio", F.when(F.col("tv") > 0, F.col("ti") / F.col("tv")))


def top(df: DataFrame, n: int, order: list[Column], *by: str) -> DataFrame:
    """The first n rows of each group by ``order``."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
