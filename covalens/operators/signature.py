"""Sample fingerprints: coded genotypes at fixed positions, compared pairwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.functions.variants import coded_genotype


def signatures(counts: DataFrame, sample: str, position: str, coverage: int = 10) -> DataFrame:
    """sample, position, genotype of base counts a, c, g, t; positions without a valid genotype are left out."""
    g = coded_genotype(F.col("a"), F.col("c"), F.col("g"), F.col("t"), coverage)
    return counts.select(F.col(sample).alias("sample"), F.col(position).alias("position"), g.alias("genotype")).where("genotype is not null")


#: Samples alike are expanded in blocks of about so many: a pair of blocks is one row until it is expanded.
BLOCK = 256


def pair_scores(signed: DataFrame, digits: int | None = None) -> DataFrame:
    """a, b, compared, matches, score (rounded to ``digits``) for each pair of samples (a < b) that share a position.

    Samples with the same genotypes at the same positions are one class, named
    by its least sample; classes are joined on position and their sums formed.
    Only then are pairs of classes expanded to all pairs of their samples, from
    blocks dealt over all partitions, so the pairs themselves are never
    shuffled and a class may hold any share of the samples.
    """
    known = signed.where("sample is not null and position is not null")
    texts = known.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("position", "genotype"))).alias("signs"))
    classes = texts.groupBy("signs").agg(F.min("sample").alias("class"), F.count("*").alias("n"))
    signs = classes.select("class", F.explode("signs").alias("s")).select(F.col("s.position").alias("position"), "class", F.col("s.genotype").alias("genotype"))
    left, right = (signs.select("position", F.col("class").alias(c), F.col("genotype").alias(g)) for c, g in (("x", "gx"), ("y", "gy")))
    met = left.join(right, "position").where("x <= y").groupBy("x", "y").agg(F.count("*").alias("compared"), F.sum((F.col("gx") == F.col("gy")).cast("int")).alias("matches"))
    score = F.col("matches") / F.col("compared")
    met = met.withColumn("score", score if digits is None else F.round(score, digits))
    blocks = texts.join(classes, "signs").select("class", "sample", F.pmod(F.xxhash64("sample"), F.ceil(F.col("n") / BLOCK)).alias("block"))
    blocks = blocks.groupBy("class", "block").agg(F.collect_list("sample").alias("own"))
    sides = met.join(blocks.select(F.col("class").alias("x"), F.col("own").alias("xs")), "x").join(blocks.select(F.col("class").alias("y"), F.col("own").alias("ys")), "y")
    dealt = sides.repartition(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = dealt.withColumn("p", F.explode("xs")).withColumn("q", F.explode("ys")).where("x <> y or p < q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "compared", "matches", "score")
