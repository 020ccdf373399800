"""Connected components of a graph that is too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris and others, 2014); each
    step is two shuffles, written to the shared folder, so that neither lineage
    nor a hub's neighbours pile up in one place. Loops and repeated edges are
    allowed. No edges give no rows. Nodes without edges don't appear.
    """
    tidy = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, before = common.stored(tidy, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.stored(large.where("a > b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        linked = large.join(least, large.a == least.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = linked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = common.stored(small.where("a > b").distinct(), "small")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
