"""Greedy clustering of pairs of breakpoints.

Pairs are dealt by contigs and by islands: stretches of left ends without a gap
above the window. Islands don't affect each other; each is clustered in order of
its left ends by one task, so the result is that of a single pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_clusters(pairs: DataFrame, window: int, least: int) -> DataFrame:
    """contig_a, contig_b, cluster (its seed's left end), members, left_start, left_end, right_start, right_end.

    Pairs (contig_a, a, contig_b, b) sorted by a, then b: the first that is free
    seeds a cluster of the free ones within ``window`` of its a and of its b; of
    ``least`` members it is kept, else only the seed is given up.
    """
    own = W.partitionBy("contig_a", "contig_b").orderBy("a", "b")
    df = pairs.select("contig_a", F.col("a").cast("long").alias("a"), "contig_b", F.col("b").cast("long").alias("b"))
    gap = F.when(F.col("a") - F.lag("a").over(own) <= window, 0).otherwise(1)
    df = df.withColumn("new", gap).withColumn("island", F.floor(F.sum("new").over(own) / 256)).drop("new")

    def cluster(key, pdf):
        pdf = pdf.sort_values(["a", "b"]).reset_index(drop=True)
        free = [True] * len(pdf)
        a, b, out = pdf.a.tolist(), pdf.b.tolist(), []
        for i in range(len(pdf)):
            if not free[i]:
                continue
            own = []
            j = i
            while j < len(pdf) and a[j] - a[i] <= window:
                if free[j] and abs(b[j] - b[i]) <= window:
                    own.append(j)
                j += 1
            free[i] = False
            if len(own) >= least:
                for j in own:
                    free[j] = False
                out.append((key[0], key[1], a[i], len(own), min(a[j] for j in own), max(a[j] for j in own), min(b[j] for j in own), max(b[j] for j in own)))
        return pd.DataFrame(out, columns=["contig_a", "contig_b", "cluster", "members", "left_start", "left_end", "right_start", "right_end"])

    schema = "contig_a string, contig_b string, cluster long, members long, left_start long, left_end long, right_start long, right_end long"
    return df.withColumns({"contig_a": F.col("contig_a").cast("string"), "contig_b": F.col("contig_b").cast("string")}).groupBy("contig_a", "contig_b", "island").applyInPandas(cluster, schema)
