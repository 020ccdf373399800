"""Alignment: what built-in functions can't express runs in Arrow-batched Python, after a k-mer filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covalens.functions.sequence import hamming, kmers


def smith_waterman(a: str, b: str, match: float = 5, mismatch: float = -4, opening: float = 16, extend: float = 4) -> tuple[float, str, str, str]:
    """Score and the three lines of the best local alignment with affine gaps.

    A tie between opening and extending a gap opens one; of equal ways the
    diagonal goes before the gap in b, and that before the gap in a; of equal
    best cells the first by row is taken. Empty texts align to nothing.
    """
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    up = np.full((n + 1, m + 1), -np.inf)
    left = np.full((n + 1, m + 1), -np.inf)
    up_long = np.zeros((n + 1, m + 1), bool)
    left_long = np.zeros((n + 1, m + 1), bool)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    gain = np.full((n + 1, m + 1), float(mismatch))
    gain[1:, 1:][x[:, None] == y] = match
    fh, fu, fl, ful, fll, fg = (t.reshape(-1) for t in (h, up, left, up_long, left_long, gain))
    for d in range(2, n + m + 1 if n and m else 2):  # cells with i + j = d lie m apart
        first, last = max(1, d - m) * m + d, min(n, d - 1) * m + d
        at = lambda back: slice(first - back, last - back + 1, m)  # noqa: B023, E731
        go, new = fu[at(m + 1)] - extend, fh[at(m + 1)] - opening
        ful[at(0)], fu[at(0)] = go > new, np.maximum(go, new)
        go, new = fl[at(1)] - extend, fh[at(1)] - opening
        fll[at(0)], fl[at(0)] = go > new, np.maximum(go, new)
        fh[at(0)] = np.maximum(np.maximum(0, fh[at(m + 2)] + fg[at(0)]), np.maximum(fu[at(0)], fl[at(0)]))
    if not h.size or h.max() <= 0:
        return 0.0, "", "", ""
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, x, y, z = float(h[i, j]), [], [], []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            x.append(a[i - 1])
            y.append("|" if a[i - 1] == b[j - 1] else ".")
            z.append(b[j - 1])
            i, j = i - 1, j - 1
        elif h[i, j] == up[i, j]:
            more = True
            while more:
                more = up_long[i, j]
                x.append(a[i - 1])
                y.append(" ")
                z.append("-")
                i -= 1
        else:
            more = True
            while more:
                more = left_long[i, j]
                x.append("-")
                y.append(" ")
                z.append(b[j - 1])
                j -= 1
    return score, "".join(x[::-1]), "".join(y[::-1]), "".join(z[::-1])


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds score, top, middle, bottom of the local alignment of two columns; null texts are empty."""

    def run(batches):
        for pdf in batches:
            out = [smith_waterman(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)]
            yield pdf.assign(**{name: pd.Series([o[i] for o in out], index=pdf.index, dtype=kind) for i, (name, kind) in enumerate((("score", float), ("top", object), ("middle", object), ("bottom", object)))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "score double", "top string", "middle string", "bottom string"])
    return pairs.mapInPandas(run, schema)


def kmer_index(targets: DataFrame, key: str, seq: str, k: int = 13, most: int = 5000) -> DataFrame:
    """kmer, n, places (key, position from 1): k-mers with more than ``most`` places keep their count only."""
    at = targets.select(F.col(key).alias("key"), F.posexplode(kmers(F.col(seq), k)).alias("i", "kmer"))
    counts = at.groupBy("kmer").agg(F.count("*").alias("n"))
    rare = at.join(counts.where(F.col("n") <= most).select("kmer"), "kmer").groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("key", (F.col("i") + 1).alias("position")))).alias("places"))
    return counts.join(rare, "kmer", "left")


def seeds(queries: DataFrame, query: str, seq: str, index: DataFrame, k: int = 13, least: int = 2) -> DataFrame:
    """query, target, n: targets that share at least ``least`` indexed k-mers with a query."""
    own = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(kmers(F.col(seq), k))).alias("kmer"))
    hit = own.join(index.where("places is not null"), "kmer").select("query", "kmer", F.explode(F.array_distinct(F.transform("places", lambda x: x.key))).alias("target"))
    return hit.groupBy("query", "target").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def collapsed(fragments: DataFrame, seq: str) -> DataFrame:
    """seq, n: equal fragments counted; a singleton joins the largest bin (the first by text on ties) of its length at
    Hamming distance 1.

    Neighbours are found by equality with one place left out, not by comparing all pairs.
    """
    counts = fragments.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq")).agg(F.count("*").alias("n"))
    holes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1))), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring("seq", F.lit(1), i - 1), F.lit("*"), F.substring("seq", i + 1, F.length("seq"))))
    each = counts.withColumn("hole", F.explode(holes))
    best = each.where("n > 1").groupBy("hole").agg(F.min_by(F.struct("n", "seq"), F.struct(-F.col("n"), F.col("seq"))).alias("b"))
    moved = each.where("n = 1").join(best, "hole").groupBy("seq").agg(F.min_by("b.seq", F.struct(-F.col("b.n"), F.col("b.seq"))).alias("to"))
    return counts.join(moved, "seq", "left").groupBy(F.coalesce("to", "seq").alias("seq")).agg(F.sum("n").alias("n"))


def best_hits(hits: DataFrame, query: str, order: list) -> DataFrame:
    """The best alignment of each query by ``order``."""
    return hits.withColumn("__k", F.row_number().over(W.partitionBy(query).orderBy(*order))).where("__k = 1").drop("__k")


__all__ = ["aligned", "best_hits", "collapsed", "hamming", "kmer_index", "seeds", "smith_waterman"]
