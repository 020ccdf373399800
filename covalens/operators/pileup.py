"""Base pileups from aligned reads, and what is read off them.

Reads have qname, flag, rname, pos, cigar, seq, qual. Each read is exploded into
its bases once; all else is a keyed aggregate by (contig, position), so hot
positions are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """array of struct(n, op, ref, read): each operator with the reference and read offsets at its start."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<n:int,op:string,ref:int,read:int>>").alias("out"))

    def step(acc, x):
        on_ref = F.when(x.op.isin("M", "D", "N", "=", "X"), x.n).otherwise(0)
        on_read = F.when(x.op.isin("M", "I", "S", "=", "X"), x.n).otherwise(0)
        own = F.struct(x.n.alias("n"), x.op.alias("op"), acc["ref"].alias("ref"), acc["read"].alias("read"))
        return F.struct((acc["ref"] + on_ref).alias("ref"), (acc["read"] + on_read).alias("read"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


def reference_end(pos: Column, cigar: Column) -> Column:
    """The last reference position of an alignment."""
    return pos + F.aggregate(cigar_ops(cigar), F.lit(0), lambda acc, x: acc + F.when(x.op.isin("M", "D", "N", "=", "X"), x.n).otherwise(0)) - 1


def bases(reads: DataFrame) -> DataFrame:
    """One row per aligned base: qname, rname, pos, base, qual, reverse, start, end (of the read), end_of_read.

    end_of_read: the read starts or ends fewer than 5 positions away.
    """
    own = reads.withColumns({"__ops": cigar_ops(F.col("cigar")), "__end": reference_end(F.col("pos"), F.col("cigar"))})
    aligned = own.withColumn("__op", F.explode(F.filter("__ops", lambda x: x.op.isin("M", "=", "X"))))
    at = aligned.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__op.n") - 1)))
    read_at = F.col("__op.read") + F.col("__i") + 1
    out = at.select(
        "qname", "rname", (F.col("pos") + F.col("__op.ref") + F.col("__i")).alias("at"), F.substring("seq", read_at, F.lit(1)).alias("base"), (F.ascii(F.substring("qual", read_at, F.lit(1))) - 33).alias("qual"),
        (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("reverse"), F.col("pos").alias("start"), F.col("__end").alias("end"),
    )
    return out.withColumnRenamed("at", "pos").withColumn("end_of_read", (F.col("start") > F.col("pos") - 5) | (F.col("end") < F.col("pos") + 5))


def index_at(pos: Column, cigar: Column, wanted: Column) -> Column:
    """0-based read offset of a reference position; -1 outside or in a deletion."""
    hit = F.filter(cigar_ops(cigar), lambda x: x.op.isin("M", "=", "X") & (pos + x.ref <= wanted) & (wanted < pos + x.ref + x.n))
    return F.when(F.size(hit) > 0, F.get(hit, F.lit(0)).read + wanted - pos - F.get(hit, F.lit(0)).ref).otherwise(-1)


def without_overlaps(observed: DataFrame) -> DataFrame:
    """Of two observations of one read name at a position: none if the bases differ, else the better quality on one
    strand (the forward on ties of strand), or the one on the strand that is in the minority there."""
    key = ["rname", "pos"]
    strand = observed.groupBy(*key).agg(F.sum((~F.col("reverse")).cast("int")).alias("__f"), F.sum(F.col("reverse").cast("int")).alias("__r"))
    own = W.partitionBy(*key, "qname")
    df = observed.join(strand, key).withColumns({"__n": F.count("*").over(own), "__b": F.size(F.collect_set("base").over(own)), "__s": F.size(F.collect_set("reverse").over(own))})
    crowded = F.when(F.col("__f") >= F.col("__r"), ~F.col("reverse")).otherwise(F.col("reverse"))
    rank = F.row_number().over(own.orderBy(F.when(F.col("__s") > 1, crowded).otherwise(F.lit(False)), F.desc("qual"), "start", "reverse"))
    return df.withColumn("__k", rank).where("__n = 1 or __b = 1 and __k = 1").select(*observed.columns)


def by_base(observed: DataFrame) -> DataFrame:
    """rname, pos, base, fwd, fwd_qual, rev, rev_qual, novel (distinct read starts forward and read ends reverse), ends."""
    f, r = ~F.col("reverse"), F.col("reverse")
    one = lambda c: F.sum(c.cast("int"))
    return observed.groupBy("rname", "pos", "base").agg(
        one(f).alias("fwd"), F.coalesce(F.sum(F.when(f, F.col("qual"))), F.lit(0)).alias("fwd_qual"), one(r).alias("rev"), F.coalesce(F.sum(F.when(r, F.col("qual"))), F.lit(0)).alias("rev_qual"),
        (F.count_distinct(F.when(f, F.col("start"))) + F.count_distinct(F.when(r, F.col("end")))).alias("novel"), one(F.col("end_of_read")).alias("ends"),
    )


def observed_text(counts: DataFrame) -> DataFrame:
    """rname, pos, oabs: bases in order as ``A10[30.0]5[31.2]``, joined by semicolons."""
    mean = lambda q, n: F.when(F.col(n) > 0, F.round(F.col(q) / F.col(n), 2)).otherwise(0.0).cast("string")
    part = F.concat("base", F.col("fwd").cast("string"), F.lit("["), mean("fwd_qual", "fwd"), F.lit("]"), F.col("rev").cast("string"), F.lit("["), mean("rev_qual", "rev"), F.lit("]"))
    return counts.groupBy("rname", "pos").agg(F.array_join(F.array_sort(F.collect_list(part)), ";").alias("oabs"))


def voted(counts: DataFrame, least: int, quality_percent: float, reference: str | None = None) -> DataFrame:
    """rname, pos, genotype, coverage: of bases with ``least`` reads and a share of all quality, the best two by
    (count, quality, being the reference, name); one alone is homozygous; null if none."""
    total = W.partitionBy("rname", "pos")
    n, q = F.col("fwd") + F.col("rev"), F.col("fwd_qual") + F.col("rev_qual")
    df = counts.withColumns({"n": n, "q": q}).withColumns({"coverage": F.sum("n").over(total), "qall": F.sum("q").over(total)})
    good = (F.col("n") >= least) & (F.col("q") * 100 >= F.col("qall") * quality_percent)
    is_ref = (F.col("base") == F.col(reference)).cast("int") if reference else F.lit(0)
    ranked = F.filter(F.array_sort(F.collect_list(F.struct((~good).alias("bad"), (-F.col("n")).alias("n"), (-F.col("q")).alias("q"), (-is_ref).alias("r"), F.col("base")))), lambda x: ~x.bad)
    df = df.groupBy("rname", "pos").agg(ranked.alias("top"), F.first("coverage").alias("coverage"))
    pair = F.array_join(F.array_sort(F.array(F.get("top", F.lit(0)).base, F.coalesce(F.get("top", F.lit(1)).base, F.get("top", F.lit(0)).base))), "/")
    return df.select("rname", "pos", F.when(F.size("top") > 0, pair).alias("genotype"), "coverage")


def throttled(df: DataFrame, keys: list[str], passes: Column, order: list[Column], most: int) -> DataFrame:
    """All rows that pass, and the first ``most`` that fail of each key by ``order``."""
    rank = F.row_number().over(W.partitionBy(*keys, "__ok").orderBy(*order))
    ok = F.coalesce(passes, F.lit(False))
    return df.withColumn("__ok", ok).withColumn("__k", rank).where(F.col("__ok") | (F.col("__k") <= most)).drop("__ok", "__k")


def combined(matrices: list[tuple[DataFrame, int]], keys: list[str]) -> DataFrame:
    """Matrices added (weight 1) and taken away (-1), value by value; rows that come to nothing go."""
    values = [c for c in matrices[0][0].columns if c not in keys]
    parts = [m.select(*keys, *[(F.col(v) * w).alias(v) for v in values]) for m, w in matrices]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    return out.where(" or ".join(f"{v} <> 0" for v in values))
