"""Operators over closed intervals [start, end] in groups (contigs).

Intervals are cut at the borders of bins of a fixed width, so that joins and
sweeps are dealt by (contig, bin): one contig may hold any share of the rows.
Column names are parameters; a row whose contig, start or end is null, or whose
end lies before its start, is in no result but that of ``anti_join``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions in one bin.
BIN = 1 << 12


@dataclass(frozen=True)
class Spans:
    """A table of intervals and the names of their columns."""

    df: DataFrame
    contig: str = "contig"
    start: str = "start"
    end: str = "end"

    def valid(self) -> DataFrame:
        return self.df.where(F.col(self.contig).isNotNull() & (F.col(self.start) <= F.col(self.end)))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column], buffer: int = 0) -> Column:
    """Closed intervals share a position, either one extended by ``buffer``."""
    return (a[0] - buffer <= b[1]) & (a[1] + buffer >= b[0])


def contains(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] <= b[0]) & (a[1] >= b[1])


def adjacent(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """One ends right before the other starts."""
    return (a[1] + 1 == b[0]) | (b[1] + 1 == a[0])


def within_delta(a: tuple[Column, Column], b: tuple[Column, Column], delta: int) -> Column:
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) <= delta


def overlap_length(a: tuple[Column, Column], b: tuple[Column, Column], inclusive: bool = True) -> Column:
    """Shared positions; without ``inclusive`` the distance of the shared ends, one less. 0 if disjoint."""
    return F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + (1 if inclusive else 0), F.lit(0))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def _binned(spans: Spans, prefix: str, buffer: int, width: int, first: bool = False) -> DataFrame:
    """One row for each bin, or (``first``) for the bin of the start alone."""
    df = spans.valid()
    s, e = F.col(spans.start).cast("long") - buffer, F.col(spans.end).cast("long") + buffer
    bins = F.floor(s / width) if first else F.explode(_bins(s, e, width))
    return df.select(F.struct(*df.columns).alias(prefix), F.col(spans.contig).alias("__contig"), s.alias(f"__{prefix}s"), e.alias(f"__{prefix}e"), bins.alias("__bin"))


def fitting_width(spans: Spans, least: int = 16) -> int:
    """The power of two that reaches the mean length, so that bins are narrow and an interval lies in about two of them."""
    mean = spans.valid().agg(F.avg(F.col(spans.end) - F.col(spans.start) + 1)).first()[0]
    return 1 << max(least - 1, math.ceil(mean or 1) - 1).bit_length()


def overlap_join(a: Spans, b: Spans, buffer: int = 0, width: int = BIN, within: bool = False) -> DataFrame:
    """Structs a and b of each pair whose intervals overlap (with ``within``: b's contains a's).

    Each pair is found in the one bin where the later of both starts lies; with
    ``within`` that is a's, so a is in no other.
    """
    left, right = _binned(a, "a", buffer, width, within), _binned(b, "b", 0, width)
    joined = left.join(right.withColumnsRenamed({"__contig": "__rc", "__bin": "__rb"}), (F.col("__contig") == F.col("__rc")) & (F.col("__bin") == F.col("__rb")) & (F.col("__as") <= F.col("__be")) & (F.col("__ae") >= F.col("__bs")))
    joined = joined.where(F.floor(F.greatest("__as", "__bs") / width) == F.col("__bin"))
    if within:
        joined = joined.where((F.col("__bs") <= F.col("__as")) & (F.col("__be") >= F.col("__ae")))
    return joined.select("a", "b")


def _marked(a: Spans, b: Spans, buffer: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a that overlap any of b, found by value: rows alike are one."""
    merged = merge(b)
    hit = overlap_join(a, Spans(merged), buffer).select("a.*").distinct()
    return a.df, hit


def semi_join(a: Spans, b: Spans, buffer: int = 0) -> DataFrame:
    """The rows of a that overlap any of b."""
    df, hit = _marked(a, b, buffer)
    return df.join(hit, [df[c].eqNullSafe(hit[c]) for c in df.columns], "left_semi")


def anti_join(a: Spans, b: Spans, buffer: int = 0) -> DataFrame:
    """The rows of a that overlap none of b; rows without a valid interval are among them."""
    df, hit = _marked(a, b, buffer)
    return df.join(hit, [df[c].eqNullSafe(hit[c]) for c in df.columns], "left_anti")


def _pieces(spans: Spans, width: int) -> DataFrame:
    """The intervals cut at the borders of bins: contig, bin, s, e."""
    df = spans.valid()
    s, e = F.col(spans.start).cast("long"), F.col(spans.end).cast("long")
    cut = df.select(F.col(spans.contig).alias("contig"), s.alias("s0"), e.alias("e0"), F.explode(_bins(s, e, width)).alias("bin"))
    return cut.select("contig", "bin", F.greatest("s0", F.col("bin") * width).alias("s"), F.least("e0", F.col("bin") * width + (width - 1)).alias("e"))


def depth(spans: Spans, width: int = BIN) -> DataFrame:
    """Runs of equal depth above 0 as contig, start, end, depth; runs end at borders of bins.

    A sweep over the ends of each bin's pieces, with equal positions summed first.
    """
    cut = _pieces(spans, width)
    ends = cut.select("contig", "bin", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("contig", "bin", F.col("x.at").alias("start")).agg(F.sum("x.d").alias("d"))
    own = W.partitionBy("contig", "bin").orderBy("start")
    runs = steps.select("contig", "start", (F.lead("start").over(own) - 1).alias("end"), F.sum("d").over(own).alias("depth"))
    return runs.where("depth > 0 and end is not null")


def joined_runs(runs: DataFrame, *values: str, gap: int = 0) -> DataFrame:
    """Runs (contig, start, end) that touch, and agree in ``values``, made one."""
    own = W.partitionBy("contig", *values).orderBy("start")
    new = F.when(F.col("start") <= F.lag("end").over(own) + 1 + gap, 0).otherwise(1)
    grouped = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(own))
    return grouped.groupBy("contig", *values, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("contig", "start", "end", *values)


def merge(spans: Spans, gap: int = 0, width: int = BIN) -> DataFrame:
    """Overlapping and adjacent intervals, and those up to ``gap`` apart, made one: contig, start, end.

    Bins are merged each by itself; what is left of a contig, one run a bin where
    it is covered, is then joined.
    """
    own = W.partitionBy("contig", "bin").orderBy("s", "e")
    far = F.max("e").over(own.rowsBetween(W.unboundedPreceding, -1))
    cut = _pieces(spans, width).distinct()
    runs = cut.withColumn("far", far).withColumn("new", F.when(F.col("s") <= F.col("far") + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(own))
    runs = runs.groupBy("contig", "bin", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return joined_runs(runs.select("contig", "start", "end"), gap=gap)


def gaps(spans: Spans, lengths: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Stretches of ``least`` positions or more that no interval covers: contig, start, end.

    Between intervals, and where ``lengths`` (contig, length) is given, from 1 to the contig's end too.
    """
    merged = merge(spans)
    if lengths is not None:
        edge = lengths.select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("length") + 1)).alias("start"))
        merged = merged.unionByName(edge.select("contig", "start", F.col("start").alias("end")))
        inside = lengths.select("contig", (F.col("length") + 1).alias("stop"))
        merged = merged.join(inside, "contig").where("start <= stop").drop("stop")
    own = W.partitionBy("contig").orderBy("start", "end")
    after = merged.select("contig", (F.col("end") + 1).alias("start"), (F.lead("start").over(own) - 1).alias("end"))
    return after.where(F.col("end") - F.col("start") + 1 >= least)


def feature_depth(reads: Spans, features: Spans, name: str, width: int = BIN) -> DataFrame:
    """Depth inside each feature as name, contig, start, end, depth, with stretches of depth 0 filled in.

    A feature is a row; rows of one name each count their positions.
    """
    f = features.valid().select(F.col(name).alias("name"), F.col(features.contig).alias("contig"), F.col(features.start).cast("long").alias("fs"), F.col(features.end).cast("long").alias("fe"))
    runs = depth(reads, width)
    hit = overlap_join(Spans(f, "contig", "fs", "fe"), Spans(runs), width=width)
    inside = hit.select("a.name", "a.contig", "a.fs", "a.fe", F.greatest("a.fs", "b.start").alias("start"), F.least("a.fe", "b.end").alias("end"), "b.depth")
    # the uncovered rest: between covered stretches, before the first and after the last
    edges = f.distinct().select("name", "contig", "fs", "fe", F.explode(F.array(F.col("fs") - 1, F.col("fe") + 1)).alias("start"))
    marks = inside.select("name", "contig", "fs", "fe", "start", "end").distinct().unionByName(edges.withColumn("end", F.col("start")))
    own = W.partitionBy("name", "contig", "fs", "fe").orderBy("start", "end")
    empty = marks.withColumn("s", F.col("end") + 1).withColumn("e", F.lead("start").over(own) - 1).where("s <= e")
    empty = empty.select("name", "contig", "fs", "fe", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(0).cast("long").alias("depth"))
    times = f.groupBy("name", "contig", "fs", "fe").agg(F.count("*").alias("times"))
    inside = inside.distinct().unionByName(empty).join(times, ["name", "contig", "fs", "fe"])
    return inside


def coverage_histogram(reads: Spans, features: Spans, name: str) -> DataFrame:
    """name, depth, bases: how many positions of the features of each name have each depth, 0 included."""
    runs = feature_depth(reads, features, name)
    return runs.groupBy("name", "depth").agg(F.sum((F.col("end") - F.col("start") + 1) * F.col("times")).alias("bases"))


def low_depth(reads: Spans, features: Spans, name: str, cutoff: int) -> DataFrame:
    """name, contig, start, end: maximal runs inside a feature whose depth is below ``cutoff``."""
    low = feature_depth(reads, features, name).where(F.col("depth") < cutoff)
    return joined_runs(low, "name", "fs", "fe").select("name", "contig", "start", "end").distinct()


def physical(reads: DataFrame) -> DataFrame:
    """The span of each fragment: [pos, pos + tlen], the extra position included, for paired reads of tlen 0 or more;
    an unpaired read's own span; nothing for a negative tlen, as the mate counts."""
    paired = F.col("flag").bitwiseAND(F.lit(1)) != 0
    end = F.when(paired & (F.col("tlen") >= 0), F.col("pos") + F.col("tlen")).when(~paired, F.col("end"))
    return reads.select(F.col("rname").alias("contig"), F.col("pos").alias("start"), end.alias("end")).where("end is not null")


def tumbling_counts(df: DataFrame, contig: str, at: str, size: int, *by: str) -> DataFrame:
    """Rows per window of ``size`` positions (window = floor(at / size)), contig and ``by``."""
    return df.groupBy(F.col(contig).alias("contig"), F.floor(F.col(at) / size).cast("long").alias("window"), *by).agg(F.count("*").alias("n"))


def sliding_counts(df: DataFrame, contig: str, at: str, size: int = 30, step: int = 10) -> DataFrame:
    """contig, start, n: rows in each window [start, start + size) whose start is a multiple of ``step``; empty windows don't appear."""
    last = F.floor(F.col(at) / step) * step
    starts = F.sequence(last - (size - step), last, F.lit(step).cast("long"))
    return df.select(F.col(contig).alias("contig"), F.explode(starts).alias("start")).groupBy("contig", "start").agg(F.count("*").alias("n"))


def tiles(lengths: DataFrame, size: int) -> DataFrame:
    """contig, start, end: each contig of (contig, length) in tiles from 1, the last one clipped."""
    starts = F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(size).cast("long"))
    return lengths.where("length >= 1").select("contig", "length", F.explode(starts).alias("start")).select("contig", "start", F.least(F.col("start") + (size - 1), F.col("length")).alias("end"))


def shoulders(features: Spans, sizes: list[int]) -> DataFrame:
    """Stretches before and after each merged feature, nearest first, cut where the next feature or its shoulder begins.

    Columns: contig, start, end, side (pre or post), level (1 nearest). A gap too
    small for the shoulders of both neighbours is shared at its middle.
    """
    merged = merge(features)
    own = W.partitionBy("contig").orderBy("start")
    before, after = F.lag("end").over(own), F.lead("start").over(own)
    room = merged.select("contig", "start", "end", F.coalesce(F.floor((before + F.col("start")) / 2) + 1, F.lit(1)).alias("lo"), F.coalesce(F.floor((F.col("end") + after) / 2), F.lit((1 << 62))).alias("hi"))
    parts, done = [], 0
    for level, size in enumerate(sizes, 1):
        pre = F.struct(F.greatest(F.col("start") - (done + size), F.col("lo")).alias("start"), (F.col("start") - done - 1).alias("end"), F.lit("pre").alias("side"), F.lit(level).alias("level"))
        post = F.struct((F.col("end") + done + 1).alias("start"), F.least(F.col("end") + (done + size), F.col("hi")).alias("end"), F.lit("post").alias("side"), F.lit(level).alias("level"))
        parts += [pre, post]
        done += size
    return room.select("contig", F.explode(F.array(*parts)).alias("x")).select("contig", "x.*").where("start <= end")


def nearest(df: DataFrame, contig: str, at: str) -> DataFrame:
    """Adds nearest: the closest other position in the contig, the lower one on ties; null if there is none."""
    points = df.select(F.col(contig).alias("__c"), F.col(at).alias("__p")).distinct()
    own = W.partitionBy("__c").orderBy("__p")
    lo, hi = F.lag("__p").over(own), F.lead("__p").over(own)
    near = F.when(hi.isNull() | (F.col("__p") - lo <= hi - F.col("__p")), lo).otherwise(F.coalesce(hi, lo))
    points = points.withColumn("nearest", F.when(lo.isNull(), hi).otherwise(near))
    return df.join(points, (df[contig] == F.col("__c")) & (df[at] == F.col("__p")), "left").drop("__c", "__p")


def islands(df: DataFrame, contig: str, at: str, value: str) -> DataFrame:
    """Maximal runs of successive positions of one value: contig, value, start, end, n."""
    points = df.select(F.col(contig).alias("contig"), F.col(value).alias("value"), F.col(at).alias("at")).distinct()
    own = W.partitionBy("contig", "value").orderBy("at")
    runs = points.withColumn("run", F.col("at") - F.row_number().over(own))
    return runs.groupBy("contig", "value", "run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n")).drop("run")
