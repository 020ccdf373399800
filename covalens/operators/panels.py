"""Reads and regions of a panel: probes found by their prefix, regions given to fragments, consensus of clipped ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.functions.sequence import reverse_complement
from covalens.operators.intervals import Spans, fitting_width, overlap_join


def probes_found(reads: DataFrame, probes: DataFrame) -> DataFrame:
    """reads (id, seq) with probe and size: the longest probe (probe, primer) whose primer begins the read, the first by name on ties.

    Reads without one, and those whose text is null, have null in both. Each
    read meets the probes once for each length of primer, by equality. An id
    must be unique.
    """
    known = probes.where(F.length("primer") > 0).groupBy("primer").agg(F.min("probe").alias("probe"))
    lengths = known.agg(F.collect_set(F.length("primer")).alias("sizes"))  # as many as primers have lengths
    starts = reads.join(F.broadcast(lengths)).select("id", "seq", F.explode("sizes").alias("size")).where(F.length("seq") >= F.col("size"))
    hits = starts.select("id", "size", F.expr("left(seq, size)").alias("primer")).join(known, "primer")
    best = hits.groupBy("id").agg(F.max(F.struct("size", "probe")).alias("x"))
    return reads.join(best.select("id", "x.probe", "x.size"), "id", "left")


def regions_of(fragments: DataFrame, regions: DataFrame, slack: int = 10) -> DataFrame:
    """Structs a (region) and b (fragment) of one contig: the fragment holds the whole region and ends more than ``slack`` behind it.

    Slack is asked for at the end alone. Both have contig, start and end.
    """
    pairs = overlap_join(Spans(regions), Spans(fragments), width=fitting_width(Spans(fragments)), within=True)
    return pairs.where(F.col("b.end") > F.col("a.end") + slack)


def regions_counted(fragments: DataFrame, regions: DataFrame, slack: int = 10) -> DataFrame:
    """The rows of fragments that hold a region, as ``regions_of`` has it, with n, how many, and first, the least start of these.

    Regions and fragments of equal contig, start and end meet once, with their
    number, however many there are.
    """
    place = ["contig", "start", "end"]
    held = regions_of(fragments.select(*place).distinct(), regions.groupBy(*place).agg(F.count("*").alias("n")), slack)
    counts = held.groupBy(*(F.col(f"b.{c}").alias(c) for c in place)).agg(F.sum("a.n").alias("n"), F.min("a.start").alias("first"))
    return fragments.join(counts, place)


def clip_consensus(clips: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, clips and consensus of clipped ends (keys, reverse, clip) of ``least`` bases or more.

    A column's base is the one that most clips have; N on a tie, or if that is
    none of A, C, G, T. The consensus of reverse reads is reverse-complemented.
    Counts are summed before they are dealt, so a place may hold any number of
    clips.
    """
    by = [*keys, "reverse"]
    fit = clips.where(F.length("clip") >= least)
    columns = fit.select(*by, F.posexplode(F.split(F.upper("clip"), ""))).withColumnRenamed("col", "base")
    votes = columns.groupBy(*by, "pos", "base").agg(F.count("*").alias("n"))
    most = votes.groupBy(*by, "pos").agg(F.max("n").alias("n"), F.max_by("base", "n").alias("base"), F.sort_array(F.collect_list("n"), asc=False).alias("all"), F.sum("n").alias("depth"))
    tie = (F.size("all") > 1) & (F.get("all", F.lit(1)) == F.col("n"))
    called = most.withColumn("base", F.when(tie | ~F.col("base").isin("A", "C", "G", "T"), "N").otherwise(F.col("base")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    rows = called.groupBy(*by).agg(F.max("depth").alias("clips"), text.alias("text"))
    return rows.select(*by, "clips", F.when(F.col("reverse"), reverse_complement(F.col("text"))).otherwise(F.col("text")).alias("consensus"))
