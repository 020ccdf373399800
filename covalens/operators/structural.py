"""Structural evidence and windows of metrics along contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covalens.operators.intervals import Spans, joined_runs, overlap_join
from covalens.operators.profile import derivative


def insert_size_bounds(histogram: DataFrame, size: str, n: str, *by: str) -> DataFrame:
    """by, lower, upper: 5 below the size where log counts rise most, and 5 above the one where they fall most.

    The fall is looked for from the third size after the rise on; groups of
    fewer than 11 sizes have no bounds. Ties take the smaller size.
    """
    enough = histogram.groupBy(*by).agg(F.count("*").alias("__sizes")).where(F.col("__sizes") >= 11).drop("__sizes") if by else None
    slopes = derivative(histogram, size, n, *by)
    slopes = slopes.join(enough, list(by)) if by else slopes
    own = W.partitionBy(*by).orderBy(size)
    top = W.partitionBy(*by)
    df = slopes.withColumn("__k", F.row_number().over(own)).withColumn("__rise", F.min_by(F.struct(F.col(size).alias("at"), "__k"), F.struct(-F.col("slope"), F.col(size))).over(top))
    right = F.when(F.col("__k") >= F.col("__rise.__k") + 3, F.struct(F.col("slope"), F.col(size).alias("at")))
    return df.groupBy(*by).agg((F.first("__rise.at") - 5).alias("lower"), (F.min(right).getField("at") + 5).alias("upper"))


def evidence(clips: DataFrame, clusters: DataFrame, reach: int = 100) -> DataFrame:
    """clip and cluster ids whose two breakpoints (contig_a, a, contig_b, b) lie within ``reach`` of each other's, in either order of the sides.

    Dealt by both breakpoints at once, in square cells of twice the reach's
    width: a cluster lies in one cell, a clip is sent to each cell that its reach
    touches, so a pair meets once. Sides are put in the order of their contigs;
    only clips with both sides on one contig take part in both orders.
    """
    width = 2 * (2 * reach + 1)
    turn = F.col("contig_a") > F.col("contig_b")
    cell = lambda c: F.floor(c / width)
    cells = lambda c: F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach))

    def ordered(df: DataFrame, turns, name: str) -> DataFrame:
        whole = df.dropna(subset=["contig_a", "a", "contig_b", "b"])
        side = lambda x, y: F.when(F.col("t"), F.col(y)).otherwise(F.col(x))
        sides = whole.select(F.col("id").alias(name), "contig_a", "a", "contig_b", "b", turns.alias("t"))
        return sides.select(name, "t", side("contig_a", "contig_b").alias("ca"), side("a", "b").alias("a"), side("contig_b", "contig_a").alias("cb"), side("b", "a").alias("b"))

    both = F.explode(F.when(F.col("contig_a") == F.col("contig_b"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(turn)))
    left = ordered(clips, both, "clip").withColumn("x", F.explode(cells("a"))).withColumn("y", F.explode(cells("b")))
    left = left.withColumnsRenamed({"t": "t1", "a": "a1", "b": "b1"})
    right = ordered(clusters, turn, "cluster").withColumn("x", cell(F.col("a"))).withColumn("y", cell(F.col("b")))
    met = left.join(right, ["ca", "cb", "x", "y"]).where((F.abs(F.col("a1") - F.col("a")) <= reach) & (F.abs(F.col("b1") - F.col("b")) <= reach))
    return met.groupBy("clip", "cluster").agg(F.min(F.col("t1") != F.col("t")).alias("turned"))


def copy_number_windows(df: DataFrame, contig: str, start: str, sample: str, size: int, lengths: DataFrame, samples: list, as_labelled: bool = True) -> DataFrame:
    """contig, start, end and one count a sample for windows [size j + 1, size (j + 1)], the last one clipped to the contig.

    A start is counted in the window that holds it; with ``as_labelled`` false in
    window floor(start / size), which puts a start on a border one window late.
    """
    j = F.floor((F.col(start) - (1 if as_labelled else 0)) / size)
    counts = df.groupBy(F.col(contig).alias("contig"), j.alias("__j")).pivot(sample, samples).agg(F.count(F.lit(1)))
    out = counts.join(lengths, "contig")
    names = [c for c in counts.columns if c not in ("contig", "__j")]
    return out.select("contig", (F.col("__j") * size + 1).alias("start"), F.least((F.col("__j") + 1) * size, F.col("length")).alias("end"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in names])


def percent_passes(count: Column, total: Column, percent: float, per_patient: Column, least: float, strict: bool = False) -> Column:
    """A position's metric: its share reaches (``strict``: exceeds) the threshold, and reads per patient exceed the least number."""
    share = count * 100 / total
    return F.when(total > 0, ((share > percent) if strict else (share >= percent)) & (per_patient > least)).otherwise(False)


def snp_passes(nonref: Column, total: Column, high_nonref: Column, alt: Column, percent: float, count: int, high: int) -> Column:
    return F.when(total > 0, (nonref * 100 / total >= percent) & (nonref >= count) & (high_nonref >= high) & (alt != "N")).otherwise(False)


def strand_percent_bias(forward_alt: Column, forward: Column, reverse_alt: Column, reverse: Column, least: int, limit: float) -> Column:
    """Whether the alt's share differs by more than ``limit`` percent between the strands, both of at least ``least`` bases."""
    apart = F.abs(forward_alt * 100 / forward - reverse_alt * 100 / reverse)
    return F.when((forward >= least) & (reverse >= least), apart > limit).otherwise(False)


def metric_windows(positions: DataFrame, contig: str, at: str, metrics: list[str], size: int = 30, step: int = 10) -> DataFrame:
    """contig, start and per metric the number of passing positions in each window of ``size`` that starts at a multiple of ``step``."""
    last = F.floor(F.col(at) / step) * step
    starts = F.sequence(last - (size - step), last, F.lit(step).cast("long"))
    each = positions.select(F.col(contig).alias("contig"), F.explode(starts).alias("start"), *metrics)
    return each.groupBy("contig", "start").agg(*[F.sum(F.col(m).cast("int")).alias(m) for m in metrics])


def error_regions(windows: DataFrame, metrics: list[str], least: int, size: int = 30) -> DataFrame:
    """contig, start, end: windows in which any metric passes at ``least`` positions, made one where they overlap or touch."""
    bad = windows.where(F.greatest(*[F.col(m) for m in metrics]) >= least) if len(metrics) > 1 else windows.where(F.col(metrics[0]) >= least)
    return joined_runs(bad.select("contig", F.col("start").cast("long").alias("start"), (F.col("start") + (size - 1)).cast("long").alias("end")))


def chi_square(counts: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """by, chi2, df: the two-sample statistic of two histograms with unequal totals; rows empty in both don't count."""
    used = counts.where(F.col(a) + F.col(b) > 0)
    total = used.groupBy(*by).agg(F.sum(a).alias("__A"), F.sum(b).alias("__B"), F.count("*").alias("__n"))
    joined = used.join(total, list(by)) if by else used.crossJoin(F.broadcast(total))  # one row of totals
    part = F.pow(F.sqrt(F.col("__B") / F.col("__A")) * F.col(a) - F.sqrt(F.col("__A") / F.col("__B")) * F.col(b), 2) / (F.col(a) + F.col(b))
    return joined.where("__A > 0 and __B > 0").groupBy(*by).agg(F.sum(part).alias("chi2"), (F.first("__n") - 1).alias("df"))


def indel_filters(counts: DataFrame) -> DataFrame:
    """Adds filters, by semicolons, to counts of control (c_) and test (t_) reads: coverage, support, partial, novel, forward, reverse.

    HCOVN, HCOVT above 1000; COVT below 8 for somatic calls, COVN12 below 12 or
    COVN8 below 8 in the control; NPART, TPART from 3 partial reads that make
    more than 5 or 10 whole percent; TBIAS, NBIAS if all support is on one
    strand; NNS below 4 novel starts.
    """
    whole = lambda p: F.floor(F.col(f"{p}_partial") * 100 / F.col(f"{p}_coverage"))
    part = lambda p, limit: (F.col(f"{p}_coverage") > 0) & (F.col(f"{p}_partial") >= 3) & (whole(p) > limit)
    one_sided = lambda p: (F.col(f"{p}_support") > 0) & ((F.col(f"{p}_forward") == 0) | (F.col(f"{p}_reverse") == 0))
    somatic = F.col("somatic")
    rules = [
        ("HCOVN", F.col("c_coverage") > 1000), ("HCOVT", F.col("t_coverage") > 1000), ("COVT", somatic & (F.col("t_coverage") < 8)), ("COVN12", somatic & (F.col("c_coverage") < 12)), ("COVN8", ~somatic & (F.col("c_coverage") < 8)),
        ("NPART", part("c", 5)), ("TPART", part("t", 10)), ("NBIAS", ~somatic & one_sided("c")), ("TBIAS", somatic & one_sided("t")), ("NNS", F.when(somatic, F.col("t_novel")).otherwise(F.col("c_novel")) < 4),
    ]
    found = F.concat_ws(";", *[F.when(holds, name) for name, holds in rules])
    return counts.withColumn("filters", F.when(found == "", "PASS").otherwise(found))


def pair_class(lower: int, upper: int) -> Column:
    """Class of a read's pair, of three letters; needs flag, rname, rnext, pos, pnext, tlen and tags.

    Z** for duplicates. With one alignment (NH 1): D** if the mate is unmapped,
    C** if it lies on another contig, E** if the read fails quality checks, else
    strands (A opposite, B equal), direction and insert size (A within the
    bounds, B below, C above). Opposite strands face inward (A) or outward (B);
    on equal strands the first read leads (A) or the second (B); X if both start
    at one place. With another NH or none only AAA is kept, all else is Z**.
    """
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    alignments = F.col("tags")["NH"].try_cast("int")
    one = F.coalesce(alignments == 1, F.lit(False))
    left, right, reverse = F.col("pos") < F.col("pnext"), F.col("pos") > F.col("pnext"), bit(16)
    toward, away = (left & ~reverse) | (right & reverse), (right & ~reverse) | (left & reverse)
    apart = bit(16) != bit(32)
    leads = (bit(64) & toward) | (bit(128) & away)
    follows = (bit(128) & toward) | (bit(64) & away)
    facing = F.when(apart, F.when(away, "B").when(toward, "A").otherwise("X")).otherwise(F.when(follows, "B").when(leads, "A").otherwise("X"))
    size = F.abs("tlen")
    full = F.concat(F.when(apart, "A").otherwise("B"), facing, F.when(size < lower, "B").when(size > upper, "C").otherwise("A"))
    elsewhere = (F.col("rnext") != "=") & (F.col("rnext") != F.col("rname"))
    single = F.when(bit(8), "D**").when(F.coalesce(elsewhere, F.lit(False)), "C**").when(bit(512), "E**").otherwise(full)
    return F.when(bit(1024), "Z**").when(one, single).when(full == "AAA", "AAA").otherwise("Z**")


def pair_overlap() -> Column:
    """Positions that a read shares with its mate: for tlen above 0 and a mate that starts before the read ends, else 0."""
    last = F.least(F.col("end"), F.col("pos") + F.col("tlen") - 1)
    return F.when((F.col("tlen") > 0) & (F.col("pnext") <= F.col("end")), last - F.greatest("pos", "pnext") + 1).otherwise(0)


def psl_score(hits: DataFrame) -> DataFrame:
    """Adds score: matches and half the repeat matches, less mismatches and gaps."""
    return hits.withColumn("score", F.col("matches") + F.floor(F.col("rep_matches") / 2) - F.col("mismatches") - F.col("q_gaps") - F.col("t_gaps"))


def sampled_pairs(reads: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """All reads of a share of the names; which ones follows from the name and the seed, so mates stay together."""
    draw = F.pmod(F.xxhash64("qname", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return reads.where(draw < share)


def lifted(points: DataFrame, chain: DataFrame) -> DataFrame:
    """Points (contig, pos) moved by blocks (contig, start, end, to_contig, to_start); a point in no block gets nulls."""
    hit = overlap_join(Spans(points.withColumn("__e", F.col("pos")), "contig", "pos", "__e"), Spans(chain))
    moved = hit.select(F.col("a.contig").alias("__c"), F.col("a.pos").alias("__p"), F.col("b.to_contig").alias("to_contig"), (F.col("b.to_start") + F.col("a.pos") - F.col("b.start")).alias("to_pos")).groupBy("__c", "__p").agg(F.min(F.struct("to_contig", "to_pos")).alias("__t"))
    return points.join(moved, (F.col("contig") == F.col("__c")) & (F.col("pos") == F.col("__p")), "left").select(*points.columns, F.col("__t.to_contig").alias("to_contig"), F.col("__t.to_pos").alias("to_pos"))
