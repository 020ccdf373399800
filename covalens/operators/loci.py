"""Reference bases around positions, alleles ranked at a position, and tables of calls and reads set against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covalens.functions.records import run_beside

#: Bases of a contig that one row of a chunked reference holds.
CHUNK = 4096


def chunked(reference: DataFrame, size: int = CHUNK) -> DataFrame:
    """(contig, chunk, bases) of a reference (contig, sequence): so many bases a row, so that no join carries a whole contig."""
    return reference.select("contig", F.posexplode(F.regexp_extract_all("sequence", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))).alias("chunk", "bases"))


def looked_up(ranges: DataFrame, chunks: DataFrame, size: int = CHUNK, fill: str | None = None) -> DataFrame:
    """Adds bases to ranges (contig, start, end; from 1, closed): those of the reference, cut at the contig's ends or filled up with ``fill``."""
    keys = ranges.select(F.col("contig").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e")).where("__e >= 1 and __e >= __s").distinct()
    first, last = F.floor((F.greatest("__s", F.lit(1)) - 1) / size), F.floor((F.col("__e") - 1) / size)
    each = keys.withColumn("__k", F.explode(F.sequence(first, last)))
    part = chunks.select(F.col("contig").alias("__cc"), F.col("chunk").cast("long").alias("__ck"), "bases")
    lo = F.greatest(F.col("__s") - 1 - F.col("__k") * size, F.lit(0))
    hi = F.least(F.col("__e") - F.col("__k") * size, F.length("bases").cast("long"))
    hit = each.join(part, (F.col("__c") == F.col("__cc")) & (F.col("__k") == F.col("__ck"))).where(hi > lo)
    piece = F.struct("__k", F.substring("bases", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("b"))
    whole = hit.groupBy("__c", "__s", "__e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.b), "").alias("__b"))
    out = ranges.join(whole, (F.col("contig") == F.col("__c")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left")
    found = F.coalesce("__b", F.lit(""))
    if fill is not None:
        width = F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)).cast("int")
        before = F.least(F.greatest(1 - F.col("start"), F.lit(0)).cast("int"), width)
        found = F.concat(F.repeat(F.lit(fill), before), found, F.repeat(F.lit(fill), width - before - F.length(found)))
    return out.select(*ranges.columns, found.alias("bases"))


def flanked(variants: DataFrame, chunks: DataFrame, reach: int = 5, size: int = CHUNK) -> DataFrame:
    """Adds flank to variants (contig, pos, alt) of one base: the alt with ``reach`` reference bases on either side, ``-`` beyond the contig."""
    at = variants.withColumns({"start": F.col("pos") - reach, "end": F.col("pos") + reach})
    got = looked_up(at, chunks, size, "-")
    return got.select(*variants.columns, F.concat(F.left("bases", F.lit(reach)), "alt", F.right("bases", F.lit(reach))).alias("flank"))


def homopolymers(variants: DataFrame, chunks: DataFrame, window: int = 100, size: int = CHUNK) -> DataFrame:
    """Adds homopolymer to variants (contig, pos, ref, alt, kind): the run beside each, looked for within ``window`` bases.

    Indels carry the base before them; the motif is what is inserted or deleted, else the reference bases.
    """
    indel = F.col("kind").isin("INS", "DEL")
    before = F.when(indel, F.col("pos")).otherwise(F.col("pos") - 1)
    end = F.col("pos") + F.length("ref") - 1
    names = variants.columns
    up = looked_up(variants.withColumns({"start": before - (window - 1), "end": before}), chunks, size).withColumnRenamed("bases", "__up")
    both = looked_up(up.withColumns({"start": end + 1, "end": end + window}), chunks, size)
    motif = F.when(F.col("kind") == "INS", F.substring("alt", F.lit(2), F.length("alt"))).when(F.col("kind") == "DEL", F.substring("ref", F.lit(2), F.length("ref"))).otherwise(F.col("ref"))
    return both.select(*names, run_beside(F.col("__up"), F.col("bases"), motif, F.col("kind") == "INS").alias("homopolymer"))


def two_alleles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and alleles: the two bases of counts (base, n, quality) with the most reads, then the best quality, then by name, in that order."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("quality")).alias("q"), F.col("base"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x.base), "/").alias("alleles"))


def largest_variant(counts: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """keys, base, n: the base other than the reference with the most reads, the first by name on ties."""
    other = counts.where(F.col("base") != F.col(reference))
    return other.groupBy(*keys).agg(F.min_by(F.struct("base", "n"), F.struct(-F.col("n"), F.col("base"))).alias("x")).select(*keys, "x.base", "x.n")


def mapping_matrix(reads: DataFrame, dimensions: list[str]) -> DataFrame:
    """mapq, dimension, value, n: mapping quality against each of several dimensions, counted in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")
    return reads.select("mapq", each).groupBy("mapq", "x.dimension", "x.value").agg(F.count("*").alias("n"))


def position_bins(reads: DataFrame, group: str, size: int = 1_000_000) -> DataFrame:
    """group, rname, bin, n, most: read starts by bins of ``size`` positions, and the largest count at one position."""
    at = reads.groupBy(group, "rname", "pos").agg(F.count("*").alias("__n"))
    return at.groupBy(group, "rname", F.floor(F.col("pos") / size).alias("bin")).agg(F.sum("__n").alias("n"), F.max("__n").alias("most"))


def excluded(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The rows whose name is not listed; a null name is on no list."""
    return rows.join(names.select(F.col(name).alias("__x")).where("__x is not null").distinct(), F.col(name) == F.col("__x"), "left_anti")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b) and the rows of two tables of alignments that the other lacks; a row that repeats is matched as often as it occurs."""
    names = a.columns
    both = a.select(*names, F.lit(1).alias("__d")).unionByName(b.select(*names, F.lit(-1).alias("__d")))
    left = both.groupBy(*names).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return left.select(F.when(F.col("__d") > 0, "a").otherwise("b").alias("side"), *names, F.explode(F.sequence(F.lit(1), F.abs("__d"))).alias("__i")).drop("__i")


def merged_calls(control: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """keys, alt, c_gt, t_gt of two callings (alt, gt), joined by position, both sides kept.

    Equal alts stand once. Of different ones the control's come first, and the
    test's allele numbers move up by their count. A missing side has ``./.``.
    """
    c, t = control.select(*keys, F.col("alt").alias("__ca"), F.col("gt").alias("__cg")), test.select(*keys, F.col("alt").alias("__ta"), F.col("gt").alias("__tg"))
    j = c.join(t, keys, "full")
    by = F.size(F.split("__ca", ","))
    moved = F.array_join(F.transform(F.split("__tg", "/"), lambda x: F.when(x.isin("0", "."), x).otherwise((x.cast("int") + by).cast("string"))), "/")
    apart = F.col("__ca").isNotNull() & F.col("__ta").isNotNull() & (F.col("__ca") != F.col("__ta"))
    alt = F.when(apart, F.concat_ws(",", "__ca", "__ta")).otherwise(F.coalesce("__ca", "__ta"))
    return j.select(*keys, alt.alias("alt"), F.coalesce("__cg", F.lit("./.")).alias("c_gt"), F.coalesce(F.when(apart, moved).otherwise(F.col("__tg")), F.lit("./.")).alias("t_gt"))


def classified_positions(positions: DataFrame, calls: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """kinds and n: the calls at listed positions, counted by filter and class; a position listed twice counts once."""
    return calls.join(positions.select(*keys).distinct(), keys, "left_semi").groupBy(*kinds).agg(F.count("*").alias("n"))


def routed(reads: DataFrame, tag: str, known: list[int]) -> DataFrame:
    """Adds route, the integer tag's value, and takes the tag away; a missing or unknown value raises."""
    value = F.col("tags")[tag].try_cast("int")
    bad = F.raise_error(F.concat(F.lit(f"a read without a known {tag}: "), F.col("qname"))).cast("int")
    return reads.withColumns({"route": F.when(value.isin(known), value).otherwise(bad), "tags": F.map_filter("tags", lambda k, _: k != tag)})


def with_read_group(reads: DataFrame, group: str) -> DataFrame:
    """Every read in one read group, whichever it had."""
    return reads.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: k != "RG"), F.create_map(F.lit("RG"), F.lit(group))))


def header_with(head: DataFrame, kind: str, lines: list[str]) -> DataFrame:
    """Header lines (value) with those of one kind (@RG, @SQ) replaced."""
    return head.where(~F.col("value").startswith(f"{kind}\t")).select("value").unionByName(head.sparkSession.createDataFrame([(x,) for x in lines], "value string"))


def without_bases(reads: DataFrame, when: Column | None = None) -> DataFrame:
    """Reads without sequence and qualities, which the format writes as ``*``; only those for which ``when`` holds, if given."""
    cut = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return reads.withColumns({"seq": F.when(~cut, F.col("seq")), "qual": F.when(~cut, F.col("qual"))})


def spanning(reads: DataFrame, positions: DataFrame) -> DataFrame:
    """contig, pos and the mapped reads without duplicates that span each position wholly (rname, pos, end)."""
    from covalens.operators.intervals import Spans, overlap_join

    fit = reads.where(F.col("flag").bitwiseAND(F.lit(0x404)) == 0)
    p = Spans(positions.withColumn("__e", F.col("pos")), "contig", "pos", "__e")
    return overlap_join(p, Spans(fit, "rname", "pos", "end")).select("a.contig", "a.pos", "b.qname", F.col("b.pos").alias("start"), F.col("b.end").alias("end"))


def numbered_orders(df: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """Adds place, the rank of each row within its group by ``order``."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
