"""Scalar functions on packed numbers, coverage texts, verdicts of variant records, and the sequence beside a variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place_of(values: Column, wanted: Column, ignore_case: bool = False) -> Column:
    """0-based place of a text in an array; -1 if it isn't there."""
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    return F.array_position(F.transform(values, low), low(wanted)).cast("int") - 1


def picked(values: Column, places: Column) -> Column:
    """The elements at 0-based places, in the order of the places; a place beyond the array raises."""
    beyond = F.raise_error(F.lit("a place lies beyond the array")).cast("string")
    return F.transform(places, lambda i: F.when(i < F.size(values), F.get(values, i)).otherwise(beyond))


def packed_shorts(high: Column, low: Column) -> Column:
    """Two signed shorts in one int."""
    return F.shiftleft(high.cast("int"), 16).bitwiseOR(low.cast("int").bitwiseAND(F.lit(0xFFFF)))


def unpacked_shorts(packed: Column) -> Column:
    """struct(high, low) of ``packed_shorts``."""
    low = packed.bitwiseAND(F.lit(0xFFFF))
    return F.struct(F.shiftright(packed, 16).alias("high"), F.when(low >= 0x8000, low - 0x10000).otherwise(low).alias("low"))


def bit_added(number: Column, bit: int) -> Column:
    """The number with a bit added: added twice it carries over into the next one."""
    return number + F.lit(1 << bit).cast("long")


def bit_taken(number: Column, bit: int) -> Column:
    return number - F.lit(1 << bit).cast("long")


def bit_set(number: Column, bit: int) -> Column:
    return F.shiftright(number.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")) == 1


#: What a distribution with a count over 16 bits is coded as.
OVERFLOW = -(1 << 63)


def packed_counts(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Four unsigned counts of 16 bits in one long, A highest; OVERFLOW if one is too large."""
    over = F.greatest(a, c, g, t) > 0xFFFF
    parts = F.shiftleft(a.cast("long"), 48).bitwiseOR(F.shiftleft(c.cast("long"), 32)).bitwiseOR(F.shiftleft(g.cast("long"), 16)).bitwiseOR(t.cast("long"))
    return F.when(over, F.lit(OVERFLOW)).otherwise(parts)


def unpacked_counts(packed: Column) -> Column:
    """Array of the four counts."""
    return F.array(*[F.shiftright(packed, by).bitwiseAND(F.lit(0xFFFF)) for by in (48, 32, 16, 0)])


def coverage_counts(coverage: Column) -> Column:
    """struct(a, c, g, t, total) of a text such as ``A:1,C:2,G:0,T:9,TOTAL:12``; bases that it doesn't name are 0."""
    at = lambda key: F.coalesce(F.nullif(F.regexp_extract(coverage, rf"(?:^|,){key}:(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(*[at(key).alias(key.lower()) for key in ("A", "C", "G", "T", "TOTAL")])


def dashed_counts(coverage: Column) -> Column:
    """Array of four counts of ``a-c-g-t``; null if the text is anything else."""
    return F.when(coverage.rlike(r"^\d+-\d+-\d+-\d+$"), F.split(coverage, "-").cast("array<int>"))


def split_depths(alts: Column, depths: Column) -> Column:
    """``ref,alt`` depths for each of several comma-joined alts, of the depths of ref and all alts."""
    d = F.split(depths, ",")
    return F.transform(F.split(alts, ","), lambda x, i: F.concat_ws(",", F.get(d, F.lit(0)), F.get(d, i + 1)))


def record_passes(filters: Column, somatic: Column) -> Column:
    """Whether a record with one filter a sample passes: none PASS, no; all, yes; else only a germline one with PASS at every even place."""
    even = F.filter(filters, lambda _, i: i % 2 == 0)
    return F.when(~F.array_contains(filters, "PASS"), False).when(F.forall(filters, lambda x: x == "PASS"), True).otherwise(~somatic & F.forall(even, lambda x: x == "PASS"))


def is_somatic(info: Column, marks: Column, callers: Column) -> Column:
    """Whether INFO says SOMATIC, or as many samples do as there are callers; with unknown callers, half of the samples."""
    n = F.size(F.filter(marks, lambda x: F.contains(x, F.lit("SOMATIC"))))
    return F.contains(info, F.lit("SOMATIC")) | F.when(callers.isNull(), n * 2 >= F.size(marks)).otherwise(n >= callers)


def indel_confidence(filters: Column, nearby: Column, homopolymer: Column, strong: Column, somatic: Column, most_nearby: float = 0.1, longest: int = 6, least_strong: float = 0.2) -> Column:
    """HIGH for PASS with few nearby indels, a short run beside it and enough strong support (which a somatic call
    always has); ZERO for extreme coverage or a repeat; else LOW."""
    enough = F.when(somatic, F.lit(1.0)).otherwise(strong) >= least_strong
    has = lambda x: F.contains(filters, F.lit(x))
    high = (filters == "PASS") & (nearby <= most_nearby) & (homopolymer <= longest) & enough
    return F.when(high, "HIGH").when(has("HCOVN") | has("HCOVT") | has("REPEAT"), "ZERO").otherwise("LOW")


def cigar_key(element: Column) -> Column:
    """Sort key of one CIGAR element such as ``12M``: its operator, then its length; shorter texts raise."""
    short = F.raise_error(F.concat(F.lit("no CIGAR element: "), element)).cast("string")
    return F.when(F.length(element) >= 2, F.struct(F.right(element, F.lit(1)).alias("op"), F.regexp_extract(element, r"(\d+)", 1).cast("int").alias("n"))).otherwise(F.struct(short.alias("op"), F.lit(0).alias("n")))


def run_beside(before: Column, after: Column, motif: Column, inserted: Column) -> Column:
    """Length of the homopolymer next to a variant with the reference bases ``before`` and ``after`` it; 0 for a single base.

    The runs on both sides count apart; an insertion joins them if their bases
    are equal. Otherwise the variant's own bases (``motif``) lengthen a run as
    far as they continue it, and one that fills the whole gap joins the runs. A
    side without bases counts as a run of one.
    """
    tail = lambda c: F.length(F.regexp_extract(c, r"(.)\1*$", 0))
    head = lambda c: F.length(F.regexp_extract(c, r"^(.)\1*", 0))
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    up, down = F.greatest(tail(before), F.lit(1)), F.greatest(head(after), F.lit(1))
    left = F.when(last == "", 0).otherwise(head(F.concat(last, motif)) - 1)
    right = F.when(first == "", 0).otherwise(tail(F.concat(motif, first)) - 1)
    filled = (left == F.length(motif)) & (right == F.length(motif))
    own = F.when(filled, up + down + F.length(motif)).otherwise(F.greatest(up + left, down + right))
    joined = F.when((last == first) & (last != ""), up + down).otherwise(F.greatest(up, down))
    most = F.when(inserted, joined).otherwise(own)
    return F.when(most == 1, 0).otherwise(most)
