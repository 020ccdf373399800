"""Scalar functions on sequences, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and the bases they stand for.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def alleles_of(code: Column) -> Column:
    """The bases of a code: itself for A, C, G, T, two to four for an IUPAC code, null for others."""
    out = F.when(code.isin("A", "C", "G", "T"), F.array(code))
    for key, bases in IUPAC.items():
        out = out.when(code == key, F.array(*map(F.lit, bases)))
    return out


def kmers(seq: Column, k: int) -> Column:
    """All substrings of k characters in order; none of a shorter text."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def tile_code(seq: Column) -> Column:
    """Base-4 number of a short sequence, the first base least significant; -1 if any base isn't A, C, G or T."""
    codes = F.transform(F.split(seq, ""), lambda b: F.instr(F.lit("ACGT"), b) - 1)
    value = F.aggregate(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), F.lit(0).cast("long"), lambda acc, x: acc + x.c.cast("long") * F.pow(F.lit(4.0), x.i).cast("long"))
    return F.when((F.length(seq) == 0) | F.exists(codes, lambda c: c < 0), F.lit(-1).cast("long")).otherwise(value)


def from_tile_code(code: Column, k: int) -> Column:
    return F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)])


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two texts of one length above 0, else null."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x))


def edit_to_primer(read: Column, primer: Column, limit: int | None = None) -> Column:
    """Levenshtein distance of the read's first len(primer) bases to the primer; beyond ``limit`` the largest int."""
    d = F.levenshtein(F.substring(read, F.lit(1), F.length(primer)), primer)
    return d if limit is None else F.when(d <= limit, d).otherwise(F.lit(2**31 - 1))


def common_prefix_length(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def longest_run(seq: Column, base: Column) -> Column:
    """Length of the longest run of one character."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.concat(F.lit("("), base, F.lit("+)")), F.lit(1)), lambda x: F.length(x))), F.lit(0))


def block_counts(seq: Column, base: str) -> Column:
    """struct(blocks, total): runs of one character and their characters."""
    runs = F.regexp_extract_all(seq, F.lit(f"({base}+)"), F.lit(1))
    return F.struct(F.size(runs).alias("blocks"), F.aggregate(runs, F.lit(0), lambda acc, x: acc + F.length(x)).alias("total"))


def complexity(seq: Column) -> Column:
    """How many of A, C, G, T a sequence has."""
    return sum((F.contains(F.upper(seq), F.lit(b)).cast("int") for b in "ACGT"), F.lit(0))


def shifted_qualities(qual: Column, by: int) -> Column:
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.char(F.ascii(c) + by)), "")


def merged_pair(first: Column, second: Column, seed: int = 10) -> Column:
    """Two reads joined where the last ``seed`` bases of one are found in the other; null if they aren't."""

    def onto(a, b):
        at = F.instr(b, F.substring(a, F.greatest(F.length(a) - (seed - 1), F.lit(1)), F.lit(seed)))
        return F.when((at > 0) & (F.length(a) >= seed), F.concat(a, F.substring(b, at + seed, F.length(b))))

    return F.coalesce(onto(first, second), onto(second, first))
