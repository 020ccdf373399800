"""Scalar functions on variants and genotypes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covalens.functions.text import missing


def variant_type(ref: Column, alts: Column) -> Column:
    """SNP, DNP, TNP or ONP for equal lengths, INS for a ref of one base, DEL for an alt of one, CTX below 200, else UNKNOWN."""
    alt = F.split(alts, ",")
    lens = F.array_distinct(F.transform(alt, lambda x: F.length(x)))
    n, r = F.get(lens, F.lit(0)), F.length(ref)
    same = F.when(r == 1, "SNP").when(r == 2, "DNP").when(r == 3, "TNP").otherwise("ONP")
    return F.when(F.size(lens) != 1, "UNKNOWN").when((r >= 200) | (n >= 200), "UNKNOWN").when(n == r, same).when(r == 1, "INS").when(n == 1, "DEL").otherwise("CTX")


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def substitution(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.lit(">"), F.upper(alt))


def indel_motif(kind: Column, ref: Column, alt: Column) -> Column:
    return F.when(kind == "INS", F.substring(alt, F.lit(2), F.length(alt))).when(kind == "DEL", F.substring(ref, F.lit(2), F.length(ref))).when(kind == "UNKNOWN", None).otherwise(ref)


def genotype(a: Column, b: Column) -> Column:
    """An unordered allele pair, as the sorted pair joined by a slash."""
    return F.array_join(F.array_sort(F.array(a, b)), "/")


def same_genotype(a: Column, b: Column) -> Column:
    tidy = lambda c: F.array_sort(F.split(F.replace(c, F.lit("|"), F.lit("/")), "/"))
    return tidy(a) == tidy(b)


def gt_index(allele: Column, alts: Column, ref: Column) -> Column:
    """Index of an allele in ref, alt 1, alt 2 ...; null if it is none of them."""
    at = F.array_position(F.concat(F.array(ref), F.split(alts, ",")), allele) - 1
    return F.when(at >= 0, at)


def coded_genotype(a: Column, c: Column, g: Column, t: Column, coverage: int = 10) -> Column:
    """Genotype of base counts: a base above 0.9 of all is homozygous (the first in A, C, G, T order), else those
    strictly between 0.3 and 0.7 make it, if they are two; null below the coverage or otherwise."""
    total = a + c + g + t
    share = lambda x: (x / total).cast("float")
    hom = F.when(share(a) > F.lit(0.9).cast("float"), "AA").when(share(c) > F.lit(0.9).cast("float"), "CC").when(share(g) > F.lit(0.9).cast("float"), "GG").when(share(t) > F.lit(0.9).cast("float"), "TT")
    lo, hi = F.lit(0.3).cast("float"), F.lit(0.7).cast("float")
    het = F.concat(*[F.when((share(x) > lo) & (share(x) < hi), name).otherwise("") for x, name in ((a, "A"), (c, "C"), (g, "G"), (t, "T"))])
    return F.when(total < coverage, None).otherwise(F.coalesce(hom, F.when(F.length(het) == 2, het)))


def classified(control: Column, test: Column, ref: Column) -> Column:
    """GERMLINE if both have the same genotype or the test's alleles are all in the control; SOMATIC if the test has an
    allele that neither control nor reference has; UNKNOWN if a genotype is missing; else GERMLINE."""
    alleles = lambda g: F.split(F.replace(g, F.lit("|"), F.lit("/")), "/")
    new = F.array_except(alleles(test), F.concat(alleles(control), F.array(ref)))
    return F.when(missing(control) | missing(test), "UNKNOWN").when(F.size(new) > 0, "SOMATIC").otherwise("GERMLINE")


def mutation_in_normal(alt: Column, total: Column, least: int, percent: float) -> Column:
    """Whether the normal sample carries the mutation: alt reads reach ``least`` and ``percent`` of the total (in float)."""
    need = F.greatest(F.lit(float(least)).cast("float"), (total.cast("float") / 100 * percent).cast("float"))
    return F.when((alt == 0) | (alt < least), False).otherwise(alt.cast("float") >= need)


def vaf_percent(alt: Column, total: Column) -> Column:
    """Variant allele share in whole percent, cut off; null without coverage."""
    return F.when(total > 0, F.floor(alt * 100 / total).cast("int"))


def passes_rule(count: Column, coverage: Column, bound: Column, needed: Column, second: bool = False) -> Column:
    """A rule with an upper coverage bound needs a count, one without a percentage; a second pass halves the percentage."""
    percent = needed / 2 if second else needed
    return F.when(bound.isNull(), count * 100 / coverage >= percent).otherwise(count >= needed)


def strand_bias(forward: Column, reverse: Column, percent: float, strict: bool = True) -> Column:
    """Whether both strands are present, and the rarer one makes more than (not ``strict``: at least) ``percent``."""
    share = F.least(forward, reverse) * 100 / (forward + reverse)
    return (forward > 0) & (reverse > 0) & ((share > percent) if strict else (share >= percent))


def observed_alleles(oabs: Column) -> Column:
    """base -> reads of a text such as ``A10[30]5[30];C0[0]2[25]``."""
    parts = F.filter(F.split(oabs, ";"), lambda x: x.rlike(r"^[A-Z]\d+\[[^\]]*\]\d+\["))
    entry = lambda x: F.struct(F.substring(x, 1, 1).alias("key"), (F.regexp_extract(x, r"^[A-Z](\d+)\[", 1).cast("int") + F.regexp_extract(x, r"\](\d+)\[", 1).cast("int")).alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def allele_depths(ref: Column, alts: Column, counts: Column) -> Column:
    """Reads of ref and of each alt, comma-joined; 0 if missing."""
    return F.array_join(F.transform(F.concat(F.array(ref), F.split(alts, ",")), lambda x: F.coalesce(counts[x], F.lit(0)).cast("string")), ",")


def confidence(kind: Column, novel_starts: Column, alt_reads: Column, passes: Column, high: tuple[int, int] = (4, 5), low: tuple[int, int] = (4, 4)) -> Column:
    """HIGH, LOW or ZERO by filter verdict, novel starts and variant reads."""
    at = lambda t: (novel_starts >= t[0]) & (alt_reads >= t[1])
    return F.when(passes & at(high), "HIGH").when(passes & at(low), "LOW").otherwise("ZERO")


def split_compound(pos: Column, ref: Column, alt: Column) -> Column:
    """A substitution of n bases as n structs(pos, ref, alt)."""
    return F.transform(F.sequence(F.lit(0), F.length(ref) - 1), lambda i: F.struct((pos + i).alias("pos"), F.substring(ref, i + 1, F.lit(1)).alias("ref"), F.substring(alt, i + 1, F.lit(1)).alias("alt")))


def mutation_class(control: Column, test: Column) -> Column:
    """Code of a control and a test genotype (numbers like 0/1; ``.`` or ``./.`` if missing).

    The tens tell the control: none 0, reference 10, one alt 20, two equal alts
    30, two different 40. The ones tell the test and which alts it shares:

    ====================  ==  ==  ======  ======  =============
    test                  0   10  20      30      40
    ====================  ==  ==  ======  ======  =============
    missing               1   11  21      31      41
    reference             2   12  22      32      42
    one alt               3   13  23, 26  33, 38  43, 44, 49
    two equal alts        4   14  24, 27  34, 37  45, 46, 50
    two different alts    5   15  25, 28  35, 36  47, 51, 48
    ====================  ==  ==  ======  ======  =============

    Of two codes the first is for a shared alt; of three, the first is for the
    control's first alt, the second for its other one; of the last three, for
    equal genotypes, one shared alt, and none. 99 is the same two alts in another
    order. Texts that are no genotype give null.
    """
    pair = lambda g: F.transform(F.split(g, "[/|]"), lambda x: x.try_cast("int"))
    c, t = pair(control), pair(test)
    c0, c1, t0, t1 = F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(t, F.lit(0)), F.get(t, F.lit(1))
    none = lambda g: g.isin(".", "./.", ".|.")
    tens = F.when(none(control), 0).when((c0 == 0) & (c1 == 0), 10).when((c0 == 0) | (c1 == 0), 20).when(c0 == c1, 30).when(c0 != c1, 40)
    kind = F.when(none(test), 1).when((t0 == 0) & (t1 == 0), 2).when((t0 == 0) | (t1 == 0), 3).when(t0 == t1, 4).when(t0 != t1, 5)
    alt = F.greatest(t0, t1)
    held = lambda x: ((x == c0) | (x == c1)) & (x != 0)
    shared = held(t0).cast("int") + held(t1).cast("int")
    by_two = F.when(kind == 3, F.when(alt == c0, 43).when(alt == c1, 44).otherwise(49)).when(kind == 4, F.when(t0 == c0, 45).when(t0 == c1, 46).otherwise(50)).when(control == test, 47).when(shared == 0, 48).when(shared == 1, 51).otherwise(99)
    by_one = F.when(shared > 0, tens + kind).otherwise(F.when(tens == 20, 23 + kind).otherwise(41 - kind))
    return F.when((kind <= 2) | (tens <= 10), tens + kind).when(tens == 40, by_two).otherwise(by_one).cast("int")
