"""Texts of annotations: search terms, classes of filters, mismatch tags, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a substitution is written in the literature; the mark of a compound call; filters of class B.
VARIETIES = (">", "->", "-->", "/")
COMPOUND = "COMPOUNDMUTATION"
CLASS_B = ("COVN12", "SAN3", "MIUN", "COVN12; MIUN", "SAN3; MIUN")


def search_term(coding: Column, protein: Column) -> Column:
    """Query for a variant's names in all their spellings; an empty text if neither name says anything.

    Of the coding name the part after the first dot counts if it is a
    substitution (``c.35G>A``), of the protein name the part after the first
    dot or, without one, all of it.
    """
    after = F.regexp_extract(coding, r"(?s)^[^.>]*\.([^>]*)>(.*)$", 1)
    changed = F.regexp_extract(coding, r"(?s)^[^.>]*\.([^>]*)>(.*)$", 2)
    spelt = F.concat_ws("|", *[F.concat(F.lit('"'), after, F.lit(v), changed, F.lit('"')) for v in VARIETIES])
    first = F.when(coding.rlike(r"(?s)^[^.>]*\.[^>]*>"), spelt)
    second = F.when(protein != "", F.concat(F.lit('"'), F.regexp_replace(protein, r"(?s)^[^.]*\.", ""), F.lit('"')))
    inner = F.concat_ws("|", first, second)
    return F.when(inner == "", "").otherwise(F.concat(F.lit('"GENE"+('), inner, F.lit(")")))


def filter_class(annotation: Column) -> Column:
    """A for PASS, B for a filter that only says that the normal sample is thin, else null; the mark of a compound call doesn't count."""
    bare = F.regexp_replace(annotation, f";{COMPOUND}", "")
    return F.when(bare == "PASS", "A").when(bare.isin(*CLASS_B), "B")


def mismatch_tags(reference: Column, read: Column) -> Column:
    """struct(md, nm) of two aligned texts of one length with ``-`` for gaps; null if either is null or the lengths differ.

    md: lengths of equal stretches between the reference's bases where the read
    has others, deleted bases behind ``^``; inserted bases count in nm alone.
    """
    columns = F.zip_with(
        F.regexp_extract_all(F.upper(reference), F.lit("(?s)(.)"), F.lit(1)), F.regexp_extract_all(F.upper(read), F.lit("(?s)(.)"), F.lit(1)),
        lambda a, b: F.when(a == "-", "+").when(b == "-", F.lower(a)).when(a == b, "=").otherwise(a),
    )
    signs = F.array_join(columns, "")
    shown = F.replace(signs, F.lit("+"), F.lit(""))
    runs = F.transform(F.split(shown, "[A-Z]|[a-z]+", -1), lambda s: F.length(s).cast("string"))
    others = F.transform(F.regexp_extract_all(shown, F.lit("([A-Z]|[a-z]+)"), F.lit(1)), lambda s: F.when(s.rlike("^[a-z]"), F.concat(F.lit("^"), F.upper(s))).otherwise(s))
    md = F.array_join(F.zip_with(runs, others, lambda n, o: F.concat(n, F.coalesce(o, F.lit("")))), "")
    nm = F.length(F.replace(signs, F.lit("="), F.lit("")))
    return F.when(F.length(reference) == F.length(read), F.struct(md.alias("md"), nm.alias("nm")))
