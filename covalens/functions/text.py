"""Scalar functions on delimited text, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Null, blank, ``.`` or ``./.``."""
    return c.isNull() | F.trim(c).isin("", ".", "./.", ".|.")


def tokens(c: Column, delimiter: str = "\t") -> Column:
    """All parts; a text without the delimiter is one part."""
    return F.split(c, re.escape(delimiter), -1)


def first_tokens(c: Column, n: int, delimiter: str = "\t", rest: bool = False) -> Column:
    """The first n parts and, with ``rest``, the unsplit remainder as one more."""
    parts = tokens(c, delimiter)
    tail = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(1))), delimiter)
    return F.concat(F.slice(parts, 1, n), F.when(F.size(parts) > n, F.array(tail)).otherwise(F.array().cast("array<string>"))) if rest else F.slice(parts, 1, n)


def value_of(c: Column, key: str, stop: str = "\t") -> Column:
    """What follows ``key=`` up to the next ``stop``; null if the key isn't there."""
    at = F.instr(c, f"{key}=")
    return F.when(at > 0, F.substring_index(F.substring(c, at + len(key) + 1, F.length(c)), stop, 1))


def info_map(c: Column, delimiter: str = ";") -> Column:
    """key=value parts as a map; a key alone maps to an empty text, missing texts to an empty map."""
    parts = F.filter(F.split(F.when(missing(c), "").otherwise(c), re.escape(delimiter)), lambda x: x != "")
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value"))
    # of a repeated key the last value stands
    entries = F.transform(parts, pair)
    keys = F.array_distinct(F.transform(entries, lambda x: x.key))
    last = lambda k: F.element_at(F.filter(entries, lambda x: x.key == k), -1).value
    return F.map_from_arrays(keys, F.transform(keys, last))


def info_text(m: Column, delimiter: str = ";") -> Column:
    """The inverse of ``info_map``, keys in order; ``.`` for an empty map."""
    parts = F.transform(F.array_sort(F.map_entries(m)), lambda x: F.when(x.value == "", x.key).otherwise(F.concat(x.key, F.lit("="), x.value)))
    return F.when(F.size(m) == 0, ".").otherwise(F.array_join(parts, delimiter))


def appended(c: Column, value: Column, delimiter: str = ",") -> Column:
    """``value`` added unless the text has it as a substring; a missing text becomes the value."""
    return F.when(missing(c), value).when(F.contains(c, value), c).otherwise(F.concat(c, F.lit(delimiter), value))


def padded(c: Column, width: int, fill: str = " ", left: bool = True) -> Column:
    """Padded to ``width``; never cut."""
    pad = F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(c), F.lit(0)))
    return F.concat(pad, c) if left else F.concat(c, pad)


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^-?[0-9]+$"), F.lit(False))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def occurrences(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def position(c: Column) -> Column:
    """contig:start-end as struct(contig, start, end); null unless both marks are there."""
    m = lambda i: F.regexp_extract(c, r"^(.+):(\d+)-(\d+)$", i)
    return F.when(c.rlike(r"^.+:\d+-\d+$"), F.struct(m(1).alias("contig"), m(2).cast("long").alias("start"), m(3).cast("long").alias("end")))


def contig_rank(c: Column) -> Column:
    """A sort key for contig names: numbers first by value, then X, Y, M, then the others by name."""
    bare = F.regexp_replace(F.lower(c), "^chr", "")
    n = bare.try_cast("int")
    special = F.when(bare == "x", 1000).when(bare == "y", 1001).when(bare.isin("m", "mt"), 1002)
    return F.struct(F.coalesce(n, special, F.lit(1003)).alias("rank"), c.alias("name"))


def with_prefix(c: Column) -> Column:
    """chr-prefixed contig names; MT becomes chrM."""
    bare = F.regexp_replace(c, "^chr", "")
    return F.concat(F.lit("chr"), F.when(F.upper(bare) == "MT", "M").otherwise(bare))


def without_prefix(c: Column) -> Column:
    bare = F.regexp_replace(c, "^chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)
