"""The record filter language: a boolean expression over fields, compiled to one Column.

    expression := condition | (and|or) '(' expression (',' expression)+ ')'
    condition  := field comparator value

Comparators: >= <= > < == != and, with case-insensitive wildcards, =~ and !~.
There is no negation. Values hold no quotes, backslashes or minus signs.
The compiled Column is never null, so it can be negated for the rejected rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(>=|<=|==|!=|=~|!~|>|<)|([(),])|([A-Za-z0-9_.:*/+|#@%$]+))")

#: Fixed values of the read format: flag bits.
FLAGS = {
    "readpaired": 0x1, "properpair": 0x2, "readunmapped": 0x4, "mateunmapped": 0x8, "readnegativestrand": 0x10, "matenegativestrand": 0x20,
    "firstofpair": 0x40, "secondofpair": 0x80, "notprimaryalignment": 0x100, "failsvendorqualitycheck": 0x200, "readfailsvendorquality": 0x200, "duplicateread": 0x400, "supplementaryread": 0x800,
}
#: Flags that mean something for paired reads only.
_OF_PAIRS = 0x2 | 0x8 | 0x20 | 0x40 | 0x80

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


class FilterError(ValueError):
    """The expression isn't in the language."""


def parse(text: str) -> tuple:
    """('and'|'or', [nodes]) or ('is', field, comparator, value)."""
    if not text or not text.strip():
        raise FilterError("empty filter")
    if re.search(r"[\"'\\]", text):
        raise FilterError("quotes and backslashes are not allowed")
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at:].strip()[:10]!r}")
        tokens.append(next(x for x in m.groups() if x))
        at = m.end()
    node, rest = _expression(tokens)
    if rest:
        raise FilterError(f"unexpected {rest[0]!r}")
    return node


def _expression(tokens: list[str]) -> tuple[tuple, list[str]]:
    if not tokens:
        raise FilterError("unexpected end")
    if tokens[0].lower() in ("and", "or") and tokens[1:2] == ["("]:
        kind, parts, rest = tokens[0].lower(), [], [",", *tokens[2:]]
        while rest[:1] == [","]:
            node, rest = _expression(rest[1:])
            parts.append(node)
        if rest[:1] != [")"]:
            raise FilterError("a closing bracket is missing")
        if len(parts) < 2:
            raise FilterError(f"{kind} takes two operands at least")
        return (kind, parts), rest[1:]
    if len(tokens) < 3 or tokens[1] not in (*_COMPARE, "=~", "!~"):
        raise FilterError(f"no condition at {tokens[0]!r}")
    return ("is", tokens[0], tokens[1], tokens[2]), tokens[3:]


def _wild(column: Column, comparator: str, value: str) -> Column:
    if value.count("*") > 1:
        raise FilterError("one star at most")
    c, v = F.lower(column.cast("string")), value.lower().replace("*", "")
    hit = c.endswith(v) if value.startswith("*") else c.startswith(v) if value.endswith("*") else c.contains(v)
    if "*" in value[1:-1]:
        raise FilterError("a star stands at an end")
    return hit if comparator == "=~" else ~hit


def _number(column: Column, comparator: str, value: str, kind: str) -> Column:
    if comparator in ("=~", "!~"):
        return _wild(column, comparator, value)
    try:
        literal = int(value) if kind == "long" else float(value)
    except ValueError:
        raise FilterError(f"{value!r} is no number") from None
    return _COMPARE[comparator](column.cast(kind), F.lit(literal))


def _text(column: Column, comparator: str, value: str) -> Column:
    if comparator in ("=~", "!~"):
        return _wild(column, comparator, value)
    if comparator in ("==", "!="):
        return _COMPARE[comparator](F.lower(column.cast("string")), F.lit(value.lower()))
    return _number(column.cast("string").try_cast("int"), comparator, value, "long")


def _flag(column: Column, name: str, comparator: str, value: str) -> Column:
    if name not in FLAGS:
        raise FilterError(f"unknown flag {name!r}")
    if comparator not in ("==", "!=") or value.lower() not in ("true", "false", "0", "1"):
        raise FilterError("a flag is == or != true or false")
    bit = FLAGS[name]
    is_set = column.bitwiseAND(F.lit(bit)) != 0
    if bit & _OF_PAIRS:
        is_set = is_set & (column.bitwiseAND(F.lit(1)) != 0)
    return is_set if (value.lower() in ("true", "1")) == (comparator == "==") else ~is_set


def _sum_of(cigar: Column, op: str) -> Column:
    """Total length of one operator in a CIGAR string."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def read_field(key: str, comparator: str, value: str) -> Column:
    """A condition on a read with the columns of the read source; unknown fields raise."""
    head, _, tail = key.partition("_")
    head, low = head.lower(), tail.lower()
    if not tail and head in ("mapq", "pos", "isize"):
        return _number(F.col("tlen" if head == "isize" else head), comparator, value, "long")
    if not tail and head in ("rname", "mrnm"):
        if comparator not in ("==", "!=", "=~", "!~"):
            raise FilterError("names are compared for equality only")
        own, other = ("rname", "rnext") if head == "rname" else ("rnext", "rname")
        mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
        columns = {"rname": F.col("rname"), "rnext": mate}
        if value.lower() == ("mrnm" if head == "rname" else "rname") and comparator in ("==", "!="):
            return _COMPARE[comparator](F.lower(columns[own]), F.lower(columns[other]))
        return _text(columns[own], comparator, value)
    if head == "cigar" and tail.upper() in tuple("MIDNSHP"):
        return _number(_sum_of(F.col("cigar"), tail.upper()), comparator, value, "long")
    if head == "md" and low == "mismatch":
        md = F.regexp_replace(F.col("tags")["MD"], r"\^[A-Za-z]+", "")
        return _number(F.length(F.regexp_replace(md, r"[^A-Za-z]", "")), comparator, value, "long")
    if head == "option" and tail:
        column = F.col("tags")[tail]
        is_number = re.fullmatch(r"\d+(\.\d+)?", value) and comparator not in ("=~", "!~")
        return _number(column.try_cast("double"), comparator, value, "double") if is_number else _text(column, comparator, value)
    if head == "flag" and tail:
        return _flag(F.col("flag"), low, comparator, value)
    if head == "qual" and low == "average":
        n = F.length("qual")
        codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
        return _number(F.when(n > 0, F.floor(F.aggregate(codes, F.lit(0), lambda acc, x: acc + x) / n)), comparator, value, "long")
    if head == "seq" and low == "numbern":
        return _number(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("N"), F.lit(""))), comparator, value, "long")
    raise FilterError(f"unknown field {key!r}")


def table_field(schema: T.StructType) -> Callable[[str, str, str], Column]:
    """Conditions on the columns of any table: numbers compare as numbers, all else as text."""
    kinds = {f.name.lower(): f for f in schema.fields}

    def field(key: str, comparator: str, value: str) -> Column:
        if key.lower() not in kinds:
            raise FilterError(f"unknown field {key!r}")
        f = kinds[key.lower()]
        if isinstance(f.dataType, T.IntegralType):
            return _number(F.col(f.name), comparator, value, "double" if "." in value else "long")
        if isinstance(f.dataType, T.NumericType):
            return _number(F.col(f.name), comparator, value, "double")
        return _text(F.col(f.name), comparator, value)

    return field


def compiled(text: str, field: Callable[[str, str, str], Column] = read_field) -> Column:
    """The filter as a Column: true keeps the row. A missing value fails every comparison, != and !~ too."""

    def build(node: tuple) -> Column:
        if node[0] == "is":
            return F.coalesce(field(*node[1:]), F.lit(False))
        parts = [build(x) for x in node[1]]
        return reduce((lambda a, b: a & b) if node[0] == "and" else (lambda a, b: a | b), parts)

    return build(parse(text))


def kept(df: DataFrame, text: str, reads: bool = False) -> DataFrame:
    return df.where(compiled(text, read_field if reads else table_field(df.schema)))


def split(df: DataFrame, text: str, reads: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those that don't."""
    passes = compiled(text, read_field if reads else table_field(df.schema))
    return df.where(passes), df.where(~passes)


def valid_for_calling(reads: DataFrame, include_duplicates: bool = False) -> DataFrame:
    """Mapped, primary reads that pass quality checks and, unless included, are no duplicates."""
    mask = 0x4 | 0x100 | 0x200 | 0x800 | (0 if include_duplicates else 0x400)
    return reads.where(F.col("flag").bitwiseAND(F.lit(mask)) == 0)
