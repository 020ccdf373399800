"""Winnowing fingerprints (Schleimer and others, 2003) over word k-grams.

Of each ``w`` successive k-gram hashes the least is chosen, the rightmost of
equal ones; any passage of w + k - 1 words that two texts share then gives them
a common fingerprint. Each word is hashed once. A k-gram's hash is the rolling
one of Karp and Rabin, the sum of word x BASE^place modulo PRIME; it is put
together from the hashes of shorter grams, so all grams take log2(k) passes, and
the window's minimum log2(w) passes over (hash, position) packed in one long.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covalens.llm import common

PRIME = (1 << 31) - 1
BASE = 1_000_003
_POS = (1 << 30) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def word_hashes(text: Column) -> Column:
    """A number below PRIME for each word."""
    return F.transform(_words(text), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))


def _appended(a: str, b: str, skip: int, words: int) -> Column:
    """Hashes of grams of ``a``, each followed by the gram of so many ``words`` in ``b`` that begins ``skip`` places on; null beyond the end."""
    scale = pow(BASE, words, PRIME)
    return F.zip_with(a, F.slice(b, skip + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: (x * scale + y) % PRIME)


def _with_grams(df: DataFrame, column: str, k: int) -> DataFrame:
    """Turns word hashes into hashes of ``k`` successive words; fewer words make one gram, none make none."""
    words, power = f"{column}_words", f"{column}_power"
    df = df.withColumn(words, F.col(column)).withColumn(power, F.col(column))
    have, step = 0, 1
    while have < k:
        if k & step:
            df = df.withColumn(column, _appended(column, power, have, step) if have else F.col(power))
            have += step
        if have < k:
            df = df.withColumn(power, _appended(power, power, step, step))
            step *= 2
    n = F.size(words)
    short = F.aggregate(words, F.lit(0).cast("long"), lambda at, x: (at * BASE + x) % PRIME)
    whole = F.when(n >= k, F.slice(column, F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).when(n > 0, F.array(short)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(column, whole).drop(words, power)


def _least(packed: Column, n: Column, step: int) -> Column:
    return F.zip_with(packed, F.slice(packed, step + 1, F.greatest(n, F.lit(1))), lambda a, b: F.least(a, b))


def winnowed(df: DataFrame, text: str, out: str, k: int = 5, w: int = 4) -> DataFrame:
    """Adds ``out``: array of struct(hash, pos), the chosen k-grams by position; empty for null and wordless texts.

    pos counts k-grams from 0. Fewer than ``w`` k-grams form one window, fewer than ``k`` words one k-gram.
    """
    g, v = f"{out}_g", f"{out}_v"
    df = _with_grams(df.withColumn(g, word_hashes(F.coalesce(F.col(text), F.lit("")))), g, k)
    # hash above, position below: the least has the least hash, and of equal ones the last position
    df = df.withColumn(v, F.transform(g, lambda x, i: F.shiftleft(x, 30).bitwiseOR(F.lit(_POS) - i)))
    have = 1
    while have < w:
        step = min(have, w - have)
        df = df.withColumn(v, _least(F.col(v), F.size(g), step))
        have += step
    chosen = F.array_distinct(F.slice(v, 1, F.greatest(F.size(g) - (w - 1), F.lit(1))))
    at = lambda x: (F.lit(_POS) - x.bitwiseAND(F.lit(_POS))).cast("int")
    df = df.withColumn(out, F.transform(F.transform(chosen, at), lambda p: F.struct(F.get(g, p).alias("hash"), p.alias("pos"))))
    return df.drop(g, v)


def digest(chosen: str) -> Column:
    """SHA-256 of the chosen hashes and their positions."""
    return F.sha2(F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", F.hex(x.hash), x.pos)), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes; 1 if both are empty."""
    common_ = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common_
    return F.when(total == 0, F.lit(1.0)).otherwise(common_ / total)


#: Sub-blocks are numbered below this within the block of one bound.
_SUBS = 1 << 20


def _folded(values: list[int]) -> Column:
    """An array of longs, written as one string that is folded into one literal; thousands of literals would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _block(rows: DataFrame, blocks: int) -> Column:
    """The range of (__key, __mark) that a row lies in, counted up with the key; no key, null ids included, has more than some shares of one.

    Bounds are quantiles of the keys. A key that is several quantiles has as many
    shares of the rows, and is dealt further by the upper bits of its mark.
    """
    q = rows.agg(F.percentile_approx("__key", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0]
    times = Counter(q or [])
    bounds = sorted(times)
    if not bounds:
        return F.lit(0).cast("long")
    table = _folded(bounds)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    # how many bounds lie below the key, found by halving
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + (step - 1)) < F.col("__key")), at + step).otherwise(at))
    block = below.cast("long") * _SUBS
    hot = {key: n + 1 for key, n in times.items() if n > 1}
    if hot:
        parts = F.get(_folded(list(hot.values())), F.array_position(_folded(list(hot)), F.col("__key")).cast("int") - 1)
        # the hot key is the largest of its block; the upper 32 bits of the mark tell the part
        block += F.coalesce(1 + F.shiftright((F.shiftright("__mark", 32) + (1 << 31)) * parts, 32), F.lit(0))
    return block


def ranged(docs: DataFrame) -> tuple[DataFrame, W]:
    """Rows (doc_id, text, copy) by descending doc_id in ranges, and the window over a range.

    No task gets all rows, and no key, null included, all of its rows in one.
    Each range ends with a copy of the next range's first row; the last range's
    is the first row of all. A null doc_id comes last; rows that repeat a doc_id
    follow each other by descending hash of the text, then by text.
    """
    spark = docs.sparkSession
    key, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")
    rows = docs.withColumns({"__key": key, "__mark": mark})
    rows = rows.withColumn("__block", _block(rows.select("__key", "__mark"), 4 * common.partitions(spark)))
    # keys, not texts, say which row heads a range; there are few ranges
    heads = rows.groupBy("__block").agg(F.max(F.struct("__key", "__mark")).alias("head"))
    ring = W.orderBy(F.desc("__block"))
    before = F.coalesce(F.lag("__block").over(ring), F.min("__block").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = common.stored(heads.select("head", before.alias("before")), "heads")
    first = heads.select(F.col("head.__key").alias("__k"), F.col("head.__mark").alias("__m"), "before")
    copies = docs.select(key.alias("__k"), mark.alias("__m"), "text").join(F.broadcast(first), ["__k", "__m"])
    copies = copies.groupBy("before").agg(F.max("text").alias("text"))  # of rows with one key and mark the first
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(-(1 << 63)).alias("__key"), F.lit(-(1 << 63)).alias("__mark"), F.col("before").alias("__block"), F.lit(True).alias("copy"))
    every = rows.select("doc_id", "text", "__key", "__mark", "__block", F.lit(False).alias("copy")).unionByName(copies)
    order = ["copy", F.desc("__key"), F.desc("__mark"), F.desc("text")]
    dealt = every.repartition(common.partitions(spark), "__block").sortWithinPartitions("__block", *order)
    return dealt, W.partitionBy("__block").orderBy(*order)


def edited(text: Column, following: Column) -> Column:
    """The text with its last third of code points replaced by the first as many, or all, of the following one."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprinted(docs: DataFrame, k: int = 5, w: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Takes doc_id and text; other columns are ignored. Null texts are empty.
    fingerprint is the SHA-256 of the chosen hashes and positions, so equal
    texts (up to case and the width of white space) have equal ones; texts
    without words share one, and are alike to degree 1. The edited text is
    described at ``edited``; the order of rows at ``ranged``. A single row is
    its own next. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, window = ranged(own)
    rows = winnowed(rows, "text", "f", k, w).withColumn("next", F.lead(F.struct("text", F.col("f.hash").alias("hash"))).over(window)).where(~F.col("copy"))
    df = rows.select("doc_id", "text", "f", F.col("next.hash").alias("next_hash"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    df = winnowed(df, "edited", "fe", k, w)
    return df.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest("f").alias("fingerprint"), digest("fe").alias("edited_fingerprint"), likeness(F.col("f.hash"), F.col("fe.hash")).alias("near_edited"), likeness(F.col("f.hash"), F.col("next_hash")).alias("near_next"))
