"""Benchmark decontamination: MinHash containment search for short items in long documents.

Items are partitioned by their number n of distinct word shingles into classes of
doubling sizes. A document that holds t = ceil(threshold x n) of them lacks at most
n - t, so it holds r of any n - t + r. An item's sketch is its bottom MinHash of that
length, and r, how many of it must be met, grows with the size class: one shingle that
many documents share makes no candidate of a large item. Documents are far longer
than items, so their side of the search is the stream of their shingles' hashes; only
sketches meet it. The pairs so found, and no others, are verified by exact
containment, in which the shingles' words are compared and each shingle counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covalens.llm import common

#: A side is broadcast up to this many bytes; they are counted first.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    found = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(found, "")


def _shingle_hashes(hashed: Column, k: int) -> Column:
    """A hash for each ``k`` successive word hashes; one of all words if fewer; none of none."""
    n = F.size(hashed)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*[F.get(hashed, i + (j - 1)) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))


def _shingled(df: DataFrame, k: int, *keep: Column) -> DataFrame:
    hashed = df.select(*keep, words(F.col("text")).alias("__w")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    return hashed.withColumn("__s", _shingle_hashes(F.col("__h"), k)).drop("__h")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) of each item that a document contains.

    Containment is the share of the item's distinct shingles of ``k`` words
    (runs of letters and digits, lower-cased) that the document has; a text of
    fewer words is one shingle, and a text of none contains nothing and is
    contained nowhere. Other columns are ignored. Null texts count as empty,
    null ids are ids like any other. Rows that repeat doc_id and text (or
    item_id and text) count once. Empty tables give no rows.
    """
    return _found(docs, items, k, threshold).drop("doc_text")


def _found(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``contained_items`` with doc_text, the hash of the text that contains the item."""
    own = _shingled(items, k, F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_text")).distinct()
    own = own.select("item_id", "item_text", F.posexplode_outer("__s").alias("__at", "h"), "__w").where("h is not null")
    # the words, not the hash, tell shingles apart
    own = own.select("item_id", "item_text", "h", F.concat_ws(" ", F.slice("__w", F.col("__at") + 1, k)).alias("shingle")).distinct()
    sets = own.groupBy("item_id", "item_text").agg(F.sort_array(F.collect_list(F.struct("h", "shingle"))).alias("all"))
    sets = common.stored(sketched(sets, threshold), "items")
    sketches = sets.select("item_id", "item_text", "need", "meet", F.explode(F.slice("all", F.lit(1), F.col("sketch"))).alias("x"))
    sketches = sketches.select("item_id", "item_text", "need", "meet", F.col("x.h").alias("h"))

    stream = _shingled(docs, k, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_text"))
    stream = stream.withColumn("__n", F.size("__s"))
    # the outer form: Spark infers a filter for the other, and evaluates the hashes again in it
    stream = stream.select("doc_id", "doc_text", "__n", F.explode_outer("__s").alias("h"))
    if _small(sketches, 40):
        sketches = F.broadcast(sketches)
    else:  # beyond the bound both sides are dealt by hash, a document's repeats merged before
        stream = stream.distinct()
    met = stream.join(sketches, "h").where("__n >= need")  # a shorter document can't hold the item
    pair = ["doc_id", "doc_text", "item_id", "item_text"]
    met = met.groupBy(*pair, "h").agg(F.max("meet").alias("meet")).groupBy(*pair).agg(F.count("*").alias("hits"), F.max("meet").alias("meet"))
    candidates = common.stored(met.where("hits >= meet").select(*pair), "candidates")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_text"), "text")
    keys = candidates.select(F.col("doc_id").alias("__d"), F.col("doc_text").alias("__t")).distinct()
    keys = F.broadcast(keys) if _small(keys, 24) else keys
    texts = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("doc_text") == F.col("__t")), "left_semi")
    said = texts.select("doc_id", "doc_text", words(F.col("text")).alias("__w"))
    n = F.size("__w")
    said = said.select("doc_id", "doc_text", F.array_distinct(F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.concat_ws(" ", F.slice("__w", i, k)))).otherwise(F.array(F.concat_ws(" ", "__w")))).alias("said"))
    said = said.select(F.col("doc_id").alias("__d"), F.col("doc_text").alias("__t"), "said").distinct()
    sure = candidates.join(said, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("doc_text") == F.col("__t")))
    wanted = sets.select(F.col("item_id").alias("__i"), F.col("item_text").alias("__it"), "n_shingles", "need", F.col("all.shingle").alias("wanted"))
    size = wanted.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 24))).first()[0] or 0
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    sure = sure.join(wanted, F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("item_text") == F.col("__it")))
    sure = sure.withColumn("n_common", F.size(F.array_intersect("wanted", "said")).cast("long")).where("n_common >= need")
    # two texts of one document, or of one item, are pairs of their own
    return sure.select("doc_id", "doc_text", "item_id", "n_shingles", "n_common", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def sketched(sets: DataFrame, threshold: float) -> DataFrame:
    """Adds n_shingles, need, size_class, meet and sketch to ``sets`` with the sorted array ``all``.

    size_class is floor(log2 n); ``meet`` of the first ``sketch`` entries must be
    met: one in the classes of up to seven shingles, and one more for each class
    above, yet never more than ``need``.
    """
    n = F.size("all")
    need = F.greatest(F.ceil(n * F.lit(threshold) - 1e-9).cast("int"), F.lit(1))
    size_class = F.floor(F.log2(n)).cast("int")
    sets = sets.withColumns({"n_shingles": n.cast("long"), "need": need, "size_class": size_class})
    sets = sets.withColumn("meet", F.least("need", F.greatest(F.col("size_class") - 1, F.lit(1))))
    return sets.withColumn("sketch", n - F.col("need") + F.col("meet"))


def _small(df: DataFrame, width: int) -> bool:
    """Whether rows of ``width`` bytes make a side small enough to be broadcast."""
    most = BROADCAST_BYTES // width
    return df.limit(most + 1).count() <= most


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose own text contains no item; equal ids don't matter, null or not."""
    bad = _found(docs, items, k, threshold).select(F.col("doc_text").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == F.col("__bad"), "left_anti")
