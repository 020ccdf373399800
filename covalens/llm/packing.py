"""Variable-capacity best-fit packing of token sequences into training sequences.

Items go by descending length into the open bin, of whatever size, with the
least sufficient room. If none has room, a bin of the permitted size with the
least cost per token that it can be expected to hold is opened, and at the end
each bin is downsized to the least permitted size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covalens.llm import common

SIZES = (512, 1024, 2048, 4096, 8192)
#: Pieces packed together at most: the memory of a task, and what best-fit chooses from.
BLOCK = 32768


def sequence_cost(size: int) -> float:
    """Work of one training sequence: a fixed part, one per token, and one that grows with the square (attention)."""
    return 64 + size + size * size / 65536


def best_fit(lengths: list[int], sizes: tuple[int, ...] = SIZES, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each item, and each bin's final size. Items must come by descending length, none over the largest size."""
    sizes = sorted(sizes)
    room: list[int] = []  # the different free rooms, ascending
    open_: dict[int, list[int]] = {}
    used: list[int] = []
    where, start = [], []
    rest = sum(lengths)
    least = lengths[-1] if lengths else 0
    for n in lengths:
        rest -= n
        at = bisect_left(room, n)
        if at < len(room):
            free = room[at]
            bins = open_[free]
            b = bins.pop()
            if not bins:
                del open_[free], room[at]
        else:
            # what a bin may come to hold: all of it if what is left can fill it, else this item
            filled = lambda s: n + min(s - n, rest) if s - n >= least else n  # noqa: E731, B023
            free = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / max(filled(s), 1), s))
            b = len(used)
            used.append(0)
        where.append(b)
        start.append(used[b])
        used[b] += n
        free -= n
        if free:
            if free not in open_:
                insort(room, free)
                open_[free] = []
            open_[free].append(b)
    return where, start, [sizes[bisect_left(sizes, u)] for u in used]


def token_count(text: Column) -> Column:
    """Words of the text and one end token."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1


def packed(docs: DataFrame, sizes: tuple[int, ...] = SIZES, length: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, piece, piece_start, n_tokens, bin_id, bin_size, bin_used, bin_start) for each piece of each document.

    ``length`` gives a document's tokens, its words and an end token unless
    told otherwise; other columns are ignored. A document longer than the
    largest size is cut into pieces of that size and a rest. Null, negative and zero lengths make one
    piece of no tokens, which goes to any bin. Each row is packed, rows that
    repeat a doc_id too. Blocks of at most ``block`` pieces are packed apart;
    bin_id is (partition, block, bin) as text. An empty table gives no rows.
    """
    top = max(sizes)
    n = F.greatest(F.coalesce((token_count(F.col("text")) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    # sorted, so that blocks, and with them bins, are the same when a lost task is run again
    lengths = lengths.repartition(common.partitions(docs.sparkSession), "doc_id", "n").sortWithinPartitions("doc_id", "n")
    lengths = lengths.select("doc_id", "n", F.spark_partition_id().alias("part"))

    def flush(ids, lens, part, k):
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        # a null doc_id has come as the least number
        pieces = np.maximum(-(-lens // top), 1)
        own = np.repeat(np.arange(len(lens)), pieces)
        piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < pieces[own] - 1, top, lens[own] - piece * top)
        order = np.lexsort((piece, ids[own], -size))
        own, piece, size = own[order], piece[order], size[order]
        where, start, bins = best_fit(size.tolist(), sizes)
        where = np.array(where, np.int64)
        used = np.bincount(where, weights=size, minlength=len(bins)).astype(np.int64)
        doc = pa.array(ids[own], mask=ids[own] == _NONE)
        final = np.array(bins, np.int64)
        return pa.record_batch({"doc_id": doc, "piece": pa.array(piece), "piece_start": pa.array(piece * top), "n_tokens": pa.array(size), "bin_id": pa.array([f"{part}-{k}-{b}" for b in where]), "bin_size": pa.array(final[where]), "bin_used": pa.array(used[where]), "bin_start": pa.array(np.array(start, np.int64))})

    def run(batches):
        ids, lens, held, k, part = [], [], 0, 0, 0
        for batch in batches:
            doc = batch.column("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False)
            num = batch.column("n").to_numpy(zero_copy_only=False)
            part = batch.column("part")[0].as_py() if len(doc) else part
            count = np.maximum(-(-num // top), 1)
            at = 0
            while at < len(doc):  # rows until the block is full, one at least
                stop = at + max(int(np.searchsorted(np.cumsum(count[at:]), block - held, side="right")), 0 if held else 1)
                ids.append(doc[at:stop])
                lens.append(num[at:stop])
                held += int(count[at:stop].sum())
                at = stop
                if at < len(doc):
                    yield flush(ids, lens, part, k)
                    ids, lens, held, k = [], [], 0, k + 1
        if held:
            yield flush(ids, lens, part, k)

    columns = "doc_id long, piece long, piece_start long, n_tokens long, bin_id string, bin_size long, bin_used long, bin_start long"
    return lengths.mapInArrow(run, columns)


_NONE = -(1 << 63)
