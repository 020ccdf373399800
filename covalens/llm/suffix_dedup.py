"""Suffix-array dedup: prefix doubling over byte positions, for strings of a fixed length.

A position's rank stands for the string that starts there. Ranks of 16 bytes
are paired at growing offsets: 8 for ranks of 24 bytes, 16 for 32 and, for the
default threshold of 50, 18 for ranks of 50. Ranks are names (pair hashes of 96 bits and
more) that each task can derive, and the distributed sorts decide which
positions are still tied:

1. Every 50-byte string is represented by its least 24-byte rank (leftmost on
   ties), so equal strings choose the same place. Successive starts with the
   same representative form a run; a run goes out once, as (24-byte rank, rank
   pair of its two ends, smallest doc). Sorted by rank, runs that are unique
   are done, equal runs are resolved at once, and only starts of different
   runs that tie on 24 bytes go on. What this leaves of a group,
   two bits a byte, is kept, so that its runs are made twice in all.
2. Those starts go out with their 50-byte ranks. Sorted again, each learns
   whether a smaller document has it.

Sorting is dealt by rank, after each task has merged its equal ranks: a
passage that a third of all documents share is one entry per task. Entries
travel as packed arrays, replies as one bit or two each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covalens.llm import common

FIRST = 16
SEGMENT = 1 << 18
_IDX = 20
#: The second sort is done in so many parts by range of ranks, each with that share of its exchange's disk.
PARTS = 3
#: Bytes of text in one group: a task holds some hundred times as many numbers as it has repeated positions.
GROUP = 1 << 20

BLOCK = "kind int, bucket int, grp int, name binary, rank binary, docs binary, base long"
REPLY = "kind int, grp int, bucket int, bits binary"
#: Kinds of blocks and replies: runs, starts, and what the first sort leaves of a group.
RUNS, STARTS, STATE = 1, 2, 3


def _paired_words(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    out = a * common.u64(0x9E3779B97F4A7C15 + 2 * salt)
    out ^= out >> common.u64(32)
    out += b
    out *= common.u64(0xD6E8FEB86659FD93 + 2 * salt)
    out ^= out >> common.u64(32)
    out *= common.u64(0xD6E8FEB86659FD93)
    return out


def _names(data: np.ndarray, salt: int) -> np.ndarray:
    """Names of the 16 bytes that start at each position; data has 16 bytes of padding."""
    n = len(data) - FIRST
    words = np.ndarray((n + 8,), "<u8", data, strides=(1,)).astype(np.uint64)
    return _paired_words(words[:n], words[8 : n + 8], salt)


def _long_names(first, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes at positions ``at``, by doubling names of 16 bytes, which ``first`` gives for positions."""

    def name(at, n):
        if n == FIRST:
            return first(at)
        half = FIRST
        while 2 * half < n:
            half *= 2
        return common.paired(name(at, half), name(at + (n - half), half), n)

    return name(at, length)


def _anchor(length: int) -> int:
    """Bytes of the ranks that represent strings: longer ones tie less often, but make more runs."""
    return FIRST + FIRST // 2 if length >= 3 * FIRST else FIRST


def _slid_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v


def _segment(data, ends, lo, hi, length):
    """The runs among the starts lo to hi - 1: first and last start, text, name and representative's rank of each."""
    stop = min(len(data), hi + length - 1)
    padded = np.zeros(stop - lo + FIRST, np.uint8)
    padded[: stop - lo] = data[lo:stop]
    first = _names(padded, 0)
    wide = _anchor(length)
    anchor = first if wide == FIRST else common.paired(first[: FIRST - wide], first[wide - FIRST :], wide)
    n = min(hi - lo, len(anchor) - (length - wide))
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    whole = np.ones(n, bool)
    a, b = np.searchsorted(ends, [lo, lo + n + length], side="right")
    for end in ends[a : b + 1] - lo:
        whole[max(end - length + 1, 0) : max(end, 0)] = False
    keyed = anchor >> common.u64(_IDX)
    keyed <<= common.u64(_IDX)
    keyed |= np.arange(len(anchor), dtype=np.uint64)
    least = _slid_min(keyed, length - wide + 1)[:n]
    change = least[1:] != least[:-1]
    r0 = np.flatnonzero(whole & np.r_[True, change | ~whole[:-1]])
    r1 = np.flatnonzero(whole & np.r_[change | ~whole[1:], True])
    rank = anchor[(least[r0] & common.u64((1 << _IDX) - 1)).astype(np.int64)]
    ends_named = common.paired(_long_names(first.__getitem__, r0, length), _long_names(first.__getitem__, r1, length), 3)
    name = common.paired(ends_named, (r1 - r0).astype(np.uint64))
    r0 += lo
    return r0, r1 + lo, np.searchsorted(ends, r0, side="right"), name, rank


def _merged(name: np.ndarray, rank: np.ndarray, keys: np.ndarray):
    """Of each different name: name, rank and the smallest key, by ascending name; and where each row went."""
    order = np.argsort(name)
    name = name[order]
    new = np.r_[True, name[1:] != name[:-1]] if len(name) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(keys[order], at) if len(at) else keys[:0]
    where = np.empty(len(name), np.int64)
    where[order] = np.cumsum(new) - 1
    return name[at], rank[order][at], least, where


def _dealt(kind, grp, name, rank, least, buckets):
    """Packed blocks by bucket, in the order that replies refer to."""
    order, at = _dealt_order(rank, buckets)
    # a rank's low part is the bucket; of the rest 32 bits tell ties of runs, and 16 with the name starts
    width = np.uint32 if kind == RUNS else np.uint16
    name, rank, least = name[order], (rank[order] >> common.u64(32)).astype(width), least[order]
    rows = []
    for b in np.flatnonzero(at[1:] > at[:-1]):
        own = slice(at[b], at[b + 1])
        base, docs = common.small_ints(least[own])
        rows.append((kind, int(b), grp, name[own].tobytes(), rank[own].tobytes(), docs, base))
    return rows


def _texts(blobs: pa.Table):
    """A group's texts, always in the same order, however its blobs arrive; their bytes, offsets and keys."""
    common.give_back()  # what the group before has left
    texts = common.texts_of(blobs)
    texts = texts.take(pc.sort_indices(texts, sort_keys=[("key", "ascending"), ("text", "ascending")]))
    return texts, *common.flat(texts["text"]), texts["key"].to_numpy()


def _runs(data, offsets, keys, length: int):
    ends = offsets[1:]
    segments = [_segment(data, ends, lo, min(lo + SEGMENT, len(data)), length) for lo in range(0, len(data), SEGMENT)]
    joined = lambda i, kind: np.concatenate([s[i] for s in segments]) if segments else np.zeros(0, kind)
    r0, r1, doc = joined(0, np.int64), joined(1, np.int64), joined(2, np.int64)
    name, rank = joined(3, np.uint64), joined(4, np.uint64)
    name, rank, least, where = _merged(name, rank, keys[doc] if len(doc) else np.zeros(0, np.int64))
    return r0, r1, doc, name, rank, least, where


def _bits(replies: list[tuple[int, bytes]], order, at, n) -> np.ndarray:
    """What was replied about each of n entries: bit 0, a smaller document has it; bit 1, its rank ties with others."""
    out = np.zeros(n, np.uint8)
    for bucket, bits in replies:
        sel = order[at[bucket] : at[bucket + 1]]
        packed = np.frombuffer(bits, np.uint8)
        half = len(packed) // 2
        out[sel] = np.unpackbits(packed[:half], count=len(sel)) | np.unpackbits(packed[half:], count=len(sel)) << 1
    return out


def _sorted(rows: list[dict]) -> list[bytes]:
    """Sorts the blocks of one range of ranks; two bits about each entry, by block."""
    names = [np.frombuffer(r["name"], np.uint64) for r in rows]
    name = np.concatenate(names)
    rank = np.concatenate([np.frombuffer(r["rank"], np.uint32 if r["kind"] == RUNS else np.uint16) for r in rows])
    docs = np.concatenate([common.from_small(r["base"], r["docs"], len(x)) for r, x in zip(rows, names, strict=True)])
    order = np.lexsort((name, rank))
    n, k = name[order], rank[order]
    same_rank = k[1:] == k[:-1]
    new = np.r_[True, (n[1:] != n[:-1]) | ~same_rank]
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[order], at)
    cls = np.cumsum(new) - 1
    earlier = np.empty(len(name), bool)
    earlier[order] = least[cls] < docs[order]
    first_of_rank = np.r_[True, ~same_rank]
    by_rank = np.cumsum(first_of_rank) - 1
    classes = np.bincount(by_rank[at])
    tied = np.empty(len(name), bool)
    tied[order] = classes[by_rank] > 1
    ends = np.cumsum([len(x) for x in names])
    return [np.packbits(earlier[a:b]).tobytes() + np.packbits(tied[a:b]).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def _answer(key, blocks):
    """Replies to each group about each of its entries in one range of ranks; a group's state passes as it is."""
    bucket, rows = key[-1].as_py(), blocks.to_pylist()
    entries, state = ([r for r in rows if (r["kind"] == STATE) == s] for s in (False, True))
    bits = (_sorted(entries) if entries else []) + [r["name"] for r in state]
    rows = entries + state
    return pa.table({"kind": pa.array([r["kind"] for r in rows], pa.int32()), "grp": pa.array([r["grp"] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _blocks(rows) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    names = ("kind", "bucket", "grp", "name", "rank", "docs", "base")
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a range from a to b - 1."""
    return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0


def _dealt_order(rank, buckets):
    bucket = (rank % common.u64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _first(length, buckets):
    def send(key, blobs):
        _, *group = _texts(blobs)
        *_, name, rank, least, _ = _runs(*group, length)
        return _blocks(_dealt(RUNS, key[0].as_py(), name, rank, least, buckets))

    return send


def _resolved(data, offsets, keys, replies, length, buckets):
    """What the first sort leaves of a group: which starts still tie, and which bytes runs cover that a smaller document has."""
    r0, r1, doc, name, rank, least, where = _runs(data, offsets, keys, length)
    flags = _bits([(r["bucket"], r["bits"]) for r in replies], *_dealt_order(rank, buckets), len(name))[where]
    gone = (keys[doc] > least[where]) | (flags & 1).astype(bool)
    tied = ~gone & (flags >> 1).astype(bool)
    return _covered(r0[tied], r1[tied] + 1, len(data)), _covered(r0[gone], r1[gone] + length, len(data))


def _packed(tied: np.ndarray, dead: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(np.r_[tied, dead]).tobytes())


def _unpacked(rows, n: int):
    import zstandard

    (bits,) = (r["bits"] for r in rows if r["kind"] == STATE)
    both = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8), count=2 * n).astype(bool)
    return both[:n], both[n:]


def _named(data, start, length, salt):
    """Names of the ``length`` bytes at each start, which ascend; only where they are needed, unless that is more work."""
    out = [np.zeros(0, np.uint64)]
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    at = np.searchsorted(start, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        s0 = i * SEGMENT
        if 4 * (b - a) > min(SEGMENT, len(data) - s0):
            own = data[s0 : s0 + SEGMENT + length]
            first = _names(np.r_[own, np.zeros(FIRST, np.uint8)], salt)
            out.append(_long_names(first.__getitem__, start[a:b] - s0, length))
        elif b > a:
            out.append(_long_names(lambda x: _paired_words(words[x], words[x + 8], salt), start[a:b], length))
    return np.concatenate(out)


def _entries(data, offsets, keys, tied, length, buckets, part=None):
    """Starts that tie and their texts; the entries of the second sort, and which one each start is."""
    start = np.flatnonzero(tied)
    hi = _named(data, start, length, 0x51)
    if part is not None:
        mine = hi % common.u64(buckets) % common.u64(PARTS) == common.u64(part)
        start, hi = start[mine], hi[mine]
    owner = np.searchsorted(offsets[1:], start, side="right")
    return start, owner, *_merged(_named(data, start, length, 0), hi, keys[owner])


def _second(length, buckets, part):
    """Entries of one part; the first part takes the replies about runs, and hands on what they leave, which the others take."""

    def send(key, blobs, replies):
        _, *group = _texts(blobs)
        rows, grp = replies.to_pylist(), key[0].as_py()
        tied, dead = _unpacked(rows, len(group[0])) if part else _resolved(*group, rows, length, buckets)
        *_, lo, hi, first, _ = _entries(*group, tied, length, buckets, part)
        state = [] if part else [(STATE, grp % buckets // PARTS * PARTS, grp, _packed(tied, dead), b"", b"", 0)]  # to a range of this part
        return _blocks(_dealt(STARTS, grp, lo, hi, first, buckets) + state)

    return send


def _whole_characters(data: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """``dead`` and the other bytes of characters that lose a byte."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(heads):
        return dead
    broken = np.logical_or.reduceat(dead[heads[0] :], heads - heads[0])
    return np.r_[dead[: heads[0]], np.repeat(broken, np.diff(np.r_[heads, len(data)]))]


def _last(length, buckets, whole):
    def cut(key, blobs, replies):
        rows = replies.to_pylist()
        texts, data, offsets, keys = _texts(blobs)
        tied, dead = _unpacked(rows, len(data))
        start, owner, lo, hi, first, to = _entries(data, offsets, keys, tied, length, buckets)
        flags = _bits([(r["bucket"], r["bits"]) for r in rows if r["kind"] == STARTS], *_dealt_order(hi, buckets), len(lo))
        hit = start[(keys[owner] > first[to]) | (flags[to] & 1).astype(bool)]
        dead |= _covered(hit, hit + length, len(data))
        lost = _whole_characters(data, dead) if whole else dead
        none = texts["text"].is_null().to_pylist()
        removed, spans, sha, kept = [], [], [], []
        for a, b, null in zip(offsets[:-1], offsets[1:], none, strict=True):
            d = dead[a:b]
            removed.append(int(d.sum()))
            spans.append(int((d[1:] & ~d[:-1]).sum() + d[0]) if b > a else 0)
            rest = data[a:b][~d].tobytes() if removed[-1] else data[a:b].tobytes()
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(None if whole and null else data[a:b][~lost[a:b]].tobytes() if whole and removed[-1] else rest)
        ids = texts["doc_id"]
        rest = {"rest": texts["rest"]} if "rest" in texts.column_names else {}
        return pa.table({"doc_id": ids.cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()), **rest})

    return cut


def suffix_dedup(docs: DataFrame, length: int = 50, keep: bool = True, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts in a smaller document.

    Takes doc_id and text; other columns are ignored, but for those of
    ``carry``, which come back in a struct named rest. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and, with ``keep``, kept: the remaining
    bytes (binary, as a cut may fall inside a character). With ``whole``, kept
    lacks characters of which a byte is removed, too, and is null for a null
    text; nothing else depends on it. One row for each input
    row. Null and empty texts have nothing to remove; texts shorter than
    ``length`` stay whole. Rows that repeat a doc_id don't match each other,
    and a null doc_id counts as the largest one. An empty table gives no rows.
    """
    if not FIRST < length:
        raise ValueError("length must exceed 16")
    groups = common.group_count(docs, size=GROUP)
    ranges = max(common.partitions(docs.sparkSession), groups // 4)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    group = F.pmod(F.xxhash64(key), F.lit(groups))
    rest = F.struct(*carry).alias("rest")
    # dealt once, for all passes
    blobs = common.dealt_texts(docs, group, key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([rest] if carry else []))
    by = lambda df: df.groupBy("grp")
    answered = lambda blocks, tag: common.stored(blocks.groupBy("bucket").applyInArrow(_answer, REPLY), tag)
    said = answered(by(blobs).applyInArrow(_first(length, ranges), BLOCK), "runs")
    replies = None
    for part in range(PARTS):
        own = answered(by(blobs).cogroup(by(said)).applyInArrow(_second(length, ranges, part), BLOCK), f"starts-{part}")
        replies = replies.unionByName(own) if part else own
        said = replies.where(F.col("kind") == STATE)
    columns = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    columns = T.StructType([*columns.fields, *(docs.select(rest).schema.fields if carry else [])])
    out = by(blobs).cogroup(by(replies)).applyInArrow(_last(length, ranges, whole), columns)
    return out if keep else out.drop("kept")
