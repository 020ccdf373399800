"""Deleted-interpolation n-gram model (Jelinek and Mercer, 1980), for scoring whole texts.

P(w | context) mixes maximum-likelihood estimates of orders 1 to n and a uniform
share, with weights by how often the longest context was seen. The weights are
learned by expectation-maximisation on a held-out part of the training documents,
whose own counts are deleted from the estimates meanwhile.

Counting and scoring are one exchange: each group of documents sends its distinct
n-grams, packed by hash range, with its own counts; each range adds them up and
replies to every group about the n-grams it sent. N-grams travel as names of 56
bits (8 of them the range), single tokens as names of 64 bits and the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.llm import common

BUCKETS = 24
ROUNDS = 12
#: The counting is done in so many parts by range, each with that share of its exchange's disk.
PARTS = 2
_END, _BEGIN = common.u64(0xE7037ED1A0B428DB), common.u64(0x8EBC6AF09C88C6E3)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCK = "bucket int, ord int, grp int, keys binary, n int, train binary, part binary"
REPLY = "grp int, ord int, bucket int, n int, train binary, part binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of each text's words and its end token, text after text, and n + 1 offsets."""
    docs = len(offsets) - 1
    if len(data):
        blank = _BLANK[data]
        first = ~blank
        first[1:] &= blank[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = ~blank[heads]
        starts = np.flatnonzero(first)
    else:
        starts = np.zeros(0, np.int64)
    words = np.searchsorted(starts, offsets)
    at = words + np.arange(docs + 1)
    out = np.full(len(starts) + docs, _END, np.uint64)
    if len(starts):
        lens = np.diff(np.r_[starts, len(data)])
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
        salts = common.mixed(np.arange(1, int(lens.max()) + 1, dtype=np.uint64) * common.u64(0x9E3779B97F4A7C15))
        body = salts[place]
        body *= _LOWER[data[starts[0] :]].astype(np.uint64) + common.u64(1)
        body[blank[starts[0] :]] = 0
        names = common.mixed(np.add.reduceat(body, starts - starts[0]))
        own = np.repeat(np.arange(docs), np.diff(words))
        out[np.arange(len(starts)) + own] = names
    return out, at


def ngrams(names: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the names of the n-grams of 1 to ``order`` tokens that end there, padded at a text's start."""
    out = [names]
    heads = offsets[:-1]
    for k in range(2, order + 1):
        before = np.empty_like(names)
        before[1:] = out[-1][:-1]
        before[heads] = common.mixed(np.array([_BEGIN ^ common.u64(k)], np.uint64))[0]
        out.append(common.paired(before, names, k))
    return out


def _six(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class _Group:
    """The texts of one group, their tokens, and their distinct n-grams in the order of the exchange."""

    def __init__(self, blobs: pa.Table, order: int, buckets: int):
        self.rows = common.texts_of(blobs)
        data, offsets = common.flat(self.rows["text"])
        names, self.at = tokens(data, offsets)
        role = self.rows["role"].to_numpy()
        self.role = np.repeat(role, np.diff(self.at))
        self.keys, self.where, self.sorted, self.cut = [], [], [], []
        for gram in ngrams(names, self.at, order):
            keys, where = np.unique(gram, return_inverse=True)
            bucket = ((keys >> common.u64(48)) % common.u64(buckets)).astype(np.int64)
            deal = np.argsort(bucket, kind="stable")
            self.keys.append(keys)
            self.where.append(where)
            self.sorted.append(deal)
            self.cut.append(np.searchsorted(bucket[deal], np.arange(buckets + 1)))

    def blocks(self, grp: int, part: int):
        """The n-grams of the ranges of one part."""
        rows = []
        for k, (keys, where, deal, cut) in enumerate(zip(self.keys, self.where, self.sorted, self.cut, strict=True), 1):
            counts = [np.bincount(where, self.role >= least, len(keys)).astype(np.uint32)[deal] for least in (1, 2)]
            keys = keys[deal]
            ranges = np.flatnonzero(cut[1:] > cut[:-1])
            for b in ranges[ranges % PARTS == part]:
                own = slice(cut[b], cut[b + 1])
                held = counts[1][own]
                rows.append((int(b), k, grp, keys[own].tobytes() if k == 1 else _six(keys[own]), len(held), common.few_bytes(counts[0][own]), common.few_bytes(held) if held.any() else b""))
        return rows

    def counts(self, replies) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By order, for each token: how often training, and its held-out part, have the n-gram."""
        total = [np.zeros(len(x), np.float64) for x in self.keys]
        part = [np.zeros(len(x), np.float64) for x in self.keys]
        for r in replies:
            k = r["ord"] - 1
            if k >= 0:
                sel = self.sorted[k][self.cut[k][r["bucket"]] : self.cut[k][r["bucket"] + 1]]
                total[k][sel] = common.from_few(r["train"], len(sel))
                if r["part"]:
                    part[k][sel] = common.from_few(r["part"], len(sel))
        return [x[w] for x, w in zip(total, self.where, strict=True)], [x[w] for x, w in zip(part, self.where, strict=True)]


def _send(order, buckets, part):
    names = ("bucket", "ord", "grp", "keys", "n", "train", "part")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())

    def send(key, blobs):
        rows = _Group(blobs, order, buckets).blocks(key[0].as_py(), part)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return send


def _add():
    """Adds the counts of one range and order; the held-out part goes only to the groups that learn weights (below 0)."""

    def add(key, blocks):
        bucket, k = key[0].as_py(), key[1].as_py()
        rows = blocks.to_pylist()
        keys = [np.frombuffer(r["keys"], np.uint64) if k == 1 else _from_six(r["keys"]) for r in rows]
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        train = np.bincount(where, np.concatenate([common.from_few(r["train"], r["n"]) for r in rows]), len(unique)).astype(np.uint32)
        part = np.bincount(where, np.concatenate([common.from_few(r["part"] or bytes(r["n"]), r["n"]) for r in rows]), len(unique)).astype(np.uint32)
        ends = np.cumsum([len(x) for x in keys])
        out = [(r["grp"], k, bucket, r["n"], common.few_bytes(train[where[b - r["n"] : b]]), common.few_bytes(part[where[b - r["n"] : b]]) if r["grp"] < 0 else b"") for r, b in zip(rows, ends, strict=True)]
        if k == 1:  # the range's tokens, held-out tokens and types
            out.append((_STATS, 0, bucket, 3, np.array([train.sum(dtype=np.uint64), part.sum(dtype=np.uint64), (train > 0).sum()], np.uint64).tobytes(), b""))
        names, kinds = ("grp", "ord", "bucket", "n", "train", "part"), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return add


_STATS = 1 << 30


def _estimates(total, part, at, sums, order):
    """For each token the estimates of orders 1 to ``order`` after deleting ``part``, and its context's bucket."""
    n, _, _ = sums
    seen = [t - p for t, p in zip(total, part, strict=True)]
    heads = at[:-1]
    ends = seen[0][at[1:] - 1] if len(at) > 1 else np.zeros(0)  # training documents: their end tokens
    out, context = [seen[0] / max(n, 1)], np.full(len(seen[0]), float(n))
    for k in range(2, order + 1):
        context = np.empty(len(seen[0]))
        context[1:] = seen[k - 2][:-1]
        context[heads] = ends
        out.append(np.divide(seen[k - 1], context, out=np.zeros(len(context)), where=context > 0))
    return out, np.minimum(np.log2(1 + np.maximum(context, 0)).astype(np.int64), BUCKETS - 1)


def _learn(order, buckets, sums):
    """The held-out events of a group: bucket and estimates."""

    def learn(key, blobs, replies):
        group = _Group(blobs, order, buckets)
        total, part = group.counts(replies.to_pylist())
        n, held, types = sums
        out, context = _estimates(total, part, group.at, (n - held, 0, types), order)
        mine = group.role == 2
        return pa.table({"context": common.binaries([context[mine].astype(np.uint8)]), "p": common.binaries([np.stack([x[mine] for x in out], 1).astype(np.float32)])})

    return learn


def learned(events: DataFrame, order: int, uniform: float) -> np.ndarray:
    """Weights by bucket: uniform, order 1, ... order n. A bucket without events takes those of the one below, or equal ones."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))

    def step(weights):
        def run(batches):
            sums = np.zeros((BUCKETS, order + 1))
            for batch in batches:
                for c, p in zip(batch.column("context"), batch.column("p"), strict=True):
                    c = np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64)
                    p = np.frombuffer(p.as_buffer(), np.float32).reshape(-1, order)
                    share = weights[c] * np.hstack([np.full((len(p), 1), uniform), p])
                    share /= share.sum(axis=1, keepdims=True)
                    for j in range(order + 1):
                        sums[:, j] += np.bincount(c, share[:, j], BUCKETS)
            yield pa.record_batch({"cell": pa.array(np.arange(sums.size)), "s": pa.array(sums.ravel())})

        return run

    for _ in range(ROUNDS):
        rows = events.mapInArrow(step(weights), "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros(weights.size)
        for r in rows:
            sums[r.cell] = r.s
        sums = sums.reshape(weights.shape)
        total = sums.sum(axis=1, keepdims=True)
        weights = np.where(total > 0, sums / np.maximum(total, 1e-300), weights)
    seen = total[:, 0] > 0
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    weights = np.maximum(weights, 1e-6)  # no token may become impossible
    return weights / weights.sum(axis=1, keepdims=True)


def _score(order, buckets, sums, weights):
    def score(key, blobs, replies):
        group = _Group(blobs, order, buckets)
        total, _ = group.counts(replies.to_pylist())
        n, _, types = sums
        out, context = _estimates(total, [0.0] * order, group.at, sums, order)
        own = weights[context]
        mix = own[:, 0] / (types + 1)
        for j, p in enumerate(out, 1):
            mix += own[:, j] * p
        at = group.at[:-1]
        count = np.diff(group.at)
        sum_ = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        rows = group.rows
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(count.astype(np.int64)), "n_known": pa.array(sum_((total[0] > 0).astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(count), n, np.int64)), "base_score": pa.array(sum_(np.log10((total[0] + 1) / (n + types + 1)))), "score": pa.array(sum_(np.log10(mix))),
        })

    return score


def scored(docs: DataFrame, order: int = 2, modulus: int = 7, held: int = 2, fold: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Training documents are those whose crc32(doc_id as text) mod ``modulus`` is
    not ``held``; of them, those with remainder ``fold`` are held out for the
    weights, and counted again once these are learned. Scores are base-10
    logarithms over all tokens, a text's end among them; base_score is the
    add-one unigram score. Null and wordless texts have the end token only. A
    null doc_id is no training document, and held_out is null then. Each row
    counts, rows that repeat a doc_id too; other columns are ignored. Without
    training documents all tokens are unknown. An empty table gives no rows.
    """
    size = common.group_count(docs)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    role = F.when(rest.isNull() | (rest == held), 0).when(rest == fold, 2).otherwise(1).cast("int")
    deal = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(3))
    # documents that teach the weights have groups of their own, numbered below 0
    few = max(1, -(-size // modulus))
    group = F.when(role == 2, -1 - F.pmod(deal, F.lit(few))).otherwise(F.pmod(deal, F.lit(size)))
    blobs = common.dealt_texts(docs, group, F.col("doc_id").cast("long").alias("doc_id"), (rest == held).alias("held_out"), role.alias("role"), F.col("text").cast("string").alias("text"))
    replies = None
    for part in range(PARTS):
        sent = blobs.groupBy("grp").applyInArrow(_send(order, size, part), BLOCK)
        added = common.stored(sent.groupBy("bucket", "ord").applyInArrow(_add(), REPLY), f"replies-{part}")
        replies = added if replies is None else replies.unionByName(added)
    sums = np.zeros(3, np.int64)
    for r in replies.where(F.col("grp") == _STATS).select("train").collect():
        sums += np.frombuffer(bytes(r.train), np.uint64).astype(np.int64)
    sums = tuple(int(x) for x in sums)
    mine = F.col("grp") < 0
    pairs = lambda a, b: a.groupBy("grp").cogroup(b.groupBy("grp"))
    events = pairs(blobs.where(mine), replies.where(mine)).applyInArrow(_learn(order, size, sums), "context binary, p binary")
    weights = learned(common.stored(events, "events"), order, 1 / (sums[2] + 1))
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pairs(blobs, replies.where(F.col("grp") != _STATS)).applyInArrow(_score(order, size, sums, weights), columns)
