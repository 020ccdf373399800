"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a
text's word shingles. Two fingerprints that differ in at most ``bits`` places
must, for thresholds t_i with sum(t_i + 1) = bits + 1, differ in at most t_i
places of some part i. Parts group the bits that go together in the corpus;
the thresholds are unequal, chosen by dynamic programming on the estimated
number of candidates and probes. Probing masks t_i bits of a part in every
possible way; equal masked values meet, and their whole fingerprints are compared.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.llm import common
from covalens.llm.graph import components

#: A probe value with more fingerprints than this is compared block by block.
BLOCK = 1500
#: A probe, which is made, counted, shuffled and sorted, costs as much as so many comparisons. Measured over 236,028
#: fingerprints: 0.8 microseconds a probe, 4.4 nanoseconds a comparison. It changes cost, not which links are found.
PROBE_COST = 180


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, split at space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``k`` successive words joined by spaces, or of all words if fewer."""
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    stops = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = itertools.chain([0], (x + 1 for x in stops))
    cuts = (digest(joined[a:b], 42) for a, b in zip(starts, stops[k - 1 :], strict=False))
    return np.fromiter(cuts, np.uint64, len(words) - k + 1)


def _fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, h in enumerate(hashes):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 20):
            part = h[a : a + (1 << 20)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if len(part) < 255:
                ones += bits.sum(axis=0, dtype=np.uint8)
            else:
                ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
        out[i] = place[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; fp is the signed reading of the 64 bits. Null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for at in range(0, len(ids), 256):
                own = [shingle_hashes(words_of(x), shingle) for x in texts[at : at + 256].to_pylist()]
                fp = _fingerprints(own).view(np.int64)
                yield pa.record_batch({"doc_id": ids[at : at + 256], "fp": pa.array(fp)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both set (64 x 64)."""

    def run(batches):
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            for at in range(0, len(fp), 1 << 16):
                part = fp[at : at + (1 << 16)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.record_batch({"cell": pa.array(np.arange(4097)), "c": pa.array(np.append(total.ravel(), n))})

    rows = fps.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()
    cells = np.zeros(4097, np.int64)
    for r in rows:
        cells[r.cell] = r.c
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of equal size, each grown from its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(link, 0)
    left, out = set(range(64)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        rest = sorted(left)
        own = [max(rest, key=lambda b: (link[b, rest].sum(), -b))]
        while len(own) < size:
            rest = sorted(left - set(own))
            own.append(max(rest, key=lambda b: (link[b, own].sum(), -b)))
        left -= set(own)
        out.append(sorted(own))
    return out


def allotted(n: int, both: np.ndarray, groups: list[list[int]], bits: int) -> tuple[float, list[int]]:
    """The least cost and the threshold of each group (-1: not probed), by dynamic programming.

    The candidates of a group are estimated from the chance that two texts of
    the corpus differ in at most t of its bits; a probe costs as much as
    PROBE_COST comparisons.
    """
    p = np.diag(both) / max(n, 1)
    costs = []
    for g in groups:
        apart = np.array([1.0])
        for b in g:
            d = 2 * p[b] * (1 - p[b])
            apart = np.convolve(apart, [1 - d, d])
        near = np.cumsum(apart)
        cost = [0.0]
        for t in range(bits + 1):
            probes = math.comb(len(g), t) if t <= len(g) else math.inf
            cost.append(n * probes * PROBE_COST + n * n / 2 * near[min(t, len(g))] * max(1, t) if probes < 20_000 else math.inf)
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for extra, c in enumerate(cost):
                at = min(used + extra, bits + 1)
                if total + c < step.get(at, (math.inf, []))[0]:
                    step[at] = (total + c, [*ts, extra - 1])
        best = step
    return best.get(bits + 1, (math.inf, []))


def plan(n: int, both: np.ndarray, bits: int) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds, for the number of groups that costs least."""
    options = []
    for parts in range(1, min(bits + 2, 17)):
        groups = grouped_bits(n, both, parts)
        cost, ts = allotted(n, both, groups, bits)
        if ts:
            options.append((cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def masks_of(chosen: list[tuple[list[int], int]]) -> list[int]:
    """One mask for each way to leave t bits out of a group."""
    return [sum(1 << b for b in g if b not in gone) for g, t in chosen for gone in itertools.combinations(g, t)]


def _probes(masks: list[int]):
    own = np.array(masks, np.uint64)

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            step = max(1, 200_000 // len(own))
            for at in range(0, len(fp), step):
                f = fp[at : at + step]
                name = common.paired(np.repeat(own[None, :], len(f), 0).ravel(), (f.view(np.uint64)[:, None] & own[None, :]).ravel())
                yield pa.record_batch({"probe": pa.array(name.view(np.int64)), "fp": pa.array(np.repeat(f, len(own)))})

    return run


def _near(key: np.ndarray, fp: np.ndarray, side: np.ndarray, bits: int):
    """Pairs of rows (sorted by key) with equal keys whose fingerprints are near; of rows of two sides only pairs across them."""
    idx, d = np.arange(len(key) - 1), 1
    while len(idx):
        idx = idx[idx + d < len(key)]
        idx = idx[key[idx] == key[idx + d]]
        hit = idx[(np.bitwise_count(fp[idx] ^ fp[idx + d]) <= bits) & ((side[idx] == 0) | (side[idx] != side[idx + d]))]
        if len(hit):
            yield hit, hit + d
        d += 1


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (each the smallest row) after links (a, b) are added to those of ``root``."""
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            return root
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _roots(n: int, links) -> np.ndarray:
    """The smallest row of each row's component; links are folded in as they come."""
    root = np.arange(n)
    for a, b in links:
        root = _joined(root, a, b)
    return root


def _linked(bits: int, closest: bool):
    def edges(key, fp, side):
        order = np.lexsort((fp, key))
        key, fp, side = key[order], fp[order].view(np.uint64), side[order]
        pairs = list(_near(key, fp, side, bits)) if closest else _near(key, fp, side, bits)
        root = _roots(len(key), pairs)
        off = np.flatnonzero(root != np.arange(len(key)))
        a, b = off, root[off]
        if closest and pairs:  # links themselves, not only what they connect: each row's closest one, and a forest's
            best = np.full(len(key), _FAR)
            a, b = [], []
            forest = np.arange(len(key))
            for x, y in pairs:
                d = np.bitwise_count(fp[x] ^ fp[y]).astype(np.int64) << 40
                np.minimum.at(best, x, d | y)
                np.minimum.at(best, y, d | x)
                new = forest[x] != forest[y]
                a.append(x[new])
                b.append(y[new])
                forest = _joined(forest, x[new], y[new])
            has = np.flatnonzero(best < _FAR)
            a, b = np.concatenate([*a, has]), np.concatenate([*b, best[has] & ((1 << 40) - 1)])
        f = fp.view(np.int64)
        return pa.record_batch({"a": pa.array(np.maximum(f[a], f[b])), "b": pa.array(np.minimum(f[a], f[b]))})

    def run(batches):
        """Rows come sorted by probe; a probe's rows may span batches."""
        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "fp", "side")]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            last = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
            held = [x[last:] for x in own]
            if last:
                yield edges(*(x[:last] for x in own))
        if held is not None and len(held[0]):
            yield edges(*held)

    return run


_FAR = np.int64(1 << 60)


def near_edges(classes: DataFrame, bits: int, chosen: list[tuple[list[int], int]], closest: bool = False) -> DataFrame:
    """Edges (a, b) between fingerprints fp that connect all that differ in at most ``bits`` places.

    Of the links within a probe value only a spanning forest is made and, with
    ``closest``, each fingerprint's closest link; all edges are links then. A
    value with more than BLOCK fingerprints is dealt in blocks: each pair of
    blocks is a task of its own, so that no value meets in one place.
    """
    spark = classes.sparkSession
    probes = classes.select("fp").mapInArrow(_probes(masks_of(chosen)), "probe long, fp long")
    hot = probes.groupBy("probe").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = common.stored(hot.select("probe", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    n_hot = hot.limit(10_001).count()
    probes = probes.withColumn("side", F.lit(0).cast("byte"))
    if n_hot:
        split = probes.join(F.broadcast(hot) if n_hot <= 10_000 else hot, "probe", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")).cast("int")
        block = lambda x: F.struct(F.xxhash64("probe", F.least(x, own), F.greatest(x, own)).alias("probe"), F.when(x == own, 0).when(x < own, 1).otherwise(2).cast("byte").alias("side"))
        whole = F.array(F.struct("probe", "side"))
        parts = F.when(F.col("blocks").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), block))
        probes = split.withColumn("part", F.explode(parts)).select("part.probe", "fp", "part.side")
    dealt = probes.repartition(common.partitions(spark), "probe").sortWithinPartitions("probe")
    return dealt.mapInArrow(_linked(bits, closest), "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Texts link if their fingerprints differ in at most ``bits`` places. Takes
    doc_id and text; other columns are ignored. One row for each input row;
    rows that repeat a doc_id each get their own fingerprint and belong
    together only if linked. A null doc_id is never a component_id unless all
    members are null. Null and wordless texts have fingerprint zero and link
    like any other. An empty table gives no rows.
    """
    fps = common.stored(fingerprints(docs, shingle), "fps")
    none = (1 << 63) - 1
    classes = fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(none))).alias("least"))
    classes = common.stored(classes, "classes")
    n, both = bit_counts(classes)
    if not n:
        return fps.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    comp = components(near_edges(classes, bits, plan(n, both, bits)))
    joined = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = common.stored(joined.select("fp", "root").join(least, "root").select("fp", "component"), "components")
    out = fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", F.lit(none)).alias("component_id"))
    return out


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = common.unpacked(x, np.uint64), common.unpacked(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                every = len(x) + len(y) - both
                keep.append(not every or both >= similarity * every)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep))

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [np.unique(shingle_hashes(words_of(x), shingle)) for x in batch.column("text")[at : at + 256].to_pylist()]
                yield pa.record_batch({"node": batch.column("node")[at : at + 256], "own": common.binaries(own)})
        common.give_back()

    return run


def _due(size):
    """How many shingles two alike sets, the smaller one of ``size``, must share within their prefixes; these are longer by as many less one."""
    return 1 + size // 50


#: Of each set's shingles, whether an odd number of their hashes falls on each of 256 bits.
PARITY = [f"p{i}" for i in range(4)]


def _marked(shingle: int, similarity: float, common_hashes: np.ndarray, weight: np.ndarray):
    """Adds to each text its fingerprint, its set's size and parities, and its prefix: the first shingles in one order for all, rare ones first."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                sets = [np.unique(shingle_hashes(words_of(x), shingle)) for x in part.column("text").to_pylist()]
                some = np.array([len(s) > 0 for s in sets])  # wordless texts are copies of each other
                x, y = (np.where(some, part.column(c).to_numpy(zero_copy_only=False), 0) for c in ("x", "y"))
                prefix, parity = [], []
                for own in sets:
                    w = np.zeros(len(own), np.int64)
                    if len(common_hashes):
                        place = np.minimum(np.searchsorted(common_hashes, own), len(common_hashes) - 1)
                        w = np.where(common_hashes[place] == own, weight[place], 0)
                    prefix.append(own[np.lexsort((own, w))][: len(own) - math.ceil(similarity * len(own) - 1e-9) + _due(len(own))])  # none of an empty set
                    odd = np.bincount((own >> np.uint64(17) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                out = {"doc_id": part.column("doc_id"), "x": pa.array(x), "y": pa.array(y), "fp": pa.array(_fingerprints(sets).view(np.int64)), "size": pa.array([len(s) for s in sets], pa.int64())}
                out |= {c: pa.array(np.ascontiguousarray(v)) for c, v in zip(PARITY, np.array(parity).T, strict=True)}
                yield pa.record_batch(out | {"prefix": common.binaries(prefix)})
        common.give_back()

    return run


_MARKED = f"doc_id long, x long, y long, fp long, size long, {', '.join(f'{c} long' for c in PARITY)}, prefix binary"
_ENTRY = ["probe", "node", "comp", "meta", *PARITY]


def _entries(part: int, parts: int):
    """One row for each shingle of a prefix that falls to ``part``; meta is the set's size, the shingle's place and a side."""

    def run(batches):
        for batch in batches:
            column = lambda c, rows=batch: rows.column(c).to_numpy(zero_copy_only=False)
            tokens = [common.unpacked(x, np.uint64) for x in batch.column("prefix")]
            for at in range(0, len(tokens), 512):
                n = np.array([len(t) for t in tokens[at : at + 512]])
                probe = np.concatenate(tokens[at : at + 512])
                each = np.repeat(np.arange(at, at + len(n)), n)
                pos = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                mine = probe % np.uint64(parts) == part
                probe, each, pos = probe[mine], each[mine], pos[mine]
                out = [probe.view(np.int64), column("node")[each], column("comp")[each], column("size")[each] << 34 | pos << 4, *(column(c)[each] for c in PARITY)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in out], names=_ENTRY)
        common.give_back()

    return run


def _repeated():
    """(probe, n, lo, hi) of the shingles that occur at least twice in a task's prefixes: how often, and the least and largest group."""

    def flush(held):
        probe, comp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((comp, probe))
        probe, comp = probe[order], comp[order]
        at = np.flatnonzero(np.r_[True, probe[1:] != probe[:-1]])
        n = np.diff(np.r_[at, len(probe)])
        twice = n > 1
        return pa.record_batch({"probe": pa.array(probe[at][twice].view(np.int64)), "n": pa.array(n[twice]), "lo": pa.array(comp[at][twice]), "hi": pa.array(comp[at + n - 1][twice])})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            tokens = [common.unpacked(x, np.uint64) for x in batch.column("prefix")]
            n = np.array([len(t) for t in tokens], np.int64)
            held.append((np.concatenate([np.zeros(0, np.uint64), *tokens]), np.repeat(batch.column("comp").to_numpy(zero_copy_only=False), n)))
            rows += int(n.sum())
            if rows > 4_000_000:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)
        common.give_back()

    return run


def _crossing(similarity: float, beside: bool = False):
    """(a, b, n, due): in how many shingles of their prefixes two texts of different groups meet, less pairs that by bounds can't be alike.

    With ``beside`` only (a, b), each once, of texts that stand beside each other in an order of a shingle's texts by chance.
    """

    def pairs(key, node, comp, meta, *parity):
        chance = (node ^ key).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((chance if beside else comp, key))
        key, node, comp, meta = (x[order] for x in (key, node, comp, meta))
        size, pos, side = meta >> 34, meta >> 4 & ((1 << 30) - 1), meta & 15
        parity = np.stack(parity, axis=1)[order].view(np.uint64)

        def fitting(x, y):
            need = similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
            due = _due(np.minimum(size[x], size[y]))
            # the first common shingle of a pair has all others behind it, the last one due as many less
            fine = ((side[x] == 0) | (side[x] != side[y])) & (np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need - (due - 1))
            x, y, need, due = x[fine], y[fine], need[fine], due[fine]
            # bits of odd counts that differ are at most as many as the shingles of one set alone
            fine = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64) <= size[x] + size[y] - 2 * need
            x, y, due = node[x[fine]], node[y[fine]], due[fine]
            return np.stack([np.maximum(x, y), np.minimum(x, y), due], axis=1)

        if beside:
            near = [(np.flatnonzero((key[d:] == key[:-d]) & (comp[d:] != comp[:-d])), d) for d in range(1, BESIDE + 1)]
            out = np.unique(np.concatenate([fitting(at, at + d)[:, :2] for at, d in near]), axis=0)
            return pa.record_batch([pa.array(np.ascontiguousarray(v)) for v in out.T], names=["a", "b"])
        end = np.searchsorted(key, key, "right")
        last = np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (comp[1:] != comp[:-1]), True])
        after = last[np.searchsorted(last, np.arange(len(key)))] + 1  # the first row of the next group
        idx, d, found = np.arange(len(key)), 0, [np.zeros((0, 3), np.int64)]
        while len(idx := idx[after[idx] + d < end[idx]]):
            found.append(fitting(idx, after[idx] + d))
            d += 1
        out, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.record_batch([pa.array(np.ascontiguousarray(v)) for v in (out[:, 0], out[:, 1], n, out[:, 2])], names=["a", "b", "n", "due"])

    def run(batches):
        """Rows come sorted by probe; a probe's rows may span batches."""
        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in _ENTRY]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            last = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
            held = [x[last:] for x in own]
            if last:
                yield pairs(*(x[:last] for x in own))
        if held is not None and len(held[0]):
            yield pairs(*held)
        held = None
        common.give_back()

    return run


#: So many texts tell which shingles are common; only the order of the prefixes depends on them, not what is found.
SAMPLED, COMMON = 40_000, 400_000


def _common_hashes(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, that several of some SAMPLED texts have, and how many of these."""

    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.record_batch({"h": pa.array(np.unique(shingle_hashes(words_of(text), shingle)).view(np.int64))})

    share = min(1.0, SAMPLED / max(texts.count(), 1))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = (often.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


#: So many texts after each one, at each shingle, are beside it.
BESIDE = 4
#: So many texts, of 16 bytes each, are broadcast; they are counted first, and beyond them joined by shuffle.
ENDS = 500_000
#: The search by prefixes is done in so many parts by range of shingles, each with that share of its exchange's disk.
PARTS = 2


def _hot(texts: DataFrame) -> DataFrame | None:
    """probe, blocks of the shingles with more than BLOCK entries, to be broadcast if few; None if there are none."""
    # a task leaves out what it has but once, so this counts too few by the number of tasks at most: that deals
    # some values in one piece that two would hold, and changes no result
    hot = texts.select("comp", "prefix").mapInArrow(_repeated(), "probe long, n long, lo long, hi long")
    hot = hot.groupBy("probe").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("n") > BLOCK)
    hot = common.stored(hot.select("probe", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    n_hot = hot.limit(10_001).count()
    if not n_hot:
        return None
    return F.broadcast(hot) if n_hot <= 10_000 else hot


def _dealt(texts: DataFrame, hot: DataFrame | None, part: int, whole: bool = True) -> DataFrame:
    """The entries of a part, dealt and sorted by probe; those of hot probes once for each pair of blocks or, unless ``whole``, each in its own block alone."""
    entries = texts.mapInArrow(_entries(part, PARTS), ", ".join(f"{c} long" for c in _ENTRY))
    if hot is not None:
        split = entries.join(hot, "probe", "left")
        own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
        side = lambda x: F.when(x == own, 0).when(x < own, 1).otherwise(2).cast("long")
        block = lambda x: F.struct(F.xxhash64("probe", F.least(x, own), F.greatest(x, own)).alias("probe"), F.col("meta").bitwiseOR(side(x)).alias("meta"))
        met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), block) if whole else F.array(block(own))
        parts = F.when(F.col("blocks").isNull(), F.array(F.struct("probe", "meta"))).otherwise(met)
        entries = split.withColumn("part", F.explode(parts)).select("part.probe", "node", "comp", "part.meta", *PARITY)
    return entries.repartition(common.partitions(texts.sparkSession), "probe").sortWithinPartitions("probe")


def crossing_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of texts (node, comp, size, parities, prefix): every pair of different comp whose likeness reaches ``similarity``, and few others.

    Prefix filtering: in one order of all shingles, two sets of n and m with
    such a likeness share d of the first n - ceil(similarity n) + d of the one and
    of as many of the other; d grows with the size, so that large sets don't meet by
    chance. Sizes, places and parities of 256 bits bound the
    likeness from above. Shingles with more than BLOCK entries are dealt in blocks;
    those of one group alone are left out, as it is linked already.
    """
    found = None
    hot = _hot(texts)
    for part in range(PARTS):
        met = _dealt(texts, hot, part).mapInArrow(_crossing(similarity), "a long, b long, n long, due long")
        met = common.stored(met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("due").alias("due")), f"crossing-{part}")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("due").alias("due")).where("n >= due").select("a", "b")


def beside_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of the same texts, at most BESIDE for each entry: those of different comp that stand beside each other at a shingle.

    Not whole: of many texts alike, each meets a few at each of its shingles instead of all. What they link
    need not meet in ``crossing_pairs``, whose rows would else grow with the square of such a group.
    """
    return _dealt(texts, _hot(texts), 0, whole=False).mapInArrow(_crossing(similarity, beside=True), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 6, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of each doc_id: groups of texts linked by word-shingle likeness.

    Two texts are linked if the Jaccard likeness of their sets of shingles,
    computed from the whole texts, is ``similarity`` at least; no link is lost.
    First come the texts whose fingerprints, over distinct shingles, differ in at
    most ``bits`` places, of each probe value the closest ones and a spanning
    forest; this gathers most copies, but isn't whole. Then every pair of texts of
    different groups that prefix filtering can't rule out is verified. group_id is the smallest
    doc_id. Exact copies are always linked, null and wordless texts with each
    other; a null doc_id is in no group and has no row. Rows that repeat a doc_id are
    one document, for which the text with the least hash speaks. Other columns are
    ignored. An empty table gives no rows.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    hashed = own.select("doc_id", "text", F.xxhash64(text).alias("x"), F.crc32(text.cast("binary")).alias("y"))
    marked = common.stored(hashed.mapInArrow(_marked(shingle, similarity, *_common_hashes(own, shingle)), _MARKED), "marked")
    documents = marked.groupBy("doc_id").agg(F.min(F.struct("x", "y", "fp", "size", *PARITY)).alias("t")).select("doc_id", "t.*")
    documents = common.stored(documents, "documents")
    texts = documents.groupBy("x", "y", "fp", "size", *PARITY).agg(F.min("doc_id").alias("node"))
    texts = common.stored(texts, "texts")
    classes = common.stored(texts.groupBy("fp").agg(F.min("node").alias("node")), "classes")
    n, both = bit_counts(classes)
    if not n:
        return documents.select("doc_id", F.col("doc_id").alias("group_id"))

    def of(side: str) -> DataFrame:
        return texts.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", *PARITY)))

    def links(edges: DataFrame) -> DataFrame:
        """Of the candidates those that are links; sizes and parities rule out most of the others before the sets are compared."""
        sizes = [F.col("a_size"), F.col("b_size")]
        apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in PARITY[1:]), F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))))
        fair = (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-6) & (apart <= (sizes[0] + sizes[1]) * ((1 - similarity) / (1 + similarity)) + 1e-6)
        edges = common.stored(edges.join(of("a"), "a").join(of("b"), "b").where(fair).select("a", "b"), "candidates")
        ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        ends = common.stored(ends.join(texts.select("node", "x"), "node"), "ends")
        if ends.limit(ENDS + 1).count() <= ENDS:
            ends = F.broadcast(ends)
        sets = hashed.select(F.col("doc_id").alias("node"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.col("x")).otherwise(F.lit(0)).cast("long").alias("x"), "text").join(ends, ["node", "x"])
        sets = common.stored(sets.select("node", "text").mapInArrow(_sets(shingle), "node long, own binary").dropDuplicates(["node"]), "sets")
        sides = edges.join(sets.withColumnsRenamed({"node": "a", "own": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "own": "y"}), "b")
        found = common.stored(sides.select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long"), "links")
        common.discard(sets)  # as large as the texts, and done with
        return found

    near = near_edges(classes, bits, plan(n, both, bits), closest=True)
    least = classes.select("fp", "node")
    near = near.join(least.withColumnsRenamed({"fp": "a", "node": "na"}), "a").join(least.withColumnsRenamed({"fp": "b", "node": "nb"}), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    same = texts.join(least.withColumnRenamed("node", "least"), "fp").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    quick = links(near.unionByName(same))
    nodes = texts.join(components(quick), "node", "left").select("x", "y", "fp", F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("comp"))
    # rows that repeat both doc_id and text stay, as their pairs are within one group
    apart = marked.join(nodes, ["doc_id", "x", "y", "fp"]).select(F.col("doc_id").alias("node"), "comp", "size", *PARITY, "prefix")
    apart = common.stored(apart, "apart")
    common.discard(marked)
    beside = links(beside_pairs(apart, similarity))
    comp_of = nodes.select("doc_id", "comp")
    sides = beside.join(comp_of.withColumnsRenamed({"doc_id": "a", "comp": "ca"}), "a").join(comp_of.withColumnsRenamed({"doc_id": "b", "comp": "cb"}), "b")
    merged = components(sides.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnsRenamed({"node": "comp", "root": "to"})
    merged = common.stored(merged, "merged")
    if merged.limit(ENDS + 1).count() <= ENDS:
        merged = F.broadcast(merged)
    found = links(crossing_pairs(apart.join(merged, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"), similarity))
    common.discard(apart)
    comp = components(quick.unionByName(beside).unionByName(found))
    groups = texts.join(comp, "node", "left").select("x", "y", "fp", F.coalesce("root", "node").alias("group_id"))
    return documents.join(groups, ["x", "y", "fp"]).select("doc_id", "group_id")


def one_of_each(docs: DataFrame, shingle: int = 5, bits: int = 6, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they were, without those whose doc_id is not the smallest of its group."""
    gone = near_duplicates(docs, shingle, bits, similarity).where("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs.doc_id.cast("long") == F.col("__gone"), "left_anti")
