"""Suffix-array dedup, SimHash, containment search and winnowing against plain versions."""

import hashlib
import math

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from covalens.llm import decontaminate, simhash, suffix_dedup, winnow
from covalens.llm.graph import components

NONE = (1 << 63) - 1


@pytest.mark.parametrize("length", [17, 50, 101])
def test_suffix_dedup(docs, rows, length):
    want = brute.suffix_cut([(NONE if i is None else i, (t or "").encode()) for i, t, _ in rows], length)
    got = suffix_dedup.suffix_dedup(docs, length, carry=("lang",)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(rows[i][0]), *w) for i, w in want.items())
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sorted(str(r.rest.lang) for r in got) == sorted(str(x) for _, _, x in rows)


def test_suffix_dedup_over_segments(spark, monkeypatch):
    rng = np.random.default_rng(1)
    body = "".join(map(chr, rng.integers(97, 100, 3000)))
    rows = [(1, body), (2, body[700:1500] + "z" + body[900:2100]), (3, "y" + body[-60:] + body[:49])]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 211)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()}
    want = brute.suffix_cut([(i, t.encode()) for i, t in rows], 50)
    assert got == {rows[i][0]: w for i, w in want.items()}


def suffix_passes(rows, mixed, groups=3, buckets=5, length=50):
    """The passes of ``suffix_dedup`` in this process; ``mixed`` orders a group's blobs anew for each pass."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    def blob(own):
        part, sink = pa.table({"key": [i for i, _ in own], "doc_id": [i for i, _ in own], "text": [t for _, t in own]}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        return zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes())

    blobs = [[blob(rows[i : i + 2]) for i in range(2 * g, len(rows), 2 * groups)] for g in range(groups)]

    def sent(step, *replies):
        of = lambda g: [r.filter(pc.equal(r["grp"], g)) for r in replies]
        return pa.concat_tables([step((pa.scalar(g),), pa.table({"grp": [g] * len(b), "blob": mixed(b)}), *of(g)) for g, b in enumerate(blobs)])

    def answered(blocks):
        own = [blocks.filter(pc.equal(blocks["bucket"], b)) for b in sorted(set(blocks["bucket"].to_pylist()))]
        return pa.concat_tables([suffix_dedup._answer((x["kind"][0], x["bucket"][0]), x) for x in own])

    replies = answered(sent(suffix_dedup._first(length, buckets)))
    for part in range(suffix_dedup.PARTS):
        replies = pa.concat_tables([replies, answered(sent(suffix_dedup._second(length, buckets, part), replies))])
    got = sent(suffix_dedup._last(length, buckets, False), replies).to_pylist()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}


@pytest.fixture
def repeats():
    """Texts that share passages, with the same beginnings before different ends, and what is to be cut."""
    rng = np.random.default_rng(2)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [prose(n) for n in (30, 49, 55, 90, 400)]
    rows = [(int(i), "".join(shared[j] + prose(int(rng.integers(0, 40))) for j in rng.integers(0, 5, 4))) for i in rng.permutation(24)]
    want = brute.suffix_cut([(i, t.encode()) for i, t in rows], 50)
    return rows, {rows[i][0]: w for i, w in want.items()}


def test_suffix_dedup_makes_runs_twice(monkeypatch, repeats):
    rows, want = repeats
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 18)
    calls, segment = [], suffix_dedup._segment
    monkeypatch.setattr(suffix_dedup, "_segment", lambda *args: calls.append(1) or segment(*args))
    assert suffix_passes(rows, lambda blobs: blobs) == want
    assert len(calls) == 2 * 3  # a segment in each of three groups


def test_suffix_dedup_whatever_order_blobs_arrive_in(monkeypatch, repeats):
    rows, want = repeats
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 211)
    rng = np.random.default_rng(3)
    for _ in range(5):
        assert suffix_passes(rows, lambda blobs: [blobs[i] for i in rng.permutation(len(blobs))]) == want


def test_simhash_components(docs, rows):
    got = simhash.simhash_components(docs).collect()
    fps = [brute.simhash(t, 4) for _, t, _ in rows]
    assert sorted(r.fingerprint for r in got) == sorted(f"{x:016x}" for x in fps)
    root = brute.components(set(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        key = NONE if i is None else i
        least[root[f]] = min(least.get(root[f], NONE), key)
    want = sorted((str(i), f"{f:016x}", str(least[root[f]])) for (i, _, _), f in zip(rows, fps, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize(("bits", "block"), [(4, 1500), (7, 20), (12, 1500)])
def test_pigeonhole_loses_no_link(spark, monkeypatch, bits, block):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(int(x) for x in seeds)
    for s in seeds:
        for _ in range(6):
            flip = rng.choice(64, rng.integers(1, bits + 2), replace=False)
            fps.add(int(s) ^ sum(1 << int(b) for b in flip))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BLOCK", block)
    classes = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long")
    n, both = simhash.bit_counts(classes)
    assert n == len(fps) and np.diag(both).sum() == sum(x.bit_count() for x in fps)
    chosen = simhash.plan(n, both, bits)
    assert sum(t + 1 for _, t in chosen) >= bits + 1
    got = {r.node % (1 << 64): r.root for r in components(simhash.near_edges(classes, bits, chosen)).collect()}
    root = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    groups = {}
    for x in fps:
        groups.setdefault(root[x], []).append(x)
    assert all(len({got.get(x, x) for x in g}) == 1 for g in groups.values())
    assert len({got.get(x) for x in fps if x in got}) == sum(len(g) > 1 for g in groups.values())


def test_near_duplicates(docs, rows):
    own = [(i, t) for i, t, _ in rows if i is not None]
    sets = {i: set(brute.shingles(t, 5)) for i, t in own}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = brute.components(set(sets), alike)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.where("doc_id is not null").collect()}) == sorted(set(want.values()))


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_containment(spark, docs, rows):
    texts = {1: " ".join((rows[6][1] + " " + rows[7][1]).split()[:40]).upper(), 2: "one", 3: None, 4: "absent words here in this item only", 5: " ".join(rows[8][1].split()[:3])}
    inserted = [(80, "before it! " + texts[1] + ", and after"), (81, " ".join(texts[1].split()[:34])), (82, " ".join(texts[1].split()[:20]))]
    items = spark.createDataFrame([*texts.items(), (1, texts[1])], "item_id long, text string").withColumn("need", F.lit(1))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(inserted, "doc_id long, text string"))
    want = set()
    for i, t in [(i, t) for i, t, _ in rows] + inserted:
        have = brute.plain_shingles(t, 5)
        for item, x in texts.items():
            need = brute.plain_shingles(x, 5)
            if need and len(need & have) >= 0.8 * len(need) - 1e-9:
                want.add((i, item, len(need), len(need & have)))
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in decontaminate.contained_items(more, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {80, 81} <= {x[0] for x in got}
    clean = decontaminate.decontaminated(more, items)
    holds = lambda t: any(x and len(x & brute.plain_shingles(t, 5)) >= 0.8 * len(x) - 1e-9 for x in (brute.plain_shingles(x, 5) for x in texts.values()))
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t, *_ in [*rows, *inserted] if not holds(t))


def test_rows_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight"
    rows = [(7, item + " more"), (7, "clean"), (None, "before " + item), (None, "clean too"), (None, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))


def test_only_sketches_make_candidates(spark, monkeypatch):
    """A document with fewer than the sketch's due is no candidate, however many of the other shingles it has; those with enough all are."""
    rng = np.random.default_rng(0)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 84)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    sets = spark.createDataFrame([(list(range(n)),) for n in (1, 2, 7, 8, 31, 80)], "all array<int>")
    got = [(r.n_shingles, r.need, r.meet, r.sketch) for r in decontaminate.sketched(sets, 0.8).orderBy("n_shingles").collect()]
    assert got == [(1, 1, 1, 1), (2, 2, 1, 1), (7, 6, 1, 2), (8, 7, 2, 3), (31, 25, 3, 9), (80, 64, 5, 21)]
    seen = []
    monkeypatch.setattr(decontaminate.common, "stored", lambda df, tag, f=decontaminate.common.stored: seen.append((tag, f(df, tag))) or seen[-1][1])
    docs = [(cut, " ".join(words[cut:])) for cut in range(60)]
    found = {r.doc_id for r in decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), item).collect()}
    candidates = {r.doc_id for r in dict(seen)["candidates"].collect()}
    assert found == {cut for cut in range(60) if 80 - cut >= 64} and found <= candidates < set(range(60))


def test_containment_beyond_the_broadcast_bound(monkeypatch, docs, rows, spark):
    items = spark.createDataFrame([(1, rows[6][1]), (2, rows[7][1])], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contained_items(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert want and sorted(map(tuple, decontaminate.contained_items(docs, items).collect())) == want


def test_no_python_on_the_native_paths(docs, spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (decontaminate.contained_items(docs, items), winnow.fingerprinted(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def in_order(rows):
    """By descending doc_id, null last; rows of one doc_id by the signed hash of the text, then the text."""
    mark = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    return sorted(((NONE_LAST if i is None else i, t or "") for i, t, *_ in rows), key=lambda x: (x[0], mark(x[1]), x[1]), reverse=True)


NONE_LAST = -(1 << 63)


def plain_fingerprints(rows, k, w):
    own = in_order(rows)
    out = []
    for at, (i, t) in enumerate(own):
        following = own[(at + 1) % len(own)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        f, fe, fn = (brute.winnowed(x, k, w) for x in (t, edited, following))
        digest = lambda x: hashlib.sha256(",".join(f"{h:X}:{p}" for h, p in x).encode()).hexdigest()
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(f), digest(fe), brute.likeness(f, fe), brute.likeness(f, fn)))
    return sorted(out)


def got_fingerprints(df, **options):
    return sorted((NONE_LAST if r.doc_id is None else r.doc_id, *r[1:]) for r in winnow.fingerprinted(df, **options).collect())


@pytest.mark.parametrize(("k", "w"), [(5, 4), (1, 1), (3, 7), (8, 2)])
def test_fingerprints(docs, rows, k, w):
    assert got_fingerprints(docs, k=k, w=w) == plain_fingerprints(rows, k, w)


@pytest.mark.parametrize(("partitions", "frames"), [("4", 0), ("12", 1), ("12", 2), ("40", 5)])
def test_fingerprints_whatever_went_before(spark, partitions, frames):
    """Neither earlier frames (expression ids) nor the number of ranges matter; hot and null ids are dealt further."""
    rows = [(i % 700 if i % 3 else (None if i % 2 else 5), f"t{i % 50} " * (i % 30)) for i in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for _ in range(frames):
            spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumn("y", F.lit(1))
        assert got_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")) == plain_fingerprints(rows, 5, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_is_its_own_next(spark):
    for rows in ([(7, "a b c d e f g h i")], [(None, None)]):
        assert got_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")) == plain_fingerprints(rows, 5, 4)


def test_winnowing_guarantee_and_rightmost_ties(spark):
    k, w = 5, 4
    df = spark.createDataFrame([("p q r s t u v w x y",), ("1 2 p q r s t u v w 3 4",), ("a " * 12,)], "text string")
    a, b, ties = [r.f for r in winnow.winnowed(df, "text", "f", k, w).collect()]
    assert {x.hash for x in a} & {x.hash for x in b}  # eight words in common are w + k - 1
    # all grams are equal: each window chooses its last
    assert [x.pos for x in ties] == [3, 4, 5, 6, 7]


def test_empty_tables(empty, spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (suffix_dedup.suffix_dedup(empty), simhash.simhash_components(empty), simhash.near_duplicates(empty), simhash.one_of_each(empty), decontaminate.contained_items(empty, items), winnow.fingerprinted(empty)):
        assert df.count() == 0


def near_groups(spark, texts):
    sets = {i: set(brute.shingles(t, 5)) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    got = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return {r.doc_id: r.group_id for r in got}, brute.components(set(sets), alike)


def test_near_duplicates_beyond_the_fingerprint_radius(spark):
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        at = int(rng.integers(5, 170))
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join([*words[:at], *(f"v{x}" for x in rng.integers(0, 1 << 40, 18)), *words[at + 18 :]])
    for i in range(100, 120, 2):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 70)]
        texts[i], texts[i + 1] = " ".join(words), " ".join(words + words[-10:] * 11)
    fps = {i: brute.simhash(t, 5) for i, t in texts.items()}
    assert sum((fps[i] ^ fps[i + 1]).bit_count() > 12 for i in texts if i % 2 == 0) > 5
    got, want = near_groups(spark, texts)
    assert all(want[i + 1] == i for i in texts if i % 2 == 0) and got == want


@pytest.mark.parametrize("block", [1500, 20])
def test_near_duplicates_among_candidates_that_fail(spark, monkeypatch, block):
    """All fingerprints are equal, so that a spanning forest of the candidates has hardly any of the links."""
    rng = np.random.default_rng(4)
    template = [f"w{x}" for x in range(150)]
    texts = {}
    for i in range(60):
        words = [*template[:75], *(f"v{x}" for x in rng.integers(0, 1 << 40, 30)), *template[75:]]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join([*words[:-3], "end", str(i)])
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_fingerprints", lambda hashes: np.zeros(len(hashes), np.uint64))
    got, want = near_groups(spark, texts)
    assert all(want[i] == i - i % 2 for i in texts) and got == want


def test_alike_sets_share_what_is_due():
    """Sets whose likeness reaches the threshold share enough shingles of their prefixes, whatever their sizes and the order."""
    rng = np.random.default_rng(6)
    met = 0
    for n in [int(x) for x in np.geomspace(3, 6000, 200)]:
        out = 2 * n // 9  # differing shingles in all: a likeness of 0.8 just about
        gone = int(rng.integers(0, out + 1))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, out - gone, dtype=np.uint64)])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        weight = lambda s: (s % np.uint64(7)).astype(np.int64)
        cut = lambda s: s[np.lexsort((s, weight(s)))][: len(s) - math.ceil(0.8 * len(s) - 1e-9) + simhash._due(len(s))]
        met += 1
        assert len(np.intersect1d(cut(a), cut(b))) >= simhash._due(min(len(a), len(b)))
    assert met > 100
