import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from covalens.functions import sequence, text, variants
from covalens.operators import align, callers, clusters, intervals, pileup, profile
from covalens.operators.intervals import Spans

CASES = [("x", 1, 5), ("x", 6, 9), ("x", 3, 4), ("x", 3, 4), ("x", 4090, 4100), ("x", 20000, 20000), ("y", 1, 1), ("y", 5, 2), (None, 1, 2), ("y", None, 3)]


def spans(spark, rows):
    return spark.createDataFrame(rows, "contig string, start long, end long")


def points(rows):
    return [(c, p) for c, s, e in rows if c is not None and s is not None and e is not None for p in range(s, e + 1)]


def brute_runs(covered):
    out = []
    for c, p in sorted(set(covered)):
        if out and out[-1][0] == c and out[-1][2] == p - 1:
            out[-1][2] = p
        else:
            out.append([c, p, p])
    return sorted(map(tuple, out))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_and_gaps(spark):
    assert rows(intervals.merge(Spans(spans(spark, CASES)))) == brute_runs(points(CASES))
    assert rows(intervals.gaps(Spans(spans(spark, CASES)))) == [("x", 10, 4089), ("x", 4101, 19999)]
    lengths = spark.createDataFrame([("x", 20001), ("y", 3), ("z", 2)], "contig string, length long")
    assert rows(intervals.gaps(Spans(spans(spark, CASES)), lengths)) == [("x", 10, 4089), ("x", 4101, 19999), ("x", 20001, 20001), ("y", 2, 3), ("z", 1, 2)]
    assert rows(intervals.merge(Spans(spans(spark, [])))) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(1, 60), st.integers(0, 25)), max_size=12), st.lists(st.tuples(st.sampled_from("xy"), st.integers(1, 60), st.integers(0, 25)), max_size=8))
def test_against_brute_force(spark, a, b):
    a, b = [(c, s, s + n) for c, s, n in a], sorted({(c, s, s + n) for c, s, n in b})
    left, right = Spans(spans(spark, a)), Spans(spans(spark, b))
    hit = lambda x, y: x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]
    joined = intervals.overlap_join(left, right, width=8)
    assert sorted((tuple(r.a), tuple(r.b)) for r in joined.collect()) == sorted((x, y) for x in a for y in b if hit(x, y))
    assert rows(intervals.semi_join(left, right)) == sorted(x for x in a if any(hit(x, y) for y in b))
    assert rows(intervals.anti_join(left, right)) == sorted(x for x in a if not any(hit(x, y) for y in b))
    assert rows(intervals.merge(left, width=8)) == brute_runs(points(a))
    named = spark.createDataFrame([(f"{c}{s}_{e}", c, s, e) for c, s, e in b], "name string, contig string, start long, end long")
    depth = {}
    for p in points(a):
        depth[p] = depth.get(p, 0) + 1
    wanted = {}
    for c, s, e in b:
        for p in range(s, e + 1):
            key = (f"{c}{s}_{e}", depth.get((c, p), 0))
            wanted[key] = wanted.get(key, 0) + 1
    got = intervals.coverage_histogram(left, Spans(named), "name")
    assert {(r.name, r.depth): r.bases for r in got.collect()} == wanted


def test_low_depth_closes_at_the_feature(spark):
    f = spark.createDataFrame([("f", "x", 3, 12)], "name string, contig string, start long, end long")
    assert rows(intervals.low_depth(Spans(spans(spark, CASES)), Spans(f), "name", 1)) == [("f", "x", 10, 12)]


def test_interval_predicates(spark):
    df = spark.createDataFrame([(1, 5, 6, 9), (1, 5, 5, 9), (1, 9, 3, 4), (4, 4, 4, 4)], "a long, b long, c long, d long")
    x, y = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    got = df.select(intervals.overlaps(x, y), intervals.overlaps(x, y, 1), intervals.contains(x, y), intervals.adjacent(x, y), intervals.within_delta(x, y, 4), intervals.overlap_length(x, y), intervals.overlap_length(x, y, False)).collect()
    assert [tuple(r) for r in got] == [(False, True, False, True, False, 0, 0), (True, True, False, False, False, 1, 0), (True, True, True, False, False, 2, 1), (True, True, True, False, True, 1, 0)]


def test_physical_coverage(spark):
    df = spark.createDataFrame([("x", 1, 10, 15, 20), ("x", 1, 30, 35, -20), ("x", 0, 50, 59, 0)], "rname string, flag int, pos long, end long, tlen long")
    assert rows(intervals.physical(df)) == [("x", 10, 30), ("x", 50, 59)]


READS = [
    ("r1", 0, "1", 10, "3S4M1D2M", "AAACGTACC", "IIIIIIIII"),
    ("r2", 16, "1", 12, "2M1I3M", "GTACGT", "555555"),
    ("r1", 16, "1", 10, "4M", "CGTT", "####"),
]


def test_pileup(spark):
    reads = spark.createDataFrame(READS, "qname string, flag int, rname string, pos long, cigar string, seq string, qual string")
    b = pileup.bases(reads)
    got = {(r.qname, r.reverse, r.pos): (r.base, r.qual) for r in b.collect()}
    assert [got[("r1", False, p)][0] for p in (10, 11, 12, 13, 15, 16)] == list("CGTACC")
    assert ("r1", False, 14) not in got
    assert [got[("r2", True, p)][0] for p in (12, 13, 14, 15, 16)] == list("GTCGT")
    ends = reads.select(pileup.reference_end(F.col("pos"), F.col("cigar")).alias("e")).collect()
    assert [r.e for r in ends] == [16, 16, 13]
    at = reads.select(pileup.index_at(F.col("pos"), F.col("cigar"), F.lit(14)).alias("i"), pileup.index_at(F.col("pos"), F.col("cigar"), F.lit(15)).alias("j")).collect()
    assert [(r.i, r.j) for r in at] == [(-1, 7), (3, 4), (-1, -1)]
    left = pileup.without_overlaps(b).where("qname = 'r1'").collect()
    # at 13 the mates differ (A and T); at 10 to 12 they agree, the strands too few to crowd: the reverse one goes on 12
    assert sorted({r.pos for r in left}) == [10, 11, 12, 15, 16]
    counts = {(r.pos, r.base): (r.fwd, r.rev, r.novel) for r in pileup.by_base(b).collect()}
    assert counts[(10, "C")] == (1, 1, 2)
    assert {r.pos: r.oabs for r in pileup.observed_text(pileup.by_base(b)).collect()}[10] == "C1[40.0]1[2.0]"
    vote = {r.pos: r.genotype for r in pileup.voted(pileup.by_base(b), 1, 5.0).collect()}
    assert vote[15] == "C/G" and vote[10] == "C/C"


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN", "ACGAN")], "a string, b string")
    r = df.select(
        sequence.reverse_complement(F.col("a")).alias("rc"), sequence.hamming(F.col("a"), F.col("b")).alias("h"), sequence.common_prefix_length(F.col("a"), F.col("b")).alias("p"), sequence.tile_code(F.lit("CAT")).alias("t"),
        sequence.tile_code(F.col("a")).alias("bad"), sequence.from_tile_code(sequence.tile_code(F.lit("GATTA")), 5).alias("back"), sequence.alleles_of(F.lit("R")).alias("iupac"), sequence.longest_run(F.lit("AATTTAT"), F.lit("T")).alias("run"),
        sequence.block_counts(F.lit("TTATT"), "T").alias("blocks"), sequence.complexity(F.lit("AACG")).alias("c"), sequence.merged_pair(F.lit("AAAACCCC"), F.lit("CCCCGG"), 4).alias("m"), sequence.kmers(F.lit("ABCD"), 3).alias("k"),
        sequence.edit_to_primer(F.lit("ACGTTT"), F.lit("AGG"), 0).alias("e"), sequence.shifted_qualities(F.lit("!I"), 1).alias("q"),
    ).first()
    assert (r.rc, r.h, r.p, r.t, r.bad, r.back, r.iupac, r.run, tuple(r.blocks), r.c, r.m, r.k) == ("NACGT", 1, 3, 1 + 0 + 48, -1, "GATTA", ["A", "G"], 3, (2, 4), 3, "AAAACCCCGG", ["ABC", "BCD"])
    assert r.e == 2**31 - 1 and r.q == '"J'


def test_text_functions(spark):
    df = spark.createDataFrame([("a=1;b;c=x=y;a=2",), (".",), (None,)], "v string")
    got = [r[0] for r in df.select(text.info_text(text.info_map(F.col("v")))).collect()]
    assert got == ["a=2;b;c=x=y", ".", "."]
    r = df.limit(1).select(
        text.first_tokens(F.lit("a\tb\tc\td"), 2).alias("p"), text.first_tokens(F.lit("a\tb\tc\td"), 2, rest=True).alias("t"), text.value_of(F.lit("k=1\tm=2"), "k").alias("v"), text.value_of(F.lit("k=1"), "z").alias("none"),
        text.appended(F.lit("ab"), F.lit("b")).alias("a1"), text.appended(F.lit("."), F.lit("b")).alias("a2"), text.padded(F.lit("abc"), 2).alias("pad"), text.position(F.lit("chr1:5-9")).alias("pos"), text.is_integer(F.lit("-12")).alias("i"),
        text.number_or_zero(F.lit("x")).alias("z"), text.occurrences(F.lit("aXbX"), "X").alias("o"), text.with_prefix(F.lit("MT")).alias("m"), text.without_prefix(F.lit("chrM")).alias("w"),
    ).first()
    assert (r.p, r.t, r.v, r.none, r.a1, r.a2, r.pad, tuple(r.pos), r.i, r.z, r.o, r.m, r.w) == (["a", "b"], ["a", "b", "c\td"], "1", None, "ab", "b", "abc", ("chr1", 5, 9), True, 0.0, 2, "chrM", "MT")
    names = spark.createDataFrame([(x,) for x in ("chr10", "chr2", "chrM", "chrX", "GL1", "1")], "c string")
    assert [r.c for r in names.orderBy(text.contig_rank(F.col("c"))).collect()] == ["1", "chr2", "chr10", "chrX", "chrM", "GL1"]


def test_variant_functions(spark):
    cases = [("A", "G", "SNP"), ("AC", "GT", "DNP"), ("ACG", "TTT", "TNP"), ("ACGT", "TTTT", "ONP"), ("A", "AT", "INS"), ("AT", "A", "DEL"), ("AT", "CGA", "CTX"), ("A", "G,T", "SNP"), ("A", "G,TT", "UNKNOWN"), ("A", "A" * 200, "UNKNOWN")]
    df = spark.createDataFrame(cases, "ref string, alt string, want string")
    assert all(r.got == r.want for r in df.select("want", variants.variant_type(F.col("ref"), F.col("alt")).alias("got")).collect())
    counts = spark.createDataFrame([(10, 0, 0, 0, "AA"), (9, 1, 0, 0, None), (5, 5, 0, 0, "AC"), (3, 7, 0, 0, None), (4, 0, 6, 0, "AG"), (5, 0, 0, 4, None)], "a int, c int, g int, t int, want string")
    got = counts.select("want", variants.coded_genotype(*map(F.col, "acgt")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    r = df.limit(1).select(
        variants.classified(F.lit("A/A"), F.lit("A/G"), F.lit("A")).alias("s"), variants.classified(F.lit("A/G"), F.lit("G/G"), F.lit("A")).alias("g"), variants.classified(F.lit("./."), F.lit("G/G"), F.lit("A")).alias("u"),
        variants.mutation_in_normal(F.lit(3), F.lit(100), 3, 5.0).alias("n"), variants.mutation_in_normal(F.lit(5), F.lit(100), 3, 5.0).alias("y"), variants.observed_alleles(F.lit("A10[30]5[30];C0[0]2[25]")).alias("o"),
        variants.gt_index(F.lit("T"), F.lit("G,T"), F.lit("A")).alias("i"), variants.same_genotype(F.lit("0/1"), F.lit("1|0")).alias("same"), variants.strand_bias(F.lit(1), F.lit(3), 25).alias("strict"),
        variants.strand_bias(F.lit(1), F.lit(3), 25, False).alias("loose"), variants.split_compound(F.lit(5), F.lit("AC"), F.lit("GT")).alias("c"), callers.reindexed(F.lit("0/1"), F.lit("T"), F.lit("G,T")).alias("gt"),
        variants.allele_depths(F.lit("A"), F.lit("C,T"), variants.observed_alleles(F.lit("A10[30]5[30];C0[0]2[25]"))).alias("ad"),
    ).first()
    assert (r.s, r.g, r.u, r.n, r.y, r.o, r.i, r.same, r.strict, r.loose, r.gt, r.ad) == ("SOMATIC", "GERMLINE", "UNKNOWN", False, True, {"A": 15, "C": 2}, 2, True, False, True, "0/2", "15,2,0")
    assert [tuple(x) for x in r.c] == [(5, "A", "G"), (6, "C", "T")]


def test_smith_waterman():
    assert align.smith_waterman("ACGT", "ACGT") == (20.0, "ACGT", "||||", "ACGT")
    score, top, middle, bottom = align.smith_waterman("AAACCCCCGGGTTT" * 2, "AAACCCCCTGGGTTT" * 2)
    assert top.replace("-", "") in "AAACCCCCGGGTTT" * 2 and len(top) == len(middle) == len(bottom) and score > 50
    assert align.smith_waterman("", "A") == (0.0, "", "", "") and align.smith_waterman("A", "C")[0] == 0


def test_collapse(spark):
    df = spark.createDataFrame([(x,) for x in ["AAAA"] * 3 + ["CCCC"] * 2 + ["AAAT", "GGGG", "AACC", None]], "s string")
    assert rows(align.collapsed(df, "s")) == [("AAAA", 4), ("AACC", 1), ("CCCC", 2), ("GGGG", 1)]


def test_clusters(spark):
    random.seed(3)
    pairs = [("a", random.randint(1, 300), "b", random.randint(1, 40)) for _ in range(120)]
    df = spark.createDataFrame(pairs, "contig_a string, a long, contig_b string, b long")
    got = rows(clusters.pair_clusters(df, 8, 3))
    free, wanted = sorted((a, b) for _, a, _, b in pairs), []
    used = [False] * len(free)
    for i, (a, b) in enumerate(free):
        if used[i]:
            continue
        own = [j for j in range(i, len(free)) if not used[j] and free[j][0] - a <= 8 and abs(free[j][1] - b) <= 8]
        used[i] = True
        if len(own) >= 3:
            for j in own:
                used[j] = True
            wanted.append(("a", "b", a, len(own), min(free[j][0] for j in own), max(free[j][0] for j in own), min(free[j][1] for j in own), max(free[j][1] for j in own)))
    assert got == sorted(wanted)


def test_quartiles_by_place(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    r = profile.quartiles(df.withColumn("k", F.lit(1)), "v", "k").first()
    assert (r.q1, r.q3) == (1.5, 52.0)


@pytest.mark.parametrize(("share", "bin_"), [(0.0, 0), (0.02, 0), (0.021, 1), (0.04, 1), (1.0, 49)])
def test_border_goes_down(spark, share, bin_):
    df = spark.createDataFrame([(share,)], "v double")
    assert profile.binned(df, F.col("v"), 0.02).first()["bin"] == bin_


def plain_score(a, b):
    h, up, left = ([[0 if t == 0 else -1e9] * (len(b) + 1) for _ in range(len(a) + 1)] for t in range(3))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            up[i][j] = max(up[i - 1][j] - 4, h[i - 1][j] - 16)
            left[i][j] = max(left[i][j - 1] - 4, h[i][j - 1] - 16)
            h[i][j] = max(0, h[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4), up[i][j], left[i][j])
    return max(map(max, h))


def line_score(top, bottom):
    """What the lines of an alignment score; each run of gaps opens once."""
    total = 0
    for k, (x, y) in enumerate(zip(top, bottom, strict=True)):
        if "-" in (x, y):
            side = top if x == "-" else bottom
            total -= 4 if k and side[k - 1] == "-" else 16
        else:
            total += 5 if x == y else -4
    return total


def test_local_alignment_of_whole_items(spark, tmp_path):
    from covalens.plans.queries import local_alignment

    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("acgté", k=n))
    tail, long = word(60), word(200)
    texts = {1: word(140) + tail, 2: word(170) + tail[:25] + "ac" + tail[25:], 3: long, 4: long[:90] + long[95:] + word(30), 5: word(30)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query"], r["target"]): r for r in local_alignment(spark, str(tmp_path)).collect()}
    assert {(1, 2), (3, 4)} <= set(got)
    for (i, j), r in got.items():
        assert r.score == plain_score(texts[i], texts[j]) == line_score(r.top, r.bottom)
        assert r.top.replace("-", "") in texts[i] and r.bottom.replace("-", "") in texts[j]
    assert got[1, 2].score > 200


@given(st.text("acg", max_size=14), st.text("acg", max_size=14))
@settings(max_examples=150, deadline=None)
def test_smith_waterman_scores(a, b):
    score, top, _, bottom = align.smith_waterman(a, b)
    assert score == plain_score(a, b) == line_score(top, bottom)
    assert top.replace("-", "") in a and bottom.replace("-", "") in b


def test_tiled_lookup_of_frequent_kmers(spark, tmp_path):
    import duckdb

    from covalens.plans.queries import ORACLES, tiled_lookup

    texts = [(1, "ab" * 2700), (2, "ab" * 2700), (3, "ab" * 8)]  # each k-mer has over 5,000 places
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["tiled_lookup"]).fetchall())
    assert len(want) == 9 and sorted((r["query"], r.target, r.n) for r in tiled_lookup(spark, str(tmp_path)).collect()) == want
