"""Annotation texts, probes, regions and clipped ends on small cases."""

from pyspark.sql import functions as F

from covalens.functions import annotations
from covalens.operators import panels


def test_search_term_edges(spark):
    rows = [("c.35G>A", "p.Gly12"), (None, None), ("", ""), ("c.35del", None), (None, "Gly12"), ("n.1.2A>T", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, p string").select(annotations.search_term(F.col("c"), F.col("p"))).collect()]
    assert got[0] == '"GENE"+("35G>A"|"35G->A"|"35G-->A"|"35G/A"|"Gly12")'
    assert got[1:5] == ["", "", "", '"GENE"+("Gly12")']
    assert got[5].startswith('"GENE"+("1.2A>T"|')


def test_mismatch_tags(spark):
    rows = [("ACGT", "ACGT"), ("ACGT", "TCGA"), ("AC-GT", "ACAGT"), ("ACGTA", "A--CA"), ("", ""), ("ACG", "AC"), (None, "A")]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "a string, b string").select(annotations.mismatch_tags(F.col("a"), F.col("b"))).collect()]
    assert got == [("4", 0), ("0A2T0", 2), ("4", 1), ("1^CG0T1", 3), ("0", 0), None, None]


def test_probes_found_prefers_the_longest(spark):
    reads = spark.createDataFrame([(1, "ACGTAA"), (2, "ACGA"), (3, "T"), (4, None), (5, "")], "id long, seq string")
    probes = spark.createDataFrame([("p2", "ACG"), ("p1", "ACG"), ("p3", "ACGT"), ("p4", ""), ("p5", None)], "probe string, primer string")
    got = {r.id: (r.probe, r.size) for r in panels.probes_found(reads, probes).collect()}
    assert got == {1: ("p3", 4), 2: ("p1", 3), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert panels.probes_found(reads, probes.limit(0)).where("probe is null").count() == 5


def test_regions_ask_for_slack_at_the_end_alone(spark):
    region = spark.createDataFrame([("a", 100, 200)], "contig string, start long, end long")
    fragments = spark.createDataFrame([("a", 100, 211), ("a", 100, 210), ("a", 101, 400), ("b", 1, 900), (None, 1, 900)], "contig string, start long, end long")
    assert [(r.b.start, r.b.end) for r in panels.regions_of(fragments, region).collect()] == [(100, 211)]


def test_clip_consensus(spark):
    rows = [(1, False, "ACG"), (1, False, "ACT"), (1, False, "AGT"), (2, False, "AC"), (2, False, "CC"), (1, True, "AAC"), (3, False, None), (3, False, "A")]
    got = {(r.place, r.reverse): (r.clips, r.consensus) for r in panels.clip_consensus(spark.createDataFrame(rows, "place long, reverse boolean, clip string"), ["place"], 2).collect()}
    assert got == {(1, False): (3, "ACT"), (2, False): (2, "NC"), (1, True): (1, "GTT")}
