import pytest
from pyspark.sql import functions as F

from covalens.functions.variants import mutation_class
from covalens.operators import structural


@pytest.mark.parametrize(
    ("control", "test", "code"),
    [("./.", ".", 1), (".", "0/0", 2), ("./.", "0/2", 3), ("./.", "1/1", 4), ("./.", "1/2", 5), ("0/0", "./.", 11), ("0/0", "0/0", 12), ("0/0", "0/1", 13), ("0/0", "2/2", 14), ("0/0", "1/2", 15)]
    + [("0/1", "./.", 21), ("0/1", "0/0", 22), ("0/1", "0/1", 23), ("0/1", "1/1", 24), ("0/1", "1/2", 25), ("0/1", "0/2", 26), ("0/1", "2/2", 27), ("0/1", "2/3", 28)]
    + [("1/1", "./.", 31), ("1/1", "0/0", 32), ("1/1", "0/1", 33), ("1/1", "1/1", 34), ("1/1", "1/2", 35), ("1/1", "2/3", 36), ("1/1", "2/2", 37), ("1/1", "0/2", 38)]
    + [("1/2", "./.", 41), ("1/2", "0/0", 42), ("1/2", "0/1", 43), ("1/2", "0/2", 44), ("1/2", "1/1", 45), ("1/2", "2/2", 46), ("1/2", "1/2", 47), ("1/2", "3/4", 48), ("1/2", "0/3", 49), ("1/2", "3/3", 50), ("1/2", "1/3", 51), ("1/2", "2/1", 99)],
)
def test_mutation_class(spark, control, test, code):
    df = spark.createDataFrame([(control, test)], "c string, t string")
    assert df.select(mutation_class(F.col("c"), F.col("t")).alias("x")).first().x == code


def test_insert_size_bounds(spark):
    counts = [1, 1, 2, 40, 50, 60, 55, 50, 45, 3, 2, 1, 1]
    df = spark.createDataFrame([("g", 100 + 10 * i, n) for i, n in enumerate(counts)] + [("h", i, 5) for i in range(10)], "k string, size long, n long")
    assert [tuple(r) for r in structural.insert_size_bounds(df, "size", "n", "k").collect()] == [("g", 125, 195)]


def test_windows_on_the_border(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 10, "a"), ("x", 11, "b"), ("x", 25, "b")], "c string, s long, f string")
    lengths = spark.createDataFrame([("x", 27)], "contig string, length long")
    run = lambda label: sorted(tuple(r) for r in structural.copy_number_windows(df, "c", "s", "f", 10, lengths, ["a", "b"], label).collect())
    assert run(True) == [("x", 1, 10, 2, 0), ("x", 11, 20, 0, 1), ("x", 21, 27, 0, 1)]
    assert run(False) == [("x", 1, 10, 1, 0), ("x", 11, 20, 1, 1), ("x", 21, 27, 0, 1)]


def test_evidence_in_either_order(spark):
    clips = spark.createDataFrame([(1, "a", 100, "b", 500), (2, "b", 505, "a", 110), (3, "a", 100, "b", 900)], "id long, contig_a string, a long, contig_b string, b long")
    clusters = spark.createDataFrame([(9, "a", 150, "b", 550)], "id long, contig_a string, a long, contig_b string, b long")
    assert sorted(tuple(r) for r in structural.evidence(clips, clusters, 100).collect()) == [(1, 9, False), (2, 9, True)]


def test_metric_conditions(spark):
    df = spark.createDataFrame([(20, 100, 5.0, "A"), (19, 100, 5.0, "N")], "n long, total long, per double, alt string")
    r = df.select(structural.percent_passes(F.col("n"), F.col("total"), 20, F.col("per"), 4).alias("p"), structural.percent_passes(F.col("n"), F.col("total"), 20, F.col("per"), 4, strict=True).alias("s"), structural.snp_passes(F.col("n"), F.col("total"), F.col("n"), F.col("alt"), 10, 5, 5).alias("snp"), structural.strand_percent_bias(F.lit(5), F.lit(10), F.lit(1), F.lit(10), 10, 39).alias("b")).collect()
    assert [tuple(x) for x in r] == [(True, False, True, True), (False, False, False, True)]


def test_indel_filters(spark):
    columns = "somatic boolean, " + ", ".join(f"{p}_{x} long" for p in "ct" for x in ("coverage", "support", "partial", "novel", "forward", "reverse"))
    rows = [(True, 20, 0, 0, 0, 0, 0, 30, 8, 0, 5, 4, 4), (True, 11, 0, 3, 0, 0, 0, 7, 5, 3, 3, 5, 0), (False, 1001, 9, 0, 4, 4, 5, 1500, 9, 0, 9, 4, 5)]
    got = structural.indel_filters(spark.createDataFrame(rows, columns)).collect()
    assert [r.filters for r in got] == ["PASS", "COVT;COVN12;NPART;TPART;TBIAS;NNS", "HCOVN;HCOVT"]
