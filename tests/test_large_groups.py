"""Joins in which many rows share a place: the same results as a plain search, with work that follows the results."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from covalens.operators import panels, signature, structural


def metric(df, node, name):
    """The sum of a metric over the nodes of that name, after df was collected."""

    def walk(plan):
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in kind:
            return walk(plan.plan())
        own = plan.metrics().get(name) if node in kind else None
        children = plan.children()
        return (own.get().value() if own is not None and own.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


SIDES = "id long, contig_a string, a long, contig_b string, b long"


@pytest.mark.parametrize("reach", [0, 3])
def test_evidence_as_by_plain_search(spark, reach):
    rng = random.Random(3)
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.randrange(-30, 30), rng.choice(["a", "b"]), rng.choice([None, *range(-30, 30)]))
    clips, clusters = [row(i) for i in range(200)], [row(1000 + i) for i in range(200)]
    near = lambda x, y: None not in (*x, *y) and x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) <= reach and abs(x[3] - y[3]) <= reach
    expected = {(i, j): not near(x, y) for (i, *x), (j, *y) in itertools.product(clips, clusters) if near(x, y) or near(x[2:] + x[:2], y)}
    got = structural.evidence(spark.createDataFrame(clips, SIDES), spark.createDataFrame(clusters, SIDES), reach).collect()
    assert expected and len(got) == len(expected) and {(r.clip, r.cluster): r.turned for r in got} == expected


def test_evidence_is_dealt_by_both_breakpoints(spark):
    sides = spark.createDataFrame([(1, "a", 1, "b", 2)], SIDES)
    assert re.search(r"Join \[ca#\d+, cb#\d+, x#\d+L, y#\d+L\]", structural.evidence(sides, sides, 3)._jdf.queryExecution().toString())


def test_regions_counted_as_by_plain_search(spark):
    rng = random.Random(5)
    spans = [(rng.choice(["a", "b", None]), s := rng.randrange(-20, 60), s + rng.choice([-1, 0, 3, 9, 40])) for _ in range(120)]
    fragments = [(i, c, s, rng.choice([s + 15, s + 70, s - 5, None])) for i, (c, s, _) in enumerate(spans)]
    expected = {}
    for i, c, s, e in fragments:
        inside = [x for d, x, y in spans if e is not None and None not in (c, d) and c == d and s <= x <= y and e > y + 10]
        if inside:
            expected[i] = (len(inside), min(inside))
    regions = spark.createDataFrame(spans, "contig string, start long, end long")
    got = panels.regions_counted(spark.createDataFrame(fragments, "id long, contig string, start long, end long"), regions).collect()
    assert expected and len(got) == len(expected) and {r.id: (r.n, r.first) for r in got} == expected


def test_regions_alike_meet_once(spark):
    many = lambda end: spark.range(2000).select("id", F.lit("a").alias("contig"), F.lit(5).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    out = panels.regions_counted(many(40), many(14))
    assert [(r.n, r.first) for r in out.collect()] == [(2000, 5)] * 2000
    assert metric(out, "Join", "numOutputRows") <= 10_000  # 4,000,000 pairs


def test_pair_scores_as_by_plain_search(spark, monkeypatch):
    monkeypatch.setattr(signature, "BLOCK", 4)
    rng = random.Random(7)
    signs = {i: {p: rng.choice(["AA", "AC"]) for p in range(3) if rng.random() < 0.5} for i in range(60)}
    rows = [(i, p, g) for i, own in signs.items() for p, g in own.items()] + [(None, 1, "AA"), (3, None, "AA")]
    expected = {}
    for x, y in itertools.combinations(signs, 2):
        both = signs[x].keys() & signs[y].keys()
        if both:
            n = sum(signs[x][p] == signs[y][p] for p in both)
            expected[x, y] = (len(both), n, round(n / len(both), 6))
    got = signature.pair_scores(spark.createDataFrame(rows, "sample long, position long, genotype string"), 6).collect()
    assert len(got) == len(expected) and {(r.a, r.b): (r.compared, r.matches, r.score) for r in got} == expected


def test_pairs_of_samples_are_not_shuffled(spark):
    out = signature.pair_scores(spark.createDataFrame([(i, 1, "AA") for i in range(600)], "sample long, position long, genotype string"))
    assert len(out.collect()) == 600 * 599 // 2
    assert metric(out, "Exchange", "shuffleRecordsWritten") <= 10_000  # 179,700 pairs
