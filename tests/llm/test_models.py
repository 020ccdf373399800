"""Language model, quality and language classifiers: plain versions and held-out accuracy."""

import math
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from brute import table as small_table
from pyspark.sql import functions as F

from covalens.llm import interpolation, langid, quality

SF = "/root/testdata/sf0.01"


def crc(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def test_lm_counts_and_base_score(docs, rows):
    got = interpolation.scored(docs).collect()
    train = [t for i, t, _ in rows if i is not None and crc(i, 7) != 2]
    c = brute.counts(train)
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        tokens = [*brute.words(t), None]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((str(i), str(None if i is None else crc(i, 7) == 2), len(tokens), sum(c[x] > 0 for x in tokens), n, round(base, 4)))
    assert sorted((str(r.doc_id), str(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_lm_is_a_distribution_and_beats_its_base(spark):
    rows = [(i, " ".join("ab"[(i + j) % 2] for j in range(30)), None) for i in range(200)]
    got = interpolation.scored(small_table(spark, rows)).toPandas()
    held = got[got.held_out]
    assert (held.score > held.base_score).all()  # the next word is certain but for the first
    assert held.score.sum() / held.n_tokens.sum() > -0.1


def test_weights_by_em(spark):
    rng = np.random.default_rng(2)
    true = np.array([0.2, 0.3, 0.5])
    p = np.hstack([np.full((4000, 1), 0.01), rng.choice([0.0, 0.4], (4000, 2))])
    # an event is seen as often as the true mixture says
    p = p[rng.random(4000) < (p @ true) / (p @ true).max()]
    df = spark.createDataFrame([(bytes(np.full(len(p), 3, np.uint8)), p[:, 1:].astype(np.float32).tobytes())], "context binary, p binary")
    w = interpolation.learned(df, 2, 0.01)
    like = lambda x: np.log(p @ x).sum()
    assert like(w[3]) >= like(np.full(3, 1 / 3)) and abs(w[3].sum() - 1) < 1e-9
    assert np.allclose(w[5], w[3])


def test_lm_without_training(spark, empty):
    assert interpolation.scored(empty).count() == 0
    held = [i for i in range(300) if crc(i, 7) == 2][:3]
    got = interpolation.scored(small_table(spark, [(i, "a b", None) for i in held])).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out(big):
    docs, labels = big
    got = quality.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: crc(i, 5) == 0)).all()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    rows = quality.kept(docs, labels)
    assert rows.columns == docs.columns and rows.count() == int((quality.scored(docs, labels).toPandas().predicted == 1).sum())


def test_quality_never_sees_held_out_labels(big):
    docs, labels = big
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.scored(docs, x).toPandas().set_index("doc_id").score.sort_index() for x in (labels, flipped))
    pd.testing.assert_series_equal(a, b)


def test_quality_of_odd_tables(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(25)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(empty, labels).count() == 0 and quality.kept(empty, labels).count() == 0


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 4)), rng.normal(-1, 1, (1000, 4))
    mixed = np.vstack([rng.normal(1, 1, (3000, 4)), rng.normal(-1, 1, (1000, 4))])
    w = quality.fit_nnpu(good, mixed, 0.75)
    side = lambda x: (x @ w[:-1] + w[-1] > 0).mean()
    assert side(good) > 0.9 and side(bad) < 0.2


def test_language_on_held_out(big):
    docs, _ = big
    truth = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").df()
    got = langid.identified(docs).toPandas().merge(truth, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: crc(i, 4) == 2)).all()
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_of_odd_texts(docs, empty, rows):
    got = langid.identified(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.lang_pred for r in got}
    assert all(found[i] == "und" for i in (60, 61, 62, 69)) and found[63] in ("en", "fr")
    assert langid.identified(empty).count() == 0


def test_bit_slices_are_bloom_filters():
    rng = np.random.default_rng(4)
    filters = langid.Filters([str(i) for i in range(70)], slots=1 << 12)
    own = {i: rng.integers(0, 1 << 63, 60, dtype=np.uint64) for i in (0, 1, 69)}
    for i, h in own.items():
        filters.add(i, h)
    for i, h in own.items():
        assert ((filters.containing(h)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    strange = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    share = ((filters.containing(strange)[:, 0]) & np.uint64(1)).mean()
    assert abs(share - filters.chance()[0]) < 0.002
    counts = filters.counts(np.concatenate([own[1], strange]), np.array([0, 0, 60, 20_060]))
    assert counts[0].sum() == 0 and counts[1].argmax() == 1 and counts[2].max() < 100


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled_alone(prior):
    rng = np.random.default_rng(int(prior * 100))
    good = lambda n: rng.normal(1.5, 1, (n, 6))
    bad = lambda n: rng.normal(-1.5, 1, (n, 6))
    mixed = np.vstack([good(int(4000 * prior)), bad(4000 - int(4000 * prior))])
    rng.shuffle(mixed)
    assert abs(quality.estimated_prior(good(3000).astype(np.float32), mixed.astype(np.float32)) - prior) < 0.06
    assert quality.estimated_prior(good(10).astype(np.float32), mixed.astype(np.float32)) == 0.5


def test_a_repeated_doc_id_trains_once(spark):
    rows = [(i, f"some fine words in text {i} . " * 5, "en") for i in range(60)] + [(7, f"copy {i}", "en") for i in range(3000)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    w, _ = quality.train(small_table(spark, rows), labels)
    v, _ = quality.train(small_table(spark, [r for r in rows if r[0] != 7] + [min(r for r in rows if r[0] == 7)]), labels)
    assert np.allclose(w, v)
