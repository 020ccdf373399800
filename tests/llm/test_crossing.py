"""Texts of one large group that fingerprints leave apart: linked at few of their shingles, not pair by pair."""

import random

from covalens.llm import simhash


def versions(n, replaced, seed):
    """A text of 400 words in n versions, each with a run of words of its own at a place by chance."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    base = [word() for _ in range(400)]
    out = []
    for _ in range(n):
        at = rng.randrange(len(base) - replaced)
        out.append(" ".join(base[:at] + [word() for _ in range(replaced)] + base[at + replaced :]))
    return out


def grouped(spark, texts, monkeypatch):
    """The groups of near_duplicates without the quick search by fingerprints, and how many candidates the search by prefixes made."""
    made, real = [], simhash.crossing_pairs

    def spy(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "crossing_pairs", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.group_id for r in simhash.near_duplicates(docs, 5, 0, 0.8).collect()}, made[0]


def test_a_large_group_does_not_meet_pair_by_pair(spark, monkeypatch):
    groups, made = grouped(spark, versions(120, 17, 1), monkeypatch)
    assert set(groups.values()) == {0}
    assert made <= 700  # of 7,140 pairs


def test_groups_as_by_brute_force(spark, monkeypatch):
    texts = versions(60, 20, 2) + versions(30, 60, 3) + ["", "one two", "one two"]
    sets = [set(simhash.shingle_hashes(simhash.words_of(x), 5).tolist()) for x in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j in range(i):
                if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    groups, _ = grouped(spark, texts, monkeypatch)
    assert groups == dict(enumerate(root)) and len(set(root)) > 10
