"""WARC round trip, preference formatting, packing, and the pipeline."""

import gzip
import hashlib
import os
import random

import duckdb
import pytest

from covalens.llm import packing, preference, queries, registry, warc


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://b.example.org/x?q=1#f", big), (2, "https://B.example.org/x?q=1", big), (9, None, big), (4, "http://a.example.org", "small"), (5, "http://a.example.org", "small"), (6, "u\r\nv", None), (None, "z", big), (7, "w", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 60), (3, "y", "x" * 999), (8, "y", "x" * 999), (10, "y", "x" * 1000), (11, "y", "x" * 1000), (11, "y", "x" * 1000)]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows], "page_id long, url string, html string, archive string, offset int").repartition(3)
    out = warc.archived(df, str(tmp_path / "w"))
    got = out.collect()
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and (-1 if i is None else i) != last[h]
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", str(last[h]) if again else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    keys = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.urlkey for r in got} >= {"org,example,b)/x?q=1", "org,example,a)", ")"}
    # records lie where the index says, and payloads come back byte for byte
    bodies = dict((i, (h or "").encode()) for i, _, h in rows)
    for r in got:
        raw = gzip.decompress((tmp_path / "w" / r.archive).read_bytes())
        record = raw[r.offset : r.offset + r.length]
        (_, _, fields, block), *none = warc.parsed(record)
        assert not none and fields["warc-type"] == r.record_type
        assert block.partition(b"\r\n\r\n")[2] == (b"" if r.record_type == "revisit" else bodies[r.page_id])


def test_warc_parser():
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(a, n, b) for a, n, _, b in warc.parsed(gzip.compress(one) + gzip.compress(one))] == [(0, len(one), b"abc"), (len(one), len(one), b"abc")]
    for bad in (b"x", one[:-1], b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parsed(bad))


def test_loser_tree():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_preference_against_sql(spark):
    turns = [("user", "q"), ("assistant", "a1"), ("user", "é q2 <|im_end|>"), ("assistant", "")]
    rows = []
    for i, conv in enumerate([turns, turns[:3], turns, [*turns[:3], ("assistant", "other")], turns[:1], [("user", "Q")], turns, turns, turns[:1]]):
        rows += [(i, j, *t, "x", "y") for j, t in enumerate(conv)]
    rows += [(20, None, None, None, "x", "y"), (20, 1, "user", "u", "x", "y"), (20, 1, "user", "u", "x", "y"), (None, 0, "user", "n", "x", "y"), (31, 5, "assistant", "b" * 9000, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, chosen string")
    got = preference.preference_pairs(df).drop("prompt_").collect()
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()
    con.unregister("conversations")
    con.register("conversations", conversations)
    want = con.sql(preference.ORACLE).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = {r.pair_id: r for r in got}
    assert (by[0].n_common, by[1].n_common, by[2].n_common, by[3].n_common) == (3, 3, 0, 4)
    assert by[1].prompt.count("<|im_start|>") == 3 and "< |im_end|>" in by[1].prompt
    learned = lambda text, mask: [text[int(a) : int(b)] for a, b in (x.split(":") for x in mask.split(",") if x)]
    assert learned(by[1].rejected, by[1].rejected_mask) == ["other<|im_end|>"]
    assert learned(by[2].chosen, by[2].chosen_mask) == [] and by[3].chosen == "" and by[4].rejected is None
    assert preference.preference_pairs(df.limit(0)).count() == 0


def test_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted((rng.randint(0, 64) for _ in range(rng.randint(0, 60))), reverse=True)
        where, start, sizes = packing.best_fit(lengths, (16, 32, 64))
        content = {}
        for n, b, at in zip(lengths, where, start, strict=True):
            content.setdefault(b, []).append((at, n))
        for b, parts in content.items():
            at = 0
            for s, n in sorted(parts):
                assert s == at
                at += n
            assert at <= sizes[b] and not any(s >= at for s in (16, 32, 64) if s < sizes[b])  # downsized
        assert sorted(content) == list(range(len(sizes)))


def test_best_fit_takes_the_tightest_bin():
    cheap = lambda s: s
    where, _, sizes = packing.best_fit([60, 50, 14, 4, 4], (64,), cheap)
    assert where == [0, 1, 1, 0, 2] and sizes == [64, 64, 64]
    # a bin of 16 costs least for a lone item of 10
    assert packing.best_fit([10], (16, 64), cheap)[2] == [16]


def test_packing_keeps_every_token(docs, rows, empty):
    sizes = (64, 256, 1024)
    got = packing.packed(docs, sizes, block=20).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(len((t or "").encode().split()) + 1)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.n_tokens)
        assert r.bin_size in sizes and r.n_tokens + r.bin_start <= r.bin_used <= r.bin_size and r.piece_start == r.piece * 1024
    assert {k: sum(v) for k, v in have.items()} == {k: sum(v) for k, v in want.items()}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append((r.bin_start, r.n_tokens, r.bin_used))
    for parts in bins.values():
        at = 0
        for s, n, used in sorted(parts):
            assert s == at
            at += n
        assert at == used
    assert packing.packed(empty, sizes).count() == 0


def test_packing_beats_padding(spark):
    got = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    bins = got.drop_duplicates("bin_id")
    assert bins.bin_used.sum() / bins.bin_size.sum() > 0.9


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in registry.QUERIES
    assert all(callable(f) for f in registry.QUERIES.values()) and queries.table


def test_pipeline(spark, tmp_path, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]
    assert counts[0] < spark.read.parquet(f"{sf_dir}/documents.parquet").count() and counts[1] < counts[0] and counts[3] <= counts[2]


def test_passage_stage_keeps_genuine_characters(spark, sf_dir):
    import corpus_pipeline

    passage = "é" + " ".join(f"word{i}" for i in range(60)) + "é"
    rows = [(1, passage, "en", "s", 0), (2, "keep \ufffd here é" + passage[1:-1] + "ü end", "en", "s", 0), (3, None, None, None, None), (4, "", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.passage_dedup(spark, docs, sf_dir).collect()}
    assert got[1].text == passage and got[2].text == "keep \ufffd here  end"  # both broken characters go, the one meant stays
    assert got[2].n_chars == len(got[2].text) and got[3].text is None and got[3].n_chars is None and got[4].text == "" and got[4].n_chars == 0


def test_library_lives_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'])"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]")
