import gzip
import struct

from pyspark.sql import functions as F

from covalens.operators import structural
from covalens.sources import bam


def record(name, flag, ref, pos, cigar, seq, qual, tags, mate=-1, mate_pos=-1, tlen=0):
    ops = [(n << 4) | "MIDNSHP=X".index(op) for n, op in cigar]
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 60, 0, len(ops), flag, len(seq), mate, mate_pos, tlen) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops)
    body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes(ord(q) - 33 for q in qual) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chr2"))
    first = record("r1", 99, 0, 7, [(3, "S"), (4, "M"), (1, "D"), (2, "M")], "ACGTNACGT", "IIIIIIII#", b"NMC\1" + b"MDZ4^A2\0" + b"XBBs" + struct.pack("<i", 2) + struct.pack("<hh", 5, -6), 1, 36, 39)
    second = record("r2", 4, -1, 0, [], "", "", b"ZCi" + struct.pack("<i", -3) + b"XAAq")
    # two members, one record across them
    raw = head + first + second
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:150]) + gzip.compress(raw[150:]) + gzip.compress(b""))
    bam.register(spark)
    r1, r2 = sorted(spark.read.format("bam").load(str(tmp_path / "a.bam")).collect(), key=lambda r: r.qname)
    assert (r1.rname, r1.pos, r1.cigar, r1.rnext, r1.pnext, r1.tlen, r1.seq, r1.qual, r1.end) == ("chr1", 7, "3S4M1D2M", "chr2", 37, 39, "ACGTNACGT", "IIIIIIII#", 13)
    assert r1.tags == {"NM": "1", "MD": "4^A2", "XB": "s,5,-6"}
    assert (r2.rname, r2.pos, r2.cigar, r2.seq, r2.tags) == (None, 0, None, None, {"ZC": "-3", "XA": "q"})


def test_pair_classes(spark):
    paired, mate_reverse, reverse, first, second = 1, 32, 16, 64, 128
    rows = [
        (paired | mate_reverse | first, "a", "=", 10, 200, 300, "1", "AAA"),
        (paired | mate_reverse | first, "a", "=", 10, 200, 50, "1", "AAB"),
        (paired | reverse | first, "a", "=", 10, 200, 5000, "1", "ABC"),
        (paired | mate_reverse | first, "a", "=", 10, 10, 300, "1", "AXA"),
        (paired | first, "a", "=", 10, 200, 300, "1", "BAA"),
        (paired | second, "a", "=", 10, 200, 300, "1", "BBA"),
        (paired | 8, "a", "=", 10, 200, 300, "1", "D**"),
        (paired, "a", "b", 10, 200, 300, "1", "C**"),
        (paired | 512, "a", "=", 10, 200, 300, "1", "E**"),
        (paired | 1024 | mate_reverse, "a", "=", 10, 200, 300, "1", "Z**"),
        (paired | mate_reverse | first, "a", "=", 10, 200, 300, None, "AAA"),
        (paired | mate_reverse | first, "a", "=", 10, 200, 50, "3", "Z**"),
        (paired | first, "a", "=", 10, 200, 300, "2", "Z**"),
    ]
    df = spark.createDataFrame(rows, "flag int, rname string, rnext string, pos long, pnext long, tlen long, nh string, want string")
    df = df.withColumn("tags", F.when(F.col("nh").isNotNull(), F.create_map(F.lit("NH"), F.col("nh"))).otherwise(F.create_map().cast("map<string,string>")))
    assert [(r.want, r.got) for r in df.select("want", structural.pair_class(100, 400).alias("got")).collect() if r.want != r.got] == []


def test_lift_and_sample(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50), ("b", 5)], "contig string, pos long")
    chain = spark.createDataFrame([("a", 1, 10, "z", 101)], "contig string, start long, end long, to_contig string, to_start long")
    assert sorted(tuple(r) for r in structural.lifted(points, chain).collect()) == [("a", 5, "z", 105), ("a", 50, None, None), ("b", 5, None, None)]
    reads = spark.range(2000).select(F.floor(F.col("id") / 2).cast("string").alias("qname"))
    got = structural.sampled_pairs(reads, 0.3).groupBy("qname").count().collect()
    assert all(r["count"] == 2 for r in got) and 200 < len(got) < 400
