import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from covalens.sources import formats
from covalens.streaming import windows

VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr2\t5\t.\tA\tC,G\t.\tPASS\tDP=3;DB\tGT:AD\t0/1:1,2\t./.
chr10\t7\trs1\tT\tC\t12.5\tLOW;BAD\t.\tGT\t1/1\t0/0
"""
SAM = "@HD\tVN:1.0\nr1\t99\tchr1\t7\t30\t3S6M1D5M\t=\t37\t39\tTTAGATAAAGGATA\t*\tNM:i:1\tMD:Z:6^A5\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\n"


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    df = formats.read_vcf(spark, str(tmp_path / "a.vcf"))
    first, second = sorted(df.collect(), key=lambda r: r.pos)
    assert (first.id, first.alts, first.qual, first.info, first.filters) == (None, ["C", "G"], None, {"DP": "3", "DB": ""}, ["PASS"])
    assert first.samples == [{"GT": "0/1", "AD": "1,2"}, {"GT": "./.", "AD": None}]
    assert (second.id, second.qual, second.info) == ("rs1", 12.5, {})
    head = formats.read_vcf_header(spark, str(tmp_path / "a.vcf")).where("id = 'DP'").first()
    assert head.fields["Description"] == "Depth, total"
    formats.write_vcf(df, str(tmp_path / "out"), VCF.splitlines()[:3])
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:3] == VCF.splitlines()[:3]
    assert lines[3].startswith("chr2\t5\t.\tA\tC,G\t.\tPASS\tDB;DP=3\tGT:AD\t0/1:1,2\t./.") and lines[4].startswith("chr10\t7\trs1")


def test_short_vcf_line_raises(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("chr1\t5\t.\n")
    with pytest.raises(PySparkException):
        formats.read_vcf(spark, str(tmp_path / "a.vcf")).collect()


def test_sam(spark, tmp_path):
    with gzip.open(tmp_path / "a.sam.gz", "wt") as f:
        f.write(SAM)
    r1, r2 = sorted(formats.read_sam(spark, str(tmp_path / "a.sam.gz")).collect(), key=lambda r: r.qname)
    assert (r1.end, r1.tags["MD"], r1.qual, r1.rnext) == (18, "6^A5", None, "=")
    assert (r2.rname, r2.cigar, r2.seq) == (None, None, "ACGT")


def test_gff3_bed_fasta_psl(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3\nchr1\t.\tgene\t1\t9\t.\t+\t.\tID=g1;Name=x\nchr1\ts\texon\t2\t3\t1.5\t-\t0\n")
    g = sorted(formats.read_gff3(spark, str(tmp_path / "a.gff3")).collect(), key=lambda r: r.start)
    assert (g[0].attribute, g[0].score, g[1].attributes, g[1].score) == ({"ID": "g1", "Name": "x"}, None, None, 1.5)
    (tmp_path / "a.bed").write_text("track x\nchr1\t0\t10\tn\nchr2\t5\t6\n")
    assert sorted(tuple(r) for r in formats.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [("chr1", 1, 10, "n"), ("chr2", 6, 6, None)]
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nAC\n>c2\nTT\n>c3\n")
    assert sorted(tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("c1", "c1 first", "ACGTAC"), ("c2", "c2", "TT"), ("c3", "c3", "")]
    (tmp_path / "a.psl").write_text("psLayout version 3\n\n" + "\t".join(["9", "1", *["0"] * 6, "+", "q", "10", "0", "10", "t", "99", "5", "15", "2", "4,6,", "0,4,", "5,9,"]) + "\n")
    p = formats.read_psl(spark, str(tmp_path / "a.psl")).first()
    assert (p.matches, p.strand, p.block_sizes, p.t_starts) == (9, "+", [4, 6], [5, 9])


def test_fastq(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.fastq").write_text("@r1\nACG\n+\n@II\n@r2\nA\n+r2\nI\n")
    with gzip.open(tmp_path / "q" / "b.fastq.gz", "wt") as f:
        f.write("@r3\nT\n+\n#\n")
    df = spark.read.format("fastq").load(str(tmp_path / "q"))
    assert sorted(tuple(r) for r in df.collect()) == [("r1", "ACG", "@II"), ("r2", "A", "I"), ("r3", "T", "#")]
    formats.write_fastq(df, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in spark.read.format("fastq").load(str(tmp_path / "w")).collect()) == [("r1", "ACG", "@II"), ("r2", "A", "I"), ("r3", "T", "#")]


def test_reads_turned_back(spark):
    df = spark.createDataFrame([("a", 16 | 1 | 64, "AACG", "IJKL"), ("b", 0, "T", "I"), ("c", 0x100, "T", "I")], "qname string, flag int, seq string, qual string")
    assert sorted(tuple(r) for r in formats.sam_to_fastq(df).collect()) == [("a/1", "CGTT", "LKJI"), ("b", "T", "I")]


def test_streams(spark, tmp_path, sf_dir):
    folder = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(3, "ts").write.parquet(str(folder))
    stream = windows.event_stream(spark, str(folder), "*.parquet", files=10)
    counts = windows.finished(windows.tumbling(stream, "1 hour", "1 day", "event_type"), str(tmp_path / "t"))
    batch = spark.read.parquet(str(folder)).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = {(r.start, r.event_type): r.n for r in counts.collect()}
    want = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())
    again = windows.event_stream(spark, str(folder), "*.parquet", files=10)
    runs = windows.finished(windows.islands(again, "1 hour", 3600, "event_type"), str(tmp_path / "i")).collect()
    assert runs and all(r.start <= r.end and r.n >= 1 for r in runs)
