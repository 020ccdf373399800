import pytest
from pyspark.sql import functions as F

from covalens.plans import dsl

ROWS = [
    ("a", 0x1 | 0x2 | 0x40, "chr1", 100, 60, "30M2D5M", "=", 200, 135, "ACGTN", "IIIII", {"MD": "10A5^AC3T1", "ZM": "1", "RG": "g1"}),
    ("b", 0x400, "chr2", 50, 10, "35M", "chr1", 10, -50, "NNNNN", "!!!!!", {"ZM": "2"}),
    ("c", 0x4, None, 0, 0, None, None, 0, 0, "AAAA", "", {}),
]
SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("MAPQ > 50", "a"),
        ("mapq >= 10", "ab"),
        ("Cigar_M > 34", "ab"),
        ("cigar_D == 2", "a"),
        ("Cigar_M == 35", "ab"),
        ("RNAME =~ chr*", "ab"),
        ("RNAME =~ *2", "b"),
        ("RNAME !~ *2", "a"),
        ("RNAME == MRNM", "a"),
        ("RNAME != MRNM", "b"),
        ("MD_mismatch == 2", "a"),
        ("MD_mismatch != 7", "a"),
        ("option_ZM == 1", "a"),
        ("option_ZM != 1", "b"),
        ("option_RG == G1", "a"),
        ("option_XX != 3", ""),
        ("Flag_DuplicateRead == false", "ac"),
        ("Flag_DuplicateRead == 1", "b"),
        ("Flag_ProperPair == true", "a"),
        ("Flag_ProperPair != true", "bc"),
        ("QUAL_average >= 20", "a"),
        ("QUAL_average < 20", "b"),
        ("SEQ_numberN < 5", "ac"),
        ("and(MAPQ > 5, or(POS == 50, ISIZE > 100))", "ab"),
        ("or(and(MAPQ > 5, POS == 50), Flag_ReadUnmapped == true)", "bc"),
    ],
)
def test_filter(reads, text, kept):
    assert "".join(sorted(r.qname for r in dsl.kept(reads, text, reads=True).collect())) == kept
    yes, no = dsl.split(reads, text, reads=True)
    assert yes.count() + no.count() == 3


@pytest.mark.parametrize("text", ["", "MAPQ", "MAPQ > x", "and(MAPQ > 1)", "and(MAPQ > 1, POS > 2", "FOO > 1", "RNAME > chr1", "RNAME =~ *a*", "RNAME =~ a*b", "Flag_X == true", "Flag_DuplicateRead > 1", "MAPQ > 'a'", "MAPQ > 1 POS", "MAPQ > -5"])
def test_rejected(text):
    with pytest.raises(dsl.FilterError):
        dsl.compiled(text)


def test_text_order_compares_integers(spark):
    df = spark.createDataFrame([("5",), ("10",), ("x",)], "v string")
    assert sorted(r.v for r in dsl.kept(df, "v < 7").collect()) == ["5"]


def test_pushed_down(spark, sf_dir):
    df = dsl.kept(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey > 5000").select("l_orderkey")
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_valid_for_calling(reads):
    assert [r.qname for r in dsl.valid_for_calling(reads).collect()] == ["a"]
    assert sorted(r.qname for r in dsl.valid_for_calling(reads, True).select(F.col("qname")).collect()) == ["a", "b"]
