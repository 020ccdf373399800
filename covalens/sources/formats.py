"""Readers and writers of the domain's text formats.

Line formats go through Spark's text reader (any store, gzip by name, files split),
and are parsed with built-in functions. A missing value (``.``, ``./.`` or blank)
is read as null and written as ``.``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from covalens.functions.text import contig_rank, info_map, missing
from covalens.operators.pileup import reference_end


def records(spark: SparkSession, path: str, prefix: str = "#") -> tuple[DataFrame, DataFrame]:
    """Header lines, and all others but blank ones, of a text file or folder; both have value and file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    head = F.col("value").startswith(prefix)
    return lines.where(head), lines.where(~head & (F.trim("value") != ""))


def write_records(df: DataFrame, path: str, header: list[str], value: Column, order: list[Column], compression: str | None = None) -> None:
    """One line a row in the given order over the part files; the header comes first in the first of them."""
    spark = df.sparkSession
    body = df.select(F.lit(1).alias("__p"), F.struct(*order).alias("__o"), value.alias("value"))
    head = spark.createDataFrame([(i, line) for i, line in enumerate(header)], "i int, line string")
    head = head.select(F.lit(0).alias("__p"), F.lit(None).cast(body.schema["__o"].dataType).alias("__o"), F.col("line").alias("value"), "i")
    every = head.unionByName(body.withColumn("i", F.lit(0)))
    sorted_ = every.repartitionByRange("__p", "__o").sortWithinPartitions("__p", "i", "__o") if order else every
    writer = sorted_.select("value").write
    (writer.option("compression", compression) if compression else writer).text(path)


def _known(c: Column) -> Column:
    return F.when(~missing(c), c)


def _fields(df: DataFrame, least: int, what: str) -> DataFrame:
    parts = F.split("value", "\t", -1)
    short = F.concat(F.lit(f"a {what} line has fewer than {least} columns: "), F.col("value"))
    return df.withColumn("c", F.when(F.size(parts) >= least, parts).otherwise(F.split(F.raise_error(short).cast("string"), "\t")))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, alts, qual, filters, info (map), format, samples (array of maps by FORMAT key), file.

    Fewer than 8 columns raise. Trailing fields that a sample leaves out are null.
    """
    _, lines = records(spark, path)
    df = _fields(lines, 8, "VCF")
    c = lambda i: F.col("c")[i]
    fmt = F.when(F.size("c") > 8, F.split(c(8), ":")).otherwise(F.array().cast("array<string>"))
    sample = lambda s: F.map_from_arrays(F.array_distinct(fmt), F.transform(F.array_distinct(fmt), lambda k: F.get(F.split(s, ":"), F.array_position(fmt, k).cast("int") - 1)))
    samples = F.when(F.size("c") > 9, F.transform(F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(1))), sample)).otherwise(F.array().cast("array<map<string,string>>"))
    return df.select(
        c(0).alias("chrom"), c(1).cast("long").alias("pos"), _known(c(2)).alias("id"), c(3).alias("ref"), _known(c(4)).alias("alt"), F.split(_known(c(4)), ",").alias("alts"), _known(c(5)).try_cast("double").alias("qual"),
        F.split(_known(c(6)), ";").alias("filters"), info_map(c(7)).alias("info"), F.when(F.size("c") > 8, c(8)).alias("format"), samples.alias("samples"), "file",
    )


def write_vcf(df: DataFrame, path: str, header: list[str]) -> None:
    """Writes chrom, pos, id, ref, alt, qual, filters, info and, if there, format and samples, by contig and position."""
    from covalens.functions.text import info_text

    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    columns = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), dot(F.col("alt")), dot(F.col("qual")), dot(F.array_join("filters", ";")), info_text(F.col("info"))]
    if "samples" in df.columns:
        keys = F.split("format", ":")
        cell = lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(s[k], F.lit("."))), ":")
        columns += [F.col("format"), F.when(F.size("samples") > 0, F.array_join(F.transform("samples", cell), "\t"))]
    write_records(df, path, header, F.concat_ws("\t", *columns), [contig_rank(F.col("chrom")).alias("c"), F.col("pos")])


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """key, id, fields (map) of the typed meta lines ``##KEY=<ID=..,...>``, and of plain ones with a null id."""
    head, _ = records(spark, path)
    meta = head.where(F.col("value").startswith("##"))
    key = F.regexp_extract("value", r"^##([^=]+)=", 1)
    inner = F.regexp_extract("value", r"=<(.*)>$", 1)
    pairs = F.regexp_extract_all(inner, F.lit(r'([A-Za-z0-9_]+=(?:"[^"]*"|[^,]*))'), F.lit(1))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.replace(F.substring(x, F.instr(x, "=") + 1, F.length(x)), F.lit('"'), F.lit("")).alias("value"))))
    return meta.select(key.alias("key"), F.when(inner != "", fields["ID"]).alias("id"), F.when(inner != "", fields).alias("fields"), "value", "file")


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """seqid, source, type, start, end, score, strand, phase, attributes (raw), attribute (map), line, file."""
    _, lines = records(spark, path)
    df = _fields(lines, 8, "GFF3")
    c = lambda i: F.col("c")[i]
    raw = F.when(F.size("c") > 8, _known(c(8)))
    return df.select(c(0).alias("seqid"), _known(c(1)).alias("source"), c(2).alias("type"), c(3).cast("long").alias("start"), c(4).cast("long").alias("end"), _known(c(5)).try_cast("double").alias("score"), _known(c(6)).alias("strand"), _known(c(7)).alias("phase"), raw.alias("attributes"), info_map(raw).alias("attribute"), F.col("value").alias("line"), "file")


def read_bed(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """contig, start, end, name: closed intervals from 1 of BED's half-open ones from 0; with ``one_based`` false, as they stand."""
    _, lines = records(spark, path)
    df = _fields(lines.where(~F.col("value").rlike("^(track|browser)")), 3, "BED")
    start = F.col("c")[1].cast("long") + (1 if one_based else 0)
    return df.select(F.col("c")[0].alias("contig"), start.alias("start"), F.col("c")[2].cast("long").alias("end"), F.get("c", F.lit(3)).alias("name"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags (map), end (of the alignment), file."""
    _, lines = records(spark, path, "@")
    df = _fields(lines, 11, "SAM")
    c = lambda i: F.col("c")[i]
    star = lambda i: F.when(c(i) != "*", c(i))
    tag = lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, F.lit(6), F.length(x)).alias("value"))
    tags = F.when(F.size("c") > 11, F.map_from_entries(F.transform(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(1))), tag))).otherwise(F.create_map().cast("map<string,string>"))
    out = df.select(c(0).alias("qname"), c(1).cast("int").alias("flag"), star(2).alias("rname"), c(3).cast("long").alias("pos"), c(4).cast("int").alias("mapq"), star(5).alias("cigar"), star(6).alias("rnext"), c(7).cast("long").alias("pnext"), c(8).cast("long").alias("tlen"), star(9).alias("seq"), star(10).alias("qual"), tags.alias("tags"), "file")
    return out.withColumn("end", reference_end(F.col("pos"), F.col("cigar")))


def merged_reads(frames: list[DataFrame]) -> DataFrame:
    """All reads of several tables, with their number as ``source``, ordered by contig, position, name and source."""
    tagged = [df.withColumn("source", F.lit(i)) for i, df in enumerate(frames)]
    every = tagged[0]
    for df in tagged[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    return every.orderBy(contig_rank(F.col("rname")), "pos", "qname", "source")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (first word), description, sequence; lines of a sequence are joined. Records are split at line feed and ``>``."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(F.substring(body, F.instr(body, "\n") + 1, F.length(body)), r"\s", "")).otherwise("")
    df = raw.where(F.trim("value") != "").select(F.trim(head).alias("description"), seq.alias("sequence"))
    return df.select(F.substring_index("description", " ", 1).alias("id"), "description", "sequence")


def read_tabbed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated values with a header line; all columns are text unless a schema says otherwise."""
    reader = spark.read.option("sep", "\t").option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """The 21 columns of alignments by BLAT; block columns are arrays of int."""
    names = "matches mismatches rep_matches n_count q_gaps q_gap_bases t_gaps t_gap_bases strand q_name q_size q_start q_end t_name t_size t_start t_end blocks".split()
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d+\t"))
    df = _fields(lines, 21, "PSL")
    texts = {"strand", "q_name", "t_name"}
    columns = [(F.col("c")[i] if n in texts else F.col("c")[i].cast("long")).alias(n) for i, n in enumerate(names)]
    block = lambda i: F.transform(F.filter(F.split(F.col("c")[i], ","), lambda x: x != ""), lambda x: x.cast("int"))
    return df.select(*columns, block(18).alias("block_sizes"), block(19).alias("q_starts"), block(20).alias("t_starts"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastqSource(DataSource):
    """``spark.read.format("fastq")``: id, seq, qual; four lines a record, so a file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "id string, seq string, qual string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FastqReader(self.options["path"])


class _FastqReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return [_File(x.path) for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return [_File(path)]

    def read(self, partition):
        import gzip
        import itertools

        store, _ = self._store()
        with store.open_input_stream(partition.path, compression=None) as raw:
            lines = gzip.open(raw, "rt") if partition.path.endswith(".gz") else map(bytes.decode, _lines(raw))
            lines = (x.rstrip("\r\n") for x in lines)
            while record := list(itertools.islice(lines, 4)):
                if len(record) < 4 or record[0][:1] != "@" or record[2][:1] != "+" or len(record[1]) != len(record[3]):
                    if not any(record):
                        return
                    raise ValueError(f"{partition.path}: no FASTQ record at {record[0][:40]!r}")
                yield record[0][1:], record[1], record[3]


def _lines(raw, size: int = 1 << 20):
    rest = b""
    while part := raw.read(size):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def write_fastq(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """id, seq, qual as records of four lines."""
    text = reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("id")), "seq", F.lit("+"), "qual").alias("value"))
    (text.write.option("compression", compression) if compression else text.write).text(path)


def sam_to_fastq(reads: DataFrame) -> DataFrame:
    """id, seq, qual of primary reads as they were sequenced: reverse ones turned back; pairs get /1 and /2."""
    from covalens.functions.sequence import reverse_complement

    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    own = reads.where(F.col("flag").bitwiseAND(F.lit(0x900)) == 0)
    mate = F.when(bit(64), "/1").when(bit(128), "/2").otherwise("")
    return own.select(F.concat("qname", mate).alias("id"), F.when(bit(16), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(bit(16), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def write_wiggle(windows: DataFrame, path: str, name: str) -> None:
    """contig, start, value as a track of fixed windows, one declaration a row."""
    line = F.concat(F.lit("variableStep chrom="), F.col("contig"), F.lit("\n"), F.col("start").cast("string"), F.lit(" "), F.col("value").cast("string"))
    write_records(windows, path, [f'track type=wiggle_0 name="{name}"'], line, [contig_rank(F.col("contig")).alias("c"), F.col("start")])
