"""Sources and sinks: each query writes a table in a format, reads it back, and returns what it has read."""

from __future__ import annotations

from pyspark.sql import functions as F

from covalens.plans.queries import query, table
from covalens.plans.record_queries import _RD, reads
from covalens.session import work_path
from covalens.sources import formats

_V = "select distinct concat('chr', p_size % 3 + 1) as chrom, p_partkey * 10 as pos, substr('ACGT', cast(p_size % 4 + 1 as int), 1) as ref, case when p_size % 5 = 0 then null else concat('T', ',', 'G') end as alt, p_retailprice as qual, p_size, p_partkey from part"
_HEADER = ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]


def _variants(spark, sf_dir) -> str:
    p = table(spark, sf_dir, "part").selectExpr("concat('chr', p_size % 3 + 1) as chrom", "p_partkey * 10 as pos", "cast(null as string) as id", "substr('ACGT', cast(p_size % 4 + 1 as int), 1) as ref", "case when p_size % 5 = 0 then null else 'T,G' end as alt", "p_retailprice as qual", "p_size", "p_partkey")
    sample = lambda gt, dp: F.map_from_arrays(F.array(F.lit("GT"), F.lit("DP")), F.array(gt, dp.cast("string")))
    flag = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("COV"), F.lit("NNS")))
    info = F.map_from_arrays(F.array(F.lit("DP"), F.lit("SOMATIC")), F.array(F.col("p_size").cast("string"), F.lit("")))
    gt = F.when(F.col("p_size") % 3 == 0, "0/1").otherwise("1/2")
    samples = F.array(sample(gt, F.col("p_size")), sample(F.lit("./."), F.col("p_partkey")))
    p = p.select("chrom", "pos", "id", "ref", "alt", "qual", flag.alias("filters"), info.alias("info"), F.lit("GT:DP").alias("format"), samples.alias("samples"))
    path = work_path(spark, "variants.vcf")
    formats.write_vcf(p, path, _HEADER)
    return path


@query(f"""with V as ({_V}) select chrom, pos, ref, alt, qual, case when p_size % 2 = 0 then 'PASS' else 'COV;NNS' end as filters, concat('', p_size) as depth, case when p_size % 3 = 0 then '0/1' else '1/2' end as gt, concat('', p_partkey) as other_depth from V""")
def vcf_scan(spark, sf_dir):
    v = formats.read_vcf(spark, _variants(spark, sf_dir))
    return v.select("chrom", "pos", "ref", "alt", "qual", F.array_join("filters", ";").alias("filters"), F.col("info")["DP"].alias("depth"), F.col("samples")[0]["GT"].alias("gt"), F.col("samples")[1]["DP"].alias("other_depth"))


@query("select * from (values ('fileformat', null, null), ('INFO', 'DP', 'Depth, all')) as t(key, id, description)")
def vcf_header(spark, sf_dir):
    h = formats.read_vcf_header(spark, _variants(spark, sf_dir))
    return h.select("key", "id", F.col("fields")["Description"].alias("description"))


@query("select 'body' as kind, count(*) as n from part union all select 'header', 3")
def text_records(spark, sf_dir):
    head, body = formats.records(spark, _variants(spark, sf_dir))
    return head.select(F.lit("header").alias("kind")).unionByName(body.select(F.lit("body").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("select strlen(line) as bytes, count(*) as n from (select unnest(string_split(text, chr(10))) as line from benchmark) group by 1")
def line_scan(spark, sf_dir):
    path = work_path(spark, "lines")
    table(spark, sf_dir, "benchmark").select("text").write.option("compression", "gzip").text(path)
    return spark.read.text(path).groupBy(F.octet_length("value").cast("long").alias("bytes")).agg(F.count("*").alias("n"))


@query("select concat('chr', s_suppkey % 3) as seqid, 'gene' as type, s_suppkey * 10 as start_pos, s_suppkey * 10 + 99 as end_pos, case when s_acctbal < 0 then null else s_acctbal end as score, concat('s', s_suppkey) as id from supplier")
def gff3_scan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_suppkey") % 3), F.lit("."), F.lit("gene"), F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 99, F.when(F.col("s_acctbal") < 0, ".").otherwise(F.col("s_acctbal").cast("string")), F.lit("+"), F.lit("."), F.concat(F.lit("ID=s"), F.col("s_suppkey"), F.lit(";Note")))
    path = work_path(spark, "features.gff3")
    formats.write_records(s, path, ["##gff-version 3"], line, [F.col("s_suppkey")])
    g = formats.read_gff3(spark, path)
    return g.select("seqid", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "score", F.col("attribute")["ID"].alias("id"))


@query("select concat('chr', s_suppkey % 3) as contig, s_suppkey * 10 + 1 as start_pos, s_suppkey * 10 + 60 as end_pos, s_name as name from supplier")
def bed_scan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("s_suppkey") % 3), F.col("s_suppkey") * 10, F.col("s_suppkey") * 10 + 60, "s_name")
    path = work_path(spark, "regions.bed")
    formats.write_records(s, path, ["track name=regions"], line, [F.col("s_suppkey")])
    return formats.read_bed(spark, path).select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "name")


@query("select concat('item', item_id) as id, concat('item', item_id, ' of ', strlen(text)) as description, regexp_replace(text, '\\s', '', 'g') as sequence from benchmark")
def fasta_scan(spark, sf_dir):
    path = work_path(spark, "items.fa")
    line = F.concat(F.lit(">item"), F.col("item_id"), F.lit(" of "), F.octet_length("text"), F.lit("\n"), F.regexp_replace("text", "(.{50})", "$1\n"))
    formats.write_records(table(spark, sf_dir, "benchmark"), path, [], line, [F.col("item_id")])
    return formats.read_fasta(spark, path)


@query("select concat('item', item_id) as id, regexp_replace(text, '\\s', '_', 'g') as seq, repeat('I', length(text)) as qual from benchmark")
def fastq_scan(spark, sf_dir):
    formats.register(spark)
    path = work_path(spark, "items.fq")
    b = table(spark, sf_dir, "benchmark")
    seq = F.regexp_replace("text", r"\s", "_")
    formats.write_fastq(b.select(F.concat(F.lit("item"), F.col("item_id")).alias("id"), seq.alias("seq"), F.repeat(F.lit("I"), F.length("text")).alias("qual")), path)
    return spark.read.format("fastq").load(path)


_TURNED = "list_aggregate(list_reverse(string_split(translate(seq, 'ACGT', 'TGCA'), '')), 'string_agg', '')"


@query(f"""with {_RD} select rname, rnext, count(*) as n, cast(sum(pos + m1 + m2 + del + m3 - 1) as bigint) as ends, cast(sum(mapq) as bigint) as mapq, count(nh) as with_nh from RD group by 1, 2""")
def sam_scan(spark, sf_dir):
    path = _sam(spark, sf_dir)
    r = formats.read_sam(spark, path)
    return r.groupBy("rname", "rnext").agg(F.count("*").alias("n"), F.sum("end").alias("ends"), F.sum("mapq").cast("long").alias("mapq"), F.count(F.col("tags")["NH"]).alias("with_nh"))


def _sam(spark, sf_dir) -> str:
    tags = F.concat_ws("\t", F.transform(F.map_entries("tags"), lambda x: F.concat(x.key, F.lit(":Z:"), x.value)))
    line = F.concat_ws("\t", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", tags)
    path = work_path(spark, "reads.sam")
    formats.write_records(reads(spark, sf_dir), path, ["@HD\tVN:1.6\tSO:coordinate", "@RG\tID:a\tSM:s"], line, [F.col("rname"), F.col("pos")])
    return path


@query(f"""with {_RD} select mate, count(*) as n, cast(sum(length(s)) as bigint) as bases, min(s) as least, max(q) as most from (select case when flag & 64 <> 0 then '/1' when flag & 128 <> 0 then '/2' else '' end as mate, case when flag & 16 <> 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as s, case when flag & 16 <> 0 then reverse(qual) else qual end as q from RD where flag & 256 = 0 and flag & 2048 = 0) group by 1""")
def reads_to_fastq(spark, sf_dir):
    f = formats.sam_to_fastq(formats.read_sam(spark, _sam(spark, sf_dir)))
    return f.groupBy(F.regexp_extract("id", "(/[12])?$", 0).alias("mate")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.min("seq").alias("least"), F.max("qual").alias("most"))


@query("select p_partkey, p_name, p_size from part where p_size > 10")
def tabbed_scan(spark, sf_dir):
    path = work_path(spark, "parts.tsv")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").where("p_size > 10").write.option("sep", "\t").option("header", True).csv(path)
    return formats.read_tabbed(spark, path, "p_partkey long, p_name string, p_size int")


@query("select p_partkey as matches, 'q' || p_size as q_name, '+' as strand, cast(p_size as bigint) as t_start, [10, p_size] as block_sizes from part")
def psl_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    z = F.lit(0)
    cells = [F.col("p_partkey"), *[z] * 7, F.lit("+"), F.concat(F.lit("q"), F.col("p_size")), *[z] * 3, F.lit("t"), z, F.col("p_size"), z, F.lit(2), F.concat(F.lit("10,"), F.col("p_size"), F.lit(",")), F.lit("0,1,"), F.lit("0,1,")]
    path = work_path(spark, "hits.psl")
    formats.write_records(p, path, ["psLayout version 3", ""], F.concat_ws("\t", *cells), [F.col("p_partkey")])
    return formats.read_psl(spark, path).select("matches", "q_name", "strand", "t_start", "block_sizes")


@query("select concat('variableStep chrom=c', s_suppkey % 3) as declared, count(*) as n from supplier group by 1")
def wiggle_sink(spark, sf_dir):
    path = work_path(spark, "windows.wig")
    s = F.col("s_suppkey")
    formats.write_wiggle(table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), s % 3).alias("contig"), (s * 10).alias("start"), F.col("s_acctbal").alias("value")), path, "balances")
    lines = spark.read.text(path)
    return lines.where("value like 'variableStep%'").groupBy(F.col("value").alias("declared")).agg(F.count("*").alias("n"))
