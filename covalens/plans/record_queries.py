"""Record fields, scalar functions and pair geometry applied to the driver's tables, with the SQL that gives the same rows.

Order lines stand for aligned reads. The expressions of ``FIELDS`` mean the same
in both dialects, so the table of reads is the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.functions import sequence, text, variants
from covalens.operators import align, annotate, callers, intervals, motif, pileup, profile, structural
from covalens.operators.intervals import Spans
from covalens.plans import dsl
from covalens.plans.queries import query, table
from covalens.sources import formats

_LEN = "(l_linenumber + cast(l_quantity as int) % 6 + 3 + l_linenumber % 3 + 1 + l_partkey % 5 + 2 + l_partkey % 7 + 1)"
FIELDS = {
    "qname": "concat('r', l_orderkey)",
    "flag": "cast(1 + case when l_linenumber % 2 = 0 then 2 else 0 end + case when l_partkey % 11 = 0 then 4 else 0 end + case when l_partkey % 13 = 0 then 8 else 0 end + case when l_returnflag = 'R' then 16 else 0 end + case when l_linestatus = 'F' then 32 else 0 end"
    " + case when l_linenumber = 1 then 64 else 128 end + case when l_suppkey % 17 = 0 then 256 else 0 end + case when l_suppkey % 19 = 0 then 512 else 0 end + case when l_partkey % 7 = 0 then 1024 else 0 end as int)",
    "rname": "concat('chr', l_suppkey % 3 + 1)",
    "pos": "l_partkey * 10",
    "mapq": "cast(l_quantity as int)",
    "cigar": "concat(l_linenumber, 'S', cast(l_quantity as int) % 6 + 3, 'M', l_linenumber % 3 + 1, 'I', l_partkey % 5 + 2, 'M', l_suppkey % 4 + 1, 'D', l_partkey % 7 + 1, 'M')",
    "rnext": "case when l_partkey % 4 = 0 then '=' when l_partkey % 4 = 1 then concat('chr', l_linenumber % 3 + 1) else concat('chr', l_suppkey % 3 + 1) end",
    "pnext": "l_partkey * 10 + cast(l_quantity as bigint) - 30",
    "tlen": "cast(l_quantity as bigint) * 20 - 500",
    "seq": f"substr(repeat('ACGTTNGCAACGGT', 4), cast(l_partkey % 9 + 1 as int), cast({_LEN} as int))",
    "qual": f"substr(repeat('!5:?DI#+', 8), cast(l_suppkey % 7 + 1 as int), cast({_LEN} as int))",
    "md": "concat(l_linenumber, case when l_partkey % 2 = 0 then 'A0C' else '' end, cast(l_quantity as int), '^AC', l_suppkey % 9, 'T2')",
    "nh": "case when l_linenumber % 4 = 0 then null else concat('', l_linenumber % 4) end",
    "zm": "case when l_returnflag = 'A' then 'X' else concat('', l_partkey % 5) end",
    "m1": "cast(l_quantity as int) % 6 + 3", "ins": "l_linenumber % 3 + 1", "m2": "l_partkey % 5 + 2", "del": "l_suppkey % 4 + 1", "m3": "l_partkey % 7 + 1", "clip": "l_linenumber",
}
_RD = f"RD as (select {', '.join(f'{e} as {n}' for n, e in FIELDS.items())} from lineitem)"


def reads(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in FIELDS.items()])
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k.upper()).alias("key"), F.col(k).alias("value")) for k in ("md", "nh", "zm")]), lambda x: x.value.isNotNull()))
    return df.withColumns({"tags": tags, "end": pileup.reference_end(F.col("pos"), F.col("cigar"))})


def _by_name(df: DataFrame) -> DataFrame:
    return df.groupBy("rname").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def _filtered(name: str, text_: str, where: str) -> None:
    def run(spark, sf_dir):
        return _by_name(dsl.kept(reads(spark, sf_dir), text_, reads=True))

    run.__name__ = name
    query(f"with {_RD} select rname, count(*) as n, cast(sum(pos) as bigint) as sum_pos from RD where {where} group by 1")(run)


# --- the fields of the filter language

_total = "(select coalesce(sum(cast(x as bigint)), 0) from (select unnest(regexp_extract_all(cigar, '(\\d+){op}', 1)) as x))"
_MATE = "lower(case when rnext = '=' then rname else rnext end)"
_filtered("filter_positions", "and(MAPQ > 20, or(POS <= 900, ISIZE >= 100), MAPQ != 33)", "mapq > 20 and (pos <= 900 or tlen >= 100) and mapq <> 33")
_filtered("filter_names", "or(RNAME == CHR1, MRNM =~ *2, RNAME != MRNM)", f"lower(rname) = 'chr1' or {_MATE} like '%2' or lower(rname) <> {_MATE}")
_filtered("filter_cigar", "and(Cigar_M >= 12, Cigar_D < 3, or(Cigar_I == 1, Cigar_S > 4))", f"{_total.format(op='M')} >= 12 and {_total.format(op='D')} < 3 and ({_total.format(op='I')} = 1 or {_total.format(op='S')} > 4)")
_filtered("filter_md_mismatch", "MD_mismatch >= 2", "length(regexp_replace(regexp_replace(md, '\\^[A-Za-z]+', '', 'g'), '[^A-Za-z]', '', 'g')) >= 2")
_filtered("filter_option", "or(option_NH == 1, option_ZM == x)", "coalesce(try_cast(nh as double) = 1, false) or lower(zm) = 'x'")
_filtered("filter_flag", "and(Flag_ReadPaired == true, Flag_DuplicateRead == false, or(Flag_ReadNegativeStrand == true, Flag_MateUnmapped == true))", "flag & 1 <> 0 and flag & 1024 = 0 and (flag & 16 <> 0 or flag & 8 <> 0)")
_filtered("filter_quality_average", "QUAL_average > 22", "floor(list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) / length(qual)) > 22")
_filtered("filter_sequence_n", "SEQ_numberN <= 1", "length(seq) - length(replace(seq, 'N', '')) <= 1")


@query("select c_mktsegment, count(*) as n from customer where lower(c_mktsegment) = 'building' or (lower(c_mktsegment) <> 'automobile' and lower(c_name) <> 'x') group by 1")
def filter_strings(spark, sf_dir):
    return dsl.kept(table(spark, sf_dir, "customer"), "or(c_mktsegment == Building, and(c_mktsegment != AUTOMOBILE, c_name != x))").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"with {_RD} select rname, count(*) as n, cast(sum(pos) as bigint) as sum_pos from RD where flag & 4 = 0 and flag & 256 = 0 and flag & 512 = 0 and flag & 1024 = 0 group by 1")
def valid_reads(spark, sf_dir):
    return _by_name(dsl.valid_for_calling(reads(spark, sf_dir)))


# --- alignments

_WALK = """B as (select qname, rname, flag, seq, qual, pos, cast(pos + m1 + m2 + del + m3 - 1 as bigint) as e, pos + i as p, clip + i + 1 as r from (select *, unnest(generate_series(0, m1 - 1)) as i from RD)
    union all select qname, rname, flag, seq, qual, pos, cast(pos + m1 + m2 + del + m3 - 1 as bigint), pos + m1 + i, clip + m1 + ins + i + 1 from (select *, unnest(generate_series(0, m2 - 1)) as i from RD)
    union all select qname, rname, flag, seq, qual, pos, cast(pos + m1 + m2 + del + m3 - 1 as bigint), pos + m1 + m2 + del + i, clip + m1 + ins + m2 + i + 1 from (select *, unnest(generate_series(0, m3 - 1)) as i from RD)),
 BB as (select rname, cast(p as bigint) as pos, substr(seq, cast(r as int), 1) as base, ascii(substr(qual, cast(r as int), 1)) - 33 as q, flag & 16 <> 0 as reverse, pos > p - 5 or e < p + 5 as ends from B)"""


@query(f"with {_RD}, {_WALK} select rname, pos, base, count(*) as n, cast(sum(q) as bigint) as quality, count(*) filter (ends) as ends from BB group by 1, 2, 3")
def cigar_walk(spark, sf_dir):
    return pileup.bases(reads(spark, sf_dir)).groupBy("rname", "pos", "base").agg(F.count("*").alias("n"), F.sum("qual").cast("long").alias("quality"), F.sum(F.col("end_of_read").cast("long")).alias("ends"))


@query(f"with {_RD}, {_WALK} select rname, base, count(*) filter (ends) as at_end, count(*) filter (not ends) as inside from BB group by 1, 2")
def end_of_read(spark, sf_dir):
    b = pileup.bases(reads(spark, sf_dir))
    return b.groupBy("rname", "base").agg(F.sum(F.col("end_of_read").cast("long")).alias("at_end"), F.sum((~F.col("end_of_read")).cast("long")).alias("inside"))


@query(f"""with {_RD} select place, count(*) as n from (select case when 5 < m1 then clip + 5 when 5 < m1 + m2 then clip + ins + 5 when 5 < m1 + m2 + del then -1 when 5 < m1 + m2 + del + m3 then clip + ins + 5 - del else -1 end as place from RD) group by 1""")
def read_index(spark, sf_dir):
    at = pileup.index_at(F.col("pos"), F.col("cigar"), F.col("pos") + 5)
    return reads(spark, sf_dir).groupBy(at.cast("int").alias("place")).agg(F.count("*").alias("n"))


@query(f"""with {_RD}, {_WALK}, C as (select rname, pos, base, count(*) filter (not reverse) as f, sum(q) filter (not reverse) as fq, count(*) filter (reverse) as r, sum(q) filter (reverse) as rq from BB group by 1, 2, 3)
    select rname, pos, string_agg(base || f || '[' || case when f > 0 then cast(round(fq / f, 2) as varchar) else '0.0' end || ']' || r || '[' || case when r > 0 then cast(round(rq / r, 2) as varchar) else '0.0' end || ']', ';' order by base) as oabs from C group by 1, 2""")
def observed_bases(spark, sf_dir):
    return pileup.observed_text(pileup.by_base(pileup.bases(reads(spark, sf_dir))))


@query(f"""with {_RD}, P as (select rname as contig, pos as s, case when tlen >= 0 then pos + tlen end as e from RD) select contig, cast(sum(e - s + 1) as bigint) as bases, count(*) as fragments from P where e is not null group by 1""")
def physical_spans(spark, sf_dir):
    p = intervals.physical(reads(spark, sf_dir))
    return p.groupBy("contig").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"), F.count("*").alias("fragments"))


@query(f"""with {_RD}, P as (select rname as contig, pos as s, pos + tlen as e from RD where tlen >= 0), FT as (select distinct rname as contig, cast(floor(pos / 1000) as bigint) * 1000 as s from RD where floor(pos / 1000) % 2 = 0),
    E as (select contig, unnest(generate_series(s, s + 99)) as p, contig || '_' || s as name from FT), D as (select E.name, E.p, count(P.s) as d from E left join P on P.contig = E.contig and E.p between P.s and P.e group by 1, 2)
    select name, cast(d as bigint) as depth, count(*) as bases from D group by 1, 2""")
def physical_coverage(spark, sf_dir):
    r = reads(spark, sf_dir)
    starts = r.where("floor(pos / 1000) % 2 = 0").select(F.col("rname").alias("contig"), (F.floor(F.col("pos") / 1000) * 1000).alias("start")).distinct()
    f = starts.select(F.concat_ws("_", "contig", "start").alias("name"), "contig", "start", (F.col("start") + 99).alias("end"))
    return intervals.coverage_histogram(Spans(intervals.physical(r)), Spans(f), "name")


@query(f"""with {_RD}, T as (select *, (flag & 16 <> 0) <> (flag & 32 <> 0) as apart, (pos < pnext and flag & 16 = 0) or (pos > pnext and flag & 16 <> 0) as toward, (pos > pnext and flag & 16 = 0) or (pos < pnext and flag & 16 <> 0) as away from RD),
    U as (select *, case when apart then 'A' else 'B' end || case when apart then case when away then 'B' when toward then 'A' else 'X' end
        else case when (flag & 128 <> 0 and toward) or (flag & 64 <> 0 and away) then 'B' when (flag & 64 <> 0 and toward) or (flag & 128 <> 0 and away) then 'A' else 'X' end end
        || case when abs(tlen) < 100 then 'B' when abs(tlen) > 300 then 'C' else 'A' end as full_class from T)
    select case when flag & 1024 <> 0 then 'Z**' when nh = '1' then case when flag & 8 <> 0 then 'D**' when rnext <> '=' and rnext <> rname then 'C**' when flag & 512 <> 0 then 'E**' else full_class end when full_class = 'AAA' then 'AAA' else 'Z**' end as class, count(*) as n from U group by 1""")
def pair_classes(spark, sf_dir):
    return reads(spark, sf_dir).groupBy(structural.pair_class(100, 300).alias("class")).agg(F.count("*").alias("n"))


@query(f"""with {_RD}, E as (select *, cast(pos + m1 + m2 + del + m3 - 1 as bigint) as e from RD) select case when tlen > 0 and pnext <= e then least(e, pos + tlen - 1) - greatest(pos, pnext) + 1 else 0 end as shared, count(*) as n from E group by 1""")
def pair_geometry(spark, sf_dir):
    return reads(spark, sf_dir).groupBy(structural.pair_overlap().alias("shared")).agg(F.count("*").alias("n"))


@query(f"""with {_RD}, O as (select 0 as source, rname, count(*) as n, cast(sum(pos) as bigint) as sum_pos from RD where flag & 16 = 0 group by 1, 2 union all select 1, rname, count(*), cast(sum(pos) as bigint) from RD where flag & 16 <> 0 group by 1, 2) select * from O""")
def united_reads(spark, sf_dir):
    r = reads(spark, sf_dir)
    both = formats.merged_reads([r.where(F.col("flag").bitwiseAND(F.lit(16)) == 0), r.where(F.col("flag").bitwiseAND(F.lit(16)) != 0)])
    return both.groupBy("source", "rname").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query(f"with {_RD}, K as (select rname, pos, qname, count(*) as n from RD where mapq > 40 group by 1, 2, 3) select rname, pos, qname, n, row_number() over (order by rname, pos, qname) as place from K")
def position_order(spark, sf_dir):
    """The place of each read name in the order of a merged file: a global sort, numbered over its sorted partitions."""
    r = reads(spark, sf_dir).where("mapq > 40").groupBy("rname", "pos", "qname").agg(F.count("*").alias("n"))
    return numbered(formats.merged_reads([r]).drop("source"), "place")


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Row numbers from 1 in the order of a sorted table, without gathering it: each partition's rows follow those before it."""
    from covalens.plans.storage import stored

    once = stored(ordered.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = {x["__p"]: x.n for x in once.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    starts = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    return once.withColumn(name, F.get(starts, F.col("__p")) + F.col("__i") + 1).drop("__p", "__i")


@query("""select contig, case when regexp_matches(b, '^[0-9]+$') then cast(b as int) when b = 'x' then 1000 when b = 'y' then 1001 when b in ('m', 'mt') then 1002 else 1003 end as place, case when upper(s) = 'MT' then 'chrM' else 'chr' || s end as full_name, case when s = 'M' then 'MT' else s end as bare from (
    select contig, regexp_replace(lower(contig), '^chr', '') as b, regexp_replace(contig, '^chr', '') as s from (select distinct case p_size % 6 when 0 then 'chrX' when 1 then 'chrM' when 2 then 'MT' when 3 then 'GL' || p_size when 4 then 'chrY' else 'chr' || p_size end as contig from part))""")
def contig_names(spark, sf_dir):
    name = F.expr("case p_size % 6 when 0 then 'chrX' when 1 then 'chrM' when 2 then 'MT' when 3 then concat('GL', p_size) when 4 then 'chrY' else concat('chr', p_size) end").alias("contig")
    c = F.col("contig")
    return table(spark, sf_dir, "part").select(name).distinct().select("contig", text.contig_rank(c).getField("rank").alias("place"), text.with_prefix(c).alias("full_name"), text.without_prefix(c).alias("bare"))


@query("""with P as (select distinct 'chr' || (l_suppkey % 3 + 1) as contig, cast(l_partkey * 10 as bigint) as pos from lineitem), C as (select distinct 'chr' || (s_suppkey % 3 + 1) as contig, cast(s_suppkey * 100 as bigint) as s, cast(s_suppkey * 100 + 60 as bigint) as e, 'new' || (s_suppkey % 2) as to_contig, cast(s_suppkey * 7 as bigint) as t from supplier)
    select P.contig, P.pos, C.to_contig, C.t + P.pos - C.s as to_pos from P left join C on P.contig = C.contig and P.pos between C.s and C.e""")
def lifted_points(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.expr(FIELDS["rname"]).alias("contig"), (F.col("l_partkey") * 10).alias("pos")).distinct()
    s = F.col("s_suppkey")
    chain = table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), s % 3 + 1).alias("contig"), (s * 100).alias("start"), (s * 100 + 60).alias("end"), F.concat(F.lit("new"), s % 2).alias("to_contig"), (s * 7).alias("to_start")).distinct()
    return structural.lifted(points, chain)


@query("""with S as (select p_partkey, length(p_name) as n from part), B as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey) as k from part) select p_brand, p_partkey, p_size from B where k = 1""")
def best_hit(spark, sf_dir):
    return align.best_hits(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), F.col("p_partkey")])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_hundred(spark, sf_dir):
    return profile.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("select user_id, d from (select user_id, cast(floor(epoch(ts) / 86400) as bigint) as d, string_agg(distinct event_type, ',' order by event_type) as m from events group by 1, 2) where m = 'click'")
def only_one_caller(spark, sf_dir):
    from covalens.plans.queries import reads as events

    return callers.in_exactly(events(spark, sf_dir).withColumn("d", F.floor(F.col("start") / 1440)), "event_type", ["user_id", "d"], ["click"])


@query("select l_returnflag as f, l_linestatus as s, cast(case when count(*) filter (l_quantity > 25) > 0 then floor(count(*) filter (l_discount > 0.05) * 1000 / count(*) filter (l_quantity > 25)) else -1 end as bigint) as scaled from lineitem group by 1, 2")
def motif_scaling(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count_if(F.col("l_discount") > 0.05).alias("raw"), F.count_if(F.col("l_quantity") > 25).alias("total"))
    return g.select("f", "s", motif.scaled(F.col("raw"), 1000, F.col("total")).alias("scaled"))


@query("""with m as (select l_suppkey as k, count(*) as n, count(*) filter (l_returnflag = 'R') as alt, count(*) filter (l_linestatus = 'F') as fwd, count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') as fa, count(*) filter (l_quantity > 40 and l_returnflag = 'R') as high from lineitem group by 1)
    select k, alt * 100 / n >= 20 and alt >= 5 and high >= 2 as snp, case when fwd >= 10 and n - fwd >= 10 then abs(fa * 100 / fwd - (alt - fa) * 100 / (n - fwd)) > 12 else false end as biased from m""")
def position_metrics(spark, sf_dir):
    c = lambda x: F.count_if(F.expr(x))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), c("l_returnflag = 'R'").alias("alt"), c("l_linestatus = 'F'").alias("fwd"), c("l_linestatus = 'F' and l_returnflag = 'R'").alias("fa"), c("l_quantity > 40 and l_returnflag = 'R'").alias("high"))
    snp = structural.snp_passes(F.col("alt"), F.col("n"), F.col("high"), F.lit("A"), 20, 5, 2)
    biased = structural.strand_percent_bias(F.col("fa"), F.nullif("fwd", F.lit(0)), F.col("alt") - F.col("fa"), F.nullif(F.col("n") - F.col("fwd"), F.lit(0)), 10, 12)
    return m.select("k", snp.alias("snp"), biased.alias("biased"))


_INDEL = """select l_suppkey as k, count(*) filter (where l_linestatus = 'F') as c_coverage, count(*) filter (where l_linestatus = 'O') as t_coverage, count(*) filter (where l_linestatus = 'F' and l_quantity > 45) as c_partial, count(*) filter (where l_linestatus = 'O' and l_quantity > 45) as t_partial,
    count(*) filter (where l_linestatus = 'F' and l_quantity < 5) as c_support, count(*) filter (where l_linestatus = 'O' and l_quantity < 5) as t_support, count(*) filter (where l_linestatus = 'F' and l_quantity < 5 and l_linenumber % 2 = 0) as c_forward, count(*) filter (where l_linestatus = 'F' and l_quantity < 5 and l_linenumber % 2 = 1) as c_reverse,
    count(*) filter (where l_linestatus = 'O' and l_quantity < 5 and l_linenumber % 2 = 0) as t_forward, count(*) filter (where l_linestatus = 'O' and l_quantity < 5 and l_linenumber % 2 = 1) as t_reverse, count(distinct l_partkey) filter (where l_linestatus = 'F' and l_quantity < 5) as c_novel, count(distinct l_partkey) filter (where l_linestatus = 'O' and l_quantity < 5) as t_novel, l_suppkey % 2 = 0 as somatic from lineitem group by l_suppkey"""


@query(f"""with I as ({_INDEL}) select k, case when f = '' then 'PASS' else f end as filters from (select k, concat_ws(';', case when c_coverage > 1000 then 'HCOVN' end, case when t_coverage > 1000 then 'HCOVT' end, case when somatic and t_coverage < 8 then 'COVT' end, case when somatic and c_coverage < 12 then 'COVN12' end,
    case when not somatic and c_coverage < 8 then 'COVN8' end, case when c_coverage > 0 and c_partial >= 3 and floor(c_partial * 100 / c_coverage) > 5 then 'NPART' end, case when t_coverage > 0 and t_partial >= 3 and floor(t_partial * 100 / t_coverage) > 10 then 'TPART' end,
    case when not somatic and c_support > 0 and (c_forward = 0 or c_reverse = 0) then 'NBIAS' end, case when somatic and t_support > 0 and (t_forward = 0 or t_reverse = 0) then 'TBIAS' end, case when case when somatic then t_novel else c_novel end < 4 then 'NNS' end) as f from I)""")
def indel_verdict(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem")
    counts.createOrReplaceTempView("covalens_lineitem")
    found = spark.sql(_INDEL.replace("from lineitem", "from covalens_lineitem"))
    return structural.indel_filters(found).select("k", "filters")


# --- text

_KV = "concat('a=', l_suppkey, chr(9), 'key=', l_partkey, chr(9), 'z=', l_linenumber)"


@query(f"select k, v, n from (select string_split(split_part(s, 'key=', 2), chr(9))[1] as k, case when contains(s, 'none=') then '' end as v, count(*) as n from (select {_KV} as s from lineitem) group by 1, 2)")
def key_values(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.expr(_KV).alias("s"))
    return s.groupBy(text.value_of(F.col("s"), "key").alias("k"), text.value_of(F.col("s"), "none").alias("v")).agg(F.count("*").alias("n"))


_ODD = "case p_size % 7 when 0 then null when 1 then '' when 2 then ' ' when 3 then '.' when 4 then './.' when 5 then '12' else concat('-', p_size) end"


@query(f"select s, s is null or trim(s) in ('', '.', './.', '.|.') as missing, coalesce(regexp_matches(s, '^-?[0-9]+$'), false) as whole, coalesce(try_cast(s as double), 0) as number, count(*) as n from (select {_ODD} as s from part) group by 1, 2, 3, 4")
def missing_and_numbers(spark, sf_dir):
    c = F.col("s")
    return table(spark, sf_dir, "part").select(F.expr(_ODD).alias("s")).groupBy("s", text.missing(c).alias("missing"), text.is_integer(c).alias("whole"), text.number_or_zero(c).alias("number")).agg(F.count("*").alias("n"))


@query("""select p_partkey, case when length(p_type) >= 12 then p_type else lpad(p_type, 12, '*') end as left_pad, case when length(p_type) >= 12 then p_type else rpad(p_type, 12, '*') end as right_pad, case when p_size % 3 = 0 then p_type when contains(p_name, p_type) then p_name else p_name || ',' || p_type end as added from part""")
def padded_and_joined(spark, sf_dir):
    base = F.when(F.col("p_size") % 3 == 0, ".").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.padded(F.col("p_type"), 12, "*").alias("left_pad"), text.padded(F.col("p_type"), 12, "*", left=False).alias("right_pad"), text.appended(base, F.col("p_type")).alias("added"))


@query("select item_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as int) as n, position('the' in text) as first_at from benchmark")
def occurrence_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.occurrences(F.col("text"), "the").alias("n"), F.instr("text", "the").cast("long").alias("first_at"))


_POS = "case when p_size % 5 = 0 then concat('chr', p_size) else concat('chr', p_size % 3, ':', p_size, '-', p_partkey) end"


@query(f"select s, case when regexp_matches(s, '^.+:\\d+-\\d+$') then regexp_extract(s, '^(.+):(\\d+)-(\\d+)$', 1) end as contig, case when regexp_matches(s, '^.+:\\d+-\\d+$') then cast(regexp_extract(s, '^(.+):(\\d+)-(\\d+)$', 2) as bigint) end as start_pos, case when regexp_matches(s, '^.+:\\d+-\\d+$') then cast(regexp_extract(s, '^(.+):(\\d+)-(\\d+)$', 3) as bigint) end as end_pos from (select distinct {_POS} as s from part)")
def parsed_positions(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.expr(_POS).alias("s")).distinct().withColumn("p", text.position(F.col("s")))
    return s.select("s", F.col("p.contig").alias("contig"), F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"))


# --- sequences

_SEQ = "substr('ACGTTGCAAACCGGTTNACGT', cast(p_partkey % 9 + 1 as int), cast(p_size % 11 + 1 as int))"


@query(f"""select s, cast(contains(s, 'A') as int) + cast(contains(s, 'C') as int) + cast(contains(s, 'G') as int) + cast(contains(s, 'T') as int) as kinds, len(regexp_extract_all(s, 'A+')) as blocks, cast(length(s) - length(replace(s, 'A', '')) as int) as total,
    cast(case when regexp_matches(s, '^[ACGT]+$') then list_sum(list_transform(range(1, length(s) + 1), lambda i: (instr('ACGT', substr(s, i, 1)) - 1) * pow(4, i - 1))) else -1 end as bigint) as tile from (select distinct {_SEQ} as s from part)""")
def sequence_codes(spark, sf_dir):
    s = F.col("s")
    b = sequence.block_counts(s, "A")
    return table(spark, sf_dir, "part").select(F.expr(_SEQ).alias("s")).distinct().select("s", sequence.complexity(s).alias("kinds"), b.getField("blocks").cast("long").alias("blocks"), b.getField("total").alias("total"), sequence.tile_code(s).alias("tile"))


@query(f"with {_RD} select qual, shifted, count(*) as n from (select qual, list_aggregate(list_transform(string_split(qual, ''), lambda x: chr(ascii(x) + 31)), 'string_agg', '') as shifted from RD) group by 1, 2")
def shifted_qualities(spark, sf_dir):
    q = F.col("qual")
    return reads(spark, sf_dir).groupBy("qual", sequence.shifted_qualities(q, 31).alias("shifted")).agg(F.count("*").alias("n"))


@query("""select code, case code when 'A' then 'A' when 'C' then 'C' when 'G' then 'G' when 'T' then 'T' when 'R' then 'A,G' when 'Y' then 'C,T' when 'S' then 'C,G' when 'W' then 'A,T' when 'K' then 'G,T' when 'M' then 'A,C' when 'V' then 'A,C,G' when 'H' then 'A,C,T' when 'D' then 'A,G,T' when 'B' then 'C,G,T' when 'N' then 'A,C,G,T' end as bases,
    translate(code, 'ACGTacgt', 'TGCAtgca') as paired, count(*) as n from (select substr('ACGTRYSWKMVHDBNXZ', cast(p_size % 17 + 1 as int), 1) as code from part) group by 1, 2, 3""")
def iupac_codes(spark, sf_dir):
    c = F.col("code")
    return table(spark, sf_dir, "part").select(F.expr("substring('ACGTRYSWKMVHDBNXZ', cast(p_size % 17 + 1 as int), 1)").alias("code")).groupBy("code", F.array_join(sequence.alleles_of(c), ",").alias("bases"), sequence.complement(c).alias("paired")).agg(F.count("*").alias("n"))


@query("""with p as (select a.p_partkey as k, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1) select k, cast(coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) - 1, least(length(a), length(b))) as int) as shared, cast(levenshtein(substr(a, 1, length(b)), b) as int) as edits from p""")
def prefixes_and_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pair = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b")), "k")
    return pair.select("k", sequence.common_prefix_length(F.col("a"), F.col("b")).alias("shared"), sequence.edit_to_primer(F.col("a"), F.col("b")).alias("edits"))


_ENDS = "select item_id, substr(text, 1, 40) as a, substr(text, cast(20 + item_id % 20 as int), 40) as b from benchmark where length(text) >= 80"


@query(f"""with p as ({_ENDS}), q as (select *, instr(b, right(a, 10)) as i, instr(a, right(b, 10)) as j from p) select item_id, case when length(a) >= 10 and i > 0 then a || substr(b, cast(i + 10 as int)) when length(b) >= 10 and j > 0 then b || substr(a, cast(j + 10 as int)) end as whole from q""")
def merged_fragments(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").where("length(text) >= 80").selectExpr("item_id", "substr(text, 1, 40) as a", "substr(text, cast(20 + item_id % 20 as int), 40) as b")
    return p.select("item_id", sequence.merged_pair(F.col("a"), F.col("b")).alias("whole"))


# --- variants

_GT = "concat(l_linenumber % 3, case when l_partkey % 2 = 0 then '/' else '|' end, l_suppkey % 3)"


@query(f"""with g as (select {_GT} as a, concat(l_suppkey % 3, '/', l_orderkey % 3) as b, substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) as x, substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as y from lineitem)
    select least(x, y) || '/' || greatest(x, y) as pair, list_sort(string_split(replace(a, '|', '/'), '/')) = list_sort(string_split(b, '/')) as same, case x when 'A' then 0 when 'C' then 1 when 'T' then 2 end as idx, count(*) as n from g group by 1, 2, 3""")
def genotype_algebra(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").selectExpr(f"{_GT} as a", "concat(l_suppkey % 3, '/', l_orderkey % 3) as b", "substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) as x", "substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as y")
    a, b, x, y = map(F.col, "abxy")
    return g.groupBy(variants.genotype(x, y).alias("pair"), variants.same_genotype(a, b).alias("same"), variants.gt_index(x, F.lit("C,T"), F.lit("A")).cast("int").alias("idx")).agg(F.count("*").alias("n"))


_ALLELES = "select l_orderkey as k, l_linenumber as i, substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref, substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt from lineitem"


@query(f"""with v as ({_ALLELES}), t as (select *, case when length(ref) = length(alt) then 'SUB' when length(ref) = 1 then 'INS' when length(alt) = 1 then 'DEL' else 'CTX' end as kind from v)
    select kind, case kind when 'INS' then substr(alt, 2) when 'DEL' then substr(ref, 2) else ref end as motif, count(*) as n from t group by 1, 2""")
def indel_motifs(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").selectExpr("substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref", "substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt")
    kind = variants.variant_type(F.col("ref"), F.col("alt"))
    v = v.withColumn("kind", F.when(kind.isin("SNP", "DNP", "TNP", "ONP"), "SUB").otherwise(kind))
    return v.groupBy("kind", variants.indel_motif(F.col("kind"), F.col("ref"), F.col("alt")).alias("motif")).agg(F.count("*").alias("n"))


@query(f"""with v as (select k * 10 as pos, ref, alt from ({_ALLELES}) where length(ref) = length(alt)), e as (select *, unnest(generate_series(0, length(ref) - 1)) as z from v)
    select cast(pos + z as bigint) as pos, substr(ref, cast(z + 1 as int), 1) as ref, substr(alt, cast(z + 1 as int), 1) as alt, count(*) as n from e group by 1, 2, 3""")
def compound_split(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 as pos", "substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref", "substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt").where("length(ref) = length(alt)")
    return v.select(F.explode(variants.split_compound(F.col("pos"), F.col("ref"), F.col("alt"))).alias("x")).groupBy("x.pos", "x.ref", "x.alt").agg(F.count("*").alias("n"))


_OABS = "concat('A', l_linenumber, '[30.0]', cast(l_quantity as int), '[31.5];C', l_partkey % 7, '[2]0[0];T0[0]', l_suppkey % 5, '[9.25]')"


@query("""select cast(l_linenumber + cast(l_quantity as int) as bigint) as a, l_partkey % 7 as c, l_suppkey % 5 as t, concat(l_partkey % 7, ',', l_linenumber + cast(l_quantity as int), ',0,', l_suppkey % 5) as ad, count(*) as n from lineitem group by all""")
def allele_depths(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(variants.observed_alleles(F.expr(_OABS)).alias("m"))
    at = lambda b: F.col("m")[b].cast("long")
    return m.groupBy(at("A").alias("a"), at("C").alias("c"), at("T").alias("t"), variants.allele_depths(F.lit("C"), F.lit("A,G,T"), F.col("m")).alias("ad")).agg(F.count("*").alias("n"))


@query("""with m as (select l_suppkey as k, count(*) filter (l_returnflag = 'R') as alt, count(*) as total, count(distinct l_partkey) filter (l_returnflag = 'R') as novel from lineitem group by 1)
    select k, case when alt = 0 or alt < 3 then false else cast(alt as float) >= greatest(cast(3 as float), cast(total / 100 * 25 as float)) end as in_normal, case when total % 2 = 0 and novel >= 4 and alt >= 5 then 'HIGH' when total % 2 = 0 and novel >= 4 and alt >= 4 then 'LOW' else 'ZERO' end as confidence from m""")
def calls_in_normal(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("alt"), F.count("*").alias("total"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("novel"))
    sure = variants.confidence(F.lit("SNP"), F.col("novel"), F.col("alt"), F.col("total") % 2 == 0)
    return m.select("k", variants.mutation_in_normal(F.col("alt"), F.col("total"), 3, 25).alias("in_normal"), sure.alias("confidence"))


@query("""with r as (select * from (values ('R', 1), ('A', 2)) as t(term, rank)) select k, term, rank, length from (select l_suppkey as k, l_returnflag as term, r.rank, l_partkey as length, row_number() over (partition by l_suppkey order by r.rank, l_partkey desc, l_returnflag) as i from lineitem join r on r.term = l_returnflag) where i = 1""")
def ranked_effects(spark, sf_dir):
    effects = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("term"), F.col("l_partkey").alias("length"))
    return annotate.ranked_effect(effects, ["k"], spark.createDataFrame([("R", 1), ("A", 2)], "term string, rank int"))


@query(f"""with v as (select distinct cast(k % 500 as bigint) as pos, ref, alt from ({_ALLELES})), d as (select distinct cast(k % 500 - 1 as bigint) as pos, 'T' || ref as ref, 'T' || alt as alt from ({_ALLELES}) where k % 3 = 0) select v.pos, v.ref, v.alt, count(*) as n from v join d on v.pos = d.pos + 1 and substr(d.ref, 2) = v.ref and substr(d.alt, 2) = v.alt group by 1, 2, 3""")
def database_alleles(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref", "substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt")
    v = a.selectExpr("k % 500 as pos", "ref", "alt").distinct()
    d = a.where("k % 3 = 0").selectExpr("k % 500 - 1 as d_pos", "concat('T', ref) as d_ref", "concat('T', lower(alt)) as d_alt").distinct()
    # a database allele starts at most a base before the variant, so the join stays an equality
    near = v.join(d, F.col("pos") == F.col("d_pos") + 1)
    return near.where(annotate.allele_trimmed(F.col("pos"), F.col("ref"), F.col("alt"), F.col("d_pos"), F.col("d_ref"), F.col("d_alt"))).groupBy("pos", "ref", "alt").agg(F.count("*").alias("n"))


@query("""select p_partkey, p_size * 3 + cast(floor(p_partkey % 9 / 2) as bigint) - p_size % 4 - p_partkey % 3 - p_partkey % 2 as score from part""")
def alignment_scores(spark, sf_dir):
    hits = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 3 as bigint) as matches", "p_partkey % 9 as rep_matches", "p_size % 4 as mismatches", "p_partkey % 3 as q_gaps", "p_partkey % 2 as t_gaps")
    return structural.psl_score(hits).select("p_partkey", "score")
