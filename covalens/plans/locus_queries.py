"""Packed numbers, verdicts, reference bases and calls over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from covalens.functions import records
from covalens.operators import annotate, loci, pileup
from covalens.plans.queries import query, table
from covalens.plans.record_queries import _ALLELES, _RD, _WALK, reads


@query("""select p_partkey, case p_brand when 'Brand#11' then 0 when 'Brand#12' then 1 when 'Brand#23' then 2 else -1 end as place, coalesce(list_position(['economy', 'standard'], lower(string_split(p_type, ' ')[1])), 0) - 1 as folded, string_split(p_type, ' ')[len(string_split(p_type, ' '))] || '-' || string_split(p_type, ' ')[1] as picked from part""")
def array_places(spark, sf_dir):
    words = F.split("p_type", " ")
    brands = F.array(*map(F.lit, ("Brand#11", "Brand#12", "Brand#23")))
    kinds = F.array(F.lit("Economy"), F.lit("STANDARD"))
    return table(spark, sf_dir, "part").select("p_partkey", records.place_of(brands, F.col("p_brand")).alias("place"), records.place_of(kinds, F.get(words, F.lit(0)), True).alias("folded"), F.array_join(records.picked(words, F.array(F.size(words) - 1, F.lit(0))), "-").alias("picked"))


@query("""select high, low, (high << 16) | (low & 65535) as packed, b + 1099511627776 as with_bit, (b >> 3) & 1 = 1 as has_bit, b - 4 as without_bit, count(*) as n from (select cast(l_linenumber * 100 as int) as high, cast(cast(l_quantity as int) - 25 as int) as low, cast(l_partkey as bigint) as b from lineitem) group by all""")
def packed_bits(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("cast(l_linenumber * 100 as int) as high", "cast(cast(l_quantity as int) - 25 as int) as low", "cast(l_partkey as bigint) as b")
    p = records.packed_shorts(F.col("high"), F.col("low"))
    x = x.withColumn("packed", p).withColumn("back", records.unpacked_shorts(F.col("packed")))
    return x.groupBy(F.col("back.high").alias("high"), F.col("back.low").alias("low"), "packed", records.bit_added(F.col("b"), 40).alias("with_bit"), records.bit_set(F.col("b"), 3).alias("has_bit"), records.bit_taken(F.col("b"), 2).alias("without_bit")).agg(F.count("*").alias("n"))


@query("""with d as (select l_suppkey as k, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as c, count(*) filter (l_returnflag = 'R') as g, cast(sum(l_partkey) as bigint) as t from lineitem group by 1)
    select k, case when t > 65535 then -9223372036854775808 else a * 281474976710656 + c * 4294967296 + g * 65536 + t end as packed, case when t > 65535 then 0 else t end as t from d""")
def packed_distributions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("g"), F.sum("l_partkey").alias("t"))
    packed = records.packed_counts(F.col("a"), F.col("c"), F.col("g"), F.col("t"))
    return d.select("k", packed.alias("packed"), F.get(records.unpacked_counts(packed), F.lit(3)).alias("t"))


@query("""select p_partkey, p_size as a, p_size % 7 as c, 0 as g, p_size % 3 as t, p_size + p_size % 7 + p_size % 3 as total, case when p_size % 4 <> 0 then p_size % 7 end as second from part""")
def coverage_texts(spark, sf_dir):
    s = "concat('A:', p_size, ',C:', p_size % 7, ',T:', p_size % 3, ',TOTAL:', p_size + p_size % 7 + p_size % 3)"
    dashed = "case when p_size % 4 = 0 then concat('x-', p_size) else concat(p_size, '-', p_size % 7, '-0-', p_size % 3) end"
    c = records.coverage_counts(F.expr(s))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("x"), F.get(records.dashed_counts(F.expr(dashed)), F.lit(1)).alias("second")).select("p_partkey", "x.*", "second")


@query("""select p_partkey, alt, concat(p_size, ',', case i when 1 then p_size % 9 when 2 then p_partkey else 3 end) as depths from (select *, unnest(['T', 'G', 'C']) as alt, unnest([1, 2, 3]) as i from part)""")
def split_depths(spark, sf_dir):
    alts = F.lit("T,G,C")
    d = records.split_depths(alts, F.concat_ws(",", "p_size", F.col("p_size") % 9, "p_partkey", F.lit(3)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.arrays_zip(F.split(alts, ",").alias("alt"), d.alias("depths"))).alias("x")).select("p_partkey", "x.alt", "x.depths")


_MARKS = "case when l_linenumber % {m} = 0 then 'PASS' else 'COV' end"


@query(f"""with s as (select l_orderkey as k, l_partkey % 3 = 0 as som, [{_MARKS.format(m=2)}, {_MARKS.format(m=3)}, case when l_suppkey % 2 = 0 then 'PASS' else 'NNS' end] as f, case when l_suppkey % 4 = 0 then 'DP=1;SOMATIC' else 'DP=2' end as info, [case when l_linenumber % 2 = 0 then 'SOMATIC' else '.' end, case when l_partkey % 2 = 0 then 'SOMATIC' else '.' end] as marks, case when l_linenumber % 3 = 0 then null else 2 end as callers from lineitem)
    select case when not list_contains(f, 'PASS') then false when f[1] = 'PASS' and f[2] = 'PASS' and f[3] = 'PASS' then true else not som and f[1] = 'PASS' and f[3] = 'PASS' end as passes,
        contains(info, 'SOMATIC') or case when callers is null then len(list_filter(marks, lambda x: x = 'SOMATIC')) * 2 >= 2 else len(list_filter(marks, lambda x: x = 'SOMATIC')) >= callers end as somatic, count(*) as n from s group by 1, 2""")
def record_verdicts(spark, sf_dir):
    m = lambda x: F.expr(_MARKS.format(m=x))
    li = table(spark, sf_dir, "lineitem")
    f = F.array(m(2), m(3), F.when(F.col("l_suppkey") % 2 == 0, "PASS").otherwise("NNS"))
    marks = F.array(F.when(F.col("l_linenumber") % 2 == 0, "SOMATIC").otherwise("."), F.when(F.col("l_partkey") % 2 == 0, "SOMATIC").otherwise("."))
    info = F.when(F.col("l_suppkey") % 4 == 0, "DP=1;SOMATIC").otherwise("DP=2")
    callers = F.when(F.col("l_linenumber") % 3 != 0, 2)
    return li.groupBy(records.record_passes(f, F.col("l_partkey") % 3 == 0).alias("passes"), records.is_somatic(info, marks, callers).alias("somatic")).agg(F.count("*").alias("n"))


@query("""select confidence, count(*) as n from (select case when f = 'PASS' and nearby <= 0.05 and run <= 6 and case when som then 1.0 else strong end >= 0.2 then 'HIGH' when contains(f, 'HCOVN') or contains(f, 'REPEAT') then 'ZERO' else 'LOW' end as confidence
    from (select case l_linenumber % 4 when 0 then 'PASS' when 1 then 'NNS;HCOVN' when 2 then 'REPEAT' else 'NPART' end as f, l_discount as nearby, l_suppkey % 9 as run, l_tax * 5 as strong, l_returnflag = 'R' as som from lineitem)) group by 1""")
def indel_confidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").selectExpr("case l_linenumber % 4 when 0 then 'PASS' when 1 then 'NNS;HCOVN' when 2 then 'REPEAT' else 'NPART' end as f", "l_discount as nearby", "l_suppkey % 9 as run", "l_tax * 5 as strong", "l_returnflag = 'R' as som")
    c = records.indel_confidence(F.col("f"), F.col("nearby"), F.col("run"), F.col("strong"), F.col("som"), 0.05, 6, 0.2)
    return li.groupBy(c.alias("confidence")).agg(F.count("*").alias("n"))


@query(f"""with {_RD}, E as (select distinct unnest(regexp_extract_all(cigar, '\\d+[MIDS]')) as element from RD) select element, row_number() over (order by right(element, 1), cast(regexp_extract(element, '(\\d+)', 1) as int)) as place from E""")
def cigar_order(spark, sf_dir):
    e = reads(spark, sf_dir).select(F.explode(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDS])"), F.lit(1))).alias("element")).distinct()
    # there are as many different elements as operators and lengths
    return loci.numbered_orders(e, [records.cigar_key(F.col("element"))]).withColumn("place", F.col("place").cast("long"))


# --- reference bases

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz ", "AACCGGTTAACCGGTTAACCGGTTACG"
_REF = f"REF as (select concat('c', item_id) as contig, translate(lower(text), '{_LETTERS}', '{_BASES}') as sequence from benchmark), V as (select contig, sequence, unnest(generate_series(-3, length(sequence) + 3, 7)) as pos from REF)"


def _reference(spark, sf_dir):
    ref = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), "item_id").alias("contig"), F.translate(F.lower("text"), _LETTERS, _BASES).alias("sequence"))
    at = ref.select("contig", F.explode(F.sequence(F.lit(-3).cast("long"), F.length("sequence").cast("long") + 3, F.lit(7).cast("long"))).alias("pos"))
    return loci.chunked(ref, 64), at


@query(f"with {_REF} select contig, pos as start_pos, pos + 99 as end_pos, substr(sequence, cast(greatest(pos, 1) as int), cast(greatest(least(pos + 99, length(sequence)) - greatest(pos, 1) + 1, 0) as int)) as bases from V")
def reference_bases(spark, sf_dir):
    chunks, at = _reference(spark, sf_dir)
    got = loci.looked_up(at.select("contig", F.col("pos").alias("start"), (F.col("pos") + 99).alias("end")), chunks, 64)
    return got.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(f"with {_REF}, P as (select contig, pos, repeat('-', 20) || sequence || repeat('-', 20) as padded from V) select contig, pos, substr(padded, cast(pos + 15 as int), 5) || 'X' || substr(padded, cast(pos + 21 as int), 5) as flank from P")
def flanking_bases(spark, sf_dir):
    chunks, at = _reference(spark, sf_dir)
    return loci.flanked(at.withColumn("alt", F.lit("X")), chunks, 5, 64).select("contig", "pos", "flank")


@query(f"""with {_REF}, K as (select *, case pos % 3 when 0 then 'INS' when 1 then 'DEL' else 'SNP' end as kind from V where pos >= 2 and pos + 3 <= length(sequence)),
    A as (select contig, pos, kind, sequence, case kind when 'DEL' then substr(sequence, cast(pos as int), 3) else substr(sequence, cast(pos as int), 1) end as ref from K),
    M as (select *, case kind when 'INS' then 'AC' when 'DEL' then substr(ref, 2) else ref end as motif, cast(case when kind = 'SNP' then pos - 1 else pos end as int) as u, cast(pos + length(ref) - 1 as int) as e from A),
    B as (select *, substr(sequence, greatest(u - 9, 1), u - greatest(u - 9, 1) + 1) as up, substr(sequence, e + 1, 10) as down from M),
    L as (select *, right(up, 1) as x, left(down, 1) as y, greatest(length(up) - length(rtrim(up, right(up, 1))), 1) as nu, greatest(case when down = '' then 0 else length(down) - length(ltrim(down, left(down, 1))) end, 1) as nd,
        case when up = '' then 0 else length(motif) - length(ltrim(motif, right(up, 1))) end as l, case when down = '' then 0 else length(motif) - length(rtrim(motif, left(down, 1))) end as r from B),
    T as (select *, case when kind = 'INS' then case when x = y and x <> '' then nu + nd else greatest(nu, nd) end when l = length(motif) and r = length(motif) then nu + nd + length(motif) else greatest(nu + l, nd + r) end as most from L)
    select contig, pos, kind, ref, case when most = 1 then 0 else most end as homopolymer from T""")
def homopolymer_runs(spark, sf_dir):
    chunks, at = _reference(spark, sf_dir)
    lengths = chunks.groupBy("contig").agg(F.sum(F.length("bases")).alias("length"))
    v = at.join(lengths, "contig").where("pos >= 2 and pos + 3 <= length").drop("length")
    v = v.withColumn("kind", F.expr("case pos % 3 when 0 then 'INS' when 1 then 'DEL' else 'SNP' end"))
    v = loci.looked_up(v.withColumns({"start": F.col("pos"), "end": F.when(F.col("kind") == "DEL", F.col("pos") + 2).otherwise(F.col("pos"))}), chunks, 64).withColumnRenamed("bases", "ref").drop("start", "end")
    v = v.withColumn("alt", F.when(F.col("kind") == "INS", F.concat("ref", F.lit("AC"))).otherwise(F.left("ref", F.lit(1))))
    return loci.homopolymers(v, chunks, 10, 64).select("contig", "pos", "kind", "ref", F.col("homopolymer").cast("long").alias("homopolymer"))


# --- alleles at a position

_COUNTS = f"{_RD}, {_WALK}, N as (select rname, pos, base, count(*) as n, cast(sum(q) as bigint) as quality, substr('ACGT', cast(pos % 4 + 1 as int), 1) as ref from BB group by 1, 2, 3)"


def _counts(spark, sf_dir):
    b = pileup.bases(reads(spark, sf_dir)).groupBy("rname", "pos", "base").agg(F.count("*").alias("n"), F.sum("qual").cast("long").alias("quality"))
    return b.withColumn("ref", F.substring(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))


@query(f"with {_COUNTS} select rname, pos, string_agg(base, '/' order by n desc, quality desc, base) as alleles from (select *, row_number() over (partition by rname, pos order by n desc, quality desc, base) as k from N) where k <= 2 group by 1, 2")
def two_alleles(spark, sf_dir):
    return loci.two_alleles(_counts(spark, sf_dir), ["rname", "pos"])


@query(f"with {_COUNTS} select rname, pos, base, n from (select *, row_number() over (partition by rname, pos order by n desc, base) as k from N where base <> ref) where k = 1")
def largest_variant(spark, sf_dir):
    return loci.largest_variant(_counts(spark, sf_dir), ["rname", "pos"], "ref")


@query(f"with {_RD} select mapq, 'rname' as dimension, rname as value, count(*) as n from RD group by 1, 3 union all select mapq, 'flag', cast(flag as varchar), count(*) from RD group by 1, 3")
def mapping_matrix(spark, sf_dir):
    return loci.mapping_matrix(reads(spark, sf_dir), ["rname", "flag"])


@query(f"with {_RD}, P as (select zm as rg, rname, pos, count(*) as n from RD group by 1, 2, 3) select rg, rname, cast(floor(pos / 500) as bigint) as bin, cast(sum(n) as bigint) as n, max(n) as most from P group by 1, 2, 3")
def position_bins(spark, sf_dir):
    return loci.position_bins(reads(spark, sf_dir).withColumn("rg", F.col("tags")["ZM"]), "rg", 500)


@query(f"with {_RD} select length(regexp_replace(regexp_replace(md, '\\^[A-Za-z]+', '', 'g'), '[^A-Za-z]', '', 'g')) as mismatches, flag & 1024 <> 0 as duplicate, count(*) as n from RD group by 1, 2")
def mismatch_counts(spark, sf_dir):
    md = F.regexp_replace(F.regexp_replace(F.col("tags")["MD"], r"\^[A-Za-z]+", ""), "[^A-Za-z]", "")
    return reads(spark, sf_dir).groupBy(F.length(md).cast("long").alias("mismatches"), (F.col("flag").bitwiseAND(F.lit(1024)) != 0).alias("duplicate")).agg(F.count("*").alias("n"))


@query(f"""with {_RD}, P as (select distinct 'chr' || (s_suppkey % 3 + 1) as contig, cast(s_suppkey * 20 as bigint) as pos from supplier), E as (select *, pos + m1 + m2 + del + m3 - 1 as e from RD where flag & 1028 = 0) select P.contig, P.pos, count(*) as n, count(distinct qname) as names from P join E on P.contig = E.rname and P.pos between E.pos and E.e group by 1, 2""")
def spanning_reads(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey") % 3 + 1).alias("contig"), (F.col("s_suppkey") * 20).alias("pos")).distinct()
    return loci.spanning(reads(spark, sf_dir), p).groupBy("contig", "pos").agg(F.count("*").alias("n"), F.count_distinct("qname").alias("names"))


# --- calls and reads set against each other


@query(f"""with v as (select distinct k % 300 as pos, ref, alt from ({_ALLELES})), s as (select l_orderkey % 300 as pos, lower(substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int))) as ref, substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt, l_extendedprice as score, l_partkey as i from lineitem where l_partkey % 2 = 0),
    f as (select * from (select *, row_number() over (partition by pos, ref, alt order by i, score) as r from s) where r = 1) select v.pos, v.ref, v.alt, f.score from v left join f on v.pos = f.pos and lower(v.ref) = f.ref and v.alt = f.alt""")
def scores_by_allele(spark, sf_dir):
    """Scores by position and alleles, whatever their case; of the rows of one key the first counts."""
    a = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 300 as pos", "substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as ref", "substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as alt", "l_partkey as i", "l_extendedprice as score")
    source = a.where("i % 2 = 0").withColumn("ref", F.lower("ref"))
    return annotate.first_match(a.select("pos", "ref", "alt").distinct(), source, ["pos", "ref", "alt"], ["i", "score"], ["score"], ignore_case=["ref", "alt"])


_CALLS = "select o_orderkey % 1000 as pos, min(case o_orderpriority when '1-URGENT' then 'A' when '2-HIGH' then 'C,T' else 'G' end) as alt, min(case o_custkey % 3 when 0 then '0/1' when 1 then '1/1' else './.' end) as gt from {t} where o_orderkey % 3 {c} group by 1"


@query(f"""with c as ({_CALLS.format(t='orders', c='= 0')}), t as ({_CALLS.format(t='orders', c='<> 0')}), j as (select coalesce(c.pos, t.pos) as pos, c.alt as ca, t.alt as ta, c.gt as cg, t.gt as tg, c.alt is not null and t.alt is not null and c.alt <> t.alt as apart, len(string_split(c.alt, ',')) as k from c full join t on c.pos = t.pos)
    select pos, case when apart then ca || ',' || ta else coalesce(ca, ta) end as alt, coalesce(cg, './.') as c_gt, coalesce(case when apart then replace(tg, '1', cast(1 + k as varchar)) else tg end, './.') as t_gt from j""")
def merged_calls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 1000 as pos", "case o_orderpriority when '1-URGENT' then 'A' when '2-HIGH' then 'C,T' else 'G' end as alt", "case o_custkey % 3 when 0 then '0/1' when 1 then '1/1' else './.' end as gt")
    side = lambda c: o.where(f"o_orderkey % 3 {c}").groupBy("pos").agg(F.min("alt").alias("alt"), F.min("gt").alias("gt"))
    return loci.merged_calls(side("= 0"), side("<> 0"), ["pos"])


@query("select c_custkey, c_name from customer where c_name not in (select c_name from customer where c_acctbal < 0)")
def excluded_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return loci.excluded(c.select("c_custkey", "c_name"), c.where("c_acctbal < 0"), "c_name")


@query(f"""with {_RD}, a as (select qname, pos, cigar from RD where mapq % 2 = 0), b as (select qname, case when mapq % 3 = 0 then pos + 1 else pos end as pos, cigar from RD where mapq % 5 <> 0) select 'a' as side, * from (select * from a except all select * from b) union all select 'b', * from (select * from b except all select * from a)""")
def aligner_difference(spark, sf_dir):
    r = reads(spark, sf_dir)
    a = r.where("mapq % 2 = 0").select("qname", "pos", "cigar")
    b = r.where("mapq % 5 <> 0").select("qname", F.expr("case when mapq % 3 = 0 then pos + 1 else pos end").alias("pos"), "cigar")
    return loci.differing(a, b)


@query("""select l_returnflag as filter, l_linestatus as class, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size > 25) group by 1, 2""")
def classified_positions(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("pos"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("filter"), F.col("l_linestatus").alias("class"))
    return loci.classified_positions(wanted, calls, ["pos"], ["filter", "class"])


@query(f"with {_RD} select cast(nh as int) as route, false as tagged, count(*) as n from RD where nh is not null group by 1")
def reads_by_tag(spark, sf_dir):
    r = reads(spark, sf_dir).where(F.col("tags")["NH"].isNotNull())
    return loci.routed(r, "NH", [1, 2, 3]).groupBy("route", F.map_contains_key("tags", "NH").alias("tagged")).agg(F.count("*").alias("n"))


@query(f"with {_RD} select 'lane1' as rg, zm, count(*) as n from RD group by 2")
def replaced_read_group(spark, sf_dir):
    r = loci.with_read_group(loci.with_read_group(reads(spark, sf_dir), "old"), "lane1")
    return r.groupBy(F.col("tags")["RG"].alias("rg"), F.col("tags")["ZM"].alias("zm")).agg(F.count("*").alias("n"))


@query(f"with {_RD} select flag & 1024 <> 0 as duplicate, count(*) filter (flag & 1024 = 0) as with_seq, cast(coalesce(sum(length(qual)) filter (flag & 1024 = 0), 0) as bigint) as quals, count(*) as n from RD group by 1")
def reads_without_bases(spark, sf_dir):
    duplicate = F.col("flag").bitwiseAND(F.lit(1024)) != 0
    r = loci.without_bases(reads(spark, sf_dir), duplicate)
    return r.groupBy(duplicate.alias("duplicate")).agg(F.count("seq").alias("with_seq"), F.coalesce(F.sum(F.length("qual")), F.lit(0)).alias("quals"), F.count("*").alias("n"))
