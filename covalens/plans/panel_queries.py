"""Annotation texts, probes, regions and clipped ends over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from covalens.functions import annotations
from covalens.operators import panels
from covalens.plans.queries import _R, query, reads, table

_NAMES = ("case p_partkey % 4 when 0 then null when 1 then '' when 2 then 'c.' || cast(p_size as varchar) || 'A>G' else 'c.' || cast(p_size as varchar) || 'del' end as c", "case p_size % 3 when 0 then null when 1 then 'p.' || p_brand else p_brand end as p")


@query(f"""with n as (select p_partkey, {', '.join(_NAMES)} from part),
    t as (select *, case when c like '%.%>%' then array_to_string(list_transform(['>', '->', '-->', '/'], lambda v: '"' || split_part(split_part(c, '.', 2), '>', 1) || v || split_part(c, '>', 2) || '"'), '|') end as x, case when p <> '' then '"' || replace(p, 'p.', '') || '"' end as y from n)
    select p_partkey, case when x is null and y is null then '' else '"GENE"+(' || concat_ws('|', x, y) || ')' end as term from t""")
def search_terms(spark, sf_dir):
    n = table(spark, sf_dir, "part").selectExpr("p_partkey", *(x.replace("varchar", "string") for x in _NAMES))
    return n.select("p_partkey", annotations.search_term(F.col("c"), F.col("p")).alias("term"))


_FILTERS = "case l_linenumber when 1 then 'PASS' when 2 then 'COVN12' when 3 then 'COVN12; MIUN' when 4 then 'NNS' when 5 then 'SAN3' when 6 then 'COVN12;SAN3' end || case when l_suppkey % 2 = 0 then ';COMPOUNDMUTATION' else '' end"


@query(f"""select class, count(*) as n from (select case when f = 'PASS' then 'A' when f in ('COVN12', 'SAN3', 'MIUN', 'COVN12; MIUN', 'SAN3; MIUN') then 'B' end as class from (select replace({_FILTERS}, ';COMPOUNDMUTATION', '') as f from lineitem)) group by 1""")
def filter_classes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(annotations.filter_class(F.expr(_FILTERS)).alias("class")).agg(F.count("*").alias("n"))


# two texts of eight signs from each key, some of them gaps
_PAIR = ("translate(lpad(cast(p_partkey as varchar), 8, '0'), '0123456789', 'ACGTACGT-A') as a", "translate(lpad(cast(p_partkey * 7 % 99999989 as varchar), 8, '0'), '0123456789', 'ACGTACG-TA') as b")


@query(f"""with s as (select p_partkey, {', '.join(_PAIR)} from part),
    g as (select *, list_transform(range(1, 9), lambda i: case when substr(a, i, 1) = '-' then '' when substr(b, i, 1) = '-' then lower(substr(a, i, 1)) when substr(a, i, 1) = substr(b, i, 1) then '=' else substr(a, i, 1) end) as m, len(list_filter(range(1, 9), lambda i: substr(a, i, 1) = '-' or substr(a, i, 1) <> substr(b, i, 1))) as nm from s),
    r as (select *, array_to_string(m, '') as x from g),
    z as (select *, list_transform(regexp_split_to_array(x, '[A-Z]|[a-z]+'), lambda w: cast(len(w) as varchar)) as l, regexp_extract_all(x, '[A-Z]|[a-z]+') as o from r)
    select p_partkey, array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i] || case when i > len(o) then '' when o[i] between 'a' and 'z' || '~' then '^' || upper(o[i]) else o[i] end), '') as md, nm from z""")
def mismatch_tags(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", *(x.replace("varchar", "string") for x in _PAIR))
    return s.select("p_partkey", annotations.mismatch_tags(F.col("a"), F.col("b")).alias("x")).select("p_partkey", "x.md", F.col("x.nm").cast("long").alias("nm"))


_PRIMERS = "select distinct left(p_type, 4 + p_size % 9) as primer, p_brand as probe from part"


@query(f"""with k as (select primer, min(probe) as probe from ({_PRIMERS}) group by 1), h as (select p.p_partkey as id, k.probe, cast(length(k.primer) as int) as size, row_number() over (partition by p.p_partkey order by length(k.primer) desc, k.probe) as r from part p join k on starts_with(p.p_type, k.primer))
    select p.p_partkey as id, h.probe, h.size from part p left join h on h.id = p.p_partkey and r = 1""")
def probes_found(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("part_of_probes")
    primers = spark.sql(_PRIMERS.replace("from part", "from part_of_probes"))
    return panels.probes_found(part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("seq")), primers).select("id", "probe", "size")


@query(f"""with {_R}, B as (select distinct event_type as contig, user_id, s as start, s + 9 as e from R) select R.id, count(*) as n, min(B.start) as first from R join B on R.contig = B.contig and R.s <= B.start and R.e > B.e + 10 group by 1""")
def regions_of_fragments(spark, sf_dir):
    r = reads(spark, sf_dir)
    regions = r.select("contig", "user_id", "start", (F.col("start") + 9).alias("end")).distinct()
    return panels.regions_counted(r, regions).groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


_CLIPS = ("l_suppkey as place", "l_linenumber % 2 = 0 as reverse", "translate(cast(l_partkey * 31 as varchar), '0123456789', 'ACGTACGTNC') as clip")


@query(f"""with c as (select {', '.join(_CLIPS)} from lineitem), v as (select place, reverse, i, substr(clip, i, 1) as base, count(*) as n from c, range(1, 30) g(i) where length(clip) >= 4 and i <= length(clip) group by all),
    m as (select place, reverse, i, sum(n) as depth, max(n) as top, list(n) as ns, arg_max(base, n) as base from v group by 1, 2, 3),
    d as (select *, case when len(list_filter(ns, lambda x: x = top)) > 1 or base = 'N' then 'N' else base end as called from m),
    t as (select place, reverse, max(depth) as clips, string_agg(called, '' order by i) as s from d group by 1, 2)
    select place, reverse, cast(clips as bigint) as clips, case when reverse then reverse(translate(s, 'ACGT', 'TGCA')) else s end as consensus from t""")
def clip_consensus(spark, sf_dir):
    clips = table(spark, sf_dir, "lineitem").selectExpr(*(x.replace("varchar", "string") for x in _CLIPS))
    return panels.clip_consensus(clips, ["place"], 4)
