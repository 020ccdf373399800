"""Operators applied to the driver's tables; the SQL beside each gives the same rows.

Events stand for reads: contig event_type, start the minute of ts, end up to 59
minutes later by value. Features are the first halves of even days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covalens.functions import sequence, text, variants
from covalens.operators import align, annotate, callers, clusters, intervals, motif, pileup, profile, signature
from covalens.operators.intervals import Spans
from covalens.plans import dsl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A bound on the places of a k-mer that never applies.
ALL_PLACES = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MINUTE = "timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"


def reads(spark: SparkSession, sf_dir: str, contig: str = "event_type") -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("start", F.expr(_MINUTE))
    return df.select(F.expr(contig).alias("contig"), "start", (F.col("start") + F.floor("value") % 60).cast("long").alias("end"), F.col("event_id").alias("id"), "user_id", "event_type", "value")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("start") / 1440)
    days = reads(spark, sf_dir).select("contig", day.alias("day")).distinct().where("day % 2 = 0")
    return days.select(F.concat_ws("_", "contig", "day").alias("name"), "contig", (F.col("day") * 1440).alias("start"), (F.col("day") * 1440 + 719).alias("end"))


_R = """R as (select event_type as contig, cast(floor(epoch(ts) / 60) as bigint) as s, cast(floor(epoch(ts) / 60) + floor(value) % 60 as bigint) as e, event_id as id, user_id, event_type, value from events),
 FT as (select distinct event_type || '_' || cast(cast(floor(epoch(ts) / 86400) as bigint) as varchar) as name, event_type as contig, cast(floor(epoch(ts) / 86400) as bigint) * 1440 as s from events where cast(floor(epoch(ts) / 86400) as bigint) % 2 = 0),
 P as (select contig, unnest(generate_series(s, e)) as p from R),
 D as (select contig, p, count(*) as d from P group by 1, 2),
 FP as (select name, contig, unnest(generate_series(s, s + 719)) as p from FT),
 FD as (select FP.name, FP.contig, FP.p, coalesce(D.d, 0) as d from FP left join D on FP.contig = D.contig and FP.p = D.p),
 M as (select contig, min(p) as s, max(p) as e from (select contig, p, p - row_number() over (partition by contig order by p) as g from D) group by contig, g)"""
_U = "U as (select 'u' || cast(user_id % 10 as varchar) as contig, cast(floor(epoch(ts) / 60) as bigint) as s, cast(floor(epoch(ts) / 60) + floor(value) % 60 as bigint) as e, event_id as id, event_type as t from events)"


# --- filters


@query("""select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity from lineitem
    where l_quantity > 30 and (lower(l_returnflag) = 'r' or lower(l_linestatus) like 'f%') group by 1, 2""")
def dsl_filter_agg(spark, sf_dir):
    passed = dsl.kept(table(spark, sf_dir, "lineitem"), "and(l_quantity > 30, or(l_returnflag == R, l_linestatus =~ F*))")
    return passed.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""select p_type, count(*) as n from part where lower(p_name) like '%ring' or lower(p_type) like 'eco%' or not contains(lower(p_brand), '1') group by 1""")
def wildcard_filter(spark, sf_dir):
    return dsl.kept(table(spark, sf_dir, "part"), "or(p_name =~ *ring, p_type =~ ECO*, p_brand !~ 1)").groupBy("p_type").agg(F.count("*").alias("n"))


@query("""select case when l_quantity >= 25 and l_discount < 0.05 then 'kept' else 'rejected' end as side, count(*) as n from lineitem group by 1""")
def filter_split(spark, sf_dir):
    yes, no = dsl.split(table(spark, sf_dir, "lineitem"), "and(l_quantity >= 25, l_discount < 0.05)")
    return yes.select(F.lit("kept").alias("side")).unionByName(no.select(F.lit("rejected").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


# --- intervals


@query(f"with {_R} select name, cast(d as bigint) as depth, cast(count(*) as bigint) as bases from FD group by 1, 2")
def interval_coverage(spark, sf_dir):
    return intervals.coverage_histogram(Spans(reads(spark, sf_dir)), Spans(features(spark, sf_dir)), "name")


@query(f"""with {_R} select name, contig, min(p) as start_pos, max(p) as end_pos from (select name, contig, p, p - row_number() over (partition by name order by p) as g from FD where d < 2) group by name, contig, g""")
def low_depth_regions(spark, sf_dir):
    return intervals.low_depth(Spans(reads(spark, sf_dir)), Spans(features(spark, sf_dir)), "name", 2).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(f"with {_R} select contig, s as start_pos, e as end_pos from M")
def interval_merge(spark, sf_dir):
    return intervals.merge(Spans(reads(spark, sf_dir))).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(f"""with {_R} select contig, e + 1 as start_pos, n - 1 as end_pos from (select contig, e, lead(s) over (partition by contig order by s) as n from M) where n - e - 1 >= 5""")
def interval_gaps(spark, sf_dir):
    return intervals.gaps(Spans(reads(spark, sf_dir)), least=5).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _sides(spark, sf_dir):
    u = reads(spark, sf_dir, "concat('u', user_id % 10)").select("contig", "start", "end", "id", "event_type")
    return Spans(u.where("event_type = 'purchase'")), Spans(u.where("event_type = 'error'"))


@query(f"with {_U} select a.id as a_id, b.id as b_id, least(a.e, b.e) - greatest(a.s, b.s) + 1 as shared from U a join U b on a.contig = b.contig and a.s <= b.e and a.e >= b.s where a.t = 'purchase' and b.t = 'error'")
def interval_overlap_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    hit = intervals.overlap_join(a, b)
    shared = intervals.overlap_length((F.col("a.start"), F.col("a.end")), (F.col("b.start"), F.col("b.end")))
    return hit.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), shared.alias("shared"))


@query(f"with {_U} select a.id as a_id, b.id as b_id from U a join U b on a.contig = b.contig and b.s <= a.s and b.e >= a.e where a.t = 'purchase' and b.t = 'error'")
def interval_containment(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return intervals.overlap_join(a, b, within=True).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(f"with {_U} select id from U a where t = 'purchase' and exists (select 1 from U b where b.t = 'error' and a.contig = b.contig and a.s - 5 <= b.e and a.e + 5 >= b.s)")
def interval_semi(spark, sf_dir):
    return intervals.semi_join(*_sides(spark, sf_dir), buffer=5).select("id")


@query(f"with {_U} select id from U a where t = 'purchase' and not exists (select 1 from U b where b.t = 'error' and a.contig = b.contig and a.s <= b.e and a.e >= b.s)")
def interval_anti(spark, sf_dir):
    return intervals.anti_join(*_sides(spark, sf_dir)).select("id")


@query(f"with {_R} select contig, w as window_start, count(*) as n from (select contig, unnest([s // 10 * 10 - 20, s // 10 * 10 - 10, s // 10 * 10]) as w from R) group by 1, 2")
def sliding_window_counts(spark, sf_dir):
    return intervals.sliding_counts(reads(spark, sf_dir), "contig", "start", 30, 10).withColumnRenamed("start", "window_start")


@query("""select cast(floor(epoch(ts) / 3600) as bigint) as hour, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'view') as seen from events group by 1""")
def tumbling_counts_pivot(spark, sf_dir):
    counts = intervals.tumbling_counts(reads(spark, sf_dir, "'all'"), "contig", "start", 60, "event_type")
    wide = counts.groupBy("window").pivot("event_type", ["click", "error", "view", "purchase", "signup"]).agg(F.sum("n"))
    return wide.select(F.col("window").alias("hour"), F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("view", F.lit(0)).alias("seen"))


@query(f"""with {_R}, N as (select contig, s, e, lag(e) over w as b, lead(s) over w as f from M window w as (partition by contig order by s)),
    S as (select contig, unnest([{{'side': 'pre', 'level': 1, 's': greatest(s - 3, coalesce((b + s) // 2 + 1, 1)), 'e': s - 1}}, {{'side': 'post', 'level': 1, 's': e + 1, 'e': least(e + 3, coalesce((e + f) // 2, 1000000000000))}},
        {{'side': 'pre', 'level': 2, 's': greatest(s - 8, coalesce((b + s) // 2 + 1, 1)), 'e': s - 4}}, {{'side': 'post', 'level': 2, 's': e + 4, 'e': least(e + 8, coalesce((e + f) // 2, 1000000000000))}}]) as x from N)
    select contig, x.side as side, x.level as level, x.s as start_pos, x.e as end_pos from S where x.s <= x.e""")
def shoulders(spark, sf_dir):
    return intervals.shoulders(Spans(reads(spark, sf_dir)), [3, 5]).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("""select o_custkey, d as at, case when hi is null or d - lo <= hi - d then coalesce(lo, hi) else coalesce(hi, lo) end as nearest, n from (
    select o_custkey, d, n, lag(d) over w as lo, lead(d) over w as hi from (select o_custkey, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as d, count(*) as n from orders group by 1, 2) window w as (partition by o_custkey order by d))""")
def nearest_neighbour(spark, sf_dir):
    at = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    points = table(spark, sf_dir, "orders").select("o_custkey", at.alias("at")).groupBy("o_custkey", "at").agg(F.count("*").alias("n"))
    return intervals.nearest(points, "o_custkey", "at").select("o_custkey", "at", "nearest", "n")


@query("""select user_id, value, min(d) as start_day, max(d) as end_day, count(*) as n from (select user_id, value, d, d - row_number() over (partition by user_id, value order by d) as g
    from (select distinct user_id, event_type as value, cast(floor(epoch(ts) / 86400) as bigint) as d from events)) group by user_id, value, g""")
def adjacent_islands(spark, sf_dir):
    days = reads(spark, sf_dir, "user_id").withColumn("day", F.floor(F.col("start") / 1440))
    return intervals.islands(days, "contig", "day", "event_type").withColumnsRenamed({"contig": "user_id", "start": "start_day", "end": "end_day"})


@query("""select r_regionkey as contig, unnest(generate_series(1, 100 + r_regionkey, 30)) as start_pos, least(unnest(generate_series(1, 100 + r_regionkey, 30)) + 29, 100 + r_regionkey) as end_pos from region""")
def region_tiles(spark, sf_dir):
    lengths = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("contig"), (F.col("r_regionkey") + 100).cast("long").alias("length"))
    return intervals.tiles(lengths, 30).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


# --- pileups and genotypes

_OBS = """O as (select event_type as rname, cast(floor(epoch(ts) / 86400) as bigint) as pos, cast(floor(event_id / 2) as bigint) as qname, substr('ACGT', cast(user_id % 4 + 1 as int), 1) as base, cast(floor(value) as bigint) as qual,
    event_id % 3 = 1 as reverse, cast(floor(epoch(ts) / 60) as bigint) as s, cast(floor(epoch(ts) / 60) + floor(value) % 60 as bigint) as e, event_id % 7 = 0 as end_of_read from events),
 C as (select rname, pos, base, count(*) filter (not reverse) as fwd, coalesce(cast(sum(qual) filter (not reverse) as bigint), 0) as fwd_qual, count(*) filter (reverse) as rev, coalesce(cast(sum(qual) filter (reverse) as bigint), 0) as rev_qual,
    count(distinct s) filter (not reverse) + count(distinct e) filter (reverse) as novel, count(*) filter (end_of_read) as ends from O group by 1, 2, 3)"""


def observed(spark, sf_dir) -> DataFrame:
    df = reads(spark, sf_dir)
    return df.select(
        F.col("contig").alias("rname"), F.floor(F.col("start") / 1440).alias("pos"), F.floor(F.col("id") / 2).alias("qname"), F.substring(F.lit("ACGT"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1)).alias("base"),
        F.floor("value").alias("qual"), (F.col("id") % 3 == 1).alias("reverse"), "start", "end", (F.col("id") % 7 == 0).alias("end_of_read"),
    )


@query(f"with {_OBS} select * from C")
def pileup_counts(spark, sf_dir):
    return pileup.by_base(observed(spark, sf_dir))


@query(f"""with {_OBS}, S as (select rname, pos, count(*) filter (not reverse) as f, count(*) filter (reverse) as r from O group by 1, 2),
    X as (select O.*, count(*) over k as n, S.f, S.r, min(base) over k = max(base) over k as one, min(cast(reverse as int)) over k <> max(cast(reverse as int)) over k as strands from O join S on O.rname = S.rname and O.pos = S.pos window k as (partition by O.rname, O.pos, qname)),
    Y as (select *, row_number() over (partition by rname, pos, qname order by case when strands then case when f >= r then not reverse else reverse end else false end, qual desc, s, reverse) as k from X)
    select rname, pos, base, count(*) as n, cast(sum(qual) as bigint) as quality from Y where n = 1 or (one and k = 1) group by 1, 2, 3""")
def overlap_dedupe(spark, sf_dir):
    return pileup.without_overlaps(observed(spark, sf_dir)).groupBy("rname", "pos", "base").agg(F.count("*").alias("n"), F.sum("qual").cast("long").alias("quality"))


@query(f"""with {_OBS}, Q as (select rname, pos, base, fwd + rev as n, fwd_qual + rev_qual as q, sum(fwd + rev) over w as coverage, sum(fwd_qual + rev_qual) over w as qall from C window w as (partition by rname, pos)),
    K as (select *, row_number() over (partition by rname, pos order by n desc, q desc, base) as k from Q where n >= 3 and q * 100 >= qall * 10),
    G as (select rname, pos, min(base) as a, max(base) as b from K where k <= 2 group by 1, 2)
    select C.rname, C.pos, any_value(G.a || '/' || G.b) as genotype, cast(sum(C.fwd + C.rev) as bigint) as coverage from C left join G on C.rname = G.rname and C.pos = G.pos group by 1, 2""")
def genotype_vote(spark, sf_dir):
    return pileup.voted(pileup.by_base(observed(spark, sf_dir)), 3, 10.0)


@query(f"with {_OBS} select rname, pos, base from C where fwd > 0 and rev > 0 and least(fwd, rev) * 100.0 / (fwd + rev) > 20")
def strand_bias_filter(spark, sf_dir):
    counts = pileup.by_base(observed(spark, sf_dir))
    return counts.where(variants.strand_bias(F.col("fwd"), F.col("rev"), 20)).select("rname", "pos", "base")


@query(f"""with {_OBS}, T as (select *, sum(fwd + rev) over (partition by rname, pos) as coverage from C), RU as (select * from (values (0, 20, 4), (21, 60, 8), (61, null, 25)) as t(lo, hi, need))
    select rname, pos, base, fwd + rev as n, cast(coverage as bigint) as coverage from T join RU on coverage >= lo and (hi is null or coverage <= hi) where case when hi is null then (fwd + rev) * 100.0 / coverage >= need else fwd + rev >= need end""")
def rule_threshold_join(spark, sf_dir):
    rules = spark.createDataFrame([(0, 20, 4), (21, 60, 8), (61, None, 25)], "lo long, hi long, need long")
    counts = pileup.by_base(observed(spark, sf_dir)).withColumn("n", F.col("fwd") + F.col("rev"))
    total = counts.groupBy("rname", "pos").agg(F.sum("n").alias("coverage"))
    joined = counts.join(total, ["rname", "pos"]).join(F.broadcast(rules), (F.col("coverage") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("coverage") <= F.col("hi"))))
    return joined.where(variants.passes_rule(F.col("n"), F.col("coverage"), F.col("hi"), F.col("need"))).select("rname", "pos", "base", "n", "coverage")


@query("""select event_id from (select event_id, value >= 50 as ok, row_number() over (partition by user_id, value >= 50 order by event_id) as k from events) where ok or k <= 2""")
def failed_read_throttle(spark, sf_dir):
    return pileup.throttled(table(spark, sf_dir, "events"), ["user_id"], F.col("value") >= 50, [F.col("event_id")], 2).select("event_id")


@query("""with m as (select l_suppkey as k, count(*) as n, cast(sum(l_linenumber) as bigint) as v, l_returnflag as f from lineitem group by 1, 4)
    select k, cast(sum(case when f = 'R' then -n else n end) as bigint) as n, cast(sum(case when f = 'R' then -v else v end) as bigint) as v from m where f in ('A', 'N', 'R') group by k having sum(case when f = 'R' then -n else n end) <> 0 or sum(case when f = 'R' then -v else v end) <> 0""")
def matrix_add_remove(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("v"))
    side = lambda f: m.where(F.col("l_returnflag") == f).select("k", "n", "v")
    return pileup.combined([(side("A"), 1), (side("N"), 1), (side("R"), -1)], ["k"])


_SIG = """B as (select user_id as sample, cast(floor(epoch(ts) / 604800) as bigint) as position, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'view') as c, count(*) filter (event_type = 'error') as g,
    count(*) filter (event_type in ('purchase', 'signup')) as t from events group by 1, 2),
 H as (select *, a + c + g + t as n from B),
 G as (select sample, position, case when n < 3 then null when cast(a / n as float) > cast(0.9 as float) then 'AA' when cast(c / n as float) > cast(0.9 as float) then 'CC' when cast(g / n as float) > cast(0.9 as float) then 'GG' when cast(t / n as float) > cast(0.9 as float) then 'TT' else
    (case when cast(a / n as float) > cast(0.3 as float) and cast(a / n as float) < cast(0.7 as float) then 'A' else '' end) || (case when cast(c / n as float) > cast(0.3 as float) and cast(c / n as float) < cast(0.7 as float) then 'C' else '' end)
    || (case when cast(g / n as float) > cast(0.3 as float) and cast(g / n as float) < cast(0.7 as float) then 'G' else '' end) || (case when cast(t / n as float) > cast(0.3 as float) and cast(t / n as float) < cast(0.7 as float) then 'T' else '' end) end as genotype from H),
 S as (select * from G where length(genotype) = 2)"""


def signed(spark, sf_dir) -> DataFrame:
    week = F.floor(F.col("start") / 10080)
    one = lambda *kinds: F.sum(F.col("event_type").isin(*kinds).cast("long"))
    counts = reads(spark, sf_dir).groupBy("user_id", week.alias("position")).agg(one("click").alias("a"), one("view").alias("c"), one("error").alias("g"), one("purchase", "signup").alias("t"))
    return signature.signatures(counts, "user_id", "position", 3)


@query(f"with {_SIG} select * from S")
def genotype_call(spark, sf_dir):
    return signed(spark, sf_dir)


@query(f"""with {_SIG} select x.sample as a, y.sample as b, count(*) as compared, count(*) filter (x.genotype = y.genotype) as matches, round(count(*) filter (x.genotype = y.genotype) / count(*), 6) as score
    from S x join S y on x.position = y.position and x.sample < y.sample group by 1, 2""")
def fingerprint_pairs(spark, sf_dir):
    return signature.pair_scores(signed(spark, sf_dir), 6)


@query(f"""with {_SIG}, C as (select position, sample % 50 as k, min(genotype) as gt from S where sample % 2 = 0 group by 1, 2), T as (select position, (sample + 1) % 50 as k, max(genotype) as gt from S where sample % 2 = 1 group by 1, 2)
    select coalesce(C.position, T.position) as position, coalesce(C.k, T.k) as k, C.gt as c_gt, T.gt as t_gt, case when C.gt is null or T.gt is null then 'UNKNOWN'
      when not contains(C.gt || 'A', substr(T.gt, 1, 1)) or not contains(C.gt || 'A', substr(T.gt, 2, 1)) then 'SOMATIC' else 'GERMLINE' end as class
    from C full join T on C.position = T.position and C.k = T.k""")
def germline_somatic_class(spark, sf_dir):
    s = signed(spark, sf_dir)
    c = s.where("sample % 2 = 0").groupBy("position", (F.col("sample") % 50).alias("k")).agg(F.min("genotype").alias("gt"))
    t = s.where("sample % 2 = 1").groupBy("position", ((F.col("sample") + 1) % 50).alias("k")).agg(F.max("genotype").alias("gt"))
    pair = lambda g: F.concat_ws("/", F.substring(g, 1, 1), F.substring(g, 2, 1))
    gt = lambda g: F.when(F.col(g).isNotNull(), pair(g))
    both = callers.control_test(c, t, ["position", "k"])
    return both.select("position", "k", "c_gt", "t_gt", variants.classified(gt("c_gt"), gt("t_gt"), F.lit("A")).alias("class"))


@query("""select cast(floor(l_linenumber * 100 / l_quantity) as int) as vaf, count(*) as n from lineitem where l_quantity > 0 group by 1""")
def vaf_distribution(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return df.groupBy(variants.vaf_percent(F.col("l_linenumber"), F.col("l_quantity")).alias("vaf")).agg(F.count("*").alias("n"))


# --- annotation and callers


@query("""select o.o_orderkey, f.l_linenumber, f.l_partkey, f.l_quantity from orders o left join (select * from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) where k = 1) f on o.o_orderkey = f.l_orderkey""")
def first_match_annotate(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return annotate.first_match(rows, source, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_linenumber", "l_partkey", "l_quantity"])


@query("""select c.c_custkey, case when o.o_orderkey is null and e.event_type is null then '' else concat_ws(';', 'o_orderkey=' || o.o_orderkey, 'event_type=' || e.event_type) end as info from customer c
    left join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1) o on c.c_custkey = o.o_custkey left join (select user_id, arg_min(event_type, event_id) as event_type from events group by 1) e on c.c_custkey = e.user_id""")
def multi_source_annotate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    got = annotate.annotated(rows, [(orders, ["o_orderkey"], ["o_orderkey"]), (events, ["event_id"], ["event_type"])], ["c_custkey"])
    return got.select("c_custkey", annotate.info_text(["o_orderkey", "event_type"]).alias("info"))


@query(f"""with {_R} select R.id, string_agg(distinct FT.name, ';' order by FT.name) as types from R join FT on R.contig = FT.contig and R.s between FT.s and FT.s + 719 group by 1""")
def features_at_points(spark, sf_dir):
    return annotate.features_at(reads(spark, sf_dir), features(spark, sf_dir), "contig", "start", "id", "name")


@query(f"""with {_R} select id, case when exists (select 1 from FT where FT.contig = R.contig and R.s <= FT.s + 718 and R.e >= FT.s) then 'REPEAT' else 'PASS' end as filter from R""")
def repeat_mask(spark, sf_dir):
    r = reads(spark, sf_dir).select("contig", "start", "end", "id").withColumn("filter", F.lit("PASS"))
    return annotate.in_mask(r, features(spark, sf_dir)).select("id", "filter")


@query("select members, count(*) as n from (select user_id, cast(floor(epoch(ts) / 86400) as bigint) as d, string_agg(distinct event_type, ',' order by event_type) as members from events group by 1, 2) group by 1")
def caller_membership(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("d", F.floor(F.col("start") / 1440))
    return callers.membership_counts(df, "event_type", ["user_id", "d"])


@query("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as alts from orders group by 1")
def merge_alleles(spark, sf_dir):
    return callers.merged_alleles(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("""with k as (select distinct user_id from events), t as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as event_type)
    select k.user_id, t.event_type from k cross join t where not exists (select 1 from events e where e.user_id = k.user_id and e.event_type = t.event_type and e.value >= 60)""")
def missing_positions(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("gt", F.when(F.col("value") < 60, "./.").otherwise("0/1"))
    return callers.missing_in(df, "event_type", ["user_id"], "gt", ["click", "error", "purchase", "signup", "view"])


@query("select user_id, d from (select distinct user_id, cast(floor(epoch(ts) / 86400) as bigint) as d, event_type from events where event_type in ('click', 'error', 'view')) group by 1, 2 having count(*) = 3")
def gold_standard_intersect(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("d", F.floor(F.col("start") / 1440))
    return callers.gold_standard(df, "event_type", ["user_id", "d"], ["click", "error", "view"])


@query("""select user_id, cast(max(case when g is null then 0 else n end) as bigint) as score from (select user_id, case when value < 5 then null when event_id % 2 = 0 then '0/1' else '1/1' end as g, count(*) as n from events group by 1, 2) group by 1""")
def caller_agreement(spark, sf_dir):
    gt = F.expr("case when value < 5 then './.' when event_id % 2 = 0 then '1/0' else '1/1' end")
    return callers.agreement(table(spark, sf_dir, "events").withColumn("gt", gt), ["user_id"], "gt").withColumn("score", F.col("score").cast("long"))


@query("""select coalesce(a.k, b.k) as k, case when a.k is null then 'only_b' when b.k is null then 'only_a' else 'both' end as side from (select distinct o_custkey as k from orders where o_orderstatus = 'F') a full join (select distinct o_custkey as k from orders where o_orderstatus = 'P') b on a.k = b.k""")
def two_file_compare(spark, sf_dir):
    side = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return callers.compared(side("F"), side("P"), ["k"])


# --- profiles


@query("select i as cycle, substr(text, cast(i as int), 1) as value, count(*) as n from (select text, unnest(generate_series(1, length(text))) as i from benchmark) group by 1, 2")
def cycle_histogram(spark, sf_dir):
    return profile.cycles(table(spark, sf_dir, "benchmark"), "text").withColumn("cycle", F.col("cycle").cast("long"))


@query("select substr(text, cast(i as int), 6) as kmer, count(*) as n from (select text, unnest(generate_series(1, length(text) - 5)) as i from benchmark) group by 1")
def kmer_counts(spark, sf_dir):
    return profile.kmer_counts(table(spark, sf_dir, "benchmark"), "text", 6)


@query("select i as cycle, substr(text, cast(i as int), 3) as kmer, count(*) as n from (select text, unnest(generate_series(1, length(text) - 2)) as i from benchmark) group by 1, 2")
def kmer_cycles(spark, sf_dir):
    return profile.kmer_cycles(table(spark, sf_dir, "benchmark"), "text", 3).withColumn("cycle", F.col("cycle").cast("long"))


@query("""select l_linestatus, case when l_returnflag = 'R' then 'returned' when l_quantity < 5 then 'small' when l_discount > 0.08 then 'discounted' else 'kept' end as reason, count(*) as n from lineitem group by 1, 2""")
def discard_hierarchy_tally(spark, sf_dir):
    reasons = [("returned", F.col("l_returnflag") == "R"), ("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08)]
    return profile.discarded(table(spark, sf_dir, "lineitem"), reasons, "l_linestatus")


_FLAGS = "cast(1 + case when l_linenumber % 2 = 0 then 2 else 0 end + case when l_returnflag = 'R' then 16 else 0 end + case when l_linestatus = 'F' then 32 else 0 end + case when l_linenumber = 1 then 64 else 0 end as int)"
_PAIRS = f"select {_FLAGS} as flag, cast(l_quantity as bigint) * 600 - 6000 as tlen, l_partkey as pnext, l_suppkey * 10 as e from lineitem"


@query(f"""with p as ({_PAIRS}) select flag & 2 <> 0 as proper, case when (flag & 16 <> 0) = (flag & 32 <> 0) then case when (flag & 16 <> 0) = (flag & 64 <> 0) then 'F5F3' else 'F3F5' end when flag & 16 = 0 then 'inward' else 'outward' end as orientation,
    case when tlen = 0 then '0' when pnext <= e then 'overlap' when tlen < 1500 then '<1500' when tlen < 10000 then '<10000' else '>=10000' end as size, count(*) as n from p where tlen > 0 or (tlen = 0 and flag & 64 <> 0) group by 1, 2, 3""")
def pair_once_tally(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr(_FLAGS).alias("flag"), F.expr("cast(l_quantity as bigint) * 600 - 6000").alias("tlen"), F.col("l_partkey").alias("pnext"), (F.col("l_suppkey") * 10).alias("end"))
    return profile.pair_tallies(df)


@query(f"with p as ({_PAIRS}) select flag, lpad(bin(flag), 12, '0') as bits, count(*) as n from p group by 1, 2")
def flag_counts(spark, sf_dir):
    return profile.flag_counts(table(spark, sf_dir, "lineitem").select(F.expr(_FLAGS).alias("flag")))


@query("select l_returnflag, cast(greatest(ceil(round(l_discount / 0.02, 9)) - 1, 0) as bigint) as bin, count(*) as n from lineitem group by 1, 2")
def vaf_bins(spark, sf_dir):
    return profile.binned(table(spark, sf_dir, "lineitem"), F.col("l_discount"), 0.02, "l_returnflag")


@query("with h as (select cast(l_quantity as bigint) as v, count(*) as n from lineitem group by 1) select v, round(s, 9) as slope from (select v, ln(n) - ln(lag(n) over (order by v)) as s from h) where s is not null")
def first_derivative(spark, sf_dir):
    # the window runs over distinct quantities, of which there are 50
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("v")).agg(F.count("*").alias("n"))
    return profile.derivative(h, "v", "n").withColumn("slope", F.round("slope", 9))


_QUART = """o as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events),
 q as (select event_type, max(case when k = greatest(least(cast(floor(25 * (n + 1) / 100) as bigint), n), 1) then value end) as a1, max(case when k = greatest(least(cast(floor(25 * (n + 1) / 100) as bigint) + 1, n), 1) then value end) as b1, max(25 * (n + 1) / 100 - floor(25 * (n + 1) / 100)) as f1,
    max(case when k = greatest(least(cast(floor(75 * (n + 1) / 100) as bigint), n), 1) then value end) as a3, max(case when k = greatest(least(cast(floor(75 * (n + 1) / 100) as bigint) + 1, n), 1) then value end) as b3, max(75 * (n + 1) / 100 - floor(75 * (n + 1) / 100)) as f3 from o group by 1),
 z as (select event_type, a1 + f1 * (b1 - a1) as q1, a3 + f3 * (b3 - a3) as q3 from q)"""


@query(f"with {_QUART} select event_type, round(q1, 6) as q1, round(q3, 6) as q3 from z")
def quartiles(spark, sf_dir):
    q = profile.quartiles(table(spark, sf_dir, "events"), "value", "event_type")
    return q.select("event_type", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


@query(f"with {_QUART} select event_id from events join z on events.event_type = z.event_type where value < q1 - 0.25 * (q3 - q1)")
def iqr_outliers(spark, sf_dir):
    return profile.low_outliers(table(spark, sf_dir, "events"), "value", 0.25, "event_type").select("event_id")


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, grouping(l_returnflag, l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@query("select lang, regexp_extract(m, '.*') as motif, count(*) as n from (select lang, unnest(regexp_extract_all(text, '[a-z][a-z]tion')) as m from documents where contains(text, 'tion')) group by 1, 2")
def motif_two_stage(spark, sf_dir):
    return motif.two_stage(table(spark, sf_dir, "documents"), "text", "tion", "[a-z][a-z]tion", "lang")


@query("select item_id, i - 1 as start_pos, i + 2 as end_pos from (select item_id, text, unnest(generate_series(1, length(text) - 2)) as i from benchmark) where substr(text, cast(i as int), 3) = 'the'")
def motif_positions(spark, sf_dir):
    return motif.located(table(spark, sf_dir, "benchmark"), "text", "the", "item_id").withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("select item_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) as rc from benchmark")
def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sequence.reverse_complement(F.col("text")).alias("rc"))


@query("""with c as (select p_brand || '-' || cast(p_size as varchar) as seq, count(*) as n from part group by 1),
    m as (select s.seq, first(b.seq order by b.n desc, b.seq) as big from c s join c b on b.n > 1 and length(b.seq) = length(s.seq) and hamming(s.seq, b.seq) = 1 where s.n = 1 group by 1)
    select coalesce(m.big, c.seq) as seq, cast(sum(c.n) as bigint) as n from c left join m on c.seq = m.seq group by 1""")
def hamming_collapse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("seq"))
    return align.collapsed(df, "seq")


@query("""with k as (select distinct item_id, substr(text, cast(i as int), 13) as kmer from (select item_id, text, unnest(generate_series(1, length(text) - 12)) as i from benchmark))
    select a.item_id as query, b.item_id as target, count(*) as n from k a join k b on a.kmer = b.kmer group by 1, 2 having count(*) >= 2""")
def tiled_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return align.seeds(items, "item_id", "text", align.kmer_index(items, "item_id", "text", 13, most=ALL_PLACES), 13)


@query("""select r.a as ref, r.b as alt, case when length(r.a) = length(r.b) then case length(r.a) when 1 then 'SNP' when 2 then 'DNP' when 3 then 'TNP' else 'ONP' end when length(r.a) = 1 then 'INS' when length(r.b) = 1 then 'DEL' else 'CTX' end as kind, count(*) as n
    from (select substr('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int)) as a, substr('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1) as b from lineitem) r group by 1, 2, 3""")
def variant_types(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.expr("substring('ACGTACGT', 1, cast(l_linenumber % 4 + 1 as int))").alias("ref"), F.expr("substring('TGCATGCA', 1, cast(l_quantity as int) % 4 + 1)").alias("alt"))
    return df.groupBy("ref", "alt", variants.variant_type(F.col("ref"), F.col("alt")).alias("kind")).agg(F.count("*").alias("n"))


@query("""select f, count(*) filter (a || b in ('AG', 'GA', 'CT', 'TC')) as ti, count(*) filter (a || b not in ('AG', 'GA', 'CT', 'TC')) as tv from (select l_returnflag as f, substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) as a, substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as b from lineitem) where a <> b group by 1""")
def transition_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.expr("substring('ACGT', cast(l_partkey % 4 + 1 as int), 1)").alias("ref"), F.expr("substring('ACGT', cast(l_suppkey % 4 + 1 as int), 1)").alias("alt"))
    return profile.transitions(df, "f").select("f", "ti", "tv")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, regexp_extract(props, '\"k\": ?([0-9]+)', 1) as raw from events")
def props_map(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_extract("props", '"k": ?([0-9]+)', 1).alias("raw"))


@query("select page_id, split_part(url, '/', 3) as host, len(string_split(url, '/')) as parts from pages")
def tokenised(spark, sf_dir):
    parts = text.tokens(F.col("url"), "/")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("host"), F.size(parts).cast("long").alias("parts"))


# --- without SQL


@query()
def greedy_clusters(spark, sf_dir):
    """Orders as pairs of breakpoints: customer's segment and status as contigs, order day and price band as ends."""
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderpriority").alias("contig_a"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("a"), F.col("o_orderstatus").alias("contig_b"), F.floor(F.col("o_totalprice") / 1000).alias("b"))
    return clusters.pair_clusters(pairs, 10, 4)


@query()
def local_alignment(spark, sf_dir):
    """Whole benchmark items aligned to those that share k-mers with them."""
    items = table(spark, sf_dir, "benchmark")
    near = align.seeds(items, "item_id", "text", align.kmer_index(items, "item_id", "text", 9, most=ALL_PLACES), 9).where("query < target")
    side = lambda name: items.select(F.col("item_id").alias(name), F.col("text").alias(f"{name}_text"))
    pairs = near.join(side("query"), "query").join(side("target"), "target")
    return align.aligned(pairs, "query_text", "target_text").select("query", "target", "score", "top", "bottom")


@query()
def session_stream(spark, sf_dir):
    """Sessions of each user's events, half an hour apart, as a stream; those that the watermark has passed."""
    from covalens.session import work_path
    from covalens.streaming import windows

    stream = windows.sessions(windows.event_stream(spark, sf_dir), "1 hour", "30 minutes", "user_id")
    return windows.finished(stream, work_path(spark, "sessions"))


# --- structural evidence and metrics


@query("""with g as (select l_suppkey % 5 as contig, max(l_partkey * 7 + 1) as length from lineitem group by 1)
    select g.contig, cast(l_partkey * 7 // 500 * 500 + 1 as bigint) as start_pos, least(cast(l_partkey * 7 // 500 * 500 + 500 as bigint), any_value(g.length)) as end_pos,
    count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n, count(*) filter (l_returnflag = 'R') as r from lineitem join g on l_suppkey % 5 = g.contig group by g.contig, l_partkey * 7 // 500""")
def copy_number_counts(spark, sf_dir):
    from covalens.operators import structural

    df = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("contig"), (F.col("l_partkey") * 7 + 1).alias("at"), "l_returnflag")
    lengths = df.groupBy("contig").agg(F.max("at").alias("length"))
    out = structural.copy_number_windows(df, "contig", "at", "l_returnflag", 500, lengths, ["A", "N", "R"])
    return out.withColumnsRenamed({"start": "start_pos", "end": "end_pos", "A": "a", "N": "n", "R": "r"})


@query("""with p as (select event_type as contig, cast(floor(epoch(ts) / 60) as bigint) as q, sum(value) > 60 as high, count(*) filter (value < 3) > 0 as low from events group by 1, 2),
    w as (select contig, unnest([q // 10 * 10 - 20, q // 10 * 10 - 10, q // 10 * 10]) as s, high, low from p),
    c as (select contig, s from w group by 1, 2 having greatest(count(*) filter (high), count(*) filter (low)) >= 2),
    f as (select contig, s, case when s <= lag(s) over (partition by contig order by s) + 30 then 0 else 1 end as n from c), g as (select contig, s, sum(n) over (partition by contig order by s) as r from f)
    select contig, min(s) as start_pos, max(s) + 29 as end_pos from g group by contig, r""")
def metric_regions(spark, sf_dir):
    from covalens.operators import structural

    p = reads(spark, sf_dir).groupBy("contig", "start").agg((F.sum("value") > 60).alias("high"), (F.sum((F.col("value") < 3).cast("int")) > 0).alias("low"))
    w = structural.metric_windows(p, "contig", "start", ["high", "low"])
    return structural.error_regions(w, ["high", "low"], 2).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("""with h as (select o_orderpriority as k, o_orderstatus as s, count(*) filter (o_custkey % 2 = 0) as a, count(*) filter (o_custkey % 2 = 1) as b from orders group by 1, 2), t as (select k, sum(a) as x, sum(b) as y, count(*) as n from h group by 1)
    select k, round(sum(pow(sqrt(y / x) * a - sqrt(x / y) * b, 2) / (a + b)), 6) as chi2, any_value(n) - 1 as df from h join t using (k) group by 1""")
def histogram_chi_square(spark, sf_dir):
    from covalens.operators import structural

    o = table(spark, sf_dir, "orders")
    h = o.groupBy(F.col("o_orderpriority").alias("k"), "o_orderstatus").agg(F.sum((F.col("o_custkey") % 2 == 0).cast("int")).alias("a"), F.sum((F.col("o_custkey") % 2 == 1).cast("int")).alias("b"))
    return structural.chi_square(h, "a", "b", "k").withColumn("chi2", F.round("chi2", 6))


@query("""with s as (select o_orderkey as id, o_orderpriority as ca, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as a, o_orderstatus as cb, cast(floor(o_totalprice / 100) as bigint) as b from orders)
    select x.id as clip, y.id as cluster from s x join s y on x.ca = y.ca and x.cb = y.cb and abs(x.a - y.a) <= 3 and abs(x.b - y.b) <= 3 where x.id % 2 = 0 and y.id % 2 = 1""")
def evidence_join(spark, sf_dir):
    from covalens.operators import structural

    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("contig_a"), day.alias("a"), F.col("o_orderstatus").alias("contig_b"), F.floor(F.col("o_totalprice") / 100).alias("b"))
    return structural.evidence(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 3).select("clip", "cluster")


@query("""with g as (select l_returnflag as f, cast(l_linenumber % 4 as varchar) || '/' || cast(l_partkey % 4 as varchar) as c, cast(l_suppkey % 3 as varchar) || '/' || cast(l_orderkey % 3 as varchar) as t, l_linenumber % 4 as c0, l_partkey % 4 as c1, l_suppkey % 3 as t0, l_orderkey % 3 as t1 from lineitem)
    select f, case when c0 = 0 and c1 = 0 then case when t0 = 0 and t1 = 0 then 12 when t0 = 0 or t1 = 0 then 13 when t0 = t1 then 14 else 15 end
      when c0 = 0 or c1 = 0 then case when t0 = 0 and t1 = 0 then 22 when t0 = 0 or t1 = 0 then case when greatest(t0, t1) = greatest(c0, c1) then 23 else 26 end when t0 = t1 then case when t0 = greatest(c0, c1) then 24 else 27 end when greatest(c0, c1) in (t0, t1) then 25 else 28 end
      when c0 = c1 then case when t0 = 0 and t1 = 0 then 32 when t0 = 0 or t1 = 0 then case when greatest(t0, t1) = c0 then 33 else 38 end when t0 = t1 then case when t0 = c0 then 34 else 37 end when c0 in (t0, t1) then 35 else 36 end
      else case when t0 = 0 and t1 = 0 then 42 when t0 = 0 or t1 = 0 then case when greatest(t0, t1) = c0 then 43 when greatest(t0, t1) = c1 then 44 else 49 end when t0 = t1 then case when t0 = c0 then 45 when t0 = c1 then 46 else 50 end
        when c = t then 47 when t0 not in (c0, c1) and t1 not in (c0, c1) then 48 when t0 in (c0, c1) and t1 in (c0, c1) then 99 else 51 end end as code, count(*) as n from g group by 1, 2""")
def ccm_code(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.concat_ws("/", F.col("l_linenumber") % 4, F.col("l_partkey") % 4).alias("c"), F.concat_ws("/", F.col("l_suppkey") % 3, F.col("l_orderkey") % 3).alias("t"))
    return df.groupBy("f", variants.mutation_class(F.col("c"), F.col("t")).alias("code")).agg(F.count("*").alias("n"))
