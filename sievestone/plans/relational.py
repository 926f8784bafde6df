"""Interval, as-of and graph queries over events, lines and the order tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, intervals
from ._base import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R6 = lambda c: F.round(c, 6).alias(c)

#: Paragraphs (runs of lines between blank ones) and windows of lines, as spans of a document.
_SQL_SPANS = """lines as (select doc_id, unnest(l) as t, unnest(range(1, len(l) + 1)) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
wins as (select doc_id, cast(floor((line - 1) / 7) as bigint) as win, min(line) as lo, max(line) as hi from lines group by 1, 2),
secs as (select doc_id, cast(floor((line - 1) / 5) as bigint) as sec, min(line) as lo2, max(line) as hi2 from lines group by 1, 2)"""


def _spans(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("line"))
    wins = lines.groupBy("doc_id", F.floor((F.col("line") - 1) / 7).alias("win")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    secs = lines.groupBy("doc_id", F.floor((F.col("line") - 1) / 5).alias("sec")).agg(F.min("line").alias("lo2"), F.max("line").alias("hi2"))
    return lines, wins, secs


@query("line_overlap_join", f"""with {_SQL_SPANS} select doc_id, win, sec, least(hi, hi2) - greatest(lo, lo2) + 1 as shared, round((least(hi, hi2) - greatest(lo, lo2) + 1) / least(hi - lo + 1, hi2 - lo2 + 1), 6) as of_smaller from wins join secs using (doc_id) where lo <= hi2 and lo2 <= hi""")
def line_overlap_join(spark, d):
    _, wins, secs = _spans(spark, d)
    c = F.col
    x = intervals.overlap_join(wins, secs, ["doc_id"], 10)
    return x.select("doc_id", "win", "sec", (F.least("hi", "hi2") - F.greatest("lo", "lo2") + 1).alias("shared"), F.round(intervals.span_overlap(c("lo"), c("hi"), c("lo2"), c("hi2")), 6).alias("of_smaller"))


@query("point_in_interval_innermost", f"""with {_SQL_SPANS}, s as (select doc_id, 'w' || win as span, lo, hi from wins union all select doc_id, 's' || sec, lo2, hi2 from secs),
p as (select event_id, event_id % (select count(*) from documents) as doc_id, cast(floor(abs(value)) as bigint) % 30 + 1 as at_line from events)
select event_id, doc_id, at_line, lo, hi, span from (select *, row_number() over (partition by event_id order by hi - lo, lo, span) as r from p join s using (doc_id) where at_line between lo and hi) where r = 1""")
def point_in_interval_innermost(spark, d):
    _, wins, secs = _spans(spark, d)
    s = wins.select("doc_id", F.concat(F.lit("w"), "win").alias("span"), "lo", "hi").union(secs.select("doc_id", F.concat(F.lit("s"), "sec").alias("span"), "lo2", "hi2"))
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    p = table(spark, d, "events").join(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("doc_id"), (F.floor(F.abs("value")) % 30 + 1).alias("at"))
    x = intervals.innermost_span(p, s, ["doc_id"], "event_id", "span", 10)
    return x.select("event_id", "doc_id", F.col("at").alias("at_line"), "lo", "hi", "span")


@query("asof_backward", """select p.event_id, p.user_id, (select c.event_id from events c where c.event_type = 'click' and c.user_id = p.user_id and c.ts <= p.ts order by c.ts desc, c.event_id desc limit 1) as click_id from events p where p.event_type = 'purchase'""")
def asof_backward(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return intervals.asof_backward(left, right, ["user_id"], "ts", "click_id", "click_id", "click_id").select("event_id", "user_id", "click_id")


@query("asof_nearest", """with c as (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by 1, 2)
select p.event_id, p.user_id, (select c.event_id from c where c.user_id = p.user_id order by abs(epoch_us(c.ts) - epoch_us(p.ts)), c.ts limit 1) as click_id from events p where p.event_type = 'purchase'""")
def asof_nearest(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    right = e.filter("event_type = 'click'").groupBy("user_id", F.col("ts").cast("timestamp").alias("ts")).agg(F.max("event_id").alias("click_id"))
    return intervals.asof_nearest(left, right, ["user_id"], "ts", "click_id", "click_id").select("event_id", "user_id", "click_id")


@query("session_islands", """with g as (select *, epoch_us(ts) - epoch_us(lag(ts) over w) as gap from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(case when gap is null or gap > 21600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from g)
select user_id, cast(session as bigint) as session, count(*) as n, min(event_id) as first_id, round(sum(value), 4) as value from s group by 1, 2""")
def session_islands(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("gap", us - F.lag(us).over(w))
    x = intervals.islands(e, ["user_id"], ["ts", "event_id"], F.col("gap").isNull() | (F.col("gap") > 21_600_000_000), "session")
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("value"))


@query("role_runs", """with g as (select *, case when lag(role) over w = role then 0 else 1 end as new from conversations window w as (partition by conv_id order by turn)),
s as (select *, sum(new) over (partition by conv_id order by turn) as run from g) select conv_id, cast(run as bigint) as run, min(role) as role, count(*) as n from s group by 1, 2""")
def role_runs(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("prev", F.lag("role").over(w))
    x = intervals.islands(c, ["conv_id"], ["turn"], F.col("prev").isNull() | (F.col("prev") != F.col("role")), "run")
    return x.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("n"))


def _supply(spark, d):
    """Edges supplier -> part of all lines, as text nodes."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()


_SUPPLY = "supply as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem), und as (select src, dst from supply union select dst, src from supply)"


@query("graph_bfs_distance", f"""with recursive {_SUPPLY}, r as (select 's1' as node, 0 as distance union select dst, distance + 1 from r join und on node = src where distance < 3)
select node, cast(min(distance) as bigint) as distance, round(case min(distance) when 0 then 1.0 when 1 then 0.8 when 2 then 0.6 when 3 then 0.4 else 0.2 end, 6) as score from r group by 1""")
def graph_bfs_distance(spark, d):
    seeds = spark.createDataFrame([("s1",)], "node string")
    x = graph.bfs_distance(graph.undirected(_supply(spark, d)), seeds, 3)
    return x.select("node", "distance", F.round(graph.distance_score(F.col("distance")), 6).alias("score"))


@query("neighbor_boost", f"""with {_SUPPLY}, s as (select 's' || s_suppkey as node, s_acctbal as score from supplier),
h1 as (select dst as node, max(score) as score from s join und on node = src group by 1), h2 as (select dst as node, max(score) as score from h1 join und on node = src group by 1)
select node, round(max(score), 4) as score from (select node, score * 0.8 as score from h1 union all select node, score * 0.64 from h2) group by 1""")
def neighbor_boost(spark, d):
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.col("s_acctbal").alias("score"))
    return graph.propagate(graph.undirected(_supply(spark, d)), seeds, 0.8, 2).select("node", F.round("score", 4).alias("score"))


@query("graph_stitch")
def graph_stitch(spark, d):
    calls = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"), F.lit("CALLS").alias("relation"), F.lit(0.9).alias("confidence"))
    uses = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("USES").alias("relation"), (1 - F.col("l_discount")).alias("confidence"))
    seeds = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_nationkey").alias("query_id")).agg(F.concat(F.lit("c"), F.min("c_custkey")).alias("node"))
    return graph.graph_stitch(calls.union(uses).dropDuplicates(["src", "dst", "relation"]), seeds)


@query("redundancy_clusters")
def redundancy_clusters(spark, d):
    """Customers and suppliers that hang together by any line. No SQL: the recursive closure is quadratic in a component's nodes."""
    return _trade_clusters(spark, d)


def _trade_clusters(spark, d):
    """Components of the edges customer -> supplier of all lines. Nodes are numbers, even for customers and odd for
    suppliers, until each component is named by the smallest of its nodes' names."""
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = e.select((F.col("o_custkey").cast("long") * 2).alias("src"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("dst"))
    kind = F.when(F.col("node") % 2 == 0, "c").otherwise("s")
    x = graph.connected_components(None, e).withColumn("name", F.concat(kind, F.shiftright("node", 1)))
    least = x.groupBy("component").agg(F.min("name").alias("least"))
    return x.join(least, "component", "left").select(F.col("name").alias("node"), F.col("least").alias("component"))


@query("referential_anti", """select 'orders' as source, cast(o_orderkey as bigint) as id from orders where o_custkey not in (select c_custkey from customer) union all select 'unsold', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'lineitem', l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'labels', doc_id from labels where doc_id not in (select doc_id from documents)""")
def referential_anti(spark, d):
    o, li, lb = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "labels")
    a = graph.dangling(o, "o_custkey", table(spark, d, "customer"), "c_custkey").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"))
    b = graph.dangling(li, "l_orderkey", o, "o_orderkey").select(F.lit("lineitem"), "l_orderkey")
    c = graph.dangling(lb, "doc_id", table(spark, d, "documents"), "doc_id").select(F.lit("labels"), "doc_id")
    e = graph.dangling(o, "o_orderkey", li, "l_orderkey").select(F.lit("unsold"), "o_orderkey")
    return a.union(b).union(c).union(e)


@query("scope_chains", """with x as (select 'n' || n_nationkey as id, n_name as name, r_name as up from nation join region on n_regionkey = r_regionkey) select id, up || '/' || name as scope from x union all select 'r' || r_regionkey, r_name from region""")
def scope_chains(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"))
    return graph.ancestors(r.union(n), 3).select("id", F.array_join("scope", "/").alias("scope"))


@query("relation_union", f"with {_SUPPLY} select 'SUPPLIES' as relation, count(*) as n, count(distinct src) as n_src, count(distinct dst) as n_dst from supply union all select 'ORDERS', count(*), count(distinct a), count(distinct b) from (select distinct o_custkey as a, o_orderkey as b from orders)")
def relation_union(spark, d):
    # Distinct keys stay numbers, and each count is of groups: no row stands three times, and no task holds texts.
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    out = None
    for name, edges in (("SUPPLIES", s), ("ORDERS", o)):
        n = edges.distinct().agg(F.count("*").alias("n"))
        ends = [edges.select(c).distinct().agg(F.count(c).alias(f"n_{c}")) for c in ("src", "dst")]
        row = n.join(ends[0]).join(ends[1]).select(F.lit(name).alias("relation"), "n", "n_src", "n_dst")
        out = row if out is None else out.union(row)
    return out


@query("out_degree_caps", f"with {_SUPPLY} select src, dst from (select *, row_number() over (partition by src order by dst) as r from supply) where r <= 5")
def out_degree_caps(spark, d):
    w = W.partitionBy("src").orderBy("dst")
    return _supply(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("src", "dst")


@query("hydrate_candidates", """select l.doc_id, coalesce(d.source, 'unknown') as file, coalesce(d.n_chars, 0) as n_chars, l.quality from labels l left join documents d using (doc_id)""")
def hydrate_candidates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("file"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "quality")
