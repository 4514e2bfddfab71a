"""Projections of plain tables into graphs, as SQL that Spark and DuckDB both run.

``VIEWS[name]`` is a list of (view, select); later views may use earlier ones."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..graph import Graph
from .fixpoint import write_out

_NODE = "kind, name, file, line, scope, seq"

COMMERCE = [
    (
        "commerce_nodes",
        """select concat('r:', cast(r_regionkey as string)) as id, 'module' as kind, r_name as name, r_name as file, 1 as line, cast(null as string) as scope, cast(r_regionkey as bigint) as seq from region
union all select concat('n:', cast(n_nationkey as string)), 'class', n_name, r_name, cast(n_nationkey + 1 as int), concat('r:', cast(n_regionkey as string)), cast(100 + n_nationkey as bigint) from nation join region on n_regionkey = r_regionkey
union all select concat('c:', cast(c_custkey as string)), 'function', c_mktsegment, r_name, cast(c_custkey as int), concat('n:', cast(c_nationkey as string)), 1000000 + c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select concat('s:', cast(s_suppkey as string)), 'parameter', s_name, r_name, cast(s_suppkey as int), concat('n:', cast(s_nationkey as string)), 2000000000 + s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select concat('o:', cast(o_orderkey as string)), 'call', o_orderpriority, r_name, cast(o_orderkey as int), concat('c:', cast(o_custkey as string)), 4000000000 + o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    (
        "commerce_edges",
        """select scope as src, id as dst, case when kind = 'parameter' then 'has_parameter' else 'contains' end as kind, cast(null as string) as field_name, seq from commerce_nodes where scope is not null
union all select src, dst, 'flows_to', cast(null as string), seq from (select concat('o:', cast(o_orderkey as string)) as src, concat('o:', cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as string)) as dst, 8000000000 + o_orderkey as seq,
 lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders) x where nxt is not null""",
    ),
]

EVENTS = [
    (
        "ev",
        """select event_id, user_id, event_type, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, cast(row_number() over (partition by user_id order by ts, event_id) as int) as rn from events""",
    ),
    (
        "event_nodes",
        """select distinct concat('m:', cast(user_id % 10 as string)) as id, 'module' as kind, concat('mod', cast(user_id % 10 as string)) as name, concat('u', cast(user_id % 10 as string), '.py') as file, 1 as line, cast(null as string) as scope, user_id % 10 as seq from ev
union all select distinct concat('u:', cast(user_id as string)), 'function', concat('fn', cast(user_id as string)), concat('u', cast(user_id % 10 as string), '.py'), 1, concat('m:', cast(user_id % 10 as string)), 100 + user_id from ev
union all select concat('e:', cast(event_id as string)), case event_type when 'signup' then 'parameter' when 'view' then 'variable' when 'click' then 'variable' else 'call' end,
 case event_type when 'error' then 'sanitize' when 'purchase' then 'sink' else event_type end, concat('u', cast(user_id % 10 as string), '.py'), rn, concat('u:', cast(user_id as string)), 10000000 + event_id from ev""",
    ),
    (
        "event_edges",
        """select scope as src, id as dst, case when kind = 'parameter' then 'has_parameter' else 'contains' end as kind, cast(null as string) as field_name, seq from event_nodes where scope is not null
union all select concat('e:', cast(a.event_id as string)), concat('e:', cast(b.event_id as string)), 'data_flows_to', case when a.k % 5 = 0 then concat('f', cast(a.k % 3 as string)) end, 20000000000 + a.event_id * 2 + b.rn - a.rn
 from ev a join ev b on a.user_id = b.user_id and (b.rn = a.rn + 1 or (a.rn % 3 = 0 and b.rn = a.rn + 2)) and floor((a.rn - 1) / 8) = floor((b.rn - 1) / 8)
union all select concat('e:', cast(a.event_id as string)), concat('u:', cast(a.user_id + 1 as string)), 'calls', cast(null as string), 40000000000 + a.event_id from ev a where a.event_type = 'purchase' and a.user_id + 1 in (select user_id from ev)
union all select concat('e:', cast(b.event_id as string)), concat('e:', cast(a.event_id as string)), 'defined_by', cast(null as string), 60000000000 + a.event_id from ev a join ev b on a.user_id = b.user_id and b.rn = a.rn + 1 where a.event_type in ('purchase', 'error')""",
    ),
]

#: Event nodes as statements, with branches and loops that hold the statement after them.
CONTROL = EVENTS[:1] + [
    (
        "control_nodes",
        """select distinct concat('u:', cast(user_id as string)) as id, 'function' as kind, concat('fn', cast(user_id as string)) as name, concat('u', cast(user_id % 10 as string), '.py') as file, 1 as line, cast(null as string) as scope, user_id as seq from ev
union all select concat('e:', cast(a.event_id as string)), case a.event_type when 'signup' then 'parameter' when 'view' then 'branch' when 'error' then 'loop' when 'purchase' then 'return' else 'variable' end, a.event_type, concat('u', cast(a.user_id % 10 as string), '.py'), a.rn,
 case when a.rn % 3 = 0 and p.event_type in ('view', 'error') then concat('e:', cast(p.event_id as string)) when a.rn % 3 = 1 and q.event_type in ('view', 'error') then concat('e:', cast(q.event_id as string)) else concat('u:', cast(a.user_id as string)) end, 10000000 + a.event_id
 from ev a left join ev p on a.user_id = p.user_id and p.rn = a.rn - 1 left join ev q on a.user_id = q.user_id and q.rn = a.rn - 2""",
    ),
]

#: Pages with one import for each link.
PAGES = [
    (
        "page_nodes",
        """select concat('p:', cast(page_id as string)) as id, 'module' as kind, url as name, concat('p', cast(page_id as string), '.html') as file, 1 as line, cast(null as string) as scope, page_id * 1000 as seq from pages""",
    ),
]

#: Nations as functions in region classes (twice in the first region); suppliers as calls by whole, bare and foreign names.
NAMES = [
    (
        "name_nodes",
        """select concat('r:', cast(r_regionkey as string)) as id, 'class' as kind, r_name as name, 'names.py' as file, cast(r_regionkey + 1 as int) as line, cast(null as string) as scope, cast(r_regionkey as bigint) as seq, cast(null as string) as attrs from region
union all select concat('n:', cast(n_nationkey as string)), 'function', n_name, 'names.py', cast(100 + n_nationkey as int), concat('r:', cast(n_regionkey as string)), cast(100 + n_nationkey as bigint), cast(null as string) from nation
union all select concat('d:', cast(n_nationkey as string)), 'function', n_name, 'names.py', cast(200 + n_nationkey as int), 'r:0', cast(200 + n_nationkey as bigint), cast(null as string) from nation
union all select concat('s:', cast(s_suppkey as string)), 'call', case s_suppkey % 3 when 0 then concat(r_name, '.', n_name) when 1 then n_name else concat('x.', n_name) end, 'names.py', cast(1000 + s_suppkey as int), cast(null as string), 1000 + s_suppkey, cast(null as string)
 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
]

TABLES = ("region", "nation", "customer", "supplier", "orders", "events", "pages")


#: Views that are written before the views after them read them several times.
WRITTEN = ("ev",)


def load(spark: SparkSession, sf_dir: str, views: list[tuple[str, str]]):
    """The views as DataFrames by name; the source tables that they name are temporary views."""
    used = set(re.findall(r"\w+", " ".join(select for _, select in views)))
    for t in TABLES:
        if t in used:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    found = {}
    for name, select in views:
        found[name] = spark.sql(select)
        if name in WRITTEN:
            found[name], _ = write_out(found[name], name)
        found[name].createOrReplaceTempView(name)
    return found


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    v = load(spark, sf_dir, COMMERCE)
    return Graph.of(v["commerce_nodes"], v["commerce_edges"])


def events(spark: SparkSession, sf_dir: str) -> Graph:
    v = load(spark, sf_dir, EVENTS)
    return Graph.of(v["event_nodes"], v["event_edges"])


def control(spark: SparkSession, sf_dir: str) -> Graph:
    v = load(spark, sf_dir, CONTROL)
    return Graph.of(v["control_nodes"], spark.createDataFrame([], "src string, dst string, kind string, seq bigint"))


def names(spark: SparkSession, sf_dir: str) -> Graph:
    v = load(spark, sf_dir, NAMES)
    return Graph.of(v["name_nodes"], spark.createDataFrame([], "src string, dst string, kind string, seq bigint"))


def page_imports(spark: SparkSession, sf_dir: str) -> Graph:
    from pyspark.sql import functions as F

    v = load(spark, sf_dir, PAGES)
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n", "target"))
    i = links.select(F.concat_ws(":", F.lit("i"), "page_id", "n").alias("id"), F.lit("import").alias("kind"), F.col("target").alias("name"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), (F.col("n") + 2).alias("line"), F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("scope"), (F.col("page_id") * 1000 + F.col("n") + 1).alias("seq"))
    edges = i.select(F.col("scope").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), "seq")
    return Graph.of(v["page_nodes"].unionByName(i), edges)


def with_sql(views: list[tuple[str, str]], *more: tuple[str, str], select: str) -> str:
    """One statement with the views (and more common tables) before ``select``."""
    return "with recursive " + ",\n".join(f"{name} as ({sql})" for name, sql in [*views, *more]) + "\n" + select
