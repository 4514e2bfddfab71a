"""Registered queries: every operator on a projection of the given tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranges
from .graph import Graph
from .operators import calls, change, filters, flow, pattern, taint, traverse
from .plans import project, snippets
from .plans.project import COMMERCE, CONTROL, EVENTS, NAMES, with_sql
from .sinks import documents
from .sources import build, files, graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ids(g: Graph, *ids: str) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "id string")


# -- counts ---------------------------------------------------------------------------------------


@_query(with_sql(EVENTS, select="select kind, count(*)::bigint as n from event_nodes group by kind"))
def nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.count_by_kind(project.events(spark, sf_dir).nodes)


@_query(with_sql(EVENTS, select="select kind, count(*)::bigint as n from (select distinct src, dst, kind from event_edges) group by kind"))
def edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.count_by_kind(project.events(spark, sf_dir).edges)


@_query(with_sql(EVENTS, select="select '.py' as ext, count(distinct file)::bigint as n from event_nodes"))
def files_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.files_by_extension(project.events(spark, sf_dir))


@_query(with_sql(COMMERCE, select="select (select count(*) from commerce_nodes)::bigint as nodes, (select count(*) from (select distinct src, dst, kind from commerce_edges))::bigint as edges, (select count(distinct file) from commerce_nodes)::bigint as files"))
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.commerce(spark, sf_dir).counts()


# -- filters and look-ups ---------------------------------------------------------------------------

_SHOW = ("id", "kind", "name", "file", "line", "scope")


@_query(with_sql(COMMERCE, select="select id, kind, name from commerce_nodes where kind in ('class', 'call') and regexp_matches(name, '^(UN|[0-9]-)')"))
def node_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_nodes(project.commerce(spark, sf_dir), ["CLASS", "call"], name="^(UN|[0-9]-)").select("id", "kind", "name")


@_query(with_sql(EVENTS, select="select id, kind, file from event_nodes where contains(file, 'u7')"))
def node_filter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_nodes(project.events(spark, sf_dir), file="u7").select("id", "kind", "file")


@_query(with_sql(EVENTS, select="select id, kind, name from event_nodes where kind = 'call' order by seq, id limit 50 offset 20"))
def node_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_nodes(project.events(spark, sf_dir), ["call"], offset=20, limit=50).select("id", "kind", "name")


@_query(with_sql(COMMERCE, ("inside(id)", "select c.id from commerce_nodes c join commerce_nodes p on c.scope = p.id where p.name = 'EUROPE' union select c.id from commerce_nodes c join inside i on c.scope = i.id"), select="select id, kind from commerce_nodes where kind = 'call' and id in (select id from inside)"))
def scope_chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_nodes(project.commerce(spark, sf_dir).written(), ["call"], scope="EUROPE").select("id", "kind")


@_query(with_sql(COMMERCE, select="select e.src, e.dst, e.kind, a.name as source_name, b.name as target_name from (select distinct src, dst, kind from commerce_edges) e join commerce_nodes a on e.src = a.id join commerce_nodes b on e.dst = b.id where e.kind in ('flows_to', 'contains') and regexp_matches(a.name, 'URGENT') and regexp_matches(b.name, '^[12]-')"))
def edge_endpoint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.query_edges(project.commerce(spark, sf_dir), ["flows_to", "contains"], "URGENT", "^[12]-").select("src", "dst", "kind", "source_name", "target_name")


@_query(with_sql(EVENTS, select="select e.src as of, n.id, n.kind from event_edges e join event_nodes n on e.dst = n.id where e.kind = 'data_flows_to'"))
def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.events(spark, sf_dir)
    return g.successors(g.nodes, "data_flows_to").select("of", "id", "kind")


@_query(with_sql(EVENTS, select="select distinct e.dst as of, n.id, n.kind from event_edges e join event_nodes n on e.src = n.id where e.dst in (select id from event_nodes where name = 'sink')"))
def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.events(spark, sf_dir)
    return g.predecessors(g.nodes.where("name = 'sink'")).select("of", "id", "kind")


@_query(with_sql(COMMERCE, select="select id, kind, scope from commerce_nodes where scope in (select id from commerce_nodes where kind = 'class')"))
def children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.commerce(spark, sf_dir)
    return g.children_of(g.nodes.where("kind = 'class'")).select("id", "kind", "scope")


@_query(with_sql(COMMERCE, select="select c.id as of, p.id, p.kind from commerce_nodes c join commerce_nodes p on c.scope = p.id where c.kind = 'call'"))
def scope_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.commerce(spark, sf_dir)
    return g.scope_of(g.nodes.where("kind = 'call'")).select("of", "id", "kind")


_PLACE = "case kind when 'function' then 0 when 'call' then 1 when 'variable' then 2 else 9 end"


@_query(with_sql(EVENTS, select=f"select file, line, id, kind from event_nodes qualify row_number() over (partition by file, line order by {_PLACE}, seq, id) = 1"))
def node_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.nodes_at(project.events(spark, sf_dir).nodes).select("file", "line", "id", "kind")


@_query(with_sql(EVENTS, select="select id, line, name from event_nodes where file = 'u3.py'"))
def nodes_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.nodes_in_file(project.events(spark, sf_dir), "u3.py").select("id", "line", "name")


# -- control flow -----------------------------------------------------------------------------------

_FN = "select id from control_nodes where kind = 'function'"
_BLOCK = f"select id from control_nodes where kind in ('branch', 'loop') and scope in ({_FN})"


@_query(with_sql(CONTROL, select=f"select src, dst, 'flows_to' as kind from (select id as src, kind as k, lead(id) over (partition by scope order by line, seq, id) as dst from control_nodes where scope in ({_FN})) where k <> 'return' and dst is not null"))
def cfg_flows_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.sequential_flow(project.control(spark, sf_dir).nodes)


@_query(with_sql(CONTROL, select=f"select scope as src, id as dst, 'branches_to' as kind from control_nodes where scope in ({_BLOCK}) qualify row_number() over (partition by scope order by line, seq, id) = 1"))
def cfg_branch_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.branch_entries(project.control(spark, sf_dir).nodes)


@_query(with_sql(CONTROL, ("last", f"select scope, id, kind as k from control_nodes where scope in (select id from control_nodes where kind = 'loop' and scope in ({_FN})) qualify row_number() over (partition by scope order by line desc, seq desc, id desc) = 1"), select="select id as src, scope as dst, 'flows_to' as kind from last where k <> 'return'"))
def cfg_loop_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.loop_backs(project.control(spark, sf_dir).nodes)


# -- traversal --------------------------------------------------------------------------------------

_DFG = ("dfg", "select distinct src, dst from event_edges where kind = 'data_flows_to'")


def _closure(what: str, a: str, b: str) -> str:
    return f"select n.id as origin, e.{b} as id from event_nodes n join dfg e on n.id = e.{a} where {what} union select r.origin, e.{b} from r join dfg e on r.id = e.{a}"


@_query(with_sql(EVENTS, _DFG, ("r(origin, id)", _closure("n.kind = 'parameter'", "src", "dst")), select="select r.origin, n.id, n.kind from r join event_nodes n on r.id = n.id"))
def reach_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every parameter reaches."""
    g = project.events(spark, sf_dir).written()
    return traverse.reachable(g, g.nodes_of("parameter"), ["data_flows_to"]).select("origin", "id", "kind")


@_query(with_sql(EVENTS, _DFG, ("r(origin, id)", _closure("n.name = 'sink'", "dst", "src")), select="select r.origin, n.id, n.kind from r join event_nodes n on r.id = n.id"))
def reach_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches every sink."""
    g = project.events(spark, sf_dir).written()
    return traverse.reachable(g, g.nodes.where("name = 'sink'"), ["data_flows_to"], reverse=True).select("origin", "id", "kind")


@_query(with_sql(COMMERCE, ("r(origin, id)", "select scope, id from commerce_nodes where scope in (select id from commerce_nodes where kind = 'class') union select r.origin, n.id from r join commerce_nodes n on n.scope = r.id"), select="select r.origin, n.id, n.kind from r join commerce_nodes n on r.id = n.id"))
def scope_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that stands under each class."""
    g = project.commerce(spark, sf_dir).written()
    return traverse.reachable(g, g.nodes_of("class"), ["contains", "has_parameter"]).select("origin", "id", "kind")


_SUB = ("sub(id, depth)", "select 'n:7', 0 union select e.dst, s.depth + 1 from sub s join commerce_edges e on s.id = e.src where s.depth < 3")


@_query(with_sql(COMMERCE, _SUB, select="select distinct n.id, n.kind from sub s join commerce_nodes n on s.id = n.id"))
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.subgraph(project.commerce(spark, sf_dir), "n:7", max_depth=3).nodes.select("id", "kind")


@_query(with_sql(COMMERCE, _SUB, select="select distinct src, dst, kind from commerce_edges where src in (select id from sub) and dst in (select id from sub)"))
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.subgraph(project.commerce(spark, sf_dir), "n:7", max_depth=3).edges.select("src", "dst", "kind")


_HOPS = ("h", "select distinct src, dst from event_edges")
_PAIR_USER = "(select min(user_id) from ev where user_id in (select user_id from ev group by user_id having count(*) >= 8))"


@_query(with_sql(EVENTS, _HOPS, ("ends", f"select (select concat('e:', event_id::varchar) from ev where user_id = {_PAIR_USER} and rn = 1) as a, (select concat('e:', event_id::varchar) from ev where user_id = {_PAIR_USER} and rn = 8) as b"), ("p(node, path, n)", "select a, [a], 0 from ends union all select h.dst, list_append(p.path, h.dst), p.n + 1 from p join h on p.node = h.src where p.n < 10 and not list_contains(p.path, h.dst)"), select="select array_to_string(path, '->') as path from p where node = (select b from ends) and n > 0"))
def paths_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.events(spark, sf_dir)
    user = "(select min(user_id) from ev where user_id in (select user_id from ev group by user_id having count(*) >= 8))"
    a, b = (spark.sql(f"select concat('e:', cast(event_id as string)) as id from ev where user_id = {user} and rn = {n}") for n in (1, 8))
    return traverse.simple_paths(traverse.hops(g), a, b, 10).select(F.array_join("path", "->").alias("path"))


_SINK = "(select concat('e:', event_id::varchar) from ev where event_type = 'purchase' and rn % 8 = 0 order by user_id, rn limit 1)"


@_query(
    with_sql(
        EVENTS,
        _DFG,
        ("sinks", f"select {_SINK} as sink"),
        ("back(id, n)", "select sink, 0 from sinks union select e.src, b.n + 1 from back b join dfg e on b.id = e.dst where b.n < 20"),
        ("ins", "select distinct id from back"),
        ("e2", "select src, dst from dfg where src in (select id from ins) and dst in (select id from ins)"),
        ("p(node, path)", "select id, [id] from ins where id not in (select dst from e2) and id <> (select sink from sinks) union all select e.dst, list_append(p.path, e.dst) from p join e2 e on p.node = e.src where len(p.path) <= 20 and not list_contains(p.path, e.dst)"),
        select="select array_to_string(path, '->') as path from p where node = (select sink from sinks)",
    )
)
def paths_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.events(spark, sf_dir)
    row = spark.sql("select concat('e:', cast(event_id as string)) as id from ev where event_type = 'purchase' and rn % 8 = 0 order by user_id, rn limit 1").first()
    return traverse.paths_to_sink(g, row.id if row else "", ["data_flows_to"]).select(F.array_join("path", "->").alias("path"))


# -- patterns ---------------------------------------------------------------------------------------


@_query(with_sql(EVENTS, _DFG, select="select concat(a.id, '->', b.id, '->', c.id) as chain from event_nodes a join dfg x on a.id = x.src join event_nodes b on b.id = x.dst join dfg y on b.id = y.src join event_nodes c on c.id = y.dst where a.kind = 'parameter' and b.kind = 'variable' and regexp_matches(b.name, '^vi') and c.kind = 'call'"))
def pattern_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [pattern.Step("parameter"), pattern.Step("variable", name="^vi"), pattern.Step("call")]
    return pattern.match_chain(project.events(spark, sf_dir).written(), pattern.Chain(steps, "data_flows_to")).select(F.array_join("chain", "->").alias("chain"))


@_query(with_sql(EVENTS, _DFG, ("w(origin, id)", "select n.id, e.dst from event_nodes n join dfg e on n.id = e.src where n.kind = 'parameter' union select w.origin, e.dst from w join dfg e on w.id = e.src"), select="select concat(w.origin, '->', w.id) as chain from w join event_nodes n on w.id = n.id where n.name = 'sink' and w.origin <> w.id"))
def pattern_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [pattern.Step("parameter"), pattern.Step(wildcard=True), pattern.Step("call", name="^sink$")]
    return pattern.match_chain(project.events(spark, sf_dir).written(), pattern.Chain(steps, "data_flows_to")).select(F.array_join("chain", "->").alias("chain"))


# -- call resolution --------------------------------------------------------------------------------

_FNS = ("fns", "select f.id, f.name, f.seq, s.name as scope_name from name_nodes f left join name_nodes s on f.scope = s.id where f.kind = 'function'")


def _resolved(key: str, where: str) -> str:
    q = "case when contains(c.name, '.') then split_part(c.name, '.', -2) end"
    return with_sql(NAMES, _FNS, select=f"select c.id as call, f.id as fn from name_nodes c join fns f on f.name = {key} where c.kind = 'call' and {where} qualify row_number() over (partition by c.id order by case when f.scope_name = {q} then 0 else 1 end, f.seq, f.id) = 1")


def _name_parts(g: Graph) -> tuple[DataFrame, DataFrame]:
    from .functions.text import short_name

    return g.nodes.where("kind = 'call'").withColumn("short", short_name(F.col("name"))), calls.functions_of(g)


@_query(_resolved("c.name", "true"))
def call_resolution_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.by_name(*_name_parts(project.names(spark, sf_dir)))


@_query(_resolved("split_part(c.name, '.', -1)", "c.name like 'x.%'"))
def call_resolution_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = _name_parts(project.names(spark, sf_dir))
    return calls.by_name(c.where("name like 'x.%'"), f, "short")


@_query(_resolved("split_part(c.name, '.', -1)", "contains(c.name, '.') and c.name not like 'x.%'"))
def call_resolution_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = _name_parts(project.names(spark, sf_dir))
    return calls.by_name(c.where("name like '%.%' and name not like 'x.%'"), f, "short")


@_query(_resolved("case when contains(c.name, '.') then split_part(c.name, '.', -1) else c.name end", "true"))
def call_resolution_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.resolve_calls(project.names(spark, sf_dir).written()).select(F.col("src").alias("call"), F.col("dst").alias("fn"))


# Nations as classes that inherit from the next two by key; each class of a key divisible by 4 has a method.
_MRO = [
    (
        "mro_nodes",
        """select concat('k:', cast(n_nationkey as string)) as id, 'class' as kind, n_name as name, cast(null as string) as scope, cast(n_nationkey as bigint) as seq, concat('{"bases":["', coalesce((select min(b.n_name) from nation b where b.n_nationkey = a.n_nationkey + 1), 'none'), '","', coalesce((select min(b.n_name) from nation b where b.n_nationkey = a.n_nationkey + 2), 'none'), '"]}') as attrs from nation a
union all select concat('f:', cast(n_nationkey as string)), 'function', 'run', concat('k:', cast(n_nationkey as string)), cast(1000 + n_nationkey as bigint), cast(null as string) from nation where n_nationkey % 4 = 0
union all select concat('s:', cast(s_suppkey as string)), 'call', 'obj.run', cast(null as string), 10000 + s_suppkey, concat('{"receiver_inferred_type":"', n_name, '"}') from supplier join nation on s_nationkey = n_nationkey""",
    )
]


@_query(
    with_sql(
        _MRO,
        ("cls", "select id, name, json_extract_string(attrs, '$.bases[0]') as b0, json_extract_string(attrs, '$.bases[1]') as b1 from mro_nodes where kind = 'class'"),
        ("e", "select name as sub, 0 as pos, b0 as base from cls union all select name, 1, b1 from cls"),
        ("walk(cls, base, depth, ord)", "select name, name, 0, '' from cls union all select w.cls, e.base, w.depth + 1, concat(w.ord, e.pos::varchar) from walk w join e on w.base = e.sub join cls on cls.name = e.base where w.depth < 6"),
        select="select c.id as call, m.id as fn from mro_nodes c join walk w on w.cls = json_extract_string(c.attrs, '$.receiver_inferred_type') join cls k on k.name = w.base join mro_nodes m on m.kind = 'function' and m.scope = k.id where c.kind = 'call' qualify row_number() over (partition by c.id order by w.depth, w.ord) = 1",
    )
)
def call_resolution_mro(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = project.load(spark, sf_dir, _MRO)
    g = Graph.of(v["mro_nodes"], spark.createDataFrame([], "src string, dst string, kind string, seq bigint"))
    return calls.by_method(g, g.typed_nodes.where("kind = 'call'"))


# Regions as modules with their nations as functions; suppliers import a nation under an alias and call it.
_IMPORTS = [
    (
        "import_nodes",
        """select concat('m:', cast(r_regionkey as string)) as id, 'module' as kind, replace(r_name, ' ', '_') as name, cast(null as string) as scope, cast(r_regionkey as bigint) as seq, cast(null as string) as attrs from region
union all select concat('f:', cast(n_nationkey as string)), 'function', n_name, concat('m:', cast(n_regionkey as string)), cast(100 + n_nationkey as bigint), cast(null as string) from nation
union all select concat('i:', cast(s_suppkey as string)), 'import', 'from', cast(null as string), 1000 + s_suppkey, concat('{"is_from":true,"module":"pkg.', replace(r_name, ' ', '_'), '","names":["', n_name, '"],"aliases":{"', n_name, '":"a', cast(s_suppkey % 50 as string), '"}}') from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select concat('c:', cast(s_suppkey as string)), 'call', concat('a', cast(s_suppkey % 70 as string)), cast(null as string), 100000 + s_suppkey, cast(null as string) from supplier""",
    )
]


@_query(
    with_sql(
        _IMPORTS,
        ("im", "select concat('a', (s_suppkey % 50)::varchar) as local, replace(r_name, ' ', '_') as module, n_name as original from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey qualify row_number() over (partition by s_suppkey % 50 order by s_suppkey desc) = 1"),
        select="select c.id as call, f.id as fn from import_nodes c join im on c.name = im.local join import_nodes m on m.kind = 'module' and m.name = im.module join import_nodes f on f.kind = 'function' and f.scope = m.id and f.name = im.original where c.kind = 'call'",
    )
)
def call_resolution_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = project.load(spark, sf_dir, _IMPORTS)
    g = Graph.of(v["import_nodes"], spark.createDataFrame([], "src string, dst string, kind string, seq bigint"))
    return calls.by_import(g, g.nodes.where("kind = 'call'"))


# -- summaries and interprocedural flow -------------------------------------------------------------

#: Events as in EVENTS, but purchases are returns: a function returns what flows into them.
_RETURNS = EVENTS[:2] + [("ret_nodes", "select id, case when name = 'sink' then 'return' else kind end as kind, name, file, line, scope, seq from event_nodes"), EVENTS[2]]
_SUMMARY = (
    "summary(function_id, position, reached_id)",
    """select p.scope, p.position, e.dst from (select *, row_number() over (partition by scope order by seq, id) - 1 as position from ret_nodes where kind = 'parameter') p join dfg e on p.id = e.src
union select s.function_id, s.position, e.dst from summary s join dfg e on s.reached_id = e.src""",
)


def _returns(spark: SparkSession, sf_dir: str) -> Graph:
    v = project.load(spark, sf_dir, _RETURNS)
    return Graph.of(v["ret_nodes"], v["event_edges"])


@_query(with_sql(_RETURNS, _DFG, _SUMMARY, select="select distinct s.function_id, s.position::int as position from summary s join ret_nodes n on s.reached_id = n.id where n.kind = 'return'"))
def summary_params_to_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.summaries(_returns(spark, sf_dir)).where("reached_kind = 'return'").select("function_id", "position").distinct()


@_query(with_sql(_RETURNS, _DFG, _SUMMARY, select="select s.function_id, s.position::int as position, s.reached_id from summary s join ret_nodes n on s.reached_id = n.id where n.kind = 'call'"))
def summary_params_to_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.summaries(_returns(spark, sf_dir)).where("reached_kind = 'call'").select("function_id", "position", "reached_id")


_CALLS = ("called", "select distinct src as call, dst as fn from event_edges where kind = 'calls'")


@_query(with_sql(EVENTS, _DFG, _CALLS, ("args", "select e.dst as call, e.src as arg, row_number() over (partition by e.dst order by n.line, n.seq, n.id) as o from dfg e join event_nodes n on e.src = n.id"), ("pars", "select scope as fn, id as param, row_number() over (partition by scope order by seq, id) as o from event_nodes where kind = 'parameter'"), select="select distinct a.arg as src, p.param as dst from called c join args a on c.call = a.call join pars p on c.fn = p.fn and a.o = p.o"))
def interproc_arg_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.events(spark, sf_dir)
    return flow.argument_flow(g, g.edges_of("calls")).select("src", "dst")


#: Errors call the next user's function.
_ERROR_CALLS = ("called", "select concat('e:', cast(event_id as string)) as call, concat('u:', cast(user_id + 1 as string)) as fn from ev where event_type = 'error'")


@_query(with_sql(_RETURNS, _DFG, _SUMMARY, _ERROR_CALLS, select="select distinct e.src, c.call as dst from called c join ret_nodes r on r.scope = c.fn and r.kind = 'return' join dfg e on e.dst = r.id where c.fn in (select s.function_id from summary s join ret_nodes n on s.reached_id = n.id where n.kind = 'return')"))
def interproc_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _returns(spark, sf_dir)
    called = spark.sql(_ERROR_CALLS[1]).select(F.col("call").alias("src"), F.col("fn").alias("dst"))
    return flow.return_flow(g, called, flow.summaries(g)).select("src", "dst")


# -- taint ------------------------------------------------------------------------------------------

def _policy(**more) -> taint.Policy:
    return taint.Policy(F.when(F.col("name").isin("signup", "view"), F.col("name")), F.col("name") == "sink", **({"sanitizer": F.col("name") == "sanitize"} | more))


_FLOW = ("d", "select distinct src, dst, field_name as f from event_edges where kind = 'data_flows_to'")
_SEED = ("seed", "select id as origin, name as label from event_nodes where name in ('signup', 'view')")


def _spread(edges: str = "d", seed: str = "seed", cut: str = "") -> str:
    step = "case when d.f is null then {f} else d.f end"
    return f"select s.origin, s.label, {step.format(f='null::varchar')}, d.dst, 1 from {seed} s join {edges} d on s.origin = d.src {cut.replace('NODE', 's.origin')} union select r.origin, r.label, coalesce(r.field, d.f), d.dst, 1 from r join {edges} d on r.node = d.src and (d.f is null or r.field is null or r.field = d.f) {cut.replace('NODE', 'r.node')}"


_R = ("r(origin, label, field, node, x)", _spread())
_U = ("u", "select distinct label, field, node from r2")
_R2 = ("r2(origin, label, field, node, x)", _spread(cut="and NODE not in (select id from event_nodes where name = 'sanitize')").replace("from r ", "from r2 r "))
_HITS = ("hits", "select r.origin, r.node as sink, r.label, r.field, exists (select 1 from u where u.label = r.label and u.field is not distinct from r.field and u.node = r.node) as bypass from r join event_nodes n on r.node = n.id where n.name = 'sink'")


def _taint(spark: SparkSession, sf_dir: str, policy: taint.Policy | None = None) -> taint.Result:
    g = project.events(spark, sf_dir).written()
    none = spark.createDataFrame([], "function_id string, position int, reached_id string, reached_kind string")
    return taint.run(g, policy or _policy(), none)


@_query(with_sql(EVENTS, _FLOW, _SEED, _R, select="select distinct node, label, coalesce(field, '') as field, origin from (select node, label, field, origin from r union all select origin, label, null, origin from seed)"))
def taint_labels_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taint(spark, sf_dir).labels_at.select("node", "label", F.coalesce("field", F.lit("")).alias("field"), "origin")


@_query(with_sql(EVENTS, _FLOW, _SEED, _R, _R2, _U, _HITS, select="select origin, sink, not bool_or(bypass) as is_sanitized from hits group by origin, sink"))
def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taint(spark, sf_dir).paths.select("origin", "sink", "is_sanitized")


@_query(with_sql(EVENTS, _FLOW, _SEED, _R, _R2, _U, _HITS, select="select origin, sink from hits group by origin, sink having bool_or(bypass)"))
def taint_unsanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taint(spark, sf_dir).paths.where("not is_sanitized").select("origin", "sink")


@_query(with_sql(EVENTS, _FLOW, _SEED, _R, select="select node, field, count(distinct origin)::bigint as origins from r where field is not null group by node, field"))
def taint_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taint(spark, sf_dir).reach.where("field is not null").groupBy("node", "field").agg(F.count_distinct("origin").alias("origins"))


@_query(with_sql(EVENTS, _FLOW, ("seed", "select id as origin, case when name = 'view' then 'view' else concat('param:', name) end as label from event_nodes where name = 'view' or kind = 'parameter'"), _R, select="select distinct r.origin, r.label, r.node as sink from r join event_nodes n on r.node = n.id where n.name = 'sink'"))
def taint_implicit_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = taint.Policy(F.when(F.col("name") == "view", "view"), F.col("name") == "sink", implicit_params=True)
    return _taint(spark, sf_dir, policy).hits.select("origin", "label", "sink").distinct()


_PROP = ("d", "select distinct src, dst, field_name as f from event_edges where kind = 'data_flows_to' union select e.dst, e.src, null from event_edges e join event_nodes n on e.dst = n.id where e.kind = 'defined_by' and n.kind = 'call' and n.name = 'sanitize' and n.line % 2 = 0 and e.dst not in (select src from event_edges where kind = 'calls')")


@_query(with_sql(EVENTS, _PROP, _SEED, _R, select="select distinct r.origin, r.label, r.node from r"))
def taint_propagators(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = _policy(sanitizer=F.lit(False), propagators=(((F.col("name") == "sanitize") & (F.col("line") % 2 == 1), False), (F.col("name") == "sanitize", True)))
    return _taint(spark, sf_dir, policy).reach.select("origin", "label", "node").distinct()


@_query(with_sql(EVENTS, _FLOW, _SEED, _R, ("held", "select node, label, field, origin from r union select origin, label, null, origin from seed"), select="select d.src, d.dst, count(distinct a.label)::bigint as labels, count(distinct a.origin)::bigint as origins from held a join d on a.node = d.src and (d.f is null or a.field is null or a.field = d.f) group by d.src, d.dst"))
def taint_edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taint(spark, sf_dir).edge_labels.groupBy("src", "dst").agg(F.count_distinct("label").alias("labels"), F.count_distinct("origin").alias("origins"))


# A sanitizer s is common to a state iff the state is out of reach once s no longer passes anything on.
_COMMON = (
    "c(san, origin, label, field, node)",
    """select z.id, s.origin, s.label, d.f, d.dst from (select id from event_nodes where name = 'sanitize') z, seed s join d on s.origin = d.src
where s.origin <> z.id and split_part((select scope from event_nodes n where n.id = s.origin), ':', 2) = split_part((select scope from event_nodes n where n.id = z.id), ':', 2)
union select c.san, c.origin, c.label, coalesce(c.field, d.f), d.dst from c join d on c.node = d.src and c.node <> c.san and (d.f is null or c.field is null or c.field = d.f)""",
)


@_query(
    with_sql(
        EVENTS,
        _FLOW,
        _SEED,
        _R,
        _R2,
        _U,
        _HITS,
        _COMMON,
        ("ck", "select distinct san, label, field, node from c"),
        ("cs", "select distinct z.id as san from hits h join event_nodes k on k.id = h.sink join event_nodes z on z.name = 'sanitize' and z.scope = k.scope where not h.bypass and not exists (select 1 from ck where ck.san = z.id and ck.label = h.label and ck.field is not distinct from h.field and ck.node = h.sink)"),
        ("t", "select node as id, 0 as r from r union select origin, 0 from seed union select origin, 1 from hits union select sink, 2 from hits union select san, 3 from cs"),
        select="select id, ['intermediate', 'source', 'sink', 'sanitizer'][max(r) + 1] as role from t group by id",
    )
)
def taint_apply_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _taint(spark, sf_dir).annotations().where("key = 'taint_role'")
    return a.select("id", F.replace("value", F.lit('"'), F.lit("")).alias("role"))


_WALK = (
    "walk(origin, label, field, node, path, depth)",
    """select s.origin, s.label, d.f, d.dst, [{'n': d.dst, 'f': coalesce(d.f, '')}], 1 from seed s join d on s.origin = d.src
union all select w.origin, w.label, coalesce(w.field, d.f), d.dst, list_append(w.path, {'n': d.dst, 'f': coalesce(w.field, d.f, '')}), w.depth + 1 from walk w join d on w.node = d.src and (d.f is null or w.field is null or w.field = d.f)""",
)


@_query(
    with_sql(
        EVENTS,
        _FLOW,
        _SEED,
        _WALK,
        ("best", "select origin, node as sink, min({'d': depth, 'l': label, 'f': coalesce(field, '')}) as b from walk where node in (select id from event_nodes where name = 'sink') group by origin, node"),
        select="select b.origin, b.sink, concat(b.origin, '->', array_to_string(list_transform(min(w.path), lambda x: x.n), '->')) as path from best b join walk w on w.origin = b.origin and w.node = b.sink and w.depth = b.b.d and w.label = b.b.l and coalesce(w.field, '') = b.b.f group by b.origin, b.sink",
    )
)
def taint_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shortest path per (origin, sink): that of the least states."""
    return _taint(spark, sf_dir).path_nodes().select("origin", "sink", F.array_join("path", "->").alias("path"))


# -- change -----------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Before: nodes of even emission numbers; after: those not divisible by 3, one line further down in one file."""
    g = project.commerce(spark, sf_dir)
    moved = F.when(F.col("file") == "ASIA", F.col("line") + 1).otherwise(F.col("line"))
    return change.diff(Graph.of(g.nodes.where("seq % 2 = 0"), g.edges_raw), Graph.of(g.nodes.where("seq % 3 <> 0").withColumn("line", moved), g.edges_raw))


_BEFORE = ("b", "select distinct kind, name, file, line from commerce_nodes where seq % 2 = 0 and kind in ('function', 'class', 'call')")
_AFTER = ("a", "select distinct kind, name, file, (case when file = 'ASIA' then line + 1 else line end)::int as line from commerce_nodes where seq % 3 <> 0 and kind in ('function', 'class', 'call')")


@_query(with_sql(COMMERCE, _BEFORE, _AFTER, select="select * from a except select * from b"))
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)["added"]


@_query(with_sql(COMMERCE, _BEFORE, _AFTER, select="select * from b except select * from a"))
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)["removed"]


@_query(with_sql(COMMERCE, select="select file, before, after from (select file, count(*) filter (where seq % 2 = 0)::bigint as before, count(*) filter (where seq % 3 <> 0)::bigint as after from commerce_nodes group by file) where before > 0 and after > 0 and before <> after"))
def diff_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)["changed_files"]


@_query(with_sql(COMMERCE, select="""select id, 'urgent' as key, 'true' as value from commerce_nodes where kind = 'call' and regexp_matches(name, 'URGENT')
union all select id, 'level', case when regexp_matches(name, '^[12]') then '"high"' else '1' end from commerce_nodes where kind = 'call'"""))
def annotate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"match": {"kind": "CALL"}, "set": {"level": 1}}, {"match": {"kind": "call", "name": "^[12]"}, "set": {"level": "high"}}, {"match": {"kind": "call", "name": "URGENT"}, "set": {"urgent": True}}, {"match": {"kind": "nothing"}, "set": {"x": 1}}]
    g, _ = change.annotate(project.commerce(spark, sf_dir), rules)
    return g.node_annotations.select("id", "key", "value")


@_query(with_sql(COMMERCE, select="""select 'nodes' as part, count(*)::bigint as n from commerce_nodes where id not in (select id from commerce_nodes where kind = 'class' and name < 'G')
union all select 'edges', count(*)::bigint from (select distinct src, dst, kind from commerce_edges) where src not in (select id from commerce_nodes where kind = 'class' and name < 'G') and dst not in (select id from commerce_nodes where kind = 'class' and name < 'G') and not (kind = 'contains' and src like 'r:%')"""))
def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some nodes removed with their edges, and one kind of edge between other pairs."""
    g = project.commerce(spark, sf_dir)
    g = g.remove_nodes(g.nodes.where("kind = 'class' and name < 'G'"))
    g = g.remove_edges(g.edges_raw.where("src like 'r:%'"), "contains")
    part = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part("nodes", g.nodes).unionByName(part("edges", g.edges))


@_query(with_sql(COMMERCE, select="""select id, kind, case when kind = 'class' then 'renamed' else name end as name from commerce_nodes union all select concat('new:', r_regionkey::varchar), 'literal', r_name from region"""))
def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, among them some that replace nodes of the same id."""
    g = project.commerce(spark, sf_dir)
    new = spark.table("region").select(F.concat(F.lit("new:"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("literal").alias("kind"), F.col("r_name").alias("name"))
    g = g.add_nodes(g.nodes_of("class").withColumn("name", F.lit("renamed"))).add_nodes(new)
    return g.nodes.select("id", "kind", "name")


_SPANS = ("spans", "select id, file, line as lo, line + cast(seq % 7 as int) as hi from event_nodes where name = 'sink'")


@_query(with_sql(EVENTS, _SPANS, select="select a.file, a.id as a, b.id as b from spans a join spans b on a.file = b.file and a.id < b.id and a.lo <= b.hi and b.lo <= a.hi"))
def location_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    project.events(spark, sf_dir)
    return ranges.overlapping_pairs(spark.sql(_SPANS[1]), 16)


@_query(with_sql(COMMERCE, ("e", "select distinct src, dst from commerce_edges where kind = 'has_parameter'"), select="""select concat('  "', id, '" [label="', kind, ': ', name, '\\nL', line::varchar, '", shape=', case kind when 'class' then 'component' else 'ellipse' end, '];') as line from commerce_nodes where id in (select src from e union select dst from e)
union all select concat('  "', src, '" -> "', dst, '" [label="has_parameter", style=dashed];') from e"""))
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.dot_lines(project.commerce(spark, sf_dir), ["has_parameter"]).where("part in (1, 2)").select("line")


@_query("with p as (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as name from pages) select name, count(*)::bigint as n from p where regexp_matches(name, '^/[A-Z]') group by name")
def page_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = project.page_imports(spark, sf_dir)
    return filters.query_nodes(g, ["import"], name="^/[A-Z]").groupBy("name").agg(F.count("*").alias("n"))


@_query(with_sql(COMMERCE, select="select id, kind, name, file, line::int as line, scope from commerce_nodes"))
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes as JSON and back."""
    records = documents.node_records(project.commerce(spark, sf_dir).nodes)
    return graphs.nodes_from_records(records.select(F.col("json").alias("value"))).select(*_SHOW)


@_query("with f as (select concat('p', page_id::varchar, '.html') as path, sha256(html) as before, sha256(case when page_id % 3 = 0 then html || ' ' else html end) as after from pages where page_id % 5 <> 0) select path, case when page_id % 5 = 0 then 'added' else 'changed' end as change from (select page_id, concat('p', page_id::varchar, '.html') as path from pages) p where page_id % 5 = 0 or path in (select path from f where before <> after)")
def content_hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    now = p.select("path", F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 5 != 0), F.concat("html", F.lit(" "))).otherwise(F.col("html")).cast("binary").alias("content"))
    return files.changes(files.hashes(p.where("page_id % 5 <> 0").select("path", F.col("html").cast("binary").alias("content"))), files.hashes(now))


# -- front-ends -------------------------------------------------------------------------------------


def _programs(spark: SparkSession) -> Graph:
    nodes, edges, _ = build.parse_files(files.inline(spark, snippets.SOURCES))
    return Graph.of(nodes, edges)


@_query(f"select * from (values {snippets.values(snippets.NODES)}) as t(file, kind, name, line, scope_name)")
def front_end_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each front-end emits for a small program: imports, classes, functions, parameters, branches, loops, calls, variables, returns."""
    g = _programs(spark)
    scopes = g.nodes.select(F.col("id").alias("scope"), F.col("name").alias("scope_name"))
    return g.nodes.join(scopes, "scope").select("file", "kind", "name", "line", "scope_name")


@_query(f"select * from (values {snippets.values(snippets.FLOWS)}) as t(file, source, target)")
def front_end_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data flow that each front-end emits for a small program."""
    g = _programs(spark)
    end = lambda c, name: g.nodes.select(F.col("id").alias(c), F.col("name").alias(name), F.col("file"))
    return g.edges_of("data_flows_to").join(end("src", "source"), "src").join(end("dst", "target").drop("file"), "dst").select("file", "source", "target").distinct()
