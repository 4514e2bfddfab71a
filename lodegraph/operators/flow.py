"""Control flow inside functions, and data flow between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, attr
from ..plans.fixpoint import fixpoint, write_out

_ORDER = ["line", "col", "seq", "id"]


def _edge(kind: str, src: Column, dst: Column) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")]


def sequential_flow(nodes: DataFrame) -> DataFrame:
    """flows_to from each located direct child of a function to the next by place, but not from a return."""
    fn = nodes.where("kind = 'function'").select(F.col("id").alias("scope"))
    c = nodes.where("line is not null").join(fn, "scope", "left_semi")
    c = c.withColumn("next", F.lead("id").over(Window.partitionBy("scope").orderBy(*_ORDER)))
    return c.where("kind <> 'return' and next is not null").select(*_edge("flows_to", F.col("id"), F.col("next")))


def branch_entries(nodes: DataFrame) -> DataFrame:
    """branches_to from each branch or loop that is a function's direct child to its first located child."""
    first = _blocks(nodes).agg(F.min_by("id", F.struct(*_ORDER)).alias("to"))
    return first.select(*_edge("branches_to", F.col("scope"), F.col("to")))


def loop_backs(nodes: DataFrame) -> DataFrame:
    """flows_to from a loop's last located child back to the loop, unless that is a return."""
    last = _blocks(nodes, ("loop",)).agg(F.max_by(F.struct("id", "kind"), F.struct(*_ORDER)).alias("last"))
    return last.where("last.kind <> 'return'").select(*_edge("flows_to", F.col("last.id"), F.col("scope")))


def _blocks(nodes: DataFrame, kinds: tuple[str, ...] = ("branch", "loop")):
    fn = nodes.where("kind = 'function'").select(F.col("id").alias("scope"))
    block = nodes.where(F.col("kind").isin(*kinds)).join(fn, "scope", "left_semi").select(F.col("id").alias("scope"))
    return nodes.where("line is not null").join(block, "scope", "left_semi").groupBy("scope")


def control_flow(nodes: DataFrame) -> DataFrame:
    return sequential_flow(nodes).unionByName(branch_entries(nodes)).unionByName(loop_backs(nodes))


def summaries(g: Graph) -> DataFrame:
    """Rows ``(function_id, position, reached_id, reached_kind)``: the returns and calls that data of a
    parameter reaches over nodes that are direct children of its function."""
    own = g.nodes.where("scope is not null").select("id", "kind", F.col("scope").alias("fn"))
    fn = g.nodes.where("kind = 'function'").select(F.col("id").alias("fn"))
    own = own.join(fn, "fn", "left_semi")
    e = g.edges_raw.where("kind = 'data_flows_to'").select("src", "dst").distinct()
    e = e.join(own.select(F.col("id").alias("src"), "fn"), "src").join(own.select(F.col("id").alias("dst"), "fn", F.col("kind").alias("dst_kind")), ["dst", "fn"])
    e, _ = write_out(e.select("src", "dst", "dst_kind"), "own-flow")
    p = parameters(g)
    seed = p.join(e, p.param == e.src).select("function_id", "position", F.col("dst").alias("reached_id"), F.col("dst_kind").alias("reached_kind"))
    step = lambda d: d.join(e, d.reached_id == e.src).select("function_id", "position", F.col("dst").alias("reached_id"), F.col("dst_kind").alias("reached_kind"))
    return fixpoint(seed, step, ["function_id", "position", "reached_id"]).where("reached_kind in ('return', 'call')")


def parameters(g: Graph) -> DataFrame:
    """Rows ``(function_id, position, param)``; the position is the attribute's, else the order of emission."""
    p = g.nodes.where("kind = 'parameter' and scope is not null")
    n = F.row_number().over(Window.partitionBy("scope").orderBy("seq", "id")) - 1
    return p.select(F.col("scope").alias("function_id"), F.coalesce(attr("position").cast("int"), n).alias("position"), F.col("id").alias("param"))


def _arguments(g: Graph, arg_order: str) -> DataFrame:
    """Rows ``(call, ordinal, arg)``: what flows into a call, by place of definition or by emission."""
    e = g.edges_raw.where("kind = 'data_flows_to'").select("src", F.col("dst").alias("call"), "seq")
    e = e.groupBy("src", "call").agg(F.min("seq").alias("eseq"))
    n = g.nodes.select(F.col("id").alias("src"), "line", "col", "seq")
    by = ["line", "col", "seq", "src"] if arg_order == "definition" else ["eseq", "src"]
    e = e.join(n, "src").withColumn("ordinal", F.row_number().over(Window.partitionBy("call").orderBy(*by)) - 1)
    return e.select("call", "ordinal", F.col("src").alias("arg"))


def argument_flow(g: Graph, calls: DataFrame, arg_order: str = "definition") -> DataFrame:
    """data_flows_to from each call's arguments to the resolved function's parameters, by ordinal.

    ``calls``: (src, dst) of the calls edges. Only edges from before this pass are read."""
    p = parameters(g)
    p = p.withColumn("ordinal", F.row_number().over(Window.partitionBy("function_id").orderBy("position", "param")) - 1)
    c = calls.select(F.col("src").alias("call"), F.col("dst").alias("function_id")).distinct()
    pairs = c.join(_arguments(g, arg_order), "call").join(p, ["function_id", "ordinal"])
    return pairs.select(*_edge("data_flows_to", F.col("arg"), F.col("param")), F.lit(True).alias("interprocedural")).distinct()


def return_flow(g: Graph, calls: DataFrame, summary: DataFrame) -> DataFrame:
    """data_flows_to from what a function returns to its calls, where a parameter reaches a return."""
    returning = summary.where("reached_kind = 'return'").select(F.col("function_id").alias("fn")).distinct()
    r = g.nodes.where("kind = 'return'").select(F.col("id").alias("ret"), F.col("scope").alias("fn")).join(returning, "fn", "left_semi")
    e = g.edges_raw.where("kind = 'data_flows_to'").select("src", F.col("dst").alias("ret")).distinct()
    c = calls.select(F.col("src").alias("call"), F.col("dst").alias("fn")).distinct()
    pairs = r.join(e, "ret").join(c, "fn")
    return pairs.select(*_edge("data_flows_to", F.col("src"), F.col("call")), F.lit(True).alias("interprocedural")).distinct()
