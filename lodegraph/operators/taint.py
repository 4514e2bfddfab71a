"""Label propagation from sources to sinks along data flow, with sanitizers and fields.

Labels spread by kind: a state is a label's name and field at a node, whatever the origins, so what is
closed over grows with label kinds times nodes and not with sources. A field narrows on the first edge
that names one and later edges of other fields stop it. Each state also says whether some way to it left
no sanitizer. Origins are found from the states of sinks back, over the states' own edges only; what each
single origin reaches (``Result.reach``) is closed over when asked for. No result depends on an order."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import fixpoint, remove, write_counted, write_out
from .flow import summaries


@dataclass(frozen=True)
class Policy:
    """Column expressions over ``nodes``. ``source`` gives the label's name, or null.

    ``propagators``: (match, whether the call's result carries what flows in), first match first."""

    source: Column
    sink: Column
    sanitizer: Column = field(default_factory=lambda: F.lit(False))
    propagators: tuple[tuple[Column, bool], ...] = ()
    implicit_params: bool = False


def seeds(g: Graph, policy: Policy) -> DataFrame:
    """Rows ``(origin, label)``: the sources, and if asked each other parameter under its own name."""
    label = policy.source
    if policy.implicit_params:
        label = F.coalesce(label, F.when(F.col("kind") == "parameter", F.concat(F.lit("param:"), "name")))
    return g.nodes.select(F.col("id").alias("origin"), label.alias("label")).where("label is not null")


def flow_edges(g: Graph, policy: Policy, summary: DataFrame | None = None) -> DataFrame:
    """Rows ``(src, dst, f)``: data flow, and from calls to the variables they define where the callee's
    summary (or, for calls without a callee, the first propagator that matches) lets data through."""
    e = g.edges_of("data_flows_to").select("src", "dst", F.col("field_name").alias("f"))
    defined = g.edges_raw.where("kind = 'defined_by'").select(F.col("dst").alias("call"), F.col("src").alias("dst")).distinct()
    called = g.edges_raw.where("kind = 'calls'").select(F.col("src").alias("call"), F.col("dst").alias("fn")).distinct()
    summary = summaries(g) if summary is None else summary
    through = summary.where("reached_kind = 'return'").select(F.col("function_id").alias("fn")).distinct()
    if not policy.propagators and through.isEmpty():
        return e
    crossing = called.join(through, "fn", "left_semi").select("call").distinct()
    if policy.propagators:
        carries = F.lit(False)
        for match, to_return in reversed(policy.propagators):
            carries = F.when(match, F.lit(to_return)).otherwise(carries)
        free = g.nodes.where((F.col("kind") == "call") & carries).select(F.col("id").alias("call")).join(called, "call", "left_anti")
        crossing = crossing.unionByName(free)
    more = defined.join(crossing, "call", "left_semi").select(F.col("call").alias("src"), "dst", F.lit(None).cast("string").alias("f"))
    return e.unionByName(more).distinct()


def _narrow(have: str, edge: str) -> tuple[Column, Column]:
    """(whether a label passes an edge, its field after it)."""
    h, f = F.col(have), F.col(edge)
    return f.isNull() | h.isNull() | (h == f), F.coalesce(h, f)


def reached(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows ``(origin, label, field, node, depth, parent, parent_field)`` reached over at least one edge.

    The parent is the least of those that reach the row in the fewest hops, so parents form one
    shortest path to every row."""
    cols = ["origin", "label", "field", "node", "depth", "parent", "parent_field"]

    def hop(d: DataFrame) -> DataFrame:
        on = d.join(edges, d.node == edges.src)
        ok, after = _narrow("field", "f")
        new = on.where(ok).select("origin", "label", after.alias("_field"), F.col("dst").alias("_node"), (F.col("depth") + 1).alias("_depth"), F.struct(F.col("node").alias("parent"), F.col("field").alias("parent_field")).alias("p"))
        new = new.groupBy("origin", "label", "_field", "_node", "_depth").agg(F.min("p").alias("p"))
        return new.select("origin", "label", F.col("_field").alias("field"), F.col("_node").alias("node"), F.col("_depth").alias("depth"), "p.parent", "p.parent_field").select(*cols)

    start = seed.select("origin", "label", F.lit(None).cast("string").alias("field"), F.col("origin").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parent_field"))
    return fixpoint(hop(start), hop, ["origin", "label", "field", "node"])


#: Stands for no field in join keys.
NO_FIELD = "\x00"


def kinds_reached(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows ``(label, f0, node, clean)`` reached over at least one edge; ``f0`` is the field, ``clean``
    that the way there left no sanitizer. A state that both kinds of way reach has a row of each.

    ``edges``: ``(src, dst, f, cut)``, ``cut`` for those that leave a sanitizer."""

    def hop(d: DataFrame) -> DataFrame:
        on = d.join(edges, d.node == edges.src).where((F.col("f") == F.col("f0")) | F.col("f").isNull() | (F.col("f0") == NO_FIELD))
        return on.select("label", F.when(F.col("f0") == NO_FIELD, F.coalesce("f", "f0")).otherwise(F.col("f0")).alias("f0"), F.col("dst").alias("node"), (F.col("clean") & ~F.col("cut")).alias("clean"))

    start = seed.select("label", F.lit(NO_FIELD).alias("f0"), F.col("origin").alias("node"), F.lit(True).alias("clean")).distinct()
    return fixpoint(hop(start), hop)


def state_edges(edges: DataFrame, seed: DataFrame, states: DataFrame) -> DataFrame:
    """Rows ``(label, f0, node, to_f0, to, cut)``: the edges between states, those of the sources included."""
    all_states = states.select("label", "f0", "node").unionByName(seed.select("label", F.lit(NO_FIELD).alias("f0"), F.col("origin").alias("node"))).distinct()
    on = all_states.join(edges, all_states.node == edges.src).where((F.col("f") == F.col("f0")) | F.col("f").isNull() | (F.col("f0") == NO_FIELD))
    return on.select("label", "f0", "node", F.when(F.col("f0") == NO_FIELD, F.coalesce("f", "f0")).otherwise(F.col("f0")).alias("to_f0"), F.col("dst").alias("to"), "cut").distinct()


def backward(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows ``(sink, label, s0, node, f0, depth, next, next_f0)``: the states from which a sink's state
    ``(sink, label, s0)`` of ``ends`` is reached, the fewest hops, and the least state one hop nearer."""

    def hop(d: DataFrame) -> DataFrame:
        back = steps.select("label", F.col("f0").alias("from_f0"), F.col("node").alias("from"), F.col("to_f0").alias("f0"), F.col("to").alias("node"))
        on = d.join(back, ["label", "f0", "node"])
        best = on.groupBy("sink", "label", "s0", F.col("from").alias("_node"), F.col("from_f0").alias("_f0")).agg(F.min("depth").alias("_depth"), F.min(F.struct(F.col("node").alias("next"), F.col("f0").alias("next_f0"))).alias("n"))
        return best.select("sink", "label", "s0", F.col("_node").alias("node"), F.col("_f0").alias("f0"), (F.col("_depth") + 1).alias("depth"), "n.next", "n.next_f0")

    start = ends.select("sink", "label", "s0", F.col("sink").alias("node"), F.col("s0").alias("f0"), F.lit(0).alias("depth"))
    return fixpoint(hop(start), hop, ["sink", "label", "s0", "node", "f0"])


def common_sanitizers(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows ``(label, f0, node, sanitizer)``: sanitizers that every way from a start to the state leaves.

    ``steps``: edges between states with all that lead to the states in question; ``starts``: ``(label,
    f0, node)``, which hold none. The greatest fixpoint of intersections, from above: a state that has
    not been met counts as all sanitizers. A sanitizer is common if as many of a state's ways in carry
    it as there are such ways; those are counts, so states with many ways in are summed in parts."""
    key = lambda *c: F.sha2(F.concat_ws("\x01", *c), 256)
    clean = starts.select(key("label", "f0", "node").alias("k_to")).distinct()
    ways = steps.select(key("label", "f0", "node").alias("k_from"), key("label", "to_f0", "to").alias("k_to"), F.col("node").alias("left"), "cut").distinct().join(clean, "k_to", "left_anti")
    ways, _ = write_out(ways, "ways")
    names = steps.select("label", F.col("to_f0").alias("f0"), F.col("to").alias("node"), key("label", "to_f0", "to").alias("k")).distinct()
    met, met_path = write_out(clean.withColumnRenamed("k_to", "k"), "met")
    held, held_path = write_out(met.select("k", F.lit("").alias("s")).limit(0), "held")
    seen = None
    while True:  # ends: what is met only grows, and once it is full what is held only shrinks
        live = ways.join(met, ways.k_from == met.k, "left_semi")
        n = live.groupBy("k_to").agg(F.count("*").alias("n"))
        carried = live.join(held, live.k_from == held.k).select("k_from", "k_to", "left", "s").unionByName(live.where("cut").select("k_from", "k_to", "left", F.col("left").alias("s"))).distinct()
        kept = carried.groupBy("k_to", "s").agg(F.count("*").alias("m")).join(n, "k_to").where("m = n").select(F.col("k_to").alias("k"), "s")
        after, after_path = write_out(kept, "held")
        met, path, n_met = write_counted(n.select(F.col("k_to").alias("k")).unionByName(clean.select(F.col("k_to").alias("k"))).distinct(), "met")
        remove(met.sparkSession, held_path, met_path)
        held, held_path, met_path = after, after_path, path
        state = (n_met, *held.agg(F.count("*"), F.sum(F.xxhash64("k", "s").cast("decimal(38,0)"))).first())
        if state == seen:
            return names.join(held, "k").select("label", "f0", "node", F.col("s").alias("sanitizer"))
        seen = state


@dataclass(frozen=True)
class Result:
    """Tables that are worked out when first asked for: ``hits`` (origin, label, field, sink, depth, bypass),
    ``states`` (label, f0, node, clean); by origin ``labels_at`` (node, label, field, origin) and
    ``edge_labels`` (src, dst, label, field, origin)."""

    graph: Graph
    policy: Policy
    seed: DataFrame
    edges: DataFrame

    @cached_property
    def states(self) -> DataFrame:
        return kinds_reached(self.edges, self.seed)

    @cached_property
    def steps(self) -> DataFrame:
        return write_out(state_edges(self.edges, self.seed, self.states), "steps")[0]

    @cached_property
    def ends(self) -> DataFrame:
        """Sinks' states ``(sink, label, s0, bypass)``."""
        sinks = self.graph.nodes.where(self.policy.sink).select(F.col("id").alias("node"))
        at = self.states.join(sinks, "node", "left_semi").groupBy(F.col("node").alias("sink"), "label", F.col("f0").alias("s0"))
        return write_out(at.agg(F.bool_or("clean").alias("bypass")), "ends")[0]

    @cached_property
    def back(self) -> DataFrame:
        return backward(self.steps, self.ends)

    @cached_property
    def hits(self) -> DataFrame:
        at = self.back.where(F.col("f0") == NO_FIELD).join(self.seed.withColumnRenamed("origin", "node").distinct(), ["node", "label"])
        hits = at.select(F.col("node").alias("origin"), "label", "s0", "sink", "depth").join(self.ends, ["sink", "label", "s0"])
        return write_out(hits.select("origin", "label", F.when(F.col("s0") != NO_FIELD, F.col("s0")).alias("field"), "sink", "depth", "bypass"), "hits")[0]

    @cached_property
    def reach(self) -> DataFrame:
        """What each origin reaches: ``(origin, label, field, node, depth, parent, parent_field)``."""
        return reached(self.edges, self.seed)

    @property
    def labels_at(self) -> DataFrame:
        own = self.seed.select(F.col("origin").alias("node"), "label", F.lit(None).cast("string").alias("field"), "origin")
        return self.reach.select("node", "label", "field", "origin").unionByName(own).distinct()

    @property
    def edge_labels(self) -> DataFrame:
        at = self.labels_at
        ok, after = _narrow("field", "f")
        return at.join(self.edges, at.node == self.edges.src).where(ok).select("src", "dst", "label", after.alias("field"), "origin").distinct()

    @property
    def paths(self) -> DataFrame:
        """One row per (origin, sink): label, whether every kind that arrives is sanitized, hops of the shortest way."""
        best = F.min(F.struct("depth", "label", "field")).alias("b")
        out = self.hits.groupBy("origin", "sink").agg(best, (~F.bool_or("bypass")).alias("is_sanitized"))
        return out.select("origin", "sink", F.col("b.label").alias("label"), F.col("b.field").alias("field"), F.col("b.depth").alias("depth"), "is_sanitized")

    def path_nodes(self) -> DataFrame:
        """Rows ``(origin, sink, path)``: one shortest path each, the one of the least states from the origin on."""
        now = self.paths.select("origin", "sink", "label", F.coalesce("field", F.lit(NO_FIELD)).alias("s0"), F.col("origin").alias("node"), F.lit(NO_FIELD).alias("f0"), F.col("depth").alias("left"), F.array("origin").alias("path"))
        done = None
        while True:
            now, _, _ = write_counted(now, "walk")
            here = now.where("left = 0").select("origin", "sink", "path")
            done = here if done is None else done.unionByName(here)
            now = now.where("left > 0")
            if now.isEmpty():
                return done
            now = now.join(self.back, ["sink", "label", "s0", "node", "f0"])
            now = now.select("origin", "sink", "label", "s0", F.col("next").alias("node"), F.col("next_f0").alias("f0"), (F.col("left") - 1).alias("left"), F.concat("path", F.array("next")).alias("path"))

    def common(self) -> DataFrame:
        """Rows ``(sink, label, field, sanitizer)`` for sanitized hits; only ways to those are looked at."""
        h = self.hits.where("not bypass").select("sink", "label", F.coalesce("field", F.lit(NO_FIELD)).alias("s0")).distinct()
        inside = self.back.join(h, ["sink", "label", "s0"], "left_semi").select("label", "f0", "node").distinct()
        ways = self.steps.join(inside, ["label", "f0", "node"], "left_semi")
        starts = self.seed.select("label", F.lit(NO_FIELD).alias("f0"), F.col("origin").alias("node"))
        goals = inside.select("label", F.col("f0").alias("to_f0"), F.col("node").alias("to")).unionByName(h.select("label", F.col("s0").alias("to_f0"), F.col("sink").alias("to"))).distinct()
        c = common_sanitizers(ways.join(goals, ["label", "to_f0", "to"], "left_semi"), starts)
        found = c.join(h, (c.node == h.sink) & (c.label == h.label) & (c.f0 == h.s0), "left_semi")
        return found.select(F.col("node").alias("sink"), "label", F.when(F.col("f0") != NO_FIELD, F.col("f0")).alias("field"), "sanitizer")

    def annotations(self) -> DataFrame:
        """Annotation rows ``(id, key, value)``: tainted, taint_labels, taint_role, taint_sanitized."""
        labelled = self.states.select(F.col("node").alias("id"), "label").unionByName(self.seed.select(F.col("origin").alias("id"), "label"))
        names, _ = write_out(labelled.groupBy("id").agg(F.to_json(F.array_sort(F.collect_set("label"))).alias("value")), "names")
        p, _ = write_out(self.paths, "paths")
        roles = p.select(F.col("origin").alias("id"), F.lit(1).alias("r")).unionByName(p.select(F.col("sink").alias("id"), F.lit(2).alias("r"))).unionByName(self.common().select(F.col("sanitizer").alias("id"), F.lit(3).alias("r")))
        roles = names.select("id", F.lit(0).alias("r")).unionByName(roles).groupBy("id").agg(F.max("r").alias("r"))
        role = F.element_at(F.array(*map(F.lit, ("intermediate", "source", "sink", "sanitizer"))), F.col("r") + 1)
        clean = p.groupBy(F.col("sink").alias("id")).agg(F.bool_and("is_sanitized").alias("s"))
        row = lambda df, key, value: df.select("id", F.lit(key).alias("key"), value.alias("value"))
        out = row(names, "tainted", F.lit("true")).unionByName(row(names, "taint_labels", F.col("value")))
        return out.unionByName(row(roles, "taint_role", F.concat(F.lit('"'), role, F.lit('"')))).unionByName(row(clean, "taint_sanitized", F.col("s").cast("string")))

    def apply_to(self, g: Graph) -> Graph:
        """``g`` with the annotations, and on edges along the paths ``tainted`` and ``taint_labels``."""
        steps = self.path_nodes().select(F.posexplode("path").alias("i", "src"), "path").where(F.col("i") < F.size("path") - 1)
        steps = steps.select("src", F.element_at("path", F.col("i") + 2).alias("dst")).distinct()
        labels = self.edge_labels.groupBy("src", "dst").agg(F.to_json(F.array_sort(F.collect_set("label"))).alias("value"))
        e = steps.join(labels, ["src", "dst"])
        rows = e.select("src", "dst", F.lit("taint_labels").alias("key"), "value").unionByName(e.select("src", "dst", F.lit("tainted").alias("key"), F.lit("true").alias("value")))
        return g.annotate_nodes(self.annotations()).annotate_edges(rows)


def run(g: Graph, policy: Policy, summary: DataFrame | None = None) -> Result:
    sanitizers = g.nodes.where(policy.sanitizer).select(F.col("id").alias("src"), F.lit(True).alias("cut"))
    flow = flow_edges(g, policy, summary).join(sanitizers.distinct(), "src", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    edges, _ = write_out(flow.select("src", "dst", "f", "cut"), "flow")
    seed, _ = write_out(seeds(g, policy), "seeds")
    return Result(g, policy, seed, edges)
