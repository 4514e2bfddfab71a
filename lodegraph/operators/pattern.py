"""Chain patterns: steps that nodes match, direct hops between them, bounded gaps for wildcards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .filters import annotated
from .traverse import hops, reach

#: Hops that one or more wildcards in a row may stand for.
MAX_GAP = 20


@dataclass(frozen=True)
class Step:
    kind: str | None = None
    name: str | None = None
    annotation: str | None = None
    value: str | None = None
    wildcard: bool = False


@dataclass(frozen=True)
class Chain:
    steps: list[Step] = field(default_factory=list)
    edge_kind: str | None = None


def matching(g: Graph, step: Step) -> DataFrame:
    """Ids of nodes of the kind, with a name that the regular expression finds and the annotation."""
    out = g.nodes
    if step.kind:
        out = out.where(F.col("kind") == step.kind.lower())
    if step.name is not None:
        out = out.where(F.col("name").rlike(step.name))
    if step.annotation:
        out = out.join(annotated(g, step.annotation, step.value), "id", "left_semi")
    return out.select("id")


def match_chain(g: Graph, chain: Chain, limit: int = 0) -> DataFrame:
    """Rows ``(chain)``: arrays with the ids that match the concrete steps, one after another.

    Adjacent steps are joined over one edge. Over a gap a step is joined to what is reached in 1 to 20
    hops, other than the node before it; the closure runs from the gap's left ends only. Wildcards
    before the first and after the last concrete step do not count."""
    concrete = [i for i, s in enumerate(chain.steps) if not s.wildcard]
    spark = g.spark
    if not concrete:
        return spark.createDataFrame([], "chain array<string>")
    e = hops(g, [chain.edge_kind.lower()] if chain.edge_kind else None)
    found = matching(g, chain.steps[concrete[0]]).select(F.array("id").alias("chain"), F.col("id").alias("at"))
    for left, right in zip(concrete, concrete[1:]):
        if right - left == 1:
            pair = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
        else:
            pair = reach(e, found.select(F.col("at").alias("id")), MAX_GAP).where("origin <> node").select(F.col("origin").alias("at"), F.col("node").alias("to"))
        pair = pair.join(matching(g, chain.steps[right]).select(F.col("id").alias("to")), "to", "left_semi")
        found = found.join(pair, "at").select(F.concat("chain", F.array("to")).alias("chain"), F.col("to").alias("at"))
    out = found.select("chain")
    return out.orderBy("chain").limit(limit) if limit else out
