"""Comparing graphs, and annotating by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_path
from ..graph import Graph, attr

COMPARED = ("function", "class", "call")


def keys(g: Graph, prefix: str | None = None, kinds: tuple[str, ...] = COMPARED) -> DataFrame:
    """Distinct ``(kind, name, file, line)`` of located nodes, files normalised."""
    n = g.nodes.where(F.col("kind").isin(*kinds))
    return n.select("kind", "name", normalised_path(F.col("file"), prefix).alias("file"), "line").distinct()


def diff(before: Graph, after: Graph, prefix_before: str | None = None, prefix_after: str | None = None) -> dict[str, DataFrame]:
    """``added`` and ``removed`` node keys, ``new_files``, ``removed_files``, and ``changed_files`` with
    the node counts of files that both have and that differ."""
    a, b = keys(before, prefix_before), keys(after, prefix_after)
    count = lambda g, p, c: g.nodes.where("file is not null").groupBy(normalised_path(F.col("file"), p).alias("file")).agg(F.count("*").alias(c))
    n, m = count(before, prefix_before, "before"), count(after, prefix_after, "after")
    return {
        "added": b.subtract(a),
        "removed": a.subtract(b),
        "new_files": m.select("file").subtract(n.select("file")),
        "removed_files": n.select("file").subtract(m.select("file")),
        "changed_files": n.join(m, "file").where("before <> after"),
    }


def rule_test(kind: str | None = None, name: str | None = None, attrs: dict[str, str] | None = None) -> Column:
    """A rule's predicate over nodes; a kind that there is none of matches nothing."""
    test = F.lit(True)
    if kind is not None:
        test = test & (F.col("kind") == kind.lower())
    if name is not None:
        test = test & F.col("name").rlike(name)
    for k, v in (attrs or {}).items():
        test = test & (attr(k) == (str(v).lower() if isinstance(v, bool) else str(v)))
    return F.coalesce(test, F.lit(False))


def annotate(g: Graph, rules: list[dict]) -> tuple[Graph, DataFrame]:
    """The graph with every rule's values on the nodes it matches (later rules win), and the number of
    nodes for each rule.

    A rule: ``{"match": {"kind", "name", "attr"}, "set": {key: value}}``; all rules in one scan."""
    import json

    marks = []
    for n, rule in enumerate(rules):
        m = rule.get("match") or {}
        test = rule_test(m.get("kind"), m.get("name"), m.get("attr"))
        values = [F.struct(F.lit(n).alias("rule"), F.lit(k).alias("key"), F.lit(json.dumps(v)).alias("value")) for k, v in (rule.get("set") or {}).items()]
        marks.append(F.when(test, F.array(*values) if values else F.array(F.struct(F.lit(n).alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))))
    if not marks:
        return g, g.nodes.select(F.lit(0).alias("rule"), F.lit(0).cast("long").alias("n")).limit(0)
    rows = g.nodes.select("id", F.explode(F.flatten(F.array_compact(F.array(*marks)))).alias("m")).select("id", "m.*")
    counts = rows.select("id", "rule").distinct().groupBy("rule").agg(F.count("*").alias("n"))
    return g.annotate_nodes(rows.where("key is not null").select("id", "key", "value", F.col("rule").cast("long").alias("seq"))), counts
