"""Call resolution: which function a call by name means.

Candidates come from equi-joins on names and are ranked; the first tier with a hit wins: method lookup
through the receiver's class and its bases, the whole name, its last segment, an imported name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import qualifier, short_name
from ..graph import Graph
from ..plans.fixpoint import fixpoint
from .filters import scope_ancestors


def by_name(calls: DataFrame, functions: DataFrame, name: str = "name", ancestors: DataFrame | None = None) -> DataFrame:
    """Rows ``(call, fn)``: of the functions with the call's ``name`` (a column), one with the call's
    qualifier as the name of its scope (or, given ``ancestors``, of any scope around it), else the first emitted.

    ``calls``: id, name, ``key`` to join on; ``functions``: id, name, scope_name, seq."""
    c = calls.select(F.col("id").alias("call"), F.col(name).alias("_key"), qualifier(F.col("name")).alias("q"))
    f = functions.select(F.col("id").alias("fn"), F.col("name").alias("_key"), "scope_name", "seq")
    both = c.join(f, "_key")
    fits = F.coalesce(F.col("scope_name") == F.col("q"), F.lit(False))
    if ancestors is not None:
        both = both.join(ancestors.select(F.col("id").alias("fn"), F.col("name").alias("q"), F.lit(True).alias("_inside")).distinct(), ["fn", "q"], "left")
        fits = fits | F.coalesce("_inside", F.lit(False))
    best = both.groupBy("call").agg(F.min_by("fn", F.struct((~fits).cast("int"), "seq", "fn")).alias("fn"))
    return best


def functions_of(g: Graph) -> DataFrame:
    """id, name, seq, scope and the scope's name and kind of every function."""
    s = g.nodes.select(F.col("id").alias("scope"), F.col("name").alias("scope_name"), F.col("kind").alias("scope_kind"))
    return g.nodes.where("kind = 'function'").select("id", "name", "scope", "seq").join(s, "scope", "left")


def linear_bases(g: Graph) -> DataFrame:
    """Rows ``(class, base, depth, ord)``: each class and, breadth first and from left to right, all
    bases by name. Of classes of one name the last emitted counts."""
    c = g.typed_nodes.where("kind = 'class'").groupBy("name").agg(F.max_by("bases", "seq").alias("bases"))
    e = c.select(F.col("name").alias("sub"), F.posexplode("bases").alias("pos", "base")).withColumn("base", short_name(F.regexp_replace("base", r"[\[<].*", "")))
    seed = c.select(F.col("name").alias("class"), F.col("name").alias("base"), F.lit(0).alias("depth"), F.lit("").alias("ord"))
    known = c.select(F.col("name").alias("_known"))
    step = lambda d: (
        d.join(e.select(F.col("sub").alias("base"), F.col("base").alias("next"), "pos"), "base")
        .join(known, F.col("next") == F.col("_known"), "left_semi")
        .groupBy("class", "next")
        .agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), F.concat("ord", F.lpad(F.col("pos").cast("string"), 4, "0")).alias("ord"))).alias("o"))
        .select("class", F.col("next").alias("base"), "o.depth", "o.ord")
    )
    return fixpoint(seed, step, ["class", "base"])


def by_method(g: Graph, calls: DataFrame) -> DataFrame:
    """Rows ``(call, fn)``: the method of the receiver's inferred type, or of the first base that has it.

    ``calls``: id, name, receiver_inferred_type. Of methods of one class and name the last counts."""
    m = functions_of(g).where("scope_kind = 'class'").groupBy(F.col("scope_name").alias("base"), F.col("name").alias("method")).agg(F.max_by("id", "seq").alias("fn"))
    c = calls.where("receiver_inferred_type is not null").select(F.col("id").alias("call"), short_name(F.col("name")).alias("method"), F.col("receiver_inferred_type").alias("class"))
    found = c.join(linear_bases(g), "class").join(m, ["base", "method"])
    return found.groupBy("call").agg(F.min_by("fn", F.struct("depth", "ord")).alias("fn"))


def import_map(g: Graph) -> DataFrame:
    """Rows ``(local, module, original)``: what imported names mean; of one local name the last import counts."""
    i = g.typed_nodes.where("kind = 'import' and is_from").select("module", F.explode("names").alias("original"), "aliases", "seq")
    i = i.withColumn("local", F.coalesce(F.try_element_at("aliases", F.col("original")), "original"))
    best = i.groupBy("local").agg(F.max_by(F.struct("module", "original"), "seq").alias("m"))
    return best.select("local", "m.module", "m.original")


def by_import(g: Graph, calls: DataFrame) -> DataFrame:
    """Rows ``(call, fn)``: the function that an imported name stands for, in a module whose name is
    the imported one's or either part of it."""
    f = functions_of(g).where("scope_kind = 'module'").select(F.col("id").alias("fn"), F.col("name").alias("original"), F.col("scope_name").alias("part"), "seq")
    c = calls.select(F.col("id").alias("call"), F.col("name").alias("local")).join(import_map(g), "local")
    last = short_name(F.col("module"))
    parts = F.array_distinct(F.array("module", last, F.expr("if(instr(module, '.') > 0, substring(module, 1, length(module) - length(substring_index(module, '.', -1)) - 1), module)")))
    found = c.withColumn("part", F.explode(parts)).join(f, ["original", "part"])
    return found.groupBy("call").agg(F.min_by("fn", F.struct("seq", "fn")).alias("fn"))


def first_tier(*tiers: DataFrame) -> DataFrame:
    """Rows ``(call, fn)`` of the first of the tables that has the call."""
    both = None
    for n, t in enumerate(tiers):
        t = t.select("call", "fn", F.lit(n).alias("tier"))
        both = t if both is None else both.unionByName(t)
    return both.groupBy("call").agg(F.min_by("fn", "tier").alias("fn"), F.min("tier").alias("tier"))


def resolve_calls(g: Graph, inside: bool = True) -> DataFrame:
    """calls edges ``(src, dst, kind, tier)``. Calls of each language see the functions of all."""
    calls = g.typed_nodes.where("kind = 'call'").select("id", "name", "receiver_inferred_type", short_name(F.col("name")).alias("short"))
    fns = functions_of(g)
    around = None
    if inside:
        # only a name with a qualifier and several functions asks for the scopes around them
        asked = calls.where(qualifier(F.col("name")).isNotNull()).select(F.explode(F.array("name", "short")).alias("name")).distinct()
        several = fns.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name").join(asked, "name", "left_semi")
        names = g.nodes.select(F.col("id").alias("ancestor"), "name")
        around = scope_ancestors(g.nodes, fns.join(several, "name", "left_semi")).join(names, "ancestor").select("id", "name")
    whole, short = by_name(calls, fns, "name", around), by_name(calls.where("short <> name"), fns, "short", around)
    out = first_tier(by_method(g, calls), whole, short, by_import(g, calls))
    return out.select(F.col("call").alias("src"), F.col("fn").alias("dst"), F.lit("calls").alias("kind"), "tier")
