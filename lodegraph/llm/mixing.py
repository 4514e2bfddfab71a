"""Operator 4, mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; a source takes whole epochs of
all its documents first, and then documents in key order until the rest of its budget is filled. The
prefix sum over a source needs no task that holds the source: sizes are summed by key bin, the bins'
running sums find the one bin in which the budget ends, that bin is binned again, and only the documents
of the one fine bin are sorted. Bins are even steps of the key's logarithm, so whatever the weights a
coarse bin holds at most 0.6 % of a source of one weight (about 1,000 bins have rows), a fine one 0.0006 %.

Defined cases: a null source is a source of its own, last in order; a null, empty or blank text has
size 0 and is taken by no budget of 0 (its ``taken`` is 0); ties in the key go by id, then size; equal
rows are separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize

#: Bins by which the key's logarithm is cut once and again.
COARSE, FINE = 64, 65_536
#: The least weight; a missing one counts as that.
LEAST = 0.05


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of letters among the characters that are not white space
    (prose is nearly all letters; markup, tables and junk are not), times the share of distinct lines
    (boilerplate and stuttering texts repeat theirs). Texts without such characters weigh 0.05."""
    solid = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    lines = F.split(text, "\n")
    share = (letters / F.nullif(solid, F.lit(0))).cast("double") * (F.size(F.array_distinct(lines)) / F.size(lines)).cast("double")
    return F.greatest(F.lit(LEAST), F.coalesce(share, F.lit(LEAST))).cast("double")


def sampling_key(row_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from the row's id and the seed."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, budget: float | None = None) -> DataFrame:
    """``source, source_size`` with ``target``: shares of the total (or ``budget``) by weight, none
    above ``most`` times the source's size; what is cut off is shared by weight among the others.

    One row per source, so the ordered sums here are over the few sources, not the documents."""
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "n")
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("n", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("room", F.col("cap") / F.col("w"))
    total = F.sum("source_size").over(every).cast("double") if budget is None else F.lit(float(budget))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"total": total, "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_left": F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))})
    t = t.withColumn("full", F.col("cap") < F.col("w") * (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    t = t.withColumns({"cap_sum": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), "w_sum": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)})
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("total") - F.col("cap_sum")) / F.col("w_sum"))
    return t.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: str = "mix", **shares) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    Every document is taken ``floor(target / source_size)`` times; the rest of the budget goes to
    documents in key order, and the one on which it ends is taken if that brings the sum nearer."""
    size = word_count(F.col(text_col))
    weight = quality_weight(F.col(text_col)) if weight is None else F.greatest(F.lit(LEAST), F.coalesce(weight.cast("double"), F.lit(LEAST)))
    key = sampling_key(F.col(id_col), weight, seed)
    d = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "mix")
    d = d.withColumns({"coarse": F.floor(F.ln("key") * COARSE), "fine": F.floor(F.ln("key") * FINE)})
    bins = materialize(d.groupBy("source", F.col("coarse").alias("bin")).agg(F.sum("size").alias("words")), "bins")
    goal = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("before", F.lit(0).cast("long"))
    ends = checked_broadcast(materialize(_last_bin(bins, goal), "ends"))
    d = d.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source")).select("d.*", "source_size", "target", "epochs", "rest", F.col("last").alias("last_coarse"), "before")
    inner = d.where("coarse = last_coarse").groupBy("source", F.col("fine").alias("bin")).agg(F.sum("size").alias("words"))
    fine = checked_broadcast(materialize(_last_bin(materialize(inner, "bins"), ends), "ends"))
    fine = fine.select(F.col("source").alias("s"), F.col("last").alias("last_fine"), F.col("before").alias("before_fine"))
    d = d.join(fine, d.source.eqNullSafe(fine.s), "left")
    inside = F.col("rest") > 0
    edge = F.coalesce(F.col("fine") == F.col("last_fine"), F.lit(False))
    passed = F.col("last_coarse").isNull() | (F.col("coarse") < F.col("last_coarse")) | ((F.col("coarse") == F.col("last_coarse")) & (F.col("fine") < F.col("last_fine")))
    clear = d.where(~edge).withColumn("extra", inside & F.coalesce(passed, F.lit(False)))
    upto = F.col("before_fine") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = d.where(edge).withColumn("upto", upto)
    near = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))))
    edge = edge.withColumn("extra", inside & near).drop("upto")
    copies = (F.col("epochs") + F.col("extra").cast("long")).cast("long")
    return clear.unionByName(edge).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def _last_bin(bins: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` with ``last``, the bin of a source in which ``rest`` is reached (null: in none), and
    ``before``, the words up to that bin: those of ``goal`` and of the bins before."""
    g = goal.alias("g")
    run = F.col("g.before") + F.sum("words").over(Window.partitionBy("b.source").orderBy("bin"))
    upto = bins.alias("b").join(g, F.expr("b.source <=> g.source")).select("g.source", "source_size", "target", "epochs", "rest", F.col("g.before").alias("base"), "bin", run.alias("upto"))
    return upto.groupBy("source", "source_size", "target", "epochs", "rest").agg(
        F.min(F.when(F.col("upto") >= F.col("rest"), F.col("bin"))).alias("last"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("rest"), F.col("upto"))), F.max("base")).alias("before"),
    )
