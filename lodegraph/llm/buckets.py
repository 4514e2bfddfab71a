"""Comparing the rows of a bucket: sorted runs, bounded blocks for large buckets, vectorised pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, give_back, materialize

#: Rows of one block; a bucket of more is dealt out as pairs of chunks of about this size.
BLOCK_ROWS = 4096
#: Pairs that are looked at at once.
PAIRS_AT_ONCE = 2_000_000


def compare_buckets(rows: DataFrame, key: str, spread: str, lead: str | None, kernel: Callable, schema: str, block_rows: int = BLOCK_ROWS, *, sizes: DataFrame | None = None) -> DataFrame:
    """Run ``kernel`` over every pair of rows with the same ``key`` (never null).

    A bucket of more than ``block_rows`` rows is cut into chunks by a hash of ``spread``, and each pair
    of chunks is a block of its own, so no task holds more than two chunks and no pair is left out.
    ``lead`` names a boolean column: only pairs with a lead row are compared. ``kernel(columns, a, b)``
    gets the columns as numpy arrays and the pairs as positions, and returns a record batch or None.
    ``sizes`` has the same keys as ``rows``, as often, where those are cheaper to count there."""
    large = materialize((rows if sizes is None else sizes).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block_rows), "large")
    if large.isEmpty():
        dealt = rows.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)})
    else:
        n = F.ceil(F.coalesce("_rows", F.lit(1)) / F.lit(block_rows)).cast("int")
        own = F.pmod(F.xxhash64(spread), F.col("_n")).cast("int")
        at = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        dealt = rows.join(checked_broadcast(large), key, "left").withColumn("_n", n).withColumn("_own", own).withColumn("_other", at)
        dealt = dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}).drop("_rows", "_n", "_own", "_other")
    order = [key, "_i", "_j", *([F.desc(lead)] if lead else [])]
    return dealt.repartition(key, "_i", "_j").sortWithinPartitions(*order).mapInArrow(_runs(key, lead, kernel), schema)


def _runs(key: str, lead: str | None, kernel: Callable) -> Callable:
    def ends(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in (key, "_i", "_j"):
            x = t[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t[c].to_numpy(zero_copy_only=False) for c in t.column_names}
        starts = np.concatenate([[0], ends(t), [t.num_rows]])
        stop = np.repeat(starts[1:], np.diff(starts))
        for a, b in pairs(stop, cols[lead] if lead else None):
            if (keep := (cols["_i"][a] == cols["_j"][a]) | (cols["_side"][a] != cols["_side"][b])).any():
                out = kernel(cols, a[keep], b[keep])
                if out is not None and out.num_rows:
                    yield out

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = held[0].slice(0, 1), batch.slice(batch.num_rows - 1)
            if all(first[c] == last[c] for c in (key, "_i", "_j")):
                continue  # still inside one block
            t = pa.Table.from_batches(held)
            cut = ends(t)[-1]
            yield from work(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())
        held = []
        give_back()

    return run


def pairs(stop: np.ndarray, lead: np.ndarray | None = None, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all pairs with a < b < stop[a] (and lead[a]), some at a time."""
    rows = np.arange(len(stop))
    count = stop - rows - 1
    if lead is not None:
        count = np.where(lead, count, 0)
    rows = np.flatnonzero(count > 0)
    count = count[rows]
    total = np.cumsum(count)
    lo = 0
    while lo < len(rows):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + at_once, side="right")))
        n = count[lo:hi]
        a = np.repeat(rows[lo:hi], n)
        first = np.repeat(np.cumsum(n) - n, n)
        yield a, a + 1 + np.arange(len(a)) - first
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected component of the links (a, b): (smallest member, other member)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        new = new[new]
        if (new == lab).all() and (lab[u] == lab[v]).all():
            break
        lab = new
    other = lab != np.arange(len(nodes))
    return nodes[lab[other]], nodes[other]
