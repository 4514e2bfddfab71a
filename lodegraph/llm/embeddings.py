"""Operator 1, embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample (iterative quantisation on the principal directions) gives
balanced 64-bit codes. Four tables index 16 bits each; a vector stands in a table under its own 16 bits
and under those one bit away, so two vectors meet in a table if those bits differ in at most two
places, which happens in some table for any pair of at most 11 differing bits and for most pairs of
more. Pairs that meet are compared by Hamming distance on whole codes in the one bucket that is
theirs (the first table, the smallest key), and what is left is reranked with the original vectors
by cosine in double precision. Only vectors of one label and one length are compared.

Equal vectors of a label are one node of the search, whatever their number, and are linked.

Defined cases: a null label, a null or empty vector, a zero vector or one with null or non-finite
components links with nothing; so does a row with a null id, which is its own component (null). A repeated row counts as another vector. Lengths other than
the sample's commonest get a random rotation. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import compare_buckets
from .common import arrow_map, materialize
from .components import connected_components

BITS, TABLES, WIDTH = 64, 4, 16


def itq(x: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) learned on unit vectors: principal directions times a rotation that brings
    the projections near the corners of a cube. Fewer directions than bits are used more than once,
    each time with another rotation."""
    rng, mean = np.random.default_rng(seed), x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    found = []
    while sum(p.shape[1] for p in found) < bits:
        axes_now = axes[: min(len(axes), bits)].T
        v = (x - mean) @ axes_now
        r = np.linalg.qr(rng.normal(size=(axes_now.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        found.append(axes_now @ r)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def random_projection(dim: int, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return np.zeros(dim), np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)[:, :bits]


def unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, rows: int = 20_000) -> tuple[int, tuple[np.ndarray, np.ndarray]] | None:
    """(length, model) from at most ``rows`` vectors, those with the smallest hash of their id."""
    sample = vectors.orderBy(F.xxhash64("id", "k1"), "id").limit(rows).select("embedding").toArrow()["embedding"].to_pylist()
    if not sample:
        return None
    sizes = np.array([len(e) for e in sample])
    dim = int(np.bincount(sizes).argmax())
    x = unit(pa.array([e for e in sample if len(e) == dim], pa.list_(pa.float64())))
    return dim, itq(x) if len(x) > 1 else random_projection(dim)


def codes(vectors: DataFrame, model: tuple[int, tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """Rows ``(id, space, code)``; ``space`` is a hash of label and length."""

    def run(batch: pa.RecordBatch):
        sizes = batch.column(1).value_lengths().to_numpy()
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            mean, proj = model[1] if model and model[0] == dim else random_projection(int(dim))
            bits = (unit(part.column(1)) - mean) @ proj >= 0
            code = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(code)], names=["id", "space", "code"])

    return arrow_map(vectors.select("id", "embedding", F.xxhash64("label", F.size("embedding")).alias("space")), run, "id long, space long, code long")


def table_rows(coded: DataFrame) -> DataFrame:
    """Rows ``(bucket, spot, id, space, code)``: each code in each table under its key and those one bit away."""
    near = np.concatenate([[0], 1 << np.arange(WIDTH)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, space, code = (batch.column(k).to_numpy() for k in range(3))
        sub = (code.view(np.uint64)[:, None] >> np.arange(0, BITS, WIDTH, dtype=np.uint64)).astype(np.int64) & 0xFFFF
        spot = ((np.arange(TABLES) << WIDTH)[None, :, None] | (sub[:, :, None] ^ near)).reshape(len(ids), -1)
        n = spot.shape[1]
        bucket = (np.repeat(space, n) << 18) ^ spot.ravel()
        cols = bucket, spot.ravel(), np.repeat(ids, n), np.repeat(space, n), np.repeat(code, n)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["bucket", "spot", "id", "space", "code"])

    return arrow_map(coded, run, "bucket long, spot long, id long, space long, code long")


def candidates(coded: DataFrame, radius: int = 20) -> DataFrame:
    """Each pair ``(a, b)`` that meets in a table and has codes at most ``radius`` bits apart, once."""

    def meet(cols, a, b):
        x = cols["code"][a] ^ cols["code"][b]
        fine = (np.bitwise_count(x.view(np.uint64)) <= radius) & (cols["space"][a] == cols["space"][b]) & (cols["spot"][a] == cols["spot"][b]) & (cols["id"][a] != cols["id"][b])
        a, b, x = a[fine], b[fine], x[fine]
        table, key = cols["spot"][a] >> WIDTH, cols["spot"][a] & 0xFFFF
        part = lambda v, t: (v >> (WIDTH * t)) & 0xFFFF
        own = np.ones(len(a), bool)
        for t in range(TABLES):
            own &= (t >= table) | (np.bitwise_count(part(x, t)) > 2)
        d, p, q = part(x, table), part(cols["code"][a], table), part(cols["code"][b], table)
        low = d & -d
        first = np.where(d == 0, p, np.where(d == low, np.minimum(p, q), np.minimum(p ^ low, p ^ d ^ low)))
        own &= first == key
        u, v = cols["id"][a[own]], cols["id"][b[own]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return compare_buckets(table_rows(coded), "bucket", "id", None, meet, "a long, b long")


def rerank(pairs: DataFrame, vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Pairs ``(a, b, n_a, n_b)`` of nodes of one label and length with cosine of at least ``least``."""

    def run(batch: pa.RecordBatch):
        sizes = batch.column("x").value_lengths().to_numpy()
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            cosine = np.einsum("ij,ij->i", unit(part.column("x")), unit(part.column("y")))
            yield part.select(["a", "b", "n_a", "n_b"]).filter(pa.array(cosine >= least))

    side = lambda c, v, n, l: vectors.select(F.col("id").alias(c), F.col("embedding").alias(v), F.col("n").alias(n), F.col("label").alias(l))  # noqa: E731, E741
    both = pairs.join(side("a", "x", "n_a", "l_a"), "a").join(side("b", "y", "n_b", "l_b"), "b")
    both = both.where((F.col("l_a") == F.col("l_b")) & (F.size("x") == F.size("y"))).select("a", "b", "n_a", "n_b", "x", "y")
    return arrow_map(both, run, "a long, b long, n_a long, n_b long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, fit_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``."""
    t = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~odd & F.exists("embedding", lambda x: x != 0)
    keys = {k: F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(F.lit(k), "label", "embedding")) for k in ("k1", "k2")}
    rows = t.withColumns(keys).withColumn("k2", F.coalesce("k2", F.xxhash64("id")))
    slim = materialize(rows.select("id", "k1", "k2"), "keys")
    leads = slim.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes = materialize(rows.where("k1 is not null").join(leads, ["k1", "k2", "id"]).dropDuplicates(["k1", "k2"]), "nodes")
    coded = materialize(codes(nodes, fit(nodes, fit_rows)), "codes")
    linked = materialize(rerank(materialize(candidates(coded), "candidates"), nodes, least), "links")
    roots = connected_components(linked)
    more = linked.select(F.col("a").alias("lead"), F.col("n_b").alias("n")).unionByName(linked.select(F.col("b").alias("lead"), F.col("n_a").alias("n")))
    more = more.groupBy("lead").agg(F.sum("n").alias("links"))
    info = nodes.select("k1", "k2", F.col("id").alias("lead"), "n").join(more, "lead", "left").join(roots.withColumnRenamed("node", "lead"), "lead", "left")
    info = info.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "lead").alias("root"))
    out = slim.join(info, ["k1", "k2"], "left").select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
