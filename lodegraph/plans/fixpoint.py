"""Scratch tables and semi-naive fixpoints.

A round's new rows are written to the shared folder and read back, so a plan never holds more than one
round and a lost executor costs one round at most."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own if Spark runs in
    this one process, else an error, as executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def write_out(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new table and read back, and the table's path."""
    path = f"{scratch_root(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    """As ``write_out``, with the number of rows, counted as they are written."""
    seen = Observation()
    out, path = write_out(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, path, seen.get["n"]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


#: Tables of single rounds that are read side by side; more are joined into one.
ROUNDS_APART = 16


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, max_rounds: int | None = None) -> DataFrame:
    """All rows that ``seed`` gives under repeated ``step``; rows with equal ``keys`` (all columns by
    default) count as one, and the one of the earliest round stays.

    A round joins the newest rows, drops what is known and writes the rest, whose number the writing
    counts. Tables of rounds are joined into one every so often, so long chains read few files."""
    spark, keys = seed.sparkSession, keys or seed.columns
    delta, path, n = write_counted(seed.dropDuplicates(keys), "seed")
    paths, rounds = [path], 0
    while (max_rounds is None or rounds < max_rounds) and n:
        known = spark.read.schema(seed.schema).parquet(*paths)
        if len(paths) > ROUNDS_APART:
            known, one = write_out(known, "known")
            delta, path, _ = write_counted(delta, "delta")  # the newest rows stay a table of their own
            remove(spark, *paths)
            paths, fresh = [one], path
        else:
            fresh = None
        k = known.select(*(F.col(c).alias(f"_{c}") for c in keys))
        new = step(delta).select(*seed.columns).dropDuplicates(keys)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        delta, path, n = write_counted(new.join(k, same, "left_anti"), "delta")
        if fresh:
            remove(spark, fresh)
        paths.append(path)
        rounds += 1
    return spark.read.schema(seed.schema).parquet(*paths)
