"""Shared plumbing: scratch tables, Arrow batches in and out, the word rule."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (code points 0x20 and 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only after it has been counted and found to have at most this many rows.
BROADCAST_ROWS = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a folder of our own if
    Spark runs in this one process, else an error, as executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: later stages start from
    files that every executor can read, so a lost executor costs one stage at most."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df.scratch_path
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of work that nothing refers to any more: it does so when the
    driver's JVM collects garbage, which a driver with little to do may put off for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (a shuffled join).

    The count runs on the spot, so ``df`` should be a materialised table."""
    return F.broadcast(df) if df.count() <= limit else df


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on, and what one stage's
    arrays took would add to what the next one's take."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch that returns a batch, an iterator of them, or None."""

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
            del batch, out
        give_back()

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``chars`` bytes of text each; a longer text is one by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for hi, n in enumerate(size.tolist()):
        if hi > lo and held + n > chars:
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]
