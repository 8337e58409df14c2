"""Session helpers shared by every part of the engine.

Nothing here keeps state on the driver that grows with the data.  Lineage is cut
by writing Parquet into the folder the cluster shares (``spark.checkpoint.dir``),
so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to a Python worker: with documents of a few kB this
#: is a few MB, so a worker's memory does not depend on the size of a partition.
ARROW_ROWS = 512

#: Rows of a few numbers each (up to some 70 MB together, as a hashed relation) up to which a join's side is broadcast.
BROADCAST_ROWS = 500_000

#: Bytes in such a batch at most, for texts that are long.
ARROW_BYTES = 16 << 20

#: Where the package lies; of no effect on machines that have it elsewhere on their path.
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Written tables after which the driver collects its garbage.
_COLLECT_EVERY = 6

#: Share of the driver's heap in use from which its garbage is collected between two steps.
_HEAP_SHARE = 0.25

_SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only in local mode, where they are one process, is a private folder made where none is
    named; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marginalia-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the DataFrame that reads it.

    Unlike an in-memory cache the result outlives the executors, is compressed, and
    the reader sees only a file scan: column pruning and filters reach it.  Small partitions
    are put together up to the advisory size, not spread over all cores, so a small table
    has few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SPREAD, None)
    spark.conf.set(_SPREAD, "false")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SPREAD)
        else:
            spark.conf.set(_SPREAD, before)
    _written.append((spark, path))
    # shuffle files of finished steps go when the driver's garbage does, which else may take half an hour
    relieve(spark, always=len(_written) % _COLLECT_EVERY == 0)
    return spark.read.schema(df.schema).parquet(path)


def relieve(spark: SparkSession, always: bool = False) -> bool:
    """Collect the driver's garbage if that fills ``_HEAP_SHARE`` of its heap, or ``always``; returns whether it was.

    Plans and task states of finished steps are garbage, and a heap that grows for
    them is given back to the system by a full collection only.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    full = always or heap.totalMemory() - heap.freeMemory() > _HEAP_SHARE * heap.maxMemory()
    if full:
        spark.sparkContext._jvm.System.gc()
    return full


def swept(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the session ends, as tables that are written in between are."""
    _written.append((spark, path))


def checked_broadcast(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow``, whose rows are a few numbers each, marked for broadcast if it has few; else as it is, for a shuffled join.

    It is counted, so it should be a table that is written already.
    """
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers, and let workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give is not None:
        give(0)


def lean(rows):
    """A mapInArrow function whose worker gives freed memory back to the system when a task ends.

    Workers stay for the next task, and beside others that run; without this each keeps
    the most that any of its tasks took.
    """

    def run(batches):
        yield from rows(batches)
        trim()

    return run


def plain_names(df: DataFrame, *keep: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with every column but those to ``keep`` under a plain name of its own, and what they were called.

    Functions over Arrow batches take names apart at dots and backquotes.
    """
    named = {f"own_{i}": c for i, c in enumerate(df.columns) if c not in keep}
    back = {c: n for n, c in named.items()}
    return df.toDF(*[back.get(c, c) for c in df.columns]), named


def own_names(df: DataFrame, named: dict[str, str]) -> DataFrame:
    return df.toDF(*[named.get(c, c) for c in df.columns])


def parallelism(spark: SparkSession) -> int:
    """The number of partitions for an explicit deal by key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            if jvm is not None:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
