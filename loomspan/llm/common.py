"""Helpers shared by the training-data operators: the shared folder, Arrow column access, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where a session on one machine leaves it unset (tests) a local folder is made and set; on a cluster such a
    folder would be seen by one machine only, so there it has to be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            path = "file://" + tempfile.mkdtemp(prefix="loomspan-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path.rstrip("/")


#: Folders and tables made in this process, and not yet swept.
_made: list[str] = []


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder, until the next ``sweep``."""
    _made.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def fresh_table(spark: SparkSession, kind: str) -> str:
    """A new table name in the shared warehouse, until the next ``sweep``."""
    _made.append(f"loomspan_{kind}_{uuid.uuid4().hex}")
    return _made[-1]


def made() -> tuple[str, ...]:
    """Intermediate folders and tables that are not yet swept."""
    return tuple(_made)


def sweep(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete intermediate folders and tables other than ``keep``, once the results made from them are written."""
    for name in [x for x in _made if x not in keep]:
        _made.remove(name)
        if "/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what is sent to Python at once, in rows and bytes: a text may be large, and every task holds a batch.

    The setting belongs to the session, as plans are made when their result is asked for; smaller settings stay.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks, and what they keep counts as the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a call of glibc; other libraries need none
    if trim is not None:
        trim(0)


def only(module: str) -> None:
    """Empty the tables that modules of other operators hold in this worker (``_held``), which now serves ``module``."""
    for name, found in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name != module and (held := getattr(found, "_held", None)):
            held[:] = [None] * len(held)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow`` or ``applyInArrow``, after ``only`` and followed by ``give_back``: once a task or group."""
    module = run.__module__
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def stream(batches):
            only(module)
            yield from run(batches)
            give_back()

        return stream

    @functools.wraps(run)
    def whole(table):
        only(module)
        found = run(table)
        give_back()
        return found

    return whole


#: Garbage, in bytes, that a step leaves in the driver before it is collected, and what the driver held after that.
GARBAGE = 150_000_000
_live = [0]


def collect(spark: SparkSession) -> None:
    """A full collection of the driver's heap: it shrinks, and the executors drop broadcasts and shuffles of dead plans."""
    spark._jvm.System.gc()
    _live[0] = _used(spark)


def _used(spark: SparkSession) -> int:
    heap = spark._jvm.Runtime.getRuntime()
    return heap.totalMemory() - heap.freeMemory()


def rest(spark: SparkSession) -> None:
    """Shrink the heaps of the driver and the executors to what they still hold, between two stages of many.

    A heap only grows by itself, so each stage would add the garbage of all before it to its own Python workers' memory.
    """
    gc.collect()
    collect(spark)
    tasks = spark.sparkContext.defaultParallelism  # as many as run at once, so every executor gets some
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    if _used(df.sparkSession) > _live[0] + GARBAGE:
        collect(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that a broadcast may hold (16 MB); longer lists are joined by a shuffle instead.
BROADCAST_ROWS = 2_000_000


def checked(ids: DataFrame) -> DataFrame:
    """``ids``, written once, and marked for broadcast if few enough."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_listed(docs: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of ``docs`` that name their own component (doc_id, component_id), and all rows without doc_id.

    Of rows that repeat a doc_id one stays. Only ids are shuffled, and the texts of repeated doc_ids; texts otherwise
    move only where the list of dropped ids is too long for a broadcast.
    """
    every = components.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("own"), F.count("*").alias("n"))
    every = cut(every.where("n > 1 or not own"))
    dropped, again = checked(every.where("not own").select("doc_id")), checked(every.where("own").select("doc_id"))
    kept = docs.join(dropped, "doc_id", "left_anti")
    row = free_name(docs, "_row")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = kept.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one uint8 array, and n + 1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a minimum per node (combined before the
    shuffle) and an equi-join that adaptive execution may split, so a node with very many links is
    no bottleneck. Every round is cut by a checkpoint; only two numbers reach the driver.
    """
    edges = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
        )
        edges = cut(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
