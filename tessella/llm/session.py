"""What the operators need of the session: a folder all executors share, tables written there, Arrow batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Only on one machine, as in tests, where the session names no folder of its own.
LOCAL_SHARED_DIR = "/tmp/checkpoints/tessella"
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, seen by the driver and every executor. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(LOCAL_SHARED_DIR)
        found = LOCAL_SHARED_DIR
    elif not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/tessella-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts don't pile up in one Python worker.

    Results are lazy, so this stays set in the session; smaller limits of its own are kept.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def trim() -> None:
    """Gives memory that this process no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def trim_driver(spark: SparkSession) -> None:
    """As trim(), for what the driver's JVM has freed outside its heap: compiling the code of hundreds of small plans leaves
    hundreds of MB there. By the JVM's own management command; a JVM without it (before 17.0.9, or not on Linux) keeps them."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    classes, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        classes[i] = jvm.java.lang.Class.forName(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JJavaError):
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", classes).invoke(server, values)


def let_go(spark: SparkSession) -> None:
    """Frees shuffles, broadcasts and checkpoints that nothing refers to any more, on the disks of all machines too.

    Spark notices what is dead when the driver's heap is collected. A job of dozens of small rounds hardly fills the
    heap, and what its rounds leave would pile up; so they call this when they end.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()
    trim()
    trim_driver(spark)


def released(run):
    """``run`` (batches to batches), trimming memory when its task ends: workers live on, and share an executor."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
