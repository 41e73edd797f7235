"""Session helpers: reading the driver tables and cutting lineage in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Rows and bytes of a batch between Spark and Python, where the session does not say: rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the session's executors, once per application, and keep batches of texts small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's readers touch the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` is used; only where it is unset (tests on one machine) a
    folder of this process takes its place.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return _local_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at durable files.

    A lost executor costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    ship(spark)  # frames need not come from ``table``
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    # a compressor without a native context per page and column: those pile up in long-lived executors
    df.write.option("compression", "snappy").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


_released = (0.0, 0.0)  # when this process last did, and how long it took


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, and give what the driver has freed back to the system.

    Spark deletes those files once nothing in the driver refers to them. A full collection of a large driver takes a
    while, so one in twenty seconds at most goes into this.
    """
    global _released
    began = time.monotonic()
    if began - _released[0] < 20 * _released[1]:
        return
    gc.collect()
    give_back()
    _collect_driver(spark)
    _released = (time.monotonic(), time.monotonic() - began)


#: Least and greatest percentage of the driver's heap that a full collection leaves free here.
FREE = {"MinHeapFreeRatio": "10", "MaxHeapFreeRatio": "30"}


def _collect_driver(spark: SparkSession) -> None:
    """A full collection of the driver's JVM, after which heap and native memory that it does not use are the system's.

    By itself the JVM keeps a heap of three times what is in use, and what its compiler and its many short-lived
    threads have freed. Both are asked for by its management interface; a JVM without that just collects.
    """
    jvm = spark.sparkContext._jvm
    management = jvm.java.lang.management.ManagementFactory
    try:
        options = management.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        before = {name: options.getVMOption(name).getValue() for name in FREE}
    except Py4JJavaError:
        jvm.System.gc()
        return
    try:
        for name in FREE:
            options.setVMOption(name, FREE[name])
        jvm.System.gc()
    finally:
        for name in reversed(FREE):
            options.setVMOption(name, before[name])
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # neither values nor types for the command
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # only newer JVMs on Linux know this command
        invoke.invoke(management.getPlatformMBeanServer(), arguments)


def give_back() -> None:
    """Return to the system what this process has freed: Python workers live on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidied(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``; at a task's end, when all that it held is free, its worker gives that back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def drop_written(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lattica/" in parent:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_remembered: dict[tuple, DataFrame] = {}


def remembered(spark: SparkSession, key: tuple, sf_dir: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the tables, written once per session for a key and the tables' files as they are now."""
    files = []
    for path in (f"{sf_dir}/{name}.parquet" for name in sources):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(place)]
    whole = (spark.sparkContext.applicationId, key, tuple(sorted(files)))
    if whole not in _remembered:
        _remembered[whole] = written(build(), str(key[0]))
    return _remembered[whole]
