"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that drops a query's shuffle files when it has ended: once its
#: rows are in the table nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of this machine
    only where it is unset and the session is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tabulint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it survives lost
    executors and is computed once however often it is read.  options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a saved() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def given_back() -> None:
    """Give back to the system what this process's allocator holds free, if it can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(spark: SparkSession) -> bool:
    """Give back to the system what the driver's processes keep of memory that nothing
    in them uses any more: the heap's garbage, and what their allocators hold free.
    Whether the virtual machine could; one without the command keeps the latter."""
    gc.collect()
    given_back()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    # by reflection, as the server's own class is not open to calls
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = array(jvm.Object, 4)
    try:
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call[2], call[3] = array(jvm.Object, 0), array(jvm.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return False
    return True
