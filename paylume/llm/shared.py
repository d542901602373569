"""The shared folder for written intermediate tables, which survive the loss of executors."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, as in tests on one machine, a local folder; an error
    on a cluster, whose machines would not see one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from a table in the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", codec).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    return spark.read.schema(schema).parquet(path)


def trim() -> None:
    """Gives back what the driver's Python has freed. Arrow and the C library keep it otherwise, beside the driver's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def managed(spark: SparkSession, bean: str, operation: str, *args: str):
    """Result of an operation of one of the JVM's own management beans."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    values, kinds, given = gateway.new_array(jvm.Object, len(args)), gateway.new_array(jvm.String, len(args)), gateway.new_array(jvm.Object, 4)
    for i, x in enumerate(args):
        values[i], kinds[i] = x, "java.lang.String"
    for i, x in enumerate((jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, values, kinds)):
        given[i] = x
    # by the interface, as the class behind it is not open to calls
    call = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def trim_jvm(spark: SparkSession) -> bool:
    """Collects the garbage of the driver's JVM and gives back what it has freed: of the heap all but two fifths, for this
    collection only, and what the compiler and the codecs had outside of it, which the C library keeps for each thread. False
    where the JVM has no such options or refuses them (before JDK 17.0.9, or not on Linux): then it only collects."""
    system, option = spark.sparkContext._jvm.System, "MaxHeapFreeRatio"
    try:
        usual = managed(spark, "HotSpotDiagnostic", "getVMOption", option).get("value")
        least = managed(spark, "HotSpotDiagnostic", "getVMOption", "MinHeapFreeRatio").get("value")
        managed(spark, "HotSpotDiagnostic", "setVMOption", option, least)
        try:
            system.gc()
        finally:
            managed(spark, "HotSpotDiagnostic", "setVMOption", option, usual)
        managed(spark, "DiagnosticCommand", "systemTrimNativeHeap")
        return True
    except Py4JError:
        system.gc()
        return False


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced. The scheduler holds on to its
    last job, so that a job of one row comes first."""
    trim()
    spark.range(1).count()
    trim_jvm(spark)
