"""Session plumbing: sessions, shipping the package to executors, and lineage cuts in the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, bool] = {}


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("threatloom")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # without call sites for every Column, plans with thousands of them are built a quarter faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application, and bound Arrow batches.

    Rows can be long texts, so a batch holds 500 rows rather than the default 10,000; Spark itself ends it at 64 MB
    (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    sc = spark.sparkContext
    if not _SHIPPED.get(sc.applicationId):
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp()) / "threatloom_pkg.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(str(path))
        _SHIPPED[sc.applicationId] = True
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def give_back() -> None:
    """In a Python worker that is reused: return freed memory to the system before the next task."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where none is set, a folder of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="threatloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    return stage_parts([df], label)


def stage_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Stage frames of one schema as one table, one after the other: the shuffle files of one go before the next is made."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/threatloom-stages/{label}-{uuid.uuid4().hex[:12]}"
        df.write.mode("append").option("compression", "zstd").parquet(path)
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files nobody refers to any more
    out = spark.read.schema(schema).parquet(path)
    out._threatloom_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_threatloom_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
