"""What every operator needs of a session: tables, shared scratch space, code on the workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Arrow batches handed to Python workers stay this small, whatever the rows' width.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Used only where the session names no shared folder (tests, a single machine).
LOCAL_SCRATCH = "/tmp/checkpoints/tidewire"
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the driver and all executors share.

    That is the folder of spark.checkpoint.dir, else the one that the context has; only on a single
    machine may both be missing.
    """
    root, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not root and known.isDefined():
        root = known.get()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs(LOCAL_SCRATCH, exist_ok=True)
        root = f"file://{LOCAL_SCRATCH}"
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has put into shared scratch, once the results that read it are stored; the number of folders."""
    gone = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared scratch and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has: for few rows that much is made of, which would else be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound their Arrow batches (two settings of the session, which stay)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_tidewire_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidewire-")
    archive = os.path.join(folder, "tidewire_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
    sc.addPyFile(archive)
    sc._tidewire_shipped = True


@contextmanager
def carried(package: ModuleType) -> Iterator[None]:
    """What is handed to Spark in here brings this package's code along: the processes that plan and run streams do not get a session's files."""
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)
