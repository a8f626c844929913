"""Tables that cut lineage in iterative operators, and broadcasts of counted size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Greatest number of rows that are broadcast, of a few hundred bytes each; more are shuffled.
BROADCAST_ROWS = 200_000
#: Whether Spark deletes the shuffle files of a statement when it ends: a settled table is read from its own files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one where a local session has none, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_nearfield_core_folder", None) or tempfile.mkdtemp(prefix="nearfield-")
        spark._nearfield_core_folder = folder
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def swept(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_folder(spark)
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getParent().getName() == root.rsplit("/", 1)[-1]:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` settled and counted: a broadcast if it has few rows, else as it is, for a shuffle."""
    table = settle(df, name)
    return F.broadcast(table) if table.count() <= most else table
