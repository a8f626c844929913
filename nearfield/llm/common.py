"""What the operators of this subpackage share: shared-folder tables, column checks, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The upper and lower case ASCII letters, for ``translate``: other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words, in the sense of every word contract here.
BLANK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that driver and executors share.

    Where it is unset a local session gets a new folder of its own; on a cluster that is an error, as executors would
    write what others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_nearfield_folder", None) or tempfile.mkdtemp(prefix="nearfield-")
        spark._nearfield_folder = folder
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    settled(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> list[str]:
    """The paths of the tables that this session has settled and not swept, in order."""
    if not hasattr(spark, "_nearfield_tables"):
        spark._nearfield_tables = []
    return spark._nearfield_tables


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Deletes settled tables that nothing reads any more; tables of other sessions are never touched."""
    held = settled(spark)
    for p in [p for p in paths if p in held]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        held.remove(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; its path may be in a store that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return table(spark, sf_dir, "documents")


def ascii_lower(col: Column | str) -> Column:
    """Only A-Z become lower case."""
    return F.translate(col, UPPER, LOWER)


def small_batches(spark: SparkSession, size: int = 1 << 21) -> None:
    """Bounds the bytes of an Arrow batch of long texts to 2 MB, unless the session has a bound of its own."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 26)
    if spark.conf.get(key, default).rstrip("b") == default:
        spark.conf.set(key, str(size))


#: Greatest number of keys that are broadcast, under 100 bytes each; beyond it both sides of the join are shuffled.
BROADCAST_KEYS = 1_000_000


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A broadcast of a settled table of keys if it was counted to be small; else as it is, for a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys
