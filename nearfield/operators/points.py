"""The canonical table of points: id, a high-dimensional and a low-dimensional array, and a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, hd, ld (the first two coordinates) and label of the embeddings, in double precision."""
    wide = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("hd"), F.col("label").cast("int").alias("label"))
    return wide.withColumn("ld", F.slice("hd", 1, 2))


def lineage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on a lineage: customers between their region and nation, placed by balance and by mean order price."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.min("o_orderdate").alias("first_day"))
    nation = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    time = F.datediff("first_day", F.lit("1992-01-01")).cast("double")
    return cells.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("price") / 10000).alias("y"), F.col("r_name").alias("from"), F.col("n_name").alias("to"), time.alias("time"))
