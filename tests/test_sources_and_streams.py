"""Array sources, result sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import arrays, sinks
from nearfield.streaming import epochs


def test_npz_and_npy(spark, tmp_path):
    x = np.arange(12.0).reshape(6, 2)
    np.savez(tmp_path / "a.npz", X=x, y=np.arange(6))
    np.save(tmp_path / "b.npy", x)
    got = arrays.load(spark, str(tmp_path / "a.npz")).orderBy("row_id").collect()
    assert [r["features"] for r in got] == x.tolist() and [r["label"] for r in got] == list(range(6))
    assert {r["label"] for r in arrays.load(spark, str(tmp_path / "b.npy")).collect()} == {0}
    np.savez(tmp_path / "c.npz", Z=x)
    with pytest.raises(Exception, match="no array X"):
        arrays.load(spark, str(tmp_path / "c.npz")).collect()
    with pytest.raises(ValueError):
        arrays.load(spark, "x.h5ad")


def test_stacked_embedding_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [[0.5, 1.0], [2.0, 3.0]]), (2, [[4.0, 5.0], [6.0, 7.0]])], "id long, layers array<array<double>>")
    rows = sinks.stacked(df, "layers", "m")
    sinks.write_embedding(rows, str(tmp_path / "e"))
    assert sorted(map(tuple, sinks.read_embedding(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, rows.collect()))


def test_appended_records(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "b int, a double")
    for _ in range(2):
        sinks.append_json(df, str(tmp_path / "j"))
        sinks.append_records(df, str(tmp_path / "r"), ["a", "b", "c"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["a", "b", "c"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(folder)
    epochs.write_means(epochs.epoch_means(epochs.read_events(spark, folder)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r["name"], r["start"]): (round(r["value"], 9), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.read.parquet(folder).groupBy(F.col("event_type").alias("name"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    want = {(r["name"], r["start"]): (round(r["value"], 9), r["n"]) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = max(s for _, s in want)
    assert all((last - s).days <= 3 for k in set(want) - set(got) for s in [k[1]])


def test_config_scan_and_toy_cloud(spark, tmp_path):
    from nearfield.sources import configs, toy

    (tmp_path / "a.yaml").write_text("x:\n  y: 1\n  z: [2, 3]\n")
    got = {(r["key"], r["value"]) for r in configs.scan(spark, str(tmp_path / "*.yaml")).collect()}
    assert got == {("x.y", "1"), ("x.z[0]", "2"), ("x.z[1]", "3")}
    cloud = toy.branches(spark, 90, 12).collect()
    assert len(cloud) == 90 and all(len(r["features"]) == 12 and len(r["latent"]) == 3 for r in cloud)
