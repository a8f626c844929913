"""Line numbers over many splits, and files side by side."""

import pytest
from pyspark.sql import functions as F

from nearfield.sources import lines


@pytest.fixture()
def many_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_splits(spark, tmp_path, many_splits):
    n = 60_000
    (tmp_path / "a.txt").write_text("".join(f"{k}{'x' * (k % 37)}\n" for k in range(n)))
    got = lines.numbered_lines(spark, str(tmp_path / "a.txt"))
    assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 20
    assert got.count() == n and got.where(F.regexp_extract("value", "^([0-9]+)", 1).cast("long") != F.col("line")).count() == 0


def test_files_side_by_side(spark, tmp_path, many_splits):
    n = 9_000
    (tmp_path / "m.txt").write_text("".join(f" {k} {k / 2}\t{-k}\n" for k in range(n)))
    (tmp_path / "t.tsv").write_text("".join(f"type {k % 7}\n" for k in range(n)))
    (tmp_path / "b.tsv").write_text("".join(f"{k}\n" for k in range(n - 1)))
    got = lines.matched_by_place(spark, str(tmp_path / "m.txt"), {"kind": str(tmp_path / "t.tsv")})
    bad = (F.get("features", F.lit(0)) != F.col("line")) | (F.size("features") != 3) | (F.col("kind") != F.concat(F.lit("type "), F.col("line") % 7))
    assert got.count() == n and got.where(bad).count() == 0
    with pytest.raises(ValueError, match="different length"):
        lines.matched_by_place(spark, str(tmp_path / "m.txt"), {"kind": str(tmp_path / "b.tsv")})


def test_folders_and_empty_files(spark, tmp_path):
    for name, text in (("a", "1\n2\n"), ("b", "3\n\n4"), ("c", "")):
        (tmp_path / name).write_text(text)
    assert [r["value"] for r in lines.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()] == ["1", "2", "3", "", "4"]
    assert lines.numbered_lines(spark, str(tmp_path / "c")).count() == 0
