"""Plans from YAML: what is refused before any row is read, and what is written."""

import pytest

from nearfield.operators import neighbours as nb
from nearfield.operators.points import points
from nearfield.sources import recipes


@pytest.mark.parametrize(
    "text,said",
    [
        ("steps: []", "source"),
        ("source: {name: os.system}", "not one of"),
        ("source: {name: points, args: {path: x}}", "no argument"),
        ("source: {name: points}\nsteps:\n  - {name: knn, args: {k: 3}}", "needs"),
        ("source: {name: points}\nsteps:\n  - {name: knn, args: {k: three, column: hd}}", "k is 'three'"),
        ("source: {name: points}\nsteps:\n  - {name: knn, args: {k: true, column: hd}}", "k is True"),
        ("source: {name: points}\nsink: {name: csv}", "not one of"),
        ("source: {name: table, args: {name: part, columns: p_partkey}}", "columns is"),
        ("- 1", "source"),
    ],
)
def test_what_is_refused(text, said):
    with pytest.raises(ValueError, match=said):
        recipes.parsed(text)


def test_rows_and_sink(spark, sf_dir, tmp_path):
    path = str(tmp_path / "out")
    recipes.run(spark, sf_dir, f"source: {{name: points}}\nsteps:\n  - {{name: knn, args: {{k: 3, column: ld}}}}\nsink: {{name: parquet, args: {{path: {path}}}}}")
    want = nb.knn(points(spark, sf_dir), 3, "ld")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, want.collect()))
    few = recipes.run(spark, sf_dir, "source: {name: table, args: {name: region, columns: [r_name]}}")
    assert few.columns == ["r_name"] and few.count() == 5
