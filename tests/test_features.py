"""Selection of features on tables made by hand."""

from tidemark.operators.features import highly_correlated


def test_highly_correlated_drops_the_smaller_variance_then_the_second(spark):
    rows = [(float(i), 2.0 * i, float(-i), float(i * 7 % 5), 1.0) for i in range(20)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert highly_correlated(table, ["a", "b", "c", "d", "e"]) == ["a", "c"]
    assert highly_correlated(table, ["a", "c"]) == ["c"]
    assert highly_correlated(table.limit(0), ["a", "b"]) == []
