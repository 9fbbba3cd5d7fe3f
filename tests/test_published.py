"""Tables of a run published as one version."""

import pytest
from pyspark.sql import functions as F

from foliograph.sources import tables


def test_versions(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.range(5)
    first = tables.publish_tables({"a": one, "b": one.limit(0).withColumn("x", F.lit("y"))}, path)
    assert {n: (d.count(), d.columns) for n, d in tables.read_published(spark, path).items()} == {"a": (5, ["id"]), "b": (0, ["id", "x"])}
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        tables.publish_tables({"a": spark.range(9), "b": broken}, path)
    assert {n: d.count() for n, d in tables.read_published(spark, path).items()} == {"a": 5, "b": 0}
    second = tables.publish_tables({"a": spark.range(7)}, path, format="orc")
    assert {n: d.count() for n, d in tables.read_published(spark, path).items()} == {"a": 7}
    assert tables.read_published(spark, path, first)["a"].count() == 5 and tables.published_versions(spark, path).select("version").distinct().count() == 2
    assert second != first
    with pytest.raises(ValueError):
        tables.read_published(spark, path, "none")
    with pytest.raises(ValueError):
        tables.publish_tables({}, path)
    with pytest.raises(Exception):
        tables.read_published(spark, str(tmp_path / "nothing"))
