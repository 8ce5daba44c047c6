"""Joins whose heavy keys are spread give what plain joins give."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrivel.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_spread(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}", i % 2) for i in range(3_000)] + [(7, "hot", 0)] * 5
    big = spark.createDataFrame(rows, "id long, a string, b int").repartition(5)
    small = spark.createDataFrame([("hot", 0, "x"), ("hot", 1, "y"), *((f"k{i}", 0, f"v{i}") for i in range(0, 40, 2)), ("none", 0, "z")], "a string, b int, value string")
    counts = big.groupBy("a", "b").agg(F.count("*").alias("k"))
    got = common.spread_join(big, small, ["a", "b"], counts, how)
    assert got.columns == big.join(small, ["a", "b"], how).columns
    assert "_salt" in got._jdf.queryExecution().toString()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, big.join(small, ["a", "b"], how).collect()))
    light = common.spread_join(big.where("a <> 'hot'").limit(10), small, ["a", "b"], counts.where("k < 5"), how)
    assert "_salt" not in light._jdf.queryExecution().toString()


def test_an_empty_count(spark):
    big = spark.createDataFrame([], "a string")
    assert common.spread_join(big, big, ["a"], big.groupBy("a").agg(F.count("*").alias("k"))).count() == 0
