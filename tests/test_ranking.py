"""Range-split ranks and totals give what one window per group gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslens.operators.ranking import numbered, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, many ties, NULL keys, NULL and negative values."""
    rng = random.Random(7)
    keys = ["hot"] * 300 + [rng.choice("abcde") for _ in range(500)] + [None] * 100
    data = [
        (k, rng.randrange(20), i, None if i % 11 == 0 else rng.randrange(-50, 100))
        for i, k in enumerate(keys)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o int, id long, v long").repartition(6)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbered(skewed, rows, keys):
    order = [F.col("o").desc(), F.col("id")]
    expected = skewed.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    assert rows(numbered(skewed, keys, order, "n")) == rows(expected)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sum(skewed, rows, keys):
    order = [F.col("o"), F.col("id")]
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = skewed.withColumn("n", F.sum("v").over(window))
    assert rows(running_sum(skewed, keys, order, "v", "n")) == rows(expected)


def test_total_is_null_before_the_first_value(spark, rows):
    data = [("a", 1, None), ("a", 2, None), ("a", 3, 5), ("a", 4, None), ("b", 1, None), ("b", 2, 7)]
    df = spark.createDataFrame(data, "k string, o int, v long").repartition(5)
    found = rows(running_sum(df, ["k"], [F.col("o")], "v", "n"))
    assert [r[3] for r in found] == [None, None, 5, 5, None, 7]
