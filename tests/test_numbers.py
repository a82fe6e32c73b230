"""Numbers as text against Python's formatting, which rounds the double's own value."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evistra.functions.numbers import fixed

TIES = [0.7925, 0.0005, 2.675, 0.5, 1.5, 2.5, 0.125, 0.375, 0.0625, 1.005, 1e-9, 0.9999999, 0.99995, 5e-324, 0.0, -0.0, -2.675, -0.0004, 123456.785, 2.0**52 + 0.5, 4503599627370495.5, 0.00005, 0.00004999999]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 4])
def test_fixed_is_the_binary_values_rounding(spark, digits):
    pick = random.Random(digits)
    values = TIES + [pick.randrange(20000) / 2000 for _ in range(300)] + [pick.random() * 10 ** pick.randrange(-6, 7) for _ in range(300)] + [pick.randrange(1 << 12) / (1 << 11) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), digits).alias("t")).collect()
    assert [(r.v, r.t) for r in rows] == [(v, f"{v:.{digits}f}") for v in values]


def test_fixed_of_odd_values(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(fixed(F.col("v"), 2).alias("t")).collect()
    assert [r.t for r in rows] == [None, "nan", "inf", "-inf"]
