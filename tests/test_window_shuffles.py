"""Overlapping windows are put together where their panes lie."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import windows as W


def _samples(spark, n):
    return spark.range(n).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("idx"), F.col("id").cast("double").alias("x"))


@pytest.mark.parametrize("window, hop", [(4, 2), (6, 4), (4, 6), (6, 1), (5, 5)])
def test_windows_cross_the_borders_of_chunks(spark, window, hop):
    n = 1500
    rows = W.window_arrays(_samples(spark, 3 * n), ["k"], "idx", ["x"], W.Windowing(window, hop), {"total": F.col("x")}).collect()
    got = {(r["k"], r["win"]): (r["x"], r["total"]) for r in rows}
    want = {}
    for k in range(3):
        for win, start in enumerate(range(0, n - window + 1, hop)):
            values = [3.0 * i + k for i in range(start, start + window)]
            want[k, win] = (values, sum(values))
    assert len(rows) == len(got) and got == want


def test_overlapping_windows_take_one_shuffle(spark):
    rows = W.window_arrays(_samples(spark, 300), ["k"], "idx", ["x"], W.Windowing(4, 2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
