"""Prefix scans over segments equal the plain operators, and no task holds a whole well."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boreflow.operators import clean as C
from boreflow.operators import segments as SG
from boreflow.operators import windows as W

D0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def gappy(spark):
    """Wells of 800, 30 and 1 days with long gaps, a column without values, missing days."""
    rng = random.Random(3)
    rows = []
    for w, n in (("long", 800), ("mid", 30), ("one", 1)):
        for i in range(n):
            if rng.random() < 0.9 or n == 1:
                gap = 120 < i < 360 or i < 40 or i > 760
                rows.append((w, D0 + dt.timedelta(i), None if gap or rng.random() < 0.3 else float(rng.randint(1, 99)), float(i) if w == "mid" else None))
    return spark.createDataFrame(rows, "well string, ds date, a double, b double").repartition(5).cache()


def rows_of(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("days", [1, 9, 100, 5000])
def test_equal_to_the_plain_operators(gappy, days):
    cols = ["well", "ds", "a", "b"]
    assert rows_of(SG.ffill(gappy, ["a", "b"], days=days), cols) == rows_of(C.ffill(gappy, ["a", "b"]), cols)
    assert rows_of(SG.interpolate(gappy, ["a", "b"], days=days), cols) == rows_of(C.interpolate(gappy, ["a", "b"]), cols)
    assert SG.interpolate(gappy, ["a", "b"], days=days).columns == C.interpolate(gappy, ["a", "b"]).columns
    place = ["well", "ds", "time_idx", "well_id"]
    assert rows_of(SG.time_index(gappy, days=days), place) == rows_of(C.time_index(gappy), place)


@pytest.mark.parametrize("block", [1, 50, 4000])
def test_windows_over_block_borders(gappy, block):
    filled = C.interpolate(gappy, ["a"])
    cols = ["well", "start_idx", "ds_end", "x", "y"]
    assert rows_of(SG.supervised(filled, "a", 14, 7, days=60, block=block), cols) == rows_of(W.supervised(filled, "a", 14, 7), cols)


def test_eight_segments_of_one_well_are_eight_groups(spark):
    n, days = 1600, 200
    first = -(-(D0 - dt.date(1970, 1, 1)).days // days) * days
    df = spark.range(n).select(F.lit("w").alias("well"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") + first).cast("int")).alias("ds"),
                               F.when(F.col("id") % 7 < 2, F.col("id").cast("double")).alias("a"))
    out = SG.placed(df, days=days, cols=["a"])
    sizes = [r["count"] for r in out.groupBy("well", "_seg").count().collect()]
    assert sizes == [200] * 8
    plan = SG.interpolate(df, ["a"], days=days)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line and "row_number" in line]
    assert over_rows and all("_seg" in line for line in over_rows)  # rows are numbered inside their segment only
    assert rows_of(SG.interpolate(df, ["a"], days=days), ["ds", "a"]) == rows_of(C.interpolate(df, ["a"]), ["ds", "a"])


def test_empty(spark):
    empty = spark.createDataFrame([], "well string, ds date, a double")
    assert SG.interpolate(empty, ["a"]).count() == 0 and SG.supervised(empty, "a", 3, 2).count() == 0
