"""Bands calibrated on earlier folds: ranks by hand, coverage, and what has too few scores."""

import datetime as dt
import math

import numpy as np
import pytest

from boreflow.operators import bands as U
from boreflow.operators.backtest import backtest_rows, last_value_forecast

D0 = dt.date(2021, 1, 1)


@pytest.fixture(scope="module")
def fc(spark):
    rng = np.random.default_rng(2)
    rows = [(f"w{k}", D0 + dt.timedelta(i), float(50 + rng.normal(scale=k + 1))) for k in range(6) for i in range(360)]
    rows += [("tiny", D0 + dt.timedelta(i), 5.0 + i) for i in range(8)]
    panel = spark.createDataFrame(rows, "well string, ds date, y double")
    return last_value_forecast(backtest_rows(panel, "y", [], 5, 12)).cache()


def test_half_widths_by_hand(fc):
    rows = fc.collect()
    got = {(r.well, r.fold, r.step): r for r in U.conformal_band(fc, 0.8).collect()}
    assert len(got) == len(rows)
    cls = lambda s: sum(s > c for c in (7, 14, 30))
    for r in rows:
        past = [x for x in rows if x.well == r.well and x.part == "test" and x.fold < r.fold]
        width = None
        for scores in ([x for x in past if cls(x.step) == cls(r.step)], past):
            s = sorted(abs(x.y - x.yhat) for x in scores)
            rank = math.ceil((len(s) + 1) * 0.8)
            if rank <= len(s):
                width = s[rank - 1]
                break
        mine = got[r.well, r.fold, r.step]
        assert mine.yhat == r.yhat and (mine.yhat_lower is None) == (width is None)
        if width is not None:
            assert math.isclose(mine.yhat_upper - r.yhat, width) and math.isclose(r.yhat - mine.yhat_lower, width)
    assert all(r.yhat_lower is None for r in got.values() if r.fold == 0)
    assert all(r.yhat_lower is not None for r in got.values() if r.part == "future" and r.well != "tiny")


@pytest.mark.parametrize("level", [0.5, 0.8, 0.9])
def test_coverage(fc, level):
    c = U.coverage(U.conformal_band(fc, level).filter("well <> 'tiny'"), by=("model",)).first()
    assert c.n == 6 * 4 * 60 and abs(c.inside - level) < 0.08


def test_empty(spark, fc):
    none = fc.filter("well = 'nobody'")
    assert U.conformal_band(none).count() == 0 and U.coverage(U.conformal_band(none)).count() == 0
