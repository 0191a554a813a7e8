"""Residual stacks: blocks against plain least squares, the whole forecast, and the pooled ridge learner."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import pinball as PB
from boreflow.functions import stacks as ST
from boreflow.operators import clean as C
from boreflow.operators import evaluate as E
from boreflow.plans import forecast as FC
from boreflow.plans.models import lags
from boreflow.session import cut_lineage
from boreflow.sources import testpanel as T

D0 = dt.date(2021, 3, 1)
EPOCH = (D0 - dt.date(1970, 1, 1)).days


def values(k, n):
    rng = np.random.default_rng(60 + k)
    t = np.arange(n)
    return 30.0 * (k + 1) * (1 + 0.002 * t + 0.2 * np.sin(2 * math.pi * t / 7) + 0.1 * rng.normal(size=n))


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"w{k}", D0 + dt.timedelta(i), float(v)) for k in range(4) for i, v in enumerate(values(k, 210))]
    return spark.createDataFrame(rows, "well string, ds date, y double").repartition(3).cache()


def blocks_of(window, day):
    """Trend coefficients, wave coefficients and rest of one scaled window by least squares."""
    t = np.linspace(-1, 1, len(window))
    p = np.stack([t**d for d in range(3)], 1)
    a = np.linalg.lstsq(p, window, rcond=None)[0]
    left = window - p @ a
    days = day - len(window) + np.arange(len(window))
    s = np.stack([f(2 * math.pi * k * days / 7) for f in (np.sin, np.cos) for k in (1, 2, 3)], 1)
    w = np.linalg.lstsq(s, left, rcond=1e-6)[0]
    return a, w, left - s @ w


def features(a, w, rest, day):
    waves = np.array([f(2 * math.pi * k * day / 7) for f in (math.sin, math.cos) for k in (1, 2, 3)])
    return a, w * waves, np.array([1.0, *rest, math.sin(2 * math.pi * day / 365.25), math.cos(2 * math.pi * day / 365.25)])


def test_whole_forecast_by_definition(panel):
    n_in, n_out, lam = 9, 2, 0.01
    got = {(r.well, r.fold, r.step): r for r in FC.forecast(panel, "y", "N-BEATS", horizon=6, params={"n_input": n_in, "n_out": n_out, "lam": lam}).collect()}
    longest = max(k[2] for k in got)
    ahead = PB.classes(n_out, longest)
    for fold, end in {(f, r.train_end) for (_, f, _), r in got.items()}:
        weights = []
        for lo, hi in ahead:
            rows = []
            for k in range(4):
                y = values(k, 210)
                for i in range(210 - n_in):
                    at = i + n_in - 1 + lo + i % (hi - lo + 1)
                    if at < end:
                        scale = np.abs(y[i : i + n_in]).mean()
                        rows.append((*features(*blocks_of(y[i : i + n_in] / scale, EPOCH + i + n_in), EPOCH + at), y[at] / scale))
            left, own = np.array([r[3] for r in rows]), []
            for b in range(3 if rows else 0):
                x = np.array([r[b] for r in rows])
                d = np.diag(x.T @ x)
                own.append(np.linalg.solve(x.T @ x + np.diag(lam * d + 1e-9 * (1 + d.max())), x.T @ left))
                left = left - x @ own[-1]
            weights.append(own)
        have = [c for c, w in enumerate(weights) if w]
        for k in range(4):
            y = values(k, 210)
            ctx = y[end - n_in : end]
            scale = np.abs(ctx).mean()
            parts = blocks_of(ctx / scale, EPOCH + end)
            for step in [s for (w, f, s) in got if w == f"w{k}" and f == fold]:
                own = next(c for c, (_, hi) in enumerate(ahead) if step <= hi)
                own = max(c for c in have if c <= own)
                feats = features(*parts, EPOCH + end - 1 + step)
                want = scale * sum(float(f @ w) for f, w in zip(feats, weights[own], strict=True))
                r = got[f"w{k}", fold, step]
                assert r.yhat == pytest.approx(want, rel=1e-6) and r.yhat_lower is None and r.yhat_upper is None


def test_each_block_takes_its_part_off():
    days = np.arange(EPOCH, EPOCH + 300).astype(float)
    y = 5 + 0.01 * np.arange(300) + 0.5 * np.sin(2 * math.pi * days / 7)
    inputs, scale = PB.windows(y, 28)
    trend, waves, rest = ST.decompose(inputs[:, 1:], days[np.arange(len(inputs)) + 28])
    assert np.abs(rest).max() < 0.02 and np.abs(waves[:, 0] * scale - 0.5).max() < 0.05


def test_beats_the_pooled_ridge_on_the_supplier_panel(spark):
    panel = cut_lineage(C.clean(T.scale_panel(spark, "/root/testdata/sf0.001"), T.PARAMS, target=T.TARGET))

    def rmse(fc):
        return {r.fold: r.rmse for r in E.metrics(fc.filter("part = 'test'"), by=("fold",)).collect()}

    mine, ridge = rmse(FC.forecast(panel, T.TARGET, "N-BEATS", horizon=0)), rmse(lags.lag_forecast(panel, T.TARGET, 0, 24, 7, "pooled", 0.1))
    assert set(mine) == set(range(5)) and all(mine[f] < ridge[f] for f in mine)


def test_short_wells_and_empty_panels(spark):
    rows = [("long", D0 + dt.timedelta(i), None if i % 50 == 3 else float(v)) for i, v in enumerate(values(1, 200))]
    rows += [("short", D0 + dt.timedelta(i), 10.0 + i) for i in range(3)]
    panel = spark.createDataFrame(rows, "well string, ds date, y double")
    out = FC.forecast(panel, "y", "N-BEATS", horizon=4).filter("part = 'future'").collect()
    assert len(out) == 8 and all(math.isfinite(r.yhat) for r in out)
    alone = FC.forecast(panel.filter("well = 'short'"), "y", "N-BEATS", horizon=4).filter("part = 'future'").collect()
    assert [r.yhat for r in alone] == [12.0] * 4
    assert FC.forecast(panel.filter(F.lit(False)), "y", "N-BEATS", horizon=4).count() == 0
