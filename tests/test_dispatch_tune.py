import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.operators import evaluate as E
from boreflow.plans import forecast as FC
from boreflow.plans import tune as TU

D0 = dt.date(2021, 3, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for j, w in enumerate(("a", "b", "c")):
        t = np.arange(240)
        x = rng.normal(size=240)
        y = 50 + 5 * j + 4 * np.sin(2 * math.pi * t / 12) + 2 * x + rng.normal(scale=0.5, size=240)
        rows += [(w, D0 + dt.timedelta(int(i)), float(y[i]), float(x[i])) for i in t]
    return spark.createDataFrame(rows, "well string, ds date, y double, x double").cache()


@pytest.mark.parametrize("model", FC.MODELS)
def test_every_model_name_forecasts(panel, model):
    fc = FC.forecast(panel, "y", model, ["x"], horizon=7, scenario=("x", 1.0))
    rows = fc.select("well", "part", "fold", "step", "yhat", "yhat_lower", "yhat_upper").collect()
    fut = [r for r in rows if r.part == "future"]
    assert len(fut) == 3 * 7 and all(math.isfinite(r.yhat) for r in rows)
    if model == "N-BEATS":
        assert all(r.yhat_lower is None for r in fut)
    else:
        assert all(r.yhat_lower <= r.yhat_upper for r in fut)


def test_tune_picks_the_lowest_rmse(panel):
    best = {r.well: r for r in TU.tune(panel, "y", "ETS", 8, seed=3).collect()}
    trials = TU.draw(TU.SPACES["ETS"], 8, 3)
    fc = TU.trial_forecasts(panel, "y", "ETS", trials)
    allm = E.metrics(fc.filter(F.col("part") == "test"), by=("well", "model", "params")).collect()
    for w in ("a", "b", "c"):
        assert abs(best[w].rmse - min(r.rmse for r in allm if r.well == w)) < 1e-12
        assert best[w].trial in range(8) and float(best[w].params["alpha"]) == trials[best[w].trial]["alpha"]


def test_run_screens_then_forecasts(spark, panel):
    raw = panel.withColumn("x", F.when(F.dayofmonth("ds") == 5, F.lit(0.0)).otherwise(F.col("x")))
    fc, met, scr = FC.run(raw, "y", "DLT", ["y", "x"], 7)
    assert {r.well for r in scr.collect()} == {"a", "b", "c"}
    m = met.collect()
    assert len(m) == 15 and all(math.isfinite(r.rmse) for r in m)


def test_window_learners_tune_their_whole_shape(panel):
    for model in ("LSTM", "TFT", "N-BEATS"):
        trials = TU.draw(TU.SPACES[model])
        assert {t["n_out"] for t in trials} >= {7, 14}
        widths = {t["n_steps"] * 7 if model == "LSTM" else t["n_input"] for t in trials}
        assert widths >= ({14} if model == "LSTM" else {14, 24, 48})
    trials = [{"n_steps": 2, "n_out": 7, "lam": 0.1}, {"n_steps": 2, "n_out": 14, "lam": 0.1}]
    fc = TU.trial_forecasts(panel, "y", "LSTM", trials).select("trial", F.col("params")["n_out"].alias("n_out"), F.col("params")["n_input"].alias("n_input")).distinct()
    assert {tuple(r) for r in fc.collect()} == {(0, "7", "14"), (1, "14", "14")}
