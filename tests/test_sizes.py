"""What a run stores and how much one task gets, on small panels."""

import datetime as dt
import math

import numpy as np

from boreflow.operators import screen as S
from boreflow.plans import forecast as FC
from boreflow.plans.models import smoothing
from boreflow.sources import testpanel as T
from tests.conftest import SF

D0 = dt.date(2024, 1, 1)


def _panel(spark, days=60):
    rng = np.random.default_rng(3)
    rows = [(w, D0 + dt.timedelta(i), float(50 + i + rng.normal()), float(5 + i % 7 + rng.normal())) for w in ("a", "b") for i in range(days)]
    return spark.createDataFrame(rows, "well string, ds date, y double, x double")


def test_scale_panel_has_partitions_in_proportion_to_its_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "GRID_ROWS", 2_000)
    rows = T.scale_panel(spark, SF).count()
    parts = T.scale_panel(spark, SF).rdd.getNumPartitions()
    assert parts >= math.ceil(rows / 2_000) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_screen_deals_the_panel_out_once_and_stores_nothing(spark):
    plan = S.screen(T.scale_panel(spark, SF), T.TARGET, ["price", "disc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2  # at most the daily sums and the grid by well
    assert "ExistingRDD" not in plan  # no checkpoint


def test_a_dlt_run_stores_rows_per_fit_not_per_day(spark, monkeypatch):
    stored = []

    def recorded(cut):
        def run(df):
            out = cut(df)
            stored.append(out.count())
            return out
        return run

    for module, name in ((FC, "cut_lineage"), (smoothing, "cut_lineage"), (smoothing, "reuse")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, recorded(getattr(module, name)))
    _, met, _ = FC.run(_panel(spark), "y", "DLT", ["y", "x"], 7, ("x", 3.0), params={"n_bootstrap_draws": 0})
    assert met.count() == 10
    assert stored and max(stored) <= 2 * 6  # two wells, five folds and the final fit


def test_the_screen_sorts_the_panel_by_well_and_no_more(spark):
    from boreflow.plans import queries as Q

    plan = S.screen(Q.suppliers(spark, SF), T.TARGET, ["price", "disc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 3  # the grid, the fill and the statistics
    assert plan.count("Window [") <= 1  # the grid


def test_a_run_whose_forecast_is_not_read_stores_no_panel(spark, monkeypatch):
    from boreflow.plans.models import paths

    stored = []
    for module in (FC, smoothing, paths):
        for name in ("cut_lineage", "reuse"):
            if hasattr(module, name):
                cut = getattr(module, name)
                monkeypatch.setattr(module, name, lambda df, cut=cut: stored.append(cut(df).count()) or cut(df))
    _, met, _ = FC.run(_panel(spark), "y", "DLT", ["y", "x"], 7, ("x", 3.0))  # with the band of 500 draws
    assert met.count() == 10
    assert max(stored) <= 2 * 6


def test_the_regression_stage_copies_no_row_per_fold(spark):
    fits = smoothing.smoothing_fits(_panel(spark), "y", "dlt", ["x"], fixed={})
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Window" not in plan and plan.count("ArrowAggregatePython") == 1


def test_the_scenario_shares_one_final_fit_per_well(spark, monkeypatch):
    from boreflow.plans import queries as Q

    stored = []
    cut = Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: stored.append(cut(df).count()) or cut(df))
    out = Q.m10_scenario(spark, SF)
    wells = T.scale_panel(spark, SF).select("well").distinct().count()
    assert stored == [wells]
    assert out.count() == 30 * wells


def test_shared_fits_give_the_forecasts_of_each_scenario(spark):
    panel = _panel(spark)
    own = {"n_bootstrap_draws": 0}
    whole = FC.fitted(panel, "y", "LGT", ["x"], 7, own)
    for scenario in (None, ("x", 3.0)):
        alone = FC.forecast(panel, "y", "LGT", ["x"], 7, scenario, own)
        shared = FC.forecast(panel, "y", "LGT", ["x"], 7, scenario, own, fits=whole)
        assert sorted(map(str, alone.collect())) == sorted(map(str, shared.collect()))
        final = FC.forecast(panel, "y", "LGT", ["x"], 7, scenario, own, fits=whole.filter("fold = 5"))
        assert sorted(map(str, alone.filter("part = 'future'").collect())) == sorted(map(str, final.collect()))
