"""Bench: headline queries on the scale panel (wells = suppliers) at ``$BENCH_SF_DIR``.

Prints one JSON line: ``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
Every query starts from the parquet files (no cache shared between queries) and is forced with a
``noop`` write, so each time covers scan -> panel -> operator -> result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from boreflow.operators import backtest as BT  # noqa: E402
from boreflow.operators import clean as C  # noqa: E402
from boreflow.operators import evaluate as E  # noqa: E402
from boreflow.operators import screen as S  # noqa: E402
from boreflow.plans import forecast as FC  # noqa: E402
from boreflow.plans import tune as TU  # noqa: E402
from boreflow.session import local_session  # noqa: E402
from boreflow.sources import testpanel as T  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WEIGHTS = {"alpha": 0.1, "gamma": 0.05}
REGS = [p for p in T.PARAMS if p != T.TARGET]


def _cleaned(spark, sf_dir):
    return C.clean(T.scale_panel(spark, sf_dir), T.PARAMS, target=T.TARGET)


def q_clean(spark, sf_dir) -> DataFrame:
    """C1-C6 on the supplier panel (daily grid, blanks/zeros -> null, interpolation)."""
    return _cleaned(spark, sf_dir)


def q_screen(spark, sf_dir) -> DataFrame:
    """ACF to lag 20, Pearson, Spearman + p-value, per supplier."""
    return S.screen(_cleaned(spark, sf_dir), T.TARGET, REGS)


def q_baseline_folds(spark, sf_dir) -> DataFrame:
    """B2 + B4 + E1-E3: 5 expanding folds, last-value forecast, metrics."""
    rows = BT.backtest_rows(_cleaned(spark, sf_dir), T.TARGET, [], 5, 0)
    return E.metrics(BT.last_value_forecast(rows), by=("well", "model", "fold"))


def q_ets_backtest(spark, sf_dir) -> DataFrame:
    """M1: ETS with given weights, 5 folds + 30-day future, fold metrics."""
    fc = FC.forecast(_cleaned(spark, sf_dir), T.TARGET, "ETS", horizon=30, params={**WEIGHTS, "n_bootstrap_draws": 0})
    return E.metrics(fc.filter(F.col("part") == "test"), by=("well", "model", "fold"))


def q_ets_fitted(spark, sf_dir) -> DataFrame:
    """M1 with the weights fitted to every supplier and training part."""
    fc = FC.forecast(_cleaned(spark, sf_dir), T.TARGET, "ETS", horizon=30, params={"n_bootstrap_draws": 0})
    return E.metrics(fc.filter(F.col("part") == "test"), by=("well", "model", "fold"))


def q_tune_ets_50(spark, sf_dir) -> DataFrame:
    """E5: 50 ETS trials per supplier on the hold-out split, best per supplier."""
    return TU.tune(_cleaned(spark, sf_dir), T.TARGET, "ETS", 50)


def q_fourier_8(spark, sf_dir) -> DataFrame:
    """M5: trend + Fourier, all 8 (mode, yearly, weekly) candidates, 5 folds + future."""
    from boreflow.plans.models import fourier

    fc = fourier.fourier_trend(_cleaned(spark, sf_dir), T.TARGET, 30)
    return E.metrics(fc.filter(F.col("part") == "test"), by=("well", "model", "params", "fold"))


def q_dlt_run(spark, sf_dir) -> DataFrame:
    """The whole run on the supplier panel: clean -> screen -> DLT with regressors + scenario -> metrics."""
    _, met, _ = FC.run(T.scale_panel(spark, sf_dir), T.TARGET, "DLT", T.PARAMS, 30, ("price", 5000.0))
    return met


def q_u3_band(spark, sf_dir) -> DataFrame:
    """The 5 % / 95 % band of 500 bootstrap draws for every supplier, fold and step."""
    fc = FC.forecast(_cleaned(spark, sf_dir), T.TARGET, "ETS", horizon=30, params={**WEIGHTS, "n_bootstrap_draws": 500})
    return fc.select("well", "fold", "ds", "yhat", "yhat_lower", "yhat_upper")


def q_pooled(spark, sf_dir) -> DataFrame:
    """M8: lag windows pooled over all suppliers, 5 folds + 30-day future, fold metrics."""
    fc = FC.forecast(_cleaned(spark, sf_dir), T.TARGET, "N-BEATS", horizon=30)
    return E.metrics(fc.filter(F.col("part") == "test"), by=("well", "model", "fold"))


QUERIES = {
    "clean": q_clean, "screen": q_screen, "baseline_folds": q_baseline_folds, "ets_backtest": q_ets_backtest,
    "tune_ets_50": q_tune_ets_50, "fourier_8": q_fourier_8, "dlt_run": q_dlt_run,
    "u3_band": q_u3_band, "pooled": q_pooled, "ets_fitted": q_ets_fitted,
}


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    wells = T.scale_panel(spark, SF_DIR).select("well").distinct().count()
    times: dict[str, float] = {}
    only = set(sys.argv[1:]) or set(QUERIES)
    for name, fn in QUERIES.items():
        if name not in only:
            continue
        spark.catalog.clearCache()  # no query may reuse another's persisted frames
        t0 = time.perf_counter()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    out = {"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
           "sf": float(sf.group(1)) if sf else None, "wells": wells}
    if "tune_ets_50" in times:
        out["tune_fits_per_sec"] = round(wells * 50 / times["tune_ets_50"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
