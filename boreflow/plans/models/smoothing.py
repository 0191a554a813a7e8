"""M1-M3 as backtests: ETS, DLT and LGT for many wells, folds and candidates at once.

Two stages, both deterministic (least squares and exponential smoothing, not the posterior of
the Bayesian models these slots stand for; numbers are not meant to equal theirs):

1. Regression stage (Gram sums and small solves, by well): DLT fits a global trend
   (``flat | linear | loglinear | logistic``) plus the regressors with the chosen penalty
   (``fixed_ridge | auto_ridge | lasso``); LGT fits the regressors alone; ETS has none.
2. Smoothing stage on the residual series of each (well, fold, stage-1 candidate): the
   vectorised recursion of ``boreflow.functions.smoothing`` for every smoothing-grid point, or, with
   ``fixed``, once with the weights that fit the series best (``boreflow.functions.fitting``).

Forecast = regression part on the test / future rows (the scenario ramp enters here through the
regressors) + the smoother's h-step forecast. Band: ``yhat +- z * sd`` with ``sd`` the root mean
one-step in-sample error, z for 5 % / 95 %.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.session import apply_recommended_conf, cut_lineage, reuse

from boreflow.functions import linalg as L
from boreflow.functions import regress as R
from boreflow.functions.fitting import BOX, fit_folds_udf
from boreflow.functions.smoothing import NEUTRAL, PARAMS, smooth_folds_udf, smooth_grid_udf
from boreflow.operators.backtest import backtest_rows, split_bounds
from boreflow.operators.scenario import ramp_value
from boreflow.plans.series import series_arrays
from boreflow.operators.clean import KEY, ORDER
from boreflow.plans.models import common as M

TRENDS = ("flat", "linear", "loglinear", "logistic")
PENALTIES = ("fixed_ridge", "auto_ridge", "lasso")
GRID_KEYS = PARAMS


def trend_features(regressors: Sequence[str], pos: Column | None = None, train_end: Column | None = None,
                   reg_values: Sequence[Column] | None = None) -> tuple[list[Column], list[str]]:
    """Stage-1 features: intercept, the four global-trend shapes, then the regressors.

    By default they read the row's ``pos``, ``train_end`` and regressor columns; the same
    definitions also take lambda variables (``pos``, ``train_end``, ``reg_values``) so a series
    array can be evaluated element by element with the identical formulas.
    """
    pos = F.col("pos") if pos is None else pos
    train_end = F.col("train_end") if train_end is None else train_end
    t = pos.cast("double") / F.greatest(train_end, F.lit(1)).cast("double")
    feats = [F.lit(1.0), t, F.log1p(pos.cast("double")), F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-10.0) * (t - F.lit(0.5))))]
    kinds = ["const", "linear", "loglinear", "logistic"]
    values = [F.col(r) for r in regressors] if reg_values is None else list(reg_values)
    for v in values:
        feats.append(v.cast("double"))
        kinds.append("reg")
    return feats, kinds


def stage1_candidates(kind: str, regressors: Sequence[str], trends: Iterable[str] = ("linear",),
                      penalties: Iterable[str] = ("fixed_ridge",), lam: float = 0.1) -> list[M.Candidate]:
    _, kinds = trend_features(regressors)
    out = []
    for trend in (trends if kind == "dlt" else ("none",)):
        for pen in (penalties if regressors else ("fixed_ridge",)):
            if kind == "dlt":
                keep = [k == "const" or k == trend or k == "reg" for k in kinds]
                keep[0] = True
            else:
                keep = [k == "reg" for k in kinds]
            pw = [1.0 if k == "reg" else 0.0 for k in kinds]
            params = {"regression_penalty": pen}
            if kind == "dlt":
                params["global_trend_option"] = trend
            out.append(M.Candidate(params, keep, pw, lam, "lasso" if pen == "lasso" else "ridge", 0, auto=pen == "auto_ridge"))
    return out


def default_grid(kind: str) -> list[dict[str, float]]:
    """A small grid per kind. A grid point may carry ``cid``: it then runs only with that stage-1 candidate."""
    if kind == "ets":
        return [{"alpha": a, "gamma": g} for a in (0.1, 0.3, 0.5) for g in (0.05, 0.2)]
    if kind == "dlt":
        return [{"alpha": a, "beta": b, "gamma": 0.1, "phi": p} for a in (0.1, 0.3) for b in (0.01, 0.1) for p in (0.8, 0.98)]
    return [{"alpha": a, "beta": b, "gamma": 0.1, "xi1": 0.5, "xi2": x, "lam": 0.5} for a in (0.1, 0.3) for b in (0.05, 0.2) for x in (0.0, 0.01)]


def grid_point(gid: Column, cid: Column, weights: dict[str, Column]) -> Column:
    """One element of a well's own grid; weights not given are neutral."""
    told = F.create_map(*[x for k in sorted(weights) for x in (F.lit(k), weights[k].cast("string"))], F.lit("trial"), gid.cast("string"))
    return F.struct(gid.cast("int").alias("gid"), cid.cast("int").alias("only_cid"), told.alias("gparams"),
                    *[(weights[k] if k in weights else F.lit(NEUTRAL[k])).cast("double").alias(k) for k in GRID_KEYS])


def _grid_array(grid: Sequence[dict[str, float]]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("gid"), F.lit(int(g.get("cid", -1))).alias("only_cid"),
                 F.create_map(*[x for k in sorted(g) if k in GRID_KEYS or k == "trial"
                               for x in (F.lit(k), F.lit(str(g[k]) if k == "trial" else repr(float(g[k]))))]).alias("gparams"),
                 *[F.lit(float(g.get(k, NEUTRAL[k]))).alias(k) for k in GRID_KEYS])
        for i, g in enumerate(grid)
    ])


def _gparams(grid: Column, gid: Column) -> Column:
    return F.get(F.filter(grid, lambda g: g["gid"] == gid), F.lit(0))["gparams"]


def _gridded(series: DataFrame, kind: str, grid: Sequence[dict[str, float]] | None, grids: DataFrame | None, key: str,
             keep: Sequence[str] = ()) -> DataFrame:
    """Every grid point's run of every residual series; a point with a ``cid`` only with that candidate."""
    own = series.join(grids, key) if grids is not None else series.withColumn("grid", _grid_array(grid))
    own = own.withColumn("grid", F.filter("grid", lambda g: (g["only_cid"] < 0) | (g["only_cid"] == F.col("cid")))).filter(F.size("grid") > 0)
    res = own.select(key, "fold", "cid", "grid", *keep, F.explode(smooth_grid_udf(F.lit(kind), F.col("r"), F.col("h"), F.col("grid"))).alias("_s"))
    return res.select(key, "fold", "cid", *keep, "_s.*", _gparams(F.col("grid"), F.col("_s.gid")).alias("gparams"))


def _fitted(fits: DataFrame, kind: str, keys: Sequence) -> DataFrame:
    """Fits ``_s`` as rows with the fitted weights and ``converged`` as parameters."""
    told = F.create_map(*[x for p in sorted(BOX[kind]) for x in (F.lit(p), F.col(f"_s.{p}").cast("string"))],
                        F.lit("converged"), F.col("_s.converged").cast("string"))
    return fits.select(*keys, "_s.sse", "_s.n_fit", "_s.fc", told.alias("gparams"))


CARRIED = ("n", "end", "ended", "params", "train_end", "h", "pos", "step", "beta", "ds", "y", "reg")


def regression_series(panel: DataFrame, target: str, regs: Sequence[str], stage1: Sequence[M.Candidate], horizon: int, n_splits: int,
                      holdout: tuple[float, float] | None, include_last: bool, key: str) -> DataFrame:
    """One row per fit of the regression stage: ``well, fold, cid, r`` and ``CARRIED``."""
    fields = [F.col(ORDER), F.col(target).cast("double"), *[F.col(r).cast("double") for r in regs]]
    per = panel.groupBy(key).agg(R.stage1(panel.schema[ORDER].dataType, stage1, horizon, n_splits, holdout, 0 if include_last else 1, *fields).alias("_f"))
    fits = per.select(key, *[F.col(f"_f.{c}").alias(c) for c in ("n", "end", "ended")],
                      F.explode(F.arrays_zip(*[F.col(f"_f.{c}").alias(c) for c in R.PER_FIT])).alias("_c"))
    params = F.array(*[M.param_map(c.params) for c in stage1])
    return fits.select(key, "n", "end", "ended", *[F.col(f"_c.{c}").alias(c) for c in R.PER_FIT], params[F.col("_c.cid")].alias("params"))


def smoothing_fits(panel: DataFrame, target: str, kind: str, regressors: Sequence[str], stage1: list[M.Candidate] | None = None,
                   grid: Sequence[dict[str, float]] | None = None, horizon: int = 30, n_splits: int = 5, holdout: tuple[float, float] | None = None,
                   include_last: bool = False, key: str = KEY, fixed: dict[str, float] | None = None, grids: DataFrame | None = None) -> DataFrame:
    """The fits of DLT or LGT, one row of arrays each, before any scenario; ``smoothing_forecast`` lays them out.

    ``fold`` comes from the regression stage: a filter on it is made before the smoothing weights are searched.
    """
    regs = list(regressors)
    apply_recommended_conf(panel.sparkSession)
    # A parameter a well does not have enters as the constant 0.
    known = panel.withColumns({r: F.coalesce(F.col(r), F.lit(0.0)) for r in regs}) if regs else panel
    series = regression_series(known, target, regs, stage1 or stage1_candidates(kind, regs), horizon, n_splits, holdout, include_last, key)
    if fixed is not None:
        whole = F.array(F.struct(F.col("fold"), F.size("r").alias("train_end"), F.col("h")))
        runs = series.select(key, "fold", "cid", *CARRIED, F.explode(fit_folds_udf(kind, fixed)(F.col("r"), whole)).alias("_s"))
        res = _fitted(runs, kind, [key, "fold", "cid", *CARRIED])
    else:
        res = _gridded(series, kind, grid or default_grid(kind), grids, key, CARRIED)
    return res.select(key, "fold", "cid", *CARRIED, "gparams", "sse", "n_fit", F.slice("fc", F.col("step"), F.col("h") - F.col("step") + 1).alias("fc"))


def _ahead(fits: DataFrame, regs: Sequence[str], last: int, horizon: int, scenario: tuple[str, float] | None, include_last: bool, key: str) -> DataFrame:
    """Test rows of the folds and future rows of the final fit: those of ``backtest_rows`` past the training part, with ``yhat``."""
    param, delta = scenario if scenario else (None, 0.0)
    start = 0 if include_last else 1
    final = F.col("fold") == last
    steps = F.sequence(F.lit(1), F.lit(max(horizon, 1)))

    def future(s):
        ended = {r: F.col("ended")[j] for j, r in enumerate(regs)}
        values = [ramp_value(ended[r], delta, s, horizon) if r == param else ended[r] for r in regs]
        return L.dot(F.col("beta"), trend_features(regs, F.col("n") - 2 + s + F.lit(start), F.col("train_end"), values)[0])

    days = F.transform(steps, lambda s: F.date_add(F.col("end"), s - 1 + start))
    out = fits.select(key, "fold", "cid", "params", "gparams", "sse", "n_fit", "train_end", "pos", "step", F.posexplode(F.arrays_zip(
        F.when(final, days).otherwise(F.col("ds")).alias("ds"), F.col("y").alias("y"),  # none is known ahead
        F.when(final, F.transform(steps, future)).otherwise(F.col("reg")).alias("reg"), F.col("fc").alias("fc"))).alias("_i", "_r"))
    return out.select(key, "fold", "cid", "params", "gparams", "sse", "n_fit", "train_end", F.when(final, "future").otherwise("test").alias("part"),
                      "_r.ds", "_r.y", (F.col("pos") + F.col("_i")).cast("int").alias("pos"), (F.col("step") + F.col("_i")).cast("int").alias("step"),
                      (F.col("_r.reg") + F.col("_r.fc")).alias("yhat"))


def training_error(panel: DataFrame, target: str, kind: str = "ets", grid: Sequence[dict[str, float]] | None = None,
                   fixed: dict[str, float] | None = None, n_splits: int = 5, key: str = KEY) -> DataFrame:
    """In-sample one-step RMSE per (well, fold) and grid point, or of the fitted weights (``fixed``).

    ``well, fold, gparams, n_fit, rmse``; the target's own series is smoothed, without a regression stage.
    """
    ser = series_arrays(panel, [target], key)
    bounds, _ = split_bounds(F.col("n"), n_splits)
    cuts = F.transform(bounds, lambda b: F.struct(b["fold"].alias("fold"), b["train_end"].alias("train_end"), F.lit(0).alias("h")))
    if fixed is not None:
        res = _fitted(ser.select(key, F.explode(fit_folds_udf(kind, fixed)(F.col(target), cuts)).alias("_s")), kind, [key, "_s.fold"])
    else:
        garr = _grid_array(grid)
        res = ser.select(key, F.explode(smooth_folds_udf(F.lit(kind), F.col(target), cuts, garr)).alias("_s")).select(
            key, "_s.*", garr[F.col("_s.gid")]["gparams"].alias("gparams"))
    return res.select(key, "fold", "gparams", "n_fit", F.sqrt(F.try_divide("sse", F.col("n_fit").cast("double"))).alias("rmse"))


def smoothing_forecast(panel: DataFrame, target: str, kind: str = "ets", regressors: Sequence[str] = (),
                       stage1: list[M.Candidate] | None = None, grid: list[dict[str, float]] | None = None,
                       horizon: int = 30, n_splits: int = 5, holdout: tuple[float, float] | None = None,
                       scenario: tuple[str, float] | None = None, include_last: bool = False, z: float = M.Z90,
                       key: str = KEY, fixed: dict[str, float] | None = None, grids: DataFrame | None = None, cut: bool = False,
                       fits: DataFrame | None = None) -> DataFrame:
    """Backtest + future rows: ``well, fold, part, ds, step, y, params, yhat, yhat_lower, yhat_upper, model``.

    ``grid`` gives smoothing weights to run side by side, ``grids`` (``well, grid``, elements from
    ``grid_point``) the same for each well on its own; wells without a row there get none. With ``fixed`` instead, each (well, fold,
    stage-1 candidate) gets the weights of the least one-step squared error of its training part; those
    in ``fixed`` are held. ``params`` then tells the weights, and under ``converged`` whether the
    search settled. ``cut`` stores the fits of DLT and LGT with a reliable checkpoint, so that several readers of the rows share them;
    ``fits`` gives those of ``smoothing_fits`` with the same arguments, which no scenario changes.
    """
    apply_recommended_conf(panel.sparkSession)
    regs = list(regressors) if kind != "ets" else []
    if sum(x is not None for x in (grid, grids, fixed)) > 1:
        raise ValueError("one of grid, grids and fixed")
    if kind == "ets":
        grid = grid or default_grid(kind)
        fit = None if fixed is None else fit_folds_udf(kind, fixed)
        # No regression stage: every fold trains on a prefix of the same series, so each series
        # runs once per grid point and reports its state at every fold's training end.
        panel = reuse(panel)
        rows1 = backtest_rows(panel, target, [], n_splits, horizon, None, include_last, holdout, key).withColumns(
            {"cid": F.lit(0), "params": F.create_map().cast("map<string,string>"), "reg": F.lit(0.0)})
        ser = series_arrays(panel, [target], key)
        bounds, k = split_bounds(F.col("n"), n_splits, holdout)
        if horizon <= 0:
            bounds = F.filter(bounds, lambda b: b["fold"] < k)
        cuts = F.transform(bounds, lambda b: F.struct(
            b["fold"].alias("fold"), b["train_end"].alias("train_end"),
            F.when(b["fold"] == k, F.lit(max(horizon, 0))).otherwise(b["test_end"] - b["train_end"]).alias("h")))
        if fit is not None:
            res = _fitted(ser.select(key, F.explode(fit(F.col(target), cuts)).alias("_s")), kind, [key, "_s.fold", F.lit(0).alias("cid")])
        elif grids is not None:
            own = ser.join(grids, key)
            res = own.select(key, "grid", F.explode(smooth_folds_udf(F.lit(kind), F.col(target), cuts, F.col("grid"))).alias("_s"))
            res = res.select(key, "_s.fold", F.lit(0).alias("cid"), "_s.gid", "_s.sse", "_s.n_fit", "_s.fc", _gparams(F.col("grid"), F.col("_s.gid")).alias("gparams"))
        else:
            garr = _grid_array(grid)
            res = ser.select(key, F.explode(smooth_folds_udf(F.lit(kind), F.col(target), cuts, garr)).alias("_s"))
            res = res.select(key, "_s.fold", F.lit(0).alias("cid"), "_s.gid", "_s.sse", "_s.n_fit", "_s.fc").withColumn(
                "gparams", garr[F.col("gid")]["gparams"])
        pred = rows1.filter(F.col("part") != "train").join(res, [key, "fold", "cid"]).withColumn("yhat", F.col("reg") + F.element_at("fc", F.col("step")))
    else:
        # No copy of the panel is stored and no row is copied per fold: one aggregate per well makes the regression
        # stage of all folds, and with ``cut`` only one row of arrays per fit is kept.
        if fits is None:
            fits = smoothing_fits(panel, target, kind, regs, stage1, grid if grids is None else None, horizon, n_splits, holdout, include_last, key, fixed, grids)
        pred = _ahead(cut_lineage(fits) if cut else fits, regs, 1 if holdout else n_splits, horizon, scenario, include_last, key)
    sd = F.sqrt(F.try_divide(F.col("sse"), F.col("n_fit").cast("double")))
    yhat = F.col("yhat")
    return pred.select(
        key, "fold", "part", "ds", "pos", "train_end", "step", "y",
        F.map_concat("params", "gparams").alias("params"), yhat,
        (yhat - F.lit(z) * sd).alias("yhat_lower"), (yhat + F.lit(z) * sd).alias("yhat_upper"),
        F.lit(kind.upper()).alias("model"),
    )
