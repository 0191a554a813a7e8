"""One entry point for the nine model names, and the reference's whole run as one plan.

Name -> forecaster (regressors only where the named model takes them):

=========  ===========================================  ==========
name       forecaster                                   regressors
=========  ===========================================  ==========
ETS        smoothing kind ``ets``                       no
DLT        trend + regression, damped local trend       relevant
LGT        regression, local + global power trend       significant
KTR        kernel time-varying coefficients             significant
Prophet    piecewise trend + Fourier seasonality        no
Chronos    bootstrap sample paths, quantile band        no
LSTM       lag windows, direct multi-output             no
TFT        pooled quantile regression on windows        no
N-BEATS    pooled residual stacks on windows, no band   no
=========  ===========================================  ==========
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.functions.fitting import BOX
from boreflow.operators import clean as C
from boreflow.operators import evaluate as E
from boreflow.operators import screen as S
from boreflow.operators.clean import KEY
from boreflow.plans.models import fourier, ktr, lags, paths, quantile, smoothing, stacks
from boreflow.session import cut_lineage

MODELS = ("ETS", "DLT", "LGT", "KTR", "Prophet", "Chronos", "LSTM", "TFT", "N-BEATS")
USES_REGRESSORS = {"DLT": "relevant", "LGT": "significant", "KTR": "significant"}

# The parameter defaults of the reference's page, as far as a forecaster reads them, and
# the settings of the slots that stand for its sequence models.
DEFAULTS: dict[str, dict[str, str]] = {
    # smoothing weights are absent here: what is not given is fitted
    "DLT": {"global_trend_option": "linear", "regression_penalty": "fixed_ridge", "n_bootstrap_draws": "500"},
    "LGT": {"regression_penalty": "fixed_ridge", "n_bootstrap_draws": "500"},
    "ETS": {"n_bootstrap_draws": "500"},
    "KTR": {"n_bootstrap_draws": "500", "n_knots": str(ktr.N_KNOTS), "lam": "0.1"},
    "Prophet": {"seasonality_mode": "additive", "yearly_seasonality": "true", "weekly_seasonality": "true"},
    "Chronos": {"n_paths": str(paths.N_PATHS)},
    "LSTM": {"n_steps": "2", "n_length": "7", "n_out": str(lags.N_OUT), "lam": "0.1", "mode": "direct"},
    "TFT": {"n_input": str(quantile.N_INPUT), "n_out": str(quantile.N_OUT), "lam": repr(quantile.LAM)},
    "N-BEATS": {"n_input": str(stacks.N_INPUT), "n_out": str(stacks.N_OUT), "lam": repr(stacks.LAM)},
}


def forecast(panel: DataFrame, target: str, model: str, regressors: Sequence[str] = (), horizon: int = 30,
             scenario: tuple[str, float] | None = None, params: dict | None = None, n_splits: int = 5,
             holdout: tuple[float, float] | None = None, include_last: bool = False, fits: DataFrame | None = None) -> DataFrame:
    """Backtest + future forecast of one model with one parameter set (``params`` by name).

    Parameters not given take the model's DEFAULTS; the smoothing weights of ETS, DLT and LGT that are
    not given are fitted to each well and training part. The ``params`` of the result are all values
    used. ``fits`` gives what ``fitted`` made with the same arguments, so that forecasts that differ in the
    scenario alone share it; the result has rows of the fits it holds.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    p = {**DEFAULTS[model], **(params or {})}
    out = _points(panel, target, model, p, regressors, horizon, scenario, n_splits, holdout, include_last, fits=fits)
    return _named(_with_draws(out, panel, target, p, horizon, n_splits, holdout), model, p)


def fitted(panel: DataFrame, target: str, model: str, regressors: Sequence[str] = (), horizon: int = 30, params: dict | None = None,
           n_splits: int = 5, holdout: tuple[float, float] | None = None, include_last: bool = False) -> DataFrame:
    """The fits of DLT or LGT that ``forecast`` lays out as rows: one row per well and ``fold`` (the last is the final fit)."""
    if model not in ("DLT", "LGT"):
        raise ValueError(f"{model!r} has no fits apart from its rows; DLT and LGT have")
    weights, st1 = _smoothing_args(model, {**DEFAULTS[model], **(params or {})}, list(regressors))
    return smoothing.smoothing_fits(panel, target, model.lower(), list(regressors), st1, horizon=horizon, n_splits=n_splits, holdout=holdout,
                                    include_last=include_last, **weights)


def _smoothing_args(model: str, p: dict, regs: Sequence[str]) -> tuple[dict, list | None]:
    """Given or fitted weights, and the regression candidates."""
    kind = model.lower()
    given = {k: float(p[k]) for k in smoothing.GRID_KEYS if k in p}
    weights = {"grid": [given]} if set(BOX[kind]) <= set(given) else {"fixed": given}
    if kind == "ets":
        return weights, None
    return weights, smoothing.stage1_candidates(kind, regs, [p.get("global_trend_option", "linear")], [p["regression_penalty"]])


def _named(out: DataFrame, model: str, p: dict) -> DataFrame:
    used = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in p.items()}
    return E.best_params(out, used).withColumn("model", F.lit(model))


def _points(panel: DataFrame, target: str, model: str, p: dict, regressors: Sequence[str], horizon: int,
              scenario: tuple[str, float] | None, n_splits: int, holdout: tuple[float, float] | None,
              include_last: bool, cut: bool = False, fits: DataFrame | None = None) -> DataFrame:
    regs = list(regressors) if model in USES_REGRESSORS else []
    common = dict(horizon=horizon, n_splits=n_splits, holdout=holdout, include_last=include_last)
    if fits is not None and model not in ("DLT", "LGT"):
        raise ValueError(f"fits given for {model!r}")
    if model in ("ETS", "DLT", "LGT"):
        kind = model.lower()
        weights, st1 = _smoothing_args(model, p, regs)
        out = smoothing.smoothing_forecast(panel, target, kind, regs, st1, scenario=scenario, cut=cut, fits=fits, **weights, **common)
        return cut_lineage(out) if cut and kind == "ets" else out
    out = _other_points(panel, target, model, p, regs, scenario, common)
    return cut_lineage(out) if cut else out


def _other_points(panel: DataFrame, target: str, model: str, p: dict, regs: Sequence[str], scenario: tuple[str, float] | None, common: dict) -> DataFrame:
    if model == "KTR":
        return ktr.ktr(panel, target, regs, n_knots=int(p["n_knots"]), cands=ktr.candidates(regs, [float(p["lam"])]), scenario=scenario, **common)
    if model == "Prophet":
        grid = [(p["seasonality_mode"], str(p["yearly_seasonality"]).lower() == "true", str(p["weekly_seasonality"]).lower() == "true")]
        return fourier.fourier_trend(panel, target, cands=fourier.candidates(grid), **common)
    if model == "Chronos":
        return paths.sample_paths(panel, target, n_paths=int(p["n_paths"]), **common)
    if model == "TFT":
        return quantile.quantile_forecast(panel, target, n_input=int(p["n_input"]), n_out=int(p["n_out"]), lam=float(p["lam"]), **common)
    if model == "N-BEATS":
        return stacks.stack_forecast(panel, target, n_input=int(p["n_input"]), n_out=int(p["n_out"]), lam=float(p["lam"]), **common)
    return lags.lag_forecast(panel, target, n_input=int(p["n_steps"]) * int(p["n_length"]), n_out=int(p["n_out"]), mode=p["mode"], lam=float(p["lam"]), **common)


def _with_draws(out: DataFrame, panel: DataFrame, target: str, p: dict, horizon: int, n_splits: int,
                holdout: tuple[float, float] | None) -> DataFrame:
    """The bootstrap band of ``n_bootstrap_draws`` draws (0 or not a parameter: the model's own band)."""
    draws = int(p.get("n_bootstrap_draws") or 0)
    if not draws:
        return out
    return paths.bootstrap_band(out, panel, target, draws, horizon=horizon, n_splits=n_splits, holdout=holdout)


def mask_regressors(cleaned: DataFrame, screened: DataFrame, model: str, regs: Sequence[str]) -> DataFrame:
    """The panel with each well's regressors that its screening did not pass set to 0.

    Every well keeps one feature layout, so all wells stay in one job; models without regressors
    get the panel as it is.
    """
    kind = USES_REGRESSORS.get(model)
    if not kind or not regs:
        return cleaned
    # one flag per (well, regressor): ``max`` picks it deterministically
    # and the screening plan (windows, ranks, a pandas UDF) stays out of the forecast's lineage
    flags = cut_lineage(screened.groupBy(KEY).pivot("regressor", list(regs)).agg(F.max(F.col(kind).cast("int"))))
    return cleaned.join(flags.select(KEY, *[F.col(r).alias(f"_k_{r}") for r in regs]), KEY, "left").select(
        *[F.when(F.coalesce(F.col(f"_k_{c}"), F.lit(0)) == 1, F.col(c)).otherwise(F.lit(0.0)).alias(c)
          if c in regs else F.col(c) for c in cleaned.columns])


def run(panel_raw: DataFrame, target: str, model: str, params_: Sequence[str], horizon: int = 30,
        scenario: tuple[str, float] | None = None, fill_method: str = "interpolate", params: dict | None = None,
        n_splits: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reference's "run forecast": clean -> screen -> 5-fold backtest + future -> metrics.

    Returns ``(forecast, fold_metrics, screened)``. The regressors a model gets come from the
    screening, per well: a (well, regressor) pair that fails is zeroed for that well, so every
    well keeps one feature layout and the plan stays one job for all wells.
    """
    regs = [c for c in params_ if c != target]
    # The cleaned panel is many times the readings it is filled from: screening and forecast each clean
    # it again by well, and only the small screening result is cut by a reliable checkpoint.
    cleaned = C.clean(panel_raw, list(params_), method=fill_method, target=target)
    screened = cut_lineage(S.screen(cleaned, target, regs)) if regs else None
    panel = cleaned
    if screened is not None:
        panel = mask_regressors(cleaned, screened, model, regs)
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {MODELS}")
    p = {**DEFAULTS[model], **(params or {})}
    # The model is fitted once: metrics read its points, and the band is added to the same points.
    points = _points(panel, target, model, p, regs, horizon, scenario, n_splits, None, False, cut=True)
    fc = _named(_with_draws(points, panel, target, p, horizon, n_splits, None), model, p)
    metrics = E.metrics(points.filter(F.col("part") == "test").withColumn("model", F.lit(model)), by=(KEY, "model", "fold"))
    return fc, metrics, screened
