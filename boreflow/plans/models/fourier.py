"""M5: piecewise-linear trend + Fourier yearly/weekly seasonality, additive or multiplicative.

The model and its fit are in ``boreflow.functions.trend``: sparse rate changes at 25 changepoints,
Fourier terms (yearly of order 10, weekly of order 3), the posterior mode under the published priors with
the noise variance from the residuals; not draws from the posterior. The band is an 80 % normal band
of the noise and of future rate changes.

Plan: one row per well carries its dates and values (bounded by the calendar) into one kernel that
fits all training parts and candidates; no row is copied per fold, and nothing is joined back: the
test values and dates are slices of the same arrays.

``features`` are the same columns as JVM expressions, ``numpy_features`` the same in NumPy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.functions import trend as TR
from boreflow.functions.trend import N_CHANGEPOINTS, WEEKLY_ORDER, YEARLY_ORDER
from boreflow.operators.clean import KEY, ORDER
from boreflow.plans.models import common as M
from boreflow.plans.series import cut_series, fit_rows
from boreflow.session import apply_recommended_conf


def features(n_changepoints: int = N_CHANGEPOINTS, yearly: int = YEARLY_ORDER, weekly: int = WEEKLY_ORDER) -> tuple[list[Column], list[str]]:
    t = F.col("pos").cast("double") / F.greatest(F.col("train_end"), F.lit(1)).cast("double")
    d = F.datediff(F.col(ORDER), F.to_date(F.lit("1970-01-01"))).cast("double")
    feats: list[Column] = [F.lit(1.0), t]
    kinds = ["const", "trend"]
    for j in range(1, n_changepoints + 1):
        feats.append(F.greatest(t - F.lit(0.8 * j / n_changepoints), F.lit(0.0)))
        kinds.append("hinge")
    for period, order, kind in ((365.25, yearly, "yearly"), (7.0, weekly, "weekly")):
        for k in range(1, order + 1):
            ang = F.lit(2.0 * math.pi * k / period) * d
            feats += [F.sin(ang), F.cos(ang)]
            kinds += [kind, kind]
    return feats, kinds


def numpy_features(n_changepoints: int = N_CHANGEPOINTS, yearly: int = YEARLY_ORDER, weekly: int = WEEKLY_ORDER):
    """The same features as ``features`` built in NumPy from (pos, train_end, days since epoch).

    Used inside the Gram task so only three input columns cross Arrow.
    """
    def build(pos, train_end, d):
        t = pos / np.maximum(train_end, 1.0)
        cols = [np.ones_like(t), t]
        cols += [np.maximum(t - 0.8 * j / n_changepoints, 0.0) for j in range(1, n_changepoints + 1)]
        for period, order in ((365.25, yearly), (7.0, weekly)):
            for k in range(1, order + 1):
                ang = (2.0 * math.pi * k / period) * d
                cols += [np.sin(ang), np.cos(ang)]
        return np.column_stack(cols)

    return build


def feature_inputs() -> list[Column]:
    """The input columns of ``numpy_features``: position, training end, days since 1970-01-01."""
    return [F.col("pos"), F.col("train_end"), F.datediff(F.col(ORDER), F.to_date(F.lit("1970-01-01")))]


def candidates(grid: Iterable[tuple[str, bool, bool]] | None = None, lam: float = 1.0,
               n_changepoints: int = N_CHANGEPOINTS) -> list[M.Candidate]:
    """(mode, yearly, weekly) combinations; default: the full 2 x 2 x 2 space."""
    grid = list(grid) if grid is not None else [
        (m, y, w) for m in ("additive", "multiplicative") for y in (True, False) for w in (True, False)]
    _, kinds = features(n_changepoints)
    out = []
    for mode, yearly, weekly in grid:
        keep = [k in ("const", "trend", "hinge") or (k == "yearly" and yearly) or (k == "weekly" and weekly) for k in kinds]
        pen = [0.0 if k in ("const", "trend") else 1.0 for k in kinds]
        out.append(M.Candidate({"seasonality_mode": mode, "yearly_seasonality": str(yearly).lower(),
                                "weekly_seasonality": str(weekly).lower()}, keep, pen, lam, "ridge",
                               1 if mode == "multiplicative" else 0))
    return out


FIT_T = "array<struct<fold:int,cid:int,fc:array<double>,lo:array<double>,hi:array<double>,delta:array<double>>>"


def trend_udf(cands: list[tuple[bool, bool, bool]], z: float):
    """Pandas UDF ``(values, day numbers, cuts) -> fits``: one row is one series."""

    @F.pandas_udf(FIT_T)
    def run(y: pd.Series, days: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([
            TR.fit_series(np.asarray(v, float), np.asarray(d, float), [tuple(int(c[f]) for f in ("fold", "train_end", "begin", "h")) for c in cl if int(c["train_end"]) >= 1], cands, z)
            for v, d, cl in zip(y, days, cuts, strict=True)])

    return run


def fourier_trend(panel: DataFrame, target: str, horizon: int = 30, cands: list[M.Candidate] | None = None,
                  n_splits: int = 5, holdout: tuple[float, float] | None = None, include_last: bool = False, key: str = KEY) -> DataFrame:
    """Backtest + future forecast for every well and candidate: the ``forecast`` rows plus ``y``.

    A value that is null is left out of the fit; a training part without any value has no rows.
    """
    apply_recommended_conf(panel.sparkSession)
    cands = cands or candidates()
    staged, last = cut_series(panel, target, horizon, n_splits, holdout, include_last, key)
    kinds = [(c.target == 1, c.params["yearly_seasonality"] == "true", c.params["weekly_seasonality"] == "true") for c in cands]
    return fit_rows(staged, trend_udf(kinds, M.Z80)("_y", "_days", "_cuts"), last, [M.param_map(c.params) for c in cands], "Prophet", key)
