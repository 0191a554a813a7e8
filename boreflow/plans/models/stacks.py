"""M8, the slot of the residual-stack network: pooled trend, season and lag blocks.

``boreflow.functions.stacks`` has the blocks. Each block is fitted by one pass over the wells' arrays on
the residual of the blocks before it, so three passes fit all folds and classes of steps; only the
blocks' weights reach the driver, as many as folds x classes x blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.functions import stacks as ST
from boreflow.operators.clean import KEY
from boreflow.plans.models import common as M
from boreflow.plans.models.quantile import pooled_pass, spread_wells
from boreflow.plans.series import fit_rows
from boreflow.session import apply_recommended_conf

N_INPUT = 24
N_OUT = 7
LAM = 1e-3


def fit_stacks(data: DataFrame, n_input: int, ahead: list[tuple[int, int]], lam: float = LAM) -> ST.Weights:
    """{(fold, class, block): weights}, block after block."""
    weights: ST.Weights = {}
    for block in range(len(ST.BLOCKS)):
        known = dict(weights)
        weights |= pooled_pass(data, lambda wells, b=block, w=known: ST.partial_sums(wells, n_input, ahead, b, w), lambda v: ST.solve(v, lam))
    return weights


def stack_forecast(panel: DataFrame, target: str, horizon: int = 30, n_input: int = N_INPUT, n_out: int = N_OUT, lam: float = LAM,
                   n_splits: int = 5, holdout: tuple[float, float] | None = None, include_last: bool = False, key: str = KEY) -> DataFrame:
    """Backtest + future forecast of every well from the blocks all wells share; the bounds are null.

    The first ``n_out`` steps have weights of their own, later ones those of longer classes. A fold in
    which no well has a whole window carries the last value on.
    """
    apply_recommended_conf(panel.sparkSession)
    staged, last, ahead = spread_wells(panel, target, n_out, horizon, n_splits, holdout, include_last, key)
    weights = fit_stacks(staged, n_input, ahead, lam)

    @F.pandas_udf("array<struct<fold:int,cid:int,fc:array<double>,lo:array<double>,hi:array<double>>>")
    def run(y: pd.Series, days: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for v, d, cl in zip(y, days, cuts, strict=True):
            fits = []
            for c in cl:
                fold, end, begin, h = (int(c[f]) for f in ("fold", "train_end", "begin", "h"))
                if end >= 1:
                    fc, _ = ST.predict(np.asarray(v, float), np.asarray(d, float), end, begin, h, fold, n_input, ahead, weights)
                    fits.append({"fold": fold, "cid": 0, "fc": fc.tolist(), "lo": [None] * h, "hi": [None] * h})
            out.append(fits)
        return pd.Series(out)

    params = M.param_map({"n_input": str(n_input), "n_out": str(n_out), "lam": repr(float(lam))})
    return fit_rows(staged, run("_y", "_days", "_cuts"), last, [params], "N-BEATS", key)
