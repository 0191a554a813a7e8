"""M8, the slot of the quantile network: pooled quantile regression over the wells' windows.

Coefficients for every class of steps ahead and for the quantiles 0.1, 0.5 and 0.9 are shared by all wells
of a fold (``boreflow.functions.pinball``). A round of the reweighted fit is one pass over the wells' arrays:
each task adds up its wells and sends one small matrix per (fold, class, quantile), the matrices are
summed and solved where they meet, and only the coefficients reach the driver: folds x classes x quantiles
rows of one vector each, whatever the number of wells. The wells' arrays are written once to the
checkpoint folder and read again in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.functions import pinball as PB
from boreflow.operators.clean import KEY
from boreflow.plans.models import common as M
from boreflow.plans.series import cut_series, fit_rows
from boreflow.session import apply_recommended_conf, cut_lineage

N_INPUT = 24
N_OUT = 7
LAM = 1e-3
Coefficients = dict[tuple[int, int, int], np.ndarray]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as float arrays (null elements as NaN)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    cuts = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def pooled_pass(data: DataFrame, sums_of, solve_of) -> Coefficients:
    """One pass over the wells: ``sums_of(wells) -> {(fold, class, part): flat sums}`` is added up and solved per key.

    A task adds up its own wells and sends one row per key; ``solve_of`` turns the total of a key into
    its coefficients, which alone reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Coefficients = {}
        for batch in batches:
            folds = [{int(c["fold"]): int(c["train_end"]) for c in cl} for cl in batch.column("_cuts").to_pylist()]
            wells = zip(_arrays(batch.column("_y")), _arrays(batch.column("_days")), folds, strict=True)
            for key, v in sums_of(wells).items():
                total[key] = v if key not in total else total[key] + v
        if total:
            keys = sorted(total)
            cols = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["fold", "ahead", "part", "v"])

    @F.pandas_udf("array<double>")
    def solved(v: pd.Series) -> pd.Series:
        return pd.Series([solve_of(np.asarray(x, float)).tolist() for x in v])

    sums = data.mapInArrow(partial, "fold int, ahead int, part int, v array<double>")
    met = sums.groupBy("fold", "ahead", "part").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    rows = met.select("fold", "ahead", "part", solved("v").alias("beta")).collect()
    return {(r.fold, r.ahead, r.part): np.array(r.beta) for r in rows}


def fit_round(data: DataFrame, n_input: int, ahead: list[tuple[int, int]], lam: float, betas: Coefficients | None, floor: float) -> Coefficients:
    """Coefficients of one reweighted pass over the wells (a plain ridge pass without earlier ones)."""
    return pooled_pass(data, lambda wells: PB.partial_sums(wells, n_input, ahead, betas, floor), lambda v: PB.solve(v, n_input, lam))


def spread_wells(panel: DataFrame, target: str, n_out: int, horizon: int, n_splits: int, holdout: tuple[float, float] | None,
                 include_last: bool, key: str) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """(the wells' arrays in the checkpoint folder, number of the final fit, classes of steps ahead)."""
    staged, last = cut_series(panel, target, horizon, n_splits, holdout, include_last, key)
    # the windows are the work here, not the bytes of the arrays: spread the wells
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    staged = cut_lineage(staged.repartition(n, key))
    reach = F.array_max(F.transform("_cuts", lambda c: c["begin"] + c["h"] - c["train_end"]))
    return staged, last, PB.classes(n_out, staged.agg(F.max(reach)).first()[0] or 1)


def fit_quantiles(data: DataFrame, n_input: int, ahead: list[tuple[int, int]], lam: float = LAM) -> Coefficients:
    """{(fold, class, quantile index): coefficients} after the ridge start and ROUNDS reweighted rounds."""
    start = fit_round(data, n_input, ahead, lam, None, 1.0)
    betas = {(f, s, j): b for (f, s, _), b in start.items() for j in range(len(PB.QUANTILES))}
    for number in range(PB.ROUNDS if betas else 0):
        betas = fit_round(data, n_input, ahead, lam, betas, PB.floor_of(number))
    return betas


def quantile_forecast(panel: DataFrame, target: str, horizon: int = 30, n_input: int = N_INPUT, n_out: int = N_OUT, lam: float = LAM,
                      n_splits: int = 5, holdout: tuple[float, float] | None = None, include_last: bool = False, key: str = KEY) -> DataFrame:
    """Median forecast with its 0.1-0.9 band, for the backtest and the future.

    Windows of all wells train one set of coefficients per fold, each window divided by its own mean
    absolute input, so a well with little history borrows from the others. The first ``n_out`` steps
    have coefficients of their own, later ones share those of longer classes. A fold in which no well has a whole window
    carries the last value on, without a band.
    """
    apply_recommended_conf(panel.sparkSession)
    staged, last, ahead = spread_wells(panel, target, n_out, horizon, n_splits, holdout, include_last, key)
    betas = fit_quantiles(staged, n_input, ahead, lam)

    @F.pandas_udf("array<struct<fold:int,cid:int,fc:array<double>,lo:array<double>,hi:array<double>>>")
    def run(y: pd.Series, days: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for v, d, cl in zip(y, days, cuts, strict=True):
            fits = []
            for c in cl:
                fold, end, begin, h = (int(c[f]) for f in ("fold", "train_end", "begin", "h"))
                if end >= 1:
                    mid, lo, hi = PB.predict(np.asarray(v, float), np.asarray(d, float), end, begin, h, fold, n_input, ahead, betas)
                    band = [None if np.isnan(x).any() else x.tolist() for x in (lo, hi)]
                    fits.append({"fold": fold, "cid": 0, "fc": mid.tolist(), "lo": band[0] or [None] * h, "hi": band[1] or [None] * h})
            out.append(fits)
        return pd.Series(out)

    params = M.param_map({"n_input": str(n_input), "n_out": str(n_out), "lam": repr(float(lam))})
    return fit_rows(staged, run("_y", "_days", "_cuts"), last, [params], "TFT", key)
