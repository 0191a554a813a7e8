"""M9 sampled paths and U3 bootstrap bands.

M9 (the probabilistic-forecaster slot): ``n_paths`` bootstrap random walks per (well, fold). Step
``j`` of path ``p`` adds one of the training series' day-to-day changes; which one is drawn by an
integer recurrence of (seed, fold, path, step), so draws depend neither on partitioning nor on
retries and any engine can repeat them. Quantiles 0.1 / 0.5 / 0.9 over the paths per step give
``yhat_lower`` / ``yhat`` / ``yhat_upper`` (U2).

U3: the same draws (default 500) around any point forecast: 5 % / 95 % quantiles of the
cumulative change at each step, added to ``yhat``.

One Arrow row per (well, fold) carries the changes in and the quantiles of every step out; paths
are added up in blocks of steps, so neither paths nor draws ever become rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.backtest import backtest_rows, split_bounds
from boreflow.operators.clean import KEY
from boreflow.plans.series import series_arrays
from boreflow.session import reuse

N_PATHS = 20
N_DRAWS = 500
STEPS = 256  # steps added up at once
PRIME = 2_147_483_647


@functools.lru_cache(maxsize=64)
def draws(seed: int, fold: int, n_paths: int, begin: int, end: int) -> np.ndarray:
    """The drawn numbers of all paths (rows) and of the steps begin..end - 1; the same for every well."""
    p, j = np.arange(1, n_paths + 1)[:, None], np.arange(begin, end)[None, :]
    h = (p * 7919 + j * 104_729 + p * j * 31 + fold * 15_485_863 + seed * 32_452_843) % PRIME
    h = h * 48_271 % PRIME
    return h * h % PRIME


def path_quantiles(changes: np.ndarray, h: int, n_paths: int, seed: int, fold: int, qs: tuple[float, ...]) -> np.ndarray:
    """Quantiles (rows) of the paths' cumulative change at steps 1..h; no change at all gives zeros."""
    out = np.zeros((len(qs), h))
    if not len(changes):
        return out
    at = np.zeros(n_paths)
    for a in range(0, h, STEPS):
        n = min(STEPS, h - a)
        picked = draws(seed, fold, n_paths, a + 1, a + STEPS + 1)[:, :n] % len(changes)
        moved = at[:, None] + np.cumsum(changes[picked], axis=1)
        out[:, a : a + n] = np.quantile(moved, qs, axis=0)
        at = moved[:, -1]
    return out


def _band(panel: DataFrame, target: str, n_paths: int, seed: int, qs: tuple[float, ...], horizon: int, n_splits: int,
          holdout: tuple[float, float] | None, key: str) -> DataFrame:
    """Per (well, fold) with forecast rows: the last training value with one quantile array per q.

    The folds are cut from the one array of each well; nothing is computed before the band is read.
    """
    ser = series_arrays(panel, [target], key)
    bounds, final = split_bounds(F.col("n"), n_splits, holdout)
    if horizon <= 0:
        bounds = F.filter(bounds, lambda b: b["fold"] < final)
    cut = ser.select(key, F.col(target).alias("_arr"), F.explode(bounds).alias("_b"))
    cut = cut.filter((F.col("_b.fold") == final) | (F.col("_b.test_end") > F.col("_b.test_start")))
    ahead = F.when(F.col("_b.fold") == final, F.lit(max(horizon, 0))).otherwise(F.col("_b.test_end") - F.col("_b.train_end"))
    base = cut.select(key, F.col("_b.fold").alias("fold"), ahead.cast("int").alias("h"),
                      F.slice("_arr", F.lit(1), F.greatest(F.col("_b.train_end"), F.lit(0))).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, bands = [], [[] for _ in qs]
            for fold, h, y in zip(*(batch.column(c).to_pylist() for c in ("fold", "h", "train")), strict=True):
                last.append(y[-1] if y else None)
                for b, q in zip(bands, path_quantiles(np.diff(np.array(y, float)), h, n_paths, seed, fold, qs), strict=True):
                    b.append(q)
            cols = [batch.column(key), batch.column("fold"), pa.array(last, pa.float64()), *(pa.array(b, pa.list_(pa.float64())) for b in bands)]
            yield pa.record_batch(cols, names=[key, "fold", "last", *(f"q{k}" for k in range(len(qs)))])

    # The paths are the work here, not the bytes: spread the rows instead of packing them by size.
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    schema = f"{key} string, fold int, last double, " + ", ".join(f"q{k} array<double>" for k in range(len(qs)))
    return base.repartition(n, key, "fold").mapInArrow(run, schema)


def _at(name: str) -> Column:
    return F.get(name, F.col("step") - 1)


def sample_paths(panel: DataFrame, target: str, horizon: int = 30, n_paths: int = N_PATHS, seed: int = 42,
                 n_splits: int = 5, holdout: tuple[float, float] | None = None, include_last: bool = False,
                 key: str = KEY) -> DataFrame:
    """M9: quantile forecast from ``n_paths`` bootstrap random walks (one value: it is repeated)."""
    panel = reuse(panel)  # the rows and the band both read it
    pred = backtest_rows(panel, target, [], n_splits, horizon, None, include_last, holdout, key).filter(F.col("part") != "train")
    band = _band(panel, target, n_paths, seed, (0.1, 0.5, 0.9), horizon, n_splits, holdout, key)
    out = pred.join(band, [key, "fold"])
    params = F.create_map(F.lit("n_paths"), F.lit(str(n_paths)), F.lit("seed"), F.lit(str(seed)))
    at = [(F.col("last") + _at(f"q{k}")) for k in range(3)]
    return out.select(key, "fold", "part", "ds", "pos", "train_end", "step", "y", params.alias("params"),
                      at[1].alias("yhat"), at[0].alias("yhat_lower"), at[2].alias("yhat_upper"), F.lit("Chronos").alias("model"))


def bootstrap_band(fc: DataFrame, panel: DataFrame, target: str, n_draws: int = N_DRAWS, seed: int = 7,
                   qs: tuple[float, float] = (0.05, 0.95), horizon: int = 30, n_splits: int = 5,
                   holdout: tuple[float, float] | None = None, key: str = KEY) -> DataFrame:
    """Replace the band of ``fc`` by 5 % / 95 % bootstrap quantiles around its ``yhat``."""
    band = _band(panel, target, n_draws, seed, qs, horizon, n_splits, holdout, key)
    out = fc.drop("yhat_lower", "yhat_upper").join(band.drop("last"), [key, "fold"], "left")
    return out.withColumns({"yhat_lower": F.col("yhat") + _at("q0"), "yhat_upper": F.col("yhat") + _at("q1")}).drop("q0", "q1")
