"""Registered queries: one per operator of the inventory, each over the whole given tables.

Every query starts from the raw main panel (lineitem by return flag and line status, on a
daily grid) unless it says otherwise. Double outputs are rounded for engine-independent
comparison with the SQL oracle in ``boreflow.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.operators import clean as C
from boreflow.operators import evaluate as E
from boreflow.operators import segments as SG
from boreflow.plans.models import ets
from boreflow.plans.series import series_arrays
from boreflow.sources import testpanel as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
P = T.PARAMS


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.main_panel(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str, method: str = "interpolate") -> DataFrame:
    """C1 -> C2 (or C3) -> C4 -> C5 -> C6 on all parameters, target ``qty``."""
    return C.clean(raw(spark, sf_dir), P, method=method, target=T.TARGET)


def _rounded(c: str, digits: int) -> F.Column:
    """``F.round`` of a double, half up on its shortest decimal, without a decimal number per row.

    A value scaled by ``10^digits`` whose distance from a half is above the error of the scaling has one
    nearest integer; the others, and values too large for that, take Spark's own way.
    """
    x, scale = F.col(c), F.lit(10.0**digits)
    scaled = x * scale
    near = F.rint(scaled)
    clear = (F.abs(scaled) < 2.0**50) & (F.abs(scaled - near) < F.lit(0.499) - F.abs(scaled) * F.lit(2.0**-51))
    return F.when(clear, near / scale + F.lit(0.0)).otherwise(F.round(x, digits)).alias(c)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns({c: _rounded(c, digits) if k == "double" else F.round(c, digits) for c, k in kinds.items() if k in ("double", "float")})


# ---------------------------------------------------------------- minimum slice
@register("m1_ets_holdout")
def m1_ets_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean -> holdout (70 % train, last 5 % test) -> ETS(0.3, 0.1) -> align -> RMSE/MAE/MAPE."""
    ser = series_arrays(cleaned(spark, sf_dir), [T.TARGET])
    ser = ser.withColumns({"trn": F.floor(F.col("n") * 0.7).cast("int"), "te": F.floor(F.col("n") * 0.95).cast("int")})
    st = ets.ets_states(ser, T.TARGET, [(0.3, 0.1)], F.array("trn"))
    fc = st.select(
        "well", "cut", "level", "season", "te",
        F.posexplode(F.slice(T.TARGET, F.col("te") + 1, F.col("n") - F.col("te"))).alias("i", "y"),
    )
    fc = fc.withColumn("yhat", ets.ets_point(F.col("level"), F.col("season"), F.col("te") + F.col("i") - F.col("cut") + 1))
    out = E.metrics(fc.withColumn("model", F.lit("ETS")), by=("well", "model"))
    return _r(out.select("well", "model", "n", "rmse", "mae", "mape"))


# ---------------------------------------------------------------- sources and reshapes
from boreflow.sources import sheets as S  # noqa: E402


# The user's column list of the wide layouts: return flag by line status.
WELLS = [f + s for f in "ANR" for s in "FO"]


@register("s1_read_sheets")
def s1_read_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw panel as one CSV sheet per parameter (dates down, wells across) into the
    checkpoint folder, then read the sheets back with the CSV source."""
    import uuid

    from boreflow.session import cut_lineage, ensure_checkpoint_dir

    rp = cut_lineage(raw(spark, sf_dir))  # aggregated once, laid out once per parameter
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    paths = {}
    for p in P:
        sheet = rp.groupBy("ds").pivot("well", WELLS).agg(F.max(p))  # one cell per (ds, well)
        sheet.write.option("header", "true").csv(f"{root}/{p}")
        paths[p] = f"{root}/{p}"
    return _r(S.read_sheets(spark, paths, fmt="csv", date_col="ds"))


@register("s2_catalog")
def s2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.catalog(T.to_long(raw(spark, sf_dir), P))


@register("s3_select_series")
def s3_select_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's pick: wells NO and RF, parameters qty and disc."""
    return _r(S.select_series(raw(spark, sf_dir), ["NO", "RF"], ["qty", "disc"]))


@register("s4_to_panel")
def s4_to_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(S.to_panel(T.to_long(raw(spark, sf_dir), P), P))


@register("s5_to_wide")
def s5_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rp = raw(spark, sf_dir)
    cols = [(p, w) for p in P for w in WELLS]
    return _r(S.to_wide(T.to_long(rp, P), cols))


@register("s8_preview")
def s8_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(S.preview(raw(spark, sf_dir), 50))


@register("s9_series_long")
def s9_series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(S.series_long(cleaned(spark, sf_dir), P))


# ---------------------------------------------------------------- cleaning
@register("c1_null_blanks_zeros")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.null_blanks_zeros(raw(spark, sf_dir), P))


@register("c2_interpolate")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.interpolate(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c3_fill_median")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.fill_median(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c4_drop_nulls")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.drop_nulls(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c5_nonzero_target")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target ``disc`` on the raw panel (it has real zero days)."""
    return _r(C.nonzero_target(raw(spark, sf_dir), "disc"))


@register("c6_ffill")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.ffill(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c2_interpolate_segments")
def c2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 with every well cut into yearly segments: no task holds a whole well."""
    return _r(SG.interpolate(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c6_ffill_segments")
def c6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(SG.ffill(C.null_blanks_zeros(raw(spark, sf_dir), P), P))


@register("c8_time_index_segments")
def c8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SG.time_index(cleaned(spark, sf_dir)).select("well", "well_id", "ds", "time_idx")


@register("c7_missing_profile")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.missing_profile(raw(spark, sf_dir), P))


@register("c8_time_index")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.time_index(cleaned(spark, sf_dir)).select("well", "well_id", "ds", "time_idx")


@register("c9_to_float")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_float(_r(cleaned(spark, sf_dir)), P)


@register("c10_rename")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.rename(cleaned(spark, sf_dir), {"qty": "y"}))


@register("c_clean_median")
def c_clean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with the median fill instead of interpolation."""
    return _r(cleaned(spark, sf_dir, method="median"))


# ---------------------------------------------------------------- screening
from boreflow.operators import screen as F_  # noqa: E402

REGS = [p for p in P if p != T.TARGET]


@register("f1_acf")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.acf(cleaned(spark, sf_dir), P))


@register("f2_acf_screen")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.acf_screen(F_.acf(cleaned(spark, sf_dir), P)))


@register("f3_corr")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.corr_with_target(cleaned(spark, sf_dir), T.TARGET, REGS))


@register("f4_corr_screen")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.corr_screen(F_.corr_with_target(cleaned(spark, sf_dir), T.TARGET, REGS)))


@register("f5_corr_ranking")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.corr_ranking(F_.corr_with_target(cleaned(spark, sf_dir), T.TARGET, REGS)))


@register("f6_spearman")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rho and t (SQL-checked); the p-value is checked by ``f6_spearman_p`` and pytest."""
    return _r(F_.spearman(cleaned(spark, sf_dir), T.TARGET, REGS).drop("p"))


@register("f6_spearman_p")
def f6p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.spearman(cleaned(spark, sf_dir), T.TARGET, REGS))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned supplier panel, where a good part of the regressors pass the screening.

    Values are rounded, so that equal readings tie whatever the order their averages were added in.
    """
    return _r(C.clean(T.scale_panel(spark, sf_dir), P, target=T.TARGET), 9)


@register("f7_significant")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F_.significant(F_.screen(suppliers(spark, sf_dir), T.TARGET, REGS))


@register("f_screen")
def f_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(F_.screen(suppliers(spark, sf_dir), T.TARGET, REGS))


# ---------------------------------------------------------------- splits, folds, alignment
from boreflow.operators import backtest as BT  # noqa: E402
from boreflow.operators import bands as U  # noqa: E402
from boreflow.operators import folds as B  # noqa: E402
from boreflow.operators import scenario as H  # noqa: E402
from boreflow.operators import windows as W  # noqa: E402

KEEP = ["well", "ds", "qty"]


@register("b1_holdout")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.holdout(cleaned(spark, sf_dir).select(*KEEP), 0.7, 0.95))


@register("b2_expanding_folds")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(B.expanding_folds(cleaned(spark, sf_dir).select(*KEEP), 5))


@register("b3_fold_sizes")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold_sizes(B.expanding_folds(cleaned(spark, sf_dir).select(*KEEP), 5))


def _baseline(spark: SparkSession, sf_dir: str, horizon: int = 0) -> DataFrame:
    rows = BT.backtest_rows(cleaned(spark, sf_dir), T.TARGET, [], 5, horizon)
    return BT.last_value_forecast(rows)


@register("b4_align")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test actuals of the 5 folds paired with the last-value forecast on (well, fold, step)."""
    fc = _baseline(spark, sf_dir)
    actual = fc.select("well", "fold", "step", "ds", "y")
    return _r(B.align(actual, fc.select("well", "fold", "step", "yhat")))


# ---------------------------------------------------------------- windows to arrays
def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.time_index(cleaned(spark, sf_dir)).select("well", "ds", "time_idx", "qty")


@register("w1_supervised")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.supervised(cleaned(spark, sf_dir), T.TARGET, 14, 7)
    rnd = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.withColumns({"x": rnd("x"), "y": rnd("y")})


@register("w1_supervised_segments")
def w1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 by segments and blocks of positions."""
    out = SG.supervised(cleaned(spark, sf_dir), T.TARGET, 14, 7)
    rnd = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return out.withColumns({"x": rnd("x"), "y": rnd("y")})


@register("w2_encoder_tail")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(W.encoder_tail(_indexed(spark, sf_dir), 30))


@register("w3_decoder_rows")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(W.decoder_rows(_indexed(spark, sf_dir), 30))


@register("w4_prediction_frame")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(W.prediction_frame(_indexed(spark, sf_dir), 30, 30))


# ---------------------------------------------------------------- future frame and scenario
@register("h1_future_dates")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.future_dates(cleaned(spark, sf_dir), 30, include_last=True)


@register("h2_carry_last")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cl = cleaned(spark, sf_dir)
    return _r(H.carry_last(H.future_dates(cl, 30), cl, REGS))


@register("h3_ramp")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario: ``price`` rises by 5,000 over 30 days; other regressors stay at their last value."""
    return _r(H.scenario_frame(cleaned(spark, sf_dir), REGS, "price", 5000.0, 30))


@register("h4_ramp_series")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(H.ramp_series(cleaned(spark, sf_dir), "disc", -0.02, 30))


# ---------------------------------------------------------------- evaluation and assembly
@register("e1_e3_metrics")
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE, MAE, MAPE per well and fold of the last-value baseline."""
    return _r(E.metrics(_baseline(spark, sf_dir), by=("well", "model", "fold")))


@register("e4_last_fold")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.last_fold(E.metrics(_baseline(spark, sf_dir), by=("well", "model", "fold"))))


@register("e8_combine")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last fold's test forecast and the 30-day future forecast in one table."""
    fc = _baseline(spark, sf_dir, 30)
    test = fc.filter("part = 'test' AND fold = 4").select("well", "ds", "step", "y", "yhat", "part")
    fut = fc.filter("part = 'future'").select("well", "ds", "step", "yhat", "part")
    return _r(E.combine(test, fut))


@register("e9_attach_regressors")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cl = cleaned(spark, sf_dir)
    fc = _baseline(spark, sf_dir, 30).filter("part = 'future' OR fold = 4").select("well", "ds", "step", "yhat")
    return _r(E.attach_regressors(fc, cl, REGS))


@register("e10_chart_feed")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cl = cleaned(spark, sf_dir)
    fc = U.normal_band(
        _baseline(spark, sf_dir, 30).filter("part = 'future'"),
        _baseline(spark, sf_dir).withColumn("err", F.col("y") - F.col("yhat")).filter("fold = 4"))
    ramp = H.ramp_series(cl, "price", 5000.0, 30)
    return _r(E.chart_feed(cl, fc, T.TARGET, ramp, ["price"]))


# ---------------------------------------------------------------- bands
@register("u1_normal_band")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-value forecast +- 1.96 x population sd of that fold's test errors."""
    fc = _baseline(spark, sf_dir)
    resid = fc.withColumn("err", F.col("y") - F.col("yhat"))
    return _r(U.normal_band(fc, resid, by=("well", "fold")).select("well", "fold", "step", "ds", "yhat", "yhat_lower", "yhat_upper"))


@register("u1_conformal_band")
def u1_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-value forecast with the band that held 80 % of the errors of earlier folds, per class of steps."""
    fc = U.conformal_band(_baseline(spark, sf_dir, 30), 0.8)
    return _r(fc.select("well", "fold", "part", "step", "ds", "yhat", "yhat_lower", "yhat_upper"))


@register("u1_conformal_coverage")
def u1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often that band held, per fold and class of steps."""
    fc = U.conformal_band(_baseline(spark, sf_dir), 0.8).withColumn("steps", U.step_class(F.col("step")))
    return _r(U.coverage(fc, by=("model", "fold", "steps")))


@register("u1_coverage_by_model")
def u1_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each model's own band and of the calibrated one at 0.8, per fold."""
    cl = cut_lineage(cleaned(spark, sf_dir))
    out = None
    for model in ("ETS", "Prophet", "Chronos", "LSTM", "TFT"):
        fc = cut_lineage(FC.forecast(cl, T.TARGET, model, horizon=0, params={"n_bootstrap_draws": 0} if model == "ETS" else None))
        own = U.coverage(fc).withColumn("band", F.lit("own"))
        both = own.unionByName(U.coverage(U.conformal_band(fc, 0.8)).withColumn("band", F.lit("calibrated")))
        out = both if out is None else out.unionByName(both)
    return _r(out)


@register("u2_quantile_band")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles 0.1 / 0.5 / 0.9 of the target per well and weekday (a seasonal profile band)."""
    cl = cleaned(spark, sf_dir).select("well", F.dayofweek("ds").alias("dow"), F.col("qty").alias("value"))
    return _r(U.quantile_band(cl, ["well", "dow"]))


@register("u4_optional_band")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    fc = _baseline(spark, sf_dir, 30).filter("part = 'future'").select("well", "ds", "step", "yhat")
    return _r(U.with_optional_band(fc, None, ["well", "step"]))


# ---------------------------------------------------------------- forecasters (rows-only + pytest)
from boreflow.plans import forecast as FC  # noqa: E402
from boreflow.plans import tune as TU  # noqa: E402
from boreflow.plans.models import lags as LG  # noqa: E402
from boreflow.plans.models import smoothing as SM  # noqa: E402
from boreflow.session import cut_lineage  # noqa: E402
from boreflow.sources import history as HI  # noqa: E402

ETS_WEIGHTS = {"alpha": 0.1, "gamma": 0.05}
FC_COLS = ["well", "model", "fold", "part", "ds", "step", "y", "yhat", "yhat_lower", "yhat_upper"]
SCENARIO = ("price", 5000.0)


def _fc(spark: SparkSession, sf_dir: str, model: str, params: dict | None = None, digits: int = 6) -> DataFrame:
    """Backtest (5 folds) + 30-day future forecast of one model on the cleaned main panel."""
    fc = FC.forecast(cleaned(spark, sf_dir), T.TARGET, model, REGS, 30, SCENARIO, params)
    return _r(fc.select(*FC_COLS), digits)  # fold 5 is the final fit with the future rows


@register("m1_ets")
def m1_ets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETS with given weights and its normal band."""
    return _fc(spark, sf_dir, "ETS", {**ETS_WEIGHTS, "n_bootstrap_draws": 0})


@register("m1_ets_fitted")
def m1_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETS with the weights fitted to each well and training part, which the rows name."""
    fc = FC.forecast(cleaned(spark, sf_dir), T.TARGET, "ETS", REGS, 30, params={"n_bootstrap_draws": 0})
    p = F.col("params")
    return _r(fc.select(*FC_COLS, *[p[k].cast("double").alias(k) for k in ("alpha", "gamma")], (p["converged"] == "true").alias("converged")))


@register("m1_fit_against_draws")
def m1_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step training RMSE of the fitted weights next to the best of 50 draws, per well and training part.

    Both come from the one pass of each series that the fits share; the fitted one may never be larger.
    """
    cl = cut_lineage(cleaned(spark, sf_dir))
    draws = [{k: v for k, v in t.items()} for t in TU.draw(TU.SPACES["ETS"], 50, 42)]
    by = ("well", "fold")
    best = SM.training_error(cl, T.TARGET, "ets", grid=draws).groupBy(*by).agg(F.min("rmse").alias("best_of_50"))
    mine = SM.training_error(cl, T.TARGET, "ets", fixed={}).select(*by, "n_fit", F.col("rmse").alias("fitted"))
    both = mine.join(best, [*by])
    return _r(both.select(*by, "n_fit", "best_of_50", (F.col("fitted") <= F.col("best_of_50") * (1 + 1e-9)).alias("no_worse")))


for _name, _model in (("m2_dlt", "DLT"), ("m3_lgt", "LGT"), ("m4_ktr", "KTR"),
                      ("m5_fourier_trend", "Prophet"), ("m8_pooled_direct", "N-BEATS"),
                      ("m9_sample_paths", "Chronos"), ("m10_forecast_tft", "TFT")):
    REGISTRY[_name] = (lambda m: lambda spark, sf_dir: _fc(spark, sf_dir, m))(_model)


DLT_WEIGHTS = {"alpha": 0.3, "beta": 0.1, "gamma": 0.1, "phi": 0.9}
LGT_WEIGHTS = {"alpha": 0.3, "beta": 0.1, "gamma": 0.1, "xi1": 0.5, "xi2": 0.01, "lam": 0.5}


@register("m2_dlt_values")
def m2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DLT with given weights and its own band; rounded to 2 digits, as SQL solves the systems by another elimination."""
    return _fc(spark, sf_dir, "DLT", {**DLT_WEIGHTS, "n_bootstrap_draws": 0}, digits=2)


@register("m3_lgt_values")
def m3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LGT with given weights, likewise."""
    return _fc(spark, sf_dir, "LGT", {**LGT_WEIGHTS, "n_bootstrap_draws": 0}, digits=2)


@register("m4_ktr_values")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KTR with its own band; rounded to 2 digits, as SQL solves the systems by another elimination."""
    return _fc(spark, sf_dir, "KTR", {"n_bootstrap_draws": 0}, digits=2)


@register("m6_lag_regression")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to 2 digits: SQL solves the same systems by another elimination, so the last digits differ."""
    return _fc(spark, sf_dir, "LSTM", digits=2)


@register("m8_pooled_lag")
def m8_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled lag ridge that tunes the window shapes of TFT and N-BEATS."""
    fc = LG.lag_forecast(cleaned(spark, sf_dir), T.TARGET, 30, 24, 7, "pooled", 0.1)
    return _r(fc.select(*FC_COLS), 2)


@register("m7_rollout")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fc(spark, sf_dir, "LSTM", {"mode": "recursive"}, digits=2)


@register("m10_run_dlt")
def m10_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run on the supplier panel: clean -> screen -> DLT with the relevant regressors -> fold metrics."""
    _, met, _ = FC.run(T.scale_panel(spark, sf_dir), T.TARGET, "DLT", P, 30, SCENARIO)
    return _r(met)


@register("m10_run_scenario")
def m10_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scenario changes: future rows of the run with the price ramp, less those without it."""
    cl = suppliers(spark, sf_dir)
    panel = FC.mask_regressors(cl, F_.screen(cl, T.TARGET, REGS), "LGT", REGS)
    # No fit depends on the scenario, and the future rows of both forecasts are those of the final fit.
    own = {"n_bootstrap_draws": 0}
    fits = cut_lineage(FC.fitted(panel, T.TARGET, "LGT", REGS, 30, own).filter(F.col("fold") == BT.N_SPLITS))
    with_, without = (FC.forecast(panel, T.TARGET, "LGT", REGS, 30, s, own, fits=fits).filter("part = 'future'").select(
        "well", "ds", "step", F.col("yhat").alias(n)) for s, n in ((SCENARIO, "yhat_ramp"), (None, "yhat_flat")))
    return _r(with_.join(without, ["well", "ds", "step"]).withColumn("lift", F.col("yhat_ramp") - F.col("yhat_flat")))


@register("u3_bootstrap_band")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETS with its 5 % / 95 % band from 500 bootstrap draws."""
    return _fc(spark, sf_dir, "ETS", {"n_bootstrap_draws": 500})


@register("u3_bootstrap_band_20")
def u3_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same band from 20 draws, few enough for SQL to repeat every path."""
    return _fc(spark, sf_dir, "ETS", {**ETS_WEIGHTS, "n_bootstrap_draws": 20})


# ---------------------------------------------------------------- tuning and history
@register("e5_tune_ets")
def e5_ets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TU.tune(cleaned(spark, sf_dir), T.TARGET, "ETS", 50)
    return _r(t.select("well", "trial", *[F.col("params")[k].cast("double").alias(k) for k in ("alpha", "gamma")], "n", "rmse", "mae", "mape"))


@register("e5_tune_dlt")
def e5_dlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "DLT", 50, regressors=REGS))


@register("e5_tune_prophet")
def e5_prophet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "Prophet", 50))


@register("e5_tune_lgt")
def e5_lgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "LGT", 50, regressors=REGS))


@register("e5_tune_ktr")
def e5_ktr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "KTR", 50, regressors=REGS))


@register("e5_tune_lstm")
def e5_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "LSTM", 50))


@register("e5_tune_tft")
def e5_tft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "TFT", 50))


@register("e5_tune_nbeats")
def e5_nbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "N-BEATS", 50))


@register("e5_tune_chronos")
def e5_chronos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(TU.tune(cleaned(spark, sf_dir), T.TARGET, "Chronos", 50))


@register("e7_tune_then_run")
def e7_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tune ETS per well, then backtest every well with its own tuned parameters: fold metrics."""
    from boreflow.session import cut_lineage

    cl = cut_lineage(cleaned(spark, sf_dir))
    tuned = TU.tune(cl, T.TARGET, "ETS", 50)
    fc = TU.forecast_tuned(cl, T.TARGET, "ETS", tuned, 50, horizon=0).filter(F.col("part") == "test")
    met = E.metrics(fc.withColumns({k: F.col("params")[k].cast("double") for k in ("alpha", "gamma")}), by=("well", "trial", "alpha", "gamma", "fold"))
    return _r(met)


def _adaptive(model: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _r(TU.tune_adaptive(cut_lineage(cleaned(spark, sf_dir)), T.TARGET, model, regressors=REGS))

    return query


# the search that learns from its earlier trials: 25 fits a well (Prophet: its 8 settings, Chronos: its 4)
for _name, _model in (("ets", "ETS"), ("dlt", "DLT"), ("lgt", "LGT"), ("ktr", "KTR"), ("prophet", "Prophet"), ("chronos", "Chronos")):
    REGISTRY[f"e5_adaptive_{_name}"] = _adaptive(_model)


@register("e5_adaptive_then_run")
def e5_adaptive_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive DLT tuning per well, then the 5-fold backtest of every well with its own weights: fold metrics."""
    cl = cut_lineage(cleaned(spark, sf_dir))
    tuned = TU.tune_adaptive(cl, T.TARGET, "DLT", regressors=REGS)
    fc = TU.forecast_tuned(cl, T.TARGET, "DLT", tuned, regressors=REGS, horizon=0).filter(F.col("part") == "test")
    return _r(E.metrics(fc, by=("well", "model", "trial", "fold")))


ETS_GRID = [(a, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for g in (0.05, 0.2)]


def _ets_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out RMSE/MAE/MAPE of every ETS grid point (JVM ``aggregate`` recursion)."""
    ser = series_arrays(cleaned(spark, sf_dir), [T.TARGET])
    ser = ser.withColumns({"trn": F.floor(F.col("n") * 0.7).cast("int"), "te": F.floor(F.col("n") * 0.95).cast("int")})
    st = ets.ets_states(ser, T.TARGET, ETS_GRID, F.array("trn"))
    fc = st.select("well", "alpha", "gamma", "cut", "level", "season", "te",
                   F.posexplode(F.slice(T.TARGET, F.col("te") + 1, F.col("n") - F.col("te"))).alias("i", "y"))
    fc = fc.withColumn("yhat", ets.ets_point(F.col("level"), F.col("season"), F.col("te") + F.col("i") - F.col("cut") + 1))
    return E.metrics(fc, by=("well", "alpha", "gamma"))


@register("e5_tune_ets_grid")
def e5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best (alpha, gamma) per well by hold-out RMSE over a 5 x 2 grid (ties: smaller alpha, gamma)."""
    best = E.rank_by(_ets_grid_scores(spark, sf_dir), "rmse", ("well",), tie=("alpha", "gamma"))
    return _r(best.select("well", "alpha", "gamma", "n", "rmse", "mae", "mape"))


@register("e7_best_params")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuned grid point as a parameter map over the model's defaults."""
    best = E.rank_by(_ets_grid_scores(spark, sf_dir), "rmse", ("well",), tie=("alpha", "gamma"))
    tuned = best.select("well", F.create_map(F.lit("alpha"), F.col("alpha").cast("string"),
                                             F.lit("gamma"), F.col("gamma").cast("string")).alias("params"))
    out = E.best_params(tuned, FC.DEFAULTS["ETS"])
    return out.select("well", *[F.col("params")[k].alias(k) for k in ("alpha", "gamma", "n_bootstrap_draws")])


def _history(spark: SparkSession, sf_dir: str) -> str:
    """Two runs on the cleaned main panel appended to a fresh history: two smoothing weights of ETS."""
    import uuid

    from boreflow.session import cut_lineage, ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    cl = cut_lineage(cleaned(spark, sf_dir))
    for i, alpha in enumerate((0.3, 0.1)):
        fc = FC.forecast(cl, T.TARGET, "ETS", REGS, 30, params={"alpha": alpha, "gamma": 0.1, "n_bootstrap_draws": 20})
        HI.append_history(fc, path, T.TARGET, 30, "interpolate", f"2024-01-0{i + 1} 00:00:00")
    return path


@register("s6_s7_history")
def s67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs read back: metrics of the last fold, parameters as named columns."""
    h = HI.read_history(spark, _history(spark, sf_dir))
    names = ("alpha", "gamma", "n_bootstrap_draws")
    return h.select("run_ts", "well", "target", "model", "horizon", "fill_method", *[F.col("params")[k].alias(k) for k in names], "rmse", "mae", "mape")


@register("s6_s7_forecasts")
def s67f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast rows stored with the runs."""
    f = HI.read_forecasts(spark, _history(spark, sf_dir))
    return _r(f.select("run_ts", "well", "model", F.col("params")["alpha"].alias("alpha"), "fold", "part", "ds", "step", "yhat"))


# ---------------------------------------------------------------- short hourly panel (events)
@register("c2_interpolate_hourly")
def c2_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2 on the hourly events panel: hours without an event are interpolated by position."""
    ev = T.events_hourly_panel(spark, sf_dir)
    return _r(C.interpolate(C.null_blanks_zeros(ev, ["value"]), ["value"]))


@register("f1_acf_hourly")
def f1_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = C.clean(T.events_hourly_panel(spark, sf_dir), ["value"])
    return _r(F_.acf(ev, ["value"], 24))


@register("m1_ets_folds")
def m1_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ETS(alpha 0.3, gamma 0.1) by the vectorised kernel over the 5 expanding folds: metrics per fold."""
    fc = FC.forecast(cleaned(spark, sf_dir), T.TARGET, "ETS", horizon=0, params={"alpha": 0.3, "gamma": 0.1})
    return _r(E.metrics(fc.filter(F.col("part") == "test"), by=("well", "fold")))
