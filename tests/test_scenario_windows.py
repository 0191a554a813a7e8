import datetime as dt

from boreflow.operators import bands as U
from boreflow.operators import scenario as H
from boreflow.operators import windows as W

D0 = dt.date(2024, 1, 1)


def _df(spark, n=20):
    return spark.createDataFrame([("w", D0 + dt.timedelta(i), i, float(i), 5.0 + i) for i in range(n)],
                                 "well string, ds date, time_idx int, y double, p double")


def test_ramp_ends_and_one_day(spark):
    df = _df(spark)
    out = H.scenario_frame(df, ["p"], "p", 10.0, 5).orderBy("step").collect()
    assert [r.p for r in out] == [24.0, 26.5, 29.0, 31.5, 34.0]
    assert out[0].ds == D0 + dt.timedelta(20)
    one = H.scenario_frame(df, ["p"], "p", 10.0, 1).collect()
    assert [r.p for r in one] == [24.0]
    assert H.future_dates(df, 3, include_last=True).orderBy("step").collect()[0].ds == D0 + dt.timedelta(19)


def test_supervised_windows(spark):
    df = _df(spark, 21)
    out = W.supervised(df, "y", 14, 7).collect()
    assert len(out) == 1 and out[0].x == [float(i) for i in range(14)] and out[0].y == [float(i) for i in range(14, 21)]
    assert W.supervised(_df(spark, 20), "y", 14, 7).count() == 0


def test_encoder_decoder(spark):
    df = _df(spark)
    assert W.encoder_tail(df, 5).count() == 5
    dec = W.decoder_rows(df, 3).orderBy("time_idx").collect()
    assert [r.time_idx for r in dec] == [20, 21, 22] and dec[0].ds == D0 + dt.timedelta(20)
    assert "ds" not in W.prediction_frame(df, 5, 3).columns


def test_bands(spark):
    fc = spark.createDataFrame([("w", 1, 10.0)], "well string, step int, yhat double")
    res = spark.createDataFrame([("w", 1.0), ("w", -1.0)], "well string, err double")
    r = U.normal_band(fc, res).collect()[0]
    assert abs(r.yhat_lower - (10 - 1.96)) < 1e-12 and abs(r.yhat_upper - (10 + 1.96)) < 1e-12
    none = U.with_optional_band(fc, None, ["well", "step"]).collect()[0]
    assert none.yhat_lower is None and none.yhat == 10.0
    s = spark.createDataFrame([("w", float(v)) for v in range(11)], "well string, value double")
    q = U.quantile_band(s, ["well"]).collect()[0]
    assert (q.yhat_lower, q.yhat, q.yhat_upper) == (1.0, 5.0, 9.0)
