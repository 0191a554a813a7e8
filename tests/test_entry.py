import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and set(df.columns) == {"well", "model", "n", "rmse", "mae", "mape"}


def test_oracles_have_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_tuning_draws_are_deterministic():
    from boreflow.plans import tune

    a = tune.draw(tune.SPACES["DLT"], 50, 42)
    assert a == tune.draw(tune.SPACES["DLT"], 50, 42) and len(a) == 50
    assert all(t["global_trend_option"] in ("flat", "linear", "loglinear", "logistic") for t in a)
    assert all(0.8 <= t["phi"] <= 1.0 for t in a)
