"""DuckDB SQL oracles for the registered queries (same column names, same rounding).

The shared CTEs rebuild the raw and cleaned main panel from ``lineitem``; each oracle is
written from the operator's definition, not from the Spark plan.
"""

from __future__ import annotations

import math

from boreflow.plans.queries import DLT_WEIGHTS, LGT_WEIGHTS
from boreflow.plans.tune import SPACES, draw

PARAMS = ["qty", "price", "disc", "tax"]
WELLS = [f + s for f in "ANR" for s in "FO"]
W = "PARTITION BY well ORDER BY ds"

RAW = """
agg AS (
  SELECT l_returnflag || l_linestatus AS well, CAST(l_shipdate AS DATE) AS ds,
         sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
         avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY ALL),
span AS (SELECT well, min(ds) AS d0, max(ds) AS d1 FROM agg GROUP BY well),
grid AS (SELECT well, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS ds FROM span),
raw AS (SELECT g.well, g.ds, a.qty, a.price, a.disc, a.tax FROM grid g LEFT JOIN agg a USING (well, ds))"""

C1 = """
c1 AS (SELECT well, ds, """ + ", ".join(f"nullif(TRY_CAST({p} AS DOUBLE), 0) AS {p}" for p in PARAMS) + " FROM raw)"


def _interp(src: str, name: str) -> str:
    anchors = []
    for p in PARAMS:
        pt = f"CASE WHEN {p} IS NOT NULL THEN {{'p': _pos, 'v': {p}}} END"
        anchors.append(f"last_value({pt} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv_{p}")
        anchors.append(f"first_value({pt} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx_{p}")
    fills = []
    for p in PARAMS:
        a, b = f"pv_{p}", f"nx_{p}"
        fills.append(
            f"coalesce({p}, CASE WHEN {a} IS NULL THEN {b}.v WHEN {b} IS NULL THEN {a}.v "
            f"ELSE {a}.v + ({b}.v - {a}.v) * (_pos - {a}.p) / ({b}.p - {a}.p) END) AS {p}"
        )
    return f"""
{name}_pos AS (SELECT *, row_number() OVER ({W}) AS _pos FROM {src}),
{name}_anc AS (SELECT *, {", ".join(anchors)} FROM {name}_pos),
{name} AS (SELECT well, ds, {", ".join(fills)} FROM {name}_anc)"""


C2 = _interp("c1", "c2")
C3 = """
c3 AS (SELECT well, ds, """ + ", ".join(f"coalesce({p}, median({p}) OVER (PARTITION BY well)) AS {p}" for p in PARAMS) + " FROM c1)"


def _tail(src: str, name: str) -> str:
    """C4 (drop nulls) -> C5 (target != 0) -> C6 (forward fill: a no-op after C4, kept for shape)."""
    nn = " AND ".join(f"{p} IS NOT NULL" for p in PARAMS)
    return f"""
{name} AS (SELECT well, ds, {", ".join(PARAMS)} FROM {src} WHERE {nn} AND (qty IS NULL OR qty <> 0))"""


CLEAN = RAW + "," + C1 + "," + C2 + "," + _tail("c2", "clean")
CLEAN_MEDIAN = RAW + "," + C1 + "," + C3 + "," + _tail("c3", "clean")


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def ets_rec(src: str, cands: list[tuple[float, float]], stop: str, m: int = 12) -> str:
    """Recursive ETS over ``src(well, pos, y)`` (pos 1-based), candidates as VALUES; stops at ``stop``."""
    vals = ", ".join(f"({dbl(a)}, {dbl(g)})" for a, g in cands)
    zeros = "[" + ", ".join(["0.0"] * m) + "]::DOUBLE[]"
    return f"""
cand(alpha, gamma) AS (VALUES {vals}),
rec AS (
  SELECT s.well, c.alpha, c.gamma, 1 AS i, s.y AS l, {zeros} AS s, CAST(0.0 AS DOUBLE) AS sse
  FROM {src} s, cand c WHERE s.pos = 1
  UNION ALL
  SELECT r.well, r.alpha, r.gamma, r.i + 1,
         r.l + r.alpha * (x.y - (r.l + r.s[1])),
         r.s[2:{m}] || [r.s[1] + (r.gamma * (1.0 - r.alpha)) * (x.y - (r.l + r.s[1]))],
         r.sse + (x.y - (r.l + r.s[1])) * (x.y - (r.l + r.s[1]))
  FROM rec r JOIN {src} x ON x.well = r.well AND x.pos = r.i + 1
  WHERE r.i < ({stop}))"""


ORACLE: dict[str, str] = {}

ORACLE["m1_ets_holdout"] = with_(
    CLEAN,
    """
ser AS (SELECT well, row_number() OVER (PARTITION BY well ORDER BY ds) AS pos, qty AS y,
               count(*) OVER (PARTITION BY well) AS n FROM clean),
lens AS (SELECT DISTINCT well, n, CAST(floor(n * 0.7) AS INTEGER) AS cut, CAST(floor(n * 0.95) AS INTEGER) AS te FROM ser)""",
    ets_rec("ser", [(0.3, 0.1)], "SELECT cut FROM lens WHERE lens.well = r.well"),
    """
st AS (SELECT r.* FROM rec r JOIN lens USING (well) WHERE r.i = lens.cut),
fc AS (SELECT x.well, x.y, st.l + st.s[CAST(((x.pos - st.i - 1) % 12) + 1 AS INTEGER)] AS yhat
       FROM ser x JOIN lens USING (well) JOIN st USING (well) WHERE x.pos > lens.te)""",
) + """
SELECT well, 'ETS' AS model, count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
       round(avg(abs(y - yhat)), 6) AS mae, round(avg(abs((y - yhat) / y)) * 100.0, 6) AS mape
FROM fc GROUP BY well"""

def rnd(cols: list[str], d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


R4 = rnd(PARAMS)
LONG_RAW = " UNION ALL ".join(f"SELECT well, ds, '{p}' AS param, CAST({p} AS DOUBLE) AS value FROM raw" for p in PARAMS)

# Sheets: each parameter laid out over the sheet's dates (union over wells) x wells.
ORACLE["s1_read_sheets"] = with_(RAW, """
wl AS (SELECT DISTINCT well FROM raw), dl AS (SELECT DISTINCT ds FROM raw),
cells AS (SELECT wl.well, dl.ds FROM wl CROSS JOIN dl)""") + " UNION ALL ".join(
    f"""
SELECT c.well, c.ds, '{p}' AS param, round(r.{p}, 6) AS value FROM cells c LEFT JOIN raw r USING (well, ds)""" for p in PARAMS)

ORACLE["s2_catalog"] = with_(RAW, f"lr AS ({LONG_RAW})") + """
SELECT param, well, count(*) AS n_days, count(value) AS n_values, min(ds) AS first_ds, max(ds) AS last_ds
FROM lr GROUP BY param, well"""

ORACLE["s3_select_series"] = with_(RAW) + """
SELECT well, ds, round(qty, 6) AS qty, round(disc, 6) AS disc FROM raw WHERE well IN ('NO', 'RF')"""

ORACLE["s4_to_panel"] = with_(RAW) + f"\nSELECT well, ds, {R4} FROM raw"

ORACLE["s8_preview"] = with_(RAW) + f"\nSELECT well, ds, {R4} FROM raw ORDER BY ds, well LIMIT 50"

ORACLE["s9_series_long"] = with_(CLEAN) + "\n" + " UNION ALL ".join(
    f"SELECT well, ds, '{p}' AS param, round({p}, 6) AS value FROM clean" for p in PARAMS)

ORACLE["c1_null_blanks_zeros"] = with_(RAW, C1) + f"\nSELECT well, ds, {R4} FROM c1"
ORACLE["c2_interpolate"] = with_(RAW, C1, C2) + f"\nSELECT well, ds, {R4} FROM c2"
ORACLE["c3_fill_median"] = with_(RAW, C1, C3) + f"\nSELECT well, ds, {R4} FROM c3"
ORACLE["c4_drop_nulls"] = with_(RAW, C1) + f"\nSELECT well, ds, {R4} FROM c1 WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in PARAMS)
ORACLE["c5_nonzero_target"] = with_(RAW) + f"\nSELECT well, ds, {R4} FROM raw WHERE disc IS NULL OR disc <> 0"
ORACLE["c6_ffill"] = with_(RAW, C1) + "\nSELECT well, ds, " + ", ".join(
    f"round(last_value({p} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS {p}" for p in PARAMS) + " FROM c1"
ORACLE["c7_missing_profile"] = with_(RAW, f"lr AS ({LONG_RAW})") + """
SELECT well, param, count(*) AS total, CAST(count_if(value IS NULL) AS BIGINT) AS nulls, CAST(count_if(value = 0) AS BIGINT) AS zeros,
       round(CAST(count_if(value IS NULL) AS DOUBLE) * 100.0 / count(*), 6) AS pct_null,
       round(CAST(count_if(value = 0) AS DOUBLE) * 100.0 / count(*), 6) AS pct_zero
FROM lr GROUP BY well, param"""
ORACLE["c8_time_index"] = with_(CLEAN) + f"""
SELECT well, well AS well_id, ds, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS time_idx FROM clean"""
ORACLE["c9_to_float"] = with_(CLEAN) + "\nSELECT well, ds, " + ", ".join(f"CAST(round({p}, 6) AS FLOAT) AS {p}" for p in PARAMS) + " FROM clean"
ORACLE["c10_rename"] = with_(CLEAN) + "\nSELECT well, ds, round(qty, 6) AS y, " + rnd(PARAMS[1:]) + " FROM clean"
ORACLE["c_clean_median"] = with_(CLEAN_MEDIAN) + f"\nSELECT well, ds, {R4} FROM clean"

ORACLE["s5_to_wide"] = with_(RAW, f"lr AS ({LONG_RAW})") + """
SELECT ds, """ + ", ".join(
    f"round(avg(CASE WHEN param = '{p}' AND well = '{w}' THEN round(value, 6) END), 6) AS {p}__{w}" for p in PARAMS for w in WELLS) + """
FROM lr GROUP BY ds"""

REGS = PARAMS[1:]
_ACF = """
cen AS (SELECT well, ds, """ + ", ".join(f"{p} - avg({p}) OVER (PARTITION BY well) AS {p}" for p in PARAMS) + """ FROM clean),
lg AS (SELECT well, """ + ", ".join(
    f"{p} * {p if k == 0 else f'lag({p}, {k}) OVER ({W})'} AS {p}__{k}" for p in PARAMS for k in range(21)) + """ FROM cen),
sm AS (SELECT well, """ + ", ".join(f"sum({p}__{k}) AS {p}__{k}" for p in PARAMS for k in range(21)) + """ FROM lg GROUP BY well),
acf AS (""" + " UNION ALL ".join(
    f"SELECT well, '{p}' AS param, {k} AS lag, {p}__{k} / {p}__0 AS acf FROM sm" for p in PARAMS for k in range(21)) + ")"

ORACLE["f1_acf"] = with_(CLEAN, _ACF) + "\nSELECT well, param, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acf"
ORACLE["f2_acf_screen"] = with_(CLEAN, _ACF) + """
SELECT well, param, round(max(acf), 6) AS acf_max, max(acf) > 0.2 AS keep_acf FROM acf WHERE lag >= 1 GROUP BY well, param"""

_CORR = """
cr AS (""" + " UNION ALL ".join(
    f"SELECT well, '{r}' AS regressor, corr({r}, qty) AS r, count(*) AS n FROM clean GROUP BY well" for r in REGS) + ")"
ORACLE["f3_corr"] = with_(CLEAN, _CORR) + "\nSELECT well, regressor, round(r, 6) AS r, n FROM cr"
ORACLE["f4_corr_screen"] = with_(CLEAN, _CORR) + "\nSELECT well, regressor, round(r, 6) AS r, n, abs(r) >= 0.1 AS keep_corr FROM cr"
ORACLE["f5_corr_ranking"] = with_(CLEAN, _CORR) + """
SELECT well, regressor, round(r, 6) AS r, n,
       CAST(row_number() OVER (PARTITION BY well ORDER BY r DESC NULLS LAST, regressor) AS INTEGER) AS rank FROM cr"""
_SPEAR = """
rk AS (SELECT well, """ + ", ".join(
    f"CAST(rank() OVER (PARTITION BY well ORDER BY {p}) AS DOUBLE) + CAST(count(*) OVER (PARTITION BY well, {p}) - 1 AS DOUBLE) / 2.0 AS {p}"
    for p in PARAMS) + """ FROM clean),
sp AS (""" + " UNION ALL ".join(
    f"SELECT well, '{r}' AS regressor, count(*) AS n, corr({r}, qty) AS rho FROM rk GROUP BY well" for r in REGS) + ")"
ORACLE["f6_spearman"] = with_(CLEAN, _SPEAR) + """
SELECT well, regressor, n, round(rho, 6) AS rho, round(rho * sqrt(CAST(n - 2 AS DOUBLE) / (1.0 - rho * rho)), 6) AS t FROM sp"""

# ---------------------------------------------------------------- splits, folds, baseline
POS = f"""
pz AS (SELECT well, ds, qty, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS pos,
              count(*) OVER (PARTITION BY well) AS n FROM clean)"""
FOLDS = """
fb AS (SELECT DISTINCT well, n FROM pz),
fl AS (SELECT well, n, CAST(t.f AS INTEGER) AS fold, CAST(n - (5 - t.f) * (n // 6) AS INTEGER) AS train_end,
              CAST(n - (5 - t.f) * (n // 6) + n // 6 AS INTEGER) AS test_end FROM fb, range(5) t(f))"""
BASE = """
tst AS (SELECT p.well, f.fold, p.ds, p.qty AS y, p.pos, f.train_end, CAST(p.pos - f.train_end + 1 AS INTEGER) AS step
        FROM pz p JOIN fl f ON p.well = f.well AND p.pos >= f.train_end AND p.pos < f.test_end),
lastv AS (SELECT f.well, f.fold, p.qty AS yhat FROM fl f JOIN pz p ON p.well = f.well AND p.pos = f.train_end - 1),
base AS (SELECT t.*, l.yhat, 'last_value' AS model FROM tst t JOIN lastv l USING (well, fold)),
mx AS (SELECT well, max(ds) AS d1, max_by(qty, pos) AS yl FROM pz GROUP BY well),
fut AS (SELECT well, CAST(r.s AS INTEGER) AS step, CAST(d1 + CAST(r.s AS INTEGER) AS DATE) AS ds, yl AS yhat
        FROM mx, range(1, 31) r(s))"""
BT = with_(CLEAN, POS, FOLDS, BASE)

ORACLE["b1_holdout"] = with_(CLEAN, POS) + """
SELECT well, ds, round(qty, 6) AS qty, CASE WHEN pos < floor(n * 0.7) THEN 'train' ELSE 'test' END AS part, pos
FROM pz WHERE pos < floor(n * 0.7) OR pos >= floor(n * 0.95)"""

ORACLE["b2_expanding_folds"] = with_(CLEAN, POS, FOLDS) + """
SELECT p.well, p.ds, round(p.qty, 6) AS qty, f.fold, CASE WHEN p.pos < f.train_end THEN 'train' ELSE 'test' END AS part, p.pos
FROM pz p JOIN fl f ON p.well = f.well AND p.pos < f.test_end"""

ORACLE["b3_fold_sizes"] = with_(CLEAN, POS, FOLDS) + """
SELECT p.well, f.fold, CASE WHEN p.pos < f.train_end THEN 'train' ELSE 'test' END AS part, count(*) AS n
FROM pz p JOIN fl f ON p.well = f.well AND p.pos < f.test_end GROUP BY ALL"""

ORACLE["b4_align"] = BT + """
SELECT well, fold, step, ds, round(y, 6) AS y, round(yhat, 6) AS yhat FROM base"""

# ---------------------------------------------------------------- windows
IDX = f"""
ix AS (SELECT well, ds, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS time_idx, qty FROM clean)"""

ORACLE["w1_supervised"] = with_(CLEAN, f"""
sw AS (SELECT well, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS start_idx,
              last_value(ds) OVER ({W} ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS ds_end,
              list(qty) OVER ({W} ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS x,
              list(qty) OVER ({W} ROWS BETWEEN 14 FOLLOWING AND 20 FOLLOWING) AS y FROM clean)""") + """
SELECT well, start_idx, ds_end, list_transform(x, lambda v: round(v, 6)) AS x, list_transform(y, lambda v: round(v, 6)) AS y
FROM sw WHERE len(x) = 14 AND len(y) = 7"""

_TAIL = "SELECT well, ds, time_idx, round(qty, 6) AS qty FROM ix WHERE time_idx > (SELECT max(time_idx) FROM ix i2 WHERE i2.well = ix.well) - 30"
_DEC = """SELECT l.well, CAST(l.ds + CAST(r.h AS INTEGER) AS DATE) AS ds, CAST(l.time_idx + r.h AS INTEGER) AS time_idx, round(l.qty, 6) AS qty
FROM (SELECT well, arg_max(ds, time_idx) AS ds, max(time_idx) AS time_idx, arg_max(qty, time_idx) AS qty FROM ix GROUP BY well) l, range(1, 31) r(h)"""
ORACLE["w2_encoder_tail"] = with_(CLEAN, IDX) + "\n" + _TAIL
ORACLE["w3_decoder_rows"] = with_(CLEAN, IDX) + "\n" + _DEC
ORACLE["w4_prediction_frame"] = with_(CLEAN, IDX) + f"""
SELECT well, time_idx, qty FROM ({_TAIL}) UNION ALL SELECT well, time_idx, qty FROM ({_DEC})"""

# ---------------------------------------------------------------- future frame, scenario
LASTV = """
lv AS (SELECT well, max(ds) AS d1, arg_max(price, ds) AS price, arg_max(disc, ds) AS disc, arg_max(tax, ds) AS tax FROM clean GROUP BY well),
fd AS (SELECT well, CAST(r.s AS INTEGER) AS step, CAST(d1 + CAST(r.s AS INTEGER) AS DATE) AS ds, price, disc, tax FROM lv, range(1, 31) r(s))"""
ORACLE["h1_future_dates"] = with_(CLEAN) + """
SELECT well, CAST(r.s AS INTEGER) AS step, CAST(max(ds) + CAST(r.s - 1 AS INTEGER) AS DATE) AS ds
FROM clean, range(1, 31) r(s) GROUP BY well, r.s"""
ORACLE["h2_carry_last"] = with_(CLEAN, LASTV) + "\nSELECT well, step, ds, " + rnd(REGS) + " FROM fd"
ORACLE["h3_ramp"] = with_(CLEAN, LASTV) + """
SELECT well, step, ds, round(price + 5000.0 * (step - 1) / 29.0, 6) AS price, round(disc, 6) AS disc, round(tax, 6) AS tax FROM fd"""
ORACLE["h4_ramp_series"] = with_(CLEAN, LASTV) + """
SELECT well, step, ds, round(disc + (-0.02) * (step - 1) / 29.0, 6) AS value FROM fd"""

# ---------------------------------------------------------------- evaluation, assembly, bands
_MET = """
met AS (SELECT well, model, fold, count(*) AS n, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
               avg(abs(y - yhat)) AS mae, avg(abs((y - yhat) / y)) * 100.0 AS mape FROM base GROUP BY well, model, fold)"""
ORACLE["e1_e3_metrics"] = with_(CLEAN, POS, FOLDS, BASE, _MET) + "\nSELECT well, model, fold, n, " + rnd(["rmse", "mae", "mape"]) + " FROM met"
ORACLE["e4_last_fold"] = with_(CLEAN, POS, FOLDS, BASE, _MET) + "\nSELECT well, model, fold, n, " + rnd(["rmse", "mae", "mape"]) + \
    " FROM met WHERE fold = 4"
ORACLE["e8_combine"] = BT + """
SELECT well, ds, step, round(y, 6) AS y, round(yhat, 6) AS yhat, 'test' AS part FROM base WHERE fold = 4
UNION ALL SELECT well, ds, step, CAST(NULL AS DOUBLE) AS y, round(yhat, 6) AS yhat, 'future' AS part FROM fut"""
ORACLE["e9_attach_regressors"] = with_(CLEAN, POS, FOLDS, BASE, """
fr AS (SELECT well, ds, step, yhat FROM base WHERE fold = 4 UNION ALL SELECT well, ds, step, yhat FROM fut),
jr AS (SELECT fr.*, c.price, c.disc, c.tax FROM fr LEFT JOIN clean c USING (well, ds))""") + "\nSELECT well, ds, step, round(yhat, 6) AS yhat, " + ", ".join(
    f"round(last_value({r} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS {r}" for r in REGS) + " FROM jr"
ORACLE["e10_chart_feed"] = with_(CLEAN, POS, FOLDS, BASE, LASTV.replace("lv AS", "lv2 AS").replace("FROM lv,", "FROM lv2,").replace("fd AS", "fd2 AS"), """
sd AS (SELECT well, stddev_pop(y - yhat) AS sd FROM base WHERE fold = 4 GROUP BY well),
fb2 AS (SELECT f.well, f.ds, f.yhat, f.yhat - 1.96 * s.sd AS lo, f.yhat + 1.96 * s.sd AS hi FROM fut f LEFT JOIN sd s USING (well))""") + """
SELECT well, ds, 'actual' AS series, round(qty, 6) AS value FROM clean
UNION ALL SELECT well, ds, 'yhat', round(yhat, 6) FROM fb2
UNION ALL SELECT well, ds, 'yhat_lower', round(lo, 6) FROM fb2 WHERE lo IS NOT NULL
UNION ALL SELECT well, ds, 'yhat_upper', round(hi, 6) FROM fb2 WHERE hi IS NOT NULL
UNION ALL SELECT well, ds, 'ramp', round(price + 5000.0 * (step - 1) / 29.0, 6) FROM fd2
UNION ALL SELECT well, ds, 'price', round(price, 6) FROM clean"""
ORACLE["u1_normal_band"] = BT + """,
sdf AS (SELECT well, fold, stddev_pop(y - yhat) AS sd FROM base GROUP BY well, fold)
SELECT b.well, b.fold, b.step, b.ds, round(b.yhat, 6) AS yhat, round(b.yhat - 1.96 * s.sd, 6) AS yhat_lower,
       round(b.yhat + 1.96 * s.sd, 6) AS yhat_upper FROM base b LEFT JOIN sdf s USING (well, fold)"""
ORACLE["u2_quantile_band"] = with_(CLEAN) + """
SELECT well, CAST(dayofweek(ds) + 1 AS INTEGER) AS dow, round(quantile_cont(qty, 0.1), 6) AS yhat_lower,
       round(quantile_cont(qty, 0.5), 6) AS yhat, round(quantile_cont(qty, 0.9), 6) AS yhat_upper
FROM clean GROUP BY ALL"""
ORACLE["u4_optional_band"] = BT + """
SELECT well, ds, step, round(yhat, 6) AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper FROM fut"""

# ---------------------------------------------------------------- ETS grid tuning (recursive CTE)
ETS_GRID = [(a, g) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for g in (0.05, 0.2)]
_ETS_GRID = with_(
    CLEAN,
    """
ser AS (SELECT well, row_number() OVER (PARTITION BY well ORDER BY ds) AS pos, qty AS y,
               count(*) OVER (PARTITION BY well) AS n FROM clean),
lens AS (SELECT DISTINCT well, n, CAST(floor(n * 0.7) AS INTEGER) AS cut, CAST(floor(n * 0.95) AS INTEGER) AS te FROM ser)""",
    ets_rec("ser", ETS_GRID, "SELECT cut FROM lens WHERE lens.well = r.well"),
    """
st AS (SELECT r.* FROM rec r JOIN lens USING (well) WHERE r.i = lens.cut),
fc AS (SELECT x.well, st.alpha, st.gamma, x.y, st.l + st.s[CAST(((x.pos - st.i - 1) % 12) + 1 AS INTEGER)] AS yhat
       FROM ser x JOIN lens USING (well) JOIN st USING (well) WHERE x.pos > lens.te),
sc AS (SELECT well, alpha, gamma, count(*) AS n, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
              avg(abs(y - yhat)) AS mae, avg(abs((y - yhat) / y)) * 100.0 AS mape FROM fc GROUP BY well, alpha, gamma),
best AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY rmse, alpha, gamma) AS rk FROM sc)""")
ORACLE["e5_tune_ets_grid"] = _ETS_GRID + """
SELECT well, round(alpha, 6) AS alpha, round(gamma, 6) AS gamma, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(mape, 6) AS mape FROM best WHERE rk = 1"""
ORACLE["e7_best_params"] = _ETS_GRID + """
SELECT well, CAST(alpha AS VARCHAR) AS alpha, CAST(gamma AS VARCHAR) AS gamma, '500' AS n_bootstrap_draws FROM best WHERE rk = 1"""

# ---------------------------------------------------------------- hourly events panel
EV = f"""
ev AS (SELECT event_type AS well, date_trunc('hour', ts) AS ds, avg(value) AS value FROM events GROUP BY ALL),
evs AS (SELECT well, min(ds) AS d0, max(ds) AS d1 FROM ev GROUP BY well),
evg AS (SELECT well, unnest(generate_series(d0, d1, INTERVAL 1 HOUR)) AS ds FROM evs),
evr AS (SELECT g.well, g.ds, nullif(e.value, 0) AS value FROM evg g LEFT JOIN ev e USING (well, ds)),
evp AS (SELECT *, row_number() OVER ({W}) AS _pos FROM evr),
eva AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN {{'p': _pos, 'v': value}} END IGNORE NULLS)
    OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN {{'p': _pos, 'v': value}} END IGNORE NULLS)
    OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM evp),
evi AS (SELECT well, ds, coalesce(value, CASE WHEN pv IS NULL THEN nx.v WHEN nx IS NULL THEN pv.v
          ELSE pv.v + (nx.v - pv.v) * (_pos - pv.p) / (nx.p - pv.p) END) AS value FROM eva)"""
ORACLE["c2_interpolate_hourly"] = with_(EV) + "\nSELECT well, ds, round(value, 6) AS value FROM evi"
ORACLE["f1_acf_hourly"] = with_(EV, """
evc AS (SELECT well, ds, value - avg(value) OVER (PARTITION BY well) AS v FROM evi WHERE value IS NOT NULL),
evl AS (SELECT well, """ + ", ".join(f"v * {'v' if k == 0 else f'lag(v, {k}) OVER ({W})'} AS l{k}" for k in range(25)) + """ FROM evc),
evm AS (SELECT well, """ + ", ".join(f"sum(l{k}) AS l{k}" for k in range(25)) + " FROM evl GROUP BY well)") + "\n" + " UNION ALL ".join(
    f"SELECT well, 'value' AS param, {k} AS lag, round(l{k} / l0, 6) AS acf FROM evm" for k in range(25))

ORACLE["m1_ets_folds"] = with_(
    CLEAN,
    """
ser AS (SELECT well, row_number() OVER (PARTITION BY well ORDER BY ds) AS pos, qty AS y,
               count(*) OVER (PARTITION BY well) AS n FROM clean),
mx AS (SELECT DISTINCT well, n FROM ser),
fl AS (SELECT well, CAST(t.f AS INTEGER) AS fold, CAST(n - (5 - t.f) * (n // 6) AS INTEGER) AS cut,
              CAST(n // 6 AS INTEGER) AS s FROM mx, range(5) t(f))""",
    ets_rec("ser", [(0.3, 0.1)], "SELECT n FROM mx WHERE mx.well = r.well"),
    """
st AS (SELECT fl.fold, fl.s, r.* FROM rec r JOIN fl ON r.well = fl.well AND r.i = fl.cut),
fc AS (SELECT x.well, st.fold, x.y, st.l + st.s[CAST(((x.pos - st.i - 1) % 12) + 1 AS INTEGER)] AS yhat
       FROM ser x JOIN st ON x.well = st.well AND x.pos > st.i AND x.pos <= st.i + st.s)""",
).replace("st AS (SELECT fl.fold, fl.s, r.*", "st AS (SELECT fl.fold, fl.s AS s_len, r.*").replace(
    "x.pos <= st.i + st.s)", "x.pos <= st.i + st.s_len)") + """
SELECT well, fold, count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
       round(avg(abs(y - yhat)), 6) AS mae, round(avg(abs((y - yhat) / y)) * 100.0, 6) AS mape
FROM fc GROUP BY well, fold"""

# ---------------------------------------------------------------- p-values and the whole screening
# Averages differ in their last bits by the order of addition; rounded, equal readings tie in any engine.
SUPPLIERS = CLEAN.replace("l_returnflag || l_linestatus", "CAST(l_suppkey AS VARCHAR)").replace(
    f"clean AS (SELECT well, ds, {', '.join(PARAMS)} FROM", f"clean AS (SELECT well, ds, {rnd(PARAMS, 9)} FROM")
assert "CAST(l_suppkey" in SUPPLIERS and "round(qty, 9)" in SUPPLIERS
# Two-sided p of a t statistic: 1 - 2 * integral of the t density over 0..|t|, by Simpson's rule.
_PVAL = """
tv AS (SELECT well, regressor, n, rho, CAST(n - 2 AS DOUBLE) AS df, rho * sqrt(CAST(n - 2 AS DOUBLE) / (1.0 - rho * rho)) AS t FROM sp),
td AS (SELECT *, least(abs(t), 60.0) / 2000 AS w, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c FROM tv),
pv AS (SELECT well, regressor, n, rho, t, greatest(0.0, 1.0 - 2.0 * w / 3.0 * list_sum(
         [(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * c * pow(1.0 + (i * w) * (i * w) / df, -(df + 1) / 2)
          FOR i IN range(2001)])) AS p FROM td)"""
ORACLE["f6_spearman_p"] = with_(CLEAN, _SPEAR, _PVAL) + """
SELECT well, regressor, n, round(rho, 6) AS rho, round(t, 6) AS t, round(p, 6) AS p FROM pv"""
_SCREEN = with_(SUPPLIERS, _ACF, _CORR, _SPEAR, _PVAL, """
am AS (SELECT well, param AS regressor, max(acf) AS acf_max FROM acf WHERE lag >= 1 AND param <> 'qty' GROUP BY well, param),
scr AS (SELECT well, regressor, acf_max, acf_max > 0.2 AS keep_acf, r, cr.n, abs(r) >= 0.1 AS keep_corr, rho, p,
               acf_max > 0.2 AND abs(r) >= 0.1 AS relevant, acf_max > 0.2 AND abs(r) >= 0.1 AND p < 0.05 AS significant
        FROM am JOIN cr USING (well, regressor) JOIN pv USING (well, regressor))""")
ORACLE["f_screen"] = _SCREEN + "\nSELECT well, regressor, keep_acf, n, keep_corr, relevant, significant, " + rnd(["acf_max", "r", "rho", "p"]) + " FROM scr"
ORACLE["f7_significant"] = _SCREEN + "\nSELECT well, regressor FROM scr WHERE significant"

# ---------------------------------------------------------------- backtests with a future, sampled paths
# Folds 0..4 and the final fit (fold 5, 30 future days): train_end, number of steps h.
FITS = """
fits AS (SELECT well, fold, train_end, CAST(test_end - train_end AS INTEGER) AS h FROM fl
         UNION ALL SELECT well, 5, CAST(n AS INTEGER), 30 FROM fb),
rowsp AS (SELECT f.well, f.fold, f.train_end, CAST(s.k AS INTEGER) AS step, p.ds, p.qty AS y, 'test' AS part
          FROM fits f, range(1, 2000) s(k), pz p WHERE f.fold < 5 AND s.k <= f.h AND p.well = f.well AND p.pos = f.train_end + s.k - 1
          UNION ALL
          SELECT f.well, f.fold, f.train_end, CAST(s.k AS INTEGER), CAST(m.d1 + CAST(s.k AS INTEGER) AS DATE), NULL, 'future'
          FROM fits f JOIN (SELECT well, max(ds) AS d1 FROM pz GROUP BY well) m USING (well), range(1, 31) s(k) WHERE f.fold = 5)"""


def ets_fits(cands: list[tuple[float, float]]) -> str:
    """ETS forecasts of every fit: ``efc(well, alpha, gamma, fold, part, ds, step, y, yhat)``."""
    rec = ets_rec("ser", cands, "SELECT n FROM fb WHERE fb.well = r.well")
    return "ser AS (SELECT well, pos + 1 AS pos, qty AS y FROM pz)," + rec + """,
efc AS (SELECT x.well, r.alpha, r.gamma, x.fold, x.part, x.ds, x.step, x.y,
               r.l + r.s[CAST(((x.step - 1) % 12) + 1 AS INTEGER)] AS yhat
               , sqrt(r.sse / (x.train_end - 1)) AS sd
        FROM rowsp x JOIN rec r ON r.well = x.well AND r.i = x.train_end)"""


def path_band(n_paths: int, seed: int, qs: tuple[float, ...]) -> str:
    """Quantiles of cumulative sampled changes: ``band(well, fold, step, q0, q1, ...)``."""
    quant = ", ".join(f"quantile_cont(moved, {q}) AS q{k}" for k, q in enumerate(qs))
    return f"""
chg AS (SELECT well, list(d ORDER BY pos) AS d FROM (
          SELECT well, pos, lead(qty) OVER (PARTITION BY well ORDER BY pos) - qty AS d FROM pz) GROUP BY well),
dr1 AS (SELECT f.well, f.fold, f.train_end, p.k AS p, j.k AS j,
               (p.k * 7919 + j.k * 104729 + p.k * j.k * 31 + f.fold * 15485863 + {seed} * 32452843) % 2147483647 AS a
        FROM fits f, range(1, {n_paths + 1}) p(k), range(1, 2000) j(k) WHERE j.k <= f.h),
dr2 AS (SELECT *, (a * 48271) % 2147483647 AS b FROM dr1),
dr3 AS (SELECT well, fold, p, j, (b * b) % 2147483647 % (train_end - 1) AS k FROM dr2),
mv AS (SELECT dr3.well, dr3.fold, dr3.j AS step,
              sum(chg.d[k + 1]) OVER (PARTITION BY dr3.well, fold, p ORDER BY j ROWS UNBOUNDED PRECEDING) AS moved
       FROM dr3 JOIN chg USING (well)),
band AS (SELECT well, fold, step, {quant} FROM mv GROUP BY well, fold, step)"""


_FC_OUT = "\nSELECT well, '{model}' AS model, fold, part, ds, step, " + "round(y, 6) AS y, round({yhat}, 6) AS yhat, round({lo}, 6) AS yhat_lower, round({hi}, 6) AS yhat_upper"
ORACLE["u3_bootstrap_band_20"] = with_(CLEAN, POS, FOLDS, FITS, ets_fits([(0.1, 0.05)]), path_band(20, 7, (0.05, 0.95))) + _FC_OUT.format(
    model="ETS", yhat="yhat", lo="yhat + q0", hi="yhat + q1") + " FROM efc LEFT JOIN band USING (well, fold, step)"
ORACLE["m1_ets"] = with_(CLEAN, POS, FOLDS, FITS, ets_fits([(0.1, 0.05)])) + _FC_OUT.format(
    model="ETS", yhat="yhat", lo="yhat - 1.6449 * sd", hi="yhat + 1.6449 * sd") + " FROM efc"
ORACLE["m9_sample_paths"] = with_(CLEAN, POS, FOLDS, FITS, path_band(20, 42, (0.1, 0.5, 0.9)), """
lastp AS (SELECT f.well, f.fold, p.qty AS last FROM fits f JOIN pz p ON p.well = f.well AND p.pos = f.train_end - 1)""") + _FC_OUT.format(
    model="Chronos", yhat="last + q1", lo="last + q0", hi="last + q2") + " FROM rowsp JOIN lastp USING (well, fold) JOIN band USING (well, fold, step)"

# ---------------------------------------------------------------- history
_TWO = [(0.3, 0.1), (0.1, 0.1)]
_RUNS = with_(CLEAN, POS, FOLDS, FITS, ets_fits(_TWO))
_STAMP = "CAST(CASE WHEN alpha > 0.2 THEN '2024-01-01 00:00:00' ELSE '2024-01-02 00:00:00' END AS TIMESTAMP) AS run_ts"
ORACLE["s6_s7_history"] = _RUNS + f"""
SELECT {_STAMP}, well, 'qty' AS target, 'ETS' AS model, 30 AS horizon, 'interpolate' AS fill_method,
       CAST(alpha AS VARCHAR) AS alpha, CAST(gamma AS VARCHAR) AS gamma, '20' AS n_bootstrap_draws,
       round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(abs(y - yhat)), 2) AS mae,
       round(avg(abs((y - yhat) / y)) * 100.0, 2) AS mape
FROM efc WHERE fold = 4 GROUP BY well, alpha, gamma"""
ORACLE["s6_s7_forecasts"] = _RUNS + f"""
SELECT {_STAMP}, well, 'ETS' AS model, CAST(alpha AS VARCHAR) AS alpha, fold, part, ds, step, round(yhat, 6) AS yhat FROM efc"""

# ---------------------------------------------------------------- tuning with the seeded trials
_TRIALS = [(t["alpha"], t["gamma"]) for t in draw(SPACES["ETS"], 50, 42)]
_TUNED = with_(CLEAN, POS, FOLDS, FITS, ets_fits(_TRIALS), "trials(trial, alpha, gamma) AS (VALUES " + ", ".join(
    f"({i}, {dbl(a)}, {dbl(g)})" for i, (a, g) in enumerate(_TRIALS)) + ")", """
cutp AS (SELECT well, CAST(floor(n * 0.7) AS INTEGER) AS cut, CAST(floor(n * 0.95) AS INTEGER) AS te FROM fb),
hold AS (SELECT x.well, t.trial, t.alpha, t.gamma, x.y, r.l + r.s[CAST(((x.pos - r.i - 1) % 12) + 1 AS INTEGER)] AS yhat
         FROM cutp c JOIN ser x ON x.well = c.well AND x.pos > c.te JOIN rec r ON r.well = c.well AND r.i = c.cut
         JOIN trials t ON t.alpha = r.alpha AND t.gamma = r.gamma),
sc AS (SELECT well, trial, alpha, gamma, count(*) AS n, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
              avg(abs(y - yhat)) AS mae, avg(abs((y - yhat) / y)) * 100.0 AS mape FROM hold GROUP BY well, trial, alpha, gamma),
best AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY rmse, trial) AS rk FROM sc)""")
ORACLE["e5_tune_ets"] = _TUNED + """
SELECT well, trial, round(alpha, 6) AS alpha, round(gamma, 6) AS gamma, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
       round(mape, 6) AS mape FROM best WHERE rk = 1"""
ORACLE["e7_tune_then_run"] = _TUNED + """
SELECT e.well, b.trial, round(e.alpha, 6) AS alpha, round(e.gamma, 6) AS gamma, e.fold, count(*) AS n,
       round(sqrt(avg((e.y - e.yhat) * (e.y - e.yhat))), 6) AS rmse, round(avg(abs(e.y - e.yhat)), 6) AS mae,
       round(avg(abs((e.y - e.yhat) / e.y)) * 100.0, 6) AS mape
FROM efc e JOIN best b ON b.well = e.well AND b.alpha = e.alpha AND b.gamma = e.gamma AND b.rk = 1
WHERE e.part = 'test' GROUP BY e.well, b.trial, e.alpha, e.gamma, e.fold"""

# ---------------------------------------------------------------- fitted weights against the draws
ORACLE["m1_fit_against_draws"] = with_(CLEAN, POS, FOLDS, FITS, "ser AS (SELECT well, pos + 1 AS pos, qty AS y FROM pz)," + ets_rec(
    "ser", _TRIALS, "SELECT n FROM fb WHERE fb.well = r.well")) + """
SELECT r.well, CAST(f.fold AS INTEGER) AS fold, CAST(f.train_end - 1 AS INTEGER) AS n_fit,
       round(min(sqrt(r.sse / (f.train_end - 1))), 6) AS best_of_50, true AS no_worse
FROM rec r JOIN fits f ON f.well = r.well AND f.train_end = r.i GROUP BY r.well, f.fold, f.train_end"""

# ---------------------------------------------------------------- wells in segments: the same results
for _name in ("c2_interpolate", "c6_ffill", "c8_time_index", "w1_supervised"):
    ORACLE[f"{_name}_segments"] = ORACLE[_name]

# ---------------------------------------------------------------- bands calibrated on earlier folds
_CLASS = "CAST(step > 7 AS INTEGER) + CAST(step > 14 AS INTEGER) + CAST(step > 30 AS INTEGER)"
_CONFORMAL = BT + f""",
rows_ AS (SELECT well, fold, 'test' AS part, step, ds, y, yhat, {_CLASS} AS c FROM base
          UNION ALL SELECT well, 5, 'future', step, ds, NULL, yhat, {_CLASS} FROM fut),
cal AS (SELECT b.well, t.k AS fold, b.c, abs(b.y - b.yhat) AS s FROM rows_ b, range(1, 6) t(k) WHERE b.part = 'test' AND b.fold < t.k),
own AS (SELECT well, fold, c, list(s ORDER BY s) AS l FROM cal GROUP BY well, fold, c),
alls AS (SELECT well, fold, list(s ORDER BY s) AS l FROM cal GROUP BY well, fold),
banded AS (SELECT r.*, coalesce(CASE WHEN ceil((len(o.l) + 1) * 0.8) <= len(o.l) THEN o.l[CAST(ceil((len(o.l) + 1) * 0.8) AS INTEGER)] END,
                                CASE WHEN ceil((len(a.l) + 1) * 0.8) <= len(a.l) THEN a.l[CAST(ceil((len(a.l) + 1) * 0.8) AS INTEGER)] END) AS h
           FROM rows_ r LEFT JOIN own o ON o.well = r.well AND o.fold = r.fold AND o.c = r.c
           LEFT JOIN alls a ON a.well = r.well AND a.fold = r.fold)"""
ORACLE["u1_conformal_band"] = _CONFORMAL + """
SELECT well, CAST(fold AS INTEGER) AS fold, part, step, ds, round(yhat, 6) AS yhat, round(yhat - h, 6) AS yhat_lower, round(yhat + h, 6) AS yhat_upper FROM banded"""
ORACLE["u1_conformal_coverage"] = _CONFORMAL + """
SELECT 'last_value' AS model, CAST(fold AS INTEGER) AS fold, c AS steps, count(*) AS n, round(avg(CASE WHEN y >= yhat - h AND y <= yhat + h THEN 1.0 ELSE 0.0 END), 6) AS inside,
       round(avg(2 * h), 6) AS mean_width
FROM banded WHERE part = 'test' AND h IS NOT NULL GROUP BY fold, c"""

# ---------------------------------------------------------------- lag regression: Gram sums, Gauss-Jordan, rollout
def lag_rollout(n_in: int, n_out: int, lam: float, block: int, pooled: bool = False) -> str:
    """Ridge on scaled windows per (well, fold), or per fold over all wells, and its forecast in blocks: ``fc(well, fold, out, sd)``."""
    mine = "" if pooled else "g0.well = f.well AND "
    k, width = n_in + 1, n_in + 1 + n_out
    return f"""
vals AS (SELECT well, list(qty ORDER BY pos) AS v FROM pz GROUP BY well),
win AS (SELECT well, CAST(r.i AS INTEGER) AS i, v[r.i + 1:r.i + {n_in}] AS x, v[r.i + {n_in + 1}:r.i + {n_in + n_out}] AS y
        FROM vals, range(0, 100000) r(i) WHERE r.i + {n_in + n_out} <= len(v)),
scl AS (SELECT *, list_avg([abs(a) FOR a IN x]) AS m FROM win),
ft AS (SELECT well, i, list_concat([CAST(1.0 AS DOUBLE)], list_concat([a / CASE WHEN m > 0 THEN m ELSE 1 END FOR a IN x], [b / CASE WHEN m > 0 THEN m ELSE 1 END FOR b IN y])) AS z FROM scl),
blk AS (SELECT ft.well, ft.z, min(f.fold) AS b FROM ft JOIN fits f ON f.well = ft.well AND f.train_end >= ft.i + {n_in + n_out} GROUP BY ft.well, ft.i, ft.z),
g0 AS (SELECT well, b, CAST(p.k AS INTEGER) AS p, CAST(q.k AS INTEGER) AS q, sum(z[p.k] * z[q.k]) AS g
       FROM blk, range(1, {k + 2}) p(k), range(1, {width + 1}) q(k) WHERE p.k <= {k} OR q.k = {k + 1} GROUP BY well, b, p.k, q.k),
g AS (SELECT f.well, f.fold, p, q, sum(g) AS g FROM fits f JOIN g0 ON {mine}g0.b <= f.fold GROUP BY f.well, f.fold, p, q),
mrow AS (SELECT well, fold, p, list(CASE WHEN p = q AND p > 1 THEN g * {1.0 + lam} ELSE g END ORDER BY q) AS r FROM g WHERE p <= {k} GROUP BY well, fold, p),
mat AS (SELECT well, fold, list(r ORDER BY p) AS m FROM mrow GROUP BY well, fold),
gj(well, fold, k, m) AS (
  SELECT well, fold, 0, m FROM mat
  UNION ALL
  SELECT well, fold, k + 1, [CASE WHEN i = k + 1 THEN [a / m[k + 1][k + 1] FOR a IN m[i]]
                                  ELSE [m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] FOR j IN range(1, {width + 1})] END FOR i IN range(1, {k + 1})]
  FROM gj WHERE k < {k}),
beta AS (SELECT well, fold, m FROM gj WHERE k = {k}),
err AS (SELECT well, fold, max(CASE WHEN p = 1 AND q = 1 THEN g END) AS n,
               sum(CASE WHEN p <= {k} AND q <= {k} THEN m[p][{k + 1}] * m[q][{k + 1}] * g WHEN p <= {k} AND q = {k + 1} THEN -2 * m[p][{k + 1}] * g
                        WHEN p = {k + 1} AND q = {k + 1} THEN g ELSE 0 END) AS sse
        FROM g JOIN beta USING (well, fold) GROUP BY well, fold),
start AS (SELECT f.well, f.fold, f.h, v[f.train_end - {n_in - 1}:f.train_end] AS c FROM fits f JOIN vals USING (well)),
roll(well, fold, h, c, out) AS (
  SELECT well, fold, h, c, CAST([] AS DOUBLE[]) FROM start
  UNION ALL
  SELECT well, fold, h, list_concat(c, o)[{block + 1}:{block + n_in}], list_concat(out, o)
  FROM (SELECT r.*, [s * (m[1][{k} + t] + list_sum([m[i + 1][{k} + t] * c[i] / s FOR i IN range(1, {n_in + 1})])) FOR t IN range(1, {block + 1})] AS o
        FROM (SELECT *, CASE WHEN list_avg([abs(a) FOR a IN c]) > 0 THEN list_avg([abs(a) FOR a IN c]) ELSE 1 END AS s FROM roll WHERE len(out) < h) r
        JOIN beta USING (well, fold))),
fc AS (SELECT r.well, r.fold, r.out, sqrt(e.sse / e.n) * list_avg([abs(a) FOR a IN st.c]) AS sd
       FROM roll r JOIN err e USING (well, fold) JOIN start st USING (well, fold) WHERE len(r.out) >= r.h)"""


for _name, _model, _block in (("m6_lag_regression", "LSTM", 7), ("m7_rollout", "LSTM", 1)):
    ORACLE[_name] = with_(CLEAN, POS, FOLDS, FITS, lag_rollout(14, 7, 0.1, _block)) + f"""
SELECT well, '{_model}' AS model, fold, part, ds, step, round(y, 2) AS y, round(out[step], 2) AS yhat,
       round(out[step] - 1.96 * sd, 2) AS yhat_lower, round(out[step] + 1.96 * sd, 2) AS yhat_upper
FROM rowsp JOIN fc USING (well, fold)"""

ORACLE["m8_pooled_lag"] = with_(CLEAN, POS, FOLDS, FITS, lag_rollout(24, 7, 0.1, 7, pooled=True)) + """
SELECT well, 'N-BEATS' AS model, fold, part, ds, step, round(y, 2) AS y, round(out[step], 2) AS yhat, CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper
FROM rowsp JOIN fc USING (well, fold)"""

# ---------------------------------------------------------------- regressions with regressors and the price ramp
_REGS = [p for p in PARAMS if p != "qty"]
# rows of every fit with their regressors: training rows, test rows and the 30 future rows, where the price
# rises by 5,000 and the others stay
REGROWS = f"""
px AS (SELECT well, ds, qty AS y, {', '.join(_REGS)}, CAST(row_number() OVER (PARTITION BY well ORDER BY ds) - 1 AS INTEGER) AS pos FROM clean),
lastx AS (SELECT p.* FROM px p JOIN fb ON fb.well = p.well AND p.pos = fb.n - 1),
prow AS (SELECT r.well, r.fold, r.part, r.ds, r.step, r.train_end, r.y, p.pos, {', '.join(f'p.{c}' for c in _REGS)}
         FROM rowsp r JOIN px p ON p.well = r.well AND p.ds = r.ds WHERE r.part = 'test'
         UNION ALL
         SELECT r.well, r.fold, r.part, r.ds, r.step, r.train_end, NULL, l.pos + r.step, {', '.join(f"l.{c}" + (' + 5000.0 * (r.step - 1) / 29' if c == 'price' else '') for c in _REGS)}
         FROM rowsp r JOIN lastx l ON l.well = r.well WHERE r.part = 'future')"""


def gauss(name: str, mat: str, keys: str, k: int, width: int) -> str:
    """``name(keys, k, m)``: Gauss-Jordan steps 0..k on the augmented ``mat(keys, m)`` of k rows."""
    return f"""
{name}({keys}, k, m) AS (
  SELECT {keys}, 0, m FROM {mat}
  UNION ALL
  SELECT {keys}, k + 1, [CASE WHEN i = k + 1 THEN [a / m[k + 1][k + 1] FOR a IN m[i]]
                              ELSE [m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] FOR j IN range(1, {width + 1})] END FOR i IN range(1, {k + 1})]
  FROM {name} WHERE k < {k})"""


def _waves(pos: str) -> str:
    return ", ".join(f"{f}(CAST({2.0 * math.pi * k / 12!r} AS DOUBLE) * {pos})" for k in (1, 2) for f in ("sin", "cos"))


_K = 5 + len(_REGS)
_KNOT = "exp(-0.5 * pow(({pos} - train_end * (j + 0.5) / 6.0) / greatest(train_end / 6.0, 1.0), 2))"
ORACLE["m4_ktr_values"] = with_(CLEAN, POS, FOLDS, FITS, REGROWS, f"""
trn AS (SELECT f.well, f.fold, CAST(t.j AS INTEGER) AS j, [CAST(1.0 AS DOUBLE), {_waves('p.pos')}, {', '.join(f'p.{c}' for c in _REGS)}, p.y] AS z,
               {_KNOT.format(pos='p.pos')} AS w FROM fits f JOIN px p ON p.well = f.well AND p.pos < f.train_end, range(6) t(j)),
g AS (SELECT well, fold, j, CAST(p.k AS INTEGER) AS p, CAST(q.k AS INTEGER) AS q, sum(w * z[p.k] * z[q.k]) AS g
      FROM trn, range(1, {_K + 2}) p(k), range(1, {_K + 2}) q(k) GROUP BY well, fold, j, p.k, q.k),
mrow AS (SELECT well, fold, j, p, list(CASE WHEN p = q AND p > 1 THEN g * 1.1 ELSE g END ORDER BY q) AS r FROM g WHERE p <= {_K} GROUP BY well, fold, j, p),
mat AS (SELECT well, fold, j, list(r ORDER BY p) AS m FROM mrow GROUP BY well, fold, j)""",
    gauss("gj", "mat", "well, fold, j", _K, _K + 1), f"""
beta AS (SELECT well, fold, j, [m[i][{_K + 1}] FOR i IN range(1, {_K + 1})] AS b FROM gj WHERE k = {_K}),
err AS (SELECT well, fold, sqrt(sum(CASE WHEN p <= {_K} AND q <= {_K} THEN b[p] * b[q] * g WHEN p <= {_K} THEN -2 * b[p] * g WHEN q = {_K + 1} THEN g ELSE 0 END)
                    / sum(CASE WHEN p = 1 AND q = 1 THEN g ELSE 0 END)) AS sd FROM g JOIN beta USING (well, fold, j) GROUP BY well, fold),
feat AS (SELECT *, [CAST(1.0 AS DOUBLE), {_waves('pos')}, {', '.join(_REGS)}] AS z, least(pos, train_end - 1) AS held FROM prow),
mixed AS (SELECT f.well, f.fold, f.part, f.ds, f.step, f.y, sum({_KNOT.format(pos='f.held')} * list_sum([b[i] * f.z[i] FOR i IN range(1, {_K + 1})]))
                 / sum({_KNOT.format(pos='f.held')}) AS yhat
          FROM feat f JOIN beta USING (well, fold) GROUP BY f.well, f.fold, f.part, f.ds, f.step, f.y)""") + """
SELECT well, 'KTR' AS model, fold, part, ds, step, round(y, 2) AS y, round(yhat, 2) AS yhat, round(yhat - 1.6449 * sd, 2) AS yhat_lower, round(yhat + 1.6449 * sd, 2) AS yhat_upper
FROM mixed JOIN err USING (well, fold)"""

# ---------------------------------------------------------------- DLT and LGT with given weights
def trend_smoother(kind: str, w: dict[str, float]) -> str:
    """Ridge on trend and regressors, then the recursion on its residuals: ``fcs(well, fold, h, out, sd)`` and ``beta``."""
    base = ["CAST(1.0 AS DOUBLE)", "p.pos / greatest(f.train_end, 1)"] if kind == "dlt" else []
    k = len(base) + len(_REGS)
    a, b, g = (dbl(w[x]) for x in ("alpha", "beta", "gamma"))
    if kind == "dlt":
        ahead = f"l + {dbl(w['phi'])} * b"
        trend = f"{dbl(w['phi'])} * b + {b} * e"
    else:
        ahead = f"l + {dbl(w['xi1'])} * b + {dbl(w['xi2'])} * sign(l) * pow(abs(l), {dbl(w['lam'])})"
        trend = f"{b} * (nl - l) + (1 - {b}) * b"
    level = f"base + {a} * e" if kind == "dlt" else f"{a} * (x - s[1]) + (1 - {a}) * base"
    drift = f"{dbl(w['phi'])} * b" if kind == "dlt" else "b"
    return ",".join([f"""
trn AS (SELECT f.well, f.fold, f.train_end, f.h, p.pos, [{', '.join(base + [f'p.{c}' for c in _REGS])}, p.y] AS z FROM fits f JOIN px p ON p.well = f.well AND p.pos < f.train_end),
g AS (SELECT well, fold, CAST(p.k AS INTEGER) AS p, CAST(q.k AS INTEGER) AS q, sum(z[p.k] * z[q.k]) AS g FROM trn, range(1, {k + 1}) p(k), range(1, {k + 2}) q(k) GROUP BY well, fold, p.k, q.k),
mrow AS (SELECT well, fold, p, list(CASE WHEN p = q AND p > {len(base)} THEN g * 1.1 ELSE g END ORDER BY q) AS r FROM g GROUP BY well, fold, p),
mat AS (SELECT well, fold, list(r ORDER BY p) AS m FROM mrow GROUP BY well, fold)""", gauss("gj", "mat", "well, fold", k, k + 1), f"""
beta AS (SELECT well, fold, [m[i][{k + 1}] FOR i IN range(1, {k + 1})] AS b FROM gj WHERE k = {k}),
res AS (SELECT t.well, t.fold, t.train_end, t.h, list(z[{k + 1}] - list_sum([be.b[i] * z[i] FOR i IN range(1, {k + 1})]) ORDER BY t.pos) AS v
        FROM trn t JOIN beta be USING (well, fold) GROUP BY t.well, t.fold, t.train_end, t.h),
run(well, fold, t, l, b, s, sse) AS (
  SELECT well, fold, 1, v[1], CAST(0 AS DOUBLE), [CAST(0 AS DOUBLE) FOR i IN range(12)], CAST(0 AS DOUBLE) FROM res
  UNION ALL
  SELECT well, fold, t + 1, nl, {trend}, list_append(s[2:12], s[1] + {g} * (1 - {a}) * e), sse + e * e
  FROM (SELECT *, {level} AS nl FROM (SELECT *, x - base - s[1] AS e FROM (
        SELECT r.*, {ahead} AS base, v[t + 1] AS x FROM run r JOIN res USING (well, fold) WHERE t < train_end)))),
fin AS (SELECT r.*, res.h, res.train_end FROM run r JOIN res USING (well, fold) WHERE r.t = res.train_end),
roll(well, fold, h, l, b, s, sd, out) AS (
  SELECT well, fold, h, l, b, s, sqrt(sse / (train_end - 1)), CAST([] AS DOUBLE[]) FROM fin
  UNION ALL
  SELECT well, fold, h, {ahead}, {drift}, s, sd, list_append(out, {ahead} + s[CAST(len(out) % 12 + 1 AS INTEGER)]) FROM roll WHERE len(out) < h),
fcs AS (SELECT * FROM roll WHERE len(out) = h)"""])


for _name, _kind, _w in (("m2_dlt_values", "dlt", DLT_WEIGHTS), ("m3_lgt_values", "lgt", LGT_WEIGHTS)):
    _x = (["CAST(1.0 AS DOUBLE)", "x.pos / greatest(x.train_end, 1)"] if _kind == "dlt" else []) + [f"x.{c}" for c in _REGS]
    _reg = " + ".join(f"be.b[{i + 1}] * {c}" for i, c in enumerate(_x))
    ORACLE[_name] = with_(CLEAN, POS, FOLDS, FITS, REGROWS, trend_smoother(_kind, _w), f"""
val AS (SELECT x.well, x.fold, x.part, x.ds, x.step, x.y, {_reg} + f.out[x.step] AS yhat, f.sd
        FROM prow x JOIN beta be USING (well, fold) JOIN fcs f USING (well, fold))""") + f"""
SELECT well, '{_kind.upper()}' AS model, fold, part, ds, step, round(y, 2) AS y, round(yhat, 2) AS yhat, round(yhat - 1.6449 * sd, 2) AS yhat_lower,
       round(yhat + 1.6449 * sd, 2) AS yhat_upper FROM val"""
