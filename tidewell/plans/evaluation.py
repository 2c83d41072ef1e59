"""Queries over predictions: ranks, correlations, spreads, splits, back-tests, ensembles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import backtest as T, indicators as I, leaderboard as L, metrics as E, panel as P, ranks as R, splits as S, views as V
from .base import DAILY, WEEKLY, daily_bars, pred_sql, predictions, query, rnd, sql_rnd, sql_stamp, stamp, table, weekly_bars

PRED = f"{DAILY}, {pred_sql()}"
IC = """r AS (SELECT *, rank() OVER (PARTITION BY timestamp ORDER BY y_true) + (count(*) OVER (PARTITION BY timestamp, y_true) - 1) / 2 AS ry, rank() OVER (PARTITION BY timestamp ORDER BY y_pred) + (count(*) OVER (PARTITION BY timestamp, y_pred) - 1) / 2 AS rp FROM pred),
ic AS (SELECT timestamp, count(*) AS n, corr(y_true, y_pred) AS ic, corr(ry, rp) AS rank_ic FROM r GROUP BY timestamp HAVING count(*) >= {0})"""
SPREAD = """k AS (SELECT timestamp, symbol, y_true, row_number() OVER (PARTITION BY timestamp ORDER BY y_pred, symbol) AS i, count(*) OVER (PARTITION BY timestamp) AS n FROM pred),
spread AS (SELECT timestamp, n, CAST(floor(n * 0.1) AS BIGINT) AS k, avg(y_true) FILTER (i > n - floor(n * 0.1)) AS top, avg(y_true) FILTER (i <= floor(n * 0.1)) AS bottom FROM k WHERE n >= 20 AND floor(n * 0.1) >= 1 GROUP BY timestamp, n)"""


def _pred(spark, d, horizon=1):
    return predictions(daily_bars(spark, d), horizon)


@query(f"WITH {PRED}, {IC.format(20)}, {SPREAD} SELECT {sql_stamp('timestamp')}, ic.n, {sql_rnd('ic')}, {sql_rnd('rank_ic')}, round(top - bottom, 6) + 0.0 AS spread FROM ic JOIN spread USING (timestamp)")
def q_daily_ic_flagship(spark, d):
    return flagship(spark, d)


def flagship(spark, d, least=20, q=0.1):
    """Daily correlation, rank correlation and quantile spread of a momentum signal, on days with at least `least` symbols."""
    p = _pred(spark, d)
    ic = E.daily_ic(p, least=least)
    return ic.join(E.quantile_spread(p, q, least).select("timestamp", "spread"), "timestamp").select(stamp("timestamp"), "n", rnd("ic"), rnd("rank_ic"), rnd("spread"))


@query(f"WITH {PRED}, {IC.format(2)} SELECT {sql_stamp('timestamp')}, n, {sql_rnd('ic')}, {sql_rnd('rank_ic')} FROM ic")
def e3_daily_ic(spark, d):
    return E.daily_ic(_pred(spark, d)).select(stamp("timestamp"), "n", rnd("ic"), rnd("rank_ic"))


@query(f"WITH {PRED}, {IC.format(2)} SELECT count(*) AS n, {sql_rnd('avg(ic)', 'mean')}, {sql_rnd('stddev_samp(ic)', 'std')}, {sql_rnd('avg(ic) * sqrt(count(*)) / stddev_samp(ic)', 'tstat')}, {sql_rnd('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)', 'frac_positive')} FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic)")
def e4_ic_summary(spark, d):
    s = E.summary(E.daily_ic(_pred(spark, d)), "ic")
    return s.select("n", rnd("mean"), rnd("std"), rnd("tstat"), rnd("frac_positive"))


@query(f"WITH {PRED} SELECT count(*) AS n, {sql_rnd('avg(abs(y_pred - y_true))', 'mae')}, {sql_rnd('sqrt(avg((y_pred - y_true) ** 2))', 'rmse')}, {sql_rnd('avg(CASE WHEN abs(y_true) > 1e-8 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END)', 'hit_rate')}, {sql_rnd('corr(y_true, y_pred)', 'pearson')}, {sql_rnd('quantile_cont(abs(y_pred - y_true), 0.99)', 'q99_abs')} FROM pred")
def e1_basic_metrics(spark, d):
    m = E.basic(_pred(spark, d))
    return m.select("n", *[rnd(c) for c in m.columns if c != "n"])


@query(f"""WITH {PRED}, m AS (SELECT quantile_cont(abs(y_pred - y_true), 0.5) AS medae, 1 - sum((y_pred - y_true) ** 2) / (var_pop(y_true) * count(*)) AS r2, avg(CASE WHEN abs(y_true) > 0.0018 THEN CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END END) AS h FROM pred),
r AS (SELECT y_true, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS r FROM pred),
a AS (SELECT (sum(r) FILTER (y_true > 0) - count(*) FILTER (y_true > 0) * (count(*) FILTER (y_true > 0) + 1) / 2) / (count(*) FILTER (y_true > 0) * count(*) FILTER (y_true <= 0)) AS auc FROM r)
SELECT {sql_rnd('medae')}, {sql_rnd('r2')}, round(h, 6) + 0.0 AS hit_rate_deadzone, {sql_rnd('auc')} FROM m, a""")
def e2_extended_metrics(spark, d):
    m = E.extended(_pred(spark, d), deadzone=E.deadzone(1))
    return m.select(rnd("medae"), rnd("r2"), rnd("hit_rate_deadzone"), rnd("auc"))


@query(f"WITH {PRED}, {SPREAD} SELECT {sql_stamp('timestamp')}, n, k, {sql_rnd('top')}, {sql_rnd('bottom')}, round(top - bottom, 6) + 0.0 AS spread FROM spread")
def e5_quantile_spread(spark, d):
    return E.quantile_spread(_pred(spark, d)).select(stamp("timestamp"), "n", "k", rnd("top"), rnd("bottom"), rnd("spread"))


@query(f"WITH {PRED}, {SPREAD} SELECT {sql_rnd('avg(top - bottom)', 'mean')}, {sql_rnd('stddev_samp(top - bottom)', 'std')}, {sql_rnd('avg(top - bottom) / stddev_samp(top - bottom) * sqrt(252)', 'sharpe')} FROM spread")
def e5_spread_sharpe(spark, d):
    s = E.sharpe(E.quantile_spread(_pred(spark, d)))
    return s.select(rnd("mean"), rnd("std"), rnd("sharpe"))


HALVES = "cut AS (SELECT median(i) AS m FROM (SELECT DISTINCT timestamp, dense_rank() OVER (ORDER BY timestamp) AS i FROM pred)), h AS (SELECT pred.*, abs(y_true - y_pred) AS r, dense_rank() OVER (ORDER BY timestamp) AS i FROM pred), cal AS (SELECT r FROM h, cut WHERE i <= m), te AS (SELECT r FROM h, cut WHERE i > m)"


@query(f"WITH {PRED}, {HALVES}, q AS (SELECT r AS qhat FROM cal QUALIFY row_number() OVER (ORDER BY r) = least(count(*) OVER (), CAST(ceil((count(*) OVER () + 1) * 0.9 - 1e-12) AS BIGINT))) SELECT {sql_rnd('any_value(qhat)', 'qhat')}, {sql_rnd('avg(CASE WHEN r <= qhat + 1e-12 THEN 1.0 ELSE 0.0 END)', 'coverage')}, {sql_rnd('2 * any_value(qhat)', 'width')}, count(*) AS n FROM te, q")
def e6_conformal(spark, d):
    p = _pred(spark, d)
    half = S.axis(p).agg(F.percentile("i", F.lit(0.5)).alias("m")).first()[0]
    placed = p.join(F.broadcast(S.axis(p).withColumnRenamed("t", "timestamp")), "timestamp")
    c = E.conformal(placed.filter(F.col("i") <= half), placed.filter(F.col("i") > half))
    return c.select(rnd("qhat"), rnd("coverage"), rnd("width"), "n")


@query(f"""WITH {PRED}, {IC.format(20)}, k AS (SELECT timestamp, y_true, row_number() OVER (PARTITION BY timestamp ORDER BY y_pred, symbol) AS i, count(*) OVER (PARTITION BY timestamp) AS n FROM pred),
s AS (SELECT timestamp, avg(y_true) FILTER (i > n - greatest(1, floor(n * 0.05))) - avg(y_true) FILTER (i <= greatest(1, floor(n * 0.05))) AS spread FROM k WHERE n >= 20 GROUP BY timestamp)
SELECT count(*) AS n_days, {sql_rnd('avg(ic)', 'ic')}, {sql_rnd('avg(rank_ic)', 'rank_ic')}, {sql_rnd('avg(spread)', 'spread')} FROM ic JOIN s USING (timestamp)""")
def e7_cross_section_summary(spark, d):
    p = _pred(spark, d)
    both = E.daily_ic(p, least=20).join(E.quantile_spread(p, q=0.05, at_least_one=True).select("timestamp", "spread"), "timestamp")
    return both.agg(F.count(F.lit(1)).alias("n_days"), rnd(F.avg("ic"), "ic"), rnd(F.avg("rank_ic"), "rank_ic"), rnd(F.avg("spread"), "spread"))


BOOK = """k AS (SELECT timestamp, symbol, y_true, row_number() OVER (PARTITION BY timestamp ORDER BY y_pred, symbol) AS i, count(*) OVER (PARTITION BY timestamp) AS n FROM pred),
book AS (SELECT timestamp, symbol, y_true, CASE WHEN i > n - greatest(1, floor(n * 0.1)) THEN 1 WHEN i <= greatest(1, floor(n * 0.1)) THEN -1 END / greatest(1, floor(n * 0.1)) AS w FROM k WHERE n >= 20 AND (i > n - greatest(1, floor(n * 0.1)) OR i <= greatest(1, floor(n * 0.1)))),
days AS (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS p FROM (SELECT DISTINCT timestamp FROM book)),
pairs AS (SELECT days.timestamp, symbol FROM days JOIN book USING (timestamp) UNION SELECT days.timestamp, symbol FROM days JOIN book ON book.timestamp = days.p),
turn AS (SELECT x.timestamp, sum(abs(coalesce(b.w, 0) - coalesce(a.w, 0))) / 2 AS turnover FROM pairs x JOIN days USING (timestamp) LEFT JOIN book b ON b.timestamp = x.timestamp AND b.symbol = x.symbol LEFT JOIN book a ON a.timestamp = days.p AND a.symbol = x.symbol GROUP BY x.timestamp),
ret AS (SELECT timestamp, gross, turnover, gross - turnover * 5 / 10000 AS net FROM (SELECT timestamp, sum(w * y_true) AS gross FROM book GROUP BY timestamp) JOIN turn USING (timestamp)),
eq AS (SELECT *, exp(sum(ln(greatest(1 + net, 1e-12))) OVER (ORDER BY timestamp)) AS equity FROM ret),
curve AS (SELECT *, max(equity) OVER (ORDER BY timestamp) AS peak, equity / max(equity) OVER (ORDER BY timestamp) - 1 AS drawdown FROM eq)"""


def _curve(spark, d):
    return T.equity(T.daily_returns(T.weights(_pred(spark, d)), 5.0))


@query(f"WITH {PRED}, {BOOK} SELECT {sql_stamp('timestamp')}, {sql_rnd('gross')}, {sql_rnd('turnover')}, {sql_rnd('net')} FROM ret")
def e8_daily_returns(spark, d):
    return T.daily_returns(T.weights(_pred(spark, d)), 5.0).select(stamp("timestamp"), rnd("gross"), rnd("turnover"), rnd("net"))


@query(f"WITH {PRED}, {BOOK} SELECT count(*) AS n_days, {sql_rnd('avg(net)', 'mean')}, {sql_rnd('avg(net) / stddev_samp(net) * sqrt(252)', 'sharpe')}, {sql_rnd('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')}, {sql_rnd('avg(turnover)', 'mean_turnover')}, {sql_rnd('min(drawdown)', 'max_drawdown')}, {sql_rnd('arg_max(equity, timestamp) - 1', 'total_return')} FROM curve")
def e8_backtest_report(spark, d):
    r = T.report(_curve(spark, d))
    return r.select("n_days", *[rnd(c) for c in r.columns if c != "n_days"])


@query(f"WITH {PRED}, {BOOK} SELECT {sql_stamp('timestamp')}, {sql_rnd('equity')}, {sql_rnd('peak')}, {sql_rnd('drawdown')} FROM curve")
def w19_drawdown(spark, d):
    return _curve(spark, d).select(stamp("timestamp"), rnd("equity"), rnd("peak"), rnd("drawdown"))


@query(f"WITH {PRED}, {SPREAD} SELECT {sql_stamp('timestamp')}, round(sum(top - bottom) OVER (ORDER BY timestamp), 6) + 0.0 AS cumulative FROM spread")
def w18_cumulative_spread(spark, d):
    s = E.quantile_spread(_pred(spark, d))
    return s.withColumn("cumulative", F.sum("spread").over(Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0))).select(stamp("timestamp"), rnd("cumulative"))


@query(f"WITH {PRED}, {SPREAD}, s AS (SELECT timestamp, top - bottom AS s FROM spread) SELECT {sql_stamp('timestamp')}, CASE WHEN count(*) OVER w = 10 THEN round(avg(s) OVER w / stddev_samp(s) OVER w * sqrt(252), 6) + 0.0 END AS rolling FROM s WINDOW w AS (ORDER BY timestamp ROWS 9 PRECEDING)")
def w21_rolling_sharpe(spark, d):
    s = E.quantile_spread(_pred(spark, d)).withColumn("all", F.lit(1))
    return s.select(stamp("timestamp"), rnd(I.rolling_sharpe("spread", ["all"], "timestamp", 10), "rolling"))


@query(f"WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY y_pred DESC, symbol) AS rank, count(*) OVER (PARTITION BY timestamp) AS n FROM pred) SELECT symbol, {sql_stamp('timestamp')}, rank, round(rank / n, 6) AS rank_pct, CASE WHEN rank / n <= 0.1 THEN 'long' WHEN rank / n >= 0.9 THEN 'short' ELSE 'neutral' END AS bucket FROM r")
def w14_rank_cross_section(spark, d):
    return E.rank_cross_section(_pred(spark, d)).select("symbol", stamp("timestamp"), F.col("rank").cast("long").alias("rank"), rnd("rank_pct"), "bucket")


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS r FROM events")
def w15_average_rank(spark, d):
    return table(spark, d, "events").select("event_id", E.average_rank("value", ["user_id"]).alias("r"))


@query(f"WITH {PRED} SELECT {sql_stamp('timestamp')}, {sql_rnd('avg(y_true)', 'y_true')}, {sql_rnd('avg(y_pred)', 'y_pred')} FROM pred GROUP BY timestamp")
def a7_mean_by_time(spark, d):
    return _pred(spark, d).groupBy("timestamp").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred")).select(stamp("timestamp"), rnd("y_true"), rnd("y_pred"))


@query(f"WITH {PRED}, e AS (SELECT list_distinct(quantile_cont(y_pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM pred) SELECT CAST(len(list_filter(e, lambda x: x < y_pred)) AS INTEGER) AS bucket, count(*) AS n, {sql_rnd('avg(y_true)', 'mean_true')}, {sql_rnd('avg(y_pred)', 'mean_pred')} FROM pred, e GROUP BY 1")
def a8_quantile_buckets(spark, d):
    return E.buckets(_pred(spark, d)).select("bucket", "n", rnd("mean_true"), rnd("mean_pred"))


@query(f"WITH {PRED} SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT timestamp) AS n_days, count(*) AS n FROM pred")
def a9_summary(spark, d):
    return _pred(spark, d).agg(F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("timestamp").alias("n_days"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DAILY}, {pred_sql(1, 'p1')}, {pred_sql(2, 'p2')}, {pred_sql(5, 'p5')}, m AS (SELECT 'a' AS model, * FROM p1 UNION ALL SELECT 'b', * FROM p2 UNION ALL SELECT 'c', * FROM p5) SELECT metric, round(max(v) FILTER (model = 'a'), 6) + 0.0 AS a, round(max(v) FILTER (model = 'b'), 6) + 0.0 AS b, round(max(v) FILTER (model = 'c'), 6) + 0.0 AS c FROM (SELECT model, 'mae' AS metric, avg(abs(y_pred - y_true)) AS v FROM m GROUP BY model UNION ALL SELECT model, 'pearson', corr(y_true, y_pred) FROM m GROUP BY model) GROUP BY metric")
def a11_model_matrix(spark, d):
    m = E.basic(_models(spark, d), ["model"])
    long = m.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("mae", "pearson")])).alias("x")).select("model", "x.metric", "x.v")
    return P.pivot_last(long, ["metric"], "model", "v", ["a", "b", "c"]).select("metric", rnd("a"), rnd("b"), rnd("c"))


def _models(spark, d):
    b = daily_bars(spark, d)
    out = [predictions(b, h).withColumn("model", F.lit(m)) for h, m in ((1, "a"), (2, "b"), (5, "c"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


MODELS = f"""{DAILY}, {pred_sql(1, 'p1')}, {pred_sql(2, 'p2')}, {pred_sql(5, 'p5')}, m AS (SELECT 'a' AS model, 0.5 AS w, * FROM p1 UNION ALL SELECT 'b', 0.3, * FROM p2 UNION ALL SELECT 'c', 0.2, * FROM p5),
rk AS (SELECT *, row_number() OVER (PARTITION BY timestamp, model ORDER BY y_pred DESC, symbol) / count(*) OVER (PARTITION BY timestamp, model) AS rank_pct FROM m),
ens AS (SELECT timestamp, symbol, count(*) AS n_models, sum(rank_pct * w) / sum(w) AS ensemble_rank, stddev_pop(rank_pct) AS disagreement, CAST(sum(CASE WHEN rank_pct <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS long_votes, CAST(sum(CASE WHEN rank_pct >= 0.9 AND rank_pct > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS short_votes FROM rk GROUP BY timestamp, symbol)"""


def _ensemble(spark, d, require):
    return E.ensemble(E.rank_cross_section(_models(spark, d), by=["timestamp", "model"]), {"a": 0.5, "b": 0.3, "c": 0.2}, require=require)


@query(f"WITH {MODELS} SELECT symbol, {sql_stamp('timestamp')}, n_models, {sql_rnd('ensemble_rank')}, {sql_rnd('disagreement')}, long_votes, short_votes, round(0.5 - ensemble_rank, 6) + 0.0 AS signal FROM ens WHERE n_models >= 3")
def e10_rank_ensemble(spark, d):
    return _ensemble(spark, d, 3).select("symbol", stamp("timestamp"), "n_models", rnd("ensemble_rank"), rnd("disagreement"), "long_votes", "short_votes", rnd("signal"))


@query(f"WITH {MODELS} SELECT symbol, long_votes, short_votes, {sql_rnd('ensemble_rank')} FROM ens WHERE n_models = 3 AND timestamp = (SELECT max(timestamp) FROM (SELECT timestamp FROM m GROUP BY timestamp HAVING count(DISTINCT model) = 3))")
def a12_votes_on_last_common_day(spark, d):
    """x3 and a12: the last day that all models have, and each symbol's votes on it."""
    m = _models(spark, d)
    last = V.common_days(m, "model", "timestamp").agg(F.max("timestamp").alias("timestamp"))
    return _ensemble(spark, d, 3).join(F.broadcast(last), "timestamp").select("symbol", "long_votes", "short_votes", rnd("ensemble_rank"))


@query(f"WITH {MODELS}, k AS (SELECT timestamp, model, y_true, row_number() OVER (PARTITION BY timestamp, model ORDER BY y_pred, symbol) AS i, count(*) OVER (PARTITION BY timestamp, model) AS n FROM m), s AS (SELECT timestamp, model, avg(y_true) FILTER (i > n - floor(n * 0.1)) - avg(y_true) FILTER (i <= floor(n * 0.1)) AS s FROM k WHERE n >= 20 GROUP BY timestamp, model), c AS (SELECT timestamp, model, sum(s) OVER (PARTITION BY model ORDER BY timestamp) AS c FROM s) SELECT {sql_stamp('timestamp')}, round(max(c) FILTER (model = 'a'), 6) + 0.0 AS a, round(max(c) FILTER (model = 'b'), 6) + 0.0 AS b, round(max(c) FILTER (model = 'c'), 6) + 0.0 AS c FROM c GROUP BY timestamp")
def e9_cumulative_by_model(spark, d):
    m = _models(spark, d).withColumn("key", F.struct("timestamp", "model"))
    s = E.quantile_spread(m, time="key").select("key.timestamp", "key.model", "spread")
    c = s.withColumn("c", F.sum("spread").over(Window.partitionBy("model").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)))
    return P.pivot_last(c, ["timestamp"], "model", "c", ["a", "b", "c"]).select(stamp("timestamp"), rnd("a"), rnd("b"), rnd("c"))


# Splits

META = f"{DAILY}, meta AS (SELECT symbol, timestamp, lead(timestamp, 2) OVER (PARTITION BY symbol ORDER BY timestamp) AS target_timestamp FROM bars QUALIFY target_timestamp IS NOT NULL), ax AS (SELECT timestamp AS t, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM meta))"


def _meta(spark, d):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return daily_bars(spark, d).select("symbol", "timestamp", F.lead("timestamp", 2).over(w).alias("target_timestamp")).filter("target_timestamp IS NOT NULL")


@query(f"WITH {META}, c AS (SELECT max(t) FILTER (i = CAST(floor(n * 0.7) AS INT) - 1) AS a, max(t) FILTER (i = CAST(floor(n * 0.85) AS INT) - 1) AS b FROM ax) SELECT symbol, {sql_stamp('timestamp')}, CASE WHEN timestamp <= a AND target_timestamp <= a THEN 'train' WHEN timestamp > a AND timestamp <= b AND target_timestamp <= b THEN 'val' WHEN timestamp > b THEN 'test' END AS split FROM meta, c")
def d1_split_fractions(spark, d):
    return S.split_fractions(_meta(spark, d)).select("symbol", stamp("timestamp"), "split")


@query(f"WITH {META}, o AS (SELECT symbol, timestamp, row_number() OVER (ORDER BY timestamp, symbol) - 1 AS i, count(*) OVER () AS n FROM meta) SELECT symbol, {sql_stamp('timestamp')}, CASE WHEN i < floor(n * 0.75) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM o")
def d2_split_positions(spark, d):
    return S.split_positions(_meta(spark, d), ["timestamp", "symbol"], 0.75, 0.15).select("symbol", stamp("timestamp"), "split")


@query(f"WITH {META} SELECT symbol, {sql_stamp('timestamp')}, CASE WHEN timestamp >= TIMESTAMP '2024-01-05' AND target_timestamp < TIMESTAMP '2024-01-18' THEN 'train' WHEN timestamp >= TIMESTAMP '2024-01-18' AND target_timestamp < TIMESTAMP '2024-01-24' THEN 'val' WHEN timestamp >= TIMESTAMP '2024-01-24' THEN 'test' END AS split FROM meta")
def d3_split_bounds(spark, d):
    return S.split_bounds(_meta(spark, d), "2024-01-05", "2024-01-18", "2024-01-24").select("symbol", stamp("timestamp"), "split")


@query(f"WITH {META} SELECT symbol, {sql_stamp('timestamp')} FROM meta WHERE timestamp >= TIMESTAMP '2024-01-20' AND target_timestamp <= TIMESTAMP '2024-01-28'")
def d3_test_rows(spark, d):
    return S.test_rows(_meta(spark, d), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 28)).select("symbol", stamp("timestamp"))


@query(f"""WITH {META}, f AS (SELECT fold, (SELECT t FROM ax WHERE i = n - (4 - fold) * (n // 5) - 1) AS a, (SELECT t FROM ax WHERE i = n - (4 - fold) * (n // 5) + n // 5 - 1) AS b FROM (SELECT unnest(range(4)) AS fold)),
r AS (SELECT symbol, timestamp, fold, CASE WHEN timestamp <= a AND target_timestamp <= a THEN 'train' WHEN timestamp > a AND timestamp <= b AND target_timestamp <= b THEN 'test' END AS role FROM meta, f)
SELECT CAST(fold AS INTEGER) AS fold, symbol, {sql_stamp('timestamp')}, role FROM r WHERE role IS NOT NULL""")
def d4_purged_folds(spark, d):
    return S.purged_folds(_meta(spark, d), 4).select("fold", "symbol", stamp("timestamp"), "role")


PURGED = "SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM (SELECT fold, CASE WHEN timestamp >= s.t AND timestamp < e.t AND target_timestamp < v.t THEN 'train' WHEN timestamp >= v.t AND target_timestamp < w.t THEN 'val' END AS role FROM meta, f JOIN ax s ON s.i = f.s JOIN ax e ON e.i = f.e JOIN ax v ON v.i = f.v JOIN ax w ON w.i = f.w) WHERE role IS NOT NULL GROUP BY 1, 2"


@query(f"WITH {META}, f AS (SELECT fold, 0 AS s, v AS e, v, v + 4 AS w FROM (SELECT fold, (SELECT max(n) FROM ax) - 4 - (4 - fold) * 5 AS v FROM (SELECT unnest(range(1, 4)) AS fold))) {PURGED}")
def d5_walk_boundaries(spark, d):
    m = _meta(spark, d)
    return S.purged_fold_table(m, S.walk_boundaries(S.axis(m).count(), 3, 4, 4, step=5)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {META}, g AS (SELECT j, (SELECT max(n) FROM ax) - 4 - j * 3 AS w FROM (SELECT unnest(range(20)) AS j)), k AS (SELECT w - 10 AS s, w - 4 AS e, w - 3 AS v, w FROM g WHERE w - 10 >= 0), f AS (SELECT row_number() OVER (ORDER BY w) AS fold, * FROM k) {PURGED}")
def d6_walk_plan(spark, d):
    """Rolling folds back from the test span with an embargo, purged by target time."""
    m = _meta(spark, d)
    return S.purged_fold_table(m, S.walk_plan(S.axis(m).count(), 3, 3, 4, 6, 1, 4)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {META}, ay AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_timestamp AS t FROM meta)), s AS (SELECT fold, role, a + (fold - 1) * 4 AS a, b + (fold - 1) * 4 AS b FROM (SELECT unnest(range(1, 20)) AS fold), (VALUES ('train', 0, 8), ('val', 10, 13), ('test', 14, 17)) v(role, a, b)), k AS (SELECT * FROM s WHERE fold IN (SELECT fold FROM s WHERE role = 'test' AND b < (SELECT max(n) FROM ay)))
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM meta JOIN ay ON meta.target_timestamp = ay.t JOIN k ON i BETWEEN a AND b GROUP BY 1, 2""")
def d7_walk_forward_targets(spark, d):
    """On target times alone: early validation rows start before the last training target is known (d7_walk_forward_purged is free of that)."""
    m = _meta(spark, d)
    folds = S.walk_forward(S.axis(m, "target_timestamp").count(), 10, 4, 4, 4, embargo=1)
    return S.fold_table(m, folds, "target_timestamp").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {META}, s AS (SELECT fold, role, a + (fold - 1) * 4 AS a, b + (fold - 1) * 4 AS b FROM (SELECT unnest(range(1, 20)) AS fold), (VALUES ('train', 0, 9), ('val', 10, 12), ('test', 13, 16)) v(role, a, b)), k AS (SELECT * FROM s WHERE fold IN (SELECT fold FROM s WHERE role = 'test' AND b < (SELECT max(n) FROM ax)))
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n FROM meta JOIN ax x ON meta.timestamp = x.t JOIN ax y ON meta.target_timestamp = y.t JOIN k ON x.i BETWEEN a AND b AND y.i BETWEEN a AND b GROUP BY 1, 2""")
def d7_walk_forward_purged(spark, d):
    """Rows whose decision and target both lie in a span."""
    m = _meta(spark, d)
    return S.fold_table(m, S.walk_forward(S.axis(m).count(), 10, 3, 4, 4), "timestamp", "target_timestamp").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {META}, ay AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT target_timestamp AS t FROM meta)) SELECT symbol, {sql_stamp('timestamp')}, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM meta JOIN ay ON target_timestamp = t")
def d8_split_targets(spark, d):
    return S.split_targets(_meta(spark, d)).select("symbol", stamp("timestamp"), "split")


@query(f"WITH {META} SELECT {sql_stamp('timestamp')}, CAST(i // 50 AS INTEGER) AS chunk, count(*) AS n FROM (SELECT timestamp, row_number() OVER (PARTITION BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY timestamp) AS n FROM meta) WHERE n >= 20 GROUP BY timestamp, i // 50")
def d9_timestamp_batches(spark, d):
    return S.timestamp_batches(_meta(spark, d), 20, 50, seed=3).groupBy("timestamp", "chunk").agg(F.count(F.lit(1)).alias("n")).select(stamp("timestamp"), "chunk", "n")


@query(f"WITH {META} SELECT {sql_stamp('t', 'timestamp')}, i FROM ax")
def a13_time_axis(spark, d):
    return S.axis(_meta(spark, d)).select(stamp("t", "timestamp"), F.col("i").cast("long").alias("i"))


@query(f"WITH {PRED}, f AS (SELECT symbol % 5 AS fold, avg(abs(y_pred - y_true)) AS mae, corr(y_true, y_pred) AS pearson FROM pred GROUP BY 1) SELECT fold, {sql_rnd('mae')}, {sql_rnd('pearson')} FROM f")
def e12_fold_table(spark, d):
    return E.basic(_pred(spark, d).withColumn("fold", F.col("symbol") % 5), ["fold"]).select("fold", rnd("mae"), rnd("pearson"))


@query(f"WITH {PRED}, f AS (SELECT symbol % 5 AS fold, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY 1) SELECT {sql_rnd('avg(mae)', 'mean')}, {sql_rnd('stddev_pop(mae)', 'std')} FROM f")
def a10_over_folds(spark, d):
    return E.basic(_pred(spark, d).withColumn("fold", F.col("symbol") % 5), ["fold"]).agg(rnd(F.avg("mae"), "mean"), rnd(F.stddev_pop("mae"), "std"))


@query(f"WITH {PRED}, f AS (SELECT symbol % 5 AS fold, avg(abs(y_pred - y_true)) AS mae, CASE WHEN symbol % 5 = 2 THEN NULL ELSE corr(y_true, y_pred) END AS ic FROM pred GROUP BY 1) SELECT fold, round(coalesce(ic, -mae), 6) + 0.0 AS score FROM f")
def e14_pick_score(spark, d):
    """A candidate's score: the first metric that is there."""
    m = E.basic(_pred(spark, d).withColumn("fold", F.col("symbol") % 5), ["fold"]).withColumn("ic", F.when(F.col("fold") != 2, F.col("pearson")))
    return m.select("fold", rnd(F.coalesce(F.nanvl("ic", F.lit(None).cast("double")), -F.col("mae")), "score"))


@query(f"WITH {PRED} SELECT round(1 - corr(y_pred, y_true), 6) + 0.0 AS ic_loss, round(avg((y_pred - y_true) ** 2) + 0.5 * (1 - corr(y_pred, y_true)), 6) AS combined FROM pred")
def e13_ic_loss(spark, d):
    """The forward value of a loss that adds a correlation term to the squared error."""
    e = F.col("y_pred") - F.col("y_true")
    loss = 1 - E.pearson("y_pred", "y_true")
    return _pred(spark, d).agg(rnd(loss, "ic_loss"), rnd(F.avg(e * e) + 0.5 * loss, "combined"))


RUNS = """f AS (SELECT symbol % 40 AS run, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae FROM pred GROUP BY 1),
runs AS (SELECT run, rmse, mae, CASE WHEN run % 13 = 5 THEN NULL WHEN run % 11 = 3 THEN 'mlp' ELSE 'ridge' END AS kind, CASE WHEN run % 17 <> 4 THEN run % 9 END AS lookback, 1 + CAST(run % 5 = 2 AS INTEGER) AS horizon, CASE WHEN run % 7 = 6 THEN '1Hour' ELSE '1Day' END AS timeframe, CASE WHEN run % 6 = 1 THEN ['close_lag0', 'vwap_lag0'] ELSE ['close_lag0'] END AS features FROM f)"""


def _runs(spark, d):
    """Saved runs: a fortieth of the symbols each, with settings that differ."""
    m, run = E.basic(_pred(spark, d).withColumn("run", F.col("symbol") % 40), ["run"]).select("run", "rmse", "mae"), F.col("run")
    kind = F.when(run % 13 == 5, F.lit(None)).when(run % 11 == 3, "mlp").otherwise("ridge")
    features = F.when(run % 6 == 1, F.array(F.lit("close_lag0"), F.lit("vwap_lag0"))).otherwise(F.array(F.lit("close_lag0")))
    return m.select("run", "rmse", "mae", kind.alias("kind"), F.when(run % 17 != 4, run % 9).alias("lookback"), (1 + (run % 5 == 2).cast("int")).alias("horizon"), F.when(run % 7 == 6, "1Hour").otherwise("1Day").alias("timeframe"), features.alias("features"))


@query(f"""WITH {PRED}, {RUNS}, r AS (SELECT *, CASE WHEN kind IS NULL THEN 'load_error' WHEN kind <> 'ridge' THEN 'not_a_ridge' WHEN lookback IS NULL THEN 'missing_settings' WHEN horizon <> 1 THEN 'horizon_mismatch' WHEN lookback >= 7 THEN 'lookback_not_smaller' WHEN timeframe <> '1Day' THEN 'timeframe_mismatch' WHEN list_contains(features, 'vwap_lag0') THEN 'missing_features' END AS skip_reason FROM runs)
SELECT run, skip_reason, CASE WHEN skip_reason IS NULL THEN 'ok' ELSE 'skip' END AS status, CASE WHEN skip_reason IS NULL THEN round(rmse, 6) END AS rmse, CASE WHEN skip_reason IS NULL THEN row_number() OVER (PARTITION BY skip_reason IS NULL ORDER BY rmse, run) END AS place FROM r""")
def e11_leaderboard(spark, d):
    """Saved runs by their error on the candidate's rows, those that cannot be compared with the reason."""
    r = L.report(_runs(spark, d), lookback=7, horizon=1, timeframe="1Day", available=["close_lag0", "close_lag1", "volume_lag0"])
    placed = L.ordered(r.filter("status = 'ok'"), ["rmse", "mae"])
    return placed.select("run", "skip_reason", "status", rnd("rmse"), "place").unionByName(r.filter("status = 'skip'").select("run", "skip_reason", "status", F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("long").alias("place")))


@query(f"WITH {PRED}, {RUNS}, v AS (SELECT run, run % 3 AS family, CASE WHEN run % 3 = 1 AND run > 5 THEN rmse END AS rmse, CASE WHEN run % 3 <> 2 THEN mae END AS mae FROM runs) SELECT family, run, CASE family WHEN 1 THEN 'rmse' WHEN 0 THEN 'mae' END AS by, row_number() OVER (PARTITION BY family ORDER BY CASE family WHEN 1 THEN rmse WHEN 0 THEN mae END NULLS LAST, run) AS place FROM v")
def o8_leaderboard_order(spark, d):
    """Runs of each family by the first listed metric that any of them has; runs without it come last, families without any go by run."""
    r = _runs(spark, d).withColumn("family", F.col("run") % 3)
    some = r.select("run", "family", F.when((F.col("family") == 1) & (F.col("run") > 5), F.col("rmse")).alias("rmse"), F.when(F.col("family") != 2, F.col("mae")).alias("mae"))
    return L.ordered(some, ["rmse", "mae"], group=("family",)).select("family", "run", "by", "place")


@query(f"WITH {PRED} SELECT symbol, {sql_stamp('timestamp')}, CASE WHEN y_pred > 0.1 THEN 'long' WHEN y_pred < -0.1 THEN 'short' ELSE 'neutral' END AS side, CASE WHEN abs(y_true) > 0.15 * 0.012 * sqrt(1) THEN CAST(sign(y_true) AS INTEGER) ELSE 0 END AS direction FROM pred")
def p10_p13_side_and_deadzone(spark, d):
    side = F.when(F.col("y_pred") > 0.1, "long").when(F.col("y_pred") < -0.1, "short").otherwise("neutral")
    return _pred(spark, d).select("symbol", stamp("timestamp"), side.alias("side"), F.when(F.abs("y_true") > E.deadzone(1), F.signum("y_true").cast("int")).otherwise(0).alias("direction"))


@query(f"WITH {MODELS} SELECT symbol, {sql_rnd('ensemble_rank')}, {sql_rnd('disagreement')} FROM ens WHERE n_models = 3 AND timestamp = (SELECT max(timestamp) FROM ens WHERE n_models = 3) ORDER BY ens.ensemble_rank, ens.disagreement, symbol LIMIT 10")
def o9_best_agreed(spark, d):
    e = _ensemble(spark, d, 3)
    last = e.agg(F.max("timestamp").alias("timestamp"))
    return e.join(F.broadcast(last), "timestamp").orderBy("ensemble_rank", "disagreement", "symbol").limit(10).select("symbol", rnd("ensemble_rank"), rnd("disagreement"))


@query(f"WITH {PRED} SELECT symbol, {sql_stamp('timestamp')}, i FROM (SELECT symbol, timestamp, row_number() OVER (ORDER BY target_timestamp, timestamp, symbol) - 1 AS i FROM pred)")
def o7_stable_order(spark, d):
    """A total order over (target time, time, symbol) as places."""
    return R.global_places(_pred(spark, d), ["target_timestamp", "timestamp", "symbol"], "i").select("symbol", stamp("timestamp"), F.col("i").cast("long").alias("i"))


@query(f"WITH {PRED} SELECT * FROM (SELECT 'top' AS side, symbol, {sql_stamp('timestamp')} FROM pred QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY y_pred DESC, symbol) <= 3) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, symbol, {sql_stamp('timestamp')} FROM pred QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY y_pred, symbol) <= 3)")
def o6_top_and_bottom(spark, d):
    p = _pred(spark, d).select("symbol", "timestamp", "y_pred")
    top = V.top_per_group(p, ["timestamp"], [F.col("y_pred").desc(), F.col("symbol")], 3).withColumn("side", F.lit("top"))
    low = V.top_per_group(p, ["timestamp"], [F.col("y_pred").asc(), F.col("symbol")], 3).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).select("side", "symbol", stamp("timestamp"))


@query(f"WITH {WEEKLY} SELECT symbol, count(*) AS n, {sql_rnd('avg(close)', 'mean')}, {sql_rnd('stddev_samp(close)', 'std', 4)}, min(close) AS min, {sql_rnd('quantile_cont(close, 0.25)', 'q25')}, {sql_rnd('quantile_cont(close, 0.5)', 'q50')}, {sql_rnd('quantile_cont(close, 0.75)', 'q75')}, max(close) AS max FROM bars GROUP BY symbol")
def a4_profile(spark, d):
    return V.profile(weekly_bars(spark, d), ["close"], ["symbol"]).select("symbol", "n", rnd("mean"), rnd("std", digits=4), "min", rnd("q25"), rnd("q50"), rnd("q75"), "max")


@query("SELECT event_id, round(CAST(event_id * 37 % 900 AS DOUBLE) / 1000 * 0.00005 + CAST(event_id * 11 % 200 AS DOUBLE) / 1000 * 0.0004, 9) AS cost FROM events")
def p11_token_cost(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(scalar.token_cost(F.col("event_id") * 37 % 900, F.col("event_id") * 11 % 200), 9).alias("cost"))


@query("SELECT event_type, round(avg(event_id * 37 % 900), 2) AS tokens_in, round(avg(event_id * 11 % 200), 2) AS tokens_out, round((avg(event_id * 37 % 900) / 1000 * 0.00005 + avg(event_id * 11 % 200) / 1000 * 0.0004) * 2000, 4) AS daily_cost FROM events GROUP BY event_type")
def p12_daily_cost(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.col("event_id") * 37 % 900).alias("a"), F.avg(F.col("event_id") * 11 % 200).alias("b"))
    return e.select("event_type", F.bround("a", 2).alias("tokens_in"), F.bround("b", 2).alias("tokens_out"), F.bround(scalar.token_cost(F.col("a"), F.col("b")) * 2000, 4).alias("daily_cost"))
