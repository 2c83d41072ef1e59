"""Queries over models, artifacts, sources and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import leaderboard as L, models as M, panel as P, splits as S, views as V
from ..sources.tables import append_log, overwrite, read_csv, read_pages, read_query, replace_whole, write_csv
from ..streaming import streams as T
from .base import DAILY, daily_bars, query, rnd, sql_rnd, sql_stamp, stamp, table


def _shared(spark) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


SUP = "sup AS (SELECT * FROM (SELECT symbol, timestamp, lead(timestamp) OVER w AS target_timestamp, close AS close_lag0, lag(close) OVER w AS close_lag1, CASE WHEN close > 0 AND lead(close) OVER w > 0 THEN ln(lead(close) OVER w / close) END AS y FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) WHERE y IS NOT NULL AND close_lag1 IS NOT NULL)"


FEATURES = ["close_lag0", "close_lag1"]


def _supervised(spark, d):
    return P.supervised(daily_bars(spark, d), ["close"], 2, 1)


@query(f"WITH {DAILY}, {SUP} SELECT round(regr_slope(y, close_lag0), 8) AS slope, round(regr_intercept(y, close_lag0), 8) AS intercept FROM sup")
def m7_least_squares(spark, d):
    m = M.fit_ridge(_supervised(spark, d), ["close_lag0"], alpha=0.0)
    return spark.range(1).select(F.round(F.lit(m["weights"][0]), 8).alias("slope"), F.round(F.lit(m["intercept"]), 8).alias("intercept"))


@query(f"""WITH {DAILY}, {SUP}, s AS (SELECT count(*) AS n, avg(close_lag0) AS mx, stddev_pop(close_lag0) AS sx, avg(y) AS my, covar_pop(close_lag0, y) AS c FROM sup), w AS (SELECT c / sx * n / (n + 10) / sx AS w, mx, my FROM s)
SELECT round(w, 8) AS slope, round(my - w * mx, 8) AS intercept FROM w""")
def m7_ridge(spark, d):
    m = M.fit_ridge(_supervised(spark, d), ["close_lag0"], alpha=10.0)
    return spark.range(1).select(F.round(F.lit(m["weights"][0]), 8).alias("slope"), F.round(F.lit(m["intercept"]), 8).alias("intercept"))


@query(f"""WITH {DAILY}, {SUP}, ax AS (SELECT timestamp AS t, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM sup)),
f AS (SELECT fold, (SELECT t FROM ax WHERE i = n - (3 - fold) * (n // 4) - 1) AS a, (SELECT t FROM ax WHERE i = n - (3 - fold) * (n // 4) + n // 4 - 1) AS b FROM (SELECT unnest(range(3)) AS fold)),
r AS (SELECT fold, close_lag0 AS x1, close_lag1 AS x2, y, CASE WHEN timestamp <= a AND target_timestamp <= a THEN 'train' WHEN timestamp > a AND timestamp <= b AND target_timestamp <= b THEN 'test' END AS role FROM sup, f),
m AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) / s1 / s2 AS c, covar_pop(x1, y) / s1 AS q1, covar_pop(x2, y) / s2 AS q2 FROM r WHERE role = 'train' GROUP BY fold),
w AS (SELECT *, CAST(penalty AS DOUBLE) AS alpha, n * ((n + penalty) * q1 - n * c * q2) / ((n + penalty) ** 2 - (n * c) ** 2) / s1 AS w1, n * ((n + penalty) * q2 - n * c * q1) / ((n + penalty) ** 2 - (n * c) ** 2) / s2 AS w2 FROM m, (SELECT unnest([0.1, 1, 10, 1000]::DOUBLE[]) AS penalty)),
e AS (SELECT w.fold, alpha, sqrt(avg((my + w1 * (x1 - m1) + w2 * (x2 - m2) - y) ** 2)) AS rmse FROM w JOIN r ON r.fold = w.fold WHERE role = 'test' GROUP BY w.fold, alpha)
SELECT alpha, round(avg(rmse), 6) + 0.0 AS rmse FROM e GROUP BY alpha""")
def m7_ridge_cv(spark, d):
    """Error of each penalty over purged folds."""
    folds = S.purged_folds(_supervised(spark, d), 3)
    return M.cross_validate(folds, FEATURES, "y", [0.1, 1.0, 10.0, 1000.0]).select("alpha", rnd("rmse"))


@query()
def m8_boosted_trees(spark, d):
    """Gradient-boosted trees by Spark's own library on a time split: eight settings, stopped and chosen on the validation span."""
    rows = S.split_fractions(_supervised(spark, d)).repartition("symbol").sortWithinPartitions("symbol", "timestamp")
    grid = [{"maxDepth": depth, "stepSize": step, "minInstancesPerNode": least} for depth in (2, 3) for step in (0.1, 0.3) for least in (1, 5)]
    model, _ = M.fit_boosted(rows, FEATURES, "y", grid, rounds=4)
    return model.transform(M.assemble(rows.filter("split = 'test'"), FEATURES)).select("symbol", stamp("timestamp"), rnd("y"), rnd("prediction"))


LINEAR = {"kind": "ridge", "features": ["close_lag0", "close_lag1"], "weights": [-0.001, 0.0005], "intercept": 0.02}


@query(f"""WITH {DAILY}, l AS (SELECT symbol, timestamp, close, lag(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS c1 FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1), p AS (SELECT *, 0.02 + close * -0.001 + c1 * 0.0005 AS y_pred FROM l WHERE c1 IS NOT NULL)
SELECT symbol, {sql_stamp('timestamp')}, {sql_rnd('y_pred')}, round(close * exp(y_pred), 4) AS predicted_price, row_number() OVER (PARTITION BY timestamp ORDER BY round(y_pred, 9) DESC, symbol) AS rank FROM p""")
def m11_live_predictions(spark, d):
    p = M.live(LINEAR, daily_bars(spark, d), 1)
    return p.select("symbol", stamp("timestamp"), rnd("y_pred"), rnd("predicted_price", digits=4), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {DAILY}, c AS (SELECT symbol, timestamp, h AS horizon, close, lag(close) OVER w AS c1, CASE h WHEN 1 THEN lead(close, 1) OVER w ELSE lead(close, 5) OVER w END AS a, CASE h WHEN 1 THEN lead(timestamp, 1) OVER w ELSE lead(timestamp, 5) OVER w END AS t FROM bars, (VALUES (1), (5)) v(h) WINDOW w AS (PARTITION BY symbol, h ORDER BY timestamp))
SELECT symbol, {sql_stamp('timestamp')}, {sql_stamp('t', 'target_timestamp')}, horizon, round(ln(a / close), 6) + 0.0 AS y_true, round(0.02 + close * -0.001 + c1 * 0.0005, 6) + 0.0 AS y_pred FROM c WHERE c1 IS NOT NULL AND a > 0 AND close > 0""")
def m12_comparison(spark, d):
    p = M.comparison({1: LINEAR, 5: LINEAR}, daily_bars(spark, d), ["close"], 2)
    return p.select("symbol", stamp("timestamp"), stamp("target_timestamp"), "horizon", rnd("y_true"), rnd("y_pred"))


@query(f"WITH {DAILY}, {SUP} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM sup")
def m14_round_trip(spark, d):
    return M.round_trip(spark, LINEAR, f"{_shared(spark)}/artifact", _supervised(spark, d))


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY event_type")
def s8_bound_query(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    return read_query(spark, "SELECT event_type, count(*) AS n FROM events WHERE value >= :least GROUP BY event_type", least=50)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s9_overwrite(spark, d):
    path = f"{_shared(spark)}/table"
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    overwrite(counts.limit(1), path)
    overwrite(counts, path)
    return spark.read.parquet(path)


@query(f"WITH {DAILY} SELECT symbol, {sql_stamp('timestamp')}, open, high, low, close, trade_count FROM bars")
def stream_bars(spark, d):
    """Bars made by a stream over the events, after all batches."""
    events = T.files(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    path = _shared(spark)
    out = T.run_to_table(T.bars(at, "user_id", "at", "value"), f"{path}/bars", f"{path}/state")
    return T.last_state(out, ["symbol", "timestamp"]).select("symbol", stamp("timestamp"), "open", "high", "low", "close", "trade_count")


@query("SELECT user_id, event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events GROUP BY ALL")
def stream_first_seen(spark, d):
    """One row for each user, type and day, by a stream that forgets behind its watermark."""
    events = T.files(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    keyed = events.select("user_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("at"))
    path = _shared(spark)
    return T.run_to_table(T.first_seen(keyed, ["user_id", "event_type", "day"], "at", "60 days"), f"{path}/seen", f"{path}/state", "append").select("user_id", "event_type", "day")


@query("WITH arr AS (SELECT CAST(user_id % 40 AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_id % 11 <> 3 THEN CAST(floor(value) AS BIGINT) END AS volume, event_id * 7 % 13 AS trade_count FROM events), f AS (SELECT key, list_reduce(list(struct_pack(seq := seq, volume := volume, trade_count := trade_count) ORDER BY seq), lambda a, b: CASE WHEN b.trade_count >= a.trade_count AND b.volume >= a.volume THEN b ELSE a END) AS r FROM arr GROUP BY key) SELECT key, r.seq AS seq, r.volume AS volume, r.trade_count AS trade_count FROM f")
def stream_guarded_upsert(spark, d):
    events = T.files(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    rows = events.select((F.col("user_id") % 40).cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 != 3, F.floor("value")).alias("volume"), (F.col("event_id") * 7 % 13).alias("trade_count"))
    path = _shared(spark)
    return T.last_state(T.run_to_table(T.guarded_upserts(rows), f"{path}/rows", f"{path}/state"), ["key"])


@query("SELECT 'close' AS feature, 3 AS lag UNION ALL SELECT 'volume', 12 UNION ALL SELECT 'x.y', 1 UNION ALL SELECT 'z', 0")
def t18_lag_names(spark, d):
    found = [P.parse_lag_name(n) for n in ("close_lag3", "volume_lag_12", "x.y.lag1", "z_t-0", "plain")]
    return spark.createDataFrame([x for x in found if x], "feature string, lag int")


@query("SELECT conv_id, turn FROM conversations WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) <= 5")
def o5_top_comments(spark, d):
    c = table(spark, d, "conversations").filter("turn > 0")
    return V.top_per_group(c, ["conv_id"], [F.length("text").desc(), F.col("turn")], 5).select("conv_id", "turn")


@query("SELECT CAST(user_id AS VARCHAR) AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, value AS c FROM events")
def s1_paged_bars(spark, d):
    """Events dealt out into token-linked JSON pages of 20, written and read again; a stray page is left out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = table(spark, d, "events").withColumn("page", F.floor((F.row_number().over(w) - 1) / 20))
    token = lambda p: F.when(p == 0, "first").otherwise(F.concat(F.lit("p"), p.cast("string")))
    pages = numbered.groupBy("user_id", "page").agg(F.collect_list(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("value").alias("c"))).alias("bars"))
    last = F.max("page").over(Window.partitionBy("user_id"))
    linked = pages.select(F.col("user_id").cast("string").alias("symbol"), token(F.col("page")).alias("token"), F.when(F.col("page") < last, token(F.col("page") + 1)).alias("next_page_token"), "bars")
    stray = spark.sql("SELECT '1' AS symbol, 'lost' AS token, CAST(NULL AS STRING) AS next_page_token, array(named_struct('t', 'never', 'c', 0.0D)) AS bars")
    path = f"{_shared(spark)}/pages"
    linked.unionByName(stray).write.json(path)
    return read_pages(spark, path)


LOSSES = "h AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)"


@query(f"WITH {LOSSES}, b AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h), i AS (SELECT *, max(CASE WHEN before IS NULL OR v > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS best_epoch FROM b) SELECT user_id, epoch, best_epoch, epoch - best_epoch AS waited FROM i")
def w22_best_so_far(spark, d):
    """Epochs since a score was last improved on: what early stopping counts."""
    w = Window.partitionBy("user_id").orderBy("epoch")
    h = table(spark, d, "events").withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = h.withColumn("up", F.when(before.isNull() | (F.col("value") > before), F.col("epoch")))
    return improved.withColumn("best_epoch", F.max("up").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("user_id", "epoch", "best_epoch", (F.col("epoch") - F.col("best_epoch")).alias("waited"))


@query("SELECT event_type, user_id, CASE WHEN user_id % 7 = 0 THEN CASE WHEN event_type = 'click' THEN 'tcn' ELSE 'torch' END WHEN user_id % 7 = 1 THEN 'ridge' WHEN user_id % 7 IN (2, 3) THEN 'sklearn' END AS family FROM (SELECT DISTINCT event_type, user_id FROM events)")
def m13_artifact_family(spark, d):
    """Which loader the folder of a saved run needs."""
    files = F.when(F.col("k") == 0, F.array(F.lit("config.json"), F.lit("model.pt"), F.lit("pipeline.joblib"))).when(F.col("k") == 1, F.array(F.lit("pipeline.joblib"), F.lit("feature_names.json"))).when(F.col("k") == 2, F.array(F.lit("pipeline.joblib"))).when(F.col("k") == 3, F.array(F.lit("artifact.pkl"), F.lit("feature_names.json"))).otherwise(F.array(F.lit("config.json")))
    runs = table(spark, d, "events").select("event_type", "user_id").distinct().withColumn("k", F.col("user_id") % 7)
    kind = F.when(F.col("event_type") == "click", "TCN_regressor").otherwise("cnn")
    return runs.select("event_type", "user_id", L.artifact_family(files, kind).alias("family"))


@query("SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def s10_csv_round_trip(spark, d):
    """Written as CSV and read again, nulls included."""
    path = f"{_shared(spark)}/csv"
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("SELECT user_id, count(*) + 1 AS n FROM events GROUP BY user_id")
def s11_replace_whole(spark, d):
    """A table replaced by one that is made from it."""
    path = f"{_shared(spark)}/table"
    replace_whole(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), path)
    replace_whole(spark.read.parquet(path).select("user_id", (F.col("n") + 1).alias("n")), path)
    return spark.read.parquet(path)


@query("SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || event_type || '] user ' || user_id AS value FROM events")
def s12_log_lines(spark, d):
    """Lines with their time and source, added in two goes."""
    path = f"{_shared(spark)}/log"
    lines = table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("source"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), "event_id")
    append_log(lines.filter("event_id % 2 = 0"), path)
    append_log(lines.filter("event_id % 2 <> 0"), path)
    return spark.read.text(path)
