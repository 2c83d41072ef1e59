"""Linear models on panels: ridge by normal equations, cross-validation, artifacts, live and comparison predictions.

The sums that the normal equations need are one aggregate over the rows, whatever their number; what reaches the driver
is a matrix of features by features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_json, write_json
from .metrics import rank_cross_section
from .panel import align, parse_lag_name


def _moments(df: DataFrame, features: list[str], target: str, group: Column | None = None) -> dict[str, np.ndarray]:
    """Sum of outer products of (1, features, target) for each value of `group` (text; few values), by task and then in all."""
    names = [*features, target]
    rows = df.select((F.lit("") if group is None else group).alias("g"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(names)]).dropna()
    k = len(names) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            groups = batch.column(0).dictionary_encode()
            at = groups.indices.to_numpy()
            for code, g in enumerate(groups.dictionary.to_pylist()):
                own = x[at == code]
                totals[g] = totals.get(g, 0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["g", "m"])

    sums = rows.mapInArrow(part, "g string, m array<double>").select("g", F.posexplode("m").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.g, np.zeros(k * k))[r.i] = r.v
    return {g: m.reshape(k, k) for g, m in out.items()}


def fit_ridge(df: DataFrame, features: list[str], target: str = "y", alpha: float = 1.0, moments: np.ndarray | None = None) -> dict:
    """Ridge on standardised features (population deviation), intercept unpenalised: a model of plain numbers."""
    m = _moments(df, features, target).get("") if moments is None else moments
    if m is None:
        raise ValueError("no rows to fit")
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    p = len(features)
    dev = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
    dev[dev == 0] = 1.0
    gram, xy = cov[:p, :p] / np.outer(dev, dev), cov[:p, p] / dev
    w = np.linalg.solve(gram * n + alpha * np.eye(p), xy * n) / dev if alpha else np.linalg.lstsq(gram, xy, rcond=None)[0] / dev
    return {"kind": "ridge", "features": list(features), "weights": w.tolist(), "intercept": float(mean[p] - w @ mean[:p]), "alpha": alpha, "n": int(n)}


def predict_column(model: dict) -> Column:
    out = F.lit(float(model["intercept"]))
    for f, w in zip(model["features"], model["weights"]):
        out = out + F.col(f"`{f}`") * F.lit(float(w))
    return out


def predict(model: dict, df: DataFrame, strict: bool = True, fill: float = 0.0, keep: list[str] = ()) -> DataFrame:
    """symbol, timestamp, kept columns, y_pred. strict: missing features raise; else they are filled."""
    missing = [f for f in model["features"] if f not in df.columns]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    for f in missing:
        df = df.withColumn(f, F.lit(fill))
    return df.select("symbol", "timestamp", *keep, predict_column(model).alias("y_pred"))


def cross_validate(folds: DataFrame, features: list[str], target: str, alphas: list[float]) -> DataFrame:
    """Error of each alpha over folds (fold, role train/test): alpha, mean rmse; lowest first.

    One pass over the rows sums the moments of every fold's two parts; fits and squared errors both follow from them. Rows with a null
    feature or target count in neither; a fold without test rows has no error, one without training rows is refused.
    """
    sums = _moments(folds, features, target, F.concat_ws(" ", F.col("fold").cast("string"), "role"))
    out = []
    for f in sorted({int(g.split(" ")[0]) for g in sums}):
        train, test = sums.get(f"{f} train"), sums.get(f"{f} test")
        if train is None:
            raise ValueError(f"no rows to fit in fold {f}")
        for a in alphas if test is not None else ():
            model = fit_ridge(folds, features, target, a, train)
            v = np.array([model["intercept"], *model["weights"], -1.0])
            out.append((f, float(a), float(np.sqrt(max(v @ test @ v, 0.0) / test[0, 0]))))
    table = folds.sparkSession.createDataFrame(out, "fold int, alpha double, rmse double")
    return table.groupBy("alpha").agg(F.avg("rmse").alias("rmse")).orderBy("rmse", "alpha")


def fit_boosted(rows: DataFrame, features: list[str], target: str, grid: list[dict], rounds: int = 50, tolerance: float = 0.01, seed: int = 1):
    """Gradient-boosted trees for each point of a grid (parameters of Spark's own regressor): the best model, and one row a point with its trees and error, best first.

    Rows have a split; those of `train` are fitted, those of `val` stop a fit once it gains less than `tolerance` and then choose the point
    (ties: the earlier one). Rows with a null feature or target are left out of both. The model reads the column `x` that `assemble` makes.
    """
    from pyspark.ml.regression import GBTRegressor

    used = assemble(rows.filter("split IN ('train', 'val')").dropna(subset=[target]), features).select("x", F.col(target).alias("y"), (F.col("split") == "val").alias("val")).persist()
    try:
        if used.select("val").distinct().count() < 2:
            raise ValueError("no rows to fit or to validate on")
        fits = []
        for i, point in enumerate(grid):
            model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=rounds, validationIndicatorCol="val", validationTol=tolerance, seed=seed, **point).fit(used)
            rmse = model.transform(used.filter("val")).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
            fits.append((rmse, i, model))
    finally:
        used.unpersist()
    fits.sort(key=lambda x: x[:2])
    table = rows.sparkSession.createDataFrame([(i, str(grid[i]), m.getNumTrees, float(e)) for e, i, m in fits], "point int, parameters string, trees int, rmse double")
    return fits[0][2], table


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with the features as one vector, x; rows with a null or nan among them are left out."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip").transform(rows)


def save_artifact(spark: SparkSession, model: dict, path: str, metrics: dict | None = None) -> None:
    write_json(spark, {"model": model, "metrics": metrics or {}}, path)


LOADERS = {"ridge": lambda x: x["model"]}


def register_loader(kind: str):
    """A decorator by which other kinds of models announce how they are loaded."""

    def add(f):
        LOADERS[kind] = f
        return f

    return add


def load_artifact(spark: SparkSession, path: str) -> dict:
    x = read_json(spark, path)
    kind = x["model"].get("kind")
    if kind not in LOADERS:
        raise ValueError(f"no loader for {kind}")
    return LOADERS[kind](x)


def round_trip(spark: SparkSession, model: dict, path: str, df: DataFrame, atol: float = 1e-6) -> DataFrame:
    """One row: rows compared, and how many predictions differ after the model was saved and loaded."""
    save_artifact(spark, model, path)
    again = load_artifact(spark, path)
    return df.select(predict_column(model).alias("a"), predict_column(again).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.abs(F.col("a") - F.col("b")) > atol).cast("long")), F.lit(0)).alias("n_different"))


def lags_of(features: list[str]) -> dict[str, list[int]]:
    """Raw columns and lags that a model's features stand for."""
    out: dict[str, list[int]] = {}
    for f in features:
        parsed = parse_lag_name(f)
        if parsed:
            out.setdefault(parsed[0], []).append(parsed[1])
    return out


def live(model: dict, bars: DataFrame, horizon: int, q: float = 0.1) -> DataFrame:
    """Predictions on each symbol's latest row: y_pred, predicted price, rank, share, bucket. Ranks go by nine places of a prediction: what is beyond them is the order of its sum."""
    from .panel import inference

    rows = inference(bars, list(lags_of(model["features"])), 0, "latest", spec=lags_of(model["features"]))
    p = predict(model, align(rows, model["features"])).join(bars.select("symbol", "timestamp", "close"), ["symbol", "timestamp"])
    p = p.withColumn("horizon", F.lit(horizon)).withColumn("predicted_price", F.col("close") * F.exp("y_pred"))
    return rank_cross_section(p, q, ["timestamp", "horizon"], digits=9)


def comparison(models: dict[int, dict], bars: DataFrame, features: list[str], lookback: int) -> DataFrame:
    """Predictions of one model a horizon beside what came: symbol, timestamp, target_timestamp, horizon, y_true, y_pred."""
    from functools import reduce

    from .panel import supervised

    parts = [predict(m, supervised(bars, features, lookback, h).withColumnRenamed("y", "y_true"), keep=["target_timestamp", "y_true"]).withColumn("horizon", F.lit(h)) for h, m in models.items()]
    return reduce(DataFrame.unionByName, parts)
