"""Saved runs side by side: which can be compared with a candidate, why others cannot, and their order.

A table of runs has a row for each: run, kind (null where it could not be read), lookback, horizon, timeframe, features (array), and
its metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skip_reason(lookback: int, horizon: int, timeframe: str | None, available: list[str], kind: str = "ridge", strict: bool = True, equal_lookback: bool = False) -> Column:
    """Why a run is not compared, null if it is: the first of unreadable, of another kind, without settings, other horizon, lookback not below the candidate's, other timeframe, features that are not there (only if strict)."""
    long = F.col("lookback") > lookback if equal_lookback else F.col("lookback") >= lookback
    missing = F.size(F.array_except(F.coalesce("features", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in available])))
    checks = [
        (F.col("kind").isNull(), "load_error"),
        (F.col("kind") != kind, f"not_a_{kind}"),
        (F.col("lookback").isNull() | F.col("horizon").isNull(), "missing_settings"),
        (F.col("horizon") != horizon, "horizon_mismatch"),
        (long, "lookback_not_smaller"),
    ]
    if timeframe is not None:
        checks.append((~F.col("timeframe").eqNullSafe(timeframe), "timeframe_mismatch"))
    if strict:
        checks.append((missing > 0, "missing_features"))
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in checks])


def report(runs: DataFrame, *, lookback: int, horizon: int, timeframe: str | None, available: list[str], **options) -> DataFrame:
    """runs with status (`ok` or `skip`) and skip_reason."""
    out = runs.withColumn("skip_reason", skip_reason(lookback, horizon, timeframe, available, **options))
    return out.withColumn("status", F.when(F.col("skip_reason").isNull(), "ok").otherwise("skip"))


def ordered(runs: DataFrame, metrics: list[str], descending: tuple[str, ...] = (), group: tuple[str, ...] = ()) -> DataFrame:
    """runs with `by`, the first of the metrics that any run of the group has, and `place` by it; runs without a value come last, ties go by run.

    The choice of the metric is one aggregate joined back, so nothing comes to the driver.
    """
    has = runs.groupBy(*group).agg(*[F.count(F.when(~F.isnan(m), F.col(m))).alias(f"__{m}") for m in metrics])
    both = runs.join(F.broadcast(has), list(group)) if group else runs.crossJoin(F.broadcast(has))
    by = F.coalesce(*[F.when(F.col(f"__{m}") > 0, F.lit(m)) for m in metrics])
    value = F.coalesce(*[F.when(F.col("by") == m, F.nanvl(F.col(m), F.lit(None).cast("double")) * (-1 if m in descending else 1)) for m in metrics])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(value.asc_nulls_last(), "run"))
    return both.withColumn("by", by).withColumn("place", place.cast("long")).drop(*[f"__{m}" for m in metrics])


def artifact_family(files: Column, model_type: Column) -> Column:
    """Which loader a run's folder needs, from the names of its files and its configured model type; null where none fits."""
    has = lambda name: F.array_contains(files, name)
    pickled = ("pipeline.pkl", "pipeline.joblib", "model.pkl", "model.joblib", "artifact.pkl", "artifact.joblib")
    return (
        F.when(has("model.pt") & (F.lower(model_type) == "tcn_regressor"), "tcn")
        .when(has("model.pt"), "torch")
        .when(has("pipeline.joblib") & has("feature_names.json"), "ridge")
        .when(F.arrays_overlap(files, F.array(*[F.lit(x) for x in pickled])), "sklearn")
    )
