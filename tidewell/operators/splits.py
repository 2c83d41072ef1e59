"""Time-aware splits. Boundaries are places on the sorted distinct time axis: a small table, made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axis(meta: DataFrame, time: str = "timestamp") -> DataFrame:
    """t, i: distinct times in order, from 0. As many rows as there are times in the panel, whatever its symbols."""
    return meta.select(F.col(time).alias("t")).filter(F.col("t").isNotNull()).distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1)


def at_places(times: DataFrame, places: dict[str, int]) -> dict:
    """The times at these places: a handful of values for the driver."""
    got = {r.i: r.t for r in times.filter(F.col("i").isin(list(places.values()))).collect()}
    return {k: got.get(v) for k, v in places.items()}


def split_fractions(meta: DataFrame, train: float = 0.7, val: float = 0.15, time: str = "timestamp", target: str = "target_timestamp") -> DataFrame:
    """meta with `split`: train up to a cut, purged of targets beyond it; val up to the next, purged likewise; test after. Others null."""
    times = axis(meta, time)
    n = times.count()
    if n < 10:
        raise ValueError("too few times to split")
    cut = at_places(times, {"train": max(0, int(n * train) - 1), "val": max(0, int(n * (train + val)) - 1)})
    t, y = F.col(time), F.col(target)
    a, b = F.lit(cut["train"]), F.lit(cut["val"])
    return meta.withColumn("split", F.when((t <= a) & (y <= a), "train").when((t > a) & (t <= b) & (y <= b), "val").when(t > b, "test"))


def split_positions(meta: DataFrame, order: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """By place in a total order, without regard to time: the first n * train rows, the next n * val, the rest.

    Places come from sorted ranges and their sizes, not from one sort in a single task.
    """
    from .ranks import global_places

    placed = global_places(meta, order)
    n = meta.count()
    a, b = int(n * train), int(n * (train + val))
    return placed.withColumn("split", F.when(F.col("place") < a, "train").when(F.col("place") < b, "val").otherwise("test")).drop("place")


def _at(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def split_bounds(meta: DataFrame, train_start: str, train_end: str, val_end: str, time: str = "timestamp", target: str = "target_timestamp") -> DataFrame:
    """train from train_start with targets before train_end, val from there with targets before val_end, test from there on; what is in none has null."""
    t, y = F.col(time), F.col(target)
    return meta.withColumn("split", F.when((t >= _at(train_start)) & (y < _at(train_end)), "train").when((t >= _at(train_end)) & (y < _at(val_end)), "val").when(t >= _at(val_end), "test"))


def purged_role(s: Column, e: Column, v: Column, w: Column, time: str = "timestamp", target: str = "target_timestamp") -> Column:
    """train in [s, e) with targets before v, val from v with targets before w."""
    t, y = F.col(time), F.col(target)
    return F.when((t >= s) & (t < e) & (y < v), "train").when((t >= v) & (y < w), "val")


def test_rows(meta: DataFrame, start, end=None, time: str = "timestamp", target: str = "target_timestamp") -> DataFrame:
    """Rows from start on whose target is known (and not after end)."""
    out = meta.filter((F.col(time) >= F.lit(start)) & F.col(target).isNotNull())
    return out if end is None else out.filter(F.col(target) <= F.lit(end))


def purged_folds(meta: DataFrame, n_splits: int = 5, time: str = "timestamp", target: str = "target_timestamp") -> DataFrame:
    """Expanding folds on the time axis: rows with fold and role. Test folds are the last ones, n // (k + 1) times each; rows whose target lies beyond their part's last time are left out, and folds that lose a whole part."""
    times = axis(meta, time)
    n = times.count()
    if n < n_splits + 2:
        raise ValueError("too few times for the folds")
    size = n // (n_splits + 1)
    ends = at_places(times, {f"{k}{e}": n - (n_splits - k) * size - 1 + (size if e == "test" else 0) for k in range(n_splits) for e in ("train", "test")})
    spans = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(ends[f"{k}train"]).alias("a"), F.lit(ends[f"{k}test"]).alias("b")) for k in range(n_splits)])
    rows = meta.withColumn("__f", F.explode(spans))
    t, y = F.col(time), F.col(target)
    role = F.when((t <= F.col("__f.a")) & (y <= F.col("__f.a")), "train").when((t > F.col("__f.a")) & (t <= F.col("__f.b")) & (y <= F.col("__f.b")), "test")
    out = rows.withColumn("fold", F.col("__f.fold")).withColumn("role", role).drop("__f").filter("role IS NOT NULL")
    both = out.groupBy("fold").agg(F.count_distinct("role").alias("n")).filter("n = 2").select("fold")
    return out.join(F.broadcast(both), "fold")


def walk_boundaries(n: int, n_folds: int, val: int, test: int, step: int | None = None, train: int | None = None) -> list[dict[str, int]]:
    """Folds as places on an axis of n times, before a test span of `test` times at its end: validation spans a step apart, training before each (all of it, or its last `train` times). Ends are exclusive."""
    step, first_test, out = step or val, n - test, []
    for k in range(n_folds):
        v = first_test - (n_folds - k) * step
        if v + val > first_test or v <= 0:
            raise ValueError("the folds do not fit before the test span")
        out.append({"fold": k + 1, "s": max(0, v - train) if train else 0, "e": v, "v": v, "w": v + val})
    return out


def walk_plan(n: int, val: int = 126, step: int = 126, test: int = 504, train: int | None = 1260, embargo: int = 0, min_train: int = 756) -> list[dict[str, int]]:
    """Folds back from the test span, a step apart, for as long as training (an embargo before validation, rolling or expanding) fits and has min_train times; the oldest is fold 1."""
    if n <= test + val + min_train + 10:
        raise ValueError("too few times for the plan")
    out, w = [], n - test
    while w - val - embargo > 0:
        v = w - val
        e = v - embargo
        s = e - train if train else 0
        if s < 0 or e - s < min_train:
            break
        out.append({"s": s, "e": e, "v": v, "w": w})
        w -= step
    if not out:
        raise ValueError("no fold fits")
    return [{"fold": k, **f} for k, f in enumerate(reversed(out), 1)]


def purged_fold_table(meta: DataFrame, folds: list[dict[str, int]], time: str = "timestamp", target: str = "target_timestamp") -> DataFrame:
    """Rows of meta with fold and role (train, val), by the places of walk_boundaries or walk_plan."""
    at = at_places(axis(meta, time), {f"{f['fold']}{k}": f[k] for f in folds for k in "sevw"})
    spans = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), *[F.lit(at[f"{f['fold']}{k}"]).alias(k) for k in "sevw"]) for f in folds])
    rows = meta.withColumn("__f", F.explode(spans))
    return rows.withColumn("fold", F.col("__f.fold")).withColumn("role", purged_role(*[F.col(f"__f.{k}") for k in "sevw"], time, target)).drop("__f").filter("role IS NOT NULL")


def walk_forward(n: int, train: int | None, val: int, test: int, step: int, min_train: int = 1, embargo: int = 0) -> list[dict[str, int]]:
    """Folds from the start of an axis: train, val, test in turn, each fold a step later. The embargo shortens training; train None: it expands. Bounds are first and last place."""
    if n < val + test + 5:
        raise ValueError("too few times for the folds")
    if train is not None and train < min_train:
        raise ValueError("training is shorter than its least")
    out, k = [], 0
    while True:
        first = k * step if train is not None else 0
        v = first + train if train is not None else max(min_train, 1) + k * step
        if v + val + test > n or v - embargo - first < max(1, min_train):
            break
        out.append({"fold": k + 1, "train_first": first, "train_last": v - embargo - 1, "val_first": v, "val_last": v + val - 1, "test_first": v + val, "test_last": v + val + test - 1})
        k += 1
    if not out:
        raise ValueError("no fold fits")
    return out


def fold_table(meta: DataFrame, folds: list[dict[str, int]], time: str, purge_on: str | None = None) -> DataFrame:
    """Rows of meta with fold and role by walk_forward's places. purge_on: a time that must lie in the same span (else the row is left out)."""
    times = axis(meta, time)
    places = {f"{f['fold']}{k}": f[k] for f in folds for k in f if k != "fold"}
    at = at_places(times, places)
    spans = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), F.lit(role).alias("role"), F.lit(at[f"{f['fold']}{role}_first"]).alias("a"), F.lit(at[f"{f['fold']}{role}_last"]).alias("b")) for f in folds for role in ("train", "val", "test")])
    inside = lambda c: (F.col(c) >= F.col("__s.a")) & (F.col(c) <= F.col("__s.b"))
    rows = meta.withColumn("__s", F.explode(spans)).filter(inside(time) & (inside(purge_on) if purge_on else F.lit(True)))
    return rows.withColumn("fold", F.col("__s.fold")).withColumn("role", F.col("__s.role")).drop("__s")


def split_targets(meta: DataFrame, train: float = 0.7, val: float = 0.15, target: str = "target_timestamp") -> DataFrame:
    """By distinct target times: floors of the shares, at least one time each; raises below three."""
    times = axis(meta, target)
    n = times.count()
    if n < 3:
        raise ValueError("too few target times to split")
    a = min(max(1, int(n * train)), n - 2)
    b = min(max(1, int(n * val)), n - a - 1)
    cut = at_places(times, {"train": a - 1, "val": a + b - 1})
    return meta.withColumn("split", F.when(F.col(target) <= F.lit(cut["train"]), "train").when(F.col(target) <= F.lit(cut["val"]), "val").otherwise("test"))


def timestamp_batches(meta: DataFrame, least: int = 20, most: int | None = None, seed: int = 0, time: str = "timestamp") -> DataFrame:
    """Rows in batches of one timestamp: times with fewer than `least` rows left out, larger ones in chunks of `most`, in an order drawn by the seed."""
    draw = F.xxhash64(F.lit(seed), "symbol", time)
    w = Window.partitionBy(time)
    rows = meta.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= least)
    place = F.row_number().over(w.orderBy(draw, "symbol"))
    chunk = F.floor((place - 1) / most) if most else F.lit(0)
    return rows.withColumn("chunk", chunk.cast("int")).withColumn("batch_order", F.xxhash64(F.lit(seed), time, "chunk")).drop("__n")
