"""Joins by nearest time, and ranks over sliding windows of rows; both split a key whose series is long."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key from which it is cut into stretches of time, and stretches a key can have.
STRETCH_ROWS = 1_000_000
STRETCHES = 256
#: New rows of a segment of a sliding window.
SEGMENT = 4096


def _stretches(rows: DataFrame, keys: list[str], stretch_rows: int) -> DataFrame:
    """rows(keys, _t, ...) with `_part`: 0, or for long keys the number of the stretch of time that holds _t."""
    long = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > stretch_rows).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    shares = [F.lit(k / STRETCHES) for k in range(1, STRETCHES)]
    hot = rows.select(*keys, "_t").join(long, same, "left_semi")
    cuts = hot.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_t", F.array(*shares), 10 * STRETCHES)).alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")
    # Left to Spark: a few rows are broadcast, and many are joined with their long side split.
    joined = rows.join(cuts, same, "left")
    return joined.withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))).drop("_cuts", *[f"_k{i}" for i in range(len(keys))])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie: str, tolerance_us: int | None = None, forward: bool = False, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Every row of left with `match`, the newest row of right of the same keys whose time is not after its own (with forward:
    the oldest one not before it), if no further away than the tolerance; null without one. Times are timestamps or dates. Of
    right rows with one time the one with the largest `tie` counts. Null keys match each other; rows without a time match none.

    Both tables are put together in the order of time, and each left row takes the last right row before it. A long key is cut
    at quantiles of its time; what a stretch leaves open is taken from the last right row of the stretches before it."""
    keys = list(keys)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sign = -1 if forward else 1
    shape = F.struct(*right.columns)
    one = right.filter(F.col(right_time).isNotNull()).select(*keys, (sign * micros(right_time)).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), shape.alias("_right"), F.lit(None).alias("_left"))
    other = left.select(*keys, (sign * micros(left_time)).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).alias("_right"), F.struct(*left.columns).alias("_left"))
    parts = _stretches(one.unionByName(other), keys, stretch_rows)
    last = parts.filter("_side = 0").groupBy(*keys, "_part").agg(F.max_by("_right", F.struct("_t", "_tie")).alias("_last"))
    # A row for each stretch; what came before it, not its own.
    every = _joined(parts.select(*keys, "_part").distinct(), last, [*keys, "_part"])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last").filter("_carried is not null")
    inside = Window.partitionBy(*keys, "_part").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.withColumn("_found", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    out = _joined(filled, carried, [*keys, "_part"]).withColumn("match", F.coalesce("_found", "_carried"))
    near = F.col("_t").isNotNull()
    if tolerance_us is not None:
        near = near & (F.col("_t") - sign * F.unix_micros(F.col(f"match.{right_time}").cast("timestamp")) <= tolerance_us)
    return out.select("_left.*", F.when(near, F.col("match")).alias("match"))


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of facts, null keys being equal."""
    named = facts.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)], F.lit(True))
    return rows.join(named, same, "left").drop(*[f"_f{i}" for i in range(len(keys))])


def places(rows: DataFrame, key: str, date: str) -> DataFrame:
    """rows with `_place`, from 0 in the order of date: the rows of earlier months, and the place in the month."""
    months = rows.withColumn("_month", F.trunc(date, "month"))
    counts = months.groupBy(key, "_month").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    before = counts.select(key, "_month", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(key, "_month").orderBy(date)
    return months.join(before, [key, "_month"]).withColumn("_place", F.col("_before") + F.row_number().over(inner) - 1).drop("_month", "_before")


def _ranks(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value the least and the greatest of the last `size`, how many of them are no greater, and how many there are;
    missing ones count nowhere."""
    padded = np.concatenate([np.full(size - 1, np.nan), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)
    seen = ~np.isnan(windows)
    low, high = np.where(seen, windows, np.inf).min(axis=1), np.where(seen, windows, -np.inf).max(axis=1)
    return low, high, (windows <= values[:, None]).sum(axis=1), seen.sum(axis=1)


def rolling_rank(rows: DataFrame, key: str, date: str, value: str, size: int = 252, segment: int = SEGMENT) -> DataFrame:
    """key, date, iv_rank and iv_percentile of the value among the last `size` rows of its key, itself included: (value - least) /
    (greatest - least), 50 where they are equal, and the share of values that are no greater; both in per cent, null where the
    value is. Dates must be different within a key; null keys and dates are left out.

    A series is cut into segments; each also gets the rows before it that its windows reach into."""
    placed = places(rows.filter(F.col(key).isNotNull() & F.col(date).isNotNull()).select(key, date, F.col(value).cast("double").alias("_value")), key, date)
    own = F.floor(F.col("_place") / segment)
    reach = F.floor((F.col("_place") + size - 1) / segment)
    spread = placed.withColumn("_segment", F.explode(F.sequence(own, reach))).withColumn("_own", F.floor(F.col("_place") / segment) == F.col("_segment"))
    kinds = {f.name: f.dataType for f in placed.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        values = table.column("_value").to_numpy(zero_copy_only=False).astype(float)
        mine = np.asarray(table.column("_own"))
        low, high, upto, seen = _ranks(values, size)
        with np.errstate(all="ignore"):
            rank = np.where(high > low, (values - low) / (high - low), 0.5) * 100
            percentile = upto / seen * 100
        gone = np.isnan(values)
        out = table.select([key, date]).append_column("iv_rank", pa.array(rank, mask=gone)).append_column("iv_percentile", pa.array(percentile, mask=gone))
        return out.filter(pa.array(mine))

    schema = f"`{key}` {kinds[key].simpleString()}, `{date}` {kinds[date].simpleString()}, iv_rank double, iv_percentile double"
    return spread.groupBy(key, "_segment").applyInArrow(run, schema)
