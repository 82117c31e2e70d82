"""Implied volatility against its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.functions import expressions as X


def clean(vol: DataFrame) -> DataFrame:
    return vol.filter((F.col("iv") > 0) & (F.col("iv") < 10))


def iv_stats(vol: DataFrame, current: DataFrame) -> DataFrame:
    """Per symbol of current(symbol, current): where that iv stands in the history. A flat history ranks 0.5."""
    rows = clean(vol).join(current, "symbol")
    g = rows.groupBy("symbol").agg(
        F.max("current").alias("current"),
        F.min("iv").alias("min_iv"),
        F.max("iv").alias("max_iv"),
        F.avg("iv").alias("mean_iv"),
        F.median("iv").alias("median_iv"),
        F.stddev_pop("iv").alias("std_iv"),
        F.count("*").alias("days"),
        (F.count_if(F.col("iv") <= F.col("current")) / F.count("*") * 100).alias("percentile"),
    )
    rank = F.try_divide(F.col("current") - F.col("min_iv"), F.col("max_iv") - F.col("min_iv"))
    return g.withColumn("rank", F.when(rank.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank))))


def last_points(vol: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return vol.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)


def sparkline(vol: DataFrame, today: DataFrame, n: int = 50) -> DataFrame:
    """The last n points by date; today's (symbol, date, iv) is added if the series lacks it; the last point is flagged."""
    kept = last_points(vol.select("symbol", "date", "iv"), n).drop("_n")
    points = kept.unionByName(today.join(kept, ["symbol", "date"], "left_anti"))
    return points.withColumn("is_last", F.col("date") == F.max("date").over(Window.partitionBy("symbol")))


def trend(vol: DataFrame, k: int = 10) -> DataFrame:
    """Direction and strength of the last k points; fewer points are a stable, weak 0."""
    g = last_points(vol, k).groupBy("symbol").agg(F.min_by("iv", "date").alias("first"), F.max_by("iv", "date").alias("last"), F.count("*").alias("n"))
    change = F.when(F.col("n") < k, 0.0).otherwise(F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, F.lit(0.0)))
    size = F.abs("change")
    return g.select("symbol", change.alias("change")).select(
        "symbol",
        "change",
        F.when(F.col("change") > 2, "expanding").when(F.col("change") < -2, "contracting").otherwise("stable").alias("direction"),
        F.when(size < 5, "weak").when(size < 15, "moderate").otherwise("strong").alias("strength"),
    )


def scaled(vol: DataFrame) -> DataFrame:
    """Each point between 0 and 100 of its symbol's range."""
    ends = vol.groupBy("symbol").agg(F.min("iv").alias("low"), F.max("iv").alias("high"), F.max("date").alias("last"))
    height = F.coalesce(F.try_divide(F.col("iv") - F.col("low"), F.col("high") - F.col("low")) * 100, F.lit(0.0))
    return vol.join(ends, "symbol").select("symbol", "date", height.alias("height"), (F.col("date") == F.col("last")).alias("is_last"))


def context(stats: DataFrame) -> DataFrame:
    return stats.select("symbol", X.iv_context(F.col("percentile"), F.col("days")).alias("c")).select("symbol", "c.*")
