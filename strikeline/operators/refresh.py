"""Summaries that are brought up to date by the days that changed.

A stored row for each day and symbol has what can be merged: counts, sums, least and greatest, the exact median of the day, and a
quantile sketch (KLL, rank error about 1.33 % at the default size) for medians over many days."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.sources.published import Published

#: The rank error of a sketch of the default size, with 99 % certainty.
SKETCH_ERROR = 0.0133

PARTIALS = "date date, act_symbol string, n_options long, n_vol long, sum_vol double, min_vol double, max_vol double, median_vol double, sketch binary"


def partials(chain: DataFrame) -> DataFrame:
    vol = F.col("vol")
    return chain.groupBy("date", "act_symbol").agg(
        F.count("*").alias("n_options"),
        F.count(vol).alias("n_vol"),
        F.sum(vol).alias("sum_vol"),
        F.min(vol).alias("min_vol"),
        F.max(vol).alias("max_vol"),
        F.median(vol).alias("median_vol"),
        F.kll_sketch_agg_double(vol).alias("sketch"),
    )


class Summaries:
    def __init__(self, spark: SparkSession, root: str):
        self.stored = Published(spark, root, PARTIALS, "date")

    def refresh(self, chain: DataFrame, days: Sequence[datetime.date]) -> int:
        """Compute the named days of the chain anew; the filter on the days reaches its scan. A day without rows goes."""
        wanted = sorted(set(days))
        fresh = chain.filter(F.col("date").isin(wanted)) if wanted else chain.limit(0)
        return self.stored.replace([str(d) for d in wanted], partials(fresh), self.stored.version())

    def missing(self, days: Sequence[datetime.date]) -> list[datetime.date]:
        """Those of the chain's days that are not stored."""
        have = self.stored.days()
        return [d for d in days if str(d) not in have]

    def daily_iv(self) -> DataFrame:
        """As views.daily_iv_summary over the whole chain."""
        rows = self.stored.read().filter("n_vol > 0")
        return rows.select("date", "act_symbol", (F.col("sum_vol") / F.col("n_vol")).alias("avg_iv"), F.col("median_vol").alias("median_iv"), F.col("n_vol").alias("n_options"))

    def symbols(self) -> DataFrame:
        """As views.symbol_summary over the whole chain, with an approximate median over all days."""
        rows = self.stored.read().filter("n_vol > 0")
        g = rows.groupBy("act_symbol").agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.sum("n_vol").alias("total_options"),
            (F.sum("sum_vol") / F.sum("n_vol")).alias("avg_iv"),
            F.count("*").alias("trading_days"),
            F.min("min_vol").alias("min_iv"),
            F.max("max_vol").alias("max_iv"),
            F.kll_merge_agg_double("sketch").alias("_sketch"),
        )
        return g.withColumn("median_iv", F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5))).drop("_sketch")

    def metadata(self, loaded: datetime.date) -> DataFrame:
        return self.symbols().select("act_symbol", "first_date", "last_date", "total_options", F.lit(loaded).alias("loaded_at"))
