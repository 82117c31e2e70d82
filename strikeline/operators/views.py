"""Summary views of the option chain and its joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_iv_summary(chain: DataFrame) -> DataFrame:
    """Average, exact median and number of implied vols per symbol and day."""
    g = chain.filter("vol is not null").groupBy("date", "act_symbol")
    return g.agg(F.avg("vol").alias("avg_iv"), F.median("vol").alias("median_iv"), F.count("*").alias("n_options"))


def symbol_summary(chain: DataFrame) -> DataFrame:
    return chain.filter("vol is not null").groupBy("act_symbol").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("total_options"),
        F.avg("vol").alias("avg_iv"),
        F.countDistinct("date").alias("trading_days"),
    )


def average_strike(chain: DataFrame) -> DataFrame:
    return chain.groupBy("act_symbol", "date").agg(F.avg("strike").alias("avg_strike"))


def atm_options(chain: DataFrame, within: float = 5.0) -> DataFrame:
    """Quotes whose strike lies near the average strike of their symbol and day."""
    return chain.join(average_strike(chain), ["act_symbol", "date"]).filter(F.abs(F.col("strike") - F.col("avg_strike")) < within)


def recent(chain: DataFrame, days: int = 30) -> DataFrame:
    """Quotes of the last calendar days up to the newest date. The date is found first, so that of a table in daily folders only
    those of the wanted days are read."""
    newest = chain.agg(F.max("date")).scalar()
    return chain.filter(F.col("date") >= F.date_sub(newest, days))


def latest(chain: DataFrame, symbol: str) -> DataFrame:
    """Quotes of a symbol's newest date, found first as for `recent`."""
    rows = chain.filter(F.col("act_symbol") == symbol)
    return rows.filter(F.col("date") == rows.agg(F.max("date")).scalar())


def market_quality(chain: DataFrame, by: list[str], liquid: Column | None = None) -> DataFrame:
    """Numbers of quotes and two-sided ones, average vol, delta, gamma and spread."""
    two_sided = (F.col("bid") > 0) & (F.col("ask") > 0) if liquid is None else liquid
    return chain.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(two_sided).alias("n_liquid"),
        F.avg("vol").alias("avg_vol"),
        F.avg("delta").alias("avg_delta"),
        F.avg("gamma").alias("avg_gamma"),
        F.avg(F.col("ask") - F.col("bid")).alias("avg_spread"),
    )


def yearly(chain: DataFrame, first: int, last: int) -> DataFrame:
    """A row per symbol and year, years without quotes included with zeros."""
    year = F.year("date").alias("year")
    stats = chain.filter(F.year("date").between(first, last)).groupBy("act_symbol", year).agg(F.avg("vol").alias("avg_vol"), F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    grid = chain.select("act_symbol").distinct().select("act_symbol", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(stats, ["act_symbol", "year"], "left").withColumns({"avg_vol": F.coalesce("avg_vol", F.lit(0.0)), "n": F.coalesce("n", F.lit(0).cast("long"))})


def age_bucket(date: Column, as_of: Column) -> Column:
    """1 for the last 365 days, then a number per further 365."""
    return F.greatest(F.lit(1), F.ceil(F.datediff(as_of, date) / 365).cast("int"))


def progressive(chain: DataFrame, as_of: Column, recent_cap: int = 1000, older_cap: int = 500, buckets: int = 6) -> DataFrame:
    """The newest rows of each age bucket, up to its cap: a top-k report per bucket."""
    aged = chain.withColumn("bucket", age_bucket(F.col("date"), as_of)).filter(F.col("bucket") <= buckets)
    order = Window.partitionBy("act_symbol", "bucket").orderBy(F.desc("date"), "strike", "id")
    cap = F.when(F.col("bucket") == 1, recent_cap).otherwise(older_cap)
    # The plain bound lets Spark cut each task's rows to it before they are shuffled; one that depends on the row does not.
    within = (F.col("_n") <= max(recent_cap, older_cap)) & (F.col("_n") <= cap)
    return aged.withColumn("_n", F.row_number().over(order)).filter(within).drop("_n")


def standard_expirations(chain: DataFrame, least: int = 10) -> DataFrame:
    """Liquid Friday expirations, marked monthly where the day of the month is the third Friday's."""
    friday = chain.filter((F.col("bid") > 0) & (F.col("ask") > 0) & (F.dayofweek("expiration") == 6))
    g = friday.groupBy("expiration").agg(F.count("*").alias("n"), F.avg("vol").alias("avg_vol"), F.avg((F.col("bid") + F.col("ask")) / 2).alias("avg_mid"))
    return g.filter(F.col("n") > least).withColumn("monthly", is_monthly(F.col("expiration")))


def is_monthly(expiration: Column) -> Column:
    return F.dayofmonth(expiration).between(15, 21)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def expiration_rollup(contracts: DataFrame) -> DataFrame:
    call = F.col("call_put") == "C"
    return contracts.groupBy("act_symbol", "expiration").agg(
        F.count("*").alias("n_contracts"),
        F.count_if(call).alias("n_calls"),
        F.count_if(~call).alias("n_puts"),
        F.min("strike").alias("min_strike"),
        F.max("strike").alias("max_strike"),
        F.countDistinct("strike").alias("n_strikes"),
    )


def strike_spacing(contracts: DataFrame) -> DataFrame:
    """Lowest, highest and number of strikes, and their average distance (0 with fewer than two)."""
    g = contracts.groupBy("act_symbol").agg(F.min("strike").alias("min_strike"), F.max("strike").alias("max_strike"), F.countDistinct("strike").alias("n_strikes"))
    gap = F.try_divide(F.col("max_strike") - F.col("min_strike"), F.col("n_strikes") - 1)
    return g.withColumn("avg_spacing", F.coalesce(gap, F.lit(0.0)))


def duplicates(chain: DataFrame, keys: list[str]) -> DataFrame:
    return chain.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
