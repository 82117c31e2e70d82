"""Tables from landed vendor payloads beyond option snapshots: quotes, option legs, earnings calendars, assembled chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = "symbol string, regularMarketPrice double, regularMarketChange double, regularMarketChangePercent double, regularMarketVolume bigint, marketCap double, trailingPE double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double"
LEG = "strike double, bid double, ask double, lastPrice double, volume bigint, openInterest bigint, impliedVolatility double"
CALENDAR = "symbol string, date date, hour string, epsEstimate double, epsActual double, revenueEstimate double, revenueActual double"
EARNINGS = "symbol string, date date, eps double, epsEstimated double, revenue double, revenueEstimated double"
#: What stands for a leg's missing or zero implied vol.
DEFAULT_VOL = 0.25


def _or(value, default) -> Column:
    """The value, or the default where it is null or zero."""
    return F.coalesce(F.nullif(F.col(value), F.lit(0)), F.lit(default))


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """A quote document a line; price, change and volume are 0 where they are missing."""
    rows = spark.read.schema(QUOTE).json(path)
    zero = {"regularMarketPrice": "price", "regularMarketChange": "change", "regularMarketChangePercent": "change_percent"}
    kept = {"marketCap": "market_cap", "trailingPE": "pe", "fiftyTwoWeekHigh": "high_52", "fiftyTwoWeekLow": "low_52"}
    return rows.select("symbol", *[_or(c, 0.0).alias(n) for c, n in zero.items()], _or("regularMarketVolume", 0).cast("long").alias("volume"), *[F.col(c).alias(n) for c, n in kept.items()])


def option_legs(spark: SparkSession, path: str) -> DataFrame:
    """Strikes with both legs from documents {symbol, calls: [...], puts: [...]}; of a leg that is there twice the last counts."""
    pages = spark.read.schema(f"symbol string, calls array<struct<{LEG}>>, puts array<struct<{LEG}>>").json(path)

    def side(name: str) -> DataFrame:
        rows = pages.select("symbol", F.posexplode(name).alias("at", "leg")).select("symbol", "at", "leg.*")
        zero = {"bid": "bid", "ask": "ask", "lastPrice": "last"}
        values = [*[_or(c, 0.0).alias(n) for c, n in zero.items()], *[_or(c, 0).cast("long").alias(n) for c, n in (("volume", "volume"), ("openInterest", "open_interest"))], _or("impliedVolatility", DEFAULT_VOL).alias("iv")]
        return rows.groupBy("symbol", "strike").agg(F.max_by(F.struct(*values), "at").alias(name[:-1]))

    return side("calls").join(side("puts"), ["symbol", "strike"])


def earnings(spark: SparkSession, path: str) -> DataFrame:
    """Events from documents that are arrays of them, in the column names of the earnings operators."""
    rows = spark.read.schema(EARNINGS).json(path)
    return rows.withColumnsRenamed({"epsEstimated": "eps_estimated", "revenueEstimated": "revenue_estimated"})


def next_events(spark: SparkSession, calendar: str, history: str, as_of: Column, past: int = 8) -> DataFrame:
    """Per symbol the first calendar entry after as_of with its hour, and rates over the last `past` reported quarters.

    calendar has documents {earningsCalendar: [...]}, history a row {symbol, period, actual, estimate} a line. A symbol
    without history has a beat rate of 0.6; missing surprises count as 0 in the average.
    """
    entries = spark.read.schema(f"earningsCalendar array<struct<{CALENDAR}>>").json(calendar).select(F.explode("earningsCalendar").alias("e")).select("e.*")
    coming = entries.filter(F.col("date") > as_of).groupBy("symbol").agg(F.min_by(F.struct("date", "hour", "epsEstimate"), F.struct("date", "hour")).alias("e"))
    hour = F.when(F.col("e.hour") == "bmo", "BMO").when(F.col("e.hour") == "amc", "AMC").otherwise("UNKNOWN")
    coming = coming.select("symbol", F.col("e.date").alias("next_date"), hour.alias("next_time"), F.col("e.epsEstimate").alias("eps_estimate"))
    from strikeline.operators.views import top_per_group

    reported = spark.read.schema("symbol string, period date, actual double, estimate double").json(history)
    newest = top_per_group(reported, ["symbol"], [F.desc("period")], past).withColumn("surprise", F.col("actual") - F.col("estimate"))
    rates = newest.groupBy("symbol").agg((F.count_if(F.col("surprise") > 0) / F.count("*")).alias("beat_rate"), (F.sum(F.coalesce("surprise", F.lit(0.0))) / F.count("*")).alias("avg_beat"))
    both = coming.join(rates, "symbol", "full_outer")
    return both.select("symbol", "next_date", "next_time", "eps_estimate", F.coalesce("beat_rate", F.lit(0.6)).alias("beat_rate"), F.coalesce("avg_beat", F.lit(0.0)).alias("avg_beat"))


def assembled_chain(contracts: DataFrame, market: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """Contracts of each underlying's next expiration with their market data and the underlying's price; a contract or an
    underlying without such data is left out. contracts(ticker, underlying_ticker, expiration_date, ...),
    market(ticker, ...), prices(underlying_ticker, price)."""
    coming = contracts.filter(F.col("expiration_date") > as_of)
    nearest = coming.groupBy("underlying_ticker").agg(F.min("expiration_date").alias("expiration_date"))
    rows = coming.join(nearest, ["underlying_ticker", "expiration_date"], "left_semi")
    return rows.join(market, "ticker").join(prices, "underlying_ticker")
