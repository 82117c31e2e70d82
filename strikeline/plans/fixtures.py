"""Option-market tables derived from the shipped ones, in Spark and, for the oracle, in SQL. Values are sums of powers of
two, so that sums and averages do not depend on the order."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AS_OF = "2024-01-30"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("date")

    @cached_property
    def chain(self) -> DataFrame:
        """A row per quote of an option: natural key (date, act_symbol, expiration, strike, call_put), with duplicates."""
        e = self.read("events")
        n, user = F.col("event_id"), F.col("user_id")
        ratio = lambda top, bottom: top.cast("double") / bottom
        return e.select(
            n.alias("id"),
            F.col("ts").cast("date").alias("date"),
            F.concat(F.lit("SYM"), (user % 10).cast("string")).alias("act_symbol"),
            F.expr("date_add(date'2024-02-02', cast(7 * ((event_id div 18) % 4) as int))").alias("expiration"),
            (80 + 5 * ((n * 7) % 9)).cast("double").alias("strike"),
            F.when(n % 2 == 0, "C").otherwise("P").alias("call_put"),
            F.when(n % 23 == 0, 0.0).otherwise(ratio(8 + n % 40, 8)).alias("bid"),
            (ratio(8 + n % 40, 8) + ratio(1 + n % 5, 16)).alias("ask"),
            F.when(n % 17 != 0, ratio(8 + (n * 5) % 41, 64)).alias("vol"),
            ratio(n % 33 - 16, 16).alias("delta"),
            ratio(1 + n % 8, 64).alias("gamma"),
            ratio(-1 - n % 16, 32).alias("theta"),
            ratio(1 + n % 13, 16).alias("vega"),
            ((n * 3) % 500).alias("open_interest"),
            ((n * 11) % 300).alias("volume"),
            F.col("ts").alias("created_at"),
            ratio(185 + 5 * (user % 10), 2).alias("spot"),
        )

    @cached_property
    def latest_chain(self) -> DataFrame:
        """The latest quote of each contract."""
        newest = Window.partitionBy("act_symbol", "expiration", "strike", "call_put").orderBy(F.desc("date"), F.desc("id"))
        return self.chain.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    @cached_property
    def vol(self) -> DataFrame:
        """A row per symbol and day."""
        g = self.chain.filter("vol is not null").groupBy("date", F.col("act_symbol").alias("symbol"))
        return g.agg((F.floor(F.avg("vol") * 64) / 64).alias("iv"), (F.floor(F.avg("vol") * 32) / 32).alias("hv"), F.count("*").alias("n"))

    @cached_property
    def em(self) -> DataFrame:
        """Forecasts: key (underlying, quote_ts, exp_date, horizon)."""
        g = self.chain.groupBy(F.col("act_symbol").alias("underlying"), F.col("date").alias("quote_ts"), F.col("expiration").alias("exp_date"))
        base = g.agg((F.count("*").cast("double") / 64).alias("em_baseline")).withColumn("horizon", F.lit("to_exp"))
        bands = {"band68_low": 0.75, "band68_high": 1.25, "band95_low": 0.5, "band95_high": 1.5}
        return base.select("underlying", "quote_ts", "exp_date", "horizon", "em_baseline", *[(F.col("em_baseline") * F.lit(x)).alias(b) for b, x in bands.items()])

    @cached_property
    def em_all(self) -> DataFrame:
        """Forecasts of three horizons for each key, the shorter ones lower; the one of five days was made on every other day."""
        shares = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(x).alias("x")) for h, x in (("to_exp", 1.0), ("5d", 0.5), ("1d", 0.25))])
        rows = self.em.withColumn("s", F.explode(shares)).filter("s.h <> '5d' or dayofmonth(quote_ts) % 2 = 0")
        return rows.select("underlying", "quote_ts", "exp_date", F.col("s.h").alias("horizon"), *[(F.col(c) * F.col("s.x")).alias(c) for c in self.em.columns[4:]])

    @cached_property
    def em_a(self) -> DataFrame:
        """One of two stores: all but the last two days."""
        return self.em.filter(F.col("quote_ts") <= F.date_sub(self.as_of, 2))

    @cached_property
    def em_b(self) -> DataFrame:
        """The other: the last three days."""
        return self.em.filter(F.col("quote_ts") >= F.date_sub(self.as_of, 2))

    @cached_property
    def earnings(self) -> DataFrame:
        """A row per customer: ten symbols with 40 dates each for every 400 of them."""
        c = F.col("c_custkey")
        return self.read("customer").select(
            F.expr("concat('SYM', cast(c_custkey % 10 + 10 * (c_custkey div 400) as string))").alias("symbol"),
            F.expr("date_add(date'2022-01-03', cast(30 * (c_custkey % 400 div 10) as int))").alias("date"),
            F.when(c % 11 != 0, (c % 37).cast("double") / 8).alias("eps"),
            F.when(c % 13 != 0, (c % 31).cast("double") / 8).alias("eps_estimated"),
            (100 + c % 97).cast("double").alias("revenue"),
            (100 + c % 89).cast("double").alias("revenue_estimated"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Minute aggregates as they come from a feed; times in milliseconds."""
        start = F.expr("unix_millis(cast(date_trunc('minute', ts) as timestamp))")
        sym = F.concat(F.lit("O:SYM"), F.char((65 + F.col("user_id") % 26).cast("int")))
        value = F.col("value")
        return self.read("events").select("event_id", sym.alias("sym"), *[value.alias(c) for c in "ohlc"], (F.col("event_id") % 50).alias("v"), start.alias("s"), (start + 60000).alias("e"))


#: Common table expressions of the same names for the oracle.
SQL = f"""
clock AS (SELECT DATE '{AS_OF}' AS d),
chain AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, 'SYM' || CAST(user_id % 10 AS VARCHAR) AS act_symbol,
    CAST(DATE '2024-02-02' + CAST(7 * ((event_id // 18) % 4) AS INTEGER) AS DATE) AS expiration,
    CAST(80 + 5 * ((event_id * 7) % 9) AS DOUBLE) AS strike, CASE WHEN event_id % 2 = 0 THEN 'C' ELSE 'P' END AS call_put,
    CASE WHEN event_id % 23 = 0 THEN 0e0 ELSE (8 + event_id % 40) / 8e0 END AS bid,
    (8 + event_id % 40) / 8e0 + (1 + event_id % 5) / 16e0 AS ask,
    CASE WHEN event_id % 17 <> 0 THEN (8 + (event_id * 5) % 41) / 64e0 END AS vol,
    (event_id % 33 - 16) / 16e0 AS delta, (1 + event_id % 8) / 64e0 AS gamma, (-1 - event_id % 16) / 32e0 AS theta, (1 + event_id % 13) / 16e0 AS vega,
    (event_id * 3) % 500 AS open_interest, (event_id * 11) % 300 AS volume, ts AS created_at, (185 + 5 * (user_id % 10)) / 2e0 AS spot FROM events),
latest_chain AS (SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY act_symbol, expiration, strike, call_put ORDER BY date DESC, id DESC) = 1),
vol AS (SELECT date, act_symbol AS symbol, floor(avg(vol) * 64) / 64 AS iv, floor(avg(vol) * 32) / 32 AS hv, count(*) AS n FROM chain WHERE vol IS NOT NULL GROUP BY 1, 2),
em AS (SELECT act_symbol AS underlying, date AS quote_ts, expiration AS exp_date, 'to_exp' AS horizon, count(*) / 64e0 AS em_baseline,
    count(*) / 64e0 * 0.75e0 AS band68_low, count(*) / 64e0 * 1.25e0 AS band68_high, count(*) / 64e0 * 0.5e0 AS band95_low, count(*) / 64e0 * 1.5e0 AS band95_high
    FROM chain GROUP BY 1, 2, 3),
em_all AS (SELECT underlying, quote_ts, exp_date, h AS horizon, em_baseline * x AS em_baseline, band68_low * x AS band68_low, band68_high * x AS band68_high, band95_low * x AS band95_low, band95_high * x AS band95_high
    FROM em, (VALUES ('to_exp', 1e0), ('5d', 0.5e0), ('1d', 0.25e0)) AS s(h, x) WHERE h <> '5d' OR day(quote_ts) % 2 = 0),
em_a AS (SELECT * FROM em WHERE quote_ts <= DATE '{AS_OF}' - 2),
em_b AS (SELECT * FROM em WHERE quote_ts >= DATE '{AS_OF}' - 2),
earnings AS (SELECT 'SYM' || CAST(c_custkey % 10 + 10 * (c_custkey // 400) AS VARCHAR) AS symbol, CAST(DATE '2022-01-03' + CAST(30 * (c_custkey % 400 // 10) AS INTEGER) AS DATE) AS date,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 37) / 8e0 END AS eps, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 31) / 8e0 END AS eps_estimated,
    CAST(100 + c_custkey % 97 AS DOUBLE) AS revenue, CAST(100 + c_custkey % 89 AS DOUBLE) AS revenue_estimated FROM customer),
bars AS (SELECT event_id, 'O:SYM' || chr(CAST(65 + user_id % 26 AS INTEGER)) AS sym, value AS o, value AS h, value AS l, value AS c, event_id % 50 AS v,
    epoch_ms(date_trunc('minute', ts)) AS s, epoch_ms(date_trunc('minute', ts)) + 60000 AS e FROM events)
"""
