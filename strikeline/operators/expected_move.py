"""Expected moves: from the at-the-money straddle, from volatility, from volatility tables, and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.functions import expressions as X
from strikeline.functions.fixed_values import HORIZON_FACTORS, RANK_MULTIPLIER, SECTOR_VOLATILITY, SYMBOL_VOLATILITY

LEGS = ["bid", "ask", "mid", "iv", "volume"]
BY = ["act_symbol", "expiration"]


def two_legged(chain: DataFrame) -> DataFrame:
    """A row per strike with both legs as structs call and put; strikes with one leg are left out."""
    leg = F.struct("bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.col("vol").alias("iv"), "volume")
    side = lambda s: F.max_by(F.when(F.col("call_put") == s, leg), F.when(F.col("call_put") == s, F.col("id")))
    g = chain.groupBy(*BY, "strike").agg(F.max("spot").alias("spot"), side("C").alias("call"), side("P").alias("put"))
    return g.filter(F.col("call").isNotNull() & F.col("put").isNotNull())


def atm(strikes: DataFrame) -> DataFrame:
    """The strike nearest to spot per symbol and expiration, the lower of two equally near."""
    nearest = F.min_by(F.struct("strike", "spot", "call", "put"), F.struct(F.abs(F.col("strike") - F.col("spot")), "strike"))
    return strikes.groupBy(*BY).agg(nearest.alias("a")).select(*BY, "a.*")


def estimated_iv(spot: Column, strike: Column, years: Column, call_mid: Column) -> Column:
    """A rough volatility where neither leg has one: by time to expiry and the time value of the call."""
    extra = call_mid - F.greatest(F.lit(0.0), spot - strike)
    base = F.when(years < 0.1, 0.2 * 1.5).when(years > 0.5, 0.2 * 0.8).otherwise(0.2)
    lifted = F.when(extra > 0, base * F.least(F.lit(2.0), extra / (spot * 0.02))).otherwise(base)
    return F.greatest(F.lit(0.05), F.least(F.lit(2.0), lifted))


def atm_iv(call_iv: Column, put_iv: Column, estimate: Column) -> Column:
    """The mean of both legs, else the one there is, else the estimate. Zero is no volatility."""
    c, p = X.zero_as_missing(call_iv), X.zero_as_missing(put_iv)
    return F.coalesce((c + p) / 2, c, p, estimate)


def step_down(level: Column) -> Column:
    return F.when(level == "high", "medium").otherwise("low")


def straddle_confidence(call: Column, put: Column, years: Column) -> Column:
    """By relative spreads, then volume, then nearness of expiry. A thin market ends at low whatever its spreads."""
    wide = ((call["ask"] - call["bid"]) / call["mid"] + (put["ask"] - put["bid"]) / put["mid"]) / 2
    volume = F.coalesce(call["volume"], F.lit(0)) + F.coalesce(put["volume"], F.lit(0))
    by_spread = F.when(wide < 0.10, "high").when(wide > 0.25, "low").otherwise("medium")
    by_volume = F.when(volume < 10, "low").when((volume > 100) & (by_spread == "medium"), "high").otherwise(by_spread)
    return F.when(years < 0.02, step_down(by_volume)).otherwise(by_volume)


def iv_confidence(call: Column, put: Column, years: Column) -> Column:
    c, p = X.zero_as_missing(call["iv"]), X.zero_as_missing(put["iv"])
    apart = F.abs(c - p)
    level = F.when(c.isNull() & p.isNull(), "low").when(apart < 0.02, "high").when(apart > 0.05, "low").otherwise("medium")
    return F.when(years < 0.02, step_down(level)).otherwise(level)


def expected_moves(chain: DataFrame, as_of: Column) -> DataFrame:
    """Per symbol and expiration: the straddle's move, the volatility's move, bands of one and two of it, confidence."""
    a = atm(two_legged(chain)).withColumn("years", F.greatest(F.lit(1), F.datediff("expiration", as_of)) / 365)
    a = a.withColumn("iv", atm_iv(F.col("call.iv"), F.col("put.iv"), estimated_iv(F.col("spot"), F.col("strike"), F.col("years"), F.col("call.mid"))))
    a = a.withColumns({"straddle_abs": F.col("call.mid") + F.col("put.mid"), "iv_abs": F.col("spot") * F.col("iv") * F.sqrt("years")})
    return a.select(
        *BY,
        F.col("strike").alias("atm_strike"),
        "spot",
        "iv",
        "straddle_abs",
        (F.col("straddle_abs") / F.col("spot") * 100).alias("straddle_pct"),
        "iv_abs",
        (F.col("iv_abs") / F.col("spot") * 100).alias("iv_pct"),
        *[(F.col("spot") + k * F.col("iv_abs")).alias(n) for k, n in ((1, "upper_1"), (-1, "lower_1"), (2, "upper_2"), (-2, "lower_2"))],
        straddle_confidence(F.col("call"), F.col("put"), F.col("years")).alias("straddle_confidence"),
        iv_confidence(F.col("call"), F.col("put"), F.col("years")).alias("iv_confidence"),
    )


def horizon_moves(move: Column, method: str = "divide") -> Column:
    """Daily, weekly and monthly moves from one, by the named rule."""
    factors = HORIZON_FACTORS[method]
    return F.struct(*[(move * f).alias(n) for n, f in zip(("daily", "weekly", "monthly"), factors, strict=True)])


def live_straddle(chain: DataFrame, factor: float = 0.85) -> DataFrame:
    """From the first expiration of each symbol: a part of the straddle as the month's move, fractions of it below."""
    a = atm(two_legged(chain))
    first = Window.partitionBy("act_symbol").orderBy("expiration")
    a = a.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    move = (F.col("call.mid") + F.col("put.mid")) * factor
    out = a.select("act_symbol", "spot", move.alias("straddle"), horizon_moves(move).alias("m")).select("act_symbol", "spot", "straddle", "m.*")
    return out.withColumn("confidence", F.when(F.col("straddle") > 0, "medium").otherwise("low"))


def volatility_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = "annual_vol double, avg_daily double, low double, high double, beta double, rank string"
    symbols = [(s, sector, v, d, lo, hi, b, r) for s, v, sector, d, hi, lo, b, r in SYMBOL_VOLATILITY]
    sectors = list(SECTOR_VOLATILITY)
    return spark.createDataFrame(symbols, f"symbol string, sector string, {names}"), spark.createDataFrame(sectors, f"sector string, {names}")


def with_volatility(quotes: DataFrame, default_sector: str = "Technology") -> DataFrame:
    """quotes(symbol, sector, price) with the symbol's volatility data, else its sector's."""
    fields = ["annual_vol", "avg_daily", "low", "high", "beta", "rank"]
    symbols, sectors = volatility_tables(quotes.sparkSession)
    own = symbols.select("symbol", *[F.col(f).alias(f"own_{f}") for f in fields])
    rows = quotes.withColumn("sector", F.coalesce("sector", F.lit(default_sector)))
    rows = rows.join(F.broadcast(own), "symbol", "left").join(F.broadcast(sectors), "sector", "left")  # fixed tables of some 20 rows
    chosen = [F.when(F.col("own_annual_vol").isNotNull(), F.col(f"own_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return rows.select("symbol", "sector", "price", F.when(F.col("own_annual_vol").isNotNull(), "historical").otherwise("sector").alias("method"), *chosen)


def realistic_moves(quotes: DataFrame, hour: int) -> DataFrame:
    """Moves from volatility tables; the hour of the day tells whether markets are open."""
    regime = 1.05 if 9 <= hour <= 16 else 0.95
    rank = F.create_map(*[F.lit(x) for pair in RANK_MULTIPLIER.items() for x in pair])
    rows = with_volatility(quotes)
    vol, price = F.col("annual_vol") * regime, F.col("price")
    beta = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("beta")))
    daily = F.col("avg_daily") / 100 * price * beta * 0.65 * F.coalesce(rank[F.col("rank")], F.lit(1.0))
    straddle = price * vol * F.sqrt(F.lit(30 / 365))
    iv_rank = X.range_rank(vol * 100, F.col("low") * 100, F.col("high") * 100)
    return rows.select(
        "symbol",
        "method",
        daily.alias("daily"),
        (daily * F.sqrt(F.lit(5.0)) * 0.75).alias("weekly"),
        (daily * F.sqrt(F.lit(22.0)) * 0.80).alias("monthly"),
        straddle.alias("straddle_move"),
        (straddle * 2).alias("straddle_price"),
        (straddle / price * 100).alias("straddle_pct"),
        (vol * 100).alias("iv_current"),
        iv_rank.alias("iv_rank"),
        X.tail_percentile(iv_rank).alias("iv_percentile"),
    )


def baseline_forecasts(vol: DataFrame, chain: DataFrame, as_of: Column, alpha: float = 1.0, expiries: int = 5, within: int = 120) -> DataFrame:
    """One plan for all symbols: the newest iv, the next expirations, a row per expiration and horizon.

    The baseline is a fraction of spot. A symbol without an upcoming expiration gets one in seven days.
    """
    iv = vol.filter(F.col("date") <= as_of).groupBy("symbol").agg(F.max_by("iv", "date").alias("iv"))
    iv = iv.withColumn("iv", F.when(F.col("iv").isNull() | (F.col("iv") == 0), 0.2).otherwise(F.col("iv")))
    dates = chain.filter(F.col("expiration").between(as_of, F.date_add(as_of, within))).select(F.col("act_symbol").alias("symbol"), "expiration").distinct()
    order = Window.partitionBy("symbol").orderBy("expiration")
    dates = dates.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= expiries)
    rows = iv.join(dates, "symbol", "left").withColumns({"exp_date": F.coalesce("expiration", F.date_add(as_of, 7)), "k": F.coalesce("k", F.lit(1))})
    dte = F.greatest(F.lit(1), F.datediff("exp_date", as_of))
    horizon = lambda name, days: F.struct(F.lit(name).alias("horizon"), days.cast("int").alias("days"))
    near = F.array(horizon("to_exp", dte), horizon("1d", F.lit(1)), horizon("5d", F.lit(5)))
    rows = rows.withColumn("h", F.explode(F.when(F.col("k") == 1, near).otherwise(F.array(horizon("to_exp", dte)))))
    em = alpha * F.col("iv") * F.sqrt(F.col("h.days") / 365)
    base = rows.select(F.col("symbol").alias("underlying"), as_of.alias("quote_ts"), "exp_date", "h.horizon", em.alias("em_baseline"))
    return base.withColumns({n: F.col("em_baseline") * k for n, k in (("band68_low", 0.75), ("band68_high", 1.25), ("band95_low", 0.5), ("band95_high", 1.5))})


def realised_moves(spots: DataFrame, days: int) -> DataFrame:
    """spots(symbol, date, spot) with the absolute log return to the row `days` calendar days later, null where there is none."""
    later = spots.select("symbol", F.date_sub("date", days).alias("date"), F.col("spot").alias("later"))
    return spots.join(later, ["symbol", "date"], "left").select("symbol", "date", F.abs(F.ln(F.col("later") / F.col("spot"))).alias("realised"))
