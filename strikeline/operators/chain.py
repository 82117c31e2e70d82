"""Chains reshaped by strike, contract documents, and earnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.functions import expressions as X


def legs_by_strike(chain: DataFrame) -> DataFrame:
    """A row per strike with each leg's quote, null where a leg is missing; the first contract by id of a leg counts."""
    leg = F.struct("id", "bid", "ask", "vol", "delta", "gamma", "theta", "vega", "open_interest", "volume")
    g = chain.groupBy("act_symbol", "expiration", "strike").pivot("call_put", ["C", "P"]).agg(F.min_by(leg, "id"))
    return g.withColumnsRenamed({"C": "call", "P": "put"})


def nested_chain(chain: DataFrame, as_of: Column) -> DataFrame:
    """Per symbol its expirations by days left, each with its strikes ascending. A document holds one symbol's chain."""
    strikes = legs_by_strike(chain).groupBy("act_symbol", "expiration").agg(F.array_sort(F.collect_list(F.struct("strike", "call", "put"))).alias("strikes"))
    dated = strikes.withColumn("dte", F.datediff("expiration", as_of))
    return dated.groupBy("act_symbol").agg(F.array_sort(F.collect_list(F.struct("dte", "expiration", "strikes"))).alias("expirations"))


def quote_map(chain: DataFrame) -> DataFrame:
    """Per symbol and expiration a map from `strike_side` to the mid."""
    key = F.concat(F.format_string("%.1f", "strike"), F.when(F.col("call_put") == "C", "_call").otherwise("_put"))
    entry = F.struct(key.alias("key"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    return chain.groupBy("act_symbol", "expiration").agg(F.map_from_entries(F.collect_set(entry)).alias("quotes"))


def split_legs(chain: DataFrame) -> DataFrame:
    """Two-sided quotes of each symbol's newest day, with the day's mean strike and each leg's distance from it."""
    quoted = chain.filter("bid > 0 and ask > 0").select("id", "act_symbol", "call_put", "strike", "date")
    # Sums combine before they move, so a symbol however frequent is no task of its own.
    newest = quoted.groupBy("act_symbol").agg(F.max("date").alias("date"))
    rows = quoted.join(newest, ["act_symbol", "date"], "left_semi")
    mean = rows.groupBy("act_symbol").agg(F.avg("strike").alias("mean_strike"))
    return rows.join(mean, "act_symbol").select("id", "act_symbol", "call_put", "strike", "mean_strike", F.abs(F.col("strike") - F.col("mean_strike")).alias("distance"))


def discovery(chain: DataFrame) -> DataFrame:
    """Per symbol: strikes overall, contracts by type, and a rollup of every expiration."""
    from strikeline.operators.views import expiration_rollup, strike_spacing

    rollup = expiration_rollup(chain).groupBy("act_symbol").agg(F.array_sort(F.collect_list(F.struct("expiration", "n_contracts", "n_calls", "n_puts", "n_strikes"))).alias("expirations"))
    types = chain.groupBy("act_symbol").agg(F.count_if(F.col("call_put") == "C").alias("n_calls"), F.count_if(F.col("call_put") == "P").alias("n_puts"))
    return strike_spacing(chain).join(types, "act_symbol").join(rollup, "act_symbol")


def analysis(chain: DataFrame, as_of: Column) -> DataFrame:
    """Pricing, moneyness, liquidity and risk of each contract."""
    call, spot, strike, bid, ask = F.col("call_put") == "C", F.col("spot"), F.col("strike"), F.col("bid"), F.col("ask")
    dte = F.datediff("expiration", as_of)
    middle = X.mid(bid, ask)
    inner = X.intrinsic_value(call, spot, strike)
    money, spread = X.moneyness(call, spot, strike), X.spread_percent(bid, ask, middle)
    return chain.select(
        "id",
        dte.alias("dte"),
        middle.alias("midpoint"),
        (ask - bid).alias("spread"),
        spread.alias("spread_percent"),
        inner.alias("intrinsic"),
        X.time_value(middle, inner).alias("time_value"),
        money.alias("moneyness"),
        (F.abs(spot - strike) / spot * 100).alias("distance_percent"),
        X.liquidity_score(F.col("volume"), F.col("open_interest"), spread).alias("liquidity"),
        X.risk_level(dte).alias("risk"),
        X.time_decay_risk(dte).alias("decay"),
        X.profit_potential(money, dte).alias("profit"),
    )


def snapshot_contracts(snapshots: DataFrame) -> DataFrame:
    """The columns of a chain from landed snapshot documents."""
    s = F.col
    return snapshots.select(
        s("details.ticker").alias("ticker"),
        s("underlying_asset.ticker").alias("act_symbol"),
        s("details.expiration_date").alias("expiration"),
        s("details.strike_price").alias("strike"),
        X.side(s("details.contract_type")).alias("call_put"),
        F.coalesce("last_quote.bid", F.lit(0.0)).alias("bid"),
        F.coalesce("last_quote.ask", F.lit(0.0)).alias("ask"),
        F.coalesce(X.zero_as_missing(s("day.close")), s("last_trade.price"), F.lit(0.0)).alias("last"),
        s("implied_volatility").alias("vol"),
        F.coalesce("open_interest", F.lit(0)).alias("open_interest"),
        F.coalesce("day.volume", F.lit(0)).alias("volume"),
        s("underlying_asset.price").alias("spot"),
        F.timestamp_micros((s("last_trade.sip_timestamp") / 1000).cast("long")).alias("traded_at"),
    )


# earnings


def newest_events(earnings: DataFrame, n: int = 15) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return earnings.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def past_events(earnings: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    """Of the newest events, those before as_of with an actual or an estimate, the last n."""
    past = newest_events(earnings).filter((F.col("date") < as_of) & (F.col("eps").isNotNull() | F.col("eps_estimated").isNotNull()))
    return newest_events(past, n)


def coming_events(earnings: DataFrame, as_of: Column) -> DataFrame:
    """Up to two: the first with an estimate, then the first of another date."""
    coming = newest_events(earnings).filter(F.col("date") >= as_of)
    estimated = F.col("eps_estimated").isNotNull() | F.col("revenue_estimated").isNotNull()
    group = Window.partitionBy("symbol")
    coming = coming.withColumn("_first", F.min(F.when(estimated, F.col("date"))).over(group))
    on_day = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(estimated.desc()))
    coming = coming.withColumn("_on_day", on_day).filter((F.col("date") != F.col("_first")) | F.col("_first").isNull() | (F.col("_on_day") == 1))
    ahead = F.when(F.col("date") == F.col("_first"), 0).otherwise(1)
    coming = coming.withColumn("_ahead", ahead).withColumn("place", F.row_number().over(group.orderBy("_ahead", "date")))
    most = F.when(F.col("_first").isNull(), 1).otherwise(2)
    return coming.filter(F.col("place") <= most).drop("_first", "_ahead", "_on_day")


def surprises(events: DataFrame) -> DataFrame:
    """Actual less estimate, and in per cent to two digits; a percentage of 0 or against 0 is null."""
    percent = lambda part, whole: F.nullif(X.round_half_up(F.try_divide(part, whole) * 100, 2), F.lit(0.0))
    eps, revenue = F.col("eps") - F.col("eps_estimated"), F.col("revenue") - F.col("revenue_estimated")
    return events.select("symbol", "date", eps.alias("eps_surprise"), percent(eps, F.abs("eps_estimated")).alias("eps_percent"), revenue.alias("revenue_surprise"), percent(revenue, F.col("revenue_estimated")).alias("revenue_percent"))


def earnings_stats(symbols: DataFrame, history: DataFrame) -> DataFrame:
    """Rates and averages over the history of surprises, with defaults for a symbol without one. Nulls count as 0 in sums
    and not as beats."""
    zero = F.lit(0.0)
    share = lambda cond: F.count_if(cond) / F.count("*")
    mean = lambda c: F.sum(F.coalesce(c, zero)) / F.count("*")
    g = history.groupBy("symbol").agg(
        share(F.col("eps_surprise") > 0).alias("beat_rate"), mean("eps_surprise").alias("avg_beat"), share(F.col("revenue_surprise") > 0).alias("revenue_beat_rate"), mean("revenue_percent").alias("avg_revenue_beat")
    )
    defaults = {"beat_rate": 0.6, "avg_beat": 0.0, "revenue_beat_rate": 0.65, "avg_revenue_beat": 0.0}
    return symbols.join(g, "symbol", "left").select("symbol", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in defaults.items()])


def price_reactions(events: DataFrame, prices: DataFrame) -> DataFrame:
    """events(symbol, date) with the price of the day before and of the day after, and the move in per cent; null without both."""
    side = lambda shift, name: prices.select("symbol", F.date_add("date", shift).alias("date"), F.col("spot").alias(name))
    both = events.select("symbol", "date").join(side(1, "before"), ["symbol", "date"], "left").join(side(-1, "after"), ["symbol", "date"], "left")
    return both.withColumn("move_percent", F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100)
