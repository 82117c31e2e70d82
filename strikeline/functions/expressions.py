"""Scalar expressions on quotes and contracts. Null inputs give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeline.functions.fixed_values import IV_LEVELS


def known(*cols: Column) -> Column:
    """Whether none is null: greatest and least skip nulls, so results that need all inputs are guarded with it."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def zero_as_missing(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def mid_or_last(bid: Column, ask: Column, last: Column) -> Column:
    """The mid of a two-sided quote, else the last price, else 0; a side at 0 counts as missing."""
    two_sided = (F.coalesce(bid, F.lit(0.0)) != 0) & (F.coalesce(ask, F.lit(0.0)) != 0)
    return F.when(two_sided, mid(bid, ask)).otherwise(F.coalesce(last, F.lit(0.0)))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_ahead(expiration: Column, now: Column, least: int | None = None) -> Column:
    """Days until midnight of the expiration, begun ones in full; not below `least` if given."""
    days = F.ceil((F.unix_timestamp(expiration.cast("timestamp")) - F.unix_timestamp(now)) / 86400).cast("int")
    return days if least is None else F.when(days.isNotNull(), F.greatest(F.lit(least), days))


def spread_percent(bid: Column, ask: Column, middle: Column) -> Column:
    return F.when(middle > 0, (ask - bid) / middle * 100).when(middle.isNotNull(), 0.0)


def intrinsic_value(is_call: Column, spot: Column, strike: Column) -> Column:
    gain = F.when(is_call, spot - strike).otherwise(strike - spot)
    return F.when(gain.isNotNull(), F.greatest(F.lit(0.0), gain))


def time_value(last: Column, intrinsic: Column) -> Column:
    return F.when(known(last, intrinsic), F.greatest(F.lit(0.0), last - intrinsic))


def in_the_money(is_call: Column, spot: Column, strike: Column) -> Column:
    return F.when(is_call, spot > strike).otherwise(spot < strike)


def moneyness(is_call: Column, spot: Column, strike: Column, at_percent: float = 2.0) -> Column:
    near = F.abs(spot - strike) / spot * 100 < at_percent
    return F.when(near, "ATM").when(in_the_money(is_call, spot, strike), "ITM").when(known(spot, strike), "OTM")


def liquidity_score(volume: Column, open_interest: Column, spread_pct: Column) -> Column:
    zero = F.lit(0.0)
    depth = F.least(open_interest / 100, F.lit(50.0)) * 0.5
    tightness = F.greatest(zero, 50 - spread_pct * 10) * 0.2
    return F.when(known(volume, open_interest, spread_pct), F.least(F.lit(100.0), volume * 0.3 + depth + tightness))


def level(x: Column, low_above: int, medium_above: int) -> Column:
    return F.when(x > low_above, "Low").when(x > medium_above, "Medium").when(x.isNotNull(), "High")


def risk_level(dte: Column) -> Column:
    return level(dte, 30, 7)


def time_decay_risk(dte: Column) -> Column:
    return level(dte, 45, 14)


def profit_potential(money: Column, dte: Column) -> Column:
    return F.when((money == "OTM") & (dte < 7), "Low").when(money == "ATM", "High").otherwise("Medium")


def band(spot: Column, move: Column) -> Column:
    """A move with its percentage and both ends."""
    return F.struct(move.alias("move"), (move / spot * 100).alias("percentage"), (spot - move).alias("lower"), (spot + move).alias("upper"))


def window_days(text: Column, default: int = 90) -> Column:
    """'90d' or '90' as days, at least 1; the default for anything else."""
    digits = F.regexp_extract(F.trim(F.lower(text)), r"^([+-]?\d+)d?$", 1)
    return F.greatest(F.lit(1), F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(default)))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def horizons_key(horizons: Column) -> Column:
    return F.array_join(F.array_sort(horizons), ":")


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def bar_width(percent: Column, horizon: Column) -> Column:
    """Per cent of the widest bar, which stands for 5, 15 or 25 per cent by horizon."""
    widest = F.when(horizon == "daily", 5.0).when(horizon == "weekly", 15.0).otherwise(25.0)
    return F.when(percent.isNotNull(), F.least(F.abs(percent) / widest * 100, F.lit(100.0)))


def signed_money(x: Column, pct: Column) -> Column:
    return F.format_string("±$%.2f (%.1f%%)", x, pct)


def underlying_of(ticker: Column) -> Column:
    name = F.regexp_extract(ticker, r"O:([A-Z]+)", 1)
    return F.when(name == "", "UNKNOWN").otherwise(F.coalesce(name, F.lit("UNKNOWN")))


def side(call_put: Column) -> Column:
    """C or P, from any of the sources' ways to write it."""
    first = F.upper(F.substring(F.trim(call_put), 1, 1))
    return F.when(first.isin("C", "P"), first)


def iv_context(percentile: Column, days: Column) -> Column:
    def fields(row) -> Column:
        _, name, colour, advice, text = row
        before, after = text.split("{n}")
        said = F.concat(F.lit(before), days.cast("string"), F.lit(after))
        return F.struct(F.lit(name).alias("level"), said.alias("description"), F.lit(colour).alias("color"), F.lit(advice).alias("recommendation"))

    out = None
    for row in IV_LEVELS[:-1]:
        out = F.when(percentile >= row[0], fields(row)) if out is None else out.when(percentile >= row[0], fields(row))
    return out.when(percentile.isNotNull(), fields(IV_LEVELS[-1]))


def tail_percentile(rank: Column) -> Column:
    """A range rank with both tails compressed by a fifth."""
    return F.when(rank < 20, rank * 0.8).when(rank > 80, 80 + (rank - 80) * 0.8).otherwise(rank)


def range_rank(value: Column, low: Column, high: Column) -> Column:
    """Null where the range is empty."""
    rank = F.try_divide(value - low, high - low) * 100
    return F.when(rank.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rank)))
