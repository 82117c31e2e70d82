"""Row validation: each rule adds `path: message` to a list of errors; a valid row has an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_PATTERN = r"^[A-Za-z0-9.-]+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
HORIZONS, TIMINGS, SIDES = ("to_exp", "1d", "5d"), ("bmo", "amc", "unknown"), ("C", "P")


def errors(*rules: tuple[str, str, Column]) -> Column:
    """Messages of the rules (path, message, holds) that do not hold; a rule that comes out null does not hold."""
    found = [F.when(F.coalesce(holds, F.lit(False)), None).otherwise(f"{path}: {message}") for path, message, holds in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def optional(value: Column, holds: Column) -> Column:
    return value.isNull() | holds


def symbol_rules(symbol: Column, path: str = "symbol") -> list[tuple[str, str, Column]]:
    return [
        (path, "must have 1 to 10 characters", F.length(symbol).between(1, 10)),
        (path, "may have letters, digits, dots and hyphens only", symbol.rlike(SYMBOL_PATTERN)),
    ]


def expiry_rules(text: Column, as_of: Column | None = None, path: str = "expiry") -> list[tuple[str, str, Column]]:
    day = F.expr("null") if as_of is None else F.to_date(text.try_cast("date"))
    rules = [(path, "must be in YYYY-MM-DD format", text.rlike(DATE_PATTERN))]
    return rules if as_of is None else [*rules, (path, "must be in the future", day > as_of)]


def quote_rules(strike: Column, mid: Column, bid: Column, ask: Column, iv: Column, volume: Column, open_interest: Column) -> list[tuple[str, str, Column]]:
    return [
        ("strike", "must be positive", strike > 0),
        *[(n, "cannot be negative", x >= 0) for n, x in (("mid", mid), ("bid", bid), ("ask", ask))],
        ("iv", "must be positive", optional(iv, iv > 0)),
        *[(n, "cannot be negative", optional(x, x >= 0)) for n, x in (("volume", volume), ("openInterest", open_interest))],
    ]


def chain_rules(strikes: Column, calls: Column, puts: Column, spot: Column, dte: Column) -> list[tuple[str, str, Column]]:
    return [
        ("spot", "must be positive", spot > 0),
        ("daysToExpiry", "must be positive", dte > 0),
        *[(n, "must not be empty", F.size(x) > 0) for n, x in (("strikes", strikes), ("calls", calls), ("puts", puts))],
    ]


def stats_rules(rank: Column, percentile: Column, positive: dict[str, Column], std: Column) -> list[tuple[str, str, Column]]:
    return [
        ("rank", "must be between 0 and 1", rank.between(0, 1)),
        ("percentile", "must be between 0 and 100", percentile.between(0, 100)),
        *[(n, "must be positive", x > 0) for n, x in positive.items()],
        ("stdDev", "cannot be negative", std >= 0),
    ]


def move_rules(**moves: Column) -> list[tuple[str, str, Column]]:
    return [(n.replace("_", "."), "cannot be negative", x >= 0) for n, x in moves.items()]


def member(path: str, value: Column, allowed: tuple[str, ...]) -> tuple[str, str, Column]:
    return (path, "must be one of " + ", ".join(allowed), value.isin(*allowed))


def bounded(value: Column, default: int, least: int, most: int) -> Column:
    """A requested number within its bounds, the default where there is none."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(value, F.lit(default))))


def validated(df: DataFrame, *rules: tuple[str, str, Column]) -> DataFrame:
    out = df.withColumn("errors", errors(*rules))
    return out.withColumn("valid", F.size("errors") == 0)


def search_symbols(names: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """names(symbol, name) that match, exact symbols first, then prefixes, then parts of symbol, then of name."""
    q, symbol, name = query.strip().lower(), F.lower("symbol"), F.lower("name")
    place = F.when(symbol == q, 0).when(symbol.startswith(q), 1).when(symbol.contains(q), 2).when(name.contains(q), 3)
    return names.withColumn("place", place).filter("place is not null").orderBy("place", "symbol", "name").limit(max(1, min(20, limit)))
