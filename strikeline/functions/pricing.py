"""Black-Scholes prices, greeks and implied volatility as column expressions. Invalid inputs give null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.fixed_values import CDF_A, CDF_P

#: The bracket of implied volatility, and the halvings that narrow it below 1e-11.
VOL_LOW, VOL_HIGH, HALVINGS = 0.01, 5.0, 40


def norm_cdf(x: Column) -> Column:
    """The five-term polynomial approximation; its error is below 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + CDF_P * z)
    series = F.lit(0.0)
    for a in reversed(CDF_A):
        series = (series + a) * t
    tail = series * F.exp(-z * z)
    return F.when(x < 0, 0.5 * tail).otherwise(1 - 0.5 * tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def d1(spot: Column, strike: Column, years: Column, rate: Column, dividend: Column, vol: Column) -> Column:
    valid = (years > 0) & (vol > 0) & (spot > 0) & (strike > 0)
    return F.when(valid, (F.ln(spot / strike) + (rate - dividend + 0.5 * vol * vol) * years) / (vol * F.sqrt(years)))


def d2(spot, strike, years, rate, dividend, vol) -> Column:
    return d1(spot, strike, years, rate, dividend, vol) - vol * F.sqrt(years)


def price(is_call: Column, spot, strike, years, rate, dividend, vol) -> Column:
    """Never below 0, as the polynomial's error might otherwise make it."""
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    a, b = d1(spot, strike, years, rate, dividend, vol), d2(spot, strike, years, rate, dividend, vol)
    value = sign * (spot * F.exp(-dividend * years) * norm_cdf(sign * a) - strike * F.exp(-rate * years) * norm_cdf(sign * b))
    return F.when(a.isNotNull(), F.greatest(F.lit(0.0), value))


def delta(is_call, spot, strike, years, rate, dividend, vol) -> Column:
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    return sign * F.exp(-dividend * years) * norm_cdf(sign * d1(spot, strike, years, rate, dividend, vol))


def gamma(spot, strike, years, rate, dividend, vol) -> Column:
    return F.exp(-dividend * years) * norm_pdf(d1(spot, strike, years, rate, dividend, vol)) / (spot * vol * F.sqrt(years))


def theta(is_call, spot, strike, years, rate, dividend, vol) -> Column:
    """Per calendar day."""
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    a, b = d1(spot, strike, years, rate, dividend, vol), d2(spot, strike, years, rate, dividend, vol)
    decay = -spot * F.exp(-dividend * years) * norm_pdf(a) * vol / (2 * F.sqrt(years))
    carry = sign * (dividend * spot * F.exp(-dividend * years) * norm_cdf(sign * a) - rate * strike * F.exp(-rate * years) * norm_cdf(sign * b))
    return (decay + carry) / 365


def vega(spot, strike, years, rate, dividend, vol) -> Column:
    """Per point of volatility."""
    return spot * F.exp(-dividend * years) * norm_pdf(d1(spot, strike, years, rate, dividend, vol)) * F.sqrt(years) / 100


def rho(is_call, spot, strike, years, rate, dividend, vol) -> Column:
    """Per point of the rate."""
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    return sign * strike * years * F.exp(-rate * years) * norm_cdf(sign * d2(spot, strike, years, rate, dividend, vol)) / 100


def valued(df: DataFrame, wanted: list[str], is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column, vol: Column) -> DataFrame:
    """df with the wanted ones of price, delta, gamma, theta, vega and rho, as the functions of those names give them. What they
    share is a column of its own first: d1, d2, the discounts, and one tail of the normal distribution for each of d1 and d2,
    which serves both signs."""
    terms = {"_call": is_call, "_s": spot, "_k": strike, "_t": years, "_r": rate, "_q": dividend, "_v": vol}
    c = {n: F.col(n) for n in [*terms, "_root", "_d1", "_d2", "_dq", "_dr", "_g", "_u1", "_u2", "_n1", "_n2", "_p1"]}
    out = df.withColumns(terms)
    out = out.withColumns({"_root": F.sqrt(c["_t"]), "_dq": F.exp(-c["_q"] * c["_t"]), "_dr": F.exp(-c["_r"] * c["_t"]), "_g": F.when(c["_call"], 1.0).otherwise(-1.0)})
    out = out.withColumn("_d1", d1(*(c[n] for n in ("_s", "_k", "_t", "_r", "_q", "_v"))))
    out = out.withColumn("_d2", c["_d1"] - c["_v"] * c["_root"])
    out = out.withColumns({f"_u{k}": 1 / (1 + CDF_P * (F.abs(c[f"_d{k}"]) / math.sqrt(2))) for k in (1, 2)})

    def cumulative(k: int) -> Column:
        series, d = F.lit(0.0), c[f"_d{k}"]
        for a in reversed(CDF_A):
            series = (series + a) * c[f"_u{k}"]
        return 0.5 * series * F.exp(-0.5 * d * d)

    out = out.withColumns({"_n1": cumulative(1), "_n2": cumulative(2), "_p1": norm_pdf(c["_d1"])})
    out = out.withColumns({f"_n{k}": F.when(c["_g"] * c[f"_d{k}"] < 0, c[f"_n{k}"]).otherwise(1 - c[f"_n{k}"]) for k in (1, 2)})
    held, owed = c["_s"] * c["_dq"], c["_k"] * c["_dr"]
    made = {
        "price": F.when(c["_d1"].isNotNull(), F.greatest(F.lit(0.0), c["_g"] * (held * c["_n1"] - owed * c["_n2"]))),
        "delta": c["_g"] * c["_dq"] * c["_n1"],
        "gamma": c["_dq"] * c["_p1"] / (c["_s"] * c["_v"] * c["_root"]),
        "theta": (-held * c["_p1"] * c["_v"] / (2 * c["_root"]) + c["_g"] * (c["_q"] * held * c["_n1"] - c["_r"] * owed * c["_n2"])) / 365,
        "vega": held * c["_p1"] * c["_root"] / 100,
        "rho": c["_g"] * owed * c["_t"] * c["_n2"] / 100,
    }
    # A null d1 means invalid terms; the tails of the other branch must not stand in for it.
    return out.select(*[x for x in df.columns if x not in wanted], *[F.when(c["_d1"].isNotNull(), made[w]).alias(w) for w in wanted])


def implied_vol(market: Column, is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column) -> Column:
    """Volatility at which the price is `market`, by halving the bracket. At or below intrinsic value the lower end, beyond
    the bracket the nearer end, null for a price that is not positive or for invalid terms."""
    names = ["m", "c", "s", "k", "t", "r", "q"]
    terms = F.struct(*[x.alias(n) for x, n in zip((market, is_call, spot, strike, years, rate, dividend), names, strict=True)])
    args = lambda a: [a["p"][n] for n in names[1:]]

    def halve(a: Column, _: Column) -> Column:
        middle = (a["lo"] + a["hi"]) / 2
        low = price(*args(a), middle) < a["p"]["m"]
        return F.struct(a["p"].alias("p"), F.when(low, middle).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(terms.alias("p"), F.lit(VOL_LOW).alias("lo"), F.lit(VOL_HIGH).alias("hi"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)
    intrinsic = F.greatest(F.lit(0.0), F.when(is_call, spot - strike).otherwise(strike - spot))
    terms = (is_call, spot, strike, years, rate, dividend)
    return (
        F.when(~F.coalesce(market > 0, F.lit(False)) | price(*terms, F.lit(0.2)).isNull(), None)
        .when((market <= intrinsic) | (market < price(*terms, F.lit(VOL_LOW))), VOL_LOW)
        .when(market > price(*terms, F.lit(VOL_HIGH)), VOL_HIGH)
        .otherwise(root)
    )


def implied_vol_bulk(market: Column, is_call: Column, spot: Column, strike: Column, years: Column, rate: Column, dividend: Column) -> Column:
    """The same root for many rows: halvings of whole Arrow batches in numpy instead of a loop in each row's expression."""
    from pyspark.sql.types import DoubleType

    return F.pandas_udf(_halve_batch, DoubleType())(market, is_call, spot, strike, years, rate, dividend)


def _cdf_batch(x):
    t = 1 / (1 + CDF_P * np.abs(x) / math.sqrt(2))
    series = 0.0
    for a in reversed(CDF_A):
        series = (series + a) * t
    tail = 0.5 * series * np.exp(-x * x / 2)
    return np.where(x < 0, tail, 1 - tail)


def _halve_batch(market: pd.Series, is_call: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, dividend: pd.Series) -> pd.Series:
    m, s, k, t, r, q = (x.to_numpy(dtype=float, na_value=np.nan) for x in (market, spot, strike, years, rate, dividend))
    sign = np.where(is_call.fillna(False).to_numpy(dtype=bool), 1.0, -1.0)
    with np.errstate(all="ignore"):
        valid = (m > 0) & (s > 0) & (k > 0) & (t > 0) & ~np.isnan(r + q) & is_call.notna().to_numpy()

        def price_at(vol):
            a = (np.log(s / k) + (r - q + 0.5 * vol * vol) * t) / (vol * np.sqrt(t))
            return np.maximum(0, sign * (s * np.exp(-q * t) * _cdf_batch(sign * a) - k * np.exp(-r * t) * _cdf_batch(sign * (a - vol * np.sqrt(t)))))

        lo, hi = np.full(len(m), VOL_LOW), np.full(len(m), VOL_HIGH)
        for _ in range(HALVINGS):
            middle = (lo + hi) / 2
            low = price_at(middle) < m
            lo, hi = np.where(low, middle, lo), np.where(low, hi, middle)
        out = np.where(m > price_at(VOL_HIGH), VOL_HIGH, (lo + hi) / 2)
        out = np.where((m <= np.maximum(0, sign * (s - k))) | (m < price_at(VOL_LOW)), VOL_LOW, out)
    return pd.Series(np.where(valid, out, np.nan)).astype("Float64").where(valid)
