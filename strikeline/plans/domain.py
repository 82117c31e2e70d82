"""Pricing, expected moves, IV statistics, chains, contracts, earnings and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strikeline.functions import expressions as X
from strikeline.functions import pricing as P
from strikeline.functions.fixed_values import CDF_A, CDF_P, IV_LEVELS, RANK_MULTIPLIER, SECTOR_VOLATILITY, SYMBOL_VOLATILITY
from strikeline.operators import chain as chains
from strikeline.operators import expected_move as em
from strikeline.operators import ivstats, modelling
from strikeline.plans.registry import add

C = F.col
CALL = lambda: C("call_put") == "C"
r9 = lambda c: F.round(c, 9)

# pricing: exp and ln differ in the last digits between engines
T = lambda: F.datediff("expiration", "date") / 365
TERMS = lambda: (C("spot"), C("strike"), T(), F.lit(0.05), F.lit(0.01), C("vol"))
OPTIONS = lambda t: t.chain.filter("vol is not null")
GREEK = lambda t, name: P.valued(OPTIONS(t).drop("delta", "gamma", "theta", "vega"), [name], CALL(), *TERMS()).select("id", r9(name).alias(name))


def cdf(x: str) -> str:
    t = f"(1e0 / (1e0 + {CDF_P}e0 * (abs({x}) / sqrt(2e0))))"
    series = "0e0"
    for a in reversed(CDF_A):
        series = f"(({series} + ({a}e0)) * {t})"
    tail = f"(0.5e0 * {series} * exp(-({x}) * ({x}) / 2e0))"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1e0 - {tail} END)"


def pdf(x: str) -> str:
    return f"(exp(-0.5e0 * ({x}) * ({x})) / {math.sqrt(2 * math.pi)!r}e0)"


B = """WITH b0 AS (SELECT id, call_put, spot, strike, vol, (expiration - date) / 365e0 AS t, CASE WHEN call_put = 'C' THEN 1e0 ELSE -1e0 END AS g FROM chain WHERE vol IS NOT NULL),
    b1 AS (SELECT *, (ln(spot / strike) + (0.05e0 - 0.01e0 + 0.5e0 * vol * vol) * t) / (vol * sqrt(t)) AS d1 FROM b0), b AS (SELECT *, d1 - vol * sqrt(t) AS d2 FROM b1) """
PRICE = f"greatest(0e0, g * (spot * exp(-0.01e0 * t) * {cdf('(g * d1)')} - strike * exp(-0.05e0 * t) * {cdf('(g * d2)')}))"
add("bsm01_norm_cdf", lambda t: t.chain.select("id", r9(P.norm_cdf(C("delta") * 4)).alias("cdf")), f"SELECT id, round({cdf('(delta * 4)')}, 9) AS cdf FROM chain")
add("bsm02_norm_pdf", lambda t: t.chain.select("id", r9(P.norm_pdf(C("delta") * 4)).alias("pdf")), f"SELECT id, round({pdf('(delta * 4)')}, 9) AS pdf FROM chain")
add("bsm03_d1_d2", lambda t: OPTIONS(t).select("id", r9(P.d1(*TERMS())).alias("d1"), r9(P.d2(*TERMS())).alias("d2")), B + "SELECT id, round(d1, 9) AS d1, round(d2, 9) AS d2 FROM b")
add("bsm04_price", lambda t: GREEK(t, "price"), B + f"SELECT id, round({PRICE}, 9) AS price FROM b")
add("bsm05_delta", lambda t: GREEK(t, "delta"), B + f"SELECT id, round(g * exp(-0.01e0 * t) * {cdf('(g * d1)')}, 9) AS delta FROM b")
add("bsm06_gamma", lambda t: GREEK(t, "gamma"), B + f"SELECT id, round(exp(-0.01e0 * t) * {pdf('d1')} / (spot * vol * sqrt(t)), 9) AS gamma FROM b")
add("bsm07_theta", lambda t: GREEK(t, "theta"),
    B + f"SELECT id, round((-spot * exp(-0.01e0 * t) * {pdf('d1')} * vol / (2 * sqrt(t)) + g * (0.01e0 * spot * exp(-0.01e0 * t) * {cdf('(g * d1)')} - 0.05e0 * strike * exp(-0.05e0 * t) * {cdf('(g * d2)')})) / 365, 9) AS theta FROM b")
add("bsm08_vega", lambda t: GREEK(t, "vega"), B + f"SELECT id, round(spot * exp(-0.01e0 * t) * {pdf('d1')} * sqrt(t) / 100, 9) AS vega FROM b")
add("bsm09_rho", lambda t: GREEK(t, "rho"), B + f"SELECT id, round(g * strike * t * exp(-0.05e0 * t) * {cdf('(g * d2)')} / 100, 9) AS rho FROM b")


def _implied(t):
    priced = OPTIONS(t).withColumn("price", P.price(CALL(), *TERMS()))
    return priced.select("id", F.round(P.implied_vol_bulk(C("price"), CALL(), *TERMS()[:-1]), 5).alias("implied_vol"))


add("bsm10_implied_vol", _implied)


def _repriced(t):
    """The price at the volatility that was found is the price it was found for, where it has a time value to speak of."""
    intrinsic = F.greatest(F.lit(0.0), F.when(CALL(), C("spot") - C("strike")).otherwise(C("strike") - C("spot")))
    priced = P.valued(OPTIONS(t), ["price"], CALL(), *TERMS()).filter(r9("price") - intrinsic > 0.01)
    found = priced.withColumn("found", P.implied_vol_bulk(C("price"), CALL(), *TERMS()[:-1])).withColumnRenamed("price", "given")
    again = P.valued(found, ["price"], CALL(), *TERMS()[:-1], C("found"))
    return again.select("id", r9("given").alias("given"), (F.abs(C("price") - C("given")) < 1e-6).alias("repriced"))


add("bsm10b_repriced", _repriced, B + f"SELECT id, round({PRICE}, 9) AS given, true AS repriced FROM b WHERE round({PRICE}, 9) - greatest(0e0, g * (spot - strike)) > 0.01e0")

# expected moves
EM_SQL = """WITH s AS (SELECT act_symbol, expiration, strike, max(spot) AS spot, max(bid) FILTER (call_put = 'C') AS cb, max(ask) FILTER (call_put = 'C') AS ca, max(vol) FILTER (call_put = 'C') AS cv, max(volume) FILTER (call_put = 'C') AS cn,
      max(bid) FILTER (call_put = 'P') AS pb, max(ask) FILTER (call_put = 'P') AS pa, max(vol) FILTER (call_put = 'P') AS pv, max(volume) FILTER (call_put = 'P') AS pn FROM latest_chain GROUP BY 1, 2, 3 HAVING count(DISTINCT call_put) = 2),
    n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY act_symbol, expiration ORDER BY abs(strike - spot), strike) = 1),
    m AS (SELECT n.*, (cb + ca) / 2 AS cm, (pb + pa) / 2 AS pm, greatest(1, expiration - d) / 365e0 AS t, nullif(cv, 0) AS ci, nullif(pv, 0) AS pi FROM n, clock),
    e AS (SELECT *, greatest(0.05e0, least(2e0, CASE WHEN t < 0.1e0 THEN 0.2e0 * 1.5e0 WHEN t > 0.5e0 THEN 0.2e0 * 0.8e0 ELSE 0.2e0 END * CASE WHEN cm - greatest(0, spot - strike) > 0 THEN least(2e0, (cm - greatest(0, spot - strike)) / (spot * 0.02e0)) ELSE 1 END)) AS guess FROM m),
    i AS (SELECT *, coalesce((ci + pi) / 2, ci, pi, guess) AS iv, ((ca - cb) / cm + (pa - pb) / pm) / 2 AS wide, cn + pn AS trades FROM e),
    k AS (SELECT *, CASE WHEN wide < 0.1e0 THEN 'high' WHEN wide > 0.25e0 THEN 'low' ELSE 'medium' END AS k1, CASE WHEN ci IS NULL AND pi IS NULL THEN 'low' WHEN abs(ci - pi) < 0.02e0 THEN 'high' WHEN abs(ci - pi) > 0.05e0 THEN 'low' ELSE 'medium' END AS ki FROM i),
    j AS (SELECT *, CASE WHEN trades < 10 THEN 'low' WHEN trades > 100 AND k1 = 'medium' THEN 'high' ELSE k1 END AS ks, cm + pm AS sa, spot * iv * sqrt(t) AS va FROM k) """
LEG_BY = ["act_symbol", "expiration"]
add("emv01_atm_data", lambda t: em.atm(em.two_legged(t.latest_chain)).select(*LEG_BY, "strike", "spot", C("call.mid").alias("call_mid"), C("put.mid").alias("put_mid")), EM_SQL + "SELECT act_symbol, expiration, strike, spot, cm AS call_mid, pm AS put_mid FROM j")
add("emv02_estimated_iv", lambda t: t.chain.select("id", r9(em.estimated_iv(C("spot"), C("strike"), F.datediff("expiration", "date") / 365, X.mid(C("bid"), C("ask")))).alias("iv")),
    """WITH v AS (SELECT id, spot, (expiration - date) / 365e0 AS t, (bid + ask) / 2 - greatest(0, spot - strike) AS x FROM chain)
       SELECT id, round(greatest(0.05e0, least(2e0, CASE WHEN t < 0.1e0 THEN 0.2e0 * 1.5e0 WHEN t > 0.5e0 THEN 0.2e0 * 0.8e0 ELSE 0.2e0 END * CASE WHEN x > 0 THEN least(2e0, x / (spot * 0.02e0)) ELSE 1 END)), 9) AS iv FROM v""")
MOVES = lambda t: em.expected_moves(t.latest_chain, t.as_of)
add("emv03_straddle_move", lambda t: MOVES(t).select(*LEG_BY, "straddle_abs", "straddle_pct"), EM_SQL + "SELECT act_symbol, expiration, sa AS straddle_abs, sa / spot * 100 AS straddle_pct FROM j")
add("emv04_iv_move", lambda t: MOVES(t).select(*LEG_BY, r9("iv_abs").alias("iv_abs")), EM_SQL + "SELECT act_symbol, expiration, round(va, 9) AS iv_abs FROM j")
add("emv05_bands", lambda t: MOVES(t).select(*LEG_BY, *[r9(c).alias(c) for c in ("upper_1", "lower_1", "upper_2", "lower_2")]),
    EM_SQL + "SELECT act_symbol, expiration, round(spot + va, 9) AS upper_1, round(spot - va, 9) AS lower_1, round(spot + 2 * va, 9) AS upper_2, round(spot - 2 * va, 9) AS lower_2 FROM j")
DOWN = "CASE WHEN t < 0.02e0 THEN CASE WHEN {0} = 'high' THEN 'medium' ELSE 'low' END ELSE {0} END"
add("emv06_confidence", lambda t: MOVES(t).select(*LEG_BY, "straddle_confidence", "iv_confidence"), EM_SQL + f"SELECT act_symbol, expiration, {DOWN.format('ks')} AS straddle_confidence, {DOWN.format('ki')} AS iv_confidence FROM j")
add("emv07_expected_move", lambda t: MOVES(t).select(*[r9(c).alias(c) if k == "double" else C(c) for c, k in MOVES(t).dtypes]),
    EM_SQL + f"""SELECT act_symbol, expiration, round(strike, 9) AS atm_strike, round(spot, 9) AS spot, round(iv, 9) AS iv, round(sa, 9) AS straddle_abs, round(sa / spot * 100, 9) AS straddle_pct, round(va, 9) AS iv_abs, round(va / spot * 100, 9) AS iv_pct,
      round(spot + va, 9) AS upper_1, round(spot - va, 9) AS lower_1, round(spot + 2 * va, 9) AS upper_2, round(spot - 2 * va, 9) AS lower_2, {DOWN.format('ks')} AS straddle_confidence, {DOWN.format('ki')} AS iv_confidence FROM j""")
BASE_SQL = """WITH iv_ AS (SELECT symbol, coalesce(nullif(arg_max(iv, date), 0), 0.2e0) AS iv FROM vol, clock WHERE date <= d GROUP BY 1),
    x AS (SELECT DISTINCT act_symbol AS symbol, expiration FROM chain, clock WHERE expiration BETWEEN d AND d + 120),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY expiration) AS k FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY expiration) <= 5),
    h AS (SELECT i.symbol, iv, coalesce(expiration, CAST(d + 7 AS DATE)) AS exp_date, coalesce(k, 1) AS k, d FROM iv_ i LEFT JOIN k USING (symbol), clock),
    a AS (SELECT symbol, iv, exp_date, d, 'to_exp' AS horizon, greatest(1, exp_date - d) AS days FROM h UNION ALL SELECT symbol, iv, exp_date, d, '1d', 1 FROM h WHERE k = 1 UNION ALL SELECT symbol, iv, exp_date, d, '5d', 5 FROM h WHERE k = 1),
    f AS (SELECT symbol AS underlying, d AS quote_ts, exp_date, horizon, iv * sqrt(days / 365e0) AS em FROM a) """
add("emv08_baseline_forecasts", lambda t: em.baseline_forecasts(t.vol, t.chain, t.as_of).select("underlying", "quote_ts", "exp_date", "horizon", *[r9(c).alias(c) for c in ("em_baseline", "band68_low", "band68_high", "band95_low", "band95_high")]),
    BASE_SQL + "SELECT underlying, quote_ts, exp_date, horizon, round(em, 9) AS em_baseline, round(em * 0.75e0, 9) AS band68_low, round(em * 1.25e0, 9) AS band68_high, round(em * 0.5e0, 9) AS band95_low, round(em * 1.5e0, 9) AS band95_high FROM f")
FIRST = EM_SQL + ", u AS (SELECT act_symbol, spot, (cm + pm) * 0.85e0 AS mv FROM j QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY expiration) = 1) "
add("emv09_live_straddle", lambda t: em.live_straddle(t.latest_chain).select("act_symbol", "spot", *[r9(c).alias(c) for c in ("straddle", "daily", "weekly", "monthly")], "confidence"),
    FIRST + "SELECT act_symbol, spot, round(mv, 9) AS straddle, round(mv / 30, 9) AS daily, round(mv / 4, 9) AS weekly, round(mv, 9) AS monthly, CASE WHEN mv > 0 THEN 'medium' ELSE 'low' END AS confidence FROM u")
NAMES = lambda: F.element_at(F.array(*map(F.lit, ("AAPL", "TSLA", "KO", "XYZ", "ABC"))), (C("c_custkey") % 5 + 1).cast("int"))
SECTORS = lambda: F.when(C("c_custkey") % 3 == 0, "Energy").when(C("c_custkey") % 3 == 1, "Utilities")
QUOTED = lambda t: t.read("customer").select(NAMES().alias("symbol"), SECTORS().alias("sector"), (100 + C("c_custkey")).cast("double").alias("price"))
_values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}e0" for v in row) + ")" for row in rows)
VOL_SQL = f"""WITH sym(symbol, av, sec_, ad, hi, lo, beta, rk) AS (VALUES {_values(SYMBOL_VOLATILITY)}), sct(sector, av2, ad2, lo2, hi2, beta2, rk2) AS (VALUES {_values(SECTOR_VOLATILITY)}),
    q AS (SELECT ['AAPL', 'TSLA', 'KO', 'XYZ', 'ABC'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'Energy' WHEN c_custkey % 3 = 1 THEN 'Utilities' ELSE 'Technology' END AS sector, CAST(100 + c_custkey AS DOUBLE) AS price FROM customer),
    w AS (SELECT symbol, sector, price, CASE WHEN av IS NULL THEN 'sector' ELSE 'historical' END AS method, CAST(coalesce(av, av2) AS DOUBLE) AS annual_vol, CAST(coalesce(ad, ad2) AS DOUBLE) AS avg_daily,
      CAST(coalesce(lo, lo2) AS DOUBLE) AS low, CAST(coalesce(hi, hi2) AS DOUBLE) AS high, CAST(coalesce(beta, beta2) AS DOUBLE) AS beta, coalesce(rk, rk2) AS rank FROM q LEFT JOIN sym USING (symbol) LEFT JOIN sct USING (sector)) """
add("jon12_sector_defaults", lambda t: em.with_volatility(QUOTED(t)), VOL_SQL + "SELECT * FROM w")
RANKS = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in RANK_MULTIPLIER.items())
add("emv10_realistic_moves", lambda t: em.realistic_moves(QUOTED(t), 11).select("symbol", "method", *[r9(c).alias(c) for c in ("daily", "weekly", "monthly", "straddle_move", "straddle_price", "straddle_pct", "iv_current", "iv_rank", "iv_percentile")]),
    VOL_SQL + f""", x AS (SELECT *, avg_daily / 100 * price * greatest(0.5e0, least(2e0, beta)) * 0.65e0 * CASE rank {RANKS} END AS dm, price * annual_vol * 1.05e0 * sqrt(30e0 / 365) AS sm, annual_vol * 1.05e0 * 100 AS cur FROM w),
      y AS (SELECT *, greatest(0, least(100, (cur - low * 100) / (high * 100 - low * 100) * 100)) AS rk FROM x)
      SELECT symbol, method, round(dm, 9) AS daily, round(dm * sqrt(5e0) * 0.75e0, 9) AS weekly, round(dm * sqrt(22e0) * 0.8e0, 9) AS monthly, round(sm, 9) AS straddle_move, round(sm * 2, 9) AS straddle_price, round(sm / price * 100, 9) AS straddle_pct,
        round(cur, 9) AS iv_current, round(rk, 9) AS iv_rank, round(CASE WHEN rk < 20 THEN rk * 0.8e0 WHEN rk > 80 THEN 80 + (rk - 80) * 0.8e0 ELSE rk END, 9) AS iv_percentile FROM y""")
add("emv11_scaled_ranges", lambda t: MOVES(t).select(*LEG_BY, em.horizon_moves(C("straddle_abs"), "scale").alias("m")).select(*LEG_BY, *[r9(f"m.{c}").alias(c) for c in ("daily", "weekly", "monthly")]),
    EM_SQL + "SELECT act_symbol, expiration, round(sa, 9) AS daily, round(sa * 2.65e0, 9) AS weekly, round(sa * 5.48e0, 9) AS monthly FROM j")
add("emv12_simple_move", lambda t: MOVES(t).select(*LEG_BY, em.horizon_moves(C("straddle_pct"), "divide").alias("m")).select(*LEG_BY, *[r9(f"m.{c}").alias(c) for c in ("daily", "weekly", "monthly")]),
    EM_SQL + "SELECT act_symbol, expiration, round(sa / spot * 100 / 30, 9) AS daily, round(sa / spot * 100 / 4, 9) AS weekly, round(sa / spot * 100, 9) AS monthly FROM j")
add("emv13_daily_percent", lambda t: t.vol.select("symbol", "date", (C("iv") * F.sqrt(F.lit(1 / 365)) * 100).alias("em_percent")), "SELECT symbol, date, iv * sqrt(1e0 / 365) * 100 AS em_percent FROM vol")
SPOTS = lambda t: t.chain.groupBy(C("act_symbol").alias("symbol"), "date").agg(F.avg("ask").alias("spot"))
add("emv14_realised_moves", lambda t: em.realised_moves(SPOTS(t), 5).select("symbol", "date", r9("realised").alias("realised")),
    "WITH s AS (SELECT act_symbol AS symbol, date, avg(ask) AS spot FROM chain GROUP BY 1, 2) SELECT a.symbol, a.date, round(abs(ln(b.spot / a.spot)), 9) AS realised FROM s a LEFT JOIN s b ON a.symbol = b.symbol AND b.date = a.date + 5")

# IV statistics
CURRENT = lambda t: t.vol.groupBy("symbol").agg(F.max_by("iv", "date").alias("current"))
STATS = lambda t: ivstats.iv_stats(t.vol, CURRENT(t))
STATS_SQL = """WITH c AS (SELECT symbol, arg_max(iv, date) AS cur FROM vol GROUP BY 1), st AS (SELECT v.symbol, max(cur) AS current, min(iv) AS min_iv, max(iv) AS max_iv, avg(iv) AS mean_iv, median(iv) AS median_iv, round(stddev_pop(iv), 9) AS std_iv, count(*) AS days,
    count(*) FILTER (iv <= cur) / count(*) * 100 AS percentile, CASE WHEN max(iv) = min(iv) THEN 0.5e0 ELSE greatest(0, least(1, (max(cur) - min(iv)) / nullif(max(iv) - min(iv), 0))) END AS rank FROM vol v JOIN c USING (symbol) WHERE iv > 0 AND iv < 10 GROUP BY 1) """
add("ivs01_iv_stats", lambda t: STATS(t).withColumn("std_iv", r9("std_iv")), STATS_SQL + "SELECT * FROM st")
add("agg23_iv_summary", lambda t: STATS(t).select("symbol", "min_iv", "max_iv", "mean_iv", "median_iv", "days"), STATS_SQL + "SELECT symbol, min_iv, max_iv, mean_iv, median_iv, days FROM st")
_case = lambda k: "CASE " + " ".join(f"WHEN percentile >= {row[0]} THEN {k(row)}" for row in IV_LEVELS[:-1]) + f" ELSE {k(IV_LEVELS[-1])} END"
_text = lambda row: "'" + row[4].replace("{n}", "' || CAST(days AS VARCHAR) || '") + "'"
add("ivs02_context", lambda t: ivstats.context(STATS(t)), STATS_SQL + f"SELECT symbol, {_case(lambda r: repr(r[1]))} AS level, {_case(_text)} AS description, {_case(lambda r: repr(r[2]))} AS color, {_case(lambda r: repr(r[3]))} AS recommendation FROM st")
add("ivs03_trend", lambda t: ivstats.trend(t.vol), """WITH l AS (SELECT * FROM vol QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10), g AS (SELECT symbol, CASE WHEN count(*) < 10 THEN 0 ELSE coalesce((arg_max(iv, date) - arg_min(iv, date)) / nullif(arg_min(iv, date), 0) * 100, 0) END AS change FROM l GROUP BY 1)
    SELECT symbol, change, CASE WHEN change > 2 THEN 'expanding' WHEN change < -2 THEN 'contracting' ELSE 'stable' END AS direction, CASE WHEN abs(change) < 5 THEN 'weak' WHEN abs(change) < 15 THEN 'moderate' ELSE 'strong' END AS strength FROM g""")
add("win12_trend_points", lambda t: ivstats.last_points(t.vol, 10).select("symbol", "date", "iv"), "SELECT symbol, date, iv FROM vol QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10")
TODAY = lambda t: t.vol.filter("symbol < 'SYM4'").select("symbol", F.date_add(t.as_of, 1).alias("date"), C("iv")).groupBy("symbol", "date").agg(F.max("iv").alias("iv"))
add("win11_sparkline", lambda t: ivstats.sparkline(t.vol, TODAY(t), 20), """WITH k AS (SELECT symbol, date, iv FROM vol QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 20), a AS (SELECT * FROM k UNION ALL SELECT symbol, CAST(d + 1 AS DATE), max(iv) FROM vol, clock WHERE symbol < 'SYM4' GROUP BY 1, 2)
    SELECT symbol, date, iv, date = max(date) OVER (PARTITION BY symbol) AS is_last FROM a""")
add("ivs04_range_rank", lambda t: STATS(t).select("symbol", X.tail_percentile(X.range_rank(C("current"), C("min_iv"), C("max_iv"))).alias("percentile")),
    STATS_SQL + ", r AS (SELECT symbol, CASE WHEN max_iv > min_iv THEN greatest(0, least(100, (current - min_iv) / nullif(max_iv - min_iv, 0) * 100)) END AS rk FROM st) SELECT symbol, CASE WHEN rk < 20 THEN rk * 0.8e0 WHEN rk > 80 THEN 80 + (rk - 80) * 0.8e0 ELSE rk END AS percentile FROM r")
add("ivs05_fallback_stats", lambda t: STATS(t).select("symbol", X.round_half_up(C("percentile")).cast("long").alias("percentile"), X.round_half_up(C("percentile")).cast("long").alias("rank")), STATS_SQL + "SELECT symbol, CAST(floor(percentile + 0.5e0) AS BIGINT) AS percentile, CAST(floor(percentile + 0.5e0) AS BIGINT) AS rank FROM st")
add("ivs06_stored_stats", lambda t: t.vol.groupBy("symbol").agg(F.max_by(F.struct("iv", "hv"), "date").alias("s")).select("symbol", "s.*"), "SELECT symbol, iv, hv FROM vol QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
add("ivs07_series", lambda t: t.vol.filter((C("symbol") == "SYM3") & (C("date") >= F.date_sub(t.as_of, 15))).orderBy("date").limit(1000).select("date", "iv"), "SELECT date, iv FROM vol, clock WHERE symbol = 'SYM3' AND date >= d - 15")
add("ivs08_scaled_series", lambda t: ivstats.scaled(t.vol), "SELECT symbol, date, coalesce((iv - min(iv) OVER w) / nullif(max(iv) OVER w - min(iv) OVER w, 0) * 100, 0) AS height, date = max(date) OVER w AS is_last FROM vol WINDOW w AS (PARTITION BY symbol)")

# chains and contracts
add("piv01_enhanced_chain", lambda t: chains.legs_by_strike(t.latest_chain).select("act_symbol", "expiration", "strike", C("call.bid").alias("call_bid"), C("call.delta").alias("call_delta"), C("put.bid").alias("put_bid"), C("put.volume").alias("put_volume")),
    "SELECT act_symbol, expiration, strike, max(bid) FILTER (call_put = 'C') AS call_bid, max(delta) FILTER (call_put = 'C') AS call_delta, max(bid) FILTER (call_put = 'P') AS put_bid, max(volume) FILTER (call_put = 'P') AS put_volume FROM latest_chain GROUP BY 1, 2, 3")
add("piv01b_nested_chain", lambda t: chains.nested_chain(t.latest_chain, t.as_of).select("act_symbol", F.explode("expirations").alias("e")).select("act_symbol", "e.dte", F.size("e.strikes").cast("long").alias("n_strikes"), F.element_at("e.strikes", 1)["strike"].alias("lowest")),
    "SELECT act_symbol, expiration - d AS dte, count(DISTINCT strike) AS n_strikes, min(strike) AS lowest FROM latest_chain, clock GROUP BY 1, 2")
add("piv02_quote_map", lambda t: chains.quote_map(t.latest_chain).select("act_symbol", "expiration", F.explode("quotes").alias("key", "mid")),
    "SELECT act_symbol, expiration, printf('%.1f', strike) || CASE WHEN call_put = 'C' THEN '_call' ELSE '_put' END AS key, (bid + ask) / 2 AS mid FROM latest_chain")
add("piv03_two_sided", lambda t: em.two_legged(t.latest_chain).select("act_symbol", "expiration", "strike", C("call.mid").alias("call_mid"), C("put.mid").alias("put_mid")),
    "SELECT c.act_symbol, c.expiration, c.strike, (c.bid + c.ask) / 2 AS call_mid, (p.bid + p.ask) / 2 AS put_mid FROM latest_chain c JOIN latest_chain p USING (act_symbol, expiration, strike) WHERE c.call_put = 'C' AND p.call_put = 'P'")
add("piv04_split_legs", lambda t: chains.split_legs(t.chain), """WITH r AS (SELECT *, max(date) OVER (PARTITION BY act_symbol) AS md FROM chain WHERE bid > 0 AND ask > 0)
    SELECT id, act_symbol, call_put, strike, avg(strike) OVER w AS mean_strike, abs(strike - avg(strike) OVER w) AS distance FROM r WHERE date = md WINDOW w AS (PARTITION BY act_symbol)""")
add("con01_discovery", lambda t: chains.discovery(t.latest_chain).select("act_symbol", "n_strikes", "avg_spacing", "n_calls", "n_puts", F.size("expirations").cast("long").alias("n_expirations"), F.element_at("expirations", 1)["n_contracts"].alias("first_contracts")),
    """WITH f AS (SELECT act_symbol, expiration, count(*) AS n FROM latest_chain GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY expiration) = 1)
       SELECT act_symbol, count(DISTINCT strike) AS n_strikes, coalesce((max(strike) - min(strike)) / nullif(count(DISTINCT strike) - 1, 0), 0) AS avg_spacing, count(*) FILTER (call_put = 'C') AS n_calls, count(*) FILTER (call_put = 'P') AS n_puts,
       count(DISTINCT l.expiration) AS n_expirations, max(f.n) AS first_contracts FROM latest_chain l JOIN f USING (act_symbol) GROUP BY 1""")
add("con02_analysis", lambda t: chains.analysis(t.chain, t.as_of), """WITH v AS (SELECT *, expiration - d AS dte, (bid + ask) / 2 AS m, greatest(0, CASE WHEN call_put = 'C' THEN spot - strike ELSE strike - spot END) AS inner_,
      CASE WHEN abs(spot - strike) / spot * 100 < 2 THEN 'ATM' WHEN (call_put = 'C' AND spot > strike) OR (call_put = 'P' AND spot < strike) THEN 'ITM' ELSE 'OTM' END AS mo FROM chain, clock),
    w AS (SELECT *, CASE WHEN m > 0 THEN (ask - bid) / m * 100 ELSE 0 END AS sp FROM v)
    SELECT id, dte, m AS midpoint, ask - bid AS spread, sp AS spread_percent, inner_ AS intrinsic, greatest(0, m - inner_) AS time_value, mo AS moneyness, abs(spot - strike) / spot * 100 AS distance_percent,
      least(100e0, volume * 0.3e0 + least(open_interest / 100, 50e0) * 0.5e0 + greatest(0e0, 50 - sp * 10) * 0.2e0) AS liquidity, CASE WHEN dte > 30 THEN 'Low' WHEN dte > 7 THEN 'Medium' ELSE 'High' END AS risk,
      CASE WHEN dte > 45 THEN 'Low' WHEN dte > 14 THEN 'Medium' ELSE 'High' END AS decay, CASE WHEN mo = 'OTM' AND dte < 7 THEN 'Low' WHEN mo = 'ATM' THEN 'High' ELSE 'Medium' END AS profit FROM w""")
add("con03_underlying", lambda t: t.bars.select("event_id", X.underlying_of(F.when(C("event_id") % 7 == 0, F.lit("bad")).otherwise(C("sym"))).alias("underlying")), "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'UNKNOWN' ELSE substr(sym, 3) END AS underlying FROM bars")

# earnings
EARN_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM earnings QUALIFY k <= 15),
    p AS (SELECT * FROM n, clock WHERE date < d AND (eps IS NOT NULL OR eps_estimated IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 7),
    s AS (SELECT symbol, date, eps - eps_estimated AS eps_surprise, nullif(floor((eps - eps_estimated) / nullif(abs(eps_estimated), 0) * 100 * 100 + 0.5e0) / 100, 0) AS eps_percent, revenue - revenue_estimated AS revenue_surprise,
      nullif(floor((revenue - revenue_estimated) / nullif(revenue_estimated, 0) * 100 * 100 + 0.5e0) / 100, 0) AS revenue_percent FROM p) """
add("earn01_past", lambda t: chains.past_events(t.earnings, t.as_of).select("symbol", "date"), EARN_SQL + "SELECT symbol, date FROM p")
add("earn01b_coming", lambda t: chains.coming_events(t.earnings, t.as_of).select("symbol", "date", "place"), EARN_SQL + """, c AS (SELECT n.*, min(CASE WHEN eps_estimated IS NOT NULL OR revenue_estimated IS NOT NULL THEN date END) OVER (PARTITION BY symbol) AS f FROM n, clock WHERE date >= d)
    SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date <> f, date) AS place FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date <> f, date) <= CASE WHEN f IS NULL THEN 1 ELSE 2 END""")
SURPRISES = lambda t: chains.surprises(chains.past_events(t.earnings, t.as_of))
add("earn02_surprises", SURPRISES, EARN_SQL + "SELECT * FROM s")
STATS_EARN = EARN_SQL + """, g AS (SELECT symbol, count(*) FILTER (eps_surprise > 0) / count(*) AS beat_rate, sum(coalesce(eps_surprise, 0)) / count(*) AS avg_beat, count(*) FILTER (revenue_surprise > 0) / count(*) AS revenue_beat_rate, round(sum(coalesce(revenue_percent, 0)) / count(*), 9) AS avg_revenue_beat FROM s GROUP BY 1)
    SELECT symbol, coalesce(beat_rate, 0.6e0) AS beat_rate, coalesce(avg_beat, 0e0) AS avg_beat, coalesce(revenue_beat_rate, 0.65e0) AS revenue_beat_rate, coalesce(avg_revenue_beat, 0e0) AS avg_revenue_beat FROM (SELECT DISTINCT act_symbol AS symbol FROM chain) LEFT JOIN g USING (symbol)"""
SYMBOLS = lambda t: t.chain.select(C("act_symbol").alias("symbol")).distinct()
add("earn03_stats", lambda t: chains.earnings_stats(SYMBOLS(t), SURPRISES(t)).withColumn("avg_revenue_beat", r9("avg_revenue_beat")), STATS_EARN)
add("agg30_beat_rates", lambda t: chains.earnings_stats(SYMBOLS(t), SURPRISES(t)).select("symbol", "beat_rate", "revenue_beat_rate"), f"SELECT symbol, beat_rate, revenue_beat_rate FROM ({STATS_EARN.replace('WITH n AS', 'WITH n AS', 1)})")
add("earn04_next_event", lambda t: t.earnings.filter(C("date") > t.as_of).groupBy("symbol").agg(F.min_by(F.struct("date", "eps_estimated"), "date").alias("e")).select("symbol", "e.*"), "SELECT symbol, date, eps_estimated FROM earnings, clock WHERE date > d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) = 1")
add("earn06_display", lambda t: chains.coming_events(t.earnings, t.as_of).filter("place = 1").select("symbol", "date").union(chains.newest_events(chains.past_events(t.earnings, t.as_of), 3).select("symbol", "date")),
    EARN_SQL + """, c AS (SELECT n.*, min(CASE WHEN eps_estimated IS NOT NULL OR revenue_estimated IS NOT NULL THEN date END) OVER (PARTITION BY symbol) AS f FROM n, clock WHERE date >= d)
    SELECT symbol, date FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date <> f, date) = 1 UNION ALL SELECT symbol, date FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 3)""")

# models
EMKEY = ["underlying", "quote_ts", "exp_date", "horizon"]
FEATURES = lambda t: t.em.select(*EMKEY, "em_baseline", "band68_low")
LABELS = lambda t: t.em.select(*EMKEY, (C("em_baseline") * 2 + 1).alias("realized_move"), F.lit(1).alias("target"))
add("mlt02_training_frame", lambda t: modelling.training_frame(FEATURES(t), LABELS(t), EMKEY)[0], "SELECT underlying, quote_ts, exp_date, horizon, em_baseline, band68_low, em_baseline * 2 + 1 AS target FROM em")
add("mlt05_latest_features", lambda t: modelling.latest_features(FEATURES(t), ["SYM1", "SYM2"]), "SELECT underlying, quote_ts, exp_date, horizon, em_baseline, band68_low FROM em WHERE underlying IN ('SYM1', 'SYM2') AND (underlying, quote_ts) IN (SELECT (underlying, max(quote_ts)) FROM em GROUP BY underlying)")


def _bands(t):
    frame, features, _ = modelling.training_frame(FEATURES(t), LABELS(t), EMKEY)
    model = modelling.BandModel.fit(frame, features, trees=5, depth=3)
    return model.predict(modelling.latest_features(FEATURES(t)), features, EMKEY)


add("mlt06_predictions", _bands)
add("mlt07_atm_features", lambda t: modelling.atm_features(em.atm(em.two_legged(t.latest_chain)), t.latest_chain),
    EM_SQL + """, w AS (SELECT act_symbol, expiration, arg_min(vol, (abs(abs(delta) - 0.25e0), strike, id)) FILTER (call_put = 'C' AND vol IS NOT NULL) AS c25, arg_min(vol, (abs(abs(delta) - 0.25e0), strike, id)) FILTER (call_put = 'P' AND vol IS NOT NULL) AS p25 FROM latest_chain GROUP BY 1, 2)
    SELECT act_symbol, expiration, cm + pm AS straddle, c25 - p25 AS risk_reversal, (c25 + p25) / 2 - (cv + pv) / 2 AS butterfly FROM j JOIN w USING (act_symbol, expiration)""")
SCORED = lambda t: t.em.withColumn("realized", C("em_baseline") * (F.dayofmonth("quote_ts") % 8).cast("double") / 4)
add("mlt08_performance", lambda t: modelling.performance(SCORED(t), ["underlying"]).select("underlying", *[r9(c).alias(c) for c in ("coverage_68", "coverage_95", "mae", "mape", "pinball_68", "pinball_95")]),
    """WITH y AS (SELECT *, em_baseline * (day(quote_ts) % 8) / 4e0 AS y FROM em) SELECT underlying, round(avg(CASE WHEN y BETWEEN band68_low AND band68_high THEN 1e0 ELSE 0 END), 9) AS coverage_68, round(avg(CASE WHEN y BETWEEN band95_low AND band95_high THEN 1e0 ELSE 0 END), 9) AS coverage_95,
      round(avg(abs(y - em_baseline)), 9) AS mae, round(avg(abs(y - em_baseline) / nullif(abs(y), 0)), 9) AS mape,
      round(avg((CASE WHEN y >= band68_low THEN 0.16e0 * (y - band68_low) ELSE 0.84e0 * (band68_low - y) END + CASE WHEN y >= band68_high THEN 0.84e0 * (y - band68_high) ELSE 0.16e0 * (band68_high - y) END) / 2), 9) AS pinball_68,
      round(avg((CASE WHEN y >= band95_low THEN 0.025e0 * (y - band95_low) ELSE 0.975e0 * (band95_low - y) END + CASE WHEN y >= band95_high THEN 0.975e0 * (y - band95_high) ELSE 0.025e0 * (band95_high - y) END) / 2), 9) AS pinball_95 FROM y GROUP BY 1""")
add("mlt07b_term_slope", lambda t: modelling.term_slope(t.latest_chain.filter("vol is not null").select("act_symbol", C("vol").alias("iv"), F.datediff("expiration", t.as_of).alias("dte")), ["act_symbol"]).select("act_symbol", r9("slope").alias("slope")),
    "SELECT act_symbol, round(regr_slope(vol, expiration - d), 9) AS slope FROM latest_chain, clock WHERE vol IS NOT NULL GROUP BY 1")
