"""Joins, aggregations, windows, set operations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.operators import asof, merging, views
from strikeline.plans.registry import add
from strikeline.sources import sinks

C = F.col
KEY = ["date", "act_symbol", "expiration", "strike", "call_put"]
EMKEY = ["underlying", "quote_ts", "exp_date", "horizon"]
BANDS = ["band68_low", "band68_high", "band95_low", "band95_high"]
CALL = lambda: C("call_put") == "C"

# joins
add("jon01_atm_options", lambda t: views.atm_options(t.chain).select("id", "avg_strike"),
    "SELECT c.id, a.avg_strike FROM chain c JOIN (SELECT act_symbol, date, avg(strike) AS avg_strike FROM chain GROUP BY 1, 2) a USING (act_symbol, date) WHERE abs(c.strike - a.avg_strike) < 5")


def _correlated(t):
    t.chain.createOrReplaceTempView("chain_quotes")
    return t.spark.sql("SELECT id, strike FROM chain_quotes c WHERE abs(strike - (SELECT avg(strike) FROM chain_quotes i WHERE i.act_symbol = c.act_symbol AND i.date = c.date)) < 5")


add("jon02_atm_correlated", _correlated, "SELECT c.id, c.strike FROM chain c JOIN (SELECT act_symbol, date, avg(strike) AS m FROM chain GROUP BY 1, 2) a USING (act_symbol, date) WHERE abs(c.strike - m) < 5")
LABELS = lambda t: t.em.filter(F.dayofmonth("quote_ts") % 2 == 0).select(*EMKEY, (C("em_baseline") * 2).alias("realized"))
SQL_LABELS = "labels_ AS (SELECT underlying, quote_ts, exp_date, horizon, em_baseline * 2 AS realized FROM em WHERE day(quote_ts) % 2 = 0)"
add("jon03_features_labels", lambda t: t.em.join(LABELS(t), EMKEY).select(*EMKEY, "em_baseline", "realized"), f"WITH {SQL_LABELS} SELECT underlying, quote_ts, exp_date, horizon, em_baseline, realized FROM em JOIN labels_ USING (underlying, quote_ts, exp_date, horizon)")
PRED = lambda t: t.em.filter(F.dayofmonth("quote_ts") < 20).filter(C("underlying") != "SYM5").select(*EMKEY, *[(C(b) + 1).alias(b) for b in BANDS])
SQL_PRED = "pred AS (SELECT underlying, exp_date, horizon, band68_low + 1 AS p68l, band68_high + 1 AS p68h, band95_low + 1 AS p95l, band95_high + 1 AS p95h FROM em WHERE day(quote_ts) < 20 AND underlying <> 'SYM5' QUALIFY row_number() OVER (PARTITION BY underlying, exp_date, horizon ORDER BY quote_ts DESC) = 1)"
add("jon04_merge_predictions", lambda t: merging.merge_predictions(t.em, PRED(t), BANDS),
    f"""WITH {SQL_PRED} SELECT underlying, quote_ts, exp_date, horizon, em_baseline, coalesce(p68l, band68_low) AS band68_low, coalesce(p68h, band68_high) AS band68_high, coalesce(p95l, band95_low) AS band95_low,
        coalesce(p95h, band95_high) AS band95_high FROM em LEFT JOIN pred USING (underlying, exp_date, horizon)""")
LEG = ["act_symbol", "expiration", "strike"]
legs = lambda t, side, name: t.latest_chain.filter(C("call_put") == side).select(*LEG, C("ask").alias(name))
add("jon05_call_put", lambda t: legs(t, "C", "call_ask").join(legs(t, "P", "put_ask"), LEG), "SELECT c.act_symbol, c.expiration, c.strike, c.ask AS call_ask, p.ask AS put_ask FROM latest_chain c JOIN latest_chain p USING (act_symbol, expiration, strike) WHERE c.call_put = 'C' AND p.call_put = 'P'")
QUOTES = lambda t: t.chain.groupBy(C("act_symbol").alias("symbol")).agg(F.max("spot").alias("price")).filter("symbol <> 'SYM9'")
STATS = lambda t: t.vol.filter("symbol < 'SYM5'").groupBy("symbol").agg(F.max("iv").alias("high"), F.min("iv").alias("low"))
add("jon06_chain_quote_stats", lambda t: t.latest_chain.groupBy(C("act_symbol").alias("symbol")).agg(F.count("*").alias("n")).join(QUOTES(t), "symbol").join(STATS(t), "symbol", "left").select("symbol", "n", "price", F.coalesce("high", F.lit(40.0)).alias("high"), F.coalesce("low", F.lit(15.0)).alias("low")),
    """WITH q AS (SELECT act_symbol AS symbol, max(spot) AS price FROM chain WHERE act_symbol <> 'SYM9' GROUP BY 1), s AS (SELECT symbol, max(iv) AS high, min(iv) AS low FROM vol WHERE symbol < 'SYM5' GROUP BY 1)
       SELECT l.symbol, n, price, coalesce(high, 40e0) AS high, coalesce(low, 15e0) AS low FROM (SELECT act_symbol AS symbol, count(*) AS n FROM latest_chain GROUP BY 1) l JOIN q USING (symbol) LEFT JOIN s USING (symbol)""")
add("jon07_contract_market_data", lambda t: t.latest_chain.select("id", "strike").join(t.latest_chain.filter("bid > 0").select("id", "bid"), "id"), "SELECT id, strike, bid FROM latest_chain WHERE bid > 0")
add("jon08_semi", lambda t: t.em.join(t.chain.filter("bid = 0").select(C("act_symbol").alias("underlying"), C("date").alias("quote_ts")).distinct(), ["underlying", "quote_ts"], "left_semi").select(*EMKEY),
    "SELECT underlying, quote_ts, exp_date, horizon FROM em WHERE EXISTS (SELECT 1 FROM chain c WHERE c.bid = 0 AND c.act_symbol = underlying AND c.date = quote_ts)")
add("jon09_anti", lambda t: t.em.join(t.chain.filter("bid = 0").select(C("act_symbol").alias("underlying"), C("date").alias("quote_ts")).distinct(), ["underlying", "quote_ts"], "left_anti").select(*EMKEY),
    "SELECT underlying, quote_ts, exp_date, horizon FROM em WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.bid = 0 AND c.act_symbol = underlying AND c.date = quote_ts)")
add("jon10_freshest", lambda t: merging.freshest(t.em_a, t.em_b.filter("underlying <> 'SYM2'"), ["underlying", "exp_date"], "quote_ts").select(*EMKEY, "em_baseline"),
    """SELECT underlying, quote_ts, exp_date, horizon, em_baseline FROM (SELECT *, 0 AS src FROM em_a UNION ALL SELECT *, 1 FROM em_b WHERE underlying <> 'SYM2')
       QUALIFY row_number() OVER (PARTITION BY underlying, exp_date ORDER BY quote_ts DESC, src DESC) = 1""")
PRICES = [("act_symbol < 'SYM4'", 1.0), ("act_symbol < 'SYM8'", 2.0), ("true", 3.0)]
add("jon11_priority", lambda t: merging.by_priority([t.chain.filter(w).groupBy(C("act_symbol").alias("symbol")).agg((F.max("spot") * k).alias("price")) for w, k in PRICES], "symbol", C("price") > 0),
    "SELECT act_symbol AS symbol, max(spot) * CASE WHEN act_symbol < 'SYM4' THEN 1 WHEN act_symbol < 'SYM8' THEN 2 ELSE 3 END AS price, CASE WHEN act_symbol < 'SYM4' THEN 0 WHEN act_symbol < 'SYM8' THEN 1 ELSE 2 END AS source FROM chain GROUP BY act_symbol")

# aggregations
add("agg01_daily_iv_summary", lambda t: views.daily_iv_summary(t.chain), "SELECT date, act_symbol, avg(vol) AS avg_iv, median(vol) AS median_iv, count(*) AS n_options FROM chain WHERE vol IS NOT NULL GROUP BY 1, 2")
SUMMARY = "SELECT act_symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS total_options, avg(vol) AS avg_iv, count(DISTINCT date) AS trading_days FROM chain WHERE vol IS NOT NULL GROUP BY 1"
add("agg02_symbol_summary", lambda t: views.symbol_summary(t.chain), SUMMARY)
add("agg03_symbols_metadata", lambda t: views.symbol_summary(t.chain).drop("trading_days").withColumn("updated_at", t.as_of), f"SELECT s.* EXCLUDE (trading_days), d AS updated_at FROM ({SUMMARY}) s, clock")
add("agg04_average_strike", lambda t: views.average_strike(t.chain), "SELECT act_symbol, date, avg(strike) AS avg_strike FROM chain GROUP BY 1, 2")
add("agg05_totals", lambda t: t.chain.agg(F.count("*").alias("n"), F.countDistinct("act_symbol").alias("n_symbols"), F.min("date").alias("first"), F.max("date").alias("last")), "SELECT count(*) AS n, count(DISTINCT act_symbol) AS n_symbols, min(date) AS first, max(date) AS last FROM chain")
add("agg06_top_iv", lambda t: t.chain.filter("vol is not null").groupBy("act_symbol").agg(F.avg("vol").alias("avg_iv")).orderBy(F.desc("avg_iv"), "act_symbol").limit(5), "SELECT act_symbol, avg(vol) AS avg_iv FROM chain WHERE vol IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("agg07_forecast_counts", lambda t: t.em.filter(C("quote_ts") >= F.date_sub(t.as_of, 7)).groupBy("underlying").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "underlying").limit(100), "SELECT underlying, count(*) AS n FROM em, clock WHERE quote_ts >= d - 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
count_by = lambda df: df.groupBy("underlying").agg(F.count("*").alias("n"))
add("agg08_hybrid_counts", lambda t: count_by(t.em_a).unionByName(count_by(t.em_b)).groupBy("underlying").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("underlying")), "SELECT underlying, CAST(sum(n) AS BIGINT) AS n FROM (SELECT underlying, count(*) AS n FROM em_a GROUP BY 1 UNION ALL SELECT underlying, count(*) FROM em_b GROUP BY 1) GROUP BY 1")
add("agg09_historical_em", lambda t: t.chain.filter((C("vol") > 0) & (C("date") >= F.date_sub(t.as_of, 20))).groupBy("act_symbol", "date").agg(F.avg("vol").alias("avg_vol"), F.count("*").alias("n")).withColumn("em_percent", C("avg_vol") * F.sqrt(F.lit(1 / 365)) * 100),
    "SELECT act_symbol, date, avg(vol) AS avg_vol, count(*) AS n, avg(vol) * sqrt(1e0 / 365) * 100 AS em_percent FROM chain, clock WHERE vol > 0 AND date >= d - 20 GROUP BY 1, 2")
add("agg10_day_expirations", lambda t: t.chain.filter(C("date") == "2024-01-10").groupBy("act_symbol", "expiration").agg(F.count("*").alias("n"), F.avg("vol").alias("avg_vol")).withColumn("monthly", views.is_monthly(C("expiration"))),
    "SELECT act_symbol, expiration, count(*) AS n, avg(vol) AS avg_vol, day(expiration) BETWEEN 15 AND 21 AS monthly FROM chain WHERE date = DATE '2024-01-10' GROUP BY 1, 2")
QUALITY = "count(*) AS n, count(*) FILTER (bid > 0 AND ask > 0) AS n_liquid, avg(vol) AS avg_vol, avg(delta) AS avg_delta, avg(gamma) AS avg_gamma, avg(ask - bid) AS avg_spread FROM chain"
add("agg11_day_summary", lambda t: views.market_quality(t.chain.filter(C("date") == "2024-01-10"), ["act_symbol"]), f"SELECT act_symbol, {QUALITY} WHERE date = DATE '2024-01-10' GROUP BY 1")


def _capped_average(t, null_as_zero):
    rows = views.top_per_group(t.chain.filter(C("date") == "2024-01-10"), ["act_symbol"], [C("strike"), C("call_put"), C("id")], 20)
    vol = F.coalesce("vol", F.lit(0.0)) if null_as_zero else C("vol")
    return rows.groupBy("act_symbol").agg(F.count("*").alias("n"), F.avg(vol).alias("avg_vol"))


CAPPED = "SELECT act_symbol, count(*) AS n, avg({}) AS avg_vol FROM (SELECT * FROM chain WHERE date = DATE '2024-01-10' QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY strike, call_put, id) <= 20) GROUP BY 1"
add("agg12_day_chain_average", lambda t: _capped_average(t, True), CAPPED.format("coalesce(vol, 0)"))
add("agg12b_day_chain_known_vols", lambda t: _capped_average(t, False), CAPPED.format("vol"))
add("agg13_yearly", lambda t: views.yearly(t.chain, 2022, 2025), """WITH y AS (SELECT act_symbol, year(date) AS year, avg(vol) AS avg_vol, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM chain GROUP BY 1, 2),
    g AS (SELECT act_symbol, unnest(range(2022, 2026)) AS year FROM (SELECT DISTINCT act_symbol FROM chain))
    SELECT act_symbol, year, coalesce(avg_vol, 0) AS avg_vol, coalesce(n, 0) AS n, first_date, last_date FROM g LEFT JOIN y USING (act_symbol, year)""")
add("agg14_progressive", lambda t: views.progressive(t.chain, F.lit("2025-01-20").cast("date"), 40, 20).select("id", "act_symbol", "bucket"),
    """WITH b AS (SELECT *, greatest(1, CAST(ceil((DATE '2025-01-20' - date) / 365e0) AS INTEGER)) AS bucket FROM chain)
       SELECT id, act_symbol, bucket FROM b WHERE bucket <= 6 QUALIFY row_number() OVER (PARTITION BY act_symbol, bucket ORDER BY date DESC, strike, id) <= CASE WHEN bucket = 1 THEN 40 ELSE 20 END""")
add("agg15_standard_expirations", lambda t: views.standard_expirations(t.chain), "SELECT expiration, count(*) AS n, avg(vol) AS avg_vol, avg((bid + ask) / 2) AS avg_mid, day(expiration) BETWEEN 15 AND 21 AS monthly FROM chain WHERE bid > 0 AND ask > 0 AND dayofweek(expiration) = 5 GROUP BY 1 HAVING count(*) > 10")
add("agg16_monthly_iv", lambda t: views.top_per_group(t.chain.filter("vol is not null").groupBy("act_symbol", F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("vol").alias("avg_vol"), F.count("*").alias("n")), ["act_symbol"], [F.desc("month")], 24),
    "SELECT act_symbol, strftime(date, '%Y-%m') AS month, avg(vol) AS avg_vol, count(*) AS n FROM chain WHERE vol IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY strftime(date, '%Y-%m') DESC) <= 24")
GREEKS = ["delta", "gamma", "theta", "vega"]
add("agg17_greeks_history", lambda t: views.top_per_group(t.chain.filter("delta is not null").groupBy("act_symbol", "date").agg(*[F.avg(g).alias(f"avg_{g}") for g in GREEKS]), ["act_symbol"], [F.desc("date")], 10),
    "SELECT act_symbol, date, avg(delta) AS avg_delta, avg(gamma) AS avg_gamma, avg(theta) AS avg_theta, avg(vega) AS avg_vega FROM chain WHERE delta IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY date DESC) <= 10")
add("agg18_liquidity", lambda t: views.market_quality(t.chain, ["act_symbol"]).drop("avg_delta", "avg_gamma"), "SELECT act_symbol, count(*) AS n, count(*) FILTER (bid > 0 AND ask > 0) AS n_liquid, avg(vol) AS avg_vol, avg(ask - bid) AS avg_spread FROM chain GROUP BY 1")
add("agg19_latest_quote", lambda t: t.em.groupBy("underlying").agg(F.max("quote_ts").alias("quote_ts")), "SELECT underlying, max(quote_ts) AS quote_ts FROM em GROUP BY 1")
add("agg20_latest_date", lambda t: t.chain.filter("act_symbol = 'SYM7'").agg(F.max("date").alias("date")), "SELECT max(date) AS date FROM chain WHERE act_symbol = 'SYM7'")
add("agg21_duplicates", lambda t: views.duplicates(t.chain, KEY), "SELECT date, act_symbol, expiration, strike, call_put, count(*) AS n FROM chain GROUP BY ALL HAVING count(*) > 1")
add("agg22_partition_counts", lambda t: t.chain.groupBy("act_symbol", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count("*").alias("n")), "SELECT act_symbol, year(date) AS year, month(date) AS month, count(*) AS n FROM chain GROUP BY 1, 2, 3")
add("agg24_percentile_bands", lambda t: t.vol.filter("iv > 0 and iv < 10").groupBy("symbol").agg(F.percentile("iv", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("p")).select("symbol", *[F.round(C("p")[k], 9).alias(f"p{q}") for k, q in enumerate((10, 25, 50, 75, 90))]),
    "SELECT symbol, " + ", ".join(f"round(quantile_cont(iv, {q / 100}), 9) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM vol WHERE iv > 0 AND iv < 10 GROUP BY 1")
add("agg25_expiration_rollup", lambda t: views.expiration_rollup(t.latest_chain), "SELECT act_symbol, expiration, count(*) AS n_contracts, count(*) FILTER (call_put = 'C') AS n_calls, count(*) FILTER (call_put = 'P') AS n_puts, min(strike) AS min_strike, max(strike) AS max_strike, count(DISTINCT strike) AS n_strikes FROM latest_chain GROUP BY 1, 2")
add("agg26_strike_spacing", lambda t: views.strike_spacing(t.latest_chain), "SELECT act_symbol, min(strike) AS min_strike, max(strike) AS max_strike, count(DISTINCT strike) AS n_strikes, coalesce((max(strike) - min(strike)) / nullif(count(DISTINCT strike) - 1, 0), 0) AS avg_spacing FROM latest_chain GROUP BY 1")
add("agg27_type_counts", lambda t: t.latest_chain.agg(F.count_if(CALL()).alias("calls"), F.count_if(~CALL()).alias("puts")), "SELECT count(*) FILTER (call_put = 'C') AS calls, count(*) FILTER (call_put = 'P') AS puts FROM latest_chain")
add("agg28_iv_range", lambda t: t.vol.filter(C("date") >= F.date_sub(t.as_of, 252)).groupBy("symbol").agg(F.max("iv").alias("high"), F.min("iv").alias("low")), "SELECT symbol, max(iv) AS high, min(iv) AS low FROM vol, clock WHERE date >= d - 252 GROUP BY 1")
ZERO_VOLS = lambda t: t.chain.withColumn("vol", F.when(C("id") % 19 == 0, 0.0).otherwise(C("vol")))
add("agg29_mean_positive_iv", lambda t: ZERO_VOLS(t).groupBy("act_symbol").agg(F.coalesce(F.avg(F.when(C("vol") > 0, C("vol"))), F.lit(0.3)).alias("iv")),
    "WITH z AS (SELECT act_symbol, CASE WHEN id % 19 = 0 THEN 0e0 ELSE vol END AS vol FROM chain) SELECT act_symbol, coalesce(avg(CASE WHEN vol > 0 THEN vol END), 0.3e0) AS iv FROM z GROUP BY 1")
add("agg31_outcomes", lambda t: t.chain.agg(F.count_if(C("bid") > 0).alias("succeeded"), F.count_if(C("bid") == 0).alias("failed"), F.count("*").alias("total")), "SELECT count(*) FILTER (bid > 0) AS succeeded, count(*) FILTER (bid = 0) AS failed, count(*) AS total FROM chain")
add("agg32_hit_rate", lambda t: t.chain.groupBy("act_symbol").agg((F.coalesce(F.try_divide(F.count_if(C("bid") > 0).cast("double"), F.count("*")), F.lit(0.0)) * 100).alias("hit_rate")), "SELECT act_symbol, count(*) FILTER (bid > 0) / count(*) * 100 AS hit_rate FROM chain GROUP BY 1")
add("agg33_reconcile", lambda t: sinks.reconcile(t.em_a, t.em_b, ["underlying", "quote_ts"]), """SELECT underlying, quote_ts, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS written_rows, coalesce(a.n, 0) <> coalesce(b.n, 0) AS mismatch
    FROM (SELECT underlying, quote_ts, count(*) AS n FROM em_a GROUP BY 1, 2) a FULL JOIN (SELECT underlying, quote_ts, count(*) AS n FROM em_b GROUP BY 1, 2) b USING (underlying, quote_ts)""")

# windows and firsts
add("win01_deduplicate", lambda t: views.first_by_key(t.chain, KEY, [C("id")]).select("id"), "SELECT id FROM chain QUALIFY row_number() OVER (PARTITION BY date, act_symbol, expiration, strike, call_put ORDER BY id) = 1")
add("win02_latest_row", lambda t: views.first_by_key(t.em, ["underlying", "exp_date"], [F.desc("quote_ts")]).select(*EMKEY, "em_baseline"), "SELECT underlying, quote_ts, exp_date, horizon, em_baseline FROM em QUALIFY row_number() OVER (PARTITION BY underlying, exp_date ORDER BY quote_ts DESC) = 1")


def latest_iv(t):
    """The iv of a symbol's newest day, null or zero taken as 0.2."""
    newest = t.vol.filter(C("date") <= t.as_of).groupBy("symbol").agg(F.max_by(F.when(F.dayofmonth("date") < 30, C("iv")), "date").alias("iv"))
    return newest.withColumn("iv", F.when(C("iv").isNull() | (C("iv") == 0), 0.2).otherwise(C("iv")))


add("win03_as_of_iv", latest_iv, "SELECT symbol, coalesce(nullif(arg_max({'v': CASE WHEN day(date) < 30 THEN iv END}, date).v, 0), 0.2e0) AS iv FROM vol, clock WHERE date <= d GROUP BY 1")
add("win04_latest_stats", lambda t: views.first_by_key(t.vol, ["symbol"], [F.desc("date")]), "SELECT date, symbol, iv, hv, n FROM vol QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
add("win05_nearest_expiry", lambda t: t.chain.groupBy("act_symbol").agg(F.min("expiration").alias("expiration")), "SELECT act_symbol, min(expiration) AS expiration FROM chain GROUP BY 1")
EXPIRIES = lambda t: t.chain.filter(C("expiration").between(t.as_of, F.date_add(t.as_of, 120))).select("act_symbol", "expiration").distinct()
add("win06_upcoming_expiries", lambda t: views.top_per_group(EXPIRIES(t), ["act_symbol"], [C("expiration")], 3), "SELECT DISTINCT act_symbol, expiration FROM chain, clock WHERE expiration BETWEEN d AND d + 120 QUALIFY dense_rank() OVER (PARTITION BY act_symbol ORDER BY expiration) <= 3")
add("win07_atm_strike", lambda t: t.latest_chain.groupBy("act_symbol", "expiration").agg(F.min_by("strike", F.struct(F.abs(C("strike") - C("spot")), "strike")).alias("atm_strike")),
    "SELECT act_symbol, expiration, strike AS atm_strike FROM latest_chain QUALIFY row_number() OVER (PARTITION BY act_symbol, expiration ORDER BY abs(strike - spot), strike) = 1")
add("win08_first_contract", lambda t: views.first_by_key(t.chain, ["act_symbol", "expiration", "strike", "call_put"], [C("id")]).select("id", "bid"), "SELECT id, bid FROM chain QUALIFY row_number() OVER (PARTITION BY act_symbol, expiration, strike, call_put ORDER BY id) = 1")


def strike_window(t, each_side=2, compat=False):
    """Strikes around the first one at or above spot. With none above, the last ones (the first ones with compat)."""
    strikes = t.latest_chain.groupBy("act_symbol", "expiration", "strike").agg(F.max("spot").alias("spot"))
    group = Window.partitionBy("act_symbol", "expiration")
    ranked = strikes.withColumn("k", F.row_number().over(group.orderBy("strike"))).withColumn("n", F.count("*").over(group))
    centre = F.min(F.when(C("strike") >= C("spot"), C("k"))).over(group)
    ranked = ranked.withColumn("at", F.coalesce(centre, F.lit(0) if compat else C("n") + 1))
    return ranked.filter(C("k").between(C("at") - each_side, C("at") + each_side)).select("act_symbol", "expiration", "strike")


add("win09_strike_window", strike_window, """WITH s AS (SELECT act_symbol, expiration, strike, max(spot) AS spot, row_number() OVER (PARTITION BY act_symbol, expiration ORDER BY strike) AS k, count(*) OVER (PARTITION BY act_symbol, expiration) AS n FROM latest_chain GROUP BY 1, 2, 3),
    c AS (SELECT *, coalesce(min(CASE WHEN strike >= spot THEN k END) OVER (PARTITION BY act_symbol, expiration), n + 1) AS a FROM s) SELECT act_symbol, expiration, strike FROM c WHERE k BETWEEN a - 2 AND a + 2""")
add("win10_strike_gaps", lambda t: t.latest_chain.select("act_symbol", "strike").distinct().withColumn("gap", C("strike") - F.lag("strike").over(Window.partitionBy("act_symbol").orderBy("strike"))), "SELECT act_symbol, strike, strike - lag(strike) OVER (PARTITION BY act_symbol ORDER BY strike) AS gap FROM (SELECT DISTINCT act_symbol, strike FROM latest_chain)")
add("win13_last_events", lambda t: views.top_per_group(t.bars, ["sym"], [F.desc("e"), F.desc("event_id")], 20).select("sym", "event_id"), "SELECT sym, event_id FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY e DESC, event_id DESC) <= 20")


def year_range_rank(t):
    g = t.vol.groupBy("symbol").agg(F.max_by("iv", "date").alias("cur"), F.min("iv").alias("low"), F.max("iv").alias("high"))
    rank = F.when(C("high") > C("low"), (C("cur") - C("low")) / (C("high") - C("low")) * 100).otherwise(50.0)
    return g.select("symbol", F.floor(rank + 0.5).cast("long").alias("iv_rank"))


add("win14_range_rank", year_range_rank, """SELECT symbol, CAST(floor(CASE WHEN max(iv) > min(iv) THEN (arg_max(iv, date) - min(iv)) / (max(iv) - min(iv)) * 100 ELSE 50 END + 0.5e0) AS BIGINT) AS iv_rank FROM vol GROUP BY 1""")


def rolling_rank(t, rows=10):
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - rows, 0)
    out = t.vol.withColumns({"lo": F.min("iv").over(w), "hi": F.max("iv").over(w), "seen": F.collect_list("iv").over(w)})  # at most `rows` values
    return out.select("symbol", "date", (F.coalesce(F.try_divide(C("iv") - C("lo"), C("hi") - C("lo")), F.lit(0.5)) * 100).alias("iv_rank"), (F.size(F.filter("seen", lambda x: x <= C("iv"))) / F.size("seen") * 100).alias("iv_percentile"))


add("win15_rolling_rank", rolling_rank, """WITH w AS (SELECT symbol, date, iv, min(iv) OVER r AS lo, max(iv) OVER r AS hi, list(iv) OVER r AS seen FROM vol WINDOW r AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT symbol, date, coalesce((iv - lo) / nullif(hi - lo, 0), 0.5e0) * 100 AS iv_rank, len(list_filter(seen, lambda x: x <= iv)) / len(seen) * 100 AS iv_percentile FROM w""")


def as_of_vol(t):
    """Every third quote with the newest other quote of its symbol that has a vol, at most an hour old."""
    quotes = t.chain.select("id", "act_symbol", C("created_at").cast("timestamp").alias("at"), "vol")
    found = asof.asof_join(quotes.filter("id % 3 = 0"), quotes.filter("id % 3 <> 0 and vol is not null"), ["act_symbol"], "at", "at", "id", tolerance_us=3_600_000_000)
    return found.select("id", C("match.id").alias("from_id"), C("match.vol").alias("vol_then"))


add("win03b_as_of_join", as_of_vol, """WITH q AS (SELECT id, act_symbol, created_at AS tm, vol FROM chain), r AS (SELECT act_symbol, tm, max(id) AS id, arg_max(vol, id) AS vol FROM q WHERE id % 3 <> 0 AND vol IS NOT NULL GROUP BY 1, 2)
    SELECT l.id, CASE WHEN l.tm - r.tm <= INTERVAL 1 HOUR THEN r.id END AS from_id, CASE WHEN l.tm - r.tm <= INTERVAL 1 HOUR THEN r.vol END AS vol_then
    FROM (SELECT * FROM q WHERE id % 3 = 0) l ASOF LEFT JOIN r ON l.act_symbol = r.act_symbol AND l.tm >= r.tm""")


def realised_moves(t):
    """Every forecast with the spot of the first day from its expiration on, at most ten days later."""
    spots = t.chain.groupBy(C("act_symbol").alias("underlying"), F.date_add("date", 9).alias("day")).agg(F.avg("ask").alias("spot"))
    found = asof.asof_join(t.em.filter("dayofmonth(quote_ts) % 3 = 0"), spots.filter("dayofmonth(day) % 4 = 0"), ["underlying"], "exp_date", "day", "day", tolerance_us=10 * 86_400_000_000, forward=True)
    return found.select("underlying", "quote_ts", "exp_date", C("match.day").alias("day"), C("match.spot").alias("spot"))


add("emv14b_realised", realised_moves, """WITH s AS (SELECT act_symbol AS underlying, CAST(date + 9 AS DATE) AS day, avg(ask) AS spot FROM chain GROUP BY 1, 2 HAVING day(CAST(date + 9 AS DATE)) % 4 = 0)
    SELECT l.underlying, l.quote_ts, l.exp_date, CASE WHEN s.day - l.exp_date <= 10 THEN s.day END AS day, CASE WHEN s.day - l.exp_date <= 10 THEN s.spot END AS spot
    FROM (SELECT * FROM em WHERE day(quote_ts) % 3 = 0) l ASOF LEFT JOIN s ON l.underlying = s.underlying AND l.exp_date <= s.day""")


def order_series(t):
    """Years of days for five symbols."""
    value = (F.sum("o_orderkey") % 97).cast("double") / 64
    return t.read("orders").groupBy((C("o_custkey") % 5).alias("symbol"), C("o_orderdate").cast("date").alias("date")).agg(value.alias("iv"))


add("win15b_yearly_rank", lambda t: asof.rolling_rank(order_series(t), "symbol", "date", "iv", 252), """WITH s AS (SELECT o_custkey % 5 AS symbol, CAST(o_orderdate AS DATE) AS date, CAST(sum(o_orderkey) % 97 AS DOUBLE) / 64 AS iv FROM orders GROUP BY 1, 2),
    w AS (SELECT *, min(iv) OVER r AS lo, max(iv) OVER r AS hi, list(iv) OVER r AS seen FROM s WINDOW r AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT symbol, date, coalesce((iv - lo) / nullif(hi - lo, 0), 0.5e0) * 100 AS iv_rank, len(list_filter(seen, lambda x: x <= iv)) / len(seen) * 100 AS iv_percentile FROM w""")


def train_split(t, part=0.85):
    """In time order, the first part for training; ordered by a distributed count of what comes before."""
    order = [C(k) for k in ("quote_ts", "underlying", "exp_date")]
    per_day = t.em.groupBy("quote_ts").agg(F.count("*").alias("n"))
    total = per_day.agg(F.sum("n")).scalar()
    running = per_day.withColumn("before", F.sum("n").over(Window.orderBy("quote_ts")) - C("n"))  # a row a day
    place = F.row_number().over(Window.partitionBy("quote_ts").orderBy(*order[1:])) + C("before")
    rows = t.em.join(running.select("quote_ts", "before"), "quote_ts").withColumn("place", place)
    return rows.select("underlying", "quote_ts", "exp_date", (C("place") <= F.floor(total * part)).alias("training"))


add("win16_time_split", train_split, "SELECT underlying, quote_ts, exp_date, row_number() OVER (ORDER BY quote_ts, underlying, exp_date) <= floor(count(*) OVER () * 0.85e0) AS training FROM em")

# sets
add("set01_upsert", lambda t: sinks.keyed_union(t.em_a, t.em_b.withColumn("em_baseline", C("em_baseline") + 1), EMKEY).select(*EMKEY, "em_baseline"), "SELECT underlying, quote_ts, exp_date, horizon, em_baseline FROM em_a WHERE (underlying, quote_ts, exp_date, horizon) NOT IN (SELECT (underlying, quote_ts, exp_date, horizon) FROM em_b) UNION ALL SELECT underlying, quote_ts, exp_date, horizon, em_baseline + 1 FROM em_b")
add("set02_first_source", lambda t: merging.first_source_wins(t.em_a, t.em_b.withColumn("em_baseline", C("em_baseline") + 1), EMKEY).select(*EMKEY, "em_baseline"), "SELECT underlying, quote_ts, exp_date, horizon, em_baseline FROM em_a UNION ALL SELECT underlying, quote_ts, exp_date, horizon, em_baseline + 1 FROM em_b WHERE (underlying, quote_ts, exp_date, horizon) NOT IN (SELECT (underlying, quote_ts, exp_date, horizon) FROM em_a)")
add("set03_union_expiries", lambda t: t.em_a.select("exp_date").union(t.em_b.select("exp_date")).distinct().orderBy("exp_date").limit(50), "SELECT exp_date FROM em_a UNION SELECT exp_date FROM em_b ORDER BY 1 LIMIT 50")
add("set04_distinct_values", lambda t: t.chain.select("act_symbol", "date").distinct(), "SELECT DISTINCT act_symbol, date FROM chain")
add("set05_future_expirations", lambda t: t.chain.select("expiration").distinct().filter(C("expiration") > "2024-02-05").orderBy("expiration"), "SELECT DISTINCT expiration FROM chain WHERE expiration > DATE '2024-02-05'")
LIST = lambda t: t.chain.filter("act_symbol < 'SYM5'").groupBy("act_symbol").agg(F.count("*").alias("n"))
MORE = lambda t: t.chain.filter("act_symbol > 'SYM2'").groupBy("act_symbol").agg((-F.count("*")).alias("n"))
SQL_LISTS = "l AS (SELECT act_symbol, count(*) AS n FROM chain WHERE act_symbol < 'SYM5' GROUP BY 1), m AS (SELECT act_symbol, -count(*) AS n FROM chain WHERE act_symbol > 'SYM2' GROUP BY 1)"
add("set06_watchlist_add", lambda t: merging.add_absent(LIST(t), MORE(t), "act_symbol"), f"WITH {SQL_LISTS} SELECT * FROM l UNION ALL SELECT * FROM m WHERE act_symbol NOT IN (SELECT act_symbol FROM l)")
add("set06b_watchlist_toggle", lambda t: merging.toggle(LIST(t), MORE(t), "act_symbol"), f"WITH {SQL_LISTS} SELECT * FROM l WHERE act_symbol NOT IN (SELECT act_symbol FROM m) UNION ALL SELECT * FROM m WHERE act_symbol NOT IN (SELECT act_symbol FROM l)")
add("set06c_watchlist_update", lambda t: merging.update_fields(LIST(t), MORE(t), "act_symbol"), f"WITH {SQL_LISTS} SELECT l.act_symbol, coalesce(m.n, l.n) AS n FROM l LEFT JOIN m USING (act_symbol)")
add("set07_concatenate", lambda t: t.em_a.select(*EMKEY).union(t.em_b.select(*EMKEY)), "SELECT underlying, quote_ts, exp_date, horizon FROM em_a UNION ALL SELECT underlying, quote_ts, exp_date, horizon FROM em_b")

# orders
ID = ["id"]
top = lambda df, n, *order: df.orderBy(*order).limit(n)
FROM_EM = "SELECT underlying, quote_ts, exp_date, horizon FROM em ORDER BY {} LIMIT {}"
add("srt01_latest_forecasts", lambda t: top(t.em, 50, F.desc("quote_ts"), "exp_date", "underlying").select(*EMKEY), FROM_EM.format("quote_ts DESC, exp_date, underlying", 50))
add("srt02_all_horizons", lambda t: top(t.em, 1000, F.desc("quote_ts"), "horizon", "underlying", "exp_date").select(*EMKEY), FROM_EM.format("quote_ts DESC, horizon, underlying, exp_date", 1000))
add("srt03_series", lambda t: t.em.filter("underlying = 'SYM1'").orderBy("quote_ts", "exp_date").select(*EMKEY), "SELECT underlying, quote_ts, exp_date, horizon FROM em WHERE underlying = 'SYM1'")
add("srt04_expiries", lambda t: top(t.em.select("exp_date").distinct(), 50, "exp_date"), "SELECT DISTINCT exp_date FROM em ORDER BY 1 LIMIT 50")
add("srt05_newest_days", lambda t: top(t.vol.filter("symbol = 'SYM1'"), 10, F.desc("date")).select("date", "iv"), "SELECT date, iv FROM vol WHERE symbol = 'SYM1' ORDER BY date DESC LIMIT 10")
add("srt06_recent", lambda t: top(t.chain, 100, F.desc("date"), "act_symbol", "id").select("id"), "SELECT id FROM chain ORDER BY date DESC, act_symbol, id LIMIT 100")
add("srt07_chain_rows", lambda t: top(t.chain, 500, F.desc("date"), "strike", "id").select("id"), "SELECT id FROM chain ORDER BY date DESC, strike, id LIMIT 500")
add("srt08_strikes", lambda t: top(t.chain, 500, "expiration", "strike", "call_put", "id").select("id"), "SELECT id FROM chain ORDER BY expiration, strike, call_put, id LIMIT 500")
add("srt09_nearest_strikes", lambda t: top(t.chain, 30, F.abs(C("strike") - 100), "id").select("id"), "SELECT id FROM chain ORDER BY abs(strike - 100), id LIMIT 30")
add("srt10_most_options", lambda t: top(views.symbol_summary(t.chain), 4, F.desc("total_options"), "act_symbol").select("act_symbol", "total_options"), "SELECT act_symbol, count(*) AS total_options FROM chain WHERE vol IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
add("srt11_highest_iv", lambda t: top(views.symbol_summary(t.chain), 5, F.desc("avg_iv"), "act_symbol").select("act_symbol", "avg_iv"), "SELECT act_symbol, avg(vol) AS avg_iv FROM chain WHERE vol IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("srt12_clustered", lambda t: sinks.clustered(t.chain, ["date", "act_symbol", "strike"]).select("id", "date", "act_symbol"), "SELECT id, date, act_symbol FROM chain")
add("srt13_page", lambda t: t.chain.orderBy("date", "act_symbol", "strike", "id").offset(200).limit(100).select("id"), "SELECT id FROM chain ORDER BY date, act_symbol, strike, id LIMIT 100 OFFSET 200")
add("srt14_top_scores", lambda t: top(t.chain.groupBy("act_symbol").agg(F.max("ask").alias("score")), 3, F.desc("score"), F.desc("act_symbol")), "SELECT act_symbol, max(ask) AS score FROM chain GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 3")
add("srt15_sorted_strikes", lambda t: t.latest_chain.groupBy("act_symbol", "expiration").agg(F.array_join(F.array_sort(F.collect_set("strike")), ",").alias("strikes")), "SELECT act_symbol, expiration, array_to_string(list_sort(list(DISTINCT strike)), ',') AS strikes FROM latest_chain GROUP BY 1, 2")

# several horizons of a key
EM_ALL = "underlying, quote_ts, exp_date, horizon, em_baseline"
OLDER = lambda t: t.em_all.filter(C("quote_ts") <= F.date_sub(t.as_of, 2))
NEWER = lambda t: t.em_all.filter((C("quote_ts") >= F.date_sub(t.as_of, 2)) & (C("horizon") != "1d")).withColumn("em_baseline", C("em_baseline") + 1)
SQL_SIDES = "a AS (SELECT em_all.* FROM em_all, clock WHERE quote_ts <= d - 2), b AS (SELECT em_all.* REPLACE (em_baseline + 1 AS em_baseline) FROM em_all, clock WHERE quote_ts >= d - 2 AND horizon <> '1d')"
K4 = "(underlying, quote_ts, exp_date, horizon)"
add("set01b_upsert_horizons", lambda t: sinks.keyed_union(OLDER(t), NEWER(t), EMKEY).select(*EMKEY, "em_baseline"), f"WITH {SQL_SIDES} SELECT {EM_ALL} FROM a WHERE {K4} NOT IN (SELECT {K4} FROM b) UNION ALL SELECT {EM_ALL} FROM b")
add("set02b_first_source_horizons", lambda t: merging.first_source_wins(OLDER(t), NEWER(t), EMKEY).select(*EMKEY, "em_baseline"), f"WITH {SQL_SIDES} SELECT {EM_ALL} FROM a UNION ALL SELECT {EM_ALL} FROM b WHERE {K4} NOT IN (SELECT {K4} FROM a)")
add("win02b_latest_by_horizon", lambda t: views.first_by_key(t.em_all, ["underlying", "exp_date", "horizon"], [F.desc("quote_ts")]).select(*EMKEY, "em_baseline"), f"SELECT {EM_ALL} FROM em_all QUALIFY row_number() OVER (PARTITION BY underlying, exp_date, horizon ORDER BY quote_ts DESC) = 1")
add("srt02b_all_horizons", lambda t: top(t.em_all, 1000, F.desc("quote_ts"), "horizon", "underlying", "exp_date").select(*EMKEY), FROM_EM.replace(" em ", " em_all ").format("quote_ts DESC, horizon, underlying, exp_date", 1000))
add("srv06b_history_horizons", lambda t: top(t.em_all.filter((C("underlying") == "SYM4") & (C("quote_ts") >= F.date_sub(t.as_of, 10))), 1000, F.desc("quote_ts"), "horizon", "exp_date").select(*EMKEY, "em_baseline"),
    f"SELECT {EM_ALL} FROM em_all, clock WHERE underlying = 'SYM4' AND quote_ts >= d - 10 ORDER BY quote_ts DESC, horizon, exp_date LIMIT 1000")
PRED_ALL = lambda t: t.em_all.filter("horizon = '5d'").select(*EMKEY, *[(C(b) + 2).alias(b) if b != "band95_high" else F.lit(None).cast("double").alias(b) for b in BANDS])
add("jon04b_merge_horizons", lambda t: merging.merge_predictions(t.em_all, PRED_ALL(t), BANDS, exact_ts=True).select(*EMKEY, *BANDS), """SELECT e.underlying, e.quote_ts, e.exp_date, e.horizon, CASE WHEN horizon = '5d' THEN band68_low + 2 ELSE band68_low END AS band68_low,
    CASE WHEN horizon = '5d' THEN band68_high + 2 ELSE band68_high END AS band68_high, CASE WHEN horizon = '5d' THEN band95_low + 2 ELSE band95_low END AS band95_low, band95_high FROM em_all e""")

# at the sizes that the application asks for
DEEP = lambda t: t.chain.filter("delta is not null").groupBy("act_symbol", "date").agg(*[F.avg(g).alias(f"avg_{g}") for g in GREEKS])
add("agg17b_greeks_history", lambda t: views.top_per_group(DEEP(t), ["act_symbol"], [F.desc("date")], 100),
    "SELECT act_symbol, date, avg(delta) AS avg_delta, avg(gamma) AS avg_gamma, avg(theta) AS avg_theta, avg(vega) AS avg_vega FROM chain WHERE delta IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY act_symbol ORDER BY date DESC) <= 100")
add("win09b_strike_window", lambda t: strike_window(t, 5), """WITH s AS (SELECT act_symbol, expiration, strike, max(spot) AS spot, row_number() OVER (PARTITION BY act_symbol, expiration ORDER BY strike) AS k, count(*) OVER (PARTITION BY act_symbol, expiration) AS n FROM latest_chain GROUP BY 1, 2, 3),
    c AS (SELECT *, coalesce(min(CASE WHEN strike >= spot THEN k END) OVER (PARTITION BY act_symbol, expiration), n + 1) AS a FROM s) SELECT act_symbol, expiration, strike FROM c WHERE k BETWEEN a - 5 AND a + 5""")
