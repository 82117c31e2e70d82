"""Sources, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.functions import expressions as X
from strikeline.operators import views
from strikeline.plans.registry import add
from strikeline.sources import readers, sinks

C = F.col
KEY = ["date", "act_symbol", "expiration", "strike", "call_put"]

add("src01_option_chain", lambda t: readers.conform(t.chain.withColumns({"year": F.year("date"), "month": F.month("date")}), readers.CHAIN, {"year": "partition_year", "month": "partition_month"}).drop("created_at"),
    "SELECT id, date, act_symbol, expiration, strike, call_put, bid, ask, vol, delta, gamma, theta, vega, open_interest, volume, year(date) AS partition_year, month(date) AS partition_month FROM chain")
add("src02_volatility_history", lambda t: t.vol.select("date", "symbol", "iv", "hv", F.year("date").alias("partition_year")), "SELECT date, symbol, iv, hv, year(date) AS partition_year FROM vol")
add("src03_forecast_table", lambda t: t.em, "SELECT * FROM em")


def _bound_view(t):
    t.em.createOrReplaceTempView("em_forecasts")
    return t.spark.sql("SELECT underlying, exp_date, em_baseline FROM em_forecasts WHERE horizon = :h", args={"h": "to_exp"})


add("src04_forecast_view", _bound_view, "SELECT underlying, exp_date, em_baseline FROM em WHERE horizon = 'to_exp'")
add("src15_quote", lambda t: readers.quote_from_bar(t.bars.select(C("sym").alias("symbol"), (C("o") / 2).alias("o"), "c", "v")),
    "SELECT sym AS symbol, c AS price, c - o / 2 AS change, (c - o / 2) / CASE WHEN o = 0 THEN 1e0 ELSE o / 2 END * 100 AS change_percent, v AS volume FROM bars")
add("src16_quote_defaults", lambda t: t.chain.select("id", F.coalesce("vol", F.lit(0.0)).alias("vol"), F.coalesce("bid", F.lit(0.0)).alias("bid")), "SELECT id, coalesce(vol, 0e0) AS vol, coalesce(bid, 0e0) AS bid FROM chain")
add("src22_symbols", lambda t: readers.symbols_from_partitions(t.chain, "act_symbol"), "SELECT DISTINCT act_symbol FROM chain ORDER BY 1 LIMIT 5")
add("snk04_narrow", lambda t: sinks.narrow(t.chain.select("id", "strike", "vol", "volume")).select(C("id").cast("long").alias("id"), C("strike").cast("double").alias("strike"), C("vol").cast("double").alias("vol"), C("volume").cast("long").alias("volume")),
    "SELECT id, strike, vol, volume FROM chain")
add("snk07_clean_quotes", lambda t: sinks.clean_quotes(t.chain),
    """SELECT date AS quote_ts, expiration AS exp_date, call_put AS callput, strike, (bid + ask) / 2 AS contract_price, bid, ask, delta, gamma, theta, vega, vol AS iv, volume, open_interest,
       expiration - date AS dte, act_symbol AS underlying, year(date) AS quote_year, month(date) AS quote_month FROM chain WHERE bid > 0 AND ask > bid AND vol > 0""")

# projections
add("prj01_cast_rename", lambda t: readers.conform(t.chain.select(*[C(c).cast("string").alias(str(k)) for k, c in enumerate(readers.CHAIN.names[:-1])]), readers.CHAIN).drop("created_at"),
    "SELECT id, date, act_symbol, expiration, strike, call_put, bid, ask, vol, delta, gamma, theta, vega, open_interest, volume FROM chain")
add("prj02_mid", lambda t: t.chain.select("id", X.mid(C("bid"), C("ask")).alias("mid")), "SELECT id, (bid + ask) / 2 AS mid FROM chain")
add("prj03_mid_or_last", lambda t: t.chain.select("id", X.mid_or_last(C("bid"), C("ask"), C("vega")).alias("mid")), "SELECT id, CASE WHEN bid <> 0 AND ask <> 0 THEN (bid + ask) / 2 ELSE coalesce(vega, 0) END AS mid FROM chain")
add("prj04_dte", lambda t: t.chain.select("id", X.days_between(C("date"), C("expiration")).alias("dte")), "SELECT id, expiration - date AS dte FROM chain")
add("prj05_days_ahead", lambda t: t.chain.select("id", X.days_ahead(C("expiration"), F.lit("2024-02-08 10:00:00").cast("timestamp"), 1).alias("dte")),
    "SELECT id, CAST(greatest(1, ceil((epoch(CAST(expiration AS TIMESTAMP)) - epoch(TIMESTAMP '2024-02-08 10:00:00')) / 86400)) AS INTEGER) AS dte FROM chain")
add("prj06_spread", lambda t: t.chain.select("id", (C("ask") - C("bid")).alias("spread"), X.spread_percent(C("bid"), C("ask"), X.mid(C("bid"), C("ask"))).alias("spread_percent")),
    "SELECT id, ask - bid AS spread, CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) * 100 ELSE 0 END AS spread_percent FROM chain")
IS_CALL = lambda: C("call_put") == "C"
INTRINSIC = lambda: X.intrinsic_value(IS_CALL(), C("spot"), C("strike"))
add("prj07_intrinsic_time", lambda t: t.chain.select("id", INTRINSIC().alias("intrinsic"), X.time_value(C("ask"), INTRINSIC()).alias("time_value")),
    "WITH v AS (SELECT id, ask, greatest(0, CASE WHEN call_put = 'C' THEN spot - strike ELSE strike - spot END) AS intrinsic FROM chain) SELECT id, intrinsic, greatest(0, ask - intrinsic) AS time_value FROM v")
add("prj08_in_the_money", lambda t: t.chain.select("id", X.in_the_money(IS_CALL(), C("spot"), C("strike")).alias("itm")), "SELECT id, CASE WHEN call_put = 'C' THEN spot > strike ELSE spot < strike END AS itm FROM chain")
add("prj09_moneyness", lambda t: t.chain.select("id", X.moneyness(IS_CALL(), C("spot"), C("strike")).alias("moneyness")),
    "SELECT id, CASE WHEN abs(spot - strike) / spot * 100 < 2 THEN 'ATM' WHEN (call_put = 'C' AND spot > strike) OR (call_put = 'P' AND spot < strike) THEN 'ITM' ELSE 'OTM' END AS moneyness FROM chain")
add("prj10_distance", lambda t: t.chain.select("id", F.abs(C("spot") - C("strike")).alias("distance"), (F.abs(C("spot") - C("strike")) / C("spot") * 100).alias("distance_percent")),
    "SELECT id, abs(spot - strike) AS distance, abs(spot - strike) / spot * 100 AS distance_percent FROM chain")
SPREAD = lambda: X.spread_percent(C("bid"), C("ask"), X.mid(C("bid"), C("ask")))
add("prj11_liquidity", lambda t: t.chain.select("id", X.liquidity_score(C("volume"), C("open_interest"), SPREAD()).alias("score")),
    """SELECT id, least(100e0, volume * 0.3e0 + least(open_interest / 100, 50e0) * 0.5e0 + greatest(0e0, 50 - (CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) * 100 ELSE 0e0 END) * 10) * 0.2e0) AS score FROM chain""")
DTE = lambda: X.days_between(C("date"), C("expiration"))
MONEY = lambda: X.moneyness(IS_CALL(), C("spot"), C("strike"))
add("prj12_risk_levels", lambda t: t.chain.select("id", X.risk_level(DTE()).alias("risk"), X.time_decay_risk(DTE()).alias("decay"), X.profit_potential(MONEY(), DTE()).alias("profit")),
    """WITH v AS (SELECT id, expiration - date AS dte, CASE WHEN abs(spot - strike) / spot * 100 < 2 THEN 'ATM' WHEN (call_put = 'C' AND spot > strike) OR (call_put = 'P' AND spot < strike) THEN 'ITM' ELSE 'OTM' END AS m FROM chain)
       SELECT id, CASE WHEN dte > 30 THEN 'Low' WHEN dte > 7 THEN 'Medium' ELSE 'High' END AS risk, CASE WHEN dte > 45 THEN 'Low' WHEN dte > 14 THEN 'Medium' ELSE 'High' END AS decay,
              CASE WHEN m = 'OTM' AND dte < 7 THEN 'Low' WHEN m = 'ATM' THEN 'High' ELSE 'Medium' END AS profit FROM v""")
add("prj13_range", lambda t: t.chain.select("id", X.band(C("spot"), C("ask")).alias("b")).select("id", "b.*"), "SELECT id, ask AS move, ask / spot * 100 AS percentage, spot - ask AS lower, spot + ask AS upper FROM chain")
add("prj14_defaults", lambda t: t.chain.select("id", F.coalesce(F.nanvl("vol", F.lit(0.0)), F.lit(0.0)).alias("vol")), "SELECT id, coalesce(vol, 0e0) AS vol FROM chain")
add("prj15_upper", lambda t: t.chain.select("id", F.upper(F.lower("act_symbol")).alias("symbol")), "SELECT id, upper(lower(act_symbol)) AS symbol FROM chain")
WINDOW_TEXT = lambda: F.element_at(F.array(*map(F.lit, ("30d", " 7D ", "0d", "x", "-4", "120"))), (C("id") % 6 + 1).cast("int"))
add("prj16_window_days", lambda t: t.chain.select("id", X.window_days(WINDOW_TEXT()).alias("days")), "SELECT id, [30, 7, 1, 90, 1, 120][CAST(id % 6 + 1 AS INTEGER)] AS days FROM chain")
add("prj17_money_text", lambda t: t.chain.select("id", X.signed_money(C("spot"), C("strike") / 2).alias("label")), "SELECT id, printf('±$%.2f (%.1f%%)', spot, strike / 2) AS label FROM chain")
add("prj18_keys", lambda t: t.chain.select("id", X.cache_key(F.lit("em_forecast"), C("act_symbol"), X.horizons_key(F.array(F.lit("to_exp"), F.lit("1d"), F.lit("5d")))).alias("key")),
    "SELECT id, 'em_forecast:' || act_symbol || ':1d:5d:to_exp' AS key FROM chain")
add("prj19_date_key", lambda t: t.chain.select("id", X.date_key(C("date")).alias("key")), "SELECT id, strftime(date, '%Y%m%d') AS key FROM chain")
HORIZON = lambda: F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly"))), (C("id") % 3 + 1).cast("int"))
add("prj20_bar_width", lambda t: t.chain.select("id", X.bar_width(C("theta") * 8, HORIZON()).alias("width")), "SELECT id, least(abs(theta * 8) / [5e0, 15e0, 25e0][CAST(id % 3 + 1 AS INTEGER)] * 100, 100) AS width FROM chain")

# filters
ALL = "id, date, act_symbol, strike"
pick = lambda df: df.select("id", "date", "act_symbol", "strike")
EM = ["underlying", "quote_ts", "exp_date", "em_baseline"]
add("flt01_equality", lambda t: t.em.filter((C("underlying") == "SYM3") & (C("exp_date") == F.lit("2024-02-09").cast("date")) & (C("horizon") == "to_exp")).select(*EM),
    "SELECT underlying, quote_ts, exp_date, em_baseline FROM em WHERE underlying = 'SYM3' AND exp_date = DATE '2024-02-09' AND horizon = 'to_exp'")
add("flt02_membership", lambda t: t.em.filter(C("underlying").isin("SYM1", "SYM4") & C("horizon").isin("to_exp", "1d")).orderBy(F.desc("quote_ts"), "exp_date", "underlying").limit(200).select(*EM),
    "SELECT underlying, quote_ts, exp_date, em_baseline FROM em WHERE underlying IN ('SYM1', 'SYM4') AND horizon IN ('to_exp', '1d') ORDER BY quote_ts DESC, exp_date, underlying LIMIT 200")
add("flt03_relative_time", lambda t: t.em.filter(C("quote_ts").cast("timestamp") >= t.as_of.cast("timestamp") - F.make_interval(days=F.lit(7))).select(*EM), "SELECT underlying, quote_ts, exp_date, em_baseline FROM em, clock WHERE quote_ts >= d - 7")
add("flt04_forward_range", lambda t: t.em.filter(C("exp_date").between(t.as_of, F.date_add(t.as_of, 14))).select(*EM), "SELECT underlying, quote_ts, exp_date, em_baseline FROM em, clock WHERE exp_date BETWEEN d AND d + 14")
add("flt05_trailing_range", lambda t: pick(t.chain.filter(C("date") >= F.date_sub(t.as_of, 10))), f"SELECT {ALL} FROM chain, clock WHERE date >= d - 10")
add("flt06_year_bucket", lambda t: pick(t.chain.filter((C("date") < F.date_sub(t.as_of, 10)) & (C("date") >= F.date_sub(t.as_of, 20)))), f"SELECT {ALL} FROM chain, clock WHERE date < d - 10 AND date >= d - 20")
add("flt07_month_range", lambda t: pick(readers.date_between(t.chain.withColumns({"partition_year": F.year("date"), "partition_month": F.month("date")}), "2024-01-05", "2024-01-20")), f"SELECT {ALL} FROM chain WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
add("flt08_extract", lambda t: pick(t.chain.filter((F.year("date") == 2024) & (F.month("date") == 1) & (F.dayofmonth("date") == 9))), f"SELECT {ALL} FROM chain WHERE year(date) = 2024 AND month(date) = 1 AND day(date) = 9")
add("flt09_quality", lambda t: pick(t.chain.filter("bid > 0 and ask > bid and vol > 0")), f"SELECT {ALL} FROM chain WHERE bid > 0 AND ask > bid AND vol > 0")
add("flt10_has_vol", lambda t: pick(t.chain.filter("vol is not null and vol > 0")), f"SELECT {ALL} FROM chain WHERE vol > 0")
add("flt11_two_sided", lambda t: pick(t.chain.filter("bid > 0 and ask > 0")), f"SELECT {ALL} FROM chain WHERE bid > 0 AND ask > 0")
# Expirations of the chain are Fridays; here some fall on the days after.
STRAYING = lambda t: t.chain.withColumn("expiration", F.date_add("expiration", (C("id") % 3).cast("int")))
add("flt12_friday", lambda t: pick(STRAYING(t).filter(F.dayofweek("expiration") == 6)), f"SELECT {ALL} FROM chain WHERE dayofweek(expiration + CAST(id % 3 AS INTEGER)) = 5")
add("flt13_monthly", lambda t: pick(t.chain.filter(F.dayofmonth("expiration").between(15, 21))), f"SELECT {ALL} FROM chain WHERE day(expiration) BETWEEN 15 AND 21")
add("flt14_iv_outliers", lambda t: t.vol.filter((C("iv") > 0) & (C("iv") < 10)).select("date", "symbol", "iv"), "SELECT date, symbol, iv FROM vol WHERE iv > 0 AND iv < 10")


add("flt15_recent", lambda t: pick(views.recent(t.chain, 7)), f"SELECT {ALL} FROM chain WHERE date >= (SELECT max(date) FROM chain) - 7")
add("flt16_latest_date", lambda t: pick(views.latest(t.chain, "SYM3")),
    f"SELECT {ALL} FROM chain WHERE act_symbol = 'SYM3' AND date = (SELECT max(date) FROM chain WHERE act_symbol = 'SYM3')")
add("flt17_latest_rows", lambda t: t.em.join(t.em.groupBy("underlying").agg(F.max("quote_ts").alias("quote_ts")), ["underlying", "quote_ts"], "left_semi").select(*EM),
    "SELECT underlying, quote_ts, exp_date, em_baseline FROM em WHERE (underlying, quote_ts) IN (SELECT (underlying, max(quote_ts)) FROM em GROUP BY underlying)")
add("flt18_prefix", lambda t: pick(t.chain.filter(F.lower("call_put").startswith("c"))), f"SELECT {ALL} FROM chain WHERE starts_with(lower(call_put), 'c')")
add("flt19_ticker_format", lambda t: t.bars.filter(C("sym").startswith("O:") & C("sym").endswith("B")).select("event_id", "sym"), "SELECT event_id, sym FROM bars WHERE sym LIKE 'O:%B'")
PAIR = ["act_symbol", "expiration", "strike"]
add("flt20_complete_strikes", lambda t: t.latest_chain.groupBy(*PAIR).agg(F.count_if(IS_CALL()).alias("calls"), F.count_if(~IS_CALL()).alias("puts")).filter("calls > 0 and puts > 0").select(*PAIR),
    "SELECT act_symbol, expiration, strike FROM latest_chain GROUP BY ALL HAVING count(DISTINCT call_put) = 2")


def optional_filters(df, **wanted):
    """Filters only for the arguments that are given."""
    for name, value in wanted.items():
        df = df if value is None else df.filter(C(name) == value)
    return df


add("flt21_optional", lambda t: pick(optional_filters(t.chain, act_symbol="SYM2", expiration=None, call_put="P")), f"SELECT {ALL} FROM chain WHERE act_symbol = 'SYM2' AND call_put = 'P'")
