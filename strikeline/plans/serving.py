"""Serving queries, validation, and the batch form of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.operators import merging, quality, views
from strikeline.plans.registry import add
from strikeline.streaming import feed

C = F.col
EM = ["underlying", "quote_ts", "exp_date", "horizon", "em_baseline"]
SQL_EM = "underlying, quote_ts, exp_date, horizon, em_baseline"


def latest_forecasts(em, symbol, horizons, as_of, days=1, limit=50):
    rows = em.filter((C("underlying") == symbol) & C("horizon").isin(*horizons) & (C("quote_ts") >= F.date_sub(as_of, days)))
    return rows.orderBy(F.desc("quote_ts"), "exp_date").limit(limit)


def newest_forecast(em, symbol, expiration):
    rows = em.filter((C("underlying") == symbol) & (C("exp_date") == F.lit(expiration).cast("date")) & (C("horizon") == "to_exp"))
    return rows.orderBy(F.desc("quote_ts")).limit(1)


def forecast_series(em, symbol, expiration, as_of, days):
    rows = em.filter((C("underlying") == symbol) & (C("exp_date") == F.lit(expiration).cast("date")) & (C("horizon") == "to_exp"))
    return rows.filter(C("quote_ts") >= F.date_sub(as_of, days)).orderBy("quote_ts")


def upcoming_expiries(em, symbol, as_of, days, limit=50):
    rows = em.filter((C("underlying") == symbol) & C("exp_date").between(as_of, F.date_add(as_of, days)))
    return rows.select("exp_date").distinct().orderBy("exp_date").limit(limit)


both = lambda t: merging.first_source_wins(t.em_a, t.em_b, ["underlying", "quote_ts", "exp_date", "horizon"])
add("srv01_latest_forecasts", lambda t: latest_forecasts(t.em, "SYM3", ["to_exp", "1d"], t.as_of).select(*EM), f"SELECT {SQL_EM} FROM em, clock WHERE underlying = 'SYM3' AND horizon IN ('to_exp', '1d') AND quote_ts >= d - 1 ORDER BY quote_ts DESC, exp_date LIMIT 50")
add("srv01b_hybrid_forecasts", lambda t: latest_forecasts(both(t), "SYM3", ["to_exp"], t.as_of, 5).select(*EM), f"SELECT {SQL_EM} FROM em, clock WHERE underlying = 'SYM3' AND quote_ts >= d - 5 ORDER BY quote_ts DESC, exp_date LIMIT 50")
add("srv02_newest_forecast", lambda t: newest_forecast(t.em, "SYM3", "2024-02-09").select(*EM), f"SELECT {SQL_EM} FROM em WHERE underlying = 'SYM3' AND exp_date = DATE '2024-02-09' ORDER BY quote_ts DESC LIMIT 1")
add("srv03_forecast_series", lambda t: forecast_series(t.em, "SYM3", "2024-02-09", t.as_of, 14).select(*EM), f"SELECT {SQL_EM} FROM em, clock WHERE underlying = 'SYM3' AND exp_date = DATE '2024-02-09' AND quote_ts >= d - 14")
add("srv04_expiries", lambda t: upcoming_expiries(t.em, "SYM3", t.as_of, 15), "SELECT DISTINCT exp_date FROM em, clock WHERE underlying = 'SYM3' AND exp_date BETWEEN d AND d + 15 ORDER BY 1 LIMIT 50")
add("srv05_symbols", lambda t: t.em.filter(C("quote_ts") >= F.date_sub(t.as_of, 7)).groupBy("underlying").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "underlying").limit(100), "SELECT underlying, count(*) AS n FROM em, clock WHERE quote_ts >= d - 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
add("srv06_symbol_history", lambda t: t.em.filter((C("underlying") == "SYM4") & (C("quote_ts") >= F.date_sub(t.as_of, 10))).orderBy(F.desc("quote_ts"), "horizon", "exp_date").limit(1000).select(*EM), f"SELECT {SQL_EM} FROM em, clock WHERE underlying = 'SYM4' AND quote_ts >= d - 10 ORDER BY quote_ts DESC, horizon, exp_date LIMIT 1000")
add("srv07_iv_summary", lambda t: views.daily_iv_summary(t.chain.filter((C("act_symbol") == "SYM2") & (C("date") >= F.date_sub(t.as_of, 12)))).orderBy(F.desc("date")).limit(100), "SELECT date, act_symbol, avg(vol) AS avg_iv, median(vol) AS median_iv, count(*) AS n_options FROM chain, clock WHERE vol IS NOT NULL AND act_symbol = 'SYM2' AND date >= d - 12 GROUP BY 1, 2")
add("srv08_recent_options", lambda t: views.recent(t.chain, 30).filter("act_symbol = 'SYM2'").orderBy(F.desc("date"), "act_symbol", "id").limit(1000).select("id", "date", "strike", "bid", "ask", "vol"), "SELECT id, date, strike, bid, ask, vol FROM chain WHERE act_symbol = 'SYM2' AND date >= (SELECT max(date) FROM chain) - 30 ORDER BY date DESC, act_symbol, id LIMIT 1000")
add("srv10_historical_chain", lambda t: t.chain.filter((C("act_symbol") == "SYM6") & (C("date") >= F.date_sub(t.as_of, 365))).orderBy(F.desc("date"), "strike", "id").limit(1000).select("id"), "SELECT id FROM chain, clock WHERE act_symbol = 'SYM6' AND date >= d - 365 ORDER BY date DESC, strike, id LIMIT 1000")
add("srv11_expirations", lambda t: t.chain.filter((C("act_symbol") == "SYM6") & (C("date") >= F.date_sub(t.as_of, 365)) & (C("expiration") >= t.as_of)).select("expiration").distinct().orderBy("expiration").limit(50), "SELECT DISTINCT expiration FROM chain, clock WHERE act_symbol = 'SYM6' AND date >= d - 365 AND expiration >= d")
add("srv12_available_dates", lambda t: t.chain.filter("act_symbol = 'SYM6'").select("date").distinct().orderBy(F.desc("date")).limit(20), "SELECT DISTINCT date FROM chain WHERE act_symbol = 'SYM6' ORDER BY 1 DESC LIMIT 20")
add("srv13_available_symbols", lambda t: views.symbol_summary(t.chain).orderBy(F.desc("total_options"), "act_symbol").limit(5).select("act_symbol"), "SELECT act_symbol FROM chain WHERE vol IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5")


def iv_history(em, symbol, as_of, days):
    """The series of the first upcoming expiration, null baselines as 0; no rows without one."""
    first = upcoming_expiries(em, symbol, as_of, 120, 1)
    rows = em.filter((C("underlying") == symbol) & (C("horizon") == "to_exp") & (C("quote_ts") >= F.date_sub(as_of, days))).join(F.broadcast(first), "exp_date")
    return rows.select("quote_ts", F.coalesce("em_baseline", F.lit(0.0)).alias("iv"))


add("srv14_iv_history", lambda t: iv_history(t.em, "SYM3", t.as_of, 20), "SELECT quote_ts, coalesce(em_baseline, 0) AS iv FROM em, clock WHERE underlying = 'SYM3' AND quote_ts >= d - 20 AND exp_date = (SELECT min(exp_date) FROM em, clock WHERE underlying = 'SYM3' AND exp_date BETWEEN d AND d + 120)")
SCORES = lambda t: t.chain.select(C("date").alias("day"), C("act_symbol").alias("symbol"), C("id").alias("ts"), (C("ask") * 2).alias("score"))
MOVERS = "WITH s AS (SELECT date AS day, act_symbol AS symbol, arg_max(ask * 2, id) AS score FROM chain WHERE ask * 2 > 5 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol DESC) AS place FROM s QUALIFY place <= 3"
add("srv15_top_movers", lambda t: feed.top_movers(SCORES(t), 3).filter(C("day") == "2024-01-15"), f"SELECT * FROM ({MOVERS.replace('WITH s AS', 'WITH s AS')}) WHERE day = DATE '2024-01-15'")
add("srv16_iv_defaults", lambda t: t.vol.filter("symbol = 'SYM3'").select("date", F.coalesce(F.when(C("hv") > 0.3, C("iv")), F.lit(25.0)).alias("iv")), "SELECT date, coalesce(CASE WHEN hv > 0.3 THEN iv END, 25e0) AS iv FROM vol WHERE symbol = 'SYM3'")

def limits_sql(requests: str, most: int, window_ms: int) -> str:
    """The rule of fixed windows, request by request."""
    return f"""WITH RECURSIVE asked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, id) AS place FROM ({requests})),
    steps AS (SELECT key, id, ms, place, 1 AS used, ms + {window_ms} AS until, true AS allowed FROM asked WHERE place = 1
        UNION ALL SELECT a.key, a.id, a.ms, a.place, CASE WHEN a.ms > s.until THEN 1 ELSE least(s.used + 1, {most}) END,
            CASE WHEN a.ms > s.until THEN a.ms + {window_ms} ELSE s.until END, a.ms > s.until OR s.used < {most}
        FROM steps s JOIN asked a ON a.key = s.key AND a.place = s.place + 1)
    SELECT key, id, ms, allowed FROM steps"""


# streams, over a table
BARS = lambda t: t.bars.select("event_id", F.lit("AM").alias("ev"), "sym", "o", "h", "l", "c", "v", F.lit(None).cast("double").alias("vw"), "s", "e")
add("str03_minute_bars", lambda t: feed.minute_bars(BARS(t)).select("sym", "open", "close", "volume", "duration_ms", F.unix_millis("window_end").alias("end_ms")), "SELECT sym, o AS open, c AS close, v AS volume, e - s AS duration_ms, e AS end_ms FROM bars")
FRAME = lambda: F.when(C("event_id") % 11 == 0, "{bad").when(C("event_id") % 3 == 0, F.to_json(F.array(F.struct("ev", "sym", "c"), F.struct(F.lit("status").alias("ev"), "sym", "c")))).otherwise(F.to_json(F.struct("ev", "sym", "c")))
add("str01_parse_frames", lambda t: feed.parse_frames(BARS(t).select(FRAME().alias("value"))).groupBy("ev").agg(F.count("*").alias("n")),
    "SELECT 'AM' AS ev, count(*) AS n FROM bars WHERE event_id % 11 <> 0 UNION ALL SELECT 'status', count(*) FROM bars WHERE event_id % 11 <> 0 AND event_id % 3 = 0")
add("str02_statuses", lambda t: feed.parse_frames(BARS(t).select(FRAME().alias("value"))).filter("ev = 'AM'").select("sym", "c"), "SELECT sym, c FROM bars WHERE event_id % 11 <> 0")
SUBS = lambda t: t.bars.select("sym").distinct().filter(C("sym") < "O:SYMH")
add("str04_subscriptions", lambda t: feed.activity(feed.subscribed(feed.minute_bars(BARS(t)), SUBS(t))).select("sym", "messages", F.unix_millis("last_update").alias("last_ms")), "SELECT sym, count(*) AS messages, max(e) AS last_ms FROM bars WHERE sym < 'O:SYMH' GROUP BY 1")
LIMITED = lambda t: feed.limit_requests(t.read("events").select((C("user_id") % 50).cast("string").alias("key"), C("event_id").alias("id"), F.unix_millis(C("ts").cast("timestamp")).alias("ms")), 2, 21_600_000)
add("str07_rate_limit", LIMITED, limits_sql("SELECT CAST(user_id % 50 AS VARCHAR) AS key, event_id AS id, epoch_us(ts) // 1000 AS ms FROM events", 2, 21_600_000))
add("str08_daily_counts", lambda t: feed.daily_counts(t.read("events").select(C("ts").cast("timestamp").alias("ts")), "ts"), "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
add("str09_daily_movers", lambda t: feed.top_movers(SCORES(t), 3), MOVERS)
add("str12_hourly_ohlc", lambda t: feed.rolled_up(feed.minute_bars(BARS(t)), "1 hour").select("sym", F.unix_millis("start").alias("start_ms"), "high", "low", "volume", "n"),
    "SELECT sym, e - e % 3600000 AS start_ms, max(h) AS high, min(l) AS low, CAST(sum(v) AS BIGINT) AS volume, count(*) AS n FROM bars GROUP BY 1, 2")

# validation
JOINED = lambda df: df.select("id", F.array_join("errors", "; ").alias("errors"), "valid")
_sql = lambda *rules: "concat_ws('; ', " + ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{m}' END" for m, ok in rules) + ")"
_both = lambda e, rest="FROM chain": f"SELECT id, {e} AS errors, {e} = '' AS valid {rest}"
NAME = lambda: F.when(C("id") % 5 == 0, F.concat("act_symbol", F.lit("$"))).when(C("id") % 7 == 0, F.repeat("act_symbol", 4)).otherwise(C("act_symbol"))
SQL_NAME = "CASE WHEN id % 5 = 0 THEN act_symbol || '$' WHEN id % 7 = 0 THEN repeat(act_symbol, 4) ELSE act_symbol END"
add("val01_symbols", lambda t: JOINED(quality.validated(t.chain, *quality.symbol_rules(NAME()))), _both(_sql(("symbol: must have 1 to 10 characters", f"length({SQL_NAME}) BETWEEN 1 AND 10"), ("symbol: may have letters, digits, dots and hyphens only", f"regexp_matches({SQL_NAME}, '^[A-Za-z0-9.-]+$')"))))
DAY = lambda: F.when(C("id") % 5 == 0, "soon").otherwise(C("expiration").cast("string"))
add("val02_expiries", lambda t: JOINED(quality.validated(t.chain, *quality.expiry_rules(DAY(), F.lit("2024-02-10").cast("date")))),
    _both(_sql(("expiry: must be in YYYY-MM-DD format", "id % 5 <> 0"), ("expiry: must be in the future", "CASE WHEN id % 5 <> 0 THEN expiration > DATE '2024-02-10' END"))))
add("val03_quotes", lambda t: JOINED(quality.validated(t.chain, *quality.quote_rules(C("strike"), C("delta"), C("bid") - 2, C("ask"), C("vol") - 0.25, C("volume"), C("open_interest") - 5))),
    _both(_sql(("strike: must be positive", "strike > 0"), ("mid: cannot be negative", "delta >= 0"), ("bid: cannot be negative", "bid - 2 >= 0"), ("ask: cannot be negative", "ask >= 0"), ("iv: must be positive", "vol IS NULL OR vol - 0.25 > 0"), ("volume: cannot be negative", "volume >= 0"), ("openInterest: cannot be negative", "open_interest - 5 >= 0"))))
SIDE = lambda s: F.collect_list(F.when(C("call_put") == s, C("strike")))


def _chains(t):
    g = t.latest_chain.groupBy("act_symbol", "expiration").agg(F.collect_list("strike").alias("strikes"), SIDE("C").alias("calls"), SIDE("P").alias("puts"), F.max("spot").alias("spot"), F.min("id").alias("id"))
    return JOINED(quality.validated(g, *quality.chain_rules(C("strikes"), C("calls"), C("puts"), C("spot") - 100, F.datediff("expiration", F.lit("2024-02-10").cast("date")))))


add("val04_chains", _chains, _both(_sql(("spot: must be positive", "spot - 100 > 0"), ("daysToExpiry: must be positive", "expiration - DATE '2024-02-10' > 0"), ("strikes: must not be empty", "n > 0"), ("calls: must not be empty", "c > 0"), ("puts: must not be empty", "p > 0")),
    "FROM (SELECT act_symbol, expiration, min(id) AS id, max(spot) AS spot, count(*) AS n, count(*) FILTER (call_put = 'C') AS c, count(*) FILTER (call_put = 'P') AS p FROM latest_chain GROUP BY 1, 2)"))
add("val05_ranges", lambda t: JOINED(quality.validated(t.chain, *quality.stats_rules(C("delta") + 0.5, C("volume"), {"current": C("vol")}, C("gamma")), *quality.move_rules(straddle_abs=C("theta") + 1))),
    _both(_sql(("rank: must be between 0 and 1", "delta + 0.5 BETWEEN 0 AND 1"), ("percentile: must be between 0 and 100", "volume BETWEEN 0 AND 100"), ("current: must be positive", "vol > 0"), ("stdDev: cannot be negative", "gamma >= 0"), ("straddle.abs: cannot be negative", "theta + 1 >= 0"))))
add("val06_bounds", lambda t: t.chain.select("id", quality.bounded(F.when(C("id") % 4 != 0, C("volume") - 20), 10, 1, 50).alias("n")), "SELECT id, greatest(1, least(50, coalesce(CASE WHEN id % 4 <> 0 THEN volume - 20 END, 10))) AS n FROM chain")
add("val07_error_counts", lambda t: quality.validated(t.chain, *quality.quote_rules(C("strike"), C("delta"), C("bid") - 2, C("ask"), C("vol"), C("volume"), C("open_interest"))).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n")),
    "SELECT 'mid: cannot be negative' AS error, count(*) AS n FROM chain WHERE delta < 0 UNION ALL SELECT 'bid: cannot be negative', count(*) FROM chain WHERE bid - 2 < 0")
add("val08_duplicates", lambda t: views.duplicates(t.chain, ["date", "act_symbol", "expiration", "strike", "call_put"]).agg(F.count("*").alias("keys"), F.sum("n").alias("rows")), "SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM chain GROUP BY date, act_symbol, expiration, strike, call_put HAVING count(*) > 1)")
add("val12_enums", lambda t: JOINED(quality.validated(t.chain, quality.member("callPut", F.when(C("id") % 6 == 0, "X").otherwise(C("call_put")), quality.SIDES))), _both(_sql(("callPut: must be one of C, P", "id % 6 <> 0"))))
NAMES = lambda t: t.read("customer").select(F.concat(F.lit("C"), C("c_custkey").cast("string")).alias("symbol"), C("c_name").alias("name"))
add("srv17_symbol_search", lambda t: quality.search_symbols(NAMES(t), "c1", 20).select("symbol", "place"), "SELECT symbol, place FROM (SELECT 'C' || c_custkey AS symbol, c_name AS name, CASE WHEN c_custkey = 1 THEN 0 WHEN starts_with(CAST(c_custkey AS VARCHAR), '1') THEN 1 WHEN contains(lower(c_name), 'c1') THEN 3 END AS place FROM customer) WHERE place IS NOT NULL ORDER BY place, symbol, name LIMIT 20")
