"""Exports, merges and tables written to the shared folder and read back, landed payloads, and feeds run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.operators import chain as chains
from strikeline.operators import boosting, modelling, views
from strikeline.plans import replay
from strikeline.plans.domain import EMKEY, FEATURES, LABELS, SPOTS
from strikeline.plans.registry import add
from strikeline.plans.serving import BARS, FRAME
from strikeline.session import scratch_path
from strikeline.sources import landed, live, readers, sinks
from strikeline.streaming import feed

C = F.col
KEY = ["date", "act_symbol", "expiration", "strike", "call_put"]
COLUMNS = "id, date, act_symbol, expiration, strike, call_put, bid, ask, vol, delta, gamma, theta, vega, open_interest, volume"
CHAIN_SQL = f"SELECT {COLUMNS}, year(date) AS partition_year, month(date) AS partition_month FROM chain"
PARTS = {"year": "partition_year", "month": "partition_month"}
CHAIN = lambda t: t.chain.drop("spot").withColumn("created_at", C("created_at").cast("timestamp"))


def _back(t, path: str) -> DataFrame:
    return readers.conform(t.spark.read.parquet(path), readers.CHAIN, PARTS).drop("created_at")


def _exported(t) -> str:
    path = scratch_path(t.spark, "chain")
    sinks.export_chain(CHAIN(t), path)
    return path


def _month_slice(t):
    """All months are exported, then one is replaced by an export of its own."""
    path = _exported(t)
    month = CHAIN(t).filter("date >= date'2024-01-01' and date < date'2024-02-01'").withColumns({"year": F.year("date"), "month": F.month("date")})
    sinks.export(month, path, ["year", "month"], KEY, compression="zstd")
    return _back(t, path)


def _volatility(t, rows):
    path = scratch_path(t.spark, "volatility")
    sinks.export_volatility(rows, path)
    return t.spark.read.parquet(path).select("date", "symbol", "iv", "hv", C("year").cast("int").alias("year"))


def _whole_table(t):
    path = scratch_path(t.spark, "table")
    sinks.export_table(t.em, path)
    return t.spark.read.parquet(path)


def _upserted(t):
    path = scratch_path(t.spark, "forecasts")
    sinks.upsert(t.em_a, path, EMKEY)
    return sinks.upsert(t.em_b.withColumn("em_baseline", C("em_baseline") * 2), path, EMKEY)


def _recent_table(t, days: int):
    return sinks.save_table(views.recent(t.chain, days).select("id", "date", "act_symbol", "strike"), "recent_options", scratch_path(t.spark, "recent_options"))


def _refreshed(t):
    _recent_table(t, 3)
    return _recent_table(t, 7).filter("act_symbol = 'SYM2'")


def _metadata(t):
    path = scratch_path(t.spark, "metadata")
    facts = t.chain.agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")).first()
    sinks.write_metadata(t.spark, path, rows=facts.rows, first_date=facts.first, last_date=facts.last, compression="zstd")
    return t.spark.read.schema("rows string, first_date string, last_date string, compression string").json(path)


def _schema_text(t):
    path = scratch_path(t.spark, "schema")
    t.em.createOrReplaceTempView("em_forecasts")
    sinks.write_schema(t.spark, path, ["em_forecasts"])
    return t.spark.read.text(path).withColumn("rows", t.em.agg(F.count("*")).scalar())


def _columns(t):
    t.em.createOrReplaceTempView("em_forecasts")
    return readers.described(t.spark, ["em_forecasts"])


def _tables(t):
    for year in (2023, 2024):
        t.chain.filter(F.year("date") == year).createOrReplaceTempView(f"options_chain_{year}")
    return readers.table_rows(t.spark, "options_chain_20*")


def _export_view(t):
    t.spark.read.parquet(_exported(t)).createOrReplaceTempView("exported_chain")
    return t.spark.sql("SELECT act_symbol, count(*) AS n, max(date) AS newest FROM exported_chain WHERE year = 2024 AND month = 1 GROUP BY act_symbol")


def _csv(t):
    path = scratch_path(t.spark, "csv")
    t.vol.select("date", "symbol", "iv").write.option("header", True).csv(path)
    return readers.csv_summary(t.spark, path)


add("snk01_chain_export", lambda t: _back(t, _exported(t)), CHAIN_SQL)
add("snk02_volatility_export", lambda t: _volatility(t, t.vol), "SELECT date, symbol, iv, hv, CAST(year(date) AS INTEGER) AS year FROM vol")
add("snk03_table_export", _whole_table, "SELECT * FROM em")
add("snk05_month_slice", _month_slice, CHAIN_SQL)
add("snk06_year_slice", lambda t: _volatility(t, t.vol.filter((C("date") >= F.make_date(F.lit(2024), F.lit(1), F.lit(1))) & (C("date") < F.make_date(F.lit(2025), F.lit(1), F.lit(1))))),
    "SELECT date, symbol, iv, hv, 2024 AS year FROM vol WHERE date >= make_date(2024, 1, 1) AND date < make_date(2025, 1, 1)")
add("snk08_forecast_upsert", _upserted, "SELECT em_a.* FROM em_a, clock WHERE quote_ts < d - 2 UNION ALL SELECT * REPLACE (em_baseline * 2 AS em_baseline) FROM em_b")
add("snk10_recent_table", lambda t: _recent_table(t, 7), "SELECT id, date, act_symbol, strike FROM chain WHERE date >= (SELECT max(date) FROM chain) - 7")
add("snk12_export_metadata", _metadata, "SELECT CAST(count(*) AS VARCHAR) AS rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, 'zstd' AS compression FROM chain")
EM_TYPES = {"underlying": "string", "quote_ts": "date", "exp_date": "date", "horizon": "string", "em_baseline": "double", "band68_low": "double", "band68_high": "double", "band95_low": "double", "band95_high": "double"}
add("snk13_schema_text", _schema_text, f"SELECT 'em_forecasts ({', '.join(f'{c} {k}' for c, k in EM_TYPES.items())})' AS value, count(*) AS rows FROM em")
add("src24_columns", _columns, " UNION ALL ".join(f"""SELECT 'em_forecasts' AS "table", {k} AS position, '{c}' AS "column", '{kind}' AS type, count({c}) AS filled FROM em""" for k, (c, kind) in enumerate(EM_TYPES.items())))
add("src25_tables", _tables, """SELECT 'options_chain_2023' AS "table", count(*) AS rows FROM chain WHERE year(date) = 2023 UNION ALL SELECT 'options_chain_2024', count(*) FROM chain WHERE year(date) = 2024""")
add("src05_export_view", _export_view, "SELECT act_symbol, count(*) AS n, max(date) AS newest FROM chain WHERE year(date) = 2024 AND month(date) = 1 GROUP BY 1")
add("src10_csv_summary", _csv, "SELECT count(*) AS rows, min(date) AS first_date FROM vol")
add("src23_file_rows", lambda t: readers.file_summary(t.spark.read.parquet(_exported(t))).agg(F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("has_bytes")), "SELECT count(*) AS rows, true AS has_bytes FROM chain")
add("val09_reconcile", lambda t: sinks.reconcile(t.chain, t.spark.read.parquet(_exported(t)).filter("id % 100 <> 7 or date > date'2024-01-10'"), ["date"]),
    "WITH g AS (SELECT date, count(*) AS source_rows, count(*) FILTER (id % 100 <> 7 OR date > DATE '2024-01-10') AS written_rows FROM chain GROUP BY 1) SELECT *, source_rows <> written_rows AS mismatch FROM g")
add("srv09_refresh", _refreshed, "SELECT id, date, act_symbol, strike FROM chain WHERE act_symbol = 'SYM2' AND date >= (SELECT max(date) FROM chain) - 7")

# landed payloads
TICKER = lambda: F.concat(F.lit("O:"), C("id").cast("string"))
KIND = lambda: F.when(C("call_put") == "C", "call").otherwise("put")


def _land(rows: DataFrame, name: str, field: str | None = "results") -> str:
    """Rows as JSON documents a line, each row a page {field: [row]}, or the row itself."""
    path = scratch_path(rows.sparkSession, name)
    row = F.struct(*rows.columns)
    rows.select(F.to_json(F.struct(F.array(row).alias(field)) if field else row).alias("value")).write.text(path)
    return path


def _snapshots(t) -> DataFrame:
    rows = t.chain.select(
        F.struct(KIND().alias("contract_type"), C("expiration").alias("expiration_date"), C("strike").alias("strike_price"), TICKER().alias("ticker")).alias("details"),
        F.struct("delta", "gamma", "theta", "vega").alias("greeks"),
        C("vol").alias("implied_volatility"),
        F.struct("bid", "ask").alias("last_quote"),
        "open_interest",
        F.struct(C("volume")).alias("day"),
        F.struct(C("act_symbol").alias("ticker"), C("spot").alias("price")).alias("underlying_asset"),
    )
    return readers.contract_snapshots(t.spark, _land(rows, "snapshots"))


def _reference(t, *wanted) -> DataFrame:
    rows = t.chain.select(KIND().alias("contract_type"), C("expiration").alias("expiration_date"), C("strike").alias("strike_price"), TICKER().alias("ticker"), C("act_symbol").alias("underlying_ticker"))
    return readers.contract_reference(t.spark, _land(rows, "contracts"), *wanted)


SNAPSHOT = ("details.ticker", "details.contract_type", "details.strike_price", "details.expiration_date", "greeks.delta", "implied_volatility", "last_quote.bid", "last_quote.ask", "open_interest", "day.volume", "underlying_asset.price")
SNAPSHOT_SQL = "SELECT 'O:' || id AS ticker, CASE WHEN call_put = 'C' THEN 'call' ELSE 'put' END AS contract_type, strike AS strike_price, expiration AS expiration_date, delta, vol AS implied_volatility, bid, ask, open_interest, volume, spot AS price FROM chain"
add("src11_chain_snapshot", lambda t: _snapshots(t).select(*SNAPSHOT), SNAPSHOT_SQL)
add("src12_contract_listing", lambda t: _reference(t, "put", "2024-02-09").select("ticker", "underlying_ticker", "strike_price"), "SELECT 'O:' || id AS ticker, act_symbol AS underlying_ticker, strike AS strike_price FROM chain WHERE call_put = 'P' AND expiration = DATE '2024-02-09'")
add("src13_contract_snapshot", lambda t: _snapshots(t).filter("details.ticker = 'O:17'").select(*SNAPSHOT), SNAPSHOT_SQL + " WHERE id = 17")


def _assembled(t):
    market = _snapshots(t).filter("open_interest % 4 <> 0").select("details.ticker", "last_quote.bid", "last_quote.ask")
    prices = t.chain.groupBy(C("act_symbol").alias("underlying_ticker")).agg(F.max("spot").alias("price"))
    return landed.assembled_chain(_reference(t), market, prices, F.lit("2024-02-05").cast("date")).select("ticker", "underlying_ticker", "expiration_date", "bid", "ask", "price")


add("src14_assembled_chain", _assembled, """SELECT 'O:' || id AS ticker, act_symbol AS underlying_ticker, expiration AS expiration_date, bid, ask, spot AS price FROM chain
    WHERE open_interest % 4 <> 0 AND (act_symbol, expiration) IN (SELECT (act_symbol, min(expiration)) FROM chain WHERE expiration > DATE '2024-02-05' GROUP BY act_symbol)""")


def _earnings(t):
    rows = t.earnings.withColumnsRenamed({"eps_estimated": "epsEstimated", "revenue_estimated": "revenueEstimated"})
    path = scratch_path(t.spark, "earnings")
    rows.select(F.to_json(F.array(F.struct(*rows.columns))).alias("value")).write.text(path)
    return landed.earnings(t.spark, path)


add("src17_earnings_calendar", _earnings, "SELECT symbol, date, eps, eps_estimated, revenue, revenue_estimated FROM earnings")


def _next_events(t):
    hour = F.element_at(F.array(*map(F.lit, ("bmo", "amc", ""))), (F.dayofyear("date") % 3 + 1).cast("int"))
    calendar = _land(t.earnings.filter("symbol <> 'SYM7'").select("symbol", "date", hour.alias("hour"), C("eps_estimated").alias("epsEstimate")), "calendar", "earningsCalendar")
    history = _land(t.earnings.filter((C("date") < t.as_of) & (C("symbol") != "SYM8")).select("symbol", C("date").alias("period"), C("eps").alias("actual"), C("eps_estimated").alias("estimate")), "history", None)
    return landed.next_events(t.spark, calendar, history, t.as_of)


add("src18_next_earnings", _next_events, """WITH c AS (SELECT symbol, date AS next_date, CASE dayofyear(date) % 3 WHEN 0 THEN 'BMO' WHEN 1 THEN 'AMC' ELSE 'UNKNOWN' END AS next_time, eps_estimated AS eps_estimate FROM earnings, clock WHERE symbol <> 'SYM7' AND date > d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) = 1),
    h AS (SELECT symbol, eps - eps_estimated AS s FROM earnings, clock WHERE date < d AND symbol <> 'SYM8' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 8),
    r AS (SELECT symbol, count(*) FILTER (s > 0) / count(*) AS beat_rate, sum(coalesce(s, 0)) / count(*) AS avg_beat FROM h GROUP BY 1)
    SELECT symbol, next_date, next_time, eps_estimate, coalesce(beat_rate, 0.6e0) AS beat_rate, coalesce(avg_beat, 0e0) AS avg_beat FROM c FULL JOIN r USING (symbol)""")


def _quotes(t):
    price = F.when(C("c_custkey") % 5 != 0, (C("c_custkey") % 97).cast("double") / 4)
    rows = t.read("customer").select(F.concat(F.lit("C"), C("c_custkey").cast("string")).alias("symbol"), price.alias("regularMarketPrice"), (C("c_custkey") * 10).alias("regularMarketVolume"))
    return landed.quotes(t.spark, _land(rows, "quotes", None)).select("symbol", "price", "change", "volume", "market_cap")


add("src19_landed_quotes", _quotes, "SELECT 'C' || c_custkey AS symbol, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 97) / 4e0 END, 0e0) AS price, 0e0 AS change, c_custkey * 10 AS volume, CAST(NULL AS DOUBLE) AS market_cap FROM customer")


def _legs(t):
    leg = lambda side: F.array_compact(F.array(F.when(C("call_put") == side, F.struct("strike", "bid", "ask", "volume", C("vol").alias("impliedVolatility")))))
    rows = t.latest_chain.select(F.concat_ws("/", "act_symbol", C("expiration").cast("string")).alias("symbol"), leg("C").alias("calls"), leg("P").alias("puts"))
    legs = landed.option_legs(t.spark, _land(rows, "legs", None))
    return legs.select("symbol", "strike", C("call.bid").alias("call_bid"), C("call.iv").alias("call_iv"), C("put.volume").alias("put_volume"), C("put.last").alias("put_last"))


add("src19b_landed_legs", _legs, """SELECT c.act_symbol || '/' || c.expiration AS symbol, c.strike, c.bid AS call_bid, coalesce(c.vol, 0.25e0) AS call_iv, p.volume AS put_volume, 0e0 AS put_last
    FROM latest_chain c JOIN latest_chain p USING (act_symbol, expiration, strike) WHERE c.call_put = 'C' AND p.call_put = 'P'""")
add("earn05_price_reaction", lambda t: chains.price_reactions(t.earnings.filter(C("date") < t.as_of), SPOTS(t)),
    """WITH s AS (SELECT act_symbol AS symbol, date, avg(ask) AS spot FROM chain GROUP BY 1, 2)
    SELECT e.symbol, e.date, b.spot AS before, a.spot AS after, (a.spot - b.spot) / b.spot * 100 AS move_percent FROM (SELECT symbol, date FROM earnings, clock WHERE date < d) e
    LEFT JOIN s b ON b.symbol = e.symbol AND b.date = e.date - 1 LEFT JOIN s a ON a.symbol = e.symbol AND a.date = e.date + 1""")

# models


def _target(t):
    """Which column is the target, and how many labels have it."""
    labels = LABELS(t)
    target = modelling.target_column(labels.columns)
    return labels.agg(F.lit(target).alias("target"), F.count(target).alias("n"), F.max(target).alias("greatest"))


add("mlt01_target_column", _target, "SELECT 'realized_move' AS target, count(*) AS n, max(em_baseline * 2 + 1) AS greatest FROM em")


def _saved_model(t):
    frame, features, _ = modelling.training_frame(FEATURES(t), LABELS(t), EMKEY)
    path = scratch_path(t.spark, "model")
    modelling.BandModel.fit(frame, features, trees=3, depth=3).save(path)
    return modelling.BandModel.load(t.spark, path).predict(modelling.latest_features(FEATURES(t)), features, EMKEY)


add("mlt04_saved_model", _saved_model)


def _quantile_bands(t):
    """Quantile models of the earlier rows, saved with their facts and loaded again, on each underlying's newest features."""
    frame, features, target = modelling.training_frame(FEATURES(t), LABELS(t), EMKEY)
    first, last = boosting.early(frame, "quote_ts")
    path = scratch_path(t.spark, "quantiles")
    boosting.fit(first, features, trees=4, depth=2, rate=0.2, bins=16).save(t.spark, path, model_family="em_quantile", n_train=first.count(), n_valid=last.count(), features=",".join(features), target=target)
    return boosting.QuantileModels.load(t.spark, path).predict(modelling.latest_features(FEATURES(t)), EMKEY)


add("mlt03_quantile_bands", _quantile_bands)


# feeds, as streams over files that have landed
def _land_frames(t, path: str, wanted: str = "true") -> None:
    BARS(t).filter(wanted).select(F.to_json(F.struct("ev", "sym", "o", "h", "l", "c", "v", "s", "e")).alias("value")).write.mode("append").text(path)


def _bars(t, path: str) -> DataFrame:
    return feed.minute_bars(feed.parse_frames(feed.read_frames(t.spark, path)))


def _paths(t, *names: str) -> list[str]:
    return [scratch_path(t.spark, n) for n in names]


def _landed_in_order(t, rows: DataFrame, name: str) -> replay.Frames:
    """Frames as a service would hold them: files of successive ranges of offsets."""
    path = scratch_path(t.spark, name)
    rows.orderBy("event_id").select("value").write.text(path)
    return replay.Frames(path)


def _feed(t, service: replay.Service) -> DataFrame:
    live.register(t.spark)
    return t.spark.readStream.format("frame_feed").options(url=service.url, delayMs="10", framesPerPartition="5000").load()


def _stream(t):
    """Frames of a service whose line breaks again and again."""
    frames = _landed_in_order(t, BARS(t).select("event_id", FRAME().alias("value")), "frames")
    out, state = _paths(t, "bars", "state")
    with replay.Service(replay.host(t.spark), frames, breaks=700, refuse=2) as service:
        return feed.drain(feed.parse_frames(_feed(t, service)).select("ev", "sym", "c"), out, state)


add("src21_feed_stream", _stream, "SELECT 'AM' AS ev, sym, c FROM bars WHERE event_id % 11 <> 0 UNION ALL SELECT 'status', sym, c FROM bars WHERE event_id % 11 <> 0 AND event_id % 3 = 0")


def _fanned_out(t):
    """Two handlers write, one fails: the batches reach the others all the same."""
    source, counts, closes, state = _paths(t, "frames", "counts", "closes", "state")
    _land_frames(t, source)

    def broken(batch: DataFrame) -> None:
        raise ValueError("handler failed")

    handlers = {
        "broken": broken,
        "counts": lambda b: b.groupBy("sym").agg(F.count("*").alias("n")).write.mode("append").parquet(counts),
        "closes": lambda b: b.groupBy("sym").agg(F.max("close").alias("highest_close")).write.mode("append").parquet(closes),
    }
    failures: list[str] = []
    handle = feed.fan_out(handlers, lambda name, _: failures.append(name))
    _bars(t, source).writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    read = t.spark.read
    return read.parquet(counts).groupBy("sym").agg(F.sum("n").alias("n")).join(read.parquet(closes).groupBy("sym").agg(F.max("highest_close").alias("highest_close")), "sym")


add("str05_fan_out", _fanned_out, "SELECT sym, count(*) AS n, max(c) AS highest_close FROM bars GROUP BY 1")


def _restarted(t):
    """The stream ends with half of the frames, the service goes on, and the stream starts again from its checkpoint; the line
    breaks in both runs, and every frame is there once."""
    whole = F.to_json(F.struct("ev", "sym", "o", "h", "l", "c", "v", "s", "e"))
    frames = _landed_in_order(t, BARS(t).select("event_id", whole.alias("value")), "frames")
    out, state = _paths(t, "bars", "state")
    bars = lambda service: feed.minute_bars(feed.parse_frames(_feed(t, service))).select("sym", "close", "volume")
    with replay.Service(replay.host(t.spark), frames, breaks=900) as service:
        service.held = len(frames) // 2
        feed.drain(bars(service), out, state)
    with replay.Service(replay.host(t.spark), frames, breaks=1100, refuse=3) as service:
        return feed.drain(bars(service), out, state)


add("str06_restart", _restarted, "SELECT sym, c AS close, v AS volume FROM bars")


def _remote_events(t):
    """The events behind a SQL endpoint, in eight ranges or more, none wider than 50,000 numbers, two thousand rows a page,
    filtered there."""
    live.register(t.spark)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    with replay.Service(replay.host(t.spark), sf_dir=t.sf_dir, tables=("events",), refuse=2, order="event_id") as service:
        n = t.read("events").agg(F.max("event_id")).first()[0] or 0
        options = {"url": service.url, "table": "events", "partitionColumn": "event_id", "lowerBound": "0", "upperBound": str(n), "numPartitions": "8", "partitionWidth": "50000", "pageRows": "2000", "delayMs": "10"}
        rows = t.spark.read.format("sql_http").schema(schema).options(**options).load()
        path = scratch_path(t.spark, "remote")
        rows.filter((C("user_id") > 3) & (C("value") < 90) & C("event_type").isNotNull()).write.parquet(path)
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("us"), "value")


add("src08_sql_over_http", _remote_events, "SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events WHERE user_id > 3 AND value < 90")
