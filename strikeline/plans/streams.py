"""Feeds and requests that land in turns and are drained by streams that go on from their checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.plans.fixtures import Tables
from strikeline.plans.registry import add
from strikeline.plans.serving import limits_sql
from strikeline.session import scratch_path
from strikeline.streaming import feed, state

C = F.col
LANDINGS = 3


def _paths(t: Tables, *names: str) -> list[str]:
    return [scratch_path(t.spark, n) for n in names]


def _in_turns(rows: DataFrame, path: str, ms: str, then: Callable[[], None]) -> None:
    """Lands rows in equal stretches of their time, and calls `then` after each landing."""
    first, last = rows.agg(F.min(ms), F.max(ms)).first()
    width = ((last or 0) - (first or 0)) // LANDINGS + 1
    for k in range(LANDINGS):
        low = (first or 0) + k * width
        rows.filter((C(ms) >= low) & (C(ms) < low + width)).write.mode("append").parquet(path)
        then()


# A second of the events counts as a millisecond, so that requests are dense enough for a limit to bite.
REQUESTS = "SELECT CAST(user_id % 5 AS VARCHAR) AS key, event_id AS id, epoch_us(ts) // 1000000 AS ms FROM events"


def stream_limits(t: Tables) -> DataFrame:
    rows = t.read("events").select((C("user_id") % 5).cast("string").alias("key"), C("event_id").alias("id"), F.expr("unix_millis(cast(ts as timestamp)) div 1000").alias("ms"))
    source, out, check = _paths(t, "requests", "limited", "state")

    def drain() -> None:
        with state.rocksdb(t.spark):
            feed.drain(state.limit_requests(t.spark.readStream.schema(rows.schema).parquet(source)), out, check)

    _in_turns(rows, source, "ms", drain)
    return t.spark.read.parquet(out)


add("str07b_stream_limits", stream_limits, limits_sql(REQUESTS, 10, 60_000))


def stream_counters(t: Tables) -> DataFrame:
    rows = t.read("events").select(C("ts").cast("timestamp").alias("ts"), C("event_id").alias("id"), F.unix_millis(C("ts").cast("timestamp")).alias("ms"))
    source, out, check = _paths(t, "hits", "counts", "state")

    def drain() -> None:
        counts = state.daily_counters(t.spark.readStream.schema(rows.schema).parquet(source), "ts", "id")
        with state.rocksdb(t.spark):
            counts.writeStream.outputMode("update").foreachBatch(feed.appending(out)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    _in_turns(rows, source, "ms", drain)
    return state.totals(t.spark.read.parquet(out))


add("str08b_counters", stream_counters, "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")


def stream_rings(t: Tables) -> DataFrame:
    """The newest 1,000 rows of either half of the board."""
    rows = t.bars.select(F.when(C("sym") < "O:SYMN", "A-M").otherwise("N-Z").alias("key"), C("e").alias("ms"), C("event_id").alias("id"), F.lit(True).alias("keep"))
    source, out, check = _paths(t, "rows", "held", "state")

    def drain() -> None:
        with state.rocksdb(t.spark):
            rings = state.ring(t.spark.readStream.schema(rows.schema).parquet(source), 1000)
            rings.writeStream.outputMode("update").format("noop").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    _in_turns(rows, source, "ms", drain)
    return state.ring_rows(t.spark, check)


add("win13b_ring", stream_rings, """SELECT CASE WHEN sym < 'O:SYMN' THEN 'A-M' ELSE 'N-Z' END AS key, e AS ms, event_id AS id FROM bars
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY e DESC, event_id DESC) <= 1000""")

CONTROL = "event_id % 7 = 0"


def changing_subscriptions(t: Tables) -> DataFrame:
    """A seventh of the events subscribe to their contract or give it up; the others are bars."""
    bars = feed.minute_bars(t.bars.filter(f"not {CONTROL}").select(F.lit("AM").alias("ev"), "sym", "o", "h", "l", "c", "v", C("event_id").cast("double").alias("vw"), "s", "e"))
    bars = bars.select("sym", C("vwap").cast("long").alias("id"), "window_end", F.unix_millis("window_end").alias("ms"))
    controls = t.bars.filter(CONTROL).select("sym", F.timestamp_millis("e").alias("at"), C("event_id").alias("id"), ((C("event_id") / 7).cast("long") % 3 != 0).alias("subscribe"), C("e").alias("ms"))
    # The last rows push the watermark past all others.
    end = t.bars.agg((F.coalesce(F.max("e"), F.lit(0)) + 10 * 86_400_000).alias("ms")).select(F.lit("end").alias("sym"), F.lit(-1).cast("long").alias("id"), F.timestamp_millis("ms").alias("time"), "ms")
    left, right, out, check = _paths(t, "bars", "controls", "subscribed", "state")

    def drain() -> None:
        stream = lambda df, path: t.spark.readStream.schema(df.schema).parquet(path).drop("ms")
        with state.rocksdb(t.spark):
            feed.drain(feed.subscribed_over_time(stream(bars, left), stream(controls, right)), out, check)

    first, last = t.bars.agg(F.min("e"), F.max("e")).first()
    cut = ((first or 0) + (last or 0)) // 2
    for part in (C("ms") < cut, C("ms") >= cut):
        bars.filter(part).write.mode("append").parquet(left)
        controls.filter(part).write.mode("append").parquet(right)
        drain()
    end.select("sym", "id", C("time").alias("window_end"), "ms").write.mode("append").parquet(left)
    end.select("sym", C("time").alias("at"), "id", F.lit(False).alias("subscribe"), "ms").write.mode("append").parquet(right)
    drain()
    return t.spark.read.parquet(out).groupBy("sym").agg(F.count("*").alias("messages"), F.unix_millis(F.max("window_end")).alias("last_ms"))


add("str04b_changing_subscriptions", changing_subscriptions, f"""WITH c AS (SELECT sym, e, event_id AS id, (event_id // 7) % 3 <> 0 AS subscribe FROM bars WHERE {CONTROL}),
    j AS (SELECT b.sym, b.event_id, b.e, arg_max(c.subscribe, (c.e, c.id)) AS subscribed FROM bars b JOIN c ON c.sym = b.sym AND c.e <= b.e AND c.e > b.e - 43200000 WHERE NOT {CONTROL.replace('event_id', 'b.event_id')} GROUP BY ALL)
    SELECT sym, count(*) AS messages, max(e) AS last_ms FROM j WHERE subscribed GROUP BY 1""")


class Crash(Exception):
    """What ends a query as the loss of its driver would."""


def _lost(_: str, error: Exception) -> None:
    raise error


def replayed_fan_out(t: Tables) -> DataFrame:
    """The driver is lost between two handlers, and again after a handler has written but before the ledger says so. Each
    restart plays the batch again, and every row reaches every table once."""
    rows = t.bars.select("event_id", "sym", "c", "e")
    source, closes, counts, books, check = _paths(t, "bars", "closes", "counts", "ledger", "state")
    rows.write.parquet(source)
    losses = ["between", "after"]
    write_counts = feed.appending(counts, lambda b: b.groupBy("sym").agg(F.count("*").alias("n")))

    def second(batch: DataFrame, number: int) -> None:
        if losses[:1] == ["between"]:
            raise Crash(losses.pop(0))
        write_counts(batch, number)
        if losses:
            raise Crash(losses.pop(0))

    handlers = {"closes": feed.appending(closes, lambda b: b.select("event_id", "sym", "c")), "counts": second}
    for _ in range(3):
        # A fresh stream each time, as after a restart; it goes on from the checkpoint.
        handle = feed.fan_out(handlers, _lost, feed.Ledger(t.spark, books))
        query = t.spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", check).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:  # the query failed as it was meant to
            if "Crash" not in str(e):
                raise
    read = t.spark.read
    found = read.parquet(closes).groupBy("sym").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("different"))
    return found.join(read.parquet(counts).groupBy("sym").agg(F.sum("n").alias("n")), "sym")


add("str05b_replayed_fan_out", replayed_fan_out, "SELECT sym, count(*) AS rows, count(DISTINCT event_id) AS different, CAST(count(*) AS BIGINT) AS n FROM bars GROUP BY 1")
