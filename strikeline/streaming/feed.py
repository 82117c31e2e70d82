"""The minute-aggregate feed as a stream: frames parsed and routed, duplicates and late rows handled, windows re-aggregated,
subscriptions counted, requests limited per key. Every transformation works on a batch table as well."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strikeline.operators.asof import asof_join
from strikeline.streaming import state

EVENT = "ev string, status string, sym string, v bigint, av bigint, op double, vw double, o double, c double, h double, l double, a double, z bigint, s bigint, e bigint"
LATENESS = "2 minutes"


def read_frames(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Text frames as they land in a folder, a line each."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def parse_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """Events of frames that are a JSON object or an array of them; what is neither is dropped."""
    text = F.trim(column)
    as_array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    events = frames.select(F.explode(F.from_json(as_array, f"array<struct<{EVENT}>>")).alias("r")).select("r.*")
    return events.filter(F.col("ev").isNotNull())


def statuses(events: DataFrame) -> DataFrame:
    return events.filter("ev = 'status'").select("status")


def minute_bars(events: DataFrame) -> DataFrame:
    """Prices, volume and window of each aggregate; its time is the window's end."""
    bars = events.filter("ev = 'AM'")
    return bars.select(
        "sym",
        *[F.col(x).alias(n) for x, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"), ("vw", "vwap"))],
        F.timestamp_millis("s").alias("window_start"),
        F.timestamp_millis("e").alias("window_end"),
        (F.col("e") - F.col("s")).alias("duration_ms"),
    )


def deduplicated(bars: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row per contract and window, as long as repeats come within the lateness."""
    return bars.withWatermark("window_end", lateness).dropDuplicatesWithinWatermark(["sym", "window_start"])


def rolled_up(bars: DataFrame, width: str = "5 minutes", lateness: str | None = LATENESS) -> DataFrame:
    """Open, high, low, close and volume over longer windows."""
    late = bars if lateness is None or not bars.isStreaming else bars.withWatermark("window_end", lateness)
    g = late.groupBy(F.window("window_end", width).alias("w"), "sym")
    out = g.agg(
        F.min_by("open", F.struct("window_start", "open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.struct("window_start", "close")).alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n"),
    )
    return out.select("sym", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def sessions(bars: DataFrame, gap: str = "10 minutes") -> DataFrame:
    late = bars.withWatermark("window_end", LATENESS) if bars.isStreaming else bars
    g = late.groupBy(F.session_window("window_end", gap).alias("w"), "sym").agg(F.count("*").alias("n"))
    return g.select("sym", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def subscribed(bars: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Rows of contracts that someone subscribed to."""
    return bars.join(subscriptions.select("sym").distinct(), "sym", "left_semi")


def subscribed_over_time(bars: DataFrame, controls: DataFrame, lease: str = "12 hours", lateness: str = "10 minutes") -> DataFrame:
    """Rows of bars(sym, window_end, ...) whose contract was subscribed to at their time. controls(sym, at, id, subscribe) come
    as they are given; the newest one up to a row's time counts, for at most the lease. Every row looks up one control and meets
    no others. As streams (both, with RocksDB) rows come out when the watermark has passed them, and what no later row can see
    leaves the state."""
    lease_us = pd.Timedelta(lease) // pd.Timedelta(microseconds=1)
    if bars.isStreaming:
        return state.subscribed(bars, controls, lease_us, lateness)
    named = bars.filter("sym is not null")
    given = controls.filter("sym is not null").select("sym", "at", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), "subscribe")
    found = asof_join(named, given, ["sym"], "window_end", "at", "id", lease_us - 1)
    return found.filter("match.subscribe").select(*bars.columns)


def activity(bars: DataFrame) -> DataFrame:
    return bars.groupBy("sym").agg(F.count("*").alias("messages"), F.max("window_end").alias("last_update"))


def daily_counts(events: DataFrame, time: str, lateness: str = "48 hours") -> DataFrame:
    late = events.withWatermark(time, lateness) if events.isStreaming else events
    return late.groupBy(F.window(time, "1 day").alias("w")).count().select(F.col("w.start").cast("date").alias("day"), F.col("count").alias("n"))


def top_movers(scores: DataFrame, n: int = 10, least: float = 5.0) -> DataFrame:
    """scores(day, symbol, ts, score): each symbol's last score of a day above the least, the n greatest a day."""
    from pyspark.sql.window import Window

    last = scores.filter(F.col("score") > least).groupBy("day", "symbol").agg(F.max_by("score", "ts").alias("score"))
    order = Window.partitionBy("day").orderBy(F.desc("score"), F.desc("symbol"))
    return last.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


class Ledger:
    """Which handler has finished which batch: an empty file each, which is made once or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, handler: str, batch: int):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{handler}/{batch}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, handler: str, batch: int) -> bool:
        at, files = self._file(handler, batch)
        return files.exists(at)

    def add(self, handler: str, batch: int) -> None:
        at, files = self._file(handler, batch)
        files.create(at, False).close()


def appending(path: str, make: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A handler that adds what it makes of a batch to a table. A batch that comes again replaces what it wrote before."""

    def handle(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def fan_out(handlers: dict[str, Callable], failed: Callable[[str, Exception], None], ledger: Ledger | None = None, again: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every handler gets the batch, and one that fails does not keep it from the others. Handlers take the
    batch, or the batch and its number.

    With a ledger a batch that Spark plays again after a crash reaches only the handlers that had not finished it; between a
    handler's work and its entry it can still come twice, so handlers should write as `appending` does. With `again` the batch
    counts as failed when a handler did, so that it comes again after a restart."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        failures = []
        try:
            for name, handler in handlers.items():
                if ledger and ledger.has(name, number):
                    continue
                try:
                    handler(batch, number) if len(inspect.signature(handler).parameters) > 1 else handler(batch)
                except Exception as e:  # handlers are the caller's code; their failures are reported, not raised
                    failed(name, e)
                    failures.append(name)
                else:
                    if ledger:
                        ledger.add(name, number)
        finally:
            batch.unpersist()
        if again and failures:
            raise RuntimeError(f"batch {number} failed in {', '.join(failures)}")

    return handle


def limit_requests(requests: DataFrame, most: int = 10, window_ms: int = 60_000) -> DataFrame:
    """requests(key, id, ms) with allowed. A window begins with the first request after the last one ended, so it is no
    tumbling window. As a stream the state is kept per key; over a table each key is read in time order."""
    if requests.isStreaming:
        return requests.groupBy("key").applyInPandasWithState(_limiter(most, window_ms), "key string, id long, ms long, allowed boolean", "count int, until long", "append", "NoTimeout")
    ordered = requests.repartition("key").sortWithinPartitions("key", "ms", "id")
    return ordered.select("key", "id", "ms").mapInPandas(_batch_limiter(most, window_ms), "key string, id long, ms long, allowed boolean")


def _step(count: int, until: int | None, ms: int, most: int, window_ms: int) -> tuple[int, int, bool]:
    if until is None or ms > until:
        return 1, ms + window_ms, True
    return (count, until, False) if count >= most else (count + 1, until, True)


def _limiter(most: int, window_ms: int):
    def run(key, frames: Iterator[pd.DataFrame], held):
        count, until = held.get if held.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["ms", "id"])
        allowed = []
        for ms in rows["ms"]:
            count, until, ok = _step(count, until, int(ms), most, window_ms)
            allowed.append(ok)
        held.update((count, until))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "ms": rows["ms"], "allowed": allowed})

    return run


def _batch_limiter(most: int, window_ms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, until = None, 0, None
        for frame in frames:
            allowed = []
            for k, ms in zip(frame["key"], frame["ms"], strict=True):
                if k != key:
                    key, count, until = k, 0, None
                count, until, ok = _step(count, until, int(ms), most, window_ms)
                allowed.append(ok)
            yield frame.assign(allowed=allowed)

    return run


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has landed, into Parquet, and return what was written."""
    query: StreamingQuery = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
