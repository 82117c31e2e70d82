"""Keyed state with a time to live: request limits, daily counters, rings of the newest rows, and subscriptions by time.

State lives in RocksDB, so it is not held on the heap. It ends by event time: when the watermark passes the end of a window or of
a counter's life, a timer removes it. A batch of one key is held as plain numbers while it is put in order, or only as the newest
rows; batches are bounded by the source (`maxFilesPerTrigger`). Counters of one name are split over shards,
so that the busiest day is many keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
LIFE_MS = 48 * 3_600_000
SHARDS = 16


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, while a query starts; the session's own setting comes back after it."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def allowed(ms: np.ndarray, count: int, until: int | None, most: int, window_ms: int) -> tuple[np.ndarray, int, int | None]:
    """Which of a key's requests, in time order, are allowed, and the window at their end. A window begins with the first
    request after the last one ended; a request at its very end is still inside. One step for each window."""
    out, at = np.zeros(len(ms), bool), 0
    while at < len(ms):
        if until is None or ms[at] > until:
            count, until = 0, int(ms[at]) + window_ms
        stop = int(np.searchsorted(ms, until, side="right"))
        free = max(0, min(most - count, stop - at))
        out[at : at + free] = True
        count, at = count + free, stop
    return out, count, until


class Limiter(StatefulProcessor):
    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ms, ids = (np.concatenate(x) for x in zip(*((f["ms"].to_numpy(), f["id"].to_numpy()) for f in rows), strict=True))
        order = np.lexsort((ids, ms))
        count, until = self.window.get() if self.window.exists() else (0, None)
        fine, count, ends = allowed(ms[order], count, until, self.most, self.window_ms)
        self.window.update((count, ends))
        if until is not None and until != ends:
            self.handle.deleteTimer(until + 1)
        self.handle.registerTimer(ends + 1)
        yield pd.DataFrame({"key": key[0], "id": ids[order], "ms": ms[order], "allowed": fine})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_requests(requests: DataFrame, most: int = 10, window_ms: int = 60_000, lateness: str = "10 seconds") -> DataFrame:
    """A stream of requests(key, id, ms) with allowed."""
    timed = requests.select("key", "id", "ms", F.timestamp_millis("ms").alias("at")).withWatermark("at", lateness)
    return timed.groupBy("key").transformWithStateInPandas(Limiter(most, window_ms), "key string, id long, ms long, allowed boolean", "Append", "EventTime")


class Counter(StatefulProcessor):
    """Counts of a day's shard; each batch that adds to one gives its new value."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("count", "n long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ends = self.state.get() if self.state.exists() else (0, None)
        last = ends
        for f in rows:
            n += len(f)
            last = max(last or 0, int(f["ms"].max()) + self.life_ms)
        if ends is not None and ends != last:
            self.handle.deleteTimer(ends)
        self.handle.registerTimer(last)
        self.state.update((n, last))
        yield pd.DataFrame({"day": [key[0]], "shard": [key[1]], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_counters(events: DataFrame, time: str, id: str, life_ms: int = LIFE_MS, lateness: str = "1 hour") -> DataFrame:
    """A stream of (day, shard, n): what each shard of a day has counted so far. A counter lives for life_ms after its last hit;
    `totals` adds what a sink has received."""
    timed = events.select(F.to_date(time).alias("day"), F.pmod(F.xxhash64(id), F.lit(SHARDS)).cast("int").alias("shard"), F.unix_millis(time).alias("ms"), F.col(time).alias("at"))
    return timed.withWatermark("at", lateness).groupBy("day", "shard").transformWithStateInPandas(Counter(life_ms), "day date, shard int, n long", "Update", "EventTime")


def totals(counts: DataFrame) -> DataFrame:
    """Counts by day from all values that the counters gave: they only grow, so a shard's greatest is its last."""
    return counts.groupBy("day", "shard").agg(F.max("n").alias("n")).groupBy("day").agg(F.sum("n").alias("n"))


class Ring(StatefulProcessor):
    """The newest rows of a key. A row whose `keep` is false empties the ring of all that is not newer."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("ring", "ms long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) if self.rows.exists() else []
        cleared = None
        for f in rows:
            gone = f.loc[~f["keep"].astype(bool)]
            if len(gone):
                cleared = max([*([cleared] if cleared else []), *zip(gone["ms"].tolist(), gone["id"].tolist(), strict=True)])
            stay = f.loc[f["keep"].astype(bool)]
            held = heapq.nlargest(self.size, [*held, *zip(stay["ms"].tolist(), stay["id"].tolist(), strict=True)])
        held = sorted((int(a), int(b)) for a, b in held if cleared is None or (a, b) > cleared)
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        yield pd.DataFrame({"key": [key[0]], "held": [len(held)]})

    def close(self) -> None:
        pass


def ring(rows: DataFrame, size: int = 1000) -> DataFrame:
    """A stream of (key, held), which keeps the newest rows of (key, ms, id, keep) as its state; `ring_rows` reads them."""
    return rows.groupBy("key").transformWithStateInPandas(Ring(size), "key string, held int", "Update", "None")


def ring_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the rings of a stream hold: key, ms, id."""
    with rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "ring").option("flattenCollectionTypes", "true").load(checkpoint)
        return state.select("key.key", "list_element.ms", "list_element.id")


def newest(control_us: np.ndarray, ids: np.ndarray, fine: np.ndarray, us: np.ndarray, lease_us: int) -> np.ndarray:
    """For each time whether the newest control up to it subscribes and is younger than the lease; of controls with one time
    the one with the largest id counts."""
    if not len(control_us):
        return np.zeros(len(us), bool)
    order = np.lexsort((ids, control_us))
    control_us, fine = control_us[order], fine[order]
    at = np.searchsorted(control_us, us, side="right") - 1
    return (at >= 0) & fine[at] & (control_us[at] > us - lease_us)


def _packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


class Subscriptions(StatefulProcessor):
    """Rows wait, packed as they came, until the watermark has passed them; then each looks its control up. Of the controls
    stay those that later rows can still see."""

    def __init__(self, lease_us: int):
        self.lease_us = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.controls = handle.getListState("controls", "chunk binary")
        self.due = handle.getValueState("due", "ms long")

    def _at(self, ms: int) -> None:
        """One timer a key, the earliest that was asked for."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _read(self, chunks) -> pa.Table | None:
        held = [pa.ipc.open_stream(c[0]).read_all() for c in chunks.get()] if chunks.exists() else []
        return pa.concat_tables(held) if held else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = []
        for f in rows:
            us, given = f["us"].to_numpy(), f["row"].isna().to_numpy()
            if given.any():
                self.controls.appendValue((_packed(us=us[given], id=f["id"].to_numpy()[given], fine=f["fine"].to_numpy()[given].astype(bool)),))
                times.append(int(us[given].min()) + self.lease_us)
            if not given.all():
                self.waiting.appendValue((_packed(us=us[~given], row=f["row"][~given].tolist()),))
                times.append(int(us[~given].min()))
        if times:
            self._at(-(-min(times) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        controls, waiting = self._read(self.controls), self._read(self.waiting)
        none = np.zeros(0, np.int64)
        control_us, ids, fine = (controls.column(c).to_numpy() for c in ("us", "id", "fine")) if controls else (none, none, none.astype(bool))
        if waiting:
            us = waiting.column("us").to_numpy()
            out = waiting.filter(pa.array((us <= passed) & newest(control_us, ids, fine, us, self.lease_us)))
            later = us > passed
            self.waiting.clear()
            if later.any():
                rest = waiting.filter(pa.array(later))
                self.waiting.appendValue((_packed(us=us[later], row=rest.column("row").combine_chunks()),))
                self._at(-(-int(us[later].min()) // 1000))
            if len(out):
                yield pd.DataFrame({"out": out.column("row").to_pylist()})
        if controls:
            seen = control_us[control_us <= passed]
            keep = (control_us >= (seen.max() if len(seen) else passed)) & (control_us > passed - self.lease_us)
            self.controls.clear()
            if keep.any():
                self.controls.appendValue((_packed(us=control_us[keep], id=ids[keep], fine=fine[keep]),))
                self._at(-(-(int(control_us[keep].min()) + self.lease_us) // 1000))

    def close(self) -> None:
        pass


JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def subscribed(bars: DataFrame, controls: DataFrame, lease_us: int, lateness: str) -> DataFrame:
    """Streams of bars(sym, window_end, ...) and controls(sym, at, id, subscribe): see `feed.subscribed_over_time`."""
    row = F.to_json(F.struct(*bars.columns), JSON)
    ones = bars.withWatermark("window_end", lateness).select("sym", F.col("window_end").alias("time"), F.lit(0).cast("long").alias("id"), F.lit(False).alias("fine"), row.alias("row"))
    least = F.lit(-(2**63)).cast("long")
    others = controls.withWatermark("at", lateness).select("sym", F.col("at").alias("time"), F.coalesce(F.col("id").cast("long"), least).alias("id"), F.coalesce("subscribe", F.lit(False)).alias("fine"), F.lit(None).cast("string").alias("row"))
    both = ones.unionAll(others).filter("sym is not null and time is not null").withColumn("us", F.unix_micros("time"))
    out = both.groupBy("sym").transformWithStateInPandas(Subscriptions(lease_us), "out string", "Append", "EventTime")
    return out.select(F.from_json("out", bars.schema, JSON).alias("r")).select("r.*")
