"""Streams over landed files return what the same transformations return over a table."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from strikeline.streaming import feed


def frames():
    out = []
    for k in range(120):
        bar = {"ev": "AM", "sym": f"O:S{k % 3}", "v": k, "o": k / 2, "h": k / 2 + 1, "l": k / 2 - 1, "c": k / 4, "s": 60_000 * (k // 3), "e": 60_000 * (k // 3 + 1)}
        out.append(json.dumps([bar, {"ev": "status", "status": "ok"}] if k % 4 == 0 else bar))
        if k % 10 == 0:
            out += [out[-1], "{broken"]
    return out


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = frames()
    for k in range(0, len(rows), 40):
        (folder / f"{k:04}.txt").write_text("\n".join(rows[k : k + 40]))
        os.utime(folder / f"{k:04}.txt", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in this order
    return str(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_parse_route_and_deduplicate(spark, landed, tmp_path):
    bars = feed.deduplicated(feed.minute_bars(feed.parse_frames(feed.read_frames(spark, landed))))
    got = feed.drain(bars, f"{tmp_path}/out", f"{tmp_path}/cp")
    whole = feed.minute_bars(feed.parse_frames(spark.read.text(landed)))
    assert got.count() == 120 == whole.dropDuplicates(["sym", "window_start"]).count()
    assert rows_of(got) == rows_of(whole.dropDuplicates(["sym", "window_start"]))
    assert feed.statuses(feed.parse_frames(spark.read.text(landed))).count() == 30 + 6


def test_rollup_stream_equals_batch(spark, landed, tmp_path):
    stream = feed.rolled_up(feed.deduplicated(feed.minute_bars(feed.parse_frames(feed.read_frames(spark, landed, 1)))), "5 minutes", None)
    got = feed.drain(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = feed.rolled_up(feed.minute_bars(feed.parse_frames(spark.read.text(landed))).dropDuplicates(["sym", "window_start"]), "5 minutes")
    closed = batch.filter(F.unix_seconds("start") + 300 <= 40 * 60 - 120)  # those that the watermark has passed
    assert set(rows_of(closed)) - set(rows_of(got)) == set()
    assert set(rows_of(got)) <= set(rows_of(batch))


def test_sessions_and_subscriptions(spark, landed):
    bars = feed.minute_bars(feed.parse_frames(spark.read.text(landed))).dropDuplicates(["sym", "window_start"])
    assert {r.n for r in feed.sessions(bars).collect()} == {40}
    some = feed.subscribed(bars, spark.createDataFrame([("O:S1",), ("O:S1",)], "sym string"))
    assert [(r.sym, r.messages) for r in feed.activity(some).collect()] == [("O:S1", 40)]


REQUESTS = [("a", k, ms) for k, ms in enumerate((0, 10, 20, 60_000, 60_001, 60_002, 60_003, 130_000))] + [("b", 100, 5)]


def allowed_of(df):
    return {r.id: r.allowed for r in df.collect()}


def test_rate_limit(spark, tmp_path):
    table = spark.createDataFrame(REQUESTS, "key string, id long, ms long")
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True, 100: True}
    assert allowed_of(feed.limit_requests(table, 2)) == want
    table.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).json(f"{tmp_path}/in")
    assert allowed_of(feed.drain(feed.limit_requests(stream, 2), f"{tmp_path}/out", f"{tmp_path}/cp")) == want


def test_fan_out_isolates_failures(spark):
    seen, failed = [], []

    def broken(_):
        raise RuntimeError("no")

    feed.fan_out({"bad": broken, "good": lambda df: seen.append(df.count())}, lambda name, e: failed.append((name, str(e))))(spark.range(3), 0)
    assert (seen, failed) == ([3], [("bad", "no")])


def _bars_in(spark):
    from strikeline.session import scratch_path

    source = scratch_path(spark, "bars")
    spark.range(60).selectExpr("concat('s', id % 3) AS sym", "id").write.parquet(source)
    return source


def _play(spark, source, check, handlers, failed, **options):
    q = spark.readStream.schema("sym string, id long").parquet(source).writeStream.foreachBatch(feed.fan_out(handlers, failed, **options)).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_replayed_batch_reaches_unfinished_handlers_only(spark):
    from strikeline.session import scratch_path

    source, out, books, check = _bars_in(spark), *(scratch_path(spark, n) for n in ("out", "ledger", "check"))
    calls = []

    def second(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise ValueError("lost")

    first = feed.appending(out)
    counted = []

    def once(batch, number):
        counted.append(number)
        first(batch, number)

    ledger = feed.Ledger(spark, books)
    with pytest.raises(Exception, match="failed in second"):
        _play(spark, source, check, {"first": once, "second": second}, lambda *_: None, ledger=ledger, again=True)
    assert ledger.has("first", 0) and not ledger.has("second", 0)
    _play(spark, source, check, {"first": once, "second": second}, lambda *_: None, ledger=ledger, again=True)
    assert counted == [0] and calls == [0, 0] and ledger.has("second", 0)
    assert spark.read.parquet(out).count() == 60


def test_a_batch_that_comes_twice_is_written_once(spark):
    from strikeline.session import scratch_path

    out = scratch_path(spark, "out")
    write = feed.appending(out, lambda b: b.filter("id > 4"))
    for _ in range(2):
        write(spark.range(10), 7)
    write(spark.range(10), 8)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(out).collect()) == [(i, b) for i in range(5, 10) for b in (7, 8)]


def test_without_a_ledger_failures_are_reported_only(spark):
    from strikeline.session import scratch_path

    source, check, told, seen = _bars_in(spark), scratch_path(spark, "check"), [], []

    def broken(batch):
        raise ValueError("no")

    _play(spark, source, check, {"broken": broken, "fine": lambda b: seen.append(b.count())}, lambda name, e: told.append((name, str(e))))
    assert told == [("broken", "no")] and seen == [60]


def test_subscriptions_by_time(spark):
    """The newest control up to a row counts, for at most the lease."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    controls = spark.createDataFrame([("a", at(10), 1, True), ("a", at(20), 2, False), ("a", at(20), 3, True), ("a", at(40), 4, False), ("b", at(0), 5, True)], "sym string, at timestamp, id long, subscribe boolean")
    bars = spark.createDataFrame([("a", k, at(k)) for k in (5, 10, 15, 20, 39, 40, 50)] + [("b", k, at(k)) for k in (0, 29, 30, 31)] + [("c", 1, at(1))], "sym string, id long, window_end timestamp")
    got = sorted((r.sym, r.id) for r in feed.subscribed_over_time(bars, controls, lease="30 minutes").collect())
    assert got == [("a", 10), ("a", 15), ("a", 20), ("a", 39), ("b", 0), ("b", 29)]


def _given(n):
    import datetime
    import random

    rng, start = random.Random(n), datetime.datetime(2024, 1, 1)
    at = lambda: start + datetime.timedelta(minutes=rng.randint(0, 3000))
    controls = [(rng.choice("abc"), at(), k, rng.random() < 0.6) for k in range(n)]
    bars = [(rng.choice("abcd"), k, at(), None if k % 5 else 'x"é') for k in range(n)]
    lease = datetime.timedelta(minutes=90)
    want = set()
    for sym, k, t, _ in bars:
        seen = [(a, i, s) for c, a, i, s in controls if c == sym and t - lease < a <= t]
        if seen and max(seen)[2]:
            want.add(k)
    return bars, controls, want


BAR, CONTROL = "sym string, id long, window_end timestamp, note string", "sym string, at timestamp, id long, subscribe boolean"


def test_subscriptions_of_streams_meet_no_pairs(spark):
    """A row looks one control up: the state is a few packed pieces a contract, not its rows, and what was decided leaves it."""
    import datetime

    from strikeline.session import scratch_path
    from strikeline.streaming import state

    bars, controls, want = _given(600)
    left, right, out, check = (scratch_path(spark, n) for n in ("bars", "controls", "out", "check"))
    bars_df, controls_df = spark.createDataFrame(bars, BAR), spark.createDataFrame(controls, CONTROL)
    cut = datetime.datetime(2024, 1, 2)
    end = datetime.datetime(2024, 2, 1)
    steps = [(bars_df.filter(F.col("window_end") < cut), controls_df.filter(F.col("at") < cut)), (bars_df.filter(F.col("window_end") >= cut), controls_df.filter(F.col("at") >= cut)),
             (spark.createDataFrame([("end", -1, end, None)], BAR), spark.createDataFrame([("end", end, -1, False)], CONTROL))]
    held = []
    for b, c in steps:
        b.coalesce(1).write.mode("append").parquet(left)
        c.coalesce(1).write.mode("append").parquet(right)
        with state.rocksdb(spark):
            df = feed.subscribed_over_time(spark.readStream.schema(BAR).parquet(left), spark.readStream.schema(CONTROL).parquet(right), lease="90 minutes")
            q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.schema(BAR).parquet(out).collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    notes = {k: (t, note) for _, k, t, note in bars}
    assert all((r.window_end, r.note) == notes[r.id] for r in got)
    assert max(held) < 60


def test_subscriptions_of_tables(spark):
    bars, controls, want = _given(400)
    got = feed.subscribed_over_time(spark.createDataFrame(bars, BAR), spark.createDataFrame(controls, CONTROL), lease="90 minutes")
    assert sorted(r.id for r in got.collect()) == sorted(want)
    # Pairs of one contract: 60,000 times 60,000 before.
    many = spark.range(60_000).selectExpr("'a' AS sym", "timestamp_millis(id * 100 + 50) AS at", "id", "id % 2 = 0 AS subscribe")
    rows = spark.range(60_000).selectExpr("'a' AS sym", "id", "timestamp_millis(id * 100 + 100) AS window_end", "'' AS note")
    assert feed.subscribed_over_time(rows, many).count() == 30_000
