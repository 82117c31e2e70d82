"""State operators, run as streams in several landings, against the same work over a table."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeline.session import scratch_path
from strikeline.streaming import feed, state


def plain_limiter(rows, most, window):
    out, held = {}, {}
    for key, i, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        count, until = held.get(key, (0, None))
        if until is None or ms > until:
            held[key], out[i] = (1, ms + window), True
        elif count >= most:
            out[i] = False
        else:
            held[key], out[i] = (count + 1, until), True
    return out


@pytest.mark.parametrize("most", [0, 1, 3, 10])
def test_allowed_in_pieces(most):
    rng = random.Random(most)
    ms = np.array(sorted(rng.randint(0, 900) for _ in range(300)))
    want = plain_limiter([("k", i, int(m)) for i, m in enumerate(ms)], most, 60) if most else dict.fromkeys(range(300), False)
    got, count, until = [], 0, None
    for part in np.array_split(ms, 7):
        fine, count, until = state.allowed(part, count, until, most, 60)
        got += fine.tolist()
    assert got == [want[i] for i in range(300)]


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(path)


def test_limits_over_landings(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 4)}" if k % 3 else "hot", k, t) for k, t in enumerate(sorted(rng.randint(0, 600_000) for _ in range(900)))]
    source, out, check = (scratch_path(spark, n) for n in ("requests", "out", "check"))
    for k in range(3):
        land(spark, source, rows[k * 300 : k * 300 + 300], "key string, id long, ms long")
        stream = spark.readStream.schema("key string, id long, ms long").parquet(source)
        with state.rocksdb(spark):
            got = feed.drain(state.limit_requests(stream), out, check)
    assert {r.id: r.allowed for r in got.collect()} == plain_limiter(rows, 10, 60_000)
    assert spark.conf.get(state.STORE) != state.ROCKSDB


def progress(spark, df, out, check):
    """Runs a stream over what has landed; the rows of state at its end."""
    with state.rocksdb(spark):
        q = df.writeStream.outputMode("append" if "allowed" in df.columns else "update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_windows_end(spark):
    """Keys whose window the watermark has passed leave no state."""
    source, out, check = (scratch_path(spark, n) for n in ("requests", "out", "check"))
    land(spark, source, [(f"k{i}", i, 1000 + i) for i in range(50)], "key string, id long, ms long")
    stream = lambda: state.limit_requests(spark.readStream.schema("key string, id long, ms long").parquet(source))
    first = progress(spark, stream(), out, check)
    land(spark, source, [("late", 1000, 500_000)], "key string, id long, ms long")
    progress(spark, stream(), out, check)
    land(spark, source, [("later", 1001, 600_000)], "key string, id long, ms long")
    assert progress(spark, stream(), out, check) < first


def test_counters_and_their_end(spark):
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    source, out, check = (scratch_path(spark, n) for n in ("hits", "out", "check"))
    schema = "ts timestamp, id long"
    stream = lambda: state.daily_counters(spark.readStream.schema(schema).parquet(source), "ts", "id")
    land(spark, source, [(day(1, k % 24), k) for k in range(100)], schema)
    first = progress(spark, stream(), out, check)
    land(spark, source, [(day(1, 23), k) for k in range(100, 130)] + [(day(2, 3), 200)], schema)
    progress(spark, stream(), out, check)
    land(spark, source, [(day(9, 3), 300)], schema)
    progress(spark, stream(), out, check)
    land(spark, source, [(day(9, 4), 301)], schema)
    assert progress(spark, stream(), out, check) < first
    got = {r.day.day: r.n for r in state.totals(spark.read.parquet(out)).collect()}
    assert got == {1: 130, 2: 1, 9: 2}


def test_rings(spark):
    source, out, check = (scratch_path(spark, n) for n in ("rows", "out", "check"))
    schema = "key string, ms long, id long, keep boolean"
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 2)}", rng.randint(0, 50), i, True) for i in range(300)]
    for k in range(3):
        land(spark, source, rows[k * 100 : k * 100 + 100], schema)
        progress(spark, state.ring(spark.readStream.schema(schema).parquet(source), 20), out, check)
    want = {(key, *x) for key in ("k0", "k1", "k2") for x in sorted(((m, i) for c, m, i, _ in rows if c == key), reverse=True)[:20]}
    assert {(r.key, r.ms, r.id) for r in state.ring_rows(spark, check).collect()} == want
    land(spark, source, [("k0", 30, 10**6, False), ("k1", 99, 10**6, False)], schema)
    progress(spark, state.ring(spark.readStream.schema(schema).parquet(source), 20), out, check)
    after = {(r.key, r.ms, r.id) for r in state.ring_rows(spark, check).collect()}
    assert after == {x for x in want if x[0] == "k2" or x[0] == "k0" and x[1:] > (30, 10**6)}


def test_one_key_as_batch_and_stream_agree(spark):
    rows = [("a", i, 1000 * i) for i in range(200)]
    batch = feed.limit_requests(spark.createDataFrame(rows, "key string, id long, ms long"))
    assert {r.id: r.allowed for r in batch.collect()} == plain_limiter(rows, 10, 60_000)
