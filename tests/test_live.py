"""The live sources against a service that breaks its lines, refuses and answers late."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from strikeline.plans import replay
from strikeline.session import scratch_path
from strikeline.sources import live
from strikeline.streaming import feed


@pytest.fixture
def frames(spark):
    path = scratch_path(spark, "frames")
    spark.range(0, 500, 1, 4).select(F.to_json(F.struct("id")).alias("value")).write.text(path)
    return replay.Frames(path)


def reader(url, **options):
    return live.FrameReader({"url": url, "delayMs": "1", **options})


def test_frames_by_number(frames):
    assert len(frames) == 500
    got = [json.loads(x)["id"] for x in frames.between(120, 130)]
    assert got == list(range(120, 130)) and list(frames.between(499, 900)) and not list(frames.between(500, 900))


def test_broken_lines_lose_and_repeat_nothing(frames):
    with replay.Service(frames=frames, breaks=37, refuse=4) as s:
        r = reader(s.url, framesPerPartition="120")
        end = r.latestOffset()
        parts = r.partitions(r.initialOffset(), end)
        got = [x for p in parts for x in r.read(p)]
        assert [(p.start, p.end) for p in parts] == [(0, 120), (120, 240), (240, 360), (360, 480), (480, 500)]
        assert [k for k, _ in got] == list(range(500)) and [json.loads(v)["id"] for _, v in got] == list(range(500))
        assert s.broken > 10


def test_pauses_double_and_end(frames, monkeypatch):
    pauses = []
    monkeypatch.setattr(live, "pause", pauses.append)
    with replay.Service(frames=frames, refuse=10**6) as s:
        with pytest.raises(live.HTTPError):
            list(live.FrameReader({"url": s.url}).read(live.Frames(0, 5)))
    assert pauses == [1, 2, 4, 8, 16]


def test_a_frame_sets_the_attempts_back(frames, monkeypatch):
    pauses = []
    monkeypatch.setattr(live, "pause", pauses.append)
    with replay.Service(frames=frames, breaks=2) as s:
        assert len(list(live.FrameReader({"url": s.url}).read(live.Frames(0, 20)))) == 20
    assert set(pauses) == {1}


def test_errors_of_the_caller_are_not_repeated(frames, monkeypatch):
    monkeypatch.setattr(live, "pause", lambda _: pytest.fail("waited"))
    with replay.Service(frames=frames) as s:
        with pytest.raises(live.HTTPError):
            live.Line({"url": s.url}).get("/nothing")


def test_stream_goes_on_from_its_checkpoint(spark, frames):
    live.register(spark)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    for held, breaks in ((180, 50), (180, 0), (500, 61)):
        with replay.Service(frames=frames, breaks=breaks) as s:
            s.held = held
            df = spark.readStream.format("frame_feed").options(url=s.url, delayMs="1", framesPerPartition="100").load()
            got = feed.drain(df, out, state)
            assert sorted(r.offset for r in got.collect()) == list(range(held))


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def table(spark, url, **options):
    live.register(spark)
    return spark.read.format("sql_http").schema(SCHEMA).options(url=url, table="events", delayMs="1", **options).load()


def asked(service):
    return [w["q"] for _, w, _ in service.asked if "q" in w]


def test_filters_and_ranges_reach_the_endpoint(spark, sf_dir):
    with replay.Service(sf_dir=sf_dir, tables=("events",)) as s:
        rows = table(spark, s.url, partitionColumn="event_id", lowerBound="0", upperBound="1000", numPartitions="4", pageRows="100", apiKey="k")
        got = rows.filter((F.col("user_id") == 7) & F.col("event_type").isin("click", "o'clock") & (F.abs("value") < 50) & ~F.col("event_type").startswith("v")).collect()
        sent = asked(s)
        assert sent and all('"user_id" = 7' in q and "IN ('click', 'o''clock')" in q and "abs" not in q and "LIMIT 100" in q for q in sent)
        assert any('"event_id" >= 250 AND "event_id" < 500' in q for q in sent) and any('"event_id" >= 750 ORDER' in q for q in sent)
        assert {a for _, _, a in s.asked} == {"Bearer k"}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = events.filter((F.col("user_id") == 7) & F.col("event_type").isin("click", "o'clock") & (F.abs("value") < 50)).count()
    assert len(got) == want


def test_pages_and_rows_outside_the_bounds(spark, sf_dir):
    with replay.Service(sf_dir=sf_dir, tables=("events",)) as s:
        rows = table(spark, s.url, partitionColumn="event_id", lowerBound="100", upperBound="200", numPartitions="2", pageRows="64")
        got = rows.select("event_id", "value").collect()
        assert any('"event_id" > ' in q for q in asked(s))
    want = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_one_page_without_a_partition_column(spark, sf_dir):
    with replay.Service(sf_dir=sf_dir, tables=("events",), refuse=2) as s:
        assert table(spark, s.url).filter("event_id < 5").count() == 5
        assert len(asked(s)) == 3 and "LIMIT" not in asked(s)[0]


def test_refused_queries_fail(spark, sf_dir):
    with replay.Service(sf_dir=sf_dir, tables=("events",)) as s:
        with pytest.raises(Exception, match="refused the query"):
            spark.read.format("sql_http").schema("nothing long").options(url=s.url, table="events", delayMs="1").load().collect()


def test_late_answers_fail(monkeypatch):
    class Slow(replay.Service):
        def answer(self, sql):
            time.sleep(0.5)
            return {"query_execution_status": "Success", "rows": []}

    with Slow() as s:
        r = live.SqlReader(live.T.StructType([live.T.StructField("a", live.T.LongType())]), {"url": s.url, "table": "t", "timeoutMs": "100", "attempts": "1", "delayMs": "1"})
        with pytest.raises(OSError):
            list(r.read(live.Piece(None, None)))


@pytest.mark.parametrize(("value", "sql"), [(None, "NULL"), (True, "TRUE"), (3, "3"), (1.5, "1.5"), ("a'b", "'a''b'"), (float("inf"), "CAST('inf' AS DOUBLE)")])
def test_literals(value, sql):
    assert live.literal(value) == sql


def test_a_range_of_frames_is_read_from_where_it_begins(spark, monkeypatch):
    """Before, each request read its file from the first line, so lines that break cost the square of a file."""
    monkeypatch.setattr(replay, "BLOCK", 64)
    path = scratch_path(spark, "frames")
    spark.range(0, 3000, 1, 2).select(F.concat(F.lit("x"), F.repeat(F.lit("-"), (F.col("id") * 37 % 211).cast("int")), "id").alias("value")).write.text(path)
    frames = replay.Frames(path)
    want = [f"x{'-' * (k * 37 % 211)}{k}".encode() for k in range(3000)]
    assert len(frames) == 3000 and list(frames.between(0, 10**9)) == want
    frames.read = 0
    for a in range(0, 3000, 7):
        assert list(frames.between(a, a + 5)) == want[a : a + 5]
    assert frames.read < 430 * 2000 < sum(map(len, want)) * 430 // 4


def test_wide_ranges_are_cut():
    options = {"url": "http://x", "table": "t", "partitionColumn": "a", "lowerBound": "0", "numPartitions": "8", "partitionWidth": "50000"}
    cut = lambda high: live.SqlReader(live.T.StructType([]), options | {"upperBound": str(high)}).partitions()
    assert len(cut(1000)) == 8
    pieces = cut(6_000_000)
    assert len(pieces) == 120 and max(p.high - p.low for p in pieces[1:-1]) <= 50_000
    assert pieces[0].low is None and pieces[-1].high is None and all(a.high == b.low for a, b in zip(pieces, pieces[1:]))


def test_a_stored_table_answers_alike(spark, sf_dir):
    """Texts in JSON as before, from a table in the order of its pages."""
    sql = "SELECT event_id, ts, event_type, value, value > 50 AS high, nullif(event_type, 'view') AS other FROM events WHERE event_id > 10 ORDER BY event_id LIMIT 50"
    with replay.Service(sf_dir=sf_dir, tables=("events",), order="event_id") as s, replay.Service(sf_dir=sf_dir, tables=("events",)) as plain:
        got = [live.Line({"url": x.url}).get(f"?q={live.quote(sql)}") for x in (s, plain)]
        assert got[0] == got[1] and got[0]["query_execution_status"] == "Success"
        rows = got[0]["rows"]
        assert [r["event_id"] for r in rows] == [str(k) for k in range(11, 61)] and {r["high"] for r in rows} <= {"true", "false"}
        assert s.db.execute("SELECT table_type FROM information_schema.tables").fetchall() == [("BASE TABLE",)]
        assert table(spark, s.url, partitionColumn="event_id", lowerBound="0", upperBound="1000", numPartitions="2", partitionWidth="300", pageRows="64").count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
        assert len({q.split("WHERE")[1].split("ORDER")[0] for q in asked(s) if "LIMIT 64" in q and '"event_id" > ' not in q}) == 4
