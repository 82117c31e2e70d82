"""Daily folders behind a pointer, summaries refreshed by day, and scans that leave other days alone."""

from __future__ import annotations

import datetime
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strikeline.operators import refresh, views
from strikeline.plans.folders import daily_folders
from strikeline.plans.fixtures import Tables
from strikeline.sources.published import Published, Refused

SCHEMA = "day date, k long, v string"


def rows(spark, *given):
    return spark.createDataFrame([(None if d is None else datetime.date(2024, 1, d), k, v) for d, k, v in given], SCHEMA)


def table(spark, tmp_path):
    return Published(spark, f"{tmp_path}/t", rows(spark).schema, "day")


def content(df):
    return sorted(((r.day.day if r.day else None, r.k, r.v) for r in df.collect()), key=str)


def test_merges_touch_their_days_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.version() == 0 and t.read().count() == 0
    t.merge(rows(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")), ["day", "k"])
    before = {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/t/data").rglob("*.parquet")}
    t.merge(rows(spark, (2, 1, "C"), (2, 9, "n"), (4, 1, "e")), ["day", "k"])
    assert content(t.read()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "C"), (2, 9, "n"), (3, 1, "d"), (4, 1, "e")]
    assert before.items() <= {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/t/data").rglob("*.parquet")}.items()
    files = {f.split("/")[-2] for f in t.read().inputFiles()}
    assert files == {f"_day=2024-01-0{d}" for d in (1, 2, 3, 4)}
    assert content(t.read(version=1)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")]
    assert content(t.read(datetime.date(2024, 1, 2), datetime.date(2024, 1, 3))) == [(2, 1, "C"), (2, 9, "n"), (3, 1, "d")]
    assert len(t.read(datetime.date(2024, 1, 4)).inputFiles()) == 1
    assert t.clean(keep=1) == 1 and content(t.read()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "C"), (2, 9, "n"), (3, 1, "d"), (4, 1, "e")]


def test_null_days_and_days_that_go(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, (None, 1, "x"), (1, 1, "a")), ["day", "k"])
    t.merge(rows(spark, (None, 1, "y")), ["day", "k"])
    assert set(content(t.read())) == {(None, 1, "y"), (1, 1, "a")}
    t.replace(["2024-01-01"], rows(spark), t.version())
    assert content(t.read()) == [(None, 1, "y")]
    with pytest.raises(ValueError, match="other days"):
        t.replace(["2024-01-02"], rows(spark, (3, 1, "a")), t.version())


def test_a_second_writer_is_refused(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, (1, 1, "a")), ["day", "k"])
    other = table(spark, tmp_path)
    t.merge(rows(spark, (1, 2, "b")), ["day", "k"])
    with pytest.raises(Refused):
        other.replace(["2024-01-01"], rows(spark, (1, 9, "z")), version=1)
    assert content(t.read()) == [(1, 1, "a"), (1, 2, "b")]


def test_readers_never_find_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, *[(d, 1, "0") for d in range(1, 5)]), ["day", "k"])
    seen, failures, stop = [], [], threading.Event()

    def look():
        while not stop.is_set():
            try:
                seen.append({r.v for r in table(spark, tmp_path).read().collect()} and table(spark, tmp_path).read().count())
            except Exception as e:
                failures.append(e)
            time.sleep(0.01)

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(1, 5):
        t.merge(rows(spark, *[(d, 1, str(k)) for d in range(1, 5)]), ["day", "k"])
    stop.set()
    reader.join()
    assert not failures and set(seen) == {4}


def test_only_new_days_are_read(spark, tmp_path, sf_dir):
    tables = Tables(spark, sf_dir)
    days = [r.date for r in tables.chain.select("date").distinct().orderBy("date").collect()]
    stored = refresh.Summaries(spark, f"{tmp_path}/s")
    chain = daily_folders(tables)
    stored.refresh(chain, days[:-1])
    # With the files of the other days gone, only a run that does not open them succeeds.
    for f in chain.inputFiles():
        if str(days[-1]) not in f:
            Path(f.removeprefix("file://")).write_bytes(b"gone")
    assert stored.missing(days) == days[-1:]
    stored.refresh(chain, stored.missing(days))
    want = views.symbol_summary(tables.chain)
    got = stored.symbols()
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, stored.daily_iv().collect())) == sorted(map(tuple, views.daily_iv_summary(tables.chain).collect()))


def test_the_sketch_keeps_its_error(spark, tmp_path):
    days = [datetime.date(2024, 1, d) for d in range(1, 9)]
    chain = spark.range(80_000).select(F.expr("date_add(date'2024-01-01', cast(id % 8 as int))").alias("date"), F.lit("A").alias("act_symbol"), ((F.col("id") * 7919) % 80_000).cast("double").alias("vol"))
    stored = refresh.Summaries(spark, f"{tmp_path}/s")
    for part in (days[:3], days[3:5], days[5:]):
        stored.refresh(chain, part)
    assert abs(stored.symbols().first().median_iv / 80_000 - 0.5) <= refresh.SKETCH_ERROR


def scans(spark, df):
    """(text, files read) of the scans of a plan, after it has run."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = len(df.collect())
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = [leaves.apply(k) for k in range(leaves.size())]
        return n, [(x.toString(), x.metrics().get("numFiles").get().value()) for x in found]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_computed_dates_prune_folders(spark, sf_dir):
    chain = daily_folders(Tables(spark, sf_dir))
    everything = len(chain.inputFiles())
    for make, least in ((lambda: views.recent(chain, 7), 8), (lambda: views.latest(chain, "SYM3"), 1)):
        n, [(text, files)] = scans(spark, make())
        assert n > 0 and "subquery" in text.split("PartitionFilters: [")[1].split("]")[0]
        assert least <= files < everything / 2
