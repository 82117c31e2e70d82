"""Tables in database files, by tasks that share nothing but a folder."""

from __future__ import annotations

import datetime
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from strikeline.session import scratch_path
from strikeline.sources import database
from strikeline.sources.database import Database

SCHEMA = "k long, day date, at timestamp, name string, x double, fine boolean"


def row(k, x, name="a'bé"):
    return (k, datetime.date(2024, 1, 1 + k % 28), datetime.datetime(2024, 1, 1, 0, 0, k % 60, 7), name, x, k % 2 == 0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_values_come_back_as_they_went(spark):
    rows = [row(1, 1.5), row(2, math.inf, None), (3, None, None, "", None, None), row(-(2**62), -0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    held = Database(spark, scratch_path(spark, "t"), "t", df.schema).create(df)
    assert held.rows().schema == df.schema and rows_of(held.rows()) == rows_of(df)
    odd = spark.createDataFrame([row(1, math.nan)], SCHEMA)
    assert math.isnan(Database(spark, scratch_path(spark, "t"), "t", df.schema).create(odd).rows().first().x)
    with pytest.raises(TypeError):
        Database(spark, scratch_path(spark, "t"), "t", spark.sql("SELECT array(1) AS a").schema)


@pytest.mark.parametrize("batch", [1, 100])
def test_upserts_touch_their_files_only(spark, monkeypatch, batch):
    monkeypatch.setattr(database, "ROWS", 50)
    old = spark.createDataFrame([row(k, 0.0) for k in range(500)], SCHEMA)
    held = Database(spark, scratch_path(spark, "t"), "t", old.schema, ["k", "day"], batch).create(old)
    before = {r._file for r in held.files.collect()}
    assert len(before) == 10
    held.upsert(spark.createDataFrame([row(7, 1.0), row(1000, 2.0)], SCHEMA))
    want = {k: 0.0 for k in range(500)} | {7: 1.0, 1000: 2.0}
    assert [(r.k, r.x) for r in held.rows().orderBy("k").collect()] == sorted(want.items())
    assert len(before & {r._file for r in held.files.collect()}) in (8, 9)
    held.upsert(old.limit(0))
    assert held.rows().count() == 501


def test_files_are_bounded_and_cannot_be_changed_by_a_query(spark, monkeypatch):
    monkeypatch.setattr(database, "ROWS", 40)
    df = spark.createDataFrame([row(k, 1.0) for k in range(200)], SCHEMA).coalesce(1)
    held = Database(spark, scratch_path(spark, "t"), "t", df.schema, batch=40).create(df)
    assert held.files.count() == 5
    assert [r.n for r in held.query("SELECT count(*) FROM t WHERE fine", "n long").collect()] == [20] * 5
    with pytest.raises(Exception, match="readonly"):
        held.query("DELETE FROM t RETURNING k", "k long").collect()
    assert held.rows().count() == 200


CLUSTER = """
import sys, tempfile
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession
import __spark_entry__ as entry
import compare

folder = tempfile.mkdtemp(prefix="spark-")
conf = {{"spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m", "spark.checkpoint.dir": "file://" + folder}}
spark = SparkSession.builder.master("local-cluster[2,1,900]").config(map=conf).getOrCreate()
con = compare.connect({data!r})
for name in ("snk09_database_merge", "src06_database_scan", "src07_database_read", "src09_local_history"):
    assert compare.spark_rows(entry.queries()[name](spark, {data!r})) == compare.sql_rows(con, entry.oracle_sql()[name]), name
print("all the same")
"""


def test_executors_that_are_processes_of_their_own(sf_dir, tmp_path):
    """A database in the memory of one process is not found by the others."""
    root = str(Path(__file__).resolve().parent.parent)
    (tmp_path / "run.py").write_text(CLUSTER.format(root=root, data=sf_dir))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], env=env, capture_output=True, text=True, timeout=600)
    assert "all the same" in done.stdout, done.stderr[-3000:]
