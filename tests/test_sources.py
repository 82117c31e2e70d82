from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strikeline.plans.fixtures import Tables
from strikeline.sources import readers, sinks

C = F.col


def test_chain_round_trip_prunes_partitions(spark, sf_dir, tmp_path):
    chain = Tables(spark, sf_dir).chain.drop("spot").withColumn("created_at", C("created_at").cast("timestamp"))
    path = f"{tmp_path}/chain"
    n = sinks.export_chain(chain, path, compression="zstd")
    back = spark.read.parquet(path)
    back = readers.conform(back, readers.CHAIN, {"year": "partition_year", "month": "partition_month"})
    assert back.count() == n == chain.count()
    assert not back.select(chain.columns).exceptAll(chain).count()
    ranged = readers.date_between(back, "2024-01-03", "2024-01-04")
    assert ranged.count() == chain.filter("date between date'2024-01-03' and date'2024-01-04'").count()
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert not sinks.reconcile(chain, back, ["date"]).filter("mismatch").count()
    assert sinks.export_chain(chain, path, skip_existing=True) == 0
    assert spark.read.parquet(path).count() == n


def test_numbered_columns(spark, tmp_path):
    pq.write_table(pa.table({"0": [1], "1": ["2024-01-02"], "2": ["AAPL"], "3": [0.25]}), f"{tmp_path}/volatility_2024.parquet")
    got = readers.conform(spark.read.parquet(str(tmp_path)), readers.VOLATILITY).first()
    assert (got.id, str(got.date), got.symbol, got.iv, got.hv) == (1, "2024-01-02", "AAPL", 0.25, None)


def test_hive_chain(spark, tmp_path):
    folder = tmp_path / "year=2024" / "month=01"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"id": [1], "date": ["2024-01-02"], "strike": ["oops"]}), folder / "options_a.parquet")
    pq.write_table(pa.table({"id": [2], "act_symbol": ["X"], "strike": ["12.5"]}), folder / "options_b.parquet")
    pq.write_table(pa.table({"id": [3]}), folder / "other.parquet")
    rows = sorted(readers.option_chain(spark, str(tmp_path)).collect(), key=lambda r: r.id)
    assert [(r.id, r.act_symbol, r.strike, r.partition_year, r.partition_month) for r in rows] == [(1, None, None, 2024, 1), (2, "X", 12.5, 2024, 1)]


def test_nanosecond_forecasts(spark, tmp_path):
    path = f"{tmp_path}/em_forecasts.parquet"
    pq.write_table(pa.table({"underlying": ["A"], "quote_ts": pa.array([1_704_153_600_000_000_123], pa.timestamp("ns")), "horizon": ["1d"]}), path)
    assert str(readers.forecasts(spark, path).first().quote_ts) == "2024-01-02 00:00:00"
    assert readers.register_views(spark, str(tmp_path), ("em_forecasts", "atm_features")) == ["em_forecasts"]
    assert spark.sql("SELECT count(*) FROM em_forecasts").first()[0] == 1


def test_upsert_is_idempotent(spark, sf_dir, tmp_path):
    em, path, keys = Tables(spark, sf_dir).em, f"{tmp_path}/em", ["underlying", "quote_ts", "exp_date", "horizon"]
    first = sinks.upsert(em, path, keys).count()
    changed = em.limit(10).withColumn("em_baseline", F.lit(9.0))
    for _ in range(2):
        after = sinks.upsert(changed, path, keys)
        assert after.count() == first
        assert after.filter("em_baseline = 9.0").count() == 10


def test_landed_json(spark, tmp_path):
    row = {"details": {"contract_type": "call", "ticker": "O:A", "strike_price": 5.0, "expiration_date": "2024-02-02"}, "day": {"close": 0, "volume": 7}, "last_trade": {"price": 1.5, "sip_timestamp": 1_704_153_600_000_000_000}, "underlying_asset": {"price": 9.0, "ticker": "A"}}
    for page in range(2):
        (tmp_path / f"{page}.json").write_text(json.dumps({"results": [row], "next_url": "x"}))
    from strikeline.operators.chain import snapshot_contracts

    got = snapshot_contracts(readers.contract_snapshots(spark, str(tmp_path))).collect()
    assert len(got) == 2
    assert (got[0].call_put, got[0].last, got[0].bid, got[0].volume, str(got[0].traded_at)) == ("C", 1.5, 0.0, 7, "2024-01-02 00:00:00")


def test_reference_csv_and_catalog(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(json.dumps({"results": [{"contract_type": t, "ticker": t, "expiration_date": "2024-02-02"} for t in ("call", "put")]}))
    assert readers.contract_reference(spark, str(tmp_path / "c"), "put", "2024-02-02").first().ticker == "put"
    (tmp_path / "v.csv").write_text("date,iv\n2024-01-03,1\n2024-01-02,2\nbad,3\n")
    got = readers.csv_summary(spark, str(tmp_path / "v.csv")).first()
    assert (got.rows, str(got.first_date)) == (3, "2024-01-02")
    spark.range(3).createOrReplaceTempView("three")
    assert [tuple(r) for r in readers.describe(spark, ["three"]).collect()] == [("three", 0, "id", "bigint")]


def test_narrow_table_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x"), (1 << 40, None, None)], "a long, b double, c string")
    assert sinks.narrow(df).dtypes == [("a", "int"), ("b", "float"), ("c", "string")]
    assert sinks.narrow(df).collect()[1].a is None
    sinks.write_metadata(spark, f"{tmp_path}/meta", rows=2, tables="a")
    assert spark.read.json(f"{tmp_path}/meta").first().rows == "2"
    df.write.parquet(f"{tmp_path}/t")
    got = readers.file_summary(spark.read.parquet(f"{tmp_path}/t")).agg(F.sum("rows"), F.min("bytes")).first()
    assert got[0] == 2 and got[1] > 0


def test_jdbc_upsert(spark, sf_dir):
    url = f"jdbc:derby:memory:strikeline{id(spark)};create=true"
    em, keys = Tables(spark, sf_dir).em.filter("underlying < 'SYM3'"), ["underlying", "quote_ts", "exp_date", "horizon"]
    sinks.write_jdbc(em.withColumn("n", F.dayofmonth("quote_ts")), url, "forecasts")
    ranged = readers.jdbc(spark, url, "forecasts", "n", 1, 31, 4)
    assert ranged.rdd.getNumPartitions() == 4 and ranged.count() == em.count()
    changed = em.limit(5).withColumn("em_baseline", F.lit(9.0)).withColumn("n", F.lit(0))
    after = sinks.upsert_jdbc(changed, url, "forecasts", "forecasts_staging", keys)
    assert after.count() == em.count() and after.filter("em_baseline = 9.0").count() == 5
