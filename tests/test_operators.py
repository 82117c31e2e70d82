"""Semantics at the edges: ties, zero as missing, thin markets, flat ranges, models."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strikeline.operators import chain as chains
from strikeline.operators import expected_move as em
from strikeline.operators import ivstats, merging, modelling, quality, views
from strikeline.plans.fixtures import Tables

C = F.col
CHAIN = "id long, act_symbol string, date string, expiration string, strike double, call_put string, bid double, ask double, vol double, volume long, spot double"


def quotes(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], CHAIN).withColumns({c: C(c).cast("date") for c in ("date", "expiration")})


def test_atm_tie_goes_to_the_lower_strike(spark):
    rows = [("A", "2024-01-02", "2024-02-02", k, s, 1.0, 2.0, 0.2, 50, 100.0) for k in (95.0, 105.0) for s in "CP"]
    assert em.atm(em.two_legged(quotes(spark, *rows))).first().strike == 95.0


def test_expected_move_by_hand(spark):
    rows = [("A", "2024-01-02", "2024-02-02", 100.0, "C", 3.0, 3.2, 0.0, 60, 100.0), ("A", "2024-01-02", "2024-02-02", 100.0, "P", 2.9, 3.1, 0.25, 60, 100.0)]
    got = em.expected_moves(quotes(spark, *rows), F.lit("2024-01-03").cast("date")).first()
    assert got.iv == 0.25  # a leg at zero has no volatility
    assert got.straddle_abs == pytest.approx(6.1)
    assert got.iv_abs == pytest.approx(100 * 0.25 * (30 / 365) ** 0.5)
    assert (got.straddle_confidence, got.iv_confidence) == ("high", "medium")


@pytest.mark.parametrize(("volume", "days", "level"), [(200, 60, "high"), (50, 60, "high"), (2, 60, "low"), (200, 3, "medium")])
def test_straddle_confidence(spark, volume, days, level):
    leg = F.struct(F.lit(1.0).alias("bid"), F.lit(1.02).alias("ask"), F.lit(1.01).alias("mid"), F.lit(volume // 2).alias("volume"))
    assert spark.range(1).select(em.straddle_confidence(leg, leg, F.lit(days / 365))).first()[0] == level


def test_one_leg_is_no_straddle(spark):
    rows = [("A", "2024-01-02", "2024-02-02", 100.0, "C", 3.0, 3.2, 0.2, 60, 100.0)]
    assert em.two_legged(quotes(spark, *rows)).count() == 0


def test_baseline_without_expirations(spark):
    vol = spark.createDataFrame([("A", "2024-01-02", 0.3), ("A", "2024-01-03", None)], "symbol string, date string, iv double").withColumn("date", C("date").cast("date"))
    rows = em.baseline_forecasts(vol, quotes(spark), F.lit("2024-01-05").cast("date")).collect()
    assert sorted((r.horizon, str(r.exp_date)) for r in rows) == [("1d", "2024-01-12"), ("5d", "2024-01-12"), ("to_exp", "2024-01-12")]
    assert {r.horizon: r.em_baseline for r in rows}["to_exp"] == pytest.approx(0.2 * (7 / 365) ** 0.5)  # the newest iv is null


def test_iv_stats_of_a_flat_history(spark):
    vol = spark.createDataFrame([("A", 0.2), ("A", 0.2), ("A", 50.0)], "symbol string, iv double")
    got = ivstats.iv_stats(vol, spark.createDataFrame([("A", 0.2)], "symbol string, current double")).first()
    assert (got["rank"], got.percentile, got.days, got.std_iv) == (0.5, 100.0, 2, 0.0)


def test_short_trend_is_stable(spark):
    vol = spark.createDataFrame([("A", k, 0.1 * (k + 1)) for k in range(3)], "symbol string, date long, iv double")
    assert ivstats.trend(vol).first()[1:] == (0.0, "stable", "weak")
    assert ivstats.trend(vol, 3).first()[2:] == ("expanding", "strong")


def test_earnings_defaults_and_surprises(spark):
    rows = [("A", "2024-01-01", 1.0, 0.0, 10.0, 8.0), ("A", "2023-10-01", 1.0, 1.0, None, 8.0), ("A", "2024-05-01", None, None, None, None), ("A", "2024-06-01", None, 2.0, None, None)]
    events = spark.createDataFrame(rows, "symbol string, date string, eps double, eps_estimated double, revenue double, revenue_estimated double").withColumn("date", C("date").cast("date"))
    as_of = F.lit("2024-02-01").cast("date")
    got = {str(r.date): r for r in chains.surprises(chains.past_events(events, as_of)).collect()}
    assert (got["2024-01-01"].eps_percent, got["2024-01-01"].revenue_percent) == (None, 25.0)
    assert (got["2023-10-01"].eps_percent, got["2023-10-01"].revenue_surprise) == (None, None)
    stats = chains.earnings_stats(spark.createDataFrame([("A",), ("B",)], "symbol string"), chains.surprises(chains.past_events(events, as_of)))
    assert {r.symbol: (r.beat_rate, r.avg_revenue_beat) for r in stats.collect()} == {"A": (0.5, 12.5), "B": (0.6, 0.0)}
    assert [str(r.date) for r in chains.coming_events(events, as_of).orderBy("place").collect()] == ["2024-06-01", "2024-05-01"]


def test_merge_predictions_modes(spark):
    keys = "underlying string, exp_date string, horizon string, quote_ts int"
    rows = spark.createDataFrame([("A", "x", "1d", 9, 1.0)], keys + ", band double")
    found = spark.createDataFrame([("A", "x", "1d", 3, 5.0), ("A", "x", "1d", 4, None)], keys + ", band double")
    assert merging.merge_predictions(rows, found, ["band"]).first().band == 1.0  # the newest has none
    assert merging.merge_predictions(rows, found.filter("quote_ts = 3"), ["band"]).first().band == 5.0
    assert merging.merge_predictions(rows, found, ["band"], exact_ts=True).first().band == 1.0


def test_source_priority_and_lists(spark):
    a, b = (spark.createDataFrame(r, "symbol string, price double") for r in ([("A", 0.0), ("B", 2.0)], [("A", 3.0), ("B", 4.0)]))
    assert {r.symbol: (r.price, r.source) for r in merging.by_priority([a, b], "symbol", C("price") > 0).collect()} == {"A": (3.0, 1), "B": (2.0, 0)}
    assert merging.rejected_additions(a, b, "symbol").count() == 2


def test_age_buckets(spark):
    got = spark.createDataFrame([("2024-01-01", d) for d in ("2024-01-01", "2023-01-01", "2022-12-31", "2020-01-01")], "a string, d string")
    assert [r[0] for r in got.select(views.age_bucket(C("d").cast("date"), C("a").cast("date"))).collect()] == [1, 1, 2, 5]


def test_validation_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("A", -1.0)], "s string, iv double")
    got = quality.validated(df, *quality.symbol_rules(C("s")), ("iv", "must be positive", quality.optional(C("iv"), C("iv") > 0))).collect()
    assert [len(r.errors) for r in got] == [2, 1]
    assert got[1].errors == ["iv: must be positive"]


def test_symbol_search(spark):
    names = spark.createDataFrame([("AA", "Alpha"), ("AAB", "Beta"), ("BAA", "Gamma"), ("X", "Has aa"), ("Y", None)], "symbol string, name string")
    assert [r.symbol for r in quality.search_symbols(names, " aa ", 99).collect()] == ["AA", "AAB", "BAA", "X"]


def test_band_model_round_trip(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    keys = ["underlying", "quote_ts", "exp_date", "horizon"]
    labels = t.em.select(*keys, (C("em_baseline") * 2).alias("realized_move"))
    frame, features, target = modelling.training_frame(t.em.select(*keys, "em_baseline"), labels, keys)
    assert (features, target) == (["em_baseline"], "realized_move")
    model = modelling.BandModel.fit(frame, features, trees=4, depth=3)
    model.save(f"{tmp_path}/m")
    rows = modelling.latest_features(t.em.select(*keys, "em_baseline"))
    first, again = (sorted(map(tuple, m.predict(rows, features, keys).collect())) for m in (model, modelling.BandModel.load(spark, f"{tmp_path}/m")))
    assert first == again and all(r[5] <= r[6] for r in first)
    assert modelling.target_column(["a"]) is None


def test_capped_report_limits_before_the_shuffle(spark, sf_dir):
    from strikeline.operators.views import progressive

    tables = Tables(spark, sf_dir)
    plan = progressive(tables.chain, tables.as_of)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == 2


def test_price_reactions(spark):
    from strikeline.operators.chain import price_reactions

    events = spark.createDataFrame([("A", "2024-01-03"), ("A", "2024-01-09"), (None, "2024-01-03")], "symbol string, date string").withColumn("date", F.col("date").cast("date"))
    prices = spark.createDataFrame([("A", "2024-01-02", 8.0), ("A", "2024-01-04", 10.0), ("A", "2024-01-08", 0.0), ("A", "2024-01-10", 1.0)], "symbol string, date string, spot double").withColumn("date", F.col("date").cast("date"))
    got = sorted(tuple(r)[2:] for r in price_reactions(events, prices).collect() if r.symbol)
    assert got == [(0.0, 1.0, None), (8.0, 10.0, 25.0)]
