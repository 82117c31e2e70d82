"""Keyed merges of stores, choices between sources, and list maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_source_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both stores, the first one's where a key is in both."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    one = Window.partitionBy(*keys).orderBy("_source")
    return both.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "_source")


def freshest(first: DataFrame, second: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The row with the latest time per key; the second source's where both have it."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("_source"))
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_source")


def by_priority(sources: list[DataFrame], key: str, usable: Column) -> DataFrame:
    """The first source with a usable row for each key; source tells which."""
    out = None
    for k, df in enumerate(sources):
        part = df.filter(usable).withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy(key).orderBy("source")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def add_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old, key, "left_anti"))


def rejected_additions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_semi")


def toggle(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Remove the rows of changes that are there, add those that are not."""
    return old.join(changes, key, "left_anti").unionByName(changes.join(old, key, "left_anti"))


def update_fields(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the fields of changes that are not null."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    joined = old.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c != key and f"_{c}" in joined.columns else F.col(c) for c in old.columns])


def merge_predictions(rows: DataFrame, predictions: DataFrame, bands: list[str], exact_ts: bool = False) -> DataFrame:
    """Bands from the predictions where there are any, each falling back to the baseline's.

    Forecasts are made later than the features that predictions rest on, so by default the newest prediction per
    underlying, expiration and horizon is taken; with exact_ts the times must be equal.
    """
    keys = ["underlying", "exp_date", "horizon"] + (["quote_ts"] if exact_ts else [])
    newest = Window.partitionBy(*keys).orderBy(F.desc("quote_ts"))
    latest = predictions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    latest = latest.select(*keys, *[F.col(b).alias(f"_{b}") for b in bands])
    joined = rows.join(latest, keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in bands else F.col(c) for c in rows.columns])
