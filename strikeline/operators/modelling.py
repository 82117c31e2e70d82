"""Features, training frames, boosted expected-move models with conformal bands, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strikeline.operators import boosting

#: Where a label table may have its target, in order of preference.
TARGETS = ("realized_move", "realized", "em_realized", "target")


def target_column(columns: Sequence[str], candidates: Sequence[str] = TARGETS) -> str | None:
    return next((c for c in candidates if c in columns), None)


def training_frame(features: DataFrame, labels: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], str]:
    """Keys, numeric features and target of rows in both tables; which columns are features, which the target."""
    target = target_column(labels.columns)
    if target is None:
        raise ValueError(f"labels have none of {TARGETS}")
    joined = features.join(labels.select(*keys, F.col(target).alias("_target")), keys)
    numeric = [f.name for f in features.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return joined.select(*keys, *numeric, F.col("_target").cast("double").alias("target")).filter("target is not null"), numeric, target


def latest_features(features: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """All rows of each underlying's newest time."""
    rows = features.filter(F.col("underlying").isin(symbols)) if symbols else features
    newest = rows.groupBy("underlying").agg(F.max("quote_ts").alias("quote_ts"))
    return rows.join(newest, ["underlying", "quote_ts"], "left_semi")


def atm_features(legs: DataFrame, chain: DataFrame) -> DataFrame:
    """Per symbol and expiration: straddle, 25-delta risk reversal and butterfly, and the at-the-money vol.

    legs are at-the-money rows with structs call and put; the 25-delta legs are those whose |delta| is nearest to 0.25.
    """
    near = lambda side: F.min_by(F.when(F.col("call_put") == side, F.col("vol")), F.when((F.col("call_put") == side) & F.col("vol").isNotNull(), F.struct(F.abs(F.abs("delta") - 0.25), "strike", "id")))
    wings = chain.groupBy("act_symbol", "expiration").agg(near("C").alias("call_25"), near("P").alias("put_25"))
    iv = (F.col("call.iv") + F.col("put.iv")) / 2
    rows = legs.join(wings, ["act_symbol", "expiration"], "left")
    return rows.select("act_symbol", "expiration", (F.col("call.mid") + F.col("put.mid")).alias("straddle"), (F.col("call_25") - F.col("put_25")).alias("risk_reversal"), ((F.col("call_25") + F.col("put_25")) / 2 - iv).alias("butterfly"))


def performance(scored: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, errors and pinball losses of forecasts (em, bands) against `realized`."""
    y = F.col("realized")
    inside = lambda lo, hi: F.avg(F.when(y.between(F.col(lo), F.col(hi)), 1.0).otherwise(0.0))
    pinball = lambda c, q: F.when(y >= F.col(c), q * (y - F.col(c))).otherwise((1 - q) * (F.col(c) - y))
    return scored.groupBy(*by).agg(
        inside("band68_low", "band68_high").alias("coverage_68"),
        inside("band95_low", "band95_high").alias("coverage_95"),
        F.avg(F.abs(y - F.col("em_baseline"))).alias("mae"),
        F.avg(F.try_divide(F.abs(y - F.col("em_baseline")), F.abs(y))).alias("mape"),
        F.avg((pinball("band68_low", 0.16) + pinball("band68_high", 0.84)) / 2).alias("pinball_68"),
        F.avg((pinball("band95_low", 0.025) + pinball("band95_high", 0.975)) / 2).alias("pinball_95"),
    )


class BandModel:
    """A gradient-boosted mean with bands from residual quantiles of rows kept out of the fit (split conformal).

    This is another estimator than five quantile models: Spark's boosting has no quantile loss. Bands are per horizon.
    """

    QUANTILES = {"band68_low": 0.16, "band68_high": 0.84, "band95_low": 0.025, "band95_high": 0.975}

    def __init__(self, pipeline, bands: DataFrame):
        self.pipeline, self.bands = pipeline, bands

    @classmethod
    def fit(cls, frame: DataFrame, features: list[str], time: str = "quote_ts", part: float = 0.85, trees: int = 20, depth: int = 4) -> BandModel:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        early, late = boosting.early(frame, time, part)
        stages = [VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), GBTRegressor(featuresCol="_features", labelCol="target", predictionCol="em", maxIter=trees, maxDepth=depth, seed=42)]
        pipeline = Pipeline(stages=stages).fit(early.fillna(0.0, features))
        kept = pipeline.transform(late.fillna(0.0, features))
        residual = F.percentile_approx(F.col("target") - F.col("em"), F.array(*[F.lit(q) for q in cls.QUANTILES.values()]), boosting.ACCURACY)
        bands = kept.groupBy("horizon").agg(residual.alias("q")).select("horizon", *[F.col("q")[k].alias(f"_{b}") for k, b in enumerate(cls.QUANTILES)])
        return cls(pipeline, bands)

    def predict(self, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
        scored = self.pipeline.transform(rows.fillna(0.0, features)).join(F.broadcast(self.bands), "horizon", "left")  # a row a horizon
        return scored.select(*keys, "em", *[(F.col("em") + F.col(f"_{b}")).alias(b) for b in self.QUANTILES])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/mean")
        self.bands.write.mode("overwrite").parquet(f"{path}/bands")

    @classmethod
    def load(cls, spark, path: str) -> BandModel:
        from pyspark.ml import PipelineModel

        return cls(PipelineModel.load(f"{path}/mean"), spark.read.parquet(f"{path}/bands"))


def term_slope(ivs: DataFrame, by: list[str]) -> DataFrame:
    """The slope of iv over days to expiry."""
    return ivs.groupBy(*by).agg(F.regr_slope("iv", "dte").alias("slope"))


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
