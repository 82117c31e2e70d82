"""Reading option histories: partitioned Parquet in either column naming, forecast files, landed JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAIN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("act_symbol", T.StringType()),
        T.StructField("expiration", T.DateType()),
        T.StructField("strike", T.DoubleType()),
        T.StructField("call_put", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "vol", "delta", "gamma", "theta", "vega")],
        T.StructField("open_interest", T.LongType()),
        T.StructField("volume", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
VOLATILITY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("iv", "hv", "iv_rank", "iv_percentile")],
        T.StructField("created_at", T.TimestampType()),
    ]
)
FORECASTS = T.StructType(
    [
        T.StructField("underlying", T.StringType()),
        T.StructField("quote_ts", T.TimestampType()),
        T.StructField("exp_date", T.DateType()),
        T.StructField("horizon", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("em_baseline", "band68_low", "band68_high", "band95_low", "band95_high")],
        T.StructField("created_at", T.TimestampType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType, partitions: dict[str, str] | None = None) -> DataFrame:
    """Columns of the schema by name, or by number where the files name them "0", "1", ...; what cannot be cast is null and
    what is missing too. Partition columns are exposed under the given names as integers."""
    out = []
    for k, field in enumerate(schema):
        source = field.name if field.name in df.columns else str(k) if str(k) in df.columns else None
        value = F.lit(None) if source is None else F.col(f"`{source}`")
        out.append((value.try_cast(field.dataType) if source else value.cast(field.dataType)).alias(field.name))
    return df.select(*out, *[F.col(c).cast("int").alias(n) for c, n in (partitions or {}).items()])


def partitioned(spark: SparkSession, root: str, files: str) -> DataFrame:
    """Files matching a name pattern anywhere below root, columns united by name, Hive directories as columns."""
    return spark.read.option("mergeSchema", True).option("pathGlobFilter", files).option("basePath", root).parquet(root)


def option_chain(spark: SparkSession, root: str) -> DataFrame:
    return conform(partitioned(spark, root, "options_*.parquet"), CHAIN, {"year": "partition_year", "month": "partition_month"})


def volatility_history(spark: SparkSession, root: str) -> DataFrame:
    return conform(partitioned(spark, root, "volatility_*.parquet"), VOLATILITY, {"year": "partition_year"})


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast files; nanosecond times, which Spark does not read as such, come out in microseconds."""
    key = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df = spark.read.parquet(path)
        for name, kind in df.dtypes:
            if kind == "bigint" and name in ("quote_ts", "created_at"):
                df = df.withColumn(name, F.expr(f"timestamp_micros(`{name}` div 1000)"))
        return conform(df, FORECASTS)
    finally:
        spark.conf.set(key, before)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def register_views(spark: SparkSession, root: str, names: tuple[str, ...]) -> list[str]:
    """A temporary view for each single-file table below root that is there; the names of those made."""
    made = [n for n in names if exists(spark, f"{root}/{n}.parquet")]
    for n in made:
        (forecasts(spark, f"{root}/{n}.parquet") if n == "em_forecasts" else spark.read.parquet(f"{root}/{n}.parquet")).createOrReplaceTempView(n)
    return made


def date_between(df: DataFrame, low, high, column: str = "date") -> DataFrame:
    """A date range with the partition predicate that follows from it, so that whole months are never opened."""
    low, high = (F.lit(x).cast("date") for x in (low, high))
    out = df.filter(F.col(column).between(low, high))
    month = lambda d: F.year(d) * 12 + F.month(d)
    if "partition_month" in df.columns:
        out = out.filter((F.col("partition_year") * 12 + F.col("partition_month")).between(month(low), month(high)))
    elif "partition_year" in df.columns:
        out = out.filter(F.col("partition_year").between(F.year(low), F.year(high)))
    return out


def symbols_from_partitions(df: DataFrame, column: str = "underlying", limit: int = 5) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(limit)


def file_summary(df: DataFrame) -> DataFrame:
    """Rows and bytes of each file behind a table."""
    meta = F.col("_metadata")
    return df.groupBy(meta.file_name.alias("file")).agg(F.count("*").alias("rows"), F.max(meta.file_size).alias("bytes"))


QUOTE = "ask double, ask_size bigint, bid double, bid_size bigint, exchange bigint, last_updated bigint, midpoint double"
SNAPSHOT = f"""break_even_price double,
day struct<change double, change_percent double, close double, high double, last_updated bigint, low double, open double, previous_close double, volume bigint, vwap double>,
details struct<contract_type string, exercise_style string, expiration_date date, shares_per_contract bigint, strike_price double, ticker string>,
fmv double, greeks struct<delta double, gamma double, theta double, vega double>, implied_volatility double, last_quote struct<{QUOTE}>,
last_trade struct<conditions array<bigint>, exchange bigint, price double, sip_timestamp bigint, size bigint, timeframe string>, open_interest bigint,
underlying_asset struct<change_to_break_even double, last_updated bigint, market_status string, price double, ticker string, timeframe string, value double>""".replace("\n", " ")
REFERENCE = "contract_type string, exercise_style string, expiration_date date, shares_per_contract bigint, strike_price double, ticker string, underlying_ticker string, primary_exchange string, cfi string"


def landed(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of landed payloads {results: [...]}; all pages that were landed, not only the first."""
    return spark.read.schema(f"results array<struct<{row}>>").json(path).select(F.explode("results").alias("r")).select("r.*")


def contract_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return landed(spark, path, SNAPSHOT)


def contract_reference(spark: SparkSession, path: str, contract_type: str | None = None, expiration: str | None = None) -> DataFrame:
    df = landed(spark, path, REFERENCE)
    df = df.filter(F.col("contract_type") == contract_type) if contract_type else df
    return df.filter(F.col("expiration_date") == F.lit(expiration).cast("date")) if expiration else df


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def csv_summary(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.agg(F.count("*").alias("rows"), F.min(F.col(date).try_cast("date")).alias("first_date"))


def quote_from_bar(bars: DataFrame) -> DataFrame:
    """Price, change and change in per cent of a previous-day bar; an open of 0 or null counts as 1 in the percentage."""
    start = F.coalesce(F.nullif("o", F.lit(0.0)), F.lit(1.0))
    return bars.select("symbol", F.col("c").alias("price"), (F.col("c") - F.col("o")).alias("change"), ((F.col("c") - F.col("o")) / start * 100).alias("change_percent"), F.col("v").alias("volume"))


def describe(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table, position, column, type) of the session's tables."""
    rows = [(t, k, f.name, f.dataType.simpleString()) for t in tables for k, f in enumerate(spark.table(t).schema)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def tables_like(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of the session's tables and views that match a pattern of SHOW TABLES, such as 'options_chain_*'."""
    return spark.sql(f"SHOW TABLES LIKE '{pattern.replace(chr(39), '')}'").select(F.col("tableName").alias("table"))


def described(spark: SparkSession, tables: list[str]) -> DataFrame:
    """As `describe`, with how many rows have a value in each column: one run over each table."""
    out = None
    for t in tables:
        df = spark.table(t)
        counts = df.agg(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])).alias("n"))
        filled = counts.select(F.explode("n").alias("column", "filled"))
        part = describe(spark, [t]).join(filled, "column")
        out = part if out is None else out.unionByName(part)
    return out


def table_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """(table, rows) of the session's tables that match a pattern."""
    names = [r.table for r in tables_like(spark, pattern).collect()]  # names of the catalogue
    out = None
    for n in names:
        part = spark.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "table string, rows long") if out is None else out
