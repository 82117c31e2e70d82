"""Writing: partitioned exports, keyed merges into a Parquet table, checks of what was written."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.sources.readers import exists


def narrow(df: DataFrame) -> DataFrame:
    """The export's smaller types: float and int numbers, dates and times; what does not fit becomes null."""
    kinds = {"double": "float", "bigint": "int", "decimal": "float"}
    return df.select(*[F.col(c).try_cast(kinds[k]).alias(c) if (k := t.split("(")[0]) in kinds else F.col(c) for c, t in df.dtypes])


def export(df: DataFrame, path: str, by: list[str], order: list[str], compression: str = "snappy", skip_existing: bool = False, row_group_bytes: int | None = None) -> int:
    """Write by partition, sorted inside the files; rows of partitions that are there are left out or replace them.

    Rows of one partition meet in as many tasks as their number asks for (a rebalance splits large ones).
    """
    spark = df.sparkSession
    if skip_existing and exists(spark, path):
        there = spark.read.parquet(path).select(*[F.col(c).cast(dict(df.dtypes)[c]).alias(c) for c in by]).distinct()
        df = df.join(there, by, "left_anti")
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, *order).write.partitionBy(*by).option("compression", compression)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        writer.mode("append" if skip_existing else "overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return _rows(seen)


def _rows(seen: Observation) -> int:
    """The observed count. A plan that Spark finds to be empty before it runs observes nothing, which the session reports as an
    error."""
    try:
        return seen.get["rows"]
    except Py4JJavaError as e:
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def export_chain(chain: DataFrame, path: str, **options) -> int:
    dated = chain.withColumns({"year": F.year("date"), "month": F.month("date")})
    return export(dated, path, ["year", "month"], ["date", "act_symbol", "strike"], **options)


def export_volatility(vol: DataFrame, path: str, **options) -> int:
    return export(vol.withColumn("year", F.year("date")), path, ["year"], ["date", "symbol"], **options)


def export_table(df: DataFrame, path: str) -> None:
    """A whole table in the order of its first column, over as many files as its size asks for."""
    df.orderBy(df.columns[0]).write.mode("overwrite").option("compression", "snappy").parquet(path)


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in ranges of the keys, sorted inside: written out, the files follow each other in order. A frequent first key takes as
    many tasks as its rows ask for."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def positions(df: DataFrame) -> DataFrame:
    """Rows of written files with `position`, their place from 1 in the order of the files' names and of the rows in them."""
    placed = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(files, "_file").withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def clean_quotes(chain: DataFrame) -> DataFrame:
    """Quotes fit for modelling, with mid and days to expiry, keyed for the per-symbol layout."""
    good = chain.filter("bid > 0 and ask > bid and vol > 0")
    return good.select(
        F.col("date").alias("quote_ts"),
        F.col("expiration").alias("exp_date"),
        F.col("call_put").alias("callput"),
        "strike",
        ((F.col("bid") + F.col("ask")) / 2).alias("contract_price"),
        *["bid", "ask", "delta", "gamma", "theta", "vega"],
        F.col("vol").alias("iv"),
        "volume",
        "open_interest",
        F.datediff("expiration", "date").alias("dte"),
        F.col("act_symbol").alias("underlying"),
        F.year("date").alias("quote_year"),
        F.month("date").alias("quote_month"),
    )


def keyed_union(old: DataFrame, new: DataFrame, keys: list[str], within: list[Column] | None = None) -> DataFrame:
    """All rows of both, the new one where a key is in both; among rows of one side the last by `within`."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_batch"), *[c.desc() for c in within or []]]
    last = Window.partitionBy(*keys).orderBy(*order)
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_batch")


def upsert(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Merge rows into a Parquet table and return what it then holds.

    The merged table is written beside the old one and renamed into its place, as Spark cannot overwrite what it reads; a
    reader between the two renames finds no table.
    """
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], new.schema)
    fresh, aside = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    keyed_union(old, new, keys).sortWithinPartitions(*keys).write.option("compression", "snappy").parquet(fresh)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(aside))
    files.rename(at(fresh), at(path))
    files.delete(at(aside), True)
    return spark.read.parquet(path)


def reconcile(source: DataFrame, written: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group on both sides, and whether they differ."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = count(source, "source_rows").join(count(written, "written_rows"), by, "full_outer")
    both = both.select(*by, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("source_rows", "written_rows")])
    return both.withColumn("mismatch", F.col("source_rows") != F.col("written_rows"))


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a materialised table by the rows of df; at the path, or in the warehouse."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_metadata(spark: SparkSession, path: str, **facts) -> None:
    spark.createDataFrame([tuple(map(str, facts.values()))], ", ".join(f"`{k}` string" for k in facts)).coalesce(1).write.mode("overwrite").json(path)


def write_schema(spark: SparkSession, path: str, tables: list[str]) -> None:
    """A line of text for each table: its name, and its columns in order with their types."""
    lines = [(f"{t} ({', '.join(f'{c} {k}' for c, k in spark.table(t).dtypes)})",) for t in tables]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", batch: int = 100, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()


def upsert_jdbc(new: DataFrame, url: str, table: str, staging: str, keys: list[str], **options: str) -> DataFrame:
    """Merge rows with a database table into a staging table beside it, which the database then swaps in; what it holds."""
    from strikeline.sources.readers import jdbc

    write_jdbc(keyed_union(jdbc(new.sparkSession, url, table, **options), new, keys), url, staging, **options)
    return jdbc(new.sparkSession, url, staging, **options)
