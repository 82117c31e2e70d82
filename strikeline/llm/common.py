"""Helpers shared by the corpus operators: shared scratch tables and byte-level tokenising of Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.session import scratch_path

#: Text bytes that a Python task works on at once, and rows that it is handed at once.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000
#: What a row costs in memory besides its text, so that many rows of short texts are bounded too.
ROW_BYTES = 64
#: A side is broadcast only when its values were measured and take no more bytes than this.
BROADCAST_BYTES = 48 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value: texts and binaries as they are, lists by their elements, other kinds 16."""
    value = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.lit(16) + F.coalesce(F.octet_length(F.array_join(value, "")), F.lit(0)) + 16 * F.greatest(F.size(value), F.lit(0))
    return F.lit(16)


def measured(df: DataFrame) -> int:
    """Bytes of all values of a written table, about."""
    row = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(ROW_BYTES))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its measured size allows, else df as it is (a shuffled join then). df should be a written
    table, as it is read once more."""
    return F.broadcast(df) if measured(df) <= BROADCAST_BYTES else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fewer_rows_a_batch(spark: SparkSession) -> None:
    """Rows with texts are long: unless the session has a number of its own, fewer of them than Spark's default go into an
    Arrow batch, which bounds the memory of both sides. The setting is read when a plan runs, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over rows with texts."""
    fewer_rows_a_batch(df.sparkSession)
    return df.mapInArrow(function, schema)


def _system_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Workers live on from stage to stage, and their allocators would keep all that the
    largest slice of any stage took."""
    pa.default_memory_pool().release_unused()
    if trim := _system_trim():
        trim(0)


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text and of its row."""
    return ROW_BYTES + np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a text column that hold about `limit` bytes each, or a single longer row."""
    ends, start = np.cumsum(_sizes(column)), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop - start
        start = stop


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of text and rows, or a single longer row."""
    for batch in batches:
        for start, n in cuts(batch.column(batch.schema.get_field_index(column)), limit):
            yield batch.slice(start, n)
        give_back()


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Put batches together until they hold `limit` bytes of text and rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(_sizes(batch.column(batch.schema.get_field_index(column))).sum())
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offset of each row (one more than rows). Null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def with_text_columns(docs: DataFrame, function: Callable[[pa.Array], list[pa.Array]], added: list[T.StructField]) -> DataFrame:
    """docs plus the added columns, which function gives for a slice of texts. Workers get the text alone; the rows stay with
    Spark, so no text comes back."""
    names = [f.name for f in added]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [pa.StructArray.from_arrays(function(texts.slice(start, n)), names=names) for start, n in cuts(texts, SLICE_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(function(texts), names=names)
            give_back()

    # Named so that a filter on a result is not pushed below it, which would work on every text twice.
    udf = F.arrow_udf(run, T.StructType(added), F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    fewer_rows_a_batch(docs.sparkSession)
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(F.struct(*kept).alias("row"), udf(F.col("text")).alias("added"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("added")[n].alias(n) for n in names])


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs for which no row of dropped has the values of these columns in its columns of those names; nulls are
    equal."""
    dropped = materialise(dropped.select(*keys).distinct(), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*[c.alias(k) for k, c in keys.items()]).alias("own"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"own.{k}").eqNullSafe(F.col(k))
    return rows.join(small(dropped), condition, "left_anti").select("row.*")


def text_digest(text: Column) -> Column:
    """128 bits of a text, null counting as empty: with doc_id, what tells rows apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def one_of_each(docs: DataFrame, keys: dict[str, Column], dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of docs without those that have the keys of a row of dropped, and a single one of those that share the keys
    of a row of repeated. The two have no keys in common."""
    rest = without(docs, dropped, keys)
    repeated = materialise(repeated.select(*keys).distinct(), "repeated")
    if repeated.isEmpty():
        return rest
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*[c.alias(k) for k, c in keys.items()]).alias("own"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"own.{k}").eqNullSafe(F.col(k))
    # Copies of a row combine before they move; of rows that differ in other columns the first in JSON stays.
    once = rows.join(small(repeated), same, "left_semi").groupBy("own").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return without(rest, repeated, keys).unionByName(once.select("row.*"))


def byte_table(word_bytes: set[int]) -> np.ndarray:
    """Maps A-Z to a-z, keeps word bytes and turns all others into 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if low in word_bytes:
            table[b] = low
    return table


class Words:
    """The words of a text column: `tokens` is a flat binary array, `first[i]` the number of words before row i."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        data, offsets = text_bytes(column)
        mapped = table[data]
        inside = mapped != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        opens[heads] = inside[heads]
        self.starts = np.flatnonzero(opens)
        compact = mapped[inside]
        # Bytes from one start to the next that belong to a word are its own: no array as long as the text is needed.
        lengths = np.add.reduceat(inside.view(np.uint8), self.starts, dtype=np.int32) if len(self.starts) else np.zeros(0, np.int32)
        ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
        self.tokens = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(compact))])
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def of(self, row: int) -> list[bytes]:
        return self.tokens.slice(self.first[row], self.counts[row]).to_pylist()
