"""A table in SQLite files in the folder that all executors share: tasks write, change and read a file each, so no database server
and no one machine's memory stands between them.

A table with keys is dealt over its files by their hash, and a merge is an INSERT ... ON CONFLICT DO UPDATE in the files that new
rows fall into; the others stay as they are. Without keys a task begins a new file after ROWS rows. Which files make up the table
is a Parquet table of names, so what failed or repeated tasks leave behind is never read. Dates are ISO texts, times microseconds,
NaN the text 'NaN', which SQLite too holds for greater than any number.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file when a table is made, and rows that are handed on at once.
ROWS = 50_000
PAGE = 10_000
FILES = "_shard int, _shards int, _file string"


def named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.IntegralType, T.BooleanType, T.TimestampType)):
        return "INTEGER"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "REAL"
    if isinstance(t, (T.StringType, T.DateType)):
        return "TEXT"
    raise TypeError(f"no column of a database file is a {t.simpleString()}")


def _stored(column: pa.Array) -> list:
    kind = column.type
    if pa.types.is_date(kind):
        return column.cast(pa.string()).to_pylist()
    if pa.types.is_timestamp(kind) or pa.types.is_boolean(kind):
        return column.cast(pa.int64()).to_pylist()
    values = column.to_pylist()
    return ["NaN" if v != v else v for v in values] if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py() else values


def _read(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_date(kind):
        return pa.array(values, pa.string()).cast(kind)
    if pa.types.is_timestamp(kind) or pa.types.is_boolean(kind):
        return pa.array(values, pa.int64()).cast(kind)
    if pa.types.is_floating(kind):
        return pa.array([float(v) if isinstance(v, str) else v for v in values], kind)
    return pa.array(values, kind)


def _pages(cursor: sqlite3.Cursor, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while rows := cursor.fetchmany(PAGE):
        yield pa.RecordBatch.from_arrays([_read(list(v), f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _writer(root: str, table: str, schema: T.StructType, keys: list[str], shards: int | None, batch: int) -> Callable:
    """Rows in the order of their shard, that of a file with its name first, to the files that hold them now."""
    columns = ", ".join(f"{named(f.name)} {_kind(f.dataType)}{' NOT NULL' * (f.name in keys)}" for f in schema)
    create = f"CREATE TABLE {named(table)} ({columns}{f', PRIMARY KEY ({', '.join(map(named, keys))})' if keys else ''})"
    rest = [named(f.name) for f in schema if f.name not in keys]
    put = f"INSERT INTO {named(table)} VALUES ({', '.join('?' * len(schema))})"
    if keys:
        put += f" ON CONFLICT ({', '.join(map(named, keys))}) DO " + (f"UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in rest)}" if rest else "NOTHING")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        made = lambda shard, name: pa.RecordBatch.from_pydict({"_shard": [shard], "_shards": [shards], "_file": [name]}, pa.schema([("_shard", pa.int32()), ("_shards", pa.int32()), ("_file", pa.string())]))
        shard, kept, db, n = None, None, None, 0

        def closed() -> pa.RecordBatch:
            name = kept
            if db:
                db.commit()
                files.create_dir(folder, recursive=True)
                name = f"{table}-{uuid.uuid4().hex}.db"
                with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(db.serialize())
                db.close()
            return made(shard, name)

        for b in batches:
            at, names = b.column("_shard").to_pylist(), b.column("_file").to_pylist()
            rows = list(zip(*[_stored(b.column(f.name)) for f in schema], strict=True))
            start = 0
            while start < len(rows):
                if (db or kept) and (at[start] != shard or not keys and n >= ROWS):
                    yield closed()
                    kept, db, n = None, None, 0
                shard = at[start]
                if names[start] is not None:
                    kept, start = names[start], start + 1
                    continue
                if db is None:
                    db = sqlite3.connect(":memory:")
                    if kept:
                        with files.open_input_stream(f"{folder}/{kept}", compression=None) as held:
                            db.deserialize(held.read())
                    else:
                        db.execute(create)
                stop = start + 1
                while stop < len(rows) and stop - start < batch and at[stop] == shard and names[stop] is None:
                    stop += 1
                db.executemany(put, rows[start:stop])
                start, n = stop, n + stop - start
        if db or kept:
            yield closed()

    return write


class Database:
    """One table. `batch` rows are put in at once."""

    def __init__(self, spark: SparkSession, root: str, table: str, schema: T.StructType, keys: list[str] | None = None, batch: int = 100):
        self.spark, self.root, self.table, self.schema, self.keys, self.batch = spark, root.rstrip("/"), table, schema, keys or [], batch
        self.version = 0
        for f in schema:
            _kind(f.dataType)

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.root}/files-{self.version}")

    def _store(self, rows: DataFrame, shards: int | None) -> None:
        write = _writer(self.root, self.table, self.schema, self.keys, shards, self.batch)
        rows.mapInArrow(write, FILES).write.parquet(f"{self.root}/files-{self.version + 1}")
        self.version += 1

    def _dealt(self, rows: DataFrame, shards: int) -> DataFrame:
        shard = F.pmod(F.xxhash64(*self.keys), F.lit(shards)).cast("int")
        return rows.select(shard.alias("_shard"), F.lit(None).cast("string").alias("_file"), *self.schema.names)

    def create(self, rows: DataFrame) -> Database:
        if not self.keys:
            self._store(rows.select(F.lit(0).alias("_shard"), F.lit(None).cast("string").alias("_file"), *self.schema.names), None)
            return self
        shards = max(1, -(-rows.count() // ROWS))
        self._store(self._dealt(rows, shards).repartition(shards, "_shard").sortWithinPartitions("_shard"), shards)
        return self

    def upsert(self, rows: DataFrame) -> Database:
        """Rows, one a key, that replace those of the same keys or come to them."""
        shards = (self.files.agg(F.max("_shards")).first()[0] if self.version else None) or 1
        new = self._dealt(rows, shards)
        held = self.files.select("_shard", "_file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]) if self.version else new.limit(0)
        both = held.unionByName(new).repartition(shards, "_shard").sortWithinPartitions("_shard", F.col("_file").isNull())
        self._store(both, shards)
        return self

    def query(self, sql: str, schema: str | T.StructType | None = None) -> DataFrame:
        """What a SELECT finds in every file, whose columns are those of the schema in order; files cannot be changed by it."""
        kinds = self.schema if schema is None else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs
            from pyspark.sql.pandas.types import to_arrow_schema

            shape = to_arrow_schema(kinds)
            files, folder = fs.FileSystem.from_uri(root)
            for b in batches:
                for name in b.column("_file").to_pylist():
                    db = sqlite3.connect(":memory:")
                    with files.open_input_stream(f"{folder}/{name}", compression=None) as held:
                        db.deserialize(held.read())
                    db.execute("PRAGMA query_only = ON")
                    yield from _pages(db.execute(sql), shape)
                    db.close()

        found = self.files.select("_file")
        return found.repartition(max(1, found.count()), "_file").mapInArrow(run, kinds)

    def rows(self) -> DataFrame:
        return self.query(f"SELECT {', '.join(map(named, self.schema.names))} FROM {named(self.table)}")
