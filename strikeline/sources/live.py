"""Live sources over HTTP: a feed of frames with offsets, read as a stream, and tables behind a SQL endpoint.

`register` makes both known to a session:

    spark.readStream.format("frame_feed").options(url=...).load()
    spark.read.format("sql_http").schema(...).options(url=..., table=...).load()

frame_feed. The service answers GET <url>/latest with {"offset": n}, the number of frames it holds, and GET
<url>/frames?from=a&to=b with these frames, one a line. A batch is cut into ranges of `framesPerPartition` offsets, each read by
a task. A line that breaks is opened again at the first frame that is missing, after delayMs, twice that, and so on; a frame that
arrives sets the count of attempts back, `attempts` failures in a row end the query. As offsets are checkpointed by Spark, a query
that starts again goes on where it ended. A batch takes all that is there: a source written in Python does not learn where its
batch starts, so it cannot end it early; what bounds a task is its range.

sql_http. A task asks GET <url>?q=<sql> for its range of the partition column, `pageRows` at a time in the order of that
column, which must tell rows apart; without one there is one task and one page. There are `numPartitions` ranges, and more where
they would be wider than `partitionWidth`: each page is found anew among the rest of its range, so a range that grows with the
table costs its square. Filters that SQL can express go into the query. An answer counts if its status is
200 and its query_execution_status is Success. Rows come as JSON objects, numbers perhaps as text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

pause = time.sleep


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFeed)
    spark.dataSource.register(SqlHttp)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class Line:
    """GET requests with a time limit, and repeated ones with growing pauses. Answers of 4xx are errors of the caller and are
    not tried again."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"].rstrip("/")
        self.timeout = float(options.get("timeoutMs", 30_000)) / 1000
        self.attempts = int(options.get("attempts", 5))
        self.delay = float(options.get("delayMs", 1000)) / 1000
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {options['apiKey']}"} if options.get("apiKey") else {})

    def open(self, path: str):
        return urlopen(Request(self.url + path, headers=self.headers), timeout=self.timeout)  # noqa: S310

    def failed(self, error: Exception, attempt: int) -> None:
        """Waits before the attempt that follows this many failures in a row, or gives up."""
        if isinstance(error, HTTPError) and error.code < 500 or attempt > self.attempts:
            raise error
        pause(self.delay * 2 ** (attempt - 1))

    def get(self, path: str) -> dict:
        attempt = 0
        while True:
            try:
                with self.open(path) as answer:
                    return json.loads(answer.read())
            except (OSError, HTTPException, json.JSONDecodeError) as e:
                attempt += 1
                self.failed(e, attempt)


class FrameFeed(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_feed"

    def schema(self) -> str:
        return "offset long, value string"

    def streamReader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(self.options)


class Frames(ds.InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class FrameReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.line = Line(options)
        self.first = int(options.get("startingOffset", 0))
        self.width = int(options.get("framesPerPartition", 20_000))

    def initialOffset(self) -> dict:
        return {"offset": self.first}

    def latestOffset(self) -> dict:
        return {"offset": int(self.line.get("/latest")["offset"])}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        a, b = start["offset"], end["offset"]
        return [Frames(x, min(x + self.width, b)) for x in range(a, b, self.width)]

    def read(self, partition: Frames) -> Iterator[tuple[int, str]]:
        at, attempt = partition.start, 0
        while at < partition.end:
            try:
                with self.line.open(f"/frames?{urlencode({'from': at, 'to': partition.end})}") as answer:
                    for raw in answer:
                        if not raw.endswith(b"\n"):
                            raise ConnectionError("the line broke inside a frame")
                        yield at, raw[:-1].decode()
                        at, attempt = at + 1, 0
                if at < partition.end:
                    raise ConnectionError("the line ended early")
            except (OSError, HTTPException) as e:
                attempt += 1
                self.line.failed(e, attempt)

    def commit(self, end: dict) -> None:
        """Nothing to do: the service keeps its frames."""


class SqlHttp(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sql_http"

    def schema(self) -> str:
        raise ValueError("sql_http needs a schema")

    def reader(self, schema: T.StructType) -> SqlReader:
        return SqlReader(schema, self.options)


class Piece(ds.InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


def literal(value) -> str:
    """A value as SQL text."""
    import datetime
    import decimal

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value) if value == value and abs(value) != float("inf") else f"CAST('{value}' AS DOUBLE)"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(type(value).__name__)


def name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def condition(f: ds.Filter) -> str | None:
    """A filter as SQL, or None where it has no form that means the same everywhere."""
    if isinstance(f, ds.Not):
        inner = condition(f.child)
        return inner and f"NOT ({inner})"
    if len(f.attribute) != 1:
        return None
    column = name(f.attribute[0])
    try:
        if type(f) in _COMPARED:
            return f"{column} {_COMPARED[type(f)]} {literal(f.value)}"
        if isinstance(f, ds.In):
            return f"{column} IN ({', '.join(map(literal, f.value))})"
    except TypeError:
        return None
    if isinstance(f, ds.IsNull):
        return f"{column} IS NULL"
    if isinstance(f, ds.IsNotNull):
        return f"{column} IS NOT NULL"
    if isinstance(f, ds.StringStartsWith) and not set(f.value) & set("%_\\"):
        return f"{column} LIKE {literal(f.value + '%')}"
    return None


def _typed(value, kind: T.DataType):
    """A JSON value as one of the column's type; text that is no such value is null."""
    import datetime

    if value is None:
        return None
    try:
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(str(value)[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return datetime.datetime.fromisoformat(str(value))
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() in ("1", "true")
    except ValueError:
        return None
    return str(value)


class SqlReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options, self.line = schema, options, Line(options)
        self.table, self.by = options["table"], options.get("partitionColumn")
        self.page = int(options.get("pageRows", 50_000))
        self.pushed: list[str] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if sql := condition(f):
                self.pushed.append(sql)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        if not self.by:
            return [Piece(None, None)]
        low, high, n = (int(self.options[k]) for k in ("lowerBound", "upperBound", "numPartitions"))
        if width := int(self.options.get("partitionWidth", 0)):
            n = max(n, -(-(high - low) // width))
        cuts = [low + (high - low) * k // n for k in range(1, n)]
        # The outer pieces are open, so the bounds decide how work is split and not which rows there are.
        return [Piece(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def query(self, piece: Piece, after: int | None) -> str:
        where = list(self.pushed)
        if self.by:
            if after is not None:
                where.append(f"{name(self.by)} > {after}")
            elif piece.low is not None:
                where.append(f"{name(self.by)} >= {piece.low}")
            if piece.high is not None:
                where.append(f"{name(self.by)} < {piece.high}")
        sql = f"SELECT {', '.join(name(f.name) for f in self.schema)} FROM {name(self.table)}"
        sql += f" WHERE {' AND '.join(where)}" if where else ""
        return sql + (f" ORDER BY {name(self.by)} LIMIT {self.page}" if self.by else "")

    def read(self, partition: Piece) -> Iterator[tuple]:
        after = None
        while True:
            answer = self.line.get(f"?q={quote(self.query(partition, after), safe='')}")
            if answer.get("query_execution_status") != "Success":
                raise RuntimeError(f"the endpoint refused the query: {answer.get('query_execution_message')}")
            rows = answer.get("rows") or []
            for row in rows:
                yield tuple(_typed(row.get(f.name), f.dataType) for f in self.schema)
            if not self.by or len(rows) < self.page:
                return
            after = int(rows[-1][self.by])
