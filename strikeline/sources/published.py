"""Tables of daily folders behind one pointer.

    root/data/<id>/day=2024-01-05/...   files, which are never changed
    root/pointer/<n>                    lines "day<TAB>folder": which folder holds each day as of version n

A merge writes new folders for the days that it touches, and then makes the pointer n + 1. Making a file that is not there yet is
one step, so a reader sees the days of version n or of n + 1, and of two writers that began from n one is refused. Folders that
no pointer names any more stay until `clean` is called, for readers that still have them open. The pointer has a line a day."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.sources.sinks import keyed_union


class Refused(RuntimeError):
    """Another writer has published since this one began."""


class Published:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, day: str):
        """day names the date column by which rows lie in folders; null dates have a folder of their own."""
        self.spark, self.root, self.day = spark, root.rstrip("/"), day
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        self._files = self._path(self.root).getFileSystem(conf)

    def version(self) -> int:
        """The newest version; 0 before the first."""
        at = self._path(f"{self.root}/pointer")
        if not self._files.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def days(self, version: int | None = None) -> dict[str, str]:
        """The folder of each day."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._files.open(self._path(f"{self.root}/pointer/{version}"))
        try:
            text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.splitlines())

    def _publish(self, version: int, days: dict[str, str]) -> None:
        text = "".join(f"{d}\t{f}\n" for d, f in sorted(days.items()))
        at, begun = self._path(f"{self.root}/pointer/{version}"), self._path(f"{self.root}/pointer/.{version}-{uuid.uuid4().hex}")
        stream = self._files.create(begun, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # A rename onto a file that is there fails on some stores and replaces it on others, so the claim is made first.
            self._files.create(self._path(f"{self.root}/pointer/.claim-{version}"), False).close()
        except Exception as e:
            self._files.delete(begun, False)
            raise Refused(f"version {version} is taken") from e
        self._files.rename(begun, at)

    def read(self, low: datetime.date | None = None, high: datetime.date | None = None, version: int | None = None) -> DataFrame:
        """Rows, of the days from low to high only where they are given; other days' files are not touched."""
        named = self.days(version)
        keep = [f for d, f in named.items() if (low is None or d != "null" and d >= str(low)) and (high is None or d != "null" and d <= str(high))]
        return self._of(keep)

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, days: list[str], rows: DataFrame, version: int) -> int:
        """Publish rows as all that the named days hold, on top of a version; the number of the new one."""
        folder = f"data/{uuid.uuid4().hex}"
        keyed = rows.select(*self.schema.names).withColumn("_day", F.coalesce(F.col(self.day).cast("string"), F.lit("null")))
        keyed.hint("rebalance", "_day").write.partitionBy("_day").option("compression", "snappy").parquet(f"{self.root}/{folder}")
        made = {s.getPath().getName().removeprefix("_day="): f"{folder}/{s.getPath().getName()}" for s in self._files.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()}
        if extra := set(made) - set(days):
            raise ValueError(f"rows of other days than were named: {sorted(extra)[:3]}")
        left = {d: f for d, f in self.days(version).items() if d not in days}
        self._publish(version + 1, left | made)
        return version + 1

    def change(self, new: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the days of new by what `make` makes of their old rows and the new ones."""
        version = self.version()
        named = self.days(version)
        days = [r[0] for r in new.select(F.coalesce(F.col(self.day).cast("string"), F.lit("null"))).distinct().collect()]  # a row a day
        old = self._of([named[d] for d in days if d in named])
        return self.replace(days, make(old, new), version)

    def merge(self, new: DataFrame, keys: list[str]) -> int:
        """Merge rows by keys, new ones winning. The day must be one of the keys: a key cannot move to another day."""
        if self.day not in keys:
            raise ValueError("the day must be one of the keys")
        return self.change(new, lambda old, rows: keyed_union(old, rows, keys))

    def clean(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` versions names, and older pointers; the number of folders gone."""
        newest = self.version()
        used = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.days(v).values()}
        gone = 0
        data = self._path(f"{self.root}/data")
        for batch in self._files.listStatus(data) if self._files.exists(data) else []:
            for folder in self._files.listStatus(batch.getPath()):
                name = f"data/{batch.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in used:
                    self._files.delete(folder.getPath(), True)
                    gone += 1
        for v in range(1, newest - keep + 1):
            self._files.delete(self._path(f"{self.root}/pointer/{v}"), False)
        return gone
