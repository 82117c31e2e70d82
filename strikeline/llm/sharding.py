"""Sharding by histogram sort, in DataFrame operations only.

Rows have a place on a line: the digest of their text, then doc_id, so copies lie together. Every round counts the exact
bytes and rows in equal slices of the intervals that still hold a wanted boundary between shards. A boundary is settled on a
slice's end that is within tolerance. Where it falls among copies of one text it goes to the nearer end of their group, and
only a group larger than a shard is parted, by id. So a shard is off its share by the tolerance, or by half of the largest
unparted group at either end. Then all rows move once: those of a shard are dealt evenly over several partitions by a hash,
so that no task gets a whole shard, and are sorted there.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.llm.common import materialise, shuffle_parts

SHARDS = 8
#: A boundary may be off by this part of a shard's bytes, or by one row.
TOLERANCE = 0.0005
PROBE_BITS = 10
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Interval:
    """Places from (digest_lo, id_lo) to (digest_hi, id_hi); ids count only where the digests are one."""

    lo: int
    hi: int
    digest: int | None = None  # set: lo and hi are ids within this digest

    def step(self) -> int:
        return max(0, (self.hi - self.lo).bit_length() - PROBE_BITS)


def _line(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOW)).alias("_id"),
        (F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 1).alias("_size"),
    )


def _probe(keys: DataFrame, intervals: list[Interval]) -> dict[int, list]:
    """Exact bytes and rows of each slice of each interval, with the least and greatest place found there."""
    digest, id_ = F.col("_digest"), F.col("_id")
    number = F.lit(None).cast("int")
    slot = F.lit(None).cast("long")
    for i, x in enumerate(intervals):
        col = digest if x.digest is None else id_
        inside = col.between(F.lit(x.lo).cast("long"), F.lit(x.hi).cast("long"))
        if x.digest is not None:
            inside = (digest == F.lit(x.digest).cast("long")) & inside
        # the first interval spans all 64 bits: the shift comes before the difference so that nothing overflows
        at = F.shiftright(col, x.step()) - F.lit(x.lo >> x.step()).cast("long")
        number, slot = F.when(inside, i).otherwise(number), F.when(inside, at).otherwise(slot)
    found = keys.select(number.alias("number"), slot.alias("slot"), "_size", "_digest", "_id").filter("number is not null").groupBy("number", "slot")
    found = found.agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("_digest", "_id")])
    out: dict[int, list] = {}
    for r in found.collect():  # at most 2 ** PROBE_BITS + 1 rows for each boundary sought
        out.setdefault(r.number, []).append(r)
    return {k: sorted(v, key=lambda r: r.slot) for k, v in out.items()}


def splitters(keys: DataFrame, ranges: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """ranges - 1 places; a row belongs to the range after all places that are not beyond it."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    share = total / ranges
    slack = tolerance * share
    settled: dict[int, tuple[int, int]] = {}
    sought = {i: (Interval(LOW, HIGH), total * i / ranges) for i in range(1, ranges)}  # bytes wanted below, in the interval
    while sought and total:
        intervals = sorted({x for x, _ in sought.values()}, key=lambda x: (x.lo, x.hi, x.digest or 0))
        counts, further = _probe(keys, intervals), {}
        for i, (interval, wanted) in sought.items():
            slots, below = counts[intervals.index(interval)], 0
            for r in slots:
                if below + r.bytes > wanted:
                    break
                below += r.bytes
            over = wanted - below  # bytes of slice r that should lie below
            one_text = r.lo__digest == r.hi__digest
            within = interval.digest is not None  # in a group that is parted
            first = (r.lo__digest, r.lo__id if within else LOW)
            after = _next(r.hi__digest, r.hi__id, within)
            if over <= slack:
                settled[i] = first
            elif r.bytes - over <= slack:
                settled[i] = after
            elif one_text and (not within and r.bytes <= share or r.lo__id == r.hi__id):
                settled[i] = first if 2 * over < r.bytes else after
            elif one_text:
                further[i] = (Interval(r.lo__id, r.hi__id, r.lo__digest), over)
            else:
                further[i] = (Interval(r.lo__digest, r.hi__digest), over)
        sought = further
    return [settled.get(i, (HIGH, HIGH)) for i in range(1, ranges)]


def _next(digest: int, id_: int, within: bool) -> tuple[int, int]:
    """The first place after a row, or after all rows of its text."""
    if within and id_ < HIGH:
        return digest, id_ + 1
    return (digest + 1, LOW) if digest < HIGH else (HIGH, HIGH)


def _range_of(places: list[tuple[int, int]]):
    """Number of places not beyond the row: a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        d, i = (F.lit(x).cast("long") for x in places[mid])
        beyond = (F.col("_digest") > d) | ((F.col("_digest") == d) & (F.col("_id") >= i))
        return F.when(beyond, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(places))


def shard(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id") -> DataFrame:
    """docs, all columns and texts, plus size, shard and slot under the law `bytes`: shards of nearly equal size.

    size is the UTF-8 bytes of the text plus 1, null being empty; slots count from 0 in each shard without gaps. Equal texts
    lie in one shard unless they are larger than one. Rows that agree in text and id stay together and are numbered in any
    order. With fewer rows than shards some are empty. Columns named size, shard or slot are replaced.
    """
    spark = docs.sparkSession
    rows = _line(docs.drop("size", "shard", "slot"), id_column)
    keys = materialise(rows.select("_digest", "_id", "_size"), "places")
    places = splitters(keys, shards)
    per_shard = max(1, round(shuffle_parts(spark) / shards))
    piece = _range_of(places) * per_shard + F.pmod(F.xxhash64("_digest", "_id"), F.lit(per_shard)).cast("int")
    counted = keys.select(piece.alias("_piece")).groupBy("_piece").agg(F.count("*").alias("_rows"))  # a row a piece
    before = Window.partitionBy("_shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_shard", F.floor(F.col("_piece") / per_shard).cast("int")).withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    # The piece is the number of the partition: no pass over the data to find ranges.
    moved = rows.withColumn("_piece", piece).repartitionById(shards * per_shard, F.col("_piece"))
    numbered = moved.withColumn("_at", F.row_number().over(Window.partitionBy("_piece").orderBy("_digest", "_id")))
    out = numbered.join(F.broadcast(offsets), "_piece")  # as many rows as there are pieces
    return out.select("_row.*", F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_at") - 1 + F.col("_offset")).alias("slot"))


def boundary_of(places: list[tuple[int, int]], digest: int, id_: int) -> int:
    """The range of one row, for tests and routing single rows."""
    return bisect_right(places, (digest, id_))
