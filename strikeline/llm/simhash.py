"""SimHash near-deduplication with covering locality-sensitive hashing.

For a radius r, bit i of a fingerprint gets a code of r + 1 bits, and for each of the 2 ** (r + 1) - 1 non-zero vectors v
a mask keeps the bits whose code has an odd product with v. Any r differing bits have codes that some v is orthogonal to,
so that mask drops them all: every pair within the radius shares a bucket of some table, with no chance of a miss.

Fingerprints are taken once each. A bucket of up to BUCKET of them is compared within; a larger one is covered again on
the bits that its mask dropped. Every level about halves those bits, so after a few levels a bucket cannot hold more
distinct fingerprints than BUCKET: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import map_arrow, materialise, one_of_each, slices, text_bytes, text_digest
from strikeline.llm.components import connect

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
BUCKET = 32
_CHUNK = 1 << 17


def masks(bits: list[int], radius: int) -> list[int]:
    """The covering masks over the given bits."""
    width = radius + 1
    codes = {b: 1 + k % (2**width - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (codes[b] & v).bit_count() % 2) for v in range(1, 2**width)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For rows of hashes that stop before `ends`: bits set in over half of a row's hashes."""
    out = np.zeros((len(ends), BITS), np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[at : at + _CHUNK]
        heads = np.flatnonzero(np.diff(rows, prepend=-1))
        np.add.at(out, rows[heads], np.add.reduceat(bits, heads, axis=0, dtype=np.int32))
    most = 2 * out > np.diff(ends, prepend=0)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(raw: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    words = raw.lower().split()  # on bytes: A-Z only, and the six ASCII spaces only
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            raw, counts, parts = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                hashes = shingle_hashes(raw[a:b], size, seed)
                counts.append(len(hashes))
                parts.append(np.array(hashes, np.uint64))
            found = fingerprint(np.concatenate(parts), np.cumsum(counts))
            keys = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(found.view(np.int64))], names=[*keys, "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _fingerprints(size, seed), "doc_id long, fp long")


def _stars(radius: int):
    """Within each bucket, link every fingerprint to the smallest node of its connected part."""

    def local(fps: pd.Series, nodes: pd.Series) -> pd.Series:
        out = []
        for f, n in zip(fps, nodes, strict=True):
            f, n = np.asarray(f, np.int64).view(np.uint64), np.asarray(n, np.int64)
            near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
            label = n
            while True:
                after = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
                if (after == label).all():
                    break
                label = after
            out.append([{"a": int(a), "b": int(b)} for a, b in zip(n, label, strict=True) if a != b])
        return pd.Series(out)

    return F.pandas_udf(local, "array<struct<a:bigint,b:bigint>>")


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) such that nodes(fp, node), of distinct fp, within the radius are connected. The work grows with the nodes."""
    level = nodes.select("fp", "node", F.lit("").alias("path"), F.lit(0).cast("long").alias("used"))
    free_sets, found, stars = {"": list(range(BITS))}, [], _stars(radius)
    while free_sets:
        plans = [(path, t, m) for path, bits in free_sets.items() for t, m in enumerate(masks(bits, radius))]
        # A row meets the masks of its own path only: as many at every level. At the first level all rows have the same path.
        if list(free_sets) == [""]:
            keyed = level.select("fp", "node", "used", F.inline(F.array(*[F.struct(F.lit(f"{t}.").alias("table"), F.lit(_signed(m)).alias("mask")) for _, t, m in plans])))
        else:
            own = nodes.sparkSession.createDataFrame([(path, f"{path}{t}.", _signed(m)) for path, t, m in plans], "path string, table string, mask long")
            keyed = level.join(F.broadcast(own), "path")  # a row for each mask of a crowded path, however many documents there are
        keyed = keyed.select("fp", "node", F.col("table").alias("path"), F.col("used").bitwiseOR(F.col("mask")).alias("used"))
        keyed = materialise(keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("used"))), "covered")
        by = ["path", "key"]
        counts = materialise(keyed.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        members = keyed.join(counts, by)
        few = members.filter(F.col("n") <= bucket).groupBy(*by).agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
        found.append(materialise(few.select(F.explode(stars("fps", "nodes")).alias("l")).select("l.a", "l.b"), "pairs"))
        crowded = counts.filter(F.col("n") > bucket)
        deeper = [r.path for r in crowded.select("path").distinct().collect()]  # masks, a fixed number a level
        dropped = {f"{path}{t}.": [b for b in free_sets[path] if not m >> b & 1] for path, t, m in plans}
        free_sets = {p: dropped[p] for p in deeper}
        if free_sets:
            large = {p for p, bits in free_sets.items() if 2 ** len(bits) <= bucket}
            assert not large, "distinct fingerprints cannot outnumber the values of their free bits"
            level = members.filter(F.col("n") > bucket).select("fp", "node", "path", "used")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id for every row of docs: the smallest doc_id reachable by links, itself included.

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Rows with a null id get
    the component of their fingerprint, null if it has no id at all. Other columns do not matter; no rows give no rows.
    """
    rows = materialise(fingerprints(docs, size, seed), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = connect(links(nodes.filter("node is not null"), radius))
    labels = nodes.join(named, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(materialise(labels, "labels"), "fp")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of docs of each group of near copies: that with the smallest doc_id. Rows are told apart by doc_id and text and
    linked by fingerprint, so ids may repeat; a null id stays only if its group has no other."""
    size, radius, seed = (options.get(k, d) for k, d in (("size", SHINGLE_WORDS), ("radius", RADIUS), ("seed", SEED)))
    keys = {"doc_id": F.col("doc_id").cast("long"), "digest": text_digest(F.col("text"))}
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], "text")
    rows = materialise(map_arrow(rows, _fingerprints(size, seed), "doc_id long, digest binary, fp long"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    nodes = materialise(rows.groupBy("fp").agg(F.min(order).alias("best")), "nodes")
    named = connect(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    groups = nodes.join(named, F.col("fp") == F.col("node"), "left").select("fp", "best", F.coalesce("component", "fp").alias("component"))
    groups = materialise(groups, "groups")
    kept = materialise(groups.groupBy("component").agg(F.min("best").alias("keep")), "kept")
    keeps = materialise(groups.join(kept, "component").select("fp", "keep.doc_id", "keep.digest"), "keeps").select("fp", F.col("doc_id").alias("keep_id"), F.col("digest").alias("keep_digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    dropped = rows.join(keeps, "fp").filter(~stays)
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("fp").alias("fp")).filter("n > 1").join(keeps, "fp").filter(stays)
    return one_of_each(docs, keys, dropped, repeated)
