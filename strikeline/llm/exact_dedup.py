"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned over sampled splitters, sorted inside the partitions so that equal texts lie side by side,
and each text is compared in full with its neighbour. The range key is the leading bytes of the text and a 64-bit digest
of all its bytes: splitters stay small whatever the texts, and long shared openings do not gather in one partition. Texts
that share a digest but differ are told apart by the comparison. A key with many rows gets a salt, so that its rows are
sorted in several ranges; the runs of equal texts that these give, each with its count and best id, are then merged by their
whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.llm.common import materialise, one_of_each, shuffle_parts, text_digest

LEADING_CHARS = 16
#: Keys are salted from this many rows, or a quarter of a partition's share if that is more.
SALT_ROWS = 200


def _order(latest: bool) -> Column:
    return F.col("doc_id").desc_nulls_last() if latest else F.col("doc_id").asc_nulls_last()


def groups(docs: DataFrame, text: Column | None = None, latest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too.

    The smallest doc_id of equal texts stays, or the largest with `latest`. `text` is the normalised text (default: the
    column as it is); null counts as empty. Of rows with the same text and id one is kept; a null id stays only if its
    group has no other. No rows give no rows; other columns of docs do not matter.
    """
    best = F.max if latest else F.min
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    rows = rows.withColumns({"_head": F.substring("_text", 1, LEADING_CHARS), "_digest": F.xxhash64("_text")})
    # Keys of a quarter of a partition's share or more: at most 4 per partition, so the side that is broadcast is bounded.
    share = max(SALT_ROWS, docs.count() // (4 * shuffle_parts(docs.sparkSession)))
    hot = rows.groupBy("_head", "_digest").agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= share)
    hot = materialise(hot.select("_head", "_digest", F.ceil(F.col("_rows") / share).cast("int").alias("_salts")), "many_copies")
    rows = rows.join(F.broadcast(hot), ["_head", "_digest"], "left")
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("_salts")).cast("int"))

    ranged = rows.select("doc_id", "_text", "_head", "_digest", salt.alias("_salt")).repartitionByRange("_head", "_digest", "_salt")
    near = Window.partitionBy("_head", "_digest", "_salt").orderBy("_text", _order(latest))
    before = F.lag("_text").over(near)
    opens = before.isNull() | (before != F.col("_text"))
    runs = ranged.withColumn("_opens", opens)
    # Of a run under a salted key its text goes along once, so that it can be compared with the runs of other salts.
    said = F.when(F.col("_salt").isNotNull() & F.col("_opens"), F.col("_text"))
    runs = runs.select("doc_id", "_head", "_digest", "_salt", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), said.alias("_said"), "_opens", F.sum(F.col("_opens").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    group = Window.partitionBy("_head", "_digest", "_salt", "_run")
    runs = materialise(runs.withColumns({"_best": best("doc_id").over(group), "_size": F.count(F.lit(1)).over(group)}), "sorted_runs")

    # A text whose rows were salted has a run under each salt: the runs are merged, no longer their rows.
    merged = runs.filter("_said is not null").groupBy("_head", "_digest", "_said").agg(best("_best").alias("_all_best"), F.sum("_size").alias("_all_size"))
    merged = merged.select("_head", "_digest", F.sha2(F.col("_said").cast("binary"), 256).alias("text_sha256"), "_all_best", "_all_size")
    joined = runs.join(F.broadcast(merged), ["_head", "_digest", "text_sha256"], "left")
    keep = F.when(F.col("_salt").isNotNull(), F.col("_all_best")).otherwise(F.col("_best"))
    kept = F.col("_opens") & F.col("doc_id").eqNullSafe(keep)  # the first of a run has its best id
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("_all_size", "_size").alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: Column | None = None, latest: bool = False) -> DataFrame:
    """One row of docs for each text: that with the smallest doc_id (largest with `latest`). Rows are told apart by doc_id and
    text, so ids may repeat; a null id stays only if its text has no other."""
    keys = {"doc_id": F.col("doc_id").cast("long"), "digest": text_digest(F.col("text") if text is None else text)}
    others = groups(docs, text, latest).filter("not kept")
    others = others.select("doc_id", F.unhex(F.substring("text_sha256", 1, 32)).alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeat"))
    others = materialise(others, "others")
    return one_of_each(docs, keys, others.filter("not repeat"), others.filter("repeat"))
