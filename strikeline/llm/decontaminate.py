"""Benchmark decontamination with a distributed positional inverted index.

The index is a table. Documents are dealt into blocks of a few MB of text; a block has one row per term with the
positions at which the term stands in the block, and one header row with its documents and where each begins. Positions
of different documents lie at least GAP apart, so neither a phrase nor a near match can cross from one to the next.
A term however frequent is spread over all blocks, so no task or row ever holds a whole posting list. Equal windows are one
phrase however many items have them, and the places of a phrase in a document are one list from the index to the check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strikeline.llm.common import BROADCAST_BYTES, Words, byte_table, gathered, map_arrow, materialise, slices, small, text_digest, without

#: After A-Z became a-z: digits, a-z and everything beyond ASCII.
WORD_BYTES = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
WINDOW_WORDS = 13
#: A document is contaminated when hit words are at least one in this many.
CONTAMINATED_PART = 20
#: Rarest terms of a phrase whose lists are intersected before its words are compared with the text.
RAREST = 3
#: More of them are met while so many places would be left by chance.
EXPECTED = 1000
#: Phrases that meet the lists of a block together.
PHRASES = 50_000
GAP = 64
BLOCK_BYTES = 6 << 20

INDEX = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("positions", T.BinaryType()),
        T.StructField("docs", T.ArrayType(T.LongType())),
    ]
)


def _task_ids() -> Iterator[int]:
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _task_ids()
    for batch in slices(gathered(batches, BLOCK_BYTES), limit=BLOCK_BYTES):
        words, block = Words(batch.column("text"), WORD_BYTES), next(ids)
        starts = words.first[:-1] + GAP * np.arange(batch.num_rows)
        where = (np.arange(len(words.tokens)) + GAP * np.repeat(np.arange(batch.num_rows), words.counts)).astype(np.int32)
        coded = words.tokens.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        where = where[np.argsort(codes, kind="stable")]
        counts = np.bincount(codes, minlength=len(coded.dictionary)) if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        steps = np.diff(where, prepend=np.int32(0)).astype(np.int32)
        steps[ends - counts] = where[ends - counts]
        lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(steps)])
        yield _rows(block, coded.dictionary.cast(pa.string()), pa.array(counts, pa.int32()), lists, pa.nulls(len(counts), pa.list_(pa.int64())))
        docs = pa.array([batch.column("doc").to_pylist()], pa.list_(pa.int64()))
        yield _rows(block, pa.nulls(1, pa.string()), pa.array([batch.num_rows], pa.int32()), pa.array([starts.astype(np.int32).tobytes()]), docs)


def _rows(block: int, *columns: pa.Array) -> pa.RecordBatch:
    blocks = pa.array(np.full(len(columns[0]), block, np.int64))
    return pa.RecordBatch.from_arrays([blocks, *columns], names=INDEX.names)


def build_index(docs: DataFrame, name: Column | None = None) -> DataFrame:
    """Store the positions of every word of every document: rows (block, term, n, positions) and a header per block. `name` is
    the number that places are given under, doc_id if none is given; two documents of one name stay apart in the index."""
    rows = docs.select((F.col("doc_id") if name is None else name).cast("long").alias("doc"), "text")
    return materialise(map_arrow(rows, _index, INDEX), "postings")


def _cut(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, out = Words(batch.column("text"), WORD_BYTES), set()
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                own = [w.decode() for w in words.of(row)]
                out |= {(item, *own[i : i + size]) for i in range(max(1, len(own) - size + 1)) if own}
            found = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1:] for x in found], pa.list_(pa.string()))], names=["item_id", "words"])

    return windows


def windows_of(items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every `size` consecutive words of an item, or all words of a shorter one: the different ones as (phrase, words), and
    (phrase, item_id as string) for each item that has it."""
    rows = items.select(F.col("item_id").cast("string"), "text")
    windows = materialise(map_arrow(rows, _cut(size), "item_id string, words array<string>"), "windows")
    # The numbers are fixed once they are written.
    phrases = materialise(windows.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    return phrases, materialise(windows.join(phrases, "words").select("phrase", "item_id").distinct(), "phrase_items")


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int32)


def _met(own: np.ndarray, other: np.ndarray, offset: int, slop: int) -> np.ndarray:
    """Those places of own from which other has the word at the offset, or at most slop words away from there."""
    wanted = own + np.int32(offset)
    at = np.minimum(np.searchsorted(other, wanted - np.int32(slop)), len(other) - 1)
    return own[np.abs(other[at] - wanted) <= slop]


def _pack(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=np.int32(0)).astype(np.int32).tobytes()


FOUND = "phrase long, doc long, places binary"
FOUND_ARROW = pa.schema([("phrase", pa.int64()), ("doc", pa.int64()), ("places", pa.binary())])


def _in_block(lists: pa.Table, phrases: pa.Table, slop: int) -> pa.Table:
    """Where the lists of a block meet for each phrase, by document. Every list is unpacked once, whatever number of phrases has
    its term."""
    names, packed = lists.column("term").to_pylist(), lists.column("positions").to_pylist()
    raw, plain = dict(zip(names, packed, strict=True)), {}
    starts = np.frombuffer(raw[None], np.int32) if None in raw else np.zeros(0, np.int32)
    docs = next((d for n, d in zip(names, lists.column("docs").to_pylist(), strict=True) if n is None), [])
    rows: dict[str, list] = {"phrase": [], "doc": [], "places": []}

    def positions(term: str) -> np.ndarray:
        if term not in plain:
            plain[term] = _unpack(raw[term])
        return plain[term]

    for k in range(phrases.num_rows):
        anchors = phrases.column("anchors")[k].as_py()
        if any(a["term"] not in raw for a in anchors):
            continue
        own = positions(anchors[0]["term"]) - np.int32(anchors[0]["offset"])
        for a in anchors[1:]:
            if not len(own):
                break
            own = _met(own, positions(a["term"]), a["offset"], slop)
        if not len(own):
            continue
        doc = np.maximum(np.searchsorted(starts, own, side="right") - 1, 0)
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        for d, places in zip(doc[heads].tolist(), np.split(own, heads[1:]), strict=True):
            rows["phrase"].append(phrases.column("phrase")[k].as_py())
            rows["doc"].append(docs[d])
            rows["places"].append(_pack(places - starts[d]))
    return pa.Table.from_pydict(rows, schema=FOUND_ARROW)


def candidates(index: DataFrame, phrases: DataFrame, slop: int = 0, rarest: int = RAREST) -> DataFrame:
    """(doc, places, phrase) where the offset-adjusted lists of each phrase's rarest words meet; places is a packed list.

    A phrase of frequent words has more lists met than `rarest`: as many as it takes for fewer than EXPECTED places to be left
    if words stood anywhere at random. A block's lists meet in one task, for PHRASES phrases at a time. With slop, the words
    after the rarest may stand up to `slop` positions away from their place (proximity)."""
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    terms = index.filter(F.col("term").isNotNull())
    flat = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    vocabulary = materialise(flat.select("term").distinct(), "vocabulary")
    words = float(index.agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")))).first()[0] or 1)
    totals = terms.select("term", "n").join(small(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("total"))
    by_rarity = Window.partitionBy("phrase").orderBy("total", "offset")
    left = F.log(F.lit(words)) + F.coalesce(F.sum(F.log(F.col("total") / words)).over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    anchors = (
        flat.join(totals, "term")
        .withColumns({"rank": F.row_number().over(by_rarity), "left": left, "known": F.count("*").over(Window.partitionBy("phrase"))})
        .filter((F.col("known") == F.col("size")) & ((F.col("rank") <= rarest) | (F.col("left") > math.log(EXPECTED))))
    )
    anchors = anchors.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "offset"))).alias("anchors"))
    anchors = materialise(anchors.select("phrase", F.col("anchors")[0]["term"].alias("term"), "anchors"), "anchors")
    wanted = materialise(anchors.select(F.explode("anchors.term").alias("term")).distinct(), "anchor_terms")
    parts = max(1, -(-anchors.count() // PHRASES))
    lists = materialise(terms.join(small(wanted), "term", "left_semi").unionByName(index.filter(F.col("term").isNull())).select("block", "term", "positions", "docs"), "lists")
    # Which phrases concern a block: those whose rarest term it has. No list is copied for them.
    here = lists.filter(F.col("term").isNotNull()).select("block", "term").join(small(anchors), "term").select("block", F.pmod("phrase", F.lit(parts)).alias("part"), "phrase", "anchors")
    lists = lists if parts == 1 else lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    lists = lists.select(F.col("block").alias("of_block"), (F.lit(0) if parts == 1 else F.col("part")).cast("long").alias("of_part"), "term", "positions", "docs")
    sides = here.groupBy("block", "part").cogroup(lists.groupBy("of_block", "of_part"))
    return sides.applyInArrow(lambda found, stored: _in_block(stored, found, slop), FOUND)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words at each candidate place with the phrase."""
    for batch in slices(batches):
        words = Words(batch.column("text"), WORD_BYTES)
        hits, seen = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        for row, found in enumerate(batch.column("found").to_pylist()):
            if not found:
                continue
            own, cover = words.of(row), np.zeros(words.counts[row] + 1, np.int64)
            for f in found:
                phrase = f["words"].encode().split(b" ")
                good = [p for p in _unpack(f["places"]).tolist() if p >= 0 and own[p : p + len(phrase)] == phrase]
                if good:
                    np.add.at(cover, good, 1)
                    np.add.at(cover, np.array(good) + len(phrase), -1)
                    seen[row].append(f["phrase"])
            hits[row] = np.count_nonzero(np.cumsum(cover[:-1]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words.counts, pa.int64()), pa.array(hits), pa.array(seen, pa.list_(pa.int64()))], names=["row", "n_words", "n_hit", "phrases"])


def _judged(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs but text), n_words, n_hit and the phrases that stand in the text. Candidate places
    find their row by a hash of id and text; as the words are compared after that, another row of that hash does no harm."""
    name = F.xxhash64("doc_id", "text")
    found = candidates(build_index(docs, name), phrases).distinct()  # rows that are there twice share their places
    phrases = phrases.select("phrase", F.concat_ws(" ", "words").alias("words"))  # no word holds a space; a text is smaller than a list
    found = materialise(found.join(small(phrases), "phrase").groupBy("doc").agg(F.collect_list(F.struct("phrase", "words", "places")).alias("found")), "candidates")
    carried = F.struct(*[F.col(c) for c in docs.columns if c != "text"]) if docs.columns != ["text"] else F.struct(F.lit(1).alias("_none"))
    bulk = found.agg(F.sum(F.size("found") * 64 + F.aggregate("found", F.lit(0), lambda n, x: n + F.octet_length(x["places"]) + F.octet_length(x["words"])))).first()[0] or 0
    side = F.broadcast(found) if bulk <= BROADCAST_BYTES else found
    rows = docs.select(carried.alias("row"), "text", name.alias("doc")).join(side, "doc", "left")
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("phrases", T.ArrayType(T.LongType()))])
    return map_arrow(rows.select("row", "text", "found"), _matches, schema)


def annotate(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """docs without text, plus n_words, n_hit, items (ids of items with an occurring window, sorted as strings) and contaminated.

    Null and empty texts have no words and are never contaminated; an item without words has no window; a null item id is
    dropped. Rows with the same doc_id are judged each by its own text, null ids included, repeated rows alike. Columns of
    docs with the names of the results are replaced; all other columns are kept.
    """
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    phrases, members = windows_of(items.filter(F.col("item_id").isNotNull()), size)
    judged = materialise(_judged(docs, phrases).withColumn("at", F.monotonically_increasing_id()), "judged")
    named = judged.select("at", F.explode("phrases").alias("phrase")).join(small(members), "phrase").groupBy("at").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = judged.join(small(materialise(named, "items")), "at", "left")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "text"]
    return out.select(*kept, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), _contaminated().alias("contaminated"))


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * CONTAMINATED_PART >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is not contaminated. Rows are told apart by doc_id and text, repeated rows go
    or stay together; null and empty texts stay. No rows give no rows, and no items drop none."""
    phrases, _ = windows_of(items.filter(F.col("item_id").isNotNull()))
    judged = _judged(docs.select("doc_id", "text", text_digest(F.col("text")).alias("digest")), phrases).filter(_contaminated())
    return without(docs, judged.select("row.doc_id", "row.digest"), {"doc_id": F.col("doc_id"), "digest": text_digest(F.col("text"))})


def phrase_search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, pos, phrase): places where every word of a phrase(phrase, words) stands; exact order, or each word within
    `slop` of its place. doc_id is what the index names its documents by."""
    longest = phrases.agg(F.max(F.size("words"))).first()[0] or 1
    places = F.explode(F.pandas_udf(_places, "array<int>")("places")).alias("pos")
    return candidates(index, phrases, slop, rarest=longest).select("phrase", F.col("doc").alias("doc_id"), places)


def _places(packed: pd.Series) -> pd.Series:
    return packed.map(_unpack)
