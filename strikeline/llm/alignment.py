"""Alignment of two tokenizers over the same bytes: which tokens of one overlap which tokens of the other.

The texts of a slice are laid end to end, so that both token sequences cover the same bytes. The union of both end arrays cuts
them into elementary intervals; searchsorted finds the token of either side that owns an interval, and each interval is one
overlap, as two tokens overlap in at most one run of bytes. Ends that both arrays share close a group. A group's product, all its
A tokens with all its B tokens, expands to at least as many pairs as it has overlaps.

How often an id pair is linked is a count over the whole corpus. A slice keeps its own list of different pairs, and its documents
hold places in that list with multiplicities. The lists are summed by pair, joined back once for each slice and pair, and meet
the documents of their slice again; a document's links are never a row of their own.

Defined cases: a text that is null or empty, or which either tokenizer does not reproduce byte for byte, has no tokens: zeros and
an empty `groups`. Rows are kept as they are, repeated ids, null ids and extra columns included (columns named as an added one
give way to it). Of pairs with equal counts each is a B id's highest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import cuts, give_back, map_arrow, materialise

#: Text bytes whose pairs share a list, and text bytes that are tokenized at once.
LIST_BYTES = 4 << 20
STEP_BYTES = 1 << 19

#: Characters whose classes no two versions of Unicode dispute; other texts are left to the tokenizers library.
PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧]*")

ADDED = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_products", "bigint"), ("n_links", "bigint"), ("groups", "string"), ("groups_sha256", "string")]


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE of the tokenizers library. Plain texts go through tiktoken with the ranks of the same file,
    which gives the same ids for a third of the time."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()
        model = json.loads(open(path, encoding="utf-8").read())
        alphabet, special = _byte_alphabet(), {x["id"] for x in model.get("added_tokens", []) if x["special"]}
        vocab = model["model"]["vocab"]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for token, number in vocab.items():
            piece = token.encode() if number in special else bytes(alphabet[c] for c in token)
            self.pieces[number] = piece
            if number not in special:
                ranks[piece] = number
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.plain = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [np.asarray(self.plain.encode_ordinary(t), np.int64) if PLAIN.fullmatch(t) else None for t in texts]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, coded in zip(rest, self.whole.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False) if rest else [], strict=True):
            found[k] = np.asarray(coded.ids, np.int64)
        return found


class Pieces:
    """Tokenizer B: a sentencepiece model, which adds the leading space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteLevel(a), Pieces(b)


@lru_cache(maxsize=2)
def _printed(a: str, b: str) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """For either side the decimal ids with the mark that follows, first inside a side of a group and then at its end, and the
    byte lengths by id."""
    left, right = (x.pieces for x in _tokenizers(a, b))
    marks = [[b"%d%s" % (k, m) for m in (b",", end) for k in range(len(p))] for p, end in ((left, b"|"), (right, b";"))]
    return marks[0], marks[1], *(np.array([len(x) for x in p], np.int64) for p in (left, right))


class Overlaps:
    """Overlaps of two token sequences that cover the same bytes, by the byte lengths of their tokens."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        ends = np.union1d(self.end_a, self.end_b)
        self.own_a, self.own_b = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        closing = (self.end_a[self.own_a] == ends) & (self.end_b[self.own_b] == ends) if len(ends) else np.zeros(0, bool)
        self.ends, self.closing = ends, ends[closing]
        #: Tokens of either side up to the end of each group, and of each group alone.
        self.upto_a, self.upto_b = self.own_a[closing] + 1, self.own_b[closing] + 1
        self.in_a, self.in_b = np.diff(self.upto_a, prepend=0), np.diff(self.upto_b, prepend=0)

    def printed(self, a: np.ndarray, b: np.ndarray, marks_a: list[bytes], marks_b: list[bytes]) -> list[bytes]:
        """The marked ids in the order of the groups, A before B in each."""
        before_b, last_a, last_b = self.upto_b - self.in_b, self.upto_a - 1, self.upto_b - 1
        out = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(before_b, self.in_a)
        at_b = np.arange(len(b)) + np.repeat(self.upto_a, self.in_b)
        half_a, half_b = len(marks_a) // 2, len(marks_b) // 2
        code_a, code_b = a.copy(), b + 2 * half_a
        code_a[last_a] += half_a
        code_b[last_b] += half_b
        out[at_a], out[at_b] = code_a, code_b
        marks = marks_a + marks_b
        return [marks[k] for k in out.tolist()]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between the given ends."""
    return np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)


def _align(texts: list[str | None], a: str, b: str) -> tuple[dict[str, list | np.ndarray], np.ndarray, np.ndarray]:
    """Columns of documents; the id pairs of all links in order, and the number of links before the end of each document."""
    left, right = _tokenizers(a, b)
    marks_a, marks_b, width_a, width_b = _printed(a, b)
    given = [k for k, t in enumerate(texts) if t]
    coded_a = left.encode([" " + texts[k] for k in given])
    coded_b = right.encode([texts[k] for k in given])
    kept, ids_a, ids_b = [], [], []
    for k, x, y in zip(given, coded_a, coded_b, strict=True):
        whole = b" " + texts[k].encode()
        if b"".join([left.pieces[i] for i in x.tolist()]) == whole and b"".join([right.pieces[i] for i in y.tolist()]) == whole:
            kept.append(k)
            ids_a.append(x)
            ids_b.append(y)
    n = len(texts)
    n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_a[kept], n_b[kept] = [len(x) for x in ids_a], [len(x) for x in ids_b]
    flat_a, flat_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b))
    found = Overlaps(width_a[flat_a], width_b[flat_b])
    # Where each document ends: in bytes, so in intervals and in groups.
    bytes_end = np.append(0, found.end_a)[np.cumsum(n_a)]
    links_end, groups_end = np.searchsorted(found.ends, bytes_end, "right"), np.searchsorted(found.closing, bytes_end, "right")
    words = found.printed(flat_a, flat_b, marks_a, marks_b)
    shown, start = [], 0
    for stop in np.cumsum(n_a + n_b).tolist():
        shown.append(b"".join(words[start:stop])[:-1])
        start = stop
    columns = {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups_end, prepend=0), "n_products": _sums(found.in_a * found.in_b, groups_end),
        "n_links": np.diff(links_end, prepend=0), "groups": [x.decode() for x in shown], "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in shown],
    }
    return columns, flat_a[found.own_a] << 32 | flat_b[found.own_b], links_end


def _listed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, a: str, b: str, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a slice with what they have on their own, places in the slice's list of pairs and multiplicities; the
    list itself lies with the slice's first document."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    rows, pairs, ends, size = [], [], [], 0

    def closed() -> pa.RecordBatch:
        nonlocal number
        everything = np.concatenate(pairs)
        listed, place, count = np.unique(everything, return_inverse=True, return_counts=True)
        held, start = [], 0
        for stop in np.cumsum(np.concatenate([np.diff(e, prepend=0) for e in ends])).tolist():
            own, times = np.unique(place[start:stop], return_counts=True)
            held.append((own.astype(np.uint16 if len(listed) <= 65536 else np.uint32).tobytes(), times.astype(np.uint16 if not len(times) or times.max() < 65536 else np.uint32).tobytes()))
            start = stop
        table = pa.concat_batches(rows)
        first = [True] + [False] * (table.num_rows - 1)
        own = {
            "slice": pa.array([part << 32 | number] * table.num_rows, pa.int64()), "places": pa.array([p for p, _ in held], pa.binary()), "times": pa.array([t for _, t in held], pa.binary()),
            "listed": pa.array([listed if f else None for f in first], pa.list_(pa.int64())), "counts": pa.array([count if f else None for f in first], pa.list_(pa.int64())),
        }
        number += 1
        return pa.RecordBatch.from_arrays([own.get(f.name, table.column(f.name) if f.name in table.schema.names else None) for f in schema], schema=schema)

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for start, n in cuts(texts, STEP_BYTES):
            part_of = batch.slice(start, n)
            strings = texts.slice(start, n)
            columns, found, end = _align(strings.to_pylist(), a, b)
            if not keep_groups:
                columns.pop("groups")
            plain = [c for c in part_of.schema.names if c != "text"]
            rows.append(pa.RecordBatch.from_arrays([part_of.column(c) for c in plain] + [pa.array(v) for v in columns.values()], names=plain + list(columns)))
            pairs.append(found)
            ends.append(end)
            size += int(strings.nbytes)
            if size >= LIST_BYTES:
                yield closed()
                rows, pairs, ends, size = [], [], [], 0
                give_back()
    if rows:
        yield closed()


def _scored(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of a slice with sums over their links, from the counts of the slice's pairs in the order of its list."""
    order = np.argsort(right.column("place").to_numpy())
    count, best = right.column("total").to_numpy()[order], right.column("best").to_numpy()[order]
    wide, n_best, count_sum = np.uint16 if len(count) <= 65536 else np.uint32, [], []
    for places, times, links in zip(left.column("places").to_pylist(), left.column("times").to_pylist(), left.column("n_links").to_pylist(), strict=True):
        place = np.frombuffer(places, wide)
        often = np.frombuffer(times, np.uint16 if len(times) == 2 * len(place) else np.uint32).astype(np.int64)
        assert often.sum() == links
        n_best.append(int((often * best[place]).sum()))
        count_sum.append(int((often * count[place]).sum()))
    added = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.Table.from_arrays([added.get(f.name, left.column(f.name) if f.name in left.column_names else None) for f in schema], schema=schema)


def pair_counts(listed: DataFrame) -> DataFrame:
    """How many links of the corpus hold each id pair, from the lists of slices: pair, total, and whether no pair of its B id has
    more. A B id has no more pairs than A has ids."""
    rows = listed.filter("listed is not null").select(F.explode(F.arrays_zip("listed", "counts")).alias("x"))
    total = rows.groupBy(F.col("x.listed").alias("pair")).agg(F.sum("x.counts").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = total.groupBy(b.alias("b")).agg(F.max("total").alias("highest"))
    return total.withColumn("b", b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = True) -> DataFrame:
    """docs, its texts left out, with n_a, n_b, n_groups, n_products, n_links, groups (unless told otherwise), groups_sha256,
    n_best and count_sum. a and b are the paths of tokenizer files."""
    from pyspark.sql.pandas.types import to_arrow_schema

    added = [(n, k) for n, k in ADDED if keep_groups or n != "groups"]
    own = {n for n, _ in ADDED} | {"n_best", "count_sum", "slice", "places", "times", "listed", "counts"}
    kept = docs.drop(*[c for c in docs.columns if c in own])
    plain = T.StructType([f for f in kept.schema if f.name != "text"])
    middle = T.StructType(plain.fields + [T.StructField(n, T._parse_datatype_string(k)) for n, k in added] + [
        T.StructField("slice", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("listed", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    ])
    arrow = to_arrow_schema(middle)
    listed = materialise(map_arrow(kept, lambda batches: _listed(batches, arrow, a, b, keep_groups), middle), "alignment")
    pairs = listed.filter("listed is not null").select(F.col("slice").alias("of"), F.posexplode("listed").alias("place", "pair"))
    counted = pairs.join(pair_counts(listed), "pair").select("of", "place", "total", "best")
    final = T.StructType(plain.fields + [T.StructField(n, T._parse_datatype_string(k)) for n, k in [*added, ("n_best", "bigint"), ("count_sum", "bigint")]])
    result = to_arrow_schema(final)
    rows = listed.drop("listed", "counts")
    return rows.groupBy("slice").cogroup(counted.groupBy("of")).applyInArrow(lambda left, right: _scored(left, right, result), final)
