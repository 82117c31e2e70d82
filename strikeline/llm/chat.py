"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last an assistant's.
Dynamic programming over this automaton chooses for each row whether it opens a turn under its own role, opens one under
another role (relabel), or joins the turn before it (merge), and where empty turns go in, at the least total cost.

A step of the automaton is a matrix of least costs between its states, and such matrices multiply. So a conversation,
however long, may be cut into pieces of bounded rows and bytes: each piece gives its matrix, the products tell the states at
the cuts, and each piece is then solved between its own. The products are taken in two steps, first over the pieces of a
partition, then over partitions, so that none meets more of them than that. Equal costs are settled by preference and then
by a number drawn from the row, so the cuts do not show in the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import map_arrow, materialise, small

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Empty turns needed in between to open a turn of the second state after the first; pairs not listed cannot be.
BETWEEN = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (),
    (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation legally.
CLOSING = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
INSERT_COST, MERGE_COST = 2, 1
#: A piece ends at so many rows or bytes of text, or after a single longer row.
PIECE_ROWS, PIECE_BYTES = 1000, 2 << 20
#: Characters of a text by which rows of one turn and role are dealt to partitions.
OPENING = 256
#: From a row's role (0: unknown or null) to another.
RELABEL_COST = {(0, SYSTEM): 4, (0, USER): 1, (0, ASSISTANT): 1, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4, (USER, SYSTEM): 4, (USER, ASSISTANT): 4, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 4}
_COST, _PREFER = 1 << 112, 1 << 80  # a path's cost, then its preferences, then its draws


def role_of(role: str | None) -> int:
    """The state of a role name, however spaced or cased; 0 if it is none."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def steps(role: int, draw: str) -> list[tuple[int, int, int, str, int]]:
    """(state before, state after, weight, action, cost) of all that can be done with a row."""
    out = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if role == after else RELABEL_COST[role, after]
            action = "keep" if not relabel else "relabel"
            if (before, after) in BETWEEN:
                cost = relabel + INSERT_COST * len(BETWEEN[before, after])
                prefer = 2 * bool(relabel) + len(BETWEEN[before, after])
                out.append((before, after, action, cost, prefer))
            if before == after:
                out.append((before, after, "merge", relabel + MERGE_COST, 1 + 2 * bool(relabel)))
    return [(b, a, cost * _COST + prefer * _PREFER + zlib.crc32(f"{draw}|{b}|{a}|{what}".encode()), what, cost) for b, a, what, cost, prefer in out]


def through(rows: list[list], before: list[int | None]) -> tuple[list[int | None], list[list]]:
    """Least weights of the states after the rows, from weights before them, and each row's best step into each state."""
    trail = []
    for options in rows:
        after: list[int | None] = [None] * 4
        best: list = [None] * 4
        for step in options:
            if before[step[0]] is None:
                continue
            weight = before[step[0]] + step[2]
            if after[step[1]] is None or weight < after[step[1]]:
                after[step[1]], best[step[1]] = weight, step
        before = after
        trail.append(best)
    return before, trail


def solve(rows: list[list], first: int, last: int) -> list[tuple]:
    """The best step of each row on the way from state to state."""
    _, trail = through(rows, [0 if s == first else None for s in range(4)])
    out, state = [], last
    for best in reversed(trail):
        out.append(best[state])
        state = best[state][0]
    return out[::-1]


def matrix(rows: list[list]) -> list[list[int | None]]:
    return [through(rows, [0 if s == first else None for s in range(4)])[0] for first in range(4)]


def chained(weights: list[int | None], m: list[list[int | None]]) -> tuple[list[int | None], list[int | None]]:
    """Least weights of the states after a piece, and from which state before it each comes."""
    options = [[(weights[b] + m[b][a], b) for b in range(4) if weights[b] is not None and m[b][a] is not None] for a in range(4)]
    return [min(o)[0] if o else None for o in options], [min(o)[1] if o else None for o in options]


def product(matrices: list[list[list[int | None]]]) -> list[list[int | None]]:
    """The matrix of pieces one after another."""
    out = []
    for first in range(4):
        weights: list[int | None] = [0 if s == first else None for s in range(4)]
        for m in matrices:
            weights, _ = chained(weights, m)
        out.append(weights)
    return out


def states_at_cuts(matrices: list[list[list[int | None]]], first: int = START, last: int | None = None) -> list[tuple[int, int]]:
    """The states in which each piece begins and ends on the way from `first` to `last`, or to the best end of a conversation."""
    weights: list[int | None] = [0 if s == first else None for s in range(4)]
    came = []
    for m in matrices:
        weights, back = chained(weights, m)
        came.append(back)
    state = last
    if state is None:
        state = min((weights[s] + INSERT_COST * len(CLOSING[s]) * _COST, s) for s in CLOSING if weights[s] is not None)[1]
    out = []
    for back in reversed(came):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def _opened(state: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n{text}"


def _safe(text: str | None) -> str:
    """Texts must not contain the marks of turns."""
    return (text or "").replace("<|im_", "<| im_")


_END = "<|im_end|>\n"


def render(path: list[tuple], texts: list[str | None], first: int, closing: bool) -> list[str]:
    """The part of the rendered conversation that each row adds; side by side they are the whole."""
    out, state = [], first
    for (before, after, _, action, _), text in zip(path, texts, strict=True):
        if action == "merge":
            out.append("\n" + _safe(text))
        else:
            out.append((_END if before != START else "") + "".join(_opened(s) + _END for s in BETWEEN[before, after]) + _opened(after, _safe(text)))
        state = after
    if closing and out:
        out[-1] += _END + "".join(_opened(s) + _END for s in CLOSING[state])
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the number of the piece that they are in, and their place."""
    key, piece, rows, size, place = None, 0, 0, 0, 0
    for batch in batches:
        numbers = []
        bytes_of = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for k, b in zip(batch.column("key").to_pylist(), bytes_of, strict=True):
            if k != key:
                key, piece, rows, size = k, 0, 0, 0
            elif rows >= PIECE_ROWS or size + b > PIECE_BYTES:
                piece, rows, size = piece + 1, 0, 0
            rows, size = rows + 1, size + b
            numbers.append(piece)
        places = pa.array(range(place, place + len(numbers)), pa.int64())
        place += len(numbers)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), places], names=[*batch.schema.names, "piece", "place"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one piece after another, which the batches hold side by side; a piece is bounded."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in _PIECE), strict=True))
        start = 0
        for k, name in enumerate(names):
            if name != last:
                held.append(batch.slice(start, k - start))
                if sum(x.num_rows for x in held):
                    yield pa.concat_batches(held)
                held, start, last = [], k, name
        held.append(batch.slice(start))
    if sum(x.num_rows for x in held):
        yield pa.concat_batches(held)


_PIECE = ("key", "part", "piece")


def _options(piece: pa.RecordBatch) -> list[list]:
    """What can be done with each row. The draws also depend on the text: rows that tie in turn and role have draws of their own."""
    return [steps(role_of(role), f"{key}|{turn}|{role}|{text}") for key, turn, role, text in zip(*(piece.column(c).to_pylist() for c in ("key", "turn", "role", "hash")), strict=True)]


def _flat(m: list[list[int | None]]) -> list[str | None]:
    return [None if w is None else str(w) for line in m for w in line]


def _square(flat: list[str | None]) -> list[list[int | None]]:
    return [[None if w is None else int(w) for w in flat[4 * k : 4 * k + 4]] for k in range(4)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        weights = pa.array([_flat(matrix(_options(piece)))], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(piece.column(k).slice(0, 1) for k in _PIECE), weights], names=[*_PIECE, "weights"])


def _products(pieces: pd.Series) -> pd.Series:
    return pd.Series([_flat(product([_square(r["weights"]) for r in sorted(rows, key=lambda r: r["piece"])])) for rows in pieces])


def _part_cuts(parts: pd.Series) -> pd.Series:
    out = []
    for rows in parts:
        rows = sorted(rows, key=lambda r: r["part"])
        cuts = states_at_cuts([_square(r["weights"]) for r in rows])
        out.append([{"part": int(r["part"]), "first": a, "last": b, "ends": k == len(rows) - 1} for k, (r, (a, b)) in enumerate(zip(rows, cuts, strict=True))])
    return pd.Series(out)


def _piece_cuts(pieces: pd.Series, first: pd.Series, last: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for rows, a, b, end in zip(pieces, first, last, ends, strict=True):
        rows = sorted(rows, key=lambda r: r["piece"])
        cuts = states_at_cuts([_square(r["weights"]) for r in rows], int(a), int(b))
        out.append([{"piece": int(r["piece"]), "first": x, "last": y, "closes": bool(end) and k == len(rows) - 1} for k, (r, (x, y)) in enumerate(zip(rows, cuts, strict=True))])
    return pd.Series(out)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"action": pa.string(), "role_out": pa.string(), "inserted": pa.int32(), "cost": pa.int32(), "fragment": pa.string()}
    for piece in _pieces(batches):
        first, last, closes = (piece.column(k)[0].as_py() for k in ("first", "last", "closes"))
        path = solve(_options(piece), first, last)
        parts, out = render(path, piece.column("text").to_pylist(), first, closes), []
        for k, (before, after, _, action, cost) in enumerate(path):
            inserted = 0 if action == "merge" else len(BETWEEN[before, after])
            if closes and k == len(path) - 1:
                inserted, cost = inserted + len(CLOSING[after]), cost + INSERT_COST * len(CLOSING[after])
            out.append((action, ROLES[after - 1], inserted, cost, parts[k]))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column("row"), *columns], names=["row", *kinds])


def repair(turns: DataFrame) -> DataFrame:
    """All columns of turns(conv_id, turn, role, text) plus action, role_out, inserted, cost and fragment, a row for every row.

    Rows of a conversation are taken by turn (null last), then role and text; their fragments in that order are the rendered
    conversation. inserted and cost count empty turns before the row, and after it where it is the last. Rows with a null
    conv_id are one conversation; an unknown or null role fits any at a cost; null texts are empty. Rows repeated in full are
    rows each. Columns of turns named like the results are replaced; no rows give no rows.
    """
    added = [T.StructField(c, T.IntegerType() if c in ("inserted", "cost") else T.StringType()) for c in ("action", "role_out", "inserted", "cost", "fragment")]
    names = [f.name for f in added]
    turns = turns.drop(*names)
    rows = turns.select(F.struct(*turns.columns).alias("row"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("row.conv_id").cast("string")), F.lit("")))
    by_turn = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last()]
    order = [*by_turn, F.col("text").asc_nulls_last()]
    # The order of partitions is the order inside them, as far as the opening of a text goes; rows that agree so far stay together.
    opening = F.left("text", F.lit(OPENING)).asc_nulls_last()
    ranged = rows.repartitionByRange("key", *by_turn, opening).withColumn("part", F.spark_partition_id()).sortWithinPartitions("key", *order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("piece", T.LongType()), T.StructField("place", T.LongType())])
    ranged = materialise(map_arrow(ranged, _numbered, schema), "turns")
    sorted_by = lambda df: df.repartition(*_PIECE).sortWithinPartitions(*_PIECE, "place")
    weights = map_arrow(sorted_by(ranged.select(*_PIECE, "place", "turn", "role", "hash")), _matrices, "key string, part int, piece long, weights array<string>")
    pieces = materialise(weights.groupBy("key", "part").agg(F.collect_list(F.struct("piece", "weights")).alias("pieces")), "pieces")  # those of one partition
    parts = pieces.select("key", "part", F.pandas_udf(_products, "array<string>")("pieces").alias("weights"))
    parts = parts.groupBy("key").agg(F.collect_list(F.struct("part", "weights")).alias("parts"))  # an entry a partition
    ends = parts.select("key", F.explode(F.pandas_udf(_part_cuts, "array<struct<part:int,first:int,last:int,ends:boolean>>")("parts")).alias("c")).select("key", "c.*")
    cuts = F.pandas_udf(_piece_cuts, "array<struct<piece:bigint,first:int,last:int,closes:boolean>>")
    states = pieces.join(ends, ["key", "part"]).select("key", "part", F.explode(cuts("pieces", "first", "last", "ends")).alias("c")).select("key", "part", "c.*")
    states = materialise(states, "cuts")
    ready = sorted_by(ranged.join(small(states), list(_PIECE)))
    return map_arrow(ready, _repair, T.StructType([ranged.schema["row"], *added])).select("row.*", *names)


def conversations(repaired: DataFrame) -> DataFrame:
    """Per conversation: rows, turns after the repair, and what was done, from the rows that `repair` returns."""
    count = lambda a: F.sum((F.col("action") == a).cast("long"))
    return repaired.groupBy("conv_id").agg(
        F.count("*").alias("n_rows"),
        (F.sum((F.col("action") != "merge").cast("long")) + F.sum("inserted")).alias("n_turns"),
        count("merge").alias("n_merged"),
        count("relabel").alias("n_relabelled"),
        F.sum("inserted").alias("n_inserted"),
        F.sum("cost").alias("cost"),
    )
