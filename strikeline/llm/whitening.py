"""Whitening of embeddings by streamed moments.

Each partition runs through its vectors once with Welford's rank-one updates: the vector k moves the mean from m to m', and the
sum of squares gains (x - m)(x - m')^T. The running means of a batch follow from cumulative sums, so the updates of a batch are
added by one matrix product; values are centred before they are multiplied. States of partitions (count, sums, mean, sum of
squares: a square matrix of the dimension) are merged by the parallel update formula in a tree, a few in a task at a time. The
covariance is reduced to tridiagonal form by reflections and solved by the implicit symmetric QR iteration. A second run, over
the whitened values, measures how far their covariance is from the identity.

Entries become integers, floor(scale * c) + offset, whose sums are exact.

Defined cases: vectors that are null, empty, or hold null, non-finite or entries of 2^40 and above are dropped; so are those whose
length is not the commonest one (the shorter of equals). Repeated rows and null ids count as rows of their own. Without a vector
there are no rows. A component without variance (an eigenvalue below dimension x 1e-15 of the largest) has null whitened values, explains 0, and is
left out of the identity error; equal eigenvalues may give any basis of their space. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import materialise

SCALE, OFFSET = 64, 1_000_000
#: Entries from here on are not counted as finite: their sums could leave a long.
LARGEST = 2.0**40
#: States that a task merges.
FAN_IN = 16
#: Vectors in a matrix product.
BATCH = 2048


@dataclass
class Moments:
    """Count, exact sums, mean and centred sum of squares of vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    squares: np.ndarray

    @staticmethod
    def none(width: int, kind: type = np.int64) -> Moments:
        return Moments(0, np.zeros(width, kind), np.zeros(width), np.zeros((width, width)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update by each row in turn."""
        if not len(rows):
            return
        seen = self.n + np.arange(1, len(rows) + 1)[:, None]
        off = rows - self.mean
        after = np.cumsum(off, axis=0) / seen
        before = np.vstack([np.zeros((1, rows.shape[1])), after[:-1]])
        self.squares += (off - before).T @ (off - after)
        self.mean = self.mean + after[-1]
        self.sums = self.sums + rows.sum(axis=0)
        self.n += len(rows)

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.sums + other.sums, self.mean + apart * (other.n / n), self.squares + other.squares + np.outer(apart, apart) * (self.n * other.n / n))

    @property
    def covariance(self) -> np.ndarray:
        return (self.squares + self.squares.T) / (2 * self.n)


STATE = "id long, n long, sums binary, mean binary, squares binary"


def _packed(key: int, m: Moments) -> pa.RecordBatch:
    row = {"id": [key], "n": [m.n], "sums": [m.sums.tobytes()], "mean": [m.mean.tobytes()], "squares": [m.squares.tobytes()]}
    return pa.RecordBatch.from_pydict(row, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("mean", pa.binary()), ("squares", pa.binary())]))


def _unpacked(n: int, sums: bytes, mean: bytes, squares: bytes, kind: type) -> Moments:
    middle = np.frombuffer(mean)
    return Moments(n, np.frombuffer(sums, kind), middle, np.frombuffer(squares).reshape(len(middle), len(middle)))


def _merged(rows: Iterator[tuple], kind: type) -> Moments | None:
    state = None
    for n, sums, mean, squares in rows:
        own = _unpacked(n, sums, mean, squares, kind)
        state = own if state is None else state.merge(own)
    return state


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def moments(vectors: DataFrame, column: str, width: int, transform=None, kind: type = np.int64) -> Moments | None:
    """Moments of an array column whose lists have `width` entries, or of what transform makes of their matrix."""
    out = width if transform is None else transform(np.zeros((0, width), np.int64)).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Moments.none(out, kind)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            for k in range(0, len(rows), BATCH):
                state.add(rows[k : k + BATCH] if transform is None else transform(rows[k : k + BATCH]))
        if state.n:
            yield _packed(TaskContext.get().partitionId(), state)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        state = _merged(zip(*(table.column(c).to_pylist() for c in ("n", "sums", "mean", "squares")), strict=True), kind)
        return pa.Table.from_batches([_packed(table.column("id")[0].as_py() // FAN_IN, state)])

    states = materialise(vectors.select(column).mapInArrow(run, STATE), "moments")
    while states.count() > FAN_IN:
        states = materialise(states.groupBy(F.floor(F.col("id") / FAN_IN).alias("part")).applyInArrow(fold, STATE), "moments")
    # At most FAN_IN states are left.
    return _merged(((r.n, bytes(r.sums), bytes(r.mean), bytes(r.squares)) for r in states.orderBy("id").collect()), kind)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q^T v q tridiagonal, by reflections."""
    a, d = np.array(v, float), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1, k] = a[k, k + 1] = -size if x[0] >= 0 else size
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, by QR steps with Wilkinson's shift on the tridiagonal form."""
    diag, off, q = tridiagonal(v)
    hi, small = len(diag) - 1, np.finfo(float).eps
    for _ in range(60 * len(diag)):
        weak = np.abs(off) <= small * (np.abs(diag[:-1]) + np.abs(diag[1:]))
        off[weak] = 0
        while hi > 0 and off[hi - 1] == 0:
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and off[lo - 1] != 0:
            lo -= 1
        half = (diag[hi - 1] - diag[hi]) / 2
        turn = half + (np.copysign(np.hypot(half, off[hi - 1]), half) if half else abs(off[hi - 1]))
        x, z = diag[lo] - (diag[hi] - off[hi - 1] ** 2 / turn), off[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            a, b, e = diag[k], diag[k + 1], off[k]
            diag[k], diag[k + 1] = c * c * a + 2 * c * s * e + s * s * b, s * s * a - 2 * c * s * e + c * c * b
            off[k] = c * s * (b - a) + (c * c - s * s) * e
            left = q[:, k].copy()
            q[:, k], q[:, k + 1] = c * left + s * q[:, k + 1], c * q[:, k + 1] - s * left
            if k < hi - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
    else:
        raise ArithmeticError("the QR iteration did not settle")
    order = np.argsort(-diag, kind="stable")
    return diag[order], q[:, order]


@dataclass
class Whitening:
    """Components of a fit list: `axes` has one in each column, already divided by the root of its eigenvalue (NaN without one)."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    @property
    def kept(self) -> np.ndarray:
        return np.isfinite(self.axes[0])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        # (n * x - S) / n, with the whole part of S / n taken off first, so that nothing is lost to its size.
        whole = self.sums // self.n
        return ((rows - whole).astype(float) - (self.sums - whole * self.n) / self.n) @ self.axes

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2; in 64 bits where that is proven to do, else in integers of any size."""
        far = max(abs(self.n * int(rows.max()) - int(self.sums.min())), abs(self.n * int(rows.min()) - int(self.sums.max()))) if rows.size else 0
        if far * far * rows.shape[1] < 2**63:
            return ((self.n * rows - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums.tolist(), strict=True)) for row in rows.tolist()]
        return [x if x < 2**63 else None for x in exact]


def fit(m: Moments, components: int) -> Whitening:
    values, vectors = symmetric_qr(m.covariance)
    least = len(values) * 1e-15 * max(values[0], 0)
    values, vectors = values[:components], vectors[:, :components]
    real = (values > least) & (values > 0)
    axes = vectors / np.sqrt(np.where(real, values, np.nan))
    trace = np.trace(m.covariance)
    return Whitening(m.n, m.sums, axes, np.where(real, values / trace if trace > 0 else 0.0, 0.0))


def integers(embedding: Column) -> Column:
    """The integer entries of a usable vector; null for others."""
    # exists() over a null entry alone gives null, which is no reason to keep the vector.
    poor = F.coalesce(F.exists(embedding, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= LARGEST)), F.lit(True))
    return F.when(~poor & (F.size(embedding) > 0), F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


def whiten(vectors: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """vectors without that column, a row for each of the first components: component, n, deviation, whitened, explained and
    identity_error. Columns of the input named as these give way."""
    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = [x.split()[0] for x in added.split(", ")]
    plain = [c for c in vectors.columns if c != column and c not in own]
    rows = vectors.select(*plain, integers(F.col(column)).alias("x")).filter("x is not null")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"] + [added])
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = width[0]
    rows = rows.filter(F.size("x") == width)
    model = fit(moments(rows, "x", width), components)
    again = moments(rows, "x", width, lambda x: model(x)[:, model.kept], float) if model.kept.any() else None
    error = float(np.abs(again.covariance - np.eye(len(again.mean))).max()) if again else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.explained)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                x = _matrix(batch.column(batch.schema.get_field_index("x")), width)
                n, white = len(x), model(x).ravel()
                each = pa.array(np.repeat(np.arange(n), k))
                made = [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                    pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, n)), pa.array([error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(each) for c in plain] + made, names=plain + own)

    return rows.mapInArrow(run, schema)
