"""Removal of long repeats: every byte inside a string of `window` bytes that also starts anywhere else in the corpus.

1. Anchors. A window's anchor is its least 128-byte string by hash, the leftmost of equals, so equal windows have equal anchors
   at the same place. Successive windows with one anchor are a fragment: each window lies in one fragment, and only fragments
   with a common anchor can share a window. Anchors that occur once in the corpus end the matter for their windows.
2. Collections. The different fragments of the remaining anchors are dealt to tasks by anchor, a few megabytes in each. A task
   builds the collection's Burrows-Wheeler order column by column: a fragment gives one document for each phase of its 8-byte
   words, and in every round each document inserts its next word, from the last to the first. The rank of a word before the place
   of its suffix gives the place of the longer one; its common prefix with both neighbours is one more than the least common
   prefix between it and the nearest suffixes that the same word precedes. Between rounds the order, its words, common prefixes
   and owners lie in sequential files, each read once from front to back and written anew (they stay in memory up to
   SPOOL_BYTES, and have no name on disk, so no task leaves one behind). Suffixes whose common prefixes cover a window are equal
   windows, and count as often as their fragments occur.
3. An anchor with more than CROWD different fragments (the edge of a passage that very many documents quote) is not put into one
   task: its windows are counted by two independent 64-bit hashes of their own.
4. The spans of repeated windows go back to their documents.

Fragments are told apart by anchor and digest, 128 bits together. Defined cases: null and texts shorter than a window have nothing
removed; repeated rows, null and equal ids count as documents of their own; columns of the input named as an added one give way.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import cuts, give_back, map_arrow, materialise, small, text_bytes

WINDOW = 400
#: Bytes of an anchor, as a part of a window.
ANCHOR_SHARE = 0.32
#: Bytes of a word, the symbol of the collections.
WORD = 8
#: Different fragments of an anchor that go into a task together, and fragments that a task should get.
CROWD = 4096
COLLECTION = 1500
SPOOL_BYTES = 16 << 20
#: Bytes that are scanned at once.
STEP = 1 << 20

_RANDOM = np.random.default_rng(400)
_VALUE = _RANDOM.integers(1, 1 << 63, (2, 256)).astype(np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Rolling:
    """Hashes of all strings of a length: sums of byte values times powers of an odd base, modulo 2^64, moved to a common power
    and mixed."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = self._table(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[which][data] * self.up[: len(data)], out=self.sums[1:])

    @classmethod
    def _table(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            made = []
            for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            have = cls._powers[which] = (made[0], made[1])
        return have

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` successive values."""
    n, span = len(values) - width + 1, 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])


def fragments(data: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor key of the fragments of texts that lie end to end."""
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchor = max(1, int(window * ANCHOR_SHARE))
    keys = Rolling(data).all(anchor)
    if len(keys) > 1 << 24:
        raise ValueError("more bytes than places have bits")
    place, low = np.arange(len(keys), dtype=np.uint64), np.uint64((1 << 24) - 1)
    chosen = _least((keys & ~low) | place, window - anchor + 1) & low
    # Windows that cross the end of a text are none.
    inside = np.zeros(len(chosen) + 1, np.int32)
    starts = np.append(0, ends[:-1])
    real = ends - starts >= window
    np.add.at(inside, starts[real], 1)
    np.add.at(inside, ends[real] - window + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1])
    opens[starts[real]] = True
    first = np.flatnonzero(opens)
    stops = np.flatnonzero(inside & np.append(opens[1:] | ~inside[1:], True)) + 1
    return first, stops - first, keys[chosen[first].astype(np.int64)]


class _Files:
    """Arrays in sequential files, each written whole and read back whole."""

    def __init__(self, **arrays: np.ndarray):
        self.files = {}
        self.put(**arrays)

    def put(self, **arrays: np.ndarray) -> None:
        for name, values in arrays.items():
            if name in self.files:
                self.files.pop(name)[0].close()
            out = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
            out.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
            self.files[name] = (out, values.dtype)

    def get(self, name: str) -> np.ndarray:
        stored, kind = self.files[name]
        stored.seek(0)
        return np.frombuffer(stored.read(), kind)

    def close(self) -> None:
        for stored, _ in self.files.values():
            stored.close()


def _folded(rows: np.ndarray) -> np.ndarray:
    """The least of each row of 16."""
    for half in (8, 4, 2, 1):
        rows = np.minimum(rows[:, :half], rows[:, half:])
    return rows[:, 0]


class _RangeMin:
    """The least of any range of small values: blocks of 16 and a table of their powers of two."""

    _column = np.arange(16)

    def __init__(self, values: np.ndarray):
        blocks = np.full(-(-max(len(values), 1) // 16) * 16, 255, np.uint8)
        blocks[: len(values)] = values
        self.blocks, least = blocks.reshape(-1, 16), blocks
        for _ in range(4):
            least = np.minimum(least[::2], least[1::2])
        self.table = [least]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From low to high, both included."""
        first, last = low >> 4, high >> 4
        # What lies outside a range is raised to the largest value.
        left = self.blocks[first] | np.where(self._column < (low & 15)[:, None], 255, 0).astype(np.uint8)
        right = self.blocks[last] | np.where(self._column > (high & 15)[:, None], 255, 0).astype(np.uint8)
        one = first == last
        out = np.where(one, _folded(left | right), np.minimum(_folded(left), _folded(right)))
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far] - 1
            level = np.frexp(b - a + 1)[1] - 1
            for k in np.unique(level):
                here = level == k
                row = self.table[k]
                out[far[here]] = np.minimum(out[far[here]], np.minimum(row[a[here]], row[b[here] - (1 << int(k)) + 1]))
        return out


def _spread(old: np.ndarray, new: np.ndarray, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """old at the places keep and new at the places at."""
    out = np.empty(len(old) + len(new), old.dtype)
    out[keep] = old
    out[at] = new
    return out


def _kept(n: int, at: np.ndarray) -> np.ndarray:
    free = np.ones(n, bool)
    free[at] = False
    return np.flatnonzero(free)


def order_collection(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of documents in order, as document and length packed in one number (document << 16 | length, the empty ones
    left out), and the common prefix of each with the one before, in words up to cap. Document d has the words
    [starts[d], starts[d] + sizes[d]), numbered from 1; sizes fall."""
    n = len(starts)
    place = np.arange(n)
    if int(sizes.sum()) + n >= 2**31:
        raise ValueError("a collection must stay below 2^31 words")
    kind = np.int32 if n < 1 << 15 else np.int64
    files = _Files(order=np.zeros(0, np.int32), words=np.zeros(0, np.int32), common=np.zeros(n, np.uint8), owner=np.zeros(n, kind))
    keep = None  # where the last round moved what was there
    for j in range(1, int(sizes[0]) + 1 if n else 1):
        active = int(np.searchsorted(-sizes, -j, side="right"))
        word = words[starts[:active] + sizes[:active] - j]
        order, known, common, owner = (files.get(x) for x in ("order", "words", "common", "owner"))
        if keep is not None:
            order = keep.astype(np.int32)[order]
        # The new words take their places among equal ones by the places of their suffixes.
        big = len(common)
        mine = word.astype(np.int64) * big + place[:active]
        turn = np.argsort(mine)
        at = np.searchsorted(known.astype(np.int64) * big + order, mine[turn]) + np.arange(active)
        keep = _kept(len(order) + active, at)
        order, known = _spread(order, place[:active][turn], at, keep), _spread(known, word[turn], at, keep)
        # Common prefixes with the neighbours in the order, as far as those begin with the same word.
        before, after = np.zeros(active, np.uint8), np.zeros(active, np.uint8)
        least = _RangeMin(common)
        same = np.flatnonzero((at > 0) & (known[at] == known[at - 1]))
        before[same] = np.minimum(least(order[at[same] - 1] + 1, order[at[same]]) + 1, cap)
        following = np.minimum(at + 1, len(order) - 1)
        same = np.flatnonzero((at + 1 < len(order)) & (known[at] == known[following]))
        after[same] = np.minimum(least(order[at[same]] + 1, order[following[same]]) + 1, cap)
        new = n + at
        keep = _kept(len(owner) + active, new)
        common, owner = _spread(common, before, new, keep), _spread(owner, turn << 16 | j, new, keep)
        has_next = new + 1 < len(common)
        common[new[has_next] + 1] = after[has_next]
        place = np.empty(active, np.int64)
        place[turn] = new
        files.put(order=order, words=known, common=common, owner=owner)
    owner, common = files.get("owner")[n:], files.get("common")[n:]
    files.close()
    return owner, common


def repeated_windows(texts: list[bytes], times: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each text, which of its windows occur more than once in all texts, each of which counts `times` times."""
    size = next(k for k in (WORD, 4, 2, 1) if window % k == 0)
    need = window // size
    if need > 250:
        raise ValueError("a window must not have more than 250 words")
    windows = np.array([max(0, len(t) - window + 1) for t in texts], np.int64)
    owner_text, phase, parts = [], [], []
    for k, t in enumerate(texts):
        for r in range(min(size, int(windows[k]))):
            owner_text.append(k)
            phase.append(r)
            parts.append(np.frombuffer(t, f">u{size}", (len(t) - r) // size, r))
    found = [np.zeros(w, bool) for w in windows]
    if not parts:
        return found
    owner_text, phase, sizes = np.array(owner_text), np.array(phase), np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32) + 1
    falling = np.argsort(-sizes, kind="stable")
    owner, common = order_collection(codes, starts[falling], sizes[falling], need)
    doc, length = falling[owner >> 16], owner & 0xFFFF
    classes = np.cumsum(common < need)
    whole = np.flatnonzero(length >= need)
    text = owner_text[doc[whole]]
    often = np.bincount(classes[whole], weights=times[text])
    hit = whole[often[classes[whole]] > 1.5]
    at, text = phase[doc[hit]] + size * (sizes[doc[hit]] - length[hit]), owner_text[doc[hit]]
    for k in np.unique(text):
        found[k][at[text == k]] = True
    return found


def runs(flags: np.ndarray) -> list[int]:
    """First and last-but-one places of the runs of set flags, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


SCANNED = "at long, frags array<struct<key: long, digest: long, windows: int, starts: array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The documents with a row number and their fragments: key, digest, number of windows and starts; one entry for all equal
    fragments of a document."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for start, n in cuts(column, STEP):
            data, offsets = text_bytes(column.slice(start, n))
            key, digest, windows, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*_pieces(data, offsets[1:], window), strict=True))
            document = np.searchsorted(offsets, at, side="right") - 1
            begin = (at - offsets[document]).astype(np.int32)
            # Equal fragments of a document lie together.
            order = np.lexsort((begin, windows, digest, key, document))
            document, key, digest, windows, begin = (x[order] for x in (document, key, digest, windows, begin))
            new = np.ones(len(order), bool)
            new[1:] = (document[1:] != document[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | (windows[1:] != windows[:-1])
            first = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(begin))
            entries = pa.StructArray.from_arrays([pa.array(key[first].view(np.int64)), pa.array(digest[first].view(np.int64)), pa.array(windows[first].astype(np.int32)), starts], names=["key", "digest", "windows", "starts"])
            bounds = np.searchsorted(document[first], np.arange(n + 1)).astype(np.int32)
            numbers = pa.array(np.arange(number, number + n))
            number += n
            part = batch.slice(start, n)
            yield pa.RecordBatch.from_arrays([*part.columns, numbers, pa.ListArray.from_arrays(pa.array(bounds), entries)], names=[*part.schema.names, "at", "frags"])
        give_back()


def _pieces(data: np.ndarray, ends: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    """Key, digest, windows and start of all fragments. Texts longer than a step are cut where no window is lost: what belongs to
    an anchor may then be two fragments, which share their anchor."""
    cut, out, view = 0, [], memoryview(data)
    empty = np.zeros(0, np.int64)
    out.append((empty.view(np.uint64), empty.view(np.uint64), empty, empty))
    while cut < len(data):
        stop = min(len(data), cut + 2 * STEP)
        if stop < len(data) and (whole := int(np.searchsorted(ends, stop, side="right"))) and ends[whole - 1] > cut:
            stop = int(ends[whole - 1])
        inner = np.unique(np.append(ends[(ends > cut) & (ends < stop)], stop)) - cut
        first, windows, key = fragments(data[cut:stop], inner, window)
        first = first + cut
        spans = zip(first.tolist(), (first + windows + window - 1).tolist(), strict=True)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(first))
        out.append((key, digest, windows, first))
        cut = stop if stop == len(data) or np.any(ends == stop) else stop - window + 1
    return out


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted fragments."""
    for batch in batches:
        columns = batch.to_pydict()
        rows = {"key": [], "digest": [], "times": [], "crowded": [], "text": []}
        for text, wanted in zip(columns["text"], columns["wanted"], strict=True):
            raw = text.encode()
            for w in wanted:
                for c in ("key", "digest", "times", "crowded"):
                    rows[c].append(w[c])
                rows["text"].append(raw[w["start"] : w["start"] + w["windows"] + window - 1])
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("times", pa.int64()), ("crowded", pa.bool_()), ("text", pa.binary())]))
        give_back()


VERDICT = "key long, digest long, runs array<int>"


def _collected(table: pa.Table, window: int) -> pa.Table:
    """Runs of repeated windows of a collection's fragments; fragments without any are left out."""
    found = repeated_windows(table.column("text").to_pylist(), table.column("times").to_numpy(), window)
    give_back()
    named = zip(table.column("key").to_pylist(), table.column("digest").to_pylist(), (runs(f) for f in found), strict=True)
    rows = [x for x in named if x[2]]
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(pa.int32()))])
    return pa.Table.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(schema.names)}, schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of crowded fragments."""
    for batch in batches:
        for key, digest, times, text in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "times", "text")), strict=True):
            data = np.frombuffer(text, np.uint8)
            one, two = (Rolling(data, k).all(window).view(np.int64) for k in (0, 1))
            n = len(one)
            yield pa.RecordBatch.from_pydict({"key": np.full(n, key), "digest": np.full(n, digest), "times": np.full(n, times), "place": np.arange(n, dtype=np.int32), "one": one, "two": two})


def _crowd_verdicts(crowd: DataFrame, window: int) -> DataFrame:
    hashed = materialise(crowd.mapInArrow(lambda b: _hashed(b, window), "key long, digest long, times long, place int, one long, two long"), "windows")
    same = ["key", "one", "two"]
    often = hashed.groupBy(*same).agg(F.sum("times").alias("total")).filter("total > 1").select(*same)
    places = hashed.join(often, same, "left_semi").groupBy("key", "digest").agg(F.array_sort(F.collect_list("place")).alias("places"))
    # Successive places are a run.
    opens = F.filter("places", lambda p, k: F.coalesce(F.get("places", k - 1) != p - 1, F.lit(True)))
    closes = F.filter("places", lambda p, k: F.coalesce(F.get("places", k + 1) != p + 1, F.lit(True)))
    return places.select("key", "digest", F.flatten(F.zip_with(opens, closes, lambda a, b: F.array(a, b + 1))).alias("runs"))


def find(scanned: DataFrame, window: int = WINDOW) -> DataFrame:
    """at, spans: the removed byte runs (start, end, start, end ...) of the documents that have any. scanned is a written table."""
    marks = scanned.select("at", F.inline("frags"))
    shared = marks.groupBy("key").agg(F.sum(F.size("starts")).alias("total")).filter("total > 1").select("key")
    live = materialise(marks.join(shared, "key"), "fragments")
    first = F.min(F.struct("at", F.get("starts", F.lit(0)).alias("start"))).alias("where")
    different = materialise(live.groupBy("key", "digest", "windows").agg(F.sum(F.size("starts")).alias("times"), first), "different")
    # Where all fragments of an anchor occur twice, nothing is left to find out.
    groups = different.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("times") == 1).alias("open"))
    several = different.join(groups.filter("n > 1 and open > 0"), "key")
    # Fragments that occur twice are repeated from end to end, whatever else shares their anchor.
    twice = different.filter("times > 1").select("key", "digest", F.array(F.lit(0), "windows").alias("runs"))
    wanted = several.select("where.at", F.struct("key", "digest", "times", (F.col("n") > CROWD).alias("crowded"), "where.start", "windows").alias("w"))
    wanted = materialise(wanted.groupBy("at").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = scanned.select("at", "text").join(small(wanted), "at").select("text", "wanted")
    texts = materialise(map_arrow(texts, lambda b: _cut(b, window), "key long, digest long, times long, crowded boolean, text binary"), "contents")
    parts = max(1, -(-texts.filter("not crowded").count() // COLLECTION))
    dealt = texts.filter("not crowded").select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "digest", "times", "text")
    ordered = materialise(dealt.groupBy("part").applyInArrow(lambda t: _collected(t, window), VERDICT), "verdicts")
    partial = ordered.unionByName(_crowd_verdicts(texts.filter("crowded"), window)) if not texts.filter("crowded").isEmpty() else ordered
    verdicts = materialise(partial.join(twice.select("key", "digest"), ["key", "digest"], "left_anti").select("key", "digest", "runs").unionByName(twice), "repeated")
    hits = live.join(verdicts, ["key", "digest"])
    # Byte runs of each fragment: from the first window of a run to the end of the last one.
    ends = F.transform("runs", lambda e, k: F.when(k % 2 == 0, e).otherwise(e + window - 1))
    spans = F.flatten(F.transform("starts", lambda s: F.transform(ends, lambda e: s + e)))
    return hits.select("at", spans.alias("spans")).groupBy("at").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _removed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, n in cuts(whole.column(whole.schema.get_field_index("text")), STEP):
            batch = whole.slice(start, n)
            made = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = (text or "").encode()
                joined = merged(spans or [])
                made["n_bytes"].append(len(raw))
                made["n_removed"].append(sum(b - a for a, b in joined))
                made["n_spans"].append(len(joined))
                made["spans"].append(",".join(f"{a}:{b}" for a, b in joined))
                made["kept"].append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in joined)], [*(a for a, _ in joined), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)
        give_back()


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of what (start, end, start, end ...) cover; touching ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (start:end in bytes, comma-joined) and kept, the remaining bytes (a span may
    begin or end inside a character)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    added = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("spans", "string"), ("kept", "binary")]
    rows = docs.drop("at", "frags", "found", *[n for n, _ in added])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [SCANNED])
    scanned = materialise(map_arrow(rows, lambda b: _scan(b, window), schema), "scanned")
    found = materialise(find(scanned, window).withColumnRenamed("spans", "found"), "found")
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} {k}" for n, k in added])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    joined = scanned.drop("frags").join(small(found), "at", "left").drop("at")
    return map_arrow(joined, lambda b: _removed(b, arrow), out)
