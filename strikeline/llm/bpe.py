"""Byte-pair encoding in batched numpy merge rounds, and decoding.

The words of a slice of texts that the worker has not met yet are encoded together. Their symbols lie in one flat array;
in a round, the rank of every neighbouring pair comes from a binary search over the sorted keys of the merge table, the
lowest of each word is found, and all its places are merged at once. Words without a pair left drop out. Very long words
would take a round over all their symbols for each rank; they are merged rank by rank instead, a round touching only the
places of its rank and their neighbours.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import map_arrow, slices

#: Unicode White_Space, as the vocabulary's normaliser takes it.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Encoded words that a worker keeps; when more are known it starts afresh.
CACHE_WORDS = 100_000
#: Letters from which a word is merged rank by rank.
LONG = 2000
SLICE = 1 << 20
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with word ends, read from the JSON text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("only lower-casing BPE vocabularies with word ends and no decoder are supported")
        end = model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = max(*vocab.values(), *self.specials.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        into = np.array([vocab["".join(p)] for p in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into
        born = {int(x): k for k, x in reversed(list(enumerate(into)))}
        #: Merging a rank everywhere at once equals merging place by place if no merge ranks before its own parts'.
        self.at_once = len(born) == len(into) and all(max(born.get(int(a), -1), born.get(int(b), -1)) < k for k, (a, b) in enumerate(zip(left, right, strict=True)))
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(self.size)]
        self.known: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_by_rank(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of one word. As no merge ranks before its parts', all places of the lowest rank go at once, and the pairs
        that arise rank above it."""
        n = len(symbols)
        after, before, rank = np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, _NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            """Take up the pairs that begin at these places."""
            at = at[(at >= 0) & (at < n)]
            rank[at] = _NONE
            at = at[after[at] < n]
            rank[at] = self.ranks_of(symbols[at], symbols[after[at]])
            at = at[rank[at] != _NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            heads = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for part in np.split(at, heads[1:]) if len(at) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(part)

        symbols = symbols.copy()
        look(np.arange(n))
        gone = np.zeros(n, bool)
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[~gone[at] & (rank[at] == r)]
            if not len(at):
                continue
            fresh = np.append(True, after[at[:-1]] != at[1:])  # of a run of overlapping places, every second
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            other = after[at]
            symbols[at] = self.into[r]
            gone[other] = True
            after[at] = after[other]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            look(np.unique(np.concatenate([at, before[at]])))
        return symbols[~gone]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        long = [k for k, w in enumerate(words) if len(w) >= LONG] if self.at_once else []
        if not long:
            return self.merge_together(words)
        apart = set(long)
        ids, counts = self.merge_together([w for k, w in enumerate(words) if k not in apart])
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        parts = [self.merge_by_rank(self.symbols(words[k])) if k in apart else next(own) for k in range(len(words))]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def symbols(self, word: bytes) -> np.ndarray:
        flat = np.frombuffer(word, np.uint8)
        return np.append(self.inner[flat[:-1]], self.last[flat[-1]])

    def merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.ranks[at], _NONE)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, heads)
            best = np.repeat(best, np.diff(heads, append=len(word)))
            over = best == _NONE
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, best = (x[~over] for x in (symbols, word, rank, best))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            if self.at_once:  # of a run of overlapping places, every second
                fresh = np.diff(hit, prepend=-2) != 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            else:
                hit = hit[np.diff(word[hit], prepend=-1) != 0]
            symbols[hit] = self.into[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def chunks(self, text: str) -> list[str]:
        """Normalised stretches between spaces; a special token stands as itself after a space."""
        out: list[str] = []
        for k, part in enumerate(self.split_specials.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(" " + part)
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = _SPACES.sub(" ", part)
                out += part.replace("Σ", "σ").lower().split(" ")
        return out

    def learn(self, chunks: set[str]) -> None:
        if not chunks:
            return
        self.known.update({" " + t: np.array([i], "<u4").tobytes() for t, i in self.specials.items()})
        fresh = [c for c in chunks if c not in self.known]
        parts = [[p.encode() for p in self.pieces(c)] for c in fresh]
        words = list({w for p in parts for w in p})
        ids, counts = self.merge(words)
        ends, raw = (np.cumsum(counts) * 4).tolist(), ids.astype("<u4").tobytes()
        of = {w: raw[e - 4 * n : e] for w, e, n in zip(words, ends, counts.tolist(), strict=True)}
        self.known.update({c: b"".join([of[w] for w in p]) for c, p in zip(fresh, parts, strict=True)})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        all_chunks = [self.chunks(t) for t in texts]
        missing = {c for chunks in all_chunks for c in chunks if c not in self.known}
        if missing and len(self.known) + len(missing) > CACHE_WORDS:  # only here are words forgotten
            missing = {c for chunks in all_chunks for c in chunks}
            self.known.clear()
        self.learn(missing)
        known = self.known
        return [b"".join([known[c] for c in chunks]) for chunks in all_chunks]

    def decode(self, ids: bytes) -> str:
        """The tokens side by side with a space between them, as a vocabulary without a decoder gives them."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


@lru_cache(maxsize=4)
def load(text: str) -> Bpe:
    return Bpe(text)


def _round_trip(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary.value)
        for batch in slices(batches, limit=SLICE):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("row"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string(), size=len(ids))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs without text, plus n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (the text of those ids).

    vocabulary is the path of a tokenizer file that the driver reads; workers get its contents, a few MB whatever the
    data. Null counts as an empty text, which has no ids. Every row gives one row, repeated ones too; columns of docs
    named like the results are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("n_tokens", "ids", "decoded")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return map_arrow(rows, _round_trip(shared), schema).select("row.*", "n_tokens", "ids", "decoded")
