"""Removal of repeats against all strings of a window's length, one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strikeline.llm import repeats
from strikeline.llm.queries import QUERIES


def brute(texts: list[str | None], window: int) -> list[list[tuple[int, int]]]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[k : k + window] for t in raw for k in range(len(t) - window + 1))
    out = []
    for t in raw:
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                covered[k : k + window] = True
        flags = repeats.runs(covered[:-1])
        out.append(list(zip(flags[::2], flags[1::2], strict=True)))
    return out


def corpus(seed: int, n: int = 60, alphabet: str = "abcd é") -> list[str | None]:
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(10, 60)) for _ in range(5)]
    texts: list[str | None] = [None, "", "a", "a" * 300, "ab" * 200, "abcabd" * 60 + "x"]
    for _ in range(n):
        t = word(rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 3)):
            t += s + word(rng.randint(0, 40))
        if rng.random() < 0.2:
            k = rng.randint(0, len(t))
            texts.append(t[:k] + "~" + t[k:])
        texts.append(t)
    return texts + texts[10:14]


def check(spark, texts, window):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    rows = {r.doc_id: r for r in repeats.remove_repeats(docs, window).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for k, want in enumerate(brute(texts, window)):
        raw, r = (texts[k] or "").encode(), rows[k]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in want)], [*(a for a, _ in want), len(raw)], strict=True))
        assert r.spans == ",".join(f"{a}:{b}" for a, b in want), (k, raw)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), sum(b - a for a, b in want), len(want), kept)


@pytest.mark.parametrize(("seed", "window"), [(1, 16), (2, 24), (3, 17)])
def test_against_all_strings(spark, seed, window):
    check(spark, corpus(seed), window)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 3)
    check(spark, corpus(4), 24)


def test_small_steps_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 64)
    monkeypatch.setattr(repeats, "COLLECTION", 5)
    monkeypatch.setattr(repeats, "SPOOL_BYTES", 100)
    check(spark, corpus(5), 24)


def test_no_document_repeats_within_itself_by_mistake(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(5000))
    check(spark, [text, text[:100] + text[3000:3500]], 400)


@pytest.mark.parametrize("window", [8, 12, 15])
def test_collections(window):
    """The ordering alone, on texts of all lengths."""
    rng = random.Random(window)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(50)]
    times = np.array([rng.randint(1, 2) for _ in texts])
    count = Counter()
    for t, n in zip(texts, times, strict=True):
        for k in range(len(t) - window + 1):
            count[t[k : k + window]] += int(n)
    for t, flags in zip(texts, repeats.repeated_windows(texts, times, window), strict=True):
        assert flags.tolist() == [count[t[k : k + window]] > 1 for k in range(len(t) - window + 1)]


def test_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    sizes = np.array(sorted(rng.integers(1, 12, 20), reverse=True))
    words, starts = rng.integers(1, 4, int(sizes.sum())).astype(np.int32), np.cumsum(sizes) - sizes
    owner, common = repeats.order_collection(words, starts, sizes, 250)
    suffixes = [words[starts[o >> 16] + sizes[o >> 16] - (o & 0xFFFF) : starts[o >> 16] + sizes[o >> 16]].tolist() for o in owner]
    assert suffixes == sorted(suffixes) and len(suffixes) == sizes.sum()
    for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == same


@pytest.mark.parametrize("rows", [[], [(None, None, "x")], [(1, "z" * 900, "x"), (1, "z" * 900, "x"), (None, "z" * 30, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = repeats.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    assert sorted(r.n_removed for r in out.collect()) == sorted(len(t) if t and len(t) > 400 else 0 for _, t, _ in rows)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = dict(zip((k for k, _ in docs), brute([t for _, t in docs], 400), strict=True))
    text, removed = dict(docs), 0
    for r in QUERIES["op11_repeats"](spark, sf_dir).collect():
        raw, spans = (text[r.doc_id] or "").encode(), want[r.doc_id]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        removed += r.n_removed
    assert removed > 0
