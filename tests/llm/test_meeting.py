"""Many windows on the same lists: texts and items of ten words, against a search of every window in every text."""

from __future__ import annotations

import random

import pytest

from strikeline.llm import decontaminate


@pytest.mark.parametrize(("phrases", "expected"), [(50_000, 1000), (7, 1), (7, 10**9)])
def test_windows_of_frequent_words(spark, monkeypatch, phrases, expected):
    monkeypatch.setattr(decontaminate, "PHRASES", phrases)
    monkeypatch.setattr(decontaminate, "EXPECTED", expected)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 6000)
    rng = random.Random(phrases)
    word = lambda n: [f"w{rng.randint(0, 9)}" for _ in range(n)]
    items = [word(rng.choice([0, 2, 5, 13, 30])) for _ in range(25)]
    texts = [word(200) for _ in range(30)]
    for t in texts[::3]:
        item = rng.choice(items)
        t[50 : 50 + len(item)] = item
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    given = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.annotate(docs, given).collect()}
    for k, t in enumerate(texts):
        hit, found = set(), set()
        for i, item in enumerate(items):
            size = min(13, len(item))
            windows = {tuple(item[x : x + size]) for x in range(len(item) - size + 1)} if item else set()
            for p in range(len(t) - size + 1) if item else ():
                if tuple(t[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    found.add(str(i))
        assert (got[k].n_words, got[k].n_hit, got[k]["items"]) == (len(t), len(hit), sorted(found))
