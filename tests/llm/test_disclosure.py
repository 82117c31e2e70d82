"""Disclosure by values and by their classes against the formula over sets of texts, and both ways to find the terms."""

from __future__ import annotations

import math
import random
import re

import pytest

from strikeline.llm import pii


def corpus(seed: int) -> list[str | None]:
    """Plain words everywhere; some stand near addresses of one domain, or near numbers of one network, and nowhere else."""
    rng = random.Random(seed)
    plain = lambda n: " ".join(rng.choice(["tree", "river", "stone", "cloud", "field", "grain"]) for _ in range(n))
    texts: list[str | None] = [None, "", *(plain(20) for _ in range(120))]
    for k in range(24):
        texts.append(f"{plain(6)} {rng.choice(['kestrel', 'osprey'])} person{k}@wing.example {plain(6)}")
    for k in range(12):
        texts.append(f"{plain(6)} harbour 10.20.{k % 3}.{k} {plain(3)} +49 30 {1000000 + k} {plain(6)}")
    texts += ["kestrel over the river", "harbour and stone"] + texts[130:134]
    return texts


def brute(texts, least):
    """Best disclosure of each term, from sets of different texts."""
    different = sorted({t or "" for t in texts})
    n = len(different)
    of_term, of_entity, both = {}, {}, {}
    for i, t in enumerate(different):
        base = pii.mentions(t)
        inside = lambda m, base=base: any(m.start() < b and m.end() > a for a, b, _ in base)
        words = [m for m in re.finditer(r"[A-Za-z\u0080-\U0010FFFF]+", t)]
        for m in words:
            of_term.setdefault(m[0].lower(), set()).add(i)
        free = [m for m in words if not inside(m)]
        for a, b, kind in base:
            value = pii.entity(t, (a, b, kind))
            near = {m[0].lower() for m in [x for x in free if x.end() <= a][-pii.CONTEXT_WORDS :] + [x for x in free if x.start() >= b][: pii.CONTEXT_WORDS]}
            for e in (value, *pii.classes(value)):
                of_entity.setdefault(e, set()).add(i)
                for w in near:
                    both.setdefault((w, e), set()).add(i)
    out = {}
    for (w, e), seen in both.items():
        if len(seen) < least or len(of_entity[e]) == n:
            continue
        smoothing = pii.SMOOTHING if e.startswith("email:@") or e[-1] in ".-" else 0
        score = math.log2(n * len(seen) / ((len(of_term[w]) + smoothing) * len(of_entity[e]))) / math.log2(n / len(of_entity[e]))
        out[w] = max(out.get(w, (-9, "")), (score, e.split(":")[0]))
    return out


@pytest.mark.parametrize("at", [0.1, 0.5, 0.75])
def test_terms_by_formula(spark, at):
    texts = corpus(1)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    got = {r.term: (r.disclosure, r.kind) for r in pii.disclosing_terms(docs, generalise_at=at).collect()}
    want = {w: x for w, x in brute(texts, pii.MIN_SUPPORT).items() if x[0] >= at}
    assert got.keys() == want.keys() and {"kestrel", "osprey", "harbour"} <= got.keys()
    for w in want:
        assert got[w][1] == want[w][1] and abs(got[w][0] - want[w][0]) < 1e-9


def test_both_ways_and_clean_texts(spark, monkeypatch):
    texts = corpus(2)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    held = sorted(map(tuple, pii.sanitise(docs).collect()))
    monkeypatch.setattr(pii, "HELD_TERMS", 0)
    assert sorted(map(tuple, pii.sanitise(docs).collect())) == held
    by = {r[0]: r for r in held}
    columns = pii.sanitise(docs.limit(1)).columns
    spans, clean = columns.index("spans"), columns.index("sanitised")
    touched = [k for k, t in enumerate(texts) if by[k][spans]]
    assert any("term:" in by[k][spans] for k in touched)
    for k, t in enumerate(texts):
        if not re.search("[0-9@]|kestrel|osprey|harbour", t or ""):
            assert by[k][spans] == "" and by[k][clean] == (t or "")


@pytest.mark.parametrize(("value", "found"), [
    ("email:a@b.c.example", ["email:@b.c.example", "email:@c.example"]), ("email:a@c.example", ["email:@c.example"]), ("ip:010.2.003.4", ["ip:10.2.3.", "ip:10.2."]),
    ("card:4111111111111111", ["card:411111-", "card:4111-"]), ("phone:4930123456", ["phone:4930-", "phone:49-"]),
])
def test_classes(value, found):
    assert pii.classes(value) == found
