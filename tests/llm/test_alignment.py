"""Alignment against all pairs of token spans, one by one."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from strikeline.llm import alignment
from strikeline.llm.queries import QUERIES, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def spans(pieces: list[bytes]) -> list[tuple[int, int]]:
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts: list[str | None]) -> list[dict]:
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(vocabulary(A))
    left.encode_special_tokens = True
    back = {c: b for c, b in alignment._byte_alphabet().items()}
    right = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    docs, counts = [], Counter()
    for t in texts:
        a, b, pa, pb = [], [], [], []
        if t:
            a, b = left.encode(" " + t, add_special_tokens=False).ids, right.encode(t)
            pa = [left.id_to_token(i) for i in a]
            pa = [bytes(back[c] for c in x) for x in pa]
            pb = [right.id_to_piece(i) for i in b]
            pb = [bytes([int(x[3:5], 16)]) if x.startswith("<0x") else x.replace("▁", " ").encode() for x in pb]
            if not b"".join(pa) == b"".join(pb) == (" " + t).encode():
                a, b, pa, pb = [], [], [], []
        sa, sb = spans(pa), spans(pb)
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        shared = sorted({y for _, y in sa} & {y for _, y in sb})
        groups = []
        for lo, hi in zip([0, *shared], shared, strict=False):
            groups.append(",".join(str(a[i]) for i, x in enumerate(sa) if lo <= x[0] < hi) + "|" + ",".join(str(b[j]) for j, y in enumerate(sb) if lo <= y[0] < hi))
        docs.append((a, b, links, groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        {"n_a": len(a), "n_b": len(b), "n_groups": len(g), "n_links": len(ln), "n_best": sum(counts[x] == top[x[1]] for x in ln), "count_sum": sum(counts[x] for x in ln),
         "groups": ";".join(g), "groups_sha256": hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""}
        for a, b, ln, g in docs
    ]


ODD = [None, "", " ", "  two  spaces ", "word", "word", "naïve café — “quoted”", "汉字と仮名 🙂🙂", "▁ piece mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tand\nnewline\r\n", "\x00\x01", "x" * 3000,
       "unsplittable" * 50, "don't can't we'll I've", "  ", "é" * 40, "1234567890" * 7, " leading", "trailing ", "　wide", "ﬁ ligature"]


def check(rows, texts, keys):
    want = brute(texts)
    for row in rows:
        for k in keys:
            assert row[k] == want[row["at"]][k], (texts[row["at"]], k)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LIST_BYTES", 200)
    monkeypatch.setattr(alignment, "STEP_BYTES", 90)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "at int, text string").repartition(3)
    rows = alignment.align(docs, vocabulary(A), vocabulary(B)).collect()
    assert sorted(r["at"] for r in rows) == list(range(len(ODD)))
    check(rows, ODD, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"])
    for r in rows:
        groups = [g.split("|") for g in r["groups"].split(";")] if r["groups"] else []
        assert r["n_products"] == sum((x.count(",") + 1) * (y.count(",") + 1) for x, y in groups) >= r["n_links"]


def test_plain_and_other_texts_agree():
    """What goes the short way has the ids that the tokenizers library gives."""
    left = alignment.ByteLevel(vocabulary(A))
    texts = [t for t in ODD if t and alignment.PLAIN.fullmatch(t)]
    assert len(texts) > 8
    for t, x in zip(texts, left.encode(texts), strict=True):
        assert x.tolist() == left.whole.encode(t, add_special_tokens=False).ids


def test_query_on_whole_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = [(i, t if t is None or len(t) < 4000 else t[:4000]) for i, t in docs]
    at = {k: n for n, (k, _) in enumerate(docs)}
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() | {"at": at[r.doc_id]} for r in QUERIES["op13_alignment"](spark, folder).collect()]
    assert len(rows) == len(docs)
    check(rows, [t for _, t in docs], ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


@pytest.mark.parametrize("rows", [[], [(None, None, 1)], [(1, "a b", 2), (1, "a b", 2), (None, "a b", 3)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_links int")
    out = alignment.align(docs, vocabulary(A), vocabulary(B))
    assert out.columns[:2] == ["doc_id", "n_a"] and len(out.collect()) == len(rows)
