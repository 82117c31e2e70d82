"""The corpus queries over whole tables against brute force, exact round trips, SQL and held-out accuracy."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
from compare import connect, spark_rows, sql_rows

from strikeline.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def table(sf_dir):
    return lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs(table):
    return [(r["doc_id"], r["text"]) for r in table("documents")]


def rows_of(name, spark, sf_dir):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), ORACLE_SQL[name])


def test_contamination(spark, sf_dir, docs, table):
    wanted = brute.contamination(docs, [(r["item_id"], r["text"]) for r in table("benchmark")])
    found = rows_of("op1_decontamination", spark, sf_dir)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == wanted and len(found) == len(docs)
    assert any(x[4] for x in wanted.values())


def test_quality_on_held_out_rows(spark, table):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in rows_of("op2_quality", spark, sf_dir)}
    ids = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    assert sorted(found) == sorted(ids)
    for r in found.values():
        assert r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    marks = [(found[r["doc_id"]].score, r["quality"]) for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist() if r["quality"] is not None and r["doc_id"] in found and brute.fold(r["doc_id"], 4) == 2]
    score, good = (np.array(x, float) for x in zip(*marks, strict=True))
    auc = (score[good == 1][:, None] > score[good == 0][None, :]).mean()
    assert auc > 0.85, auc
    assert ((score >= 0.7) == (good == 1)).mean() > 0.75


def test_personal_data(spark, sf_dir, docs):
    found = {r.doc_id: r for r in rows_of("op3_pii", spark, sf_dir)}
    assert len(found) == len(docs)
    for doc_id, text in docs:
        base, r = brute.personal(text), found[doc_id]
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == brute.sha(",".join(line))
        assert Counter(line) <= Counter(r.spans.split(","))


def test_encoding_is_the_librarys(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    from strikeline.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of("op4_bpe", spark, sf_dir)}
    wanted = {}
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        wanted[doc_id] = (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.decode(ids, skip_special_tokens=False)))
    assert found == wanted


def test_chat_costs_are_least(spark, sf_dir, table):
    from strikeline.llm import chat

    rows = table("conversations")
    found = rows_of("op5_chat", spark, sf_dir)
    assert Counter(r.conv_id for r in found) == Counter(r["conv_id"] for r in rows)
    cost, by = defaultdict(int), defaultdict(list)
    for r in found:
        cost[r.conv_id] += r.cost
    for r in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] is None, r["role"] or "", r["text"] is None, r["text"] or "")):
        by[r["conv_id"]].append(chat.role_of(r["role"]))
    short = {c: tuple(roles) for c, roles in by.items() if len(roles) <= 5}
    least = {roles: brute.least_cost(list(roles), chat.RELABEL_COST, chat.INSERT_COST, chat.MERGE_COST) for roles in set(short.values())}
    assert short and {c: least[roles] for c, roles in short.items()} == {c: cost[c] for c in short}


def test_shards(spark, sf_dir, docs):
    found = rows_of("op7_sharding", spark, sf_dir)
    size = {i: len((t or "").encode()) + 1 for i, t in docs}
    assert {r.doc_id: r.size for r in found} == size and len(found) == len(docs)
    assert {r.law for r in found} == {"bytes"} and all(r.grown_shard is None for r in found)
    import zlib

    assert {r.doc_id: r.text_crc32 for r in found} == {i: zlib.crc32((t or "").encode()) for i, t in docs}
    total = Counter()
    for r in found:
        total[r.shard] += r.size
    assert set(total) == set(range(8))
    assert max(total.values()) - min(total.values()) <= 2 * max(size.values()) + 0.01 * sum(size.values())
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_simhash(spark, sf_dir, docs):
    prints = {i: brute.fingerprint(t) for i, t in docs}
    parts = brute.components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of("op8_simhash", spark, sf_dir)}
    assert found == {i: (f"{f:016x}", parts[i]) for i, f in prints.items()}
    assert any(i != c for i, c in parts.items())


def test_language_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in rows_of("op9_langid", spark, sf_dir)}
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert sorted(found) == sorted(r["doc_id"] for r in docs)
    right, learnt = [], {r["lang"] for r in docs if r["lang"] is not None and brute.fold(r["doc_id"], 5)}
    for d in docs:
        r = found[d["doc_id"]]
        assert r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, d["text"] or "")):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learnt
            if r.held_out and d["lang"] is not None:
                right.append(r.lang_pred == d["lang"])
    assert np.mean(right) > 0.95, np.mean(right)
