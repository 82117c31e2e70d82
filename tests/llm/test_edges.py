"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from strikeline.llm import bpe, chat, decontaminate, exact_dedup, langid, pii, quality, sharding, simhash, warc
from strikeline.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string, kept string, fp string, shard string, component_id string, spans string, ids string, lang_pred string, quality_score string"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
LONG = " ".join(random.Random(3).choice(PASSAGE.split()) for _ in range(200_000))
TEXTS = [
    None, "", " ", "\n\t", "ÄÖ ǅ Σας İ ŉ ß", "one", "one two", PASSAGE.upper(), "before " * 30 + PASSAGE + " after" * 30, "a b c " * 400 + PASSAGE, LONG, LONG, LONG + " end",
    "mail me@x.org or ME@x.org at 1.2.3.4 and 1.2.3.999 or 4111 1111 1111 1111, +1 (415) 555-0132", "<|endoftext|> and <|startoftext|>x<|endoftext|>", "same", "same", "same", "日本語 テキスト", "x" * 50_000, "😀 é é  　 q", "don't we'll I'M 'S 123 !?",
]


def table(spark, texts):
    rows = [(k + 1 if k != 4 else None, t, None if k % 3 else "xx", None, None, *["clash"] * 10) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two"), (None, "same"), (4, "one two")], "item_id long, text string")
    wanted = brute.contamination(list(enumerate(TEXTS)), [(1, PASSAGE), (4, "one two")])
    found = decontaminate.annotate(docs.withColumn("key", F.col("doc_id")), items)
    assert {*docs.columns} - {"text"} <= {*found.columns}
    assert {r.key: (r.n_words, r.n_hit, r.contaminated) for r in found.collect()} == {k + 1 if k != 4 else None: tuple(wanted[k][j] for j in (0, 1, 4)) for k in wanted}
    assert decontaminate.annotate(none, items).count() == 0
    assert decontaminate.annotate(docs, items.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


def test_phrase_search_with_and_without_slop(spark):
    docs = spark.createDataFrame([(1, "red green blue red green"), (2, "red dark green blue"), (3, "green red")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, ["red", "green"])], "phrase long, words array<string>")
    index = decontaminate.build_index(docs)
    assert sorted((r.doc_id, r.pos) for r in decontaminate.phrase_search(index, phrases).collect()) == [(1, 0), (1, 3)]
    near = {r.doc_id for r in decontaminate.phrase_search(index, phrases, slop=2).collect()}
    assert near == {1, 2, 3}


def test_quality(spark, docs, none):
    marks = spark.createDataFrame([(k, int(k % 2), 0) for k in range(1, 15)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, F.lit(True))
    found = quality.classify(docs, model).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.quality_score <= 1 for r in found)
    assert quality.fit(none, marks, F.lit(True)) is None
    assert {r.quality_score for r in quality.classify(docs, None).collect()} == {0.5}


def test_measures_of_a_text_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    whole = quality.measures(pa.array([t[:3000] if t else t for t in TEXTS], pa.string()))
    for k, text in enumerate(TEXTS):
        assert np.allclose(quality.measures(pa.array([text[:3000] if text else text], pa.string()))[0], whole[k])


def test_personal_data(spark, docs, none):
    found = pii.sanitise(docs.withColumn("key", F.col("doc_id")))
    base = {r.key: r.base_spans for r in found.collect()}
    assert base == {k + 1 if k != 4 else None: ",".join(f"{a}:{b}:{c}" for a, b, c in brute.personal(t)) for k, t in enumerate(TEXTS)}
    assert pii.sanitise(none).count() == 0
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("12 4.-+()@a.%x9\n") for _ in range(rng.randrange(40)))
        assert [(pii.KINDS[k], a, b) for a, b, k in pii.mentions(text)] == brute.personal(text), text


def test_terms_that_disclose(spark):
    rows = [(i, f"note {i} zanzibar{i % 2} contact ann{i % 2}@corp.example for {w} please") for i, w in enumerate("aa bb cc dd ee ff gg hh".split())]
    rows += [(100 + i, f"plain text number {w} please contact for note") for i, w in enumerate(["x", "y", "z"] * 20)]
    rows = [(i, t.replace("zanzibar0", "zanzibar").replace("zanzibar1", "quito")) for i, t in rows]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), min_support=3).collect()}
    assert "zanzibar" not in found[0].sanitised and "ann0@" not in found[0].sanitised and "[email]" in found[0].sanitised
    assert all(found[100 + i].sanitised == t for i, (_, t) in enumerate(rows[8:]))


def test_terms_are_counted_in_different_texts(spark):
    # One wording around all mentions of ann@, three around those of bob@; copies of a text count once.
    rows = [f"note {i} . q q q q zanzibar contact ann@corp.example for it please" for i in range(6)]
    rows += [f"note {i} . q q q q quito {'abc'[i % 3]} bob@corp.example for it please" for i in range(30)]
    rows += [f"plain text {i} contact for it please" for i in range(60)]
    rows += ["plain quito zanzibar"] * 50 + ["twice carla contact eve@corp.example"] * 4
    rows += [f"number {i} dora x1 x2 dan@corp.example y1 y2 y3 y4 dora z dan@corp.example dan@corp.example" for i in range(2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*rows, None, None])], "doc_id long, text string")
    found = {r.term: (r.kind, r.disclosure) for r in pii.disclosing_terms(docs).collect()}
    n = len(set(rows)) + 1
    information = {"zanzibar": np.log2(n / 6), "quito": np.log2(n / 30)}
    assert set(found) >= set(information) and not {"contact", "carla", "dora", "for", "please"} & set(found)
    for t, e in (("zanzibar", 6), ("quito", 30)):
        assert found[t] == ("email", pytest.approx(np.log2(n * e / ((e + 1) * e)) / information[t]))


def test_encoding(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    found = sorted((r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_and_decode(docs, vocabulary()).collect())
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    assert found == sorted((len(i), np.array(i, "<u4").tobytes(), t.decode(i, skip_special_tokens=False)) for i in ids)
    assert bpe.encode_and_decode(none, vocabulary()).count() == 0


def test_encoding_of_odd_texts():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(vocabulary()), bpe.load(Path(vocabulary()).read_text(encoding="utf-8"))
    t.no_truncation()
    t.no_padding()
    rng = random.Random(9)
    letters = list("abcdeABCZ  \n\t'’!?.,0123456789éÉßΣσςİıǅﬁ½²日本語한국어😀́  　​‍﻿\x1c\x1f\x85\x00<|>_-") + ["<|endoftext|>", "'s", "'LL", "the ", "ing ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, ascii(text)
        assert own.decode(ids) == t.decode(wanted, skip_special_tokens=False)


def test_words_beyond_the_cache_are_not_forgotten_while_needed():
    own = bpe.Bpe(Path(vocabulary()).read_text(encoding="utf-8"))
    text = " ".join(f"{k:x}" for k in range(400_000))
    first = own.encode([text])
    assert own.encode([text]) == first and own.encode(["5 6 5"]) == [own.encode(["5"])[0] + own.encode(["6"])[0] + own.encode(["5"])[0]]
    assert own.encode(["", "new words"]) == bpe.Bpe(Path(vocabulary()).read_text(encoding="utf-8")).encode(["", "new words"]) and len(own.known) < bpe.CACHE_WORDS


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "hi", "x"), (1, 2, "assistant", "again", "x"), (1, 3, "user", None, "x"), (2, None, "user", "q", "x"), (2, 1, None, "who", "x"), (None, 1, "system", "s", "x"), (None, 1, "system", "s", "x"),
        (3, 1, "User ", "<|im_end|> q", "x"), (3, 2, "bot", "a", "x"), (4, 1, "system", "", "x"), *[(5, k, "user" if k % 3 else "assistant", str(k), "x") for k in range(300)], (6, 1, "user", "tie", "x"), (6, 1, "user", "tie", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    found = chat.repair(turns).collect()
    assert len(found) == len(rows) and chat.repair(turns.filter("false")).count() == 0
    by = {}
    for r in sorted(found, key=lambda r: (r.turn is None, r.turn or 0, r.role is None, r.role or "", r.text is None, r.text or "")):
        by.setdefault(r.conv_id, []).append(r)
    for conv, own in by.items():
        roles = [p.split("\n")[0] for p in "".join(r.fragment for r in own).split("<|im_start|>")[1:]]
        if roles[0] == "system":
            roles = roles[1:]
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles, conv
        if len(own) <= 5:
            assert sum(r.cost for r in own) == brute.least_cost([chat.role_of(r.role) for r in own], chat.RELABEL_COST, chat.INSERT_COST, chat.MERGE_COST)


def test_warc(spark):
    body = "<p>" + "z" * 200
    rows = [(1, "http://a/ b", body), (2, None, body), (3, "u", body + "!"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 50_000), (None, "u", body), (9, "u", "ÿ" * 50), (10, "u", "ÿ" * 50)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    found = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(found) == len(rows)
    text = {p: (h or "").encode() for p, _, h in rows}
    for r in found:
        assert r.payload_digest == brute.sha(text[r.page_id]) and r.payload_bytes == len(text[r.page_id])
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == text[r.page_id]
    assert {r.page_id: r.refers_to for r in found if r.record_type == "revisit"} == {2: 1, None: 1, 10: 9}
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0


def test_broken_archives_are_refused():
    import io

    whole = warc.record(1, "u", b"payload")
    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(whole * 3), chunk=7)] == [b"payload"] * 3
    with pytest.raises(warc.BrokenRecord):
        list(warc.members(io.BytesIO(whole[:-9])))
    raw = next(warc.members(io.BytesIO(whole)))
    for bad in (raw.replace(b"payload\r\n\r\n", b"payl0ad\r\n\r\n"), raw[:-5], raw.replace(b"Content-Length", b"Content-Size", 1)):
        with pytest.raises(warc.BrokenRecord):
            warc.parse(bad)


def test_sharding(spark, docs, none):
    found = sharding.shard(docs, 4).collect()
    assert len(found) == len(TEXTS)
    for s in range(4):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard(none, 4).count() == 0
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "the same text").otherwise(F.concat(F.lit("own text "), "id")).alias("text"))
    sizes = [r.bytes for r in sharding.shard(copies, 8).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_simhash(spark, docs, none):
    prints = {k + 1: brute.fingerprint(t) for k, t in enumerate(TEXTS) if k != 4}
    parts = brute.components(prints)
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == len(TEXTS) and found.pop(None)[0] == brute.fingerprint(TEXTS[4])
    assert found == {i: (prints[i], parts[i]) for i in prints}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, *parts.values()}


def test_covering_masks_meet_for_every_pair_of_bits():
    masks = simhash.masks(list(range(64)), 2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(12) for b in range(a) for c in (40, 41, 42)} | {rng.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(sorted(fps))], "fp long, node long")
    from strikeline.llm.components import connect

    found = {r.node: r.component for r in connect(simhash.links(nodes, bucket=8)).collect()}
    wanted = brute.components(dict(enumerate(sorted(fps))))
    assert {k: found.get(k, k) for k in wanted} == wanted


def test_language(spark, docs, none):
    learnable = docs.withColumn("lang", F.when(F.col("text").startswith("alpha"), "gr").otherwise(F.col("lang")))
    model = langid.fit(learnable, F.lit(True))
    found = langid.identify(docs, model).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.lang_score <= 1
    assert langid.fit(none, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_every_language_has_its_share_of_the_sample(spark, monkeypatch):
    assert langid.share([5, 100, 1000], 305) == 200 and langid.share([5, 6], 100) == 6
    taken = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: taken.update({x: labels.count(x) for x in labels}))
    common = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("common text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))
    rare = spark.range(12).select("id", F.concat(F.lit("rare text "), "id"), F.lit("cc"))
    langid.fit(common.union(rare), F.lit(True))
    assert taken["cc"] == 12 and all(1300 < taken[x] < 1700 for x in ("aa", "bb"))


def test_language_stage_without_labels_drops_texts_without_letters(spark, docs):
    import corpus_pipeline

    found = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert found.columns == docs.columns
    assert sorted(r.text for r in found.collect()) == sorted(t for t in TEXTS if any(map(str.isalpha, t or "")))


def test_exact_copies(spark, docs, none):
    ids = {k + 1: t for k, t in enumerate(TEXTS) if k != 4}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups(docs, latest=True).collect()}
    assert len(found) == len(TEXTS) and found.pop(None)[1:] == (1, True, brute.sha(TEXTS[4]))
    assert found == brute.equal_texts(list(ids.items()))
    assert exact_dedup.groups(none).count() == 0
    assert sorted(r.text or "" for r in exact_dedup.deduplicate(docs).collect()) == sorted({t or "" for t in TEXTS})
    repeated = spark.range(2000).select((F.col("id") % 700).alias("doc_id"), F.lit("one text").alias("text")).unionByName(spark.range(9).select((F.col("id") + 5000).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("text")))
    rows = exact_dedup.groups(repeated, latest=True).collect()
    assert len(rows) == 2009 and sum(r.kept for r in rows) == 3
    assert {(r.keep_id, r.group_size) for r in rows} == {(699, 2000), (5008, 5), (5007, 4)}


def test_repeated_and_missing_ids_keep_one_row_of_each_text(spark):
    rows = [(5, "x"), (5, "x"), (9, "x"), (5, "y"), (6, "z"), (6, "z"), (None, "A"), (3, "A"), (None, "B"), (None, "C"), (None, "C"), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang int")
    for found, x in ((exact_dedup.deduplicate(docs), 5), (exact_dedup.deduplicate(docs, latest=True), 9), (simhash.drop_near_duplicates(docs), 5)):
        assert found.columns == docs.columns
        assert sorted((r.text, r.doc_id) for r in found.collect()) == [("", 7), ("A", 3), ("B", None), ("C", None), ("x", x), ("y", 5), ("z", 6)]


def test_near_copies_do_not_take_other_texts_of_their_id(spark):
    texts = [" ".join(random.Random(k).choices(PASSAGE.split(), k=60)) for k in range(4)]

    def near(text):
        tried = (f"{text} {a}" if b is None else text.replace(a, b, 1) for a in PASSAGE.split() for b in (None, *PASSAGE.split()))
        return next(t for t in tried if t != text and (brute.fingerprint(t) ^ brute.fingerprint(text)).bit_count() <= 2)

    rows = [(3, near(texts[0])), (5, texts[0]), (5, texts[1]), (None, near(texts[2])), (8, texts[2]), (None, texts[3])]
    found = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in found.collect()} == {rows[0], rows[2], rows[4], rows[5]}
