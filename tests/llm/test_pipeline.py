"""The corpus pipeline against brute force, stage after stage, and against a session without its modules."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from strikeline.llm import langid
    from strikeline.llm.queries import vocabulary

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r.doc_id for r in langid.identify(table, langid.fit(table, langid.fold(5) != 0)).filter("lang_rejected").collect()}
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist() if r["doc_id"] not in rejected]
    exact = brute.equal_texts(docs)
    docs = [d for d in docs if exact[d[0]][2]]
    near = brute.components({i: brute.fingerprint(t) for i, t in docs})
    docs = [d for d in docs if near[d[0]] == d[0]]
    marked = brute.contamination(docs, [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()])
    docs = [d for d in docs if not marked[d[0]][4]]
    assert set(found) == {i for i, _ in docs}
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert bytes(found[i].ids) == np.array(ids, "<u4").tobytes()
        assert found[i].decoded_sha256 == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_entry_without_the_corpus_modules(tmp_path):
    for name in ("__spark_entry__.py", "strikeline"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('strikeline.llm'): raise ModuleNotFoundError(name=name)\nimport __spark_entry__ as e, importlib.util as u\ne.find_spec = lambda n: None\nsys.meta_path.insert(0, No())\nassert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
