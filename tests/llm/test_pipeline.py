"""The pipeline, stage by stage, against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from palimpsest.llm import pieces, pii, quality  # noqa: E402
from palimpsest.llm.common import saved, shared_dir  # noqa: E402
from palimpsest.llm.queries import ORACLE_SQL, QUERIES, vocabulary  # noqa: E402

from .test_text import _decontaminated, _groups  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, folder, results = docs.columns, shared_dir(spark), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, sf), folder, str(i))
        results.append(docs)
        assert docs.columns == columns or i == 4
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    left = {i for i, k in db.sql(f"select doc_id, kept from ({quality.SQL})").fetchall() if k}
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(results[0]) == left
    rows = [(i, before[i]) for i in sorted(left)]
    left = {d for d, _, _, lead in _groups(rows, 5) if lead}
    assert ids(results[1]) == left
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r[0] for r in _decontaminated([(i, before[i]) for i in sorted(left)], bench) if not r[-1]}
    assert ids(results[2]) == left
    field = pii.trained()
    masked = {i: pii.masked_text(before[i], pii.spans_of(field, [before[i]])[0][1]) for i in left}
    assert {r.doc_id: (r.text, r.n_chars) for r in results[3].collect()} == {i: (t, len(t)) for i, t in masked.items()}
    sp = pieces.pieces(vocabulary("piece_bpe_32k.model")).library
    want = {i: (len(x := sp.encode(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, t in masked.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in results[4].collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == {tuple(r) for r in results[4].collect()}


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "sentencepiece"]


def test_stages_take_odd_rows(spark, sf):
    """Nulls in every column, repeated rows and ids, empty texts, columns of other names."""
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [
        (1, word(1), "en", "a", 9, "clash"), (1, word(1), "en", "a", 9, "clash"), (None, word(1), None, None, None, None), (2, None, "en", "a", 9, "clash"), (3, "", None, "", 0, ""),
        (4, word(4) + " mail a.b@c.org", None, None, None, None), (4, word(5), "de", "b", 1, "x"), (None, word(6), "de", "b", 1, "x"), (5, "few words", "de", "b", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    masked = word(4) + " mail <EMAIL>"
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(1, word(1)), (4, masked), (4, word(5)), (None, word(6))], key=str)
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in last) == ["1", "4", "4", "None"]


def test_stages_take_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
