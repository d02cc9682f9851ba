"""The pipeline's stages and its rows against the stages' plain meaning."""

import hashlib
from collections import Counter

import corpus_pipeline
from lodestar.llm import mixing, neardup, secrets, toxicity
from lodestar.llm.shared import settle, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns, name
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        elif name == "near-dedup":
            assert {r.doc_id for r in out.collect()} == {r.class_id for r in neardup.classes(docs).collect()}
        elif name == "secrets":
            assert out.count() == docs.count() and secrets.find(out).selectExpr("sum(n_assign) + sum(n_access) + sum(n_hex) as n").first().n == 0
        else:
            taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in taken.items() if n})
        docs = out


def test_run_encodes_what_the_stages_leave(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF), "test")
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want
