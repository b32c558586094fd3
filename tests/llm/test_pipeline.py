from __future__ import annotations

import os

import pytest

import corpus_pipeline
from ledgerpitch.llm import crf_pii, decontaminate, language_id
from ledgerpitch.llm.queries import ORACLES, QUERIES

from test_decontaminate import brute
from test_lsh_forest import components

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    verdicts = language_id.identify(language_id.document_evidence(docs, ["doc_id"])).collect()
    want = {r["doc_id"] for r in verdicts if r["kept"]}
    assert len(want) >= 0.99 * len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "near_duplicates":
            want = {d for d, _, c in components([(d, rows[d]["text"]) for d in want]) if d == c}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            want -= {d for d, _ in brute([(d, rows[d]["text"]) for d in want], items)}
        assert set(got) == want, name
    for doc, row in got.items():
        assert not crf_pii.base_spans(row["text"]) and row["n_chars"] == len(row["text"])
        if not crf_pii.base_spans(rows[doc]["text"]):
            assert row["lang"] == rows[doc]["lang"]
    packed = stages["packing"](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == want


def test_empty_documents_pass_every_stage(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert decontaminate.SIMILARITY == 0.8
