"""The pipeline, stage by stage, beside a brute-force version of each decision."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from recut.llm import quality_rules
from tests.llm.fixtures import documents, prose
from tests.llm.test_edges import hits_by_hand, spans_by_hand
from tests.llm.test_overlap import groups_by_hand
from tests.llm.test_queries import check_packing

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, ROOT)
        out[name] = rows.collect()
        docs = spark.createDataFrame(out[name], rows.schema)
    return out


def test_quality(spark, stages):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in stages["quality_rules"]} == kept
    assert all(len(r.text.split()) >= 50 for r in stages["quality_rules"])


def test_near_duplicates(stages):
    groups = groups_by_hand({r.doc_id: r.text for r in stages["quality_rules"]})
    assert {r.doc_id for r in stages["near_duplicates"]} == set(groups.values())


def test_decontamination(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{ROOT}/benchmark.parquet'").fetchall()
    clean = {r.doc_id for r in stages["near_duplicates"] if not hits_by_hand(r.text, items)[1]}
    assert {r.doc_id for r in stages["decontamination"]} == clean


def test_secrets(stages):
    before = {r.doc_id: r for r in stages["decontamination"]}
    assert set(before) == {r.doc_id for r in stages["secrets"]}
    for r in stages["secrets"]:
        assert spans_by_hand(r.text) == []
        assert r.n_chars == len(r.text) if r.text != before[r.doc_id].text else r == before[r.doc_id]
        if not spans_by_hand(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text or "[secret]" in r.text


def test_packing(stages):
    check_packing([r.asDict() for r in stages["packing"]], {r.doc_id: r.text for r in stages["secrets"]})


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, ROOT).collect()
    strip = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert strip(rows) == strip(stages["packing"])


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, [(1, prose(1, 80)), (1, prose(1, 80)), (2, None), (3, ""), (None, prose(2, 80)), (4, "token=abcdefgh12 " + prose(3, 80))])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert sorted((r.doc_id or 0, "[secret]" in r.text) for r in docs.collect()) == [(0, False), (1, False), (4, True)]
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()} == {None, 1, 4}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
