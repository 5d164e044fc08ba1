"""The pipeline equals its operators' brute-force decisions, stage by stage."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from alertflow.llm.common import stored, table
from llm_frames import edge_docs
from test_cleaning import SF001, _base, _contamination
from test_near_duplicates import _brute_links, _fingerprint, _labels


def test_stages_decide_as_brute_force(spark):
    raw = table(spark, SF001, "documents")
    labels = {x["doc_id"]: x["toxic"] for x in table(spark, SF001, "labels").collect()}
    items = [(x["item_id"], x["text"]) for x in table(spark, SF001, "benchmark").collect()]
    before, docs = {x["doc_id"]: x["text"] for x in raw.collect()}, raw
    for name, stage in corpus_pipeline.STAGES:
        out = stored(spark, stage(spark, docs, SF001), f"test-{name}")
        if name == "packing":
            assert {x["doc_id"] for x in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == raw.columns
        rows = {x["doc_id"]: x["text"] for x in out.collect()}
        assert len(rows) == out.count()
        if name == "toxicity":
            gone = set(before) - set(rows)
            clean = sum(labels.get(i) == 0 for i in gone)
            assert clean <= 0.02 * len(before)
        elif name == "near_duplicates":
            fps = {i: _fingerprint(t) for i, t in before.items()}
            names = sorted(set(fps.values()))
            group = _labels(names, _brute_links(names, 2))
            first = {}
            for i, f in fps.items():
                first[group[f]] = min(first.get(group[f], i), i)
            assert set(rows) == set(first.values())
        elif name == "decontamination":
            assert set(rows) == {i for i, t in before.items() if not _contamination(t, items)[-1]}
        elif name == "personal_data":
            assert set(rows) == set(before)
            for i, t in before.items():
                changed = sum(_base(t or "")[0]) > 0
                assert (rows[i] != t) == changed or not changed
                assert sum(_base(rows[i] or "")[0]) == 0
        before, docs = rows, out
    assert {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_rows(spark, empty):
    docs = edge_docs(spark)
    docs = docs.where("false") if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(spark, stage(spark, docs, SF001), f"odd-{name}")
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert not empty or out.count() == 0
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == 0) == empty


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF001)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100
