"""The registered queries and the pipeline."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from brute import component_ids, measures, words
from oracle import connect, differences

from opslens.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    numbers = [m[1] for q in QUERIES if (m := re.match(r"op(\d+)_", q))]
    assert sorted(map(int, numbers)) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


def test_queries_with_sql_match_it(spark, sf_dir):
    duck = connect(sf_dir)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, sf_dir), duck, sql) == []


def test_native_queries_run_no_python(spark, sf_dir):
    for name in ("op7_mixing", "op9_quality_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_stages_against_brute_force(spark, frame, messy, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = frame(messy)

    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    for r in good.collect():
        m = measures(r.text)
        assert m[0] >= 50 and 100 * m[4] <= 50 * m[0]

    unique = stages["exact_dedup"](spark, good, sf_dir).cache()
    assert unique.columns == docs.columns
    texts = Counter((r.text or "").encode().lower() for r in unique.collect())
    assert set(texts.values()) == {1}
    assert set(texts) == {(r.text or "").encode().lower() for r in good.collect()}

    apart = stages["near_dedup"](spark, unique, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in unique.collect() if r.doc_id is not None]
    left = {r.doc_id for r in apart.collect() if r.doc_id is not None}
    groups = component_ids(rows, 5)
    assert left == set(groups)

    mixed = stages["mixing"](spark, apart, sf_dir).cache()
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3
    assert set(times) <= {(r.doc_id, r.text) for r in apart.collect()}

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    whole = Counter(r.doc_id for r in packed if r.piece == 0)
    assert whole == Counter(r.doc_id for r in mixed.collect())
    assert all(words(t) for _, t in times)


def test_pipeline_runs_on_tables_and_on_none(spark, frame, sf_dir):
    found = QUERIES["pipeline"](spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
