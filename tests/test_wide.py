"""Tables that grow with the input are joined by shuffle: small files may hold rows that fill the driver."""

import numpy as np
import pytest
from conftest import DATA

from millrace import plans
from millrace.operators import diff, ordered, retrieval, search
from millrace.plans import code_queries


def joins(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("SortMergeJoin"), text.count("BroadcastHashJoin") + text.count("BroadcastNestedLoopJoin")


@pytest.fixture
def plan_of_stored(monkeypatch):
    """The plans of tables that are stored, by name."""
    seen = {}
    for module in (diff, ordered, search, code_queries):
        if hasattr(module, "stored"):

            def watched(df, name, store=module.stored):
                seen[name] = joins(df)
                return store(df, name)

            monkeypatch.setattr(module, "stored", watched)
    return seen


@pytest.mark.parametrize("name", ["change_lines", "change_options", "python_module_changes", "review_changes"])
def test_changes_broadcast_nothing(spark, plan_of_stored, name):
    plans.QUERIES[name](spark, DATA)
    assert plan_of_stored["scopes"] == (1, 0) and plan_of_stored["changes"] == (4, 0)


def test_rollup_of_files_broadcasts_nothing(spark):
    assert joins(plans.QUERIES["file_rollup"](spark, DATA)) == (1, 0)


@pytest.mark.parametrize("name", ["review_payload", "review_chunks"])
def test_groups_broadcast_only_a_row_a_partition(spark, plan_of_stored, name):
    plans.QUERIES[name](spark, DATA)
    assert plan_of_stored["groups"] == (2, 2)


def test_imports_broadcast_nothing(spark):
    assert joins(plans.QUERIES["source_imports"](spark, DATA)) == (2, 0)


@pytest.mark.parametrize("name, at", [("function_neighbours", "neighbours"), ("change_contexts", "contexts"), ("index_search", "hits")])
def test_searches_store_their_index_and_broadcast_nothing(spark, plan_of_stored, name, at):
    plans.QUERIES[name](spark, DATA)
    assert plan_of_stored["index"] == (0, 0) and plan_of_stored[at][0] > 0 and plan_of_stored[at][1] == 0


def test_many_queries_pass_over_the_items_once(spark):
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(40, 6)), 3, axis=0)  # equal vectors tie by id
    items = spark.createDataFrame([(f"i{i:03d}", x.tolist()) for i, x in enumerate(v)], "vec_id string, embedding array<double>")
    q = np.concatenate([v[::3], rng.normal(size=(2060, 6))])
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, embedding array<double>")
    hits = retrieval.top_k(asked, items, 4)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    distance = np.round(1 - q @ v.T, retrieval.DIGITS)
    want = {(i, n + 1): f"i{j:03d}" for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(v)), distance[i]))[:4])}
    assert {(r.qid, r["rank"]): r.iid for r in hits.collect()} == want


def test_texts_made_from_one_file_are_parsed_in_many_tasks(spark):
    assert code_queries._sources(spark, DATA).rdd.getNumPartitions() == code_queries._diffs(spark, DATA).rdd.getNumPartitions() == 4
