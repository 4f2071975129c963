"""The stored cosine index against all pairs."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from millrace.operators import nearest, retrieval, search


def clustered(spark, n, dim=16, centres=20, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")


def hits(df):
    return {(r.qid, r["rank"]): (r.iid, r.distance) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = clustered(spark, 1500)
    return items, nearest.build(items, str(tmp_path_factory.mktemp("index") / "ix"), lists=40)


def asked(items):
    return items.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def test_exact_mode_is_all_pairs(index):
    items, ix = index
    assert hits(nearest.search(asked(items), ix, 7, exact=True)) == hits(retrieval.top_k(asked(items), items, 7))
    some = F.col("label") == 1
    assert hits(nearest.search(asked(items), ix, 4, where=some, exact=True, block=30)) == hits(retrieval.top_k(asked(items), items, 4, where=some))


def test_few_lists_hold_most_neighbours(index):
    items, ix = index
    probes = ix.probes_for(0.9)
    assert probes <= 4 and ix.shares[-1] == pytest.approx(1.0) and list(ix.shares) == sorted(ix.shares)
    true, found = hits(retrieval.top_k(asked(items), items, 10)), hits(nearest.search(asked(items), ix, 10))
    pairs = {(q, i) for (q, _), (i, _) in true.items()}
    assert len(pairs & {(q, i) for (q, _), (i, _) in found.items()}) >= 0.9 * len(pairs)


def test_only_probed_lists_are_read(index):
    items, ix = index
    one = items.where("vec_id = 20").select(F.col("vec_id").alias("qid"), "embedding")
    found = nearest.search(one, ix, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and found.first().iid == 20


def test_opened_added_and_odd_rows(spark, tmp_path):
    items = clustered(spark, 200).unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 16, 1), (5, [1.0] + [0.0] * 15, 2)], "vec_id long, embedding array<double>, label int"))
    nearest.build(items, str(tmp_path / "ix"), lists=8)
    ix = nearest.opened(spark, str(tmp_path / "ix"))
    more = spark.createDataFrame([(2000, [0.0] * 15 + [1.0], 7)], "vec_id long, embedding array<double>, label int")
    nearest.add(ix, more)
    both = items.unionByName(more)
    q = spark.createDataFrame([("a", [0.0] * 15 + [1.0]), ("b", None), ("c", [1.0] + [0.0] * 15)], "qid string, embedding array<double>")
    assert hits(nearest.search(q, ix, 3, exact=True)) == hits(retrieval.top_k(q, both, 3))
    assert nearest.search(q, ix, 1).where("qid = 'a'").first().iid == 2000
    empty = nearest.build(items.limit(0), str(tmp_path / "none"))
    assert nearest.search(q, empty, 3).count() == 0


def test_codes_bound_the_product(index):
    items, ix = index
    rows = ix.rows().limit(200).toPandas()
    q = np.random.default_rng(1).normal(size=16)
    v = np.stack(rows["embedding"])
    decoded = ix.centres[rows["list"]] + np.stack([np.frombuffer(c, "i1") for c in rows["_code"]]) * rows["_scale"].to_numpy()[:, None]
    assert (np.abs(v @ q - decoded @ q) <= np.linalg.norm(q) * rows["_left"].to_numpy() + 1e-12).all()
    assert rows["_left"].max() < 0.05


def test_search_of_text_by_a_stored_index(spark, tmp_path):
    rows = spark.range(120).selectExpr("concat('u', id) AS id", "concat('unit ', id) AS title", "concat('words w', id, ' v', id % 7) AS content", "'' AS cwe", "'info' AS severity", "if(id < 100, 'codebase', 'other') AS category", "map('file_path', concat('f', id)) AS metadata")
    rows = rows.withColumn("embedding", search.embed_texts(F.concat_ws("\n", "title", "content"))).withColumn("version", F.lit(1))
    ix = nearest.build(rows, str(tmp_path / "ix"), iid="id", lists=6)
    q = spark.createDataFrame([(1, "unit 17 words w17 v3"), (2, "unit 110 words w110 v5")], "qid int, query string")
    got = search.search_codebase(q, ix, 3, share=1.1).select("qid", "rank", "id", "relevance").collect()
    want = search.search_codebase(q, rows, 3).select("qid", "rank", "id", "relevance").collect()
    assert sorted(got) == sorted(want) and {r.id for r in got if r.qid == 1 and r["rank"] == 1} == {"u17"}


def test_tables_index(spark, tmp_path):
    items = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ix = nearest.build(items, str(tmp_path / "ix"))
    assert ix.lists == round(items.count() ** 0.5) and ix.rows().count() == items.where("embedding is not null").count()


def test_share_is_measured_on_other_rows_than_the_first_centres(spark, tmp_path):
    m = np.random.default_rng(5).normal(size=(1500, 24))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m.astype("f4"))], "vec_id long, embedding array<float>")
    ix = nearest.build(rows, str(tmp_path / "ix"), lists=210, rounds=3)
    assert abs(ix.shares[0] - nearest.measured(ix, asked=1500)[0]) < 0.06
