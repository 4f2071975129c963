"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import nearest, retrieval
from millrace.plans.catalog import query, table
from millrace.sources.shared import removed, shared_path, stored

DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
RELEVANCE = "round(least(1.0, greatest(0.0, 1 - (1 - dot) / 2)), 4)"
#: The stated query set: ids divisible by this, against all vectors.
ASKED = 20


def _queries(items: DataFrame) -> DataFrame:
    return items.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("qid"), "embedding")


@query(
    f"SELECT qid, iid, rank, {RELEVANCE} AS relevance FROM (SELECT qid, iid, dot, CAST(row_number() OVER (PARTITION BY qid ORDER BY 1 - dot, iid) AS INT) AS rank "
    f"FROM (SELECT q.vec_id AS qid, e.vec_id AS iid, {DOT} AS dot FROM embeddings q, embeddings e WHERE q.vec_id % {ASKED} = 0)) WHERE rank <= 5"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(_queries(items), items, 5).select("qid", "iid", "rank", "relevance")


@query(
    f"SELECT qid, iid, CAST(row_number() OVER (PARTITION BY qid ORDER BY fetched) AS INT) AS rank, {RELEVANCE} AS relevance FROM (SELECT qid, iid, dot, row_number() OVER (PARTITION BY qid ORDER BY 1 - dot, iid) AS fetched "
    f"FROM (SELECT q.vec_id AS qid, e.vec_id AS iid, {DOT} AS dot FROM embeddings q, embeddings e WHERE q.vec_id % {ASKED} = 0 AND e.label = 3)) WHERE fetched <= 7 AND iid <> qid AND {RELEVANCE} >= 0.35 QUALIFY rank <= 3"
)
def vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch 7 of one category, leave out the query itself and low scores, keep 3."""
    items = table(spark, sf_dir, "embeddings")
    hits = retrieval.top_k(_queries(items), items, 7, where=F.col("label") == 3)
    return retrieval.related(hits, F.col("iid") != F.col("qid"), 3).select("qid", "iid", "rank", "relevance")


def _indexed(spark: SparkSession, sf_dir: str) -> nearest.Index:
    return nearest.build(table(spark, sf_dir, "embeddings"), shared_path(spark, "vector-index"))


_TOPK = (
    f"SELECT qid, iid, rank, {RELEVANCE} AS relevance FROM (SELECT qid, iid, dot, CAST(row_number() OVER (PARTITION BY qid ORDER BY 1 - dot, iid) AS INT) AS rank "
    f"FROM (SELECT q.vec_id AS qid, e.vec_id AS iid, {DOT} AS dot FROM embeddings q, embeddings e WHERE q.vec_id % {ASKED} = 0{{}})) WHERE rank <= {{}}"
)


@query(_TOPK.format("", 10))
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index in its exact mode: all codes are scanned, and the vectors of the rows that their bounds leave are ranked."""
    index = _indexed(spark, sf_dir)
    out, _ = stored(nearest.search(_queries(index.rows()), index, 10, exact=True).select("qid", "iid", "rank", "relevance"), "hits")
    removed(spark, index.path)
    return out


@query(_TOPK.format(" AND e.label = 3", 3))
def index_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one label; the filter is applied to the scan of the codes."""
    index = _indexed(spark, sf_dir)
    out, _ = stored(nearest.search(_queries(index.rows()), index, 3, where=F.col("label") == 3, exact=True).select("qid", "iid", "rank", "relevance"), "hits")
    removed(spark, index.path)
    return out


@query(f"SELECT count(*) AS asked, 10 * count(*) AS neighbours, true AS reached, true AS exact_ranks FROM embeddings WHERE vec_id % {ASKED} = 0")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten true neighbours of each query, whether 0.9 are found by the lists that the index chose to probe; and whether what it finds has true distances."""
    index = _indexed(spark, sf_dir)
    items = index.rows()
    asked = _queries(items)
    found = nearest.search(asked, index, 10, share=0.95).select("qid", "iid", F.col("distance").alias("found"))
    true = retrieval.top_k(asked, items, 10).select("qid", "iid", "distance")
    both = true.join(found, ["qid", "iid"], "left")
    out = both.agg(F.countDistinct("qid").alias("asked"), F.count(F.lit(1)).alias("neighbours"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("reached"), F.bool_and(F.coalesce(F.abs(F.col("found") - F.col("distance")) < 1e-9, F.lit(True))).alias("exact_ranks"))
    out, _ = stored(out, "recall")
    removed(spark, index.path)
    return out
