"""A stored index for cosine search: inverted lists around centres, residual codes with proven error, and exact ranks.

Centres come from spherical k-means, whose rounds are Spark aggregates over a sample of bounded size; every row is then indexed. A row is
stored in the list of its nearest centre with its vector, its difference from the centre in bytes (one scale a row), and the length of
what the bytes leave out. For a query q and that length e, the product with the stored vector differs from that with the coded one by at
most |q| e, so a scan of the codes alone gives bounds of every product.

A search reads only the directories of the lists it probes and of them only codes. A row stays if its upper bound reaches the query's
k-th best lower bound; only those rows' vectors are read, and ranked exactly. So the result is exact for the lists that are probed, and with
``exact`` for all rows. How many lists to probe is measured when the index is built: a sample of rows is compared with all rows, and for
each number of probes the share of true neighbours in the probed lists is stored. A search asks for a share, 0.9 by default; where no
smaller number reaches it, all lists are scanned.

Queries are a stated set and are read in blocks, so what is sent to executors is bounded: a block of queries and the centres, at most
``MOST_CENTRES``. Null vectors are left out. Rows of one id are rows of their own. An empty table makes an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from millrace.functions import text as T
from millrace.operators import retrieval

MOST_CENTRES = 65_536
#: Rows of the sample for each centre, rounds of k-means, and rows whose neighbours are measured.
PER_CENTRE, ROUNDS, MEASURED = 256, 10, 200
#: Neighbours that a measurement asks for.
NEIGHBOURS = 10
#: Slack of comparisons between bounds, for rounding in double precision.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """A stored index: centres and the share of true neighbours by the number of probed lists."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    shares: tuple[float, ...]
    kind: str
    schema: str

    @property
    def lists(self) -> int:
        return len(self.centres)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/lists")

    def probes_for(self, share: float) -> int:
        """The fewest lists that held this share of the measured neighbours; all lists if none did."""
        return next((n + 1 for n, s in enumerate(self.shares) if s >= share), self.lists)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, "f8") for x in column.to_pylist()])


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def centres_of(rows: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of (iid, v), by spherical k-means; tasks add up vectors by centre, Spark adds up the tasks'."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("iid"), "iid").limit(lists).select("v").collect()
    if not first:
        return np.zeros((0, 0))
    centres = _unit(np.array([r["v"] for r in first], "f8"))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(shared.value), np.zeros(len(shared.value), "i8")
            for batch in batches:
                if batch.num_rows:
                    m = _unit(_matrix(batch.column(0)))
                    near = (m @ shared.value.T).argmax(1)
                    np.add.at(total, near, m)
                    n += np.bincount(near, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["list", "total"])

        parts = rows.select("v").mapInArrow(add_up, "list int, total array<double>").select("list", F.posexplode("total").alias("at", "x"))
        # Rounding keeps the order in which tasks are added out of the result.
        sums = parts.groupBy("list", "at").agg(F.round(F.sum("x"), 9).alias("x")).collect()  # a row a component of the centres
        moved = centres.copy()
        for row in sums:
            moved[row["list"], row["at"]] = row["x"]
        moved = _unit(moved)
        still = np.abs(moved - centres).max() < 1e-6
        centres = moved
        shared.unpersist()
        if still:
            break
    return centres


def coded(items: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``items`` with list, _code, _scale and _left (the length of what the code leaves out)."""
    shared = items.sparkSession.sparkContext.broadcast(centres)
    others = [c for c in items.columns if c != vector]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(vector))
            near = (_unit(m) @ shared.value.T).argmax(1)
            rest = m - shared.value[near]
            scale = np.abs(rest).max(1) / 127
            codes = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype("i1")
            left = np.linalg.norm(rest - codes * scale[:, None], axis=1)
            more = [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(left)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "list", "_code", "_scale", "_left"])

    return items.select(*others, vector).mapInArrow(code, ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in [*others, vector]) + ", list int, _code binary, _scale double, _left double")


def build(items: DataFrame, path: str, iid: str = "vec_id", vector: str = "embedding", lists: int | None = None, rounds: int = ROUNDS, per_centre: int = PER_CENTRE) -> Index:
    """Writes an index of ``items``, all columns kept, under ``path``. ``lists``: the root of the number of rows by default."""
    spark, path = items.sparkSession, path.rstrip("/")
    rows = items.where(F.col(vector).isNotNull())
    n = rows.count()
    lists = min(MOST_CENTRES, max(1, min(n, lists or round(n**0.5))))
    if not n:
        lists = 1
    plain = rows.select(F.col(iid).alias("iid"), F.col(vector).cast("array<double>").alias("v"))
    every = max(1, n // (lists * per_centre))  # one row of so many, chosen by a hash
    centres = centres_of(plain.where(F.pmod(F.xxhash64("iid"), F.lit(every)) == 0) if every > 1 else plain, lists, rounds)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    # Rebalancing lets adaptive execution divide a list that holds most rows among tasks.
    written = coded(rows, centres, vector)
    written.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index = Index(spark, path, centres, (), vector, written.schema.json())
    shares = measured(index, iid) if n else (1.0,)
    spark.createDataFrame([(list(map(float, shares)), vector, index.schema)], "shares array<double>, vector string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/measured")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    path = path.rstrip("/")
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    row = spark.read.parquet(f"{path}/measured").first()
    return Index(spark, path, centres, tuple(row["shares"]), row["vector"], row["schema"])


def add(index: Index, items: DataFrame) -> None:
    """Rows beside those that are there, in the lists of the same centres."""
    rows = items.where(F.col(index.kind).isNotNull())
    coded(rows, index.centres, index.kind).hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{index.path}/lists")


def measured(index: Index, iid: str = "vec_id", asked: int = MEASURED, k: int = NEIGHBOURS) -> tuple[float, ...]:
    """For 1, 2, .. probed lists the share of the true k nearest rows, of ``asked`` rows chosen by a hash, that these lists hold."""
    rows = index.rows()
    # Another order than that of the first centres: rows that the centres began with have their neighbours in fewer lists than others have.
    sample = rows.orderBy(F.xxhash64(F.lit("measured"), iid), iid).limit(asked).select(F.col(iid).alias("qid"), index.kind)
    hits = retrieval.top_k(sample, rows, k, iid=iid, vector=index.kind).select("qid", F.col("iid").alias(iid))
    found = hits.join(rows.select(iid, "list"), iid).join(sample, "qid").select("list", index.kind).collect()  # asked * k rows
    if not found:
        return (1.0,)
    order = np.argsort(-(np.array([r[index.kind] for r in found], "f8") @ index.centres.T), axis=1, kind="stable")
    at = (order == np.array([r["list"] for r in found])[:, None]).argmax(1)
    return tuple((np.bincount(at, minlength=index.lists).cumsum() / len(at)).tolist())


def search(
    queries: DataFrame, index: Index, k: int, qid: str = "qid", iid: str = "vec_id", where: Column | None = None,
    share: float = 0.9, probes: int | None = None, exact: bool = False, block: int = retrieval.QUERY_BLOCK,
) -> DataFrame:
    """qid, iid, distance, relevance, rank: the k nearest rows of each query; ties by id.

    ``probes``: lists to read for a query; by default as many as held ``share`` of the measured neighbours. ``exact``: all lists.
    """
    spark, vector = index.spark, index.kind
    probes = index.lists if exact else min(index.lists, probes or index.probes_for(share))
    rows = index.rows()
    rows = rows.where(where) if where is not None else rows
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    kinds = asked.schema["qid"].dataType, rows.schema[iid].dataType
    bounds_ddl = f"qid {kinds[0].simpleString()}, iid {kinds[1].simpleString()}, list int, low double, high double"
    arrow = to_arrow_type(kinds[0])
    out = spark.createDataFrame([], f"qid {kinds[0].simpleString()}, iid {kinds[1].simpleString()}, distance double, rank int")
    for held in retrieval._blocks(asked, block) if index.lists else ():
        matrix = np.array([v for _, v in held], "f8")
        near = matrix @ index.centres.T
        of_query = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, of_query, True, 1)
        shared = spark.sparkContext.broadcast(([q for q, _ in held], matrix, near, probed, np.linalg.norm(matrix, axis=1)))
        wanted = np.flatnonzero(probed.any(0)).tolist()
        some = rows if len(wanted) == index.lists else rows.where(F.col("list").isin(wanted))

        def bounds(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, near, probed, size = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("list").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("_code").to_pylist()), "i1").reshape(batch.num_rows, -1)
                middle = near[:, lists] + (q @ codes.T.astype("f8")) * batch.column("_scale").to_numpy()
                slack = size[:, None] * batch.column("_left").to_numpy() + SLACK
                low = np.where(probed[:, lists], middle - slack, -np.inf)
                least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
                a, b = np.nonzero(probed[:, lists] & (middle + slack >= least[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a], arrow), batch.column("iid").take(pa.array(b)), batch.column("list").take(pa.array(b)), pa.array(low[a, b]), pa.array((middle + slack)[a, b])], names=["qid", "iid", "list", "low", "high"])

        scanned = some.select(F.col(iid).alias("iid"), "list", "_code", "_scale", "_left").mapInArrow(bounds, bounds_ddl)
        by_low = Window.partitionBy("qid").orderBy(F.desc("low"))
        kth = F.min(F.when(F.col("_n") <= k, F.col("low"))).over(Window.partitionBy("qid"))
        near_enough = scanned.withColumn("_n", F.row_number().over(by_low)).withColumn("_least", kth).where("high >= _least").select("qid", "iid", "list").distinct()
        asked_rows = asked.select("qid", F.col("v").alias("_q"))
        # Only the vectors of the rows that may be among the best are read from their lists.
        exact_rows = near_enough.join(some.select(F.col(iid).alias("iid"), "list", F.col(vector).cast("array<double>").alias("v")), ["iid", "list"]).join(asked_rows, "qid")
        distance = F.round(1 - retrieval.dot(F.col("_q"), F.col("v")), retrieval.DIGITS)
        best = Window.partitionBy("qid").orderBy("distance", "iid")
        ranked = exact_rows.select("qid", "iid", distance.alias("distance")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = out.unionByName(ranked)
    return out.withColumn("relevance", T.relevance(F.col("distance")))
