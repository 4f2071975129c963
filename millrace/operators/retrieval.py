"""Cosine top-k retrieval, threshold, self exclusion, and budgets over changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions import text as T
from millrace.sources.shared import wide


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Queries are taken this many at a time, so what is sent to executors has a fixed bound; a pass over all items takes more of them, and of these so many at once.
QUERY_BLOCK, PASS, AT_ONCE = 2000, 16_000, 512
#: Distances are rounded to so many digits before they are ranked, so equal vectors tie.
DIGITS = 12


def _blocks(queries: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Queries (a stated set) read ``block`` at a time."""
    held = []
    for row in queries.toLocalIterator():
        held.append(tuple(row))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


#: Rows of a batch that is passed on.
OUT = 20_000


class _Best:
    """The k nearest items of each of distinct queries among the batches so far: rows of q (a query's number), distance and id, in this order.

    A product in single precision leaves out, with a proven bound of its error, what can't be among the k; what it leaves is compared in double precision. Of items
    of equal vectors only the k smallest ids of a batch count.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.single, self.size = queries.astype("f4"), np.linalg.norm(queries, axis=1)
        self.worst = np.full(len(queries), np.inf)  # the k-th distance
        self.q, self.distance, self.ids = np.zeros(0, "i8"), np.zeros(0), None

    def counts(self) -> np.ndarray:
        return np.bincount(self.q, minlength=len(self.queries))

    def _first(self, *order: np.ndarray) -> np.ndarray:
        """Places of the first k rows of each value of the first array, by the others."""
        at = np.lexsort(order[::-1])
        by = order[0][at]
        starts = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        return at[np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at)))) < self.k]

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        v = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(ids), -1))
        equal = np.unique(v.view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1]
        keep = np.sort(self._first(equal, _place(ids)))
        v, ids = v[keep], ids.take(pa.array(keep))
        with np.errstate(all="ignore"):
            single, length = v.astype("f4"), np.linalg.norm(v, axis=1)
            # Of a product in single precision of so many terms, and of the digits of a distance.
            slack = (v.shape[1] + 8) * 2.0**-23 * self.size * length[np.isfinite(length)].max(initial=0) + 10.0**-DIGITS
            found = [self._near(lo, single, v, slack) for lo in range(0, len(self.queries), AT_ONCE)]
        q, j, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(q):
            return
        touched = np.zeros(len(self.queries), bool)
        touched[q] = True
        again = touched[self.q]
        q, distance = np.concatenate([self.q[again], q]), np.concatenate([self.distance[again], distance])
        new = ids.take(pa.array(j))
        new = new if self.ids is None else pa.concat_arrays([self.ids.filter(pa.array(again)), new])
        best = self._first(q, distance, _place(new))
        q, distance, new = q[best], distance[best], new.take(pa.array(best))
        if self.ids is not None:
            q, distance, new = np.concatenate([self.q[~again], q]), np.concatenate([self.distance[~again], distance]), pa.concat_arrays([self.ids.filter(pa.array(~again)), new])
        order = np.argsort(q, kind="stable")
        self.q, self.distance, self.ids = q[order], distance[order], new.take(pa.array(order))
        full = self.counts() == self.k
        last = self.distance[np.cumsum(self.counts())[full] - 1]
        self.worst[full] = np.where(np.isnan(last), np.inf, last)

    def _near(self, lo: int, single: np.ndarray, v: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries (of ``AT_ONCE`` from ``lo``), items and distances of the pairs that may be among the k nearest; products that are no number stay."""
        own = slice(lo, lo + AT_ONCE)
        product = self.single[own] @ single.T
        least = 1 - self.worst[own] - slack[own]
        near = ~(product < least[:, None])
        if len(v) > self.k and np.count_nonzero(near) > 4 * self.k * len(product):
            kth = np.partition(np.where(np.isnan(product), -np.inf, product), -self.k, axis=1)[:, -self.k]
            near = ~(product < np.maximum(least, kth - 2 * slack[own])[:, None])
        i, j = np.nonzero(near)
        parts = [np.einsum("ij,ij->i", self.queries[lo + i[at : at + OUT]], v[j[at : at + OUT]]) for at in range(0, len(i), OUT)]
        return lo + i, j, np.round(1 - np.concatenate([np.zeros(0), *parts]), DIGITS)


def _place(ids: pa.Array) -> np.ndarray:
    return pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype("i8")


def top_k(queries: DataFrame, items: DataFrame, k: int, qid: str = "qid", iid: str = "vec_id", vector: str = "embedding", where: Column | None = None, block: int = PASS) -> DataFrame:
    """qid, iid, distance, relevance, rank: the k nearest items of each query, of unit vectors; ties by item id.

    A block of queries is one matrix that is sent to the executors and multiplied with each Arrow batch of items; a task passes on
    its best k of a query, which are merged by rank. Null vectors are left out.
    """
    items = items.where(where) if where is not None else items
    rows = items.where(F.col(vector).isNotNull()).select(F.col(iid).alias("iid"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, iid {rows.schema['iid'].dataType.simpleString()}, distance double"
    kind = to_arrow_type(asked.schema["qid"].dataType)
    found = queries.sparkSession.createDataFrame([], schema)
    for held in _blocks(asked, block):
        shared = queries.sparkSession.sparkContext.broadcast(([q for q, _ in held], np.array([v for _, v in held], "f8")))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            # Equal queries are one.
            distinct, of = np.unique(matrix, axis=0, return_inverse=True)
            best = _Best(distinct, k)
            for batch in batches:
                if batch.num_rows:
                    best.add(batch.column("iid"), batch.column("v"))
            if best.ids is None:
                return
            n = best.counts()[of]
            at = np.repeat(np.searchsorted(best.q, of), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(np.arange(len(ids)), n)
            for lo in range(0, len(at), OUT):
                some = at[lo : lo + OUT]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[lo : lo + OUT]], kind), best.ids.take(pa.array(some)), pa.array(best.distance[some])], names=["qid", "iid", "distance"])

        found = found.unionByName(rows.mapInArrow(score, schema))
    w = Window.partitionBy("qid").orderBy("distance", "iid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("relevance", T.relevance(F.col("distance")))


def related(hits: DataFrame, keep: Column, k: int, key: str = "qid", least: float = 0.35) -> DataFrame:
    """Of over-fetched hits those that ``keep`` and the least relevance allow, ranked again, at most k."""
    w = Window.partitionBy(key).orderBy("rank")
    left = hits.where(keep & (F.col("relevance") >= least)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return left.drop("rank").withColumnRenamed("_n", "rank")


def flag_relations(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """``is_direct_dependency`` and ``is_dependent`` of hits (file_path, hit_path) from edges (src, dst)."""
    out = edges.select(F.col("src").alias("file_path"), F.col("dst").alias("hit_path")).distinct().withColumn("_d", F.lit(True))
    into = edges.select(F.col("dst").alias("file_path"), F.col("src").alias("hit_path")).distinct().withColumn("_c", F.lit(True))
    rows = hits.join(wide(out), ["file_path", "hit_path"], "left").join(wide(into), ["file_path", "hit_path"], "left")
    return rows.withColumn("is_direct_dependency", F.col("_d").isNotNull()).withColumn("is_dependent", F.col("_c").isNotNull()).drop("_d", "_c")


def claim_over_changes(hits: DataFrame, key: str = "review_id", per_change: int = 3, total: int = 8) -> DataFrame:
    """Hits (key, change_no, rank, unit) that changes claim in turn: a unit once a review, at most ``per_change`` a change, and
    no change begins once ``total`` are claimed. A unit that an earlier change holds frees its place for the next one.

    One ordered fold a review over few ids: over-fetched ranks are bounded for each change.
    """
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("change_no", "rank", "unit"))).alias("_h"))
    unit = hits.schema["unit"].dataType.simpleString()
    kind = f"array<struct<change_no:{hits.schema['change_no'].dataType.simpleString()},unit:{unit}>>"

    def step(s: Column, x: Column) -> Column:
        fresh = ~s["change"].eqNullSafe(x["change_no"])
        before = F.when(fresh, F.size(s["got"])).otherwise(s["before"])
        mine = F.when(fresh, F.lit(0)).otherwise(s["mine"])
        take = (before < total) & (mine < per_change) & ~F.exists(s["got"], lambda g: g["unit"] == x["unit"])
        got = F.when(take, F.concat(s["got"], F.array(F.struct(x["change_no"].alias("change_no"), x["unit"].alias("unit"))))).otherwise(s["got"])
        return F.struct(x["change_no"].alias("change"), before.alias("before"), (mine + F.when(take, 1).otherwise(0)).alias("mine"), got.alias("got"))

    start = F.struct(F.lit(None).cast(hits.schema["change_no"].dataType).alias("change"), F.lit(0).alias("before"), F.lit(0).alias("mine"), F.array().cast(kind).alias("got"))
    out = rows.select(key, F.posexplode(F.aggregate("_h", start, step, lambda s: s["got"])).alias("claim_no", "_g"))
    return out.select(key, "claim_no", "_g.change_no", "_g.unit")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_or_all(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Rows with the flag; all rows of a key that has none. Keys with a flagged row are aggregated first, so no key's rows are gathered."""
    flagged = df.where(flag).select(F.col(key).alias("_key")).distinct().withColumn("_any", F.lit(True))
    rows = df.join(flagged, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.where(F.col("_any").isNull() | flag).drop("_key", "_any")


#: Knowledge documents that are sent to every task, at most; a review retrieves a handful.
KNOWLEDGE = 10_000


def match_knowledge(findings: DataFrame, knowledge: DataFrame, text: str = "cwe_id", doc_text: str = "cwe", rank: str = "rank") -> DataFrame:
    """Each finding's first document, by rank, of which one CWE text holds the other; an empty one of the document holds all.

    Only distinct texts meet the documents, which are one small array, checked to be at most ``KNOWLEDGE``; the first match by rank is
    found within the row. Findings then meet their text's match by an equi-join.
    """
    names = [c for c in knowledge.columns if c != rank]
    docs = knowledge.agg(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(doc_text).alias("_c"), *names))).alias("_docs"))
    if knowledge.limit(KNOWLEDGE + 1).count() > KNOWLEDGE:
        raise ValueError("too many knowledge documents for one review")
    texts = findings.select(F.col(text).alias("_text")).distinct().join(F.broadcast(docs))  # one row
    holds = lambda d: F.contains(F.upper("_text"), F.upper(d["_c"])) | F.contains(F.upper(d["_c"]), F.upper("_text"))
    first = F.get(F.filter("_docs", lambda d: F.coalesce(holds(d), F.lit(False))), F.lit(0))
    matched = texts.select("_text", first.alias("_d")).select("_text", F.when(F.col("_d").isNotNull(), F.struct(F.col(f"_d.{rank}").alias(rank), *(F.col(f"_d.{c}").alias(c) for c in names))).alias("matched"))
    return findings.join(matched, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")
