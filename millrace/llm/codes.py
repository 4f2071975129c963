"""Vector code compression: product quantisation in integers, with a kd-tree for each codebook.

Each component x becomes floor(1024 * x); a vector is cut into equal consecutive parts, and each part position has a codebook of
at most 256 entries, which starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest
entry (squared Euclidean distance in integers, ties to the lower index) and replaces each entry by the floored mean of its parts; an
entry without parts stays. The codebooks are 4 * 256 entries whatever the table's size: each round broadcasts one kd-tree a codebook,
every task adds up the parts of its own rows in one table of that size, and Spark sums these by (part, entry, position).

The search is branch and bound over batches of rows: a row is compared with the leaf it falls into, then with every leaf whose tight
box is no farther than the best distance so far. Boxes at an equal distance are visited too, so of equally near entries the one
with the lowest index is found. Vectors are quantised once, into a table that each round scans; a lost executor repeats its tasks.

Rows whose vector is null, empty or holds null or non-finite components have no code and are left out. Vectors of another length than the
most frequent one that the parts divide (of equally frequent ones the shortest) are left out as well. Null ids start no
codebook, but their rows are coded; of rows with one id the smallest vector starts it; repeated rows are coded each. Null labels are one
label. Components whose distances would not fit 64 bits raise an error. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, removed, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, at most.
LEAF = 8
FARTHEST = np.iinfo("i8").max


@dataclass
class Tree:
    """kd-tree over the rows of ``entries``; node i has a tight box and either children or the entries of a leaf."""

    entries: np.ndarray
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    split: list = field(default_factory=list)  # (axis, value, left, right), or None for a leaf
    leaf: list = field(default_factory=list)  # ascending indices of entries

    def __post_init__(self) -> None:
        self._grow(np.arange(len(self.entries)))

    def _grow(self, own: np.ndarray) -> int:
        at, points = len(self.low), self.entries[own]
        self.low.append(points.min(0))
        self.high.append(points.max(0))
        self.split.append(None)
        self.leaf.append(own)
        axis = int((self.high[at] - self.low[at]).argmax())
        if len(own) > LEAF and self.high[at][axis] > self.low[at][axis]:
            value = np.sort(points[:, axis])[(len(own) - 1) // 2]
            # Everything may be at or below the median; its own largest value then goes right.
            left = points[:, axis] <= value if value < self.high[at][axis] else points[:, axis] < value
            value = points[left, axis].max()
            self.split[at] = (axis, value, self._grow(own[left]), self._grow(own[~left]))
        return at

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equally near ones, and the squared distance."""
        best, found = np.full(len(rows), FARTHEST), np.zeros(len(rows), "i8")

        def compare(node: int, who: np.ndarray) -> None:
            own = self.leaf[node]
            far = ((rows[who, None, :] - self.entries[own][None]) ** 2).sum(2)
            first = far.argmin(1)
            far, index = far[np.arange(len(who)), first], own[first]
            closer = (far < best[who]) | ((far == best[who]) & (index < found[who]))
            best[who[closer]], found[who[closer]] = far[closer], index[closer]

        for bounded in (False, True):
            left_to_do = [(0, np.arange(len(rows)))]
            while left_to_do:
                node, who = left_to_do.pop()
                if bounded:
                    q = rows[who]
                    gap = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
                    who = who[(gap * gap).sum(1) <= best[who]]
                if not len(who):
                    continue
                if self.split[node] is None:
                    compare(node, who)
                    continue
                axis, value, left, right = self.split[node]
                here = rows[who, axis] <= value if not bounded else np.ones(len(who), bool)
                left_to_do += [(right, who if bounded else who[~here]), (left, who[here])]
        return found, best


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """(id, label, q) of the rows that are coded, and the length of their vectors (0 without any)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("n", F.size("v"))
    sizes = rows.where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    width = top[0]["n"] if top else 0
    # Twice the bound is the largest difference, and its squares over a vector must fit 62 bits.
    most = 1 << max(0, (62 - (max(1, width) - 1).bit_length()) // 2 - 1)
    whole = lambda x: F.when(F.abs(x * SCALE) < float(most), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component times {SCALE} is not below {most}"))).cast("int")
    return rows.where(F.col("n") == width).select("id", "label", F.transform("v", whole).alias("q")), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, width)


def _codes(trees: list[Tree], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [t.nearest(p) for t, p in zip(trees, np.split(m, len(trees), 1), strict=True)]
    return np.stack([f for f, _ in found], 1), sum(d for _, d in found)


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, position): the parts of the vectors of the ``entries`` smallest ids."""
    ids = rows.select("id").where("id is not null").distinct().orderBy("id").limit(entries)  # at most ``entries`` rows
    first = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("q").alias("q")).orderBy("id").collect()
    return np.array([r["q"] for r in first], "i8").reshape(len(first), parts, width // parts).swapaxes(0, 1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round over (.., q)."""
    parts, entries, size = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, "i8"), np.zeros((parts, entries), "i8")
        for batch in batches:
            m = _matrix(batch.column(0), parts * size)
            codes, _ = _codes(trees.value, m)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], m[:, p * size : (p + 1) * size])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    partial = rows.select("q").mapInArrow(add_up, "part int, entry int, n long, total array<long>")
    each = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    books = books.copy()
    for part, entry, at, x, n in each.collect():  # a row a component of the codebooks
        books[part, entry, at] = x // n
    trees.unpersist()
    return books


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of ``quantised`` rows."""
    books = first_books(rows, width, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of ``quantised`` rows; the code has two hexadecimal digits a part."""
    parts, _, size = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, far = _codes(trees.value, _matrix(batch.column("q"), parts * size))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in found.astype("u1")]), pa.array(far, pa.int64())], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, as components of the original scale."""
    entry = [F.array(*(F.array(*map(F.lit, (e / SCALE).tolist())) for e in book)) for book in books]
    index = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(e, index(p)) for p, e in enumerate(entry))))


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every row that is coded."""
    spark = df.sparkSession
    rows, width = quantised(df, id_col, vector_col, label_col)
    rows, written = stored(rows, "quantised")
    books = train(rows, width)
    if not books.size:
        # No vector, or none with an id: nothing starts a codebook.
        removed(spark, written)
        return spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded, kept = stored(encode(rows, books), "coded")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error")
    out = cut(out)
    removed(spark, written, kept)
    return out.withColumn("codebooks_sha256", F.lit(digest))


def _round(n: int) -> str:
    """SQL: the assignment ``a{n}`` of parts to the codebook ``c{n}``."""
    return f"""d{n} AS MATERIALIZED (SELECT r, p.part, e.entry, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN c{n} e ON p.part = e.part),
a{n} AS MATERIALIZED (SELECT r, part, min(far) AS far, arg_min(entry, far * 256 + entry) AS entry FROM d{n} GROUP BY r, part)"""


def _update(n: int) -> str:
    return f"""s{n} AS MATERIALIZED (SELECT part, entry, pos, sum(x)::BIGINT AS x, count(*) AS n FROM (SELECT a.part, a.entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS pos FROM a{n} a JOIN p USING (r, part)) GROUP BY ALL),
m{n} AS (SELECT part, entry, list((x - ((x % n) + n) % n) // n ORDER BY pos) AS x FROM s{n} GROUP BY ALL), c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (part, entry))"""


def oracle() -> str:
    """SQL of ``compressed``, for vectors of one length."""
    steps = ",\n".join(f"{_round(n)},\n{_update(n)}" for n in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, q[part * len(q) // {PARTS} + 1:(part + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
f AS (SELECT vec_id, min(r) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, x FROM f JOIN p USING (r)),
{steps},
{_round(ROUNDS)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS}),
k AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM v JOIN k USING (r)"""
