"""Mixing sources to target weights by pivotal dependent rounding.

Each row of a source with target T and size S should be copied T / S times: whole copies are certain, the fraction p is
rounded. Two rows with fractions duel: mass (words) moves from one to the other, in a random direction with the odds that keep
both expectations, until one fraction is 0 or 1. The other goes on. So words are conserved, and a set of rows leaves at most
one fraction. Leaves of at most about ``LEAF`` rows run in parallel; their residuals meet in a reduction tree of ``FANOUT``
children a node. The last residual of a source takes the rest of the target as a part of one copy.

Sizes and totals are aggregated over all rows. The table of sources is itself a distributed table: its order is a range
partitioned sort, and the water level of the targets is found by rounds of aggregates. Draws are hashes of ids, sizes and
seed, so reruns agree. Null texts and texts without words have size 0 and take nothing; a null source is a source of its own,
last in order. An empty table gives an empty result. Rows of equal id, source and size are counted before they are shuffled and
then told apart by number, so each is rounded by itself and a repeated or null id is no leaf of its own. Ids stay in Arrow, so
they are exact beside nulls too. Other columns pass through ``mix_rows``; the helper columns are prefixed with ``_mix`` .
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEAF, FANOUT = 2000, 64
SEED = 20240607
EDGE = 1e-12


def word_count(text: str = "text"):
    """Words of a text; null has 0. Counted as a difference of lengths: each word shrinks to one character, blanks go."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD, "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` in global order with ``rank`` from 0, without gathering the rows in one task."""
    rows = cut(df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1], r[2]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)), F.min("_row")).collect())  # a row a partition
    starts, before = [], 0
    for part, n, first in sizes:
        starts.append((part, before - first))
        before += n
    shifts = df.sparkSession.createDataFrame(starts, "_part int, _shift long")  # a row a partition
    return rows.join(F.broadcast(shifts), "_part").withColumn("rank", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def targets(by: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``by`` (source, source_size, n_rows) with target. Water filling; each round freezes the sources above their cap."""
    by = ranked(by, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # Words for each unit of weight if those with cap / w at most the level stop at their cap.
        stopped = F.col("cap") <= F.col("w") * F.lit(level)
        held, w = by.agg(F.sum(F.when(stopped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~stopped, F.col("w")).otherwise(0.0))).first()
        new = (total * share - held) / w if w else level
        if not w or new <= level:
            break
        level = new
    return by.select("source", "source_size", "n_rows", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def _draw(a: np.uint64, b: np.uint64) -> float:
    """A number in [0, 1) from two keys (splitmix64 of their mixture)."""
    m = (1 << 64) - 1
    z = (int(a) * 0x9E3779B97F4A7C15 + int(b) + SEED) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


def duel(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds the fractions ``p`` of one node; at most one row keeps ``open`` true."""
    rows = rows.sort_values(["_mix_key", "size", "p"], kind="stable").reset_index(drop=True)
    p, size, key = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(), rows["_mix_key"].to_numpy().astype(np.uint64)
    held = -1
    for i in range(len(rows)):
        if p[i] <= EDGE or p[i] >= 1 - EDGE:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        j, a, b = held, float(size[held]), float(size[i])
        up = min((1 - p[j]) * a, p[i] * b)  # words that can go from i to j
        down = min(p[j] * a, (1 - p[i]) * b)
        move = up if _draw(key[j], key[i]) * (up + down) < down else -down
        pj, pi = p[j] + move / a, p[i] - move / b
        snap = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        p[j], p[i] = snap(pj), snap(pi)
        still = [x for x in (j, i) if 0 < p[x] < 1]
        held = still[0] if still else -1
    rows["p"] = p
    rows["open"] = (p > 0) & (p < 1)
    return rows


def _settle(table: pa.Table) -> pa.Table:
    """``duel`` on a node's rows; what it does not read stays as it is."""
    rows = pd.DataFrame({c: table.column(c).to_numpy() for c in ("size", "p", "_mix_key")} | {"at": np.arange(len(table))})
    rows = duel(rows)
    out = table.take(pa.array(rows["at"].to_numpy()))
    for c in ("p", "open"):
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(rows[c].to_numpy()))
    return out


#: Equal rows that are numbered in one array, at most.
NUMBERED = 10_000


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST) -> DataFrame:
    """id, source, size, source_size, target, copies (whole), part (words of one more, partial copy), fraction."""
    counted = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")).groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("_mix_n"))
    counted = cut(counted)
    by = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("_mix_n")).alias("source_size"), F.sum("_mix_n").alias("n_rows"))
    by = cut(targets(by, share, most))
    each = counted.withColumn("_mix_a", F.explode(F.sequence(F.lit(0), F.floor((F.col("_mix_n") - 1) / NUMBERED).cast("int"))))
    last = F.least(F.lit(NUMBERED), F.col("_mix_n") - F.col("_mix_a") * NUMBERED).cast("int")
    each = each.withColumn("_mix_b", F.explode(F.sequence(F.lit(1), last)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = each.join(by.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("size") > 0, F.floor(rate + 1e-9)).otherwise(0).cast("long")
    rows = (
        rows.withColumn("whole", whole)
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.col("whole"))).otherwise(F.lit(0.0)))
        .withColumn("open", F.lit(True))
        .withColumn("_mix_key", F.xxhash64(F.lit(SEED), "id", "size", "_mix_a", "_mix_b"))
    )
    # A leaf's number is a hash of the row; the tree above halves it FANOUT-fold.
    rows = rows.withColumn("_mix_node", F.pmod("_mix_key", F.ceil(F.col("n_rows") / LEAF))).drop("_mix_a", "_mix_b", "_mix_n")
    settled, level = [], rows
    while True:
        level = cut(level.groupBy("source", "_mix_node").applyInArrow(_settle, rows.schema))
        settled.append(level.where("not open"))
        level = level.where("open")
        if level.where("_mix_node > 0").isEmpty():
            break
        level = level.withColumn("_mix_node", F.floor(F.col("_mix_node") / FANOUT).cast(rows.schema["_mix_node"].dataType))
    done = level
    for part in settled:
        done = done.unionByName(part)
    return done.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)).alias("copies"),
        F.when(F.col("open"), F.round(F.col("p") * F.col("size"))).otherwise(0).cast("long").alias("part"),
        F.when(F.col("open"), F.col("p")).otherwise(0.0).alias("fraction"),
    )


def digest(df: DataFrame) -> DataFrame:
    return mix(df).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"), "copies", "part")


def mix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix copies it, columns unchanged. A source's last fraction is rounded by draw.

    Rows and copies meet by (id, source, size); equal keys are numbered on both sides, so repeated rows keep their own copies.
    """
    plan = mix(df, id_col, text_col, source_col)
    last = F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), id_col), F.lit(1_000_003)) < F.col("fraction") * 1_000_003, 1).otherwise(0)
    chosen = (
        plan.withColumn("_mix_n", F.col("copies") + last)
        .groupBy(F.col(id_col).alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"))
        .agg(F.sum("_mix_n").alias("_mix_total"), F.count(F.lit(1)).alias("_mix_rows"))
    )
    chosen = cut(chosen)
    left = df.withColumn("_mix_w", word_count(text_col)).withColumn("_mix_u", F.monotonically_increasing_id())
    joined = left.join(
        chosen, F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_w") == F.col("_mix_size"))
    )
    # Rows of one key share its copies evenly; with one row a key, the usual case, no numbering is needed.
    one = joined.where("_mix_rows = 1").withColumn("_mix_k", F.col("_mix_total"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("_mix_id", "_mix_source", "_mix_size").orderBy("_mix_u"))
    many = joined.where("_mix_rows > 1").withColumn("_mix_p", place)
    many = many.withColumn("_mix_k", F.floor(F.col("_mix_total") * F.col("_mix_p") / F.col("_mix_rows")) - F.floor(F.col("_mix_total") * (F.col("_mix_p") - 1) / F.col("_mix_rows"))).drop("_mix_p")
    out = one.unionByName(many).where("_mix_k > 0")
    return out.withColumn("_mix_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_k").cast("long")))).select(*(f"`{c}`" for c in df.columns))
