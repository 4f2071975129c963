"""Shared pieces of the training-data operators: checkpoints, components, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts of this subpackage define it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a temporary folder serves in plain local mode; on a cluster that is an error.
    """
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="millrace-")
    context.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, into the reliable checkpoint folder, and drops its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as a table in the shared folder, and its path: smaller than a checkpoint, and ``removed`` when done with."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables, in any store that Spark writes."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows, at most, of a bitmap that is broadcast; each has 64 bits.
BITMAP_WORDS = 1 << 16


def in_bitmap(rows: DataFrame, by: str, wanted: DataFrame, hashes: str) -> DataFrame:
    """The rows whose hash ``by`` may be among ``hashes`` of ``wanted``: a bitmap of at most BITMAP_WORDS rows is broadcast.

    A filter before a shuffle only: what passes by chance is left to the join that follows, and a full bitmap lets all pass.
    """
    slot = lambda c: F.pmod(F.shiftright(c, 6), F.lit(BITMAP_WORDS))
    bitmap = wanted.groupBy(slot(F.col(hashes)).alias("_slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hashes} & 63L as int))")).alias("_bits"))
    rows = rows.withColumn("_slot", slot(F.col(by))).join(F.broadcast(bitmap), "_slot")
    return rows.where(F.expr(f"shiftrightunsigned(_bits, cast({by} & 63L as int)) & 1L") == 1).drop("_slot", "_bits")


def heads_of(rows: DataFrame, key: str, node: str, *more: Column) -> DataFrame:
    """key, head (smallest node), n and ``more`` aggregates of buckets of two nodes or more; of buckets of equal nodes one, the smallest key.

    ``rows`` (key, node) are distinct. Documents that share much share many keys, and these buckets would all compare the same
    nodes. Sets of nodes are told apart by their number, smallest and largest node and two 64-bit hashes.
    """
    mark = [F.bit_xor(F.xxhash64(node, F.lit(seed))).alias(f"_mark{seed}") for seed in (1, 2)]
    every = rows.groupBy(key).agg(F.min(node).alias("head"), F.max(node).alias("_last"), F.count(F.lit(1)).alias("n"), *mark, *more).where("head <> _last")
    rest = [c for c in every.columns if c != key]
    return every.groupBy(*rest).agg(F.min(key).alias(key)).drop("_last", "_mark1", "_mark2")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps, until the edges are stars around smallest nodes. Minima are aggregated before
    the shuffle and checkpointed, so the joins with them have plain exchanges on both sides and adaptive execution splits the
    partitions of hub nodes. Self loops and nulls are dropped; an empty input gives an empty result. Fails after ``rounds``, which
    grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a > b and a is not null and b is not null")
    e = cut(e.distinct())
    for n in range(rounds + 1):
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        # A star's leaf has one edge up and none below it.
        mixed = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up = 1 and n > 1)")
        if mixed.isEmpty():
            break
        if n == rounds:
            raise RuntimeError("components did not settle")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"))
        # A node without a smaller neighbour keeps its edges as they are.
        hung = both.where("b > a").join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
        # An edge to a smaller neighbour passes through the node's own minimum too.
        large = cut(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        rest = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.select("a", F.col("m").alias("b")).unionByName(rest).where("a > b").distinct())
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
