"""Keyed upsert, checkpoint listing, and human decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.retrieval import first_per


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as a maximum of its order: aggregated before the shuffle."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{n}").alias(n) for n in names))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` with the last row a key of ``new`` in place of its own."""
    last = latest(new, keys, order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def threads(checkpoints: DataFrame, thread: str = "thread_id", checkpoint: str = "checkpoint_id") -> DataFrame:
    """Latest checkpoint and number of each thread."""
    return checkpoints.groupBy(thread).agg(F.max(checkpoint).alias("latest"), F.count(F.lit(1)).alias("n"))


def route(decision: Column) -> Column:
    """Next step of a human decision; none yet is a pause."""
    return F.when(decision.isNull(), "paused").when(decision == "revise", "fix_suggester").otherwise("report")


def thread_status(next_node: Column, decision: Column) -> Column:
    return (
        F.when(next_node == "human_review", "paused").when(decision == "approve", "approved").when(decision == "reject", "rejected")
        .when(next_node.isNotNull(), F.concat(F.lit("running: "), next_node)).otherwise("completed")
    )


def reports(checkpoints: DataFrame, texts: DataFrame, thread: str = "thread_id") -> DataFrame:
    """Threads, newest first by ``latest``, with their report where there is one."""
    return threads(checkpoints, thread).join(texts, thread, "left").orderBy(F.desc("latest"), thread)


__all__ = ["first_per", "latest", "reports", "route", "thread_status", "threads", "upsert"]
