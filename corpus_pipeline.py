"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Stages but the last return the columns of
documents unchanged, extra columns included. Empty tables pass through. Rows with a null text have an empty text: they are no
near copies, hold no benchmark item, weigh nothing in the mix and so are not copied by it. Rows of one id are one document
where a stage links or drops by id (near copies, decontamination) and rows of their own elsewhere; rows without an id are never
dropped as a copy or for a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, ngram_join, packing, toxicity
from millrace.llm.common import removed, shared_path, table

#: No stage but the mixing's sizes can be said in SQL; brute-force versions are in tests/llm.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects by the classifier's threshold of each language; the model is fitted on labelled rows of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("_toxicity", toxicity.score(docs, model))
    return scored.where(~toxicity.rejects(model, "_toxicity")).drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles, similarity 0.8, the smallest id of each group stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the edit budget, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mix_rows(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read lazily from the table of the stage before; earlier stages' tables are removed once they are read."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
