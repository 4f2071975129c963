"""Indexing and search of code units, and the context that a review takes from them.

An index is a keyed table (``sources.store``) of unit documents with a unit vector each. Vectors come from an ``Embedder``, the slot for
a model; the default one hashes words and is deterministic and offline.
"""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks, nearest, retrieval, syntax
from millrace.sources.shared import removed, stored, wide
from millrace.sources.store import Table, index_summary, unit_documents

#: Hits fetched beyond those asked for, and in all, so that the query's own unit and weak ones can be left out.
MORE, MOST = 4, 15
INDEX_DDL = "id string, title string, content string, cwe string, severity string, category string, metadata map<string,string>, embedding array<float>, version long, content_hash string"
#: Units that are embedded together; one that fails fails these.
BATCH = 50


class Embedder(ABC):
    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """(texts, dimensions) of float; rows need not have length 1."""


class HashEmbedder(Embedder):
    """Counts of words and of their beginnings, by hash."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "f4")
        for n, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                for part in {word, word[:4]}:
                    h = zlib.crc32(part.encode())
                    out[n, h % self.dim] += 1 if h >> 31 else -1
        return out


def embed_texts(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Unit vectors, in Arrow batches, a model a worker; null for texts that have no direction."""

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            v = np.asarray(model.embed([t or "" for t in texts]), "f8").reshape(len(texts), -1)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            unit = (v / np.where(size > 0, size, 1)).astype("f4")
            yield pd.Series([row if s > 0 else None for row, s in zip(unit, size[:, 0], strict=True)])

    return embedded(text)


@dataclass(frozen=True)
class Indexed:
    """What an indexing run did: rows written, unchanged and removed, counts by type, and errors: sources that could not be read or parsed, batches
    that could not be embedded."""

    written: int
    unchanged: int
    removed: int
    summary: DataFrame
    errors: DataFrame


def index_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, ["id"], ["version"], INDEX_DDL)


def documents_of(units: DataFrame) -> DataFrame:
    """Store documents of parsed units with ``content_hash``, which tells whether a unit has changed."""
    return hashed(unit_documents(units))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.to_json(F.struct("title", "content", "cwe", "severity", "category", F.array_sort(F.map_entries("metadata")).alias("m"))), 256))


def embedded_documents(docs: DataFrame, make: Callable[[], Embedder] = HashEmbedder, batch: int = BATCH) -> DataFrame:
    """``docs`` with ``embedding`` and ``error``: units are embedded in batches, and a batch that fails is rows with its error and no vector."""
    text = F.concat_ws("\n", "title", "content")

    @F.pandas_udf("embedding array<float>, error string")
    def embedded(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for texts in columns:
            vectors, errors = [], []
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts[at : at + batch]]
                try:
                    v = np.asarray(model.embed(part), "f8").reshape(len(part), -1)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    unit = (v / np.where(size > 0, size, 1)).astype("f4")
                    vectors += [row if s > 0 else None for row, s in zip(unit, size[:, 0], strict=True)]
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001 - whatever a model raises is the batch's error
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield pd.DataFrame({"embedding": vectors, "error": errors})

    return docs.withColumn("_e", embedded(text)).withColumns({"embedding": F.col("_e.embedding"), "error": F.col("_e.error")}).drop("_e")


def index_rows(units: DataFrame, make: Callable[[], Embedder] = HashEmbedder, version: int = 1) -> DataFrame:
    """Rows of an index from parsed units."""
    docs = documents_of(units)
    return docs.withColumn("embedding", embed_texts(F.concat_ws("\n", "title", "content"), make)).withColumn("version", F.lit(version).cast("long"))


def index_codebase(
    sources: DataFrame, target: Table, make: Callable[[], Embedder] = HashEmbedder, version: int = 1, block: int = 60, summarise: Callable[[DataFrame], DataFrame] | None = None, batch: int = BATCH, whole: bool = False,
) -> Indexed:
    """Units of all sources (path, source and, where known, error) with their vectors into the index.

    Only units whose content differs from what the index holds are embedded and written. Units that are gone from a source that was read are
    deleted; with ``whole`` the sources are the whole codebase, and units of paths that aren't among them are deleted too. ``summarise`` may put a
    model's summaries in place of those made from parts. A source with an error of syntax is an error row and keeps the units it had; so is one
    that could not be fetched. A batch that can't be embedded is error rows, and the other batches are written.
    """
    spark = target.spark
    given = sources if "error" in sources.columns else sources.withColumn("error", F.lit(None).cast("string"))
    good = given.where("source is not null")
    # Sources are parsed once, for units and errors.
    parsed, path = stored(syntax.units(good, block=block, errors=True), "units")
    tables = [path]
    units = parsed.where("error is null").drop("error", "error_line")
    wrong = parsed.where("error is not null").select(F.col("file_path").alias("path"), "error", F.col("error_line").alias("line"))
    wrong, path = stored(wrong.unionByName(given.where("source is null").select("path", F.coalesce("error", F.lit("no content")).alias("error"), F.lit(None).cast("int").alias("line"))), "unread")
    tables.append(path)
    docs = documents_of(summarise(units) if summarise else units)
    held = target.read().where("category = 'codebase'").select("id", F.col("content_hash").alias("_held"), F.element_at("metadata", F.lit("file_path")).alias("_file"))
    held, path = stored(held, "held")
    tables.append(path)
    both = docs.join(wide(held.select("id", "_held")), "id", "left")
    fresh = both.where(~F.col("content_hash").eqNullSafe(F.col("_held"))).drop("_held")
    rows, path = stored(embedded_documents(fresh, make, batch).withColumn("version", F.lit(version).cast("long")), "embedded")
    tables.append(path)
    failed = rows.where("error is not null").select(F.element_at("metadata", F.lit("file_path")).alias("path"), "error", F.lit(None).cast("int").alias("line"))
    # Of a source with an error nothing is known, so what the index holds of it stays.
    read = good.select(F.col("path").alias("_file")).join(wide(wrong.select(F.col("path").alias("_file"))), "_file", "left_anti")
    paths = held.select("_file").distinct().join(wide(wrong.select(F.col("path").alias("_file"))), "_file", "left_anti") if whole else read.distinct()
    vanished = held.join(wide(paths), "_file", "left_semi").join(wide(docs.select("id")), "id", "left_anti")
    n_gone, n_docs = vanished.count(), docs.select("id").distinct().count()
    n_fresh = rows.select("id").distinct().count()
    written = target.upsert(rows.where("error is null").drop("error"), vanished.select("id"))
    (errors, _), (summary, _) = stored(wrong.unionByName(failed), "index-errors"), stored(index_summary(units), "index-summary")
    removed(spark, *tables)
    return Indexed(written - n_gone, n_docs - n_fresh, n_gone, summary, errors)


def indexed_count(target: Table) -> int:
    return target.count()


def search_codebase(queries: DataFrame, index: DataFrame | nearest.Index, k: int = 5, make: Callable[[], Embedder] = HashEmbedder, category: str | None = "codebase", share: float = 0.9) -> DataFrame:
    """queries (qid, query) against an index: qid, id, title, content, metadata, distance, relevance, rank.

    A table of rows is scanned whole, so the result is exact. A stored cosine index (``nearest.build`` of such rows) reads the lists that held
    ``share`` of the true neighbours when it was built.
    """
    rows = index.rows() if isinstance(index, nearest.Index) else index
    kind = F.lit(True) if category is None else F.col("category") == category
    asked = queries.select("qid", embed_texts(F.col("query"), make).alias("embedding"))
    if isinstance(index, nearest.Index):
        hits = nearest.search(asked, index, k, iid="id", where=kind, share=share).withColumnRenamed("iid", "id")
    else:
        hits = retrieval.top_k(asked, rows.where(kind), k, iid="id").withColumnRenamed("iid", "id")
    rows = rows.where(kind)
    return hits.join(wide(rows.select("id", "title", "content", "severity", "metadata")), "id")


def retrieve_for_function(functions: DataFrame, index: DataFrame, edges: DataFrame, k: int = 3, least: float = 0.35, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """functions (qid, function_name, file_path, added_lines and, where known, summary): their related units, ranked, with relation flags.

    More hits than asked for are fetched; the function's own unit and hits below ``least`` are left out.
    """
    summary = F.col("summary") if "summary" in functions.columns else F.lit(None).cast("string")
    asked = functions.withColumn("query", T.retrieval_query(F.coalesce("function_name", F.lit("")), F.col("file_path"), F.col("added_lines"), summary))
    hits = search_codebase(asked.select("qid", "query"), index, min(MOST, k + MORE), make).withColumn("hit_path", F.element_at("metadata", F.lit("file_path")))
    rows = hits.join(wide(asked.select("qid", "function_name", "file_path")), "qid")
    own = (F.col("hit_path") == F.col("file_path")) & (F.col("title") == F.substring_index(F.coalesce("function_name", F.lit("")), ".", -1))
    return retrieval.flag_relations(retrieval.related(rows, ~F.coalesce(own, F.lit(False)), k, "qid", least), edges)


def retrieve_for_changes(changes: DataFrame, index: DataFrame, edges: DataFrame, per_function: int = 3, total: int = 8, max_tokens: int = 2500, least: float = 0.35, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """change rows (review_id, pos, file_path, function_name, added_lines): one context text a review, its units and tokens.

    A function is asked for once. Changes claim units in turn, a unit once a review, and no change begins once ``total`` are claimed;
    the claimed units that fit ``max_tokens`` in order are shown.
    """
    functions = retrieval.first_per(changes.where("function_name is not null"), ["review_id", "file_path", "function_name"], ["pos"])
    functions = functions.withColumn("qid", F.xxhash64("review_id", "file_path", "function_name"))
    hits = retrieve_for_function(functions, index, edges, per_function, least, make)
    # Hits are found once; claims and texts both read them.
    hits, path = stored(hits.join(wide(functions.select("qid", "review_id", F.col("pos").cast("long").alias("change_no"))), "qid"), "hits")
    claimed = retrieval.claim_over_changes(hits.withColumn("unit", F.col("id")), "review_id", per_function, total)
    shown = claimed.withColumnRenamed("unit", "id").join(wide(hits), ["review_id", "change_no", "id"])
    shown = shown.withColumn("text", related_text()).withColumn("tokens", T.tokens(F.length("text")).cast("long"))
    kept = chunks.within_budget(shown, ["review_id"], ["claim_no"], "tokens", max_tokens, False)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "text", "id"))), lambda x: x["text"])
    out, _ = stored(kept.groupBy("review_id").agg(F.array_join(parts, "\n\n").alias("context"), F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens")), "contexts")
    removed(index.sparkSession if isinstance(index, DataFrame) else index.spark, path)
    return out


def related_text() -> Column:
    """Markdown of a related unit: title, place, relevance, relation, content."""
    badge = T.relationship_badge(F.col("is_direct_dependency"), F.col("is_dependent"))
    relation = F.when(F.length(badge) > 0, F.concat(F.lit(" ("), badge, F.lit(")"))).otherwise(F.lit(""))
    return F.format_string("#### `%s` in `%s` - %d%%%s\n%s", F.col("title"), F.col("hit_path"), T.percent(F.col("relevance")), relation, F.col("content"))


def function_context(functions: DataFrame, imports: DataFrame, most: int = 4) -> DataFrame:
    """functions (qid, function_name, file_path, snippet) with ``context``: the function, its file's first imports and its code.

    imports: src, ord, module.
    """
    modules = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "module"))), lambda x: x["module"]), 1, most)
    by_file = imports.groupBy(F.col("src").alias("file_path")).agg(modules.alias("_m"))
    rows = functions.join(wide(by_file), "file_path", "left")
    named = F.when(F.size("_m") > 0, F.concat(F.lit("Imports: "), F.array_join("_m", ", "), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(F.format_string("### `%s` (`%s`)\n", "function_name", "file_path"), named, F.lit("```"), T.language(F.col("file_path"))["code"], F.lit("\n"), F.coalesce("snippet", F.lit("")), F.lit("\n```"))
    return rows.withColumn("context", text).drop("_m")
