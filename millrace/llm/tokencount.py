"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each document's frequencies.

A pre-token here is a run between blanks, tabs and line ends. The vocabulary's own pattern never crosses white space and its
normaliser only folds it, so the count of a text is the sum of the counts of these runs; what lies inside a run (other white
space, special strings, several pieces of the pattern) is left to the library.

1. Distinct pre-tokens with their frequency: counted by task first, in tables of bounded size, then aggregated.
2. The library counts the pieces of each distinct pre-token, once in the job. The result is written as a table.
3. Each document's frequencies are joined to that table. The ``HEAD`` most frequent pre-tokens, of bounded length, are the part
   of it that is broadcast, so no frequent pre-token is shuffled. The others, each with at most 1 / ``HEAD`` of all occurrences,
   meet in a shuffled join without hot keys, and their products are added up by document.

Documents are told apart by a number of their own, so repeated and null ids keep their rows. A pre-token of more than
``SHOWN`` bytes is joined by its SHA-256, so a text without any blank is not moved twice.

Null and empty texts have 0 bytes and 0 tokens. Rows repeat as they come; an empty table gives an empty result; columns beyond
``id_col`` and ``text_col`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, removed, stored

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: Entries of the part of the counts that is broadcast, and bytes of a pre-token in it, at most.
HEAD, SHOWN = 500_000, 64
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000
_runs = re.compile(r"[^ \t\r\n]+").findall


def key_of(run: str) -> str:
    """The run itself, or a blank, which no run holds, and a digest of a long one."""
    if len(run) <= SHOWN // 4:
        return run
    raw = run.encode("utf-8", "surrogatepass")
    return run if len(raw) <= SHOWN else " " + hashlib.sha256(raw).hexdigest()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """run, n: the distinct pre-tokens of all texts and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            held.clear()
            for at in range(0, len(rows), 20_000):
                runs, n = zip(*rows[at : at + 20_000], strict=True)
                yield pa.RecordBatch.from_pydict({"run": list(runs), "n": list(n)})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(_runs(text))
                if len(held) >= HELD:
                    yield from out()
        yield from out()

    texts = docs.select(F.col(text_col).alias("t")).where("t <> ''")
    return texts.mapInArrow(count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def piece_counts(runs: DataFrame, path: str) -> DataFrame:
    """key, n, pieces of ``runs`` (run, n): each distinct pre-token is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            found = batch.column("run").to_pylist()
            pieces = [len(tokenizer.encode(r, add_special_tokens=False).ids) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, found), pa.string()), batch.column("n"), pa.array(pieces, pa.int64())], names=["key", "n", "pieces"])

    return runs.select("run", "n").mapInArrow(encode, "key string, n long, pieces long")


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """At most ``head`` rows of ``counts``: those whose frequency reaches the least quarter of a power of two that allows it."""
    short = counts.where(F.octet_length("key") <= SHOWN).withColumn("level", F.floor(4 * F.log2("n")))
    least, total = None, 0
    for level, n in sorted((tuple(r) for r in short.groupBy("level").agg(F.count(F.lit(1))).collect()), reverse=True):  # at most 256 rows
        total += n
        if total > head:
            break
        least = level
    return short.where(F.col("level") >= least if least is not None else F.lit(False)).select("key", "pieces")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit; one row per input row. ``vocabulary``: path of the file, the same on all executors."""
    path = vocabulary or vocabulary_path()
    counts, counted = stored(piece_counts(pre_tokens(df, text_col), path), "pieces")
    # Of bounded size: at most ``head`` rows of at most SHOWN bytes.
    shared = df.sparkSession.sparkContext.broadcast({k: p for k, p in most_frequent(counts, head).collect()})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    kind = rows.schema["id"].dataType

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sums, keys, times = [], [], []
                for t in part.column("t").to_pylist():
                    total, rest = 0, []
                    for run, n in Counter(_runs(t)).items():
                        pieces = known.get(run)
                        if pieces is None:
                            rest.append((key_of(run), n))
                        else:
                            total += pieces * n
                    sums.append(total)
                    keys.append([k for k, _ in rest])
                    times.append([n for _, n in rest])
                columns = [part.column("row"), part.column("id"), part.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_bytes", "known", "keys", "times"])

    found, looked = stored(rows.mapInArrow(look_up, f"row long, id {kind.simpleString()}, n_bytes long, known long, keys array<string>, times array<long>"), "frequencies")
    rare = found.select("row", F.explode(F.arrays_zip("keys", "times")).alias("r")).select("row", "r.keys", "r.times").withColumnRenamed("keys", "key")
    summed = rare.join(counts.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rare"))
    n = (F.col("known") + F.coalesce("rare", F.lit(0))).cast("long")
    out = cut(found.select("row", "id", "n_bytes", "known").join(summed, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens")))
    removed(df.sparkSession, counted, looked)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
