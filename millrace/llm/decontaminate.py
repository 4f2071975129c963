"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters, folded, may differ from a passage of a document by ``m * RATE`` edits, rounded down. It is cut
into one piece more than that, so any passage within the budget holds a piece unchanged. All pieces are found in one pass of
an automaton over each whole text; around each hit, the window that the item could fill is checked by Myers' bit-parallel distance.

Folding: lower case, white space runs as one blank, none at the ends. Items that are null or empty match nothing; an item
shorter than 1 / ``RATE`` must occur as it is. Items are taken in blocks of at most ``BLOCK_CHARS`` characters. The driver reads one block at a
time, each block passes over all documents, its hits are written as a table, and its broadcast is destroyed before the next one.
So memory has a fixed bound however large the benchmark is; the passes over the documents grow with it.

Null and empty texts hold nothing. Rows with equal ids are one document. Ties in distance take the first end. Ids stay in Arrow,
so they are exact beside nulls too. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import cut, removed, stored

RATE = 0.1
BLOCK_CHARS = 2_000_000
MEMORY = 50_000  # windows whose verdict a worker remembers


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) for each of budget + 1 pieces of nearly equal length."""
    n = int(len(item) * rate) + 1
    edges = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def masks(pattern: str) -> dict[str, int]:
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    return eq


def myers(pattern: str, text: str, eq: dict[str, int] | None = None, enough: int = 0) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a passage of ``text``, and the passage's end; stops at ``enough``."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq = masks(pattern) if eq is None else eq
    pv, mv, score, best, end = mask, 0, m, m, 0
    get = eq.get
    for j, c in enumerate(text, 1):
        e = get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # A passage may begin anywhere: nothing is carried into the first row.
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j
            if best <= enough:
                break
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.rate, self.seen = items, rate, {}
        self.edges = [[a for a, _ in pieces(text, rate)] + [len(text)] for _, text in items]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        places: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for k, (offset, piece) in enumerate(pieces(text, rate)):
                places.setdefault(piece, []).append((n, k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _check(self, n: int, window: str) -> tuple[int, int]:
        key = (n, window)
        if key not in self.seen:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            self.seen[key] = myers(self.items[n][1], window)
        return self.seen[key]

    def _ranges_hold(self, n: int, piece: int, start: int, text: str) -> bool:
        """Whether every range of pieces around the hit, but for the whole item, is within its own budget."""
        edges, item = self.edges[n], self.items[n][1]
        a, b, path = 0, len(edges) - 1, []
        while b - a > 1:
            path.append((a, b))
            middle = (a + b) // 2
            a, b = (a, middle) if piece < middle else (middle, b)
        for a, b in reversed(path[1:]):
            key, budget = (n, a, b), b - a - 1
            pattern = item[edges[a] : edges[b]]
            if key not in self.masks:
                self.masks[key] = masks(pattern)
            window = text[max(0, start + edges[a] - budget) : max(0, start + edges[b] + budget)]
            if myers(pattern, window, self.masks[key], budget)[0] > budget:
                return False
        return True

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the folded text): the nearest passage of each item that is within its budget."""
        t = fold(text)
        windows: dict[int, list[list[int]]] = {}
        if t and self.items:
            for end, (length, where) in self.automaton.iter(t):
                for n, k, offset in where:
                    m = len(self.items[n][1])
                    budget = int(m * self.rate)
                    start = end - length + 1 - offset
                    if not self._ranges_hold(n, k, start, t):
                        continue
                    lo, hi = max(0, start - budget), min(len(t), start + m + budget)
                    own = windows.setdefault(n, [])
                    # Hits come by their end; a window that touches the last one of the item extends it.
                    if own and lo <= own[-1][1] and hi >= own[-1][0]:
                        own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                    else:
                        own.append([lo, hi])
        found = []
        for n, own in windows.items():
            item = self.items[n][1]
            best = min(((d, lo + e) for lo, hi in own for d, e in [self._check(n, t[lo:hi])]), default=None)
            if best and best[0] <= int(len(item) * self.rate):
                found.append((self.items[n][0], *best))
        return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Folded items, at most BLOCK_CHARS characters at a time (or one longer item), read partition by partition."""
    block, size = [], 0
    rows = benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    for i, text in rows.toLocalIterator():
        item = fold(text)
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, item))
        size += len(item)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """id, item id, distance, end: each document and item of which it holds a passage."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"id {kind}, item {item_kind}, distance long, end long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    paths = []
    for block in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                ids, texts = batch.column("id").to_pylist(), batch.column("t").to_pylist()
                found = [(i, *hit) for i, t in zip(ids, texts, strict=True) for hit in matcher.find(t)]
                if found:
                    i, item, distance, end = zip(*found, strict=True)
                    columns = [pa.array(i, batch.schema.field("id").type), pa.array(item, item_type), pa.array(distance, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "distance", "end"])

        paths.append(stored(rows.mapInArrow(run, schema), "hits")[1])
        shared.destroy()
    out = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    best = out.groupBy("id", "item").agg(F.min(F.struct("distance", "end")).alias("b"))
    best = cut(best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.distance", "b.end"))
    removed(spark, *paths)
    return best


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows with a null id are matched by text alone and kept."""
    hit = cut(matches(docs, benchmark, id_col, text_col, rate=rate).select(F.col(id_col).alias("_hit")).distinct())
    return docs.join(hit, F.col(id_col) == F.col("_hit"), "left_anti")
