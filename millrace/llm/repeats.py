"""Substring dedup: repeats of 20 words and more, by seeds and extension.

A window is ``WINDOW`` consecutive words of one document. A window repeats if its words also start earlier: in a document before it, or
before it in the same one. All words of repeating windows go, so every maximal repeat of at least ``WINDOW`` words is removed but for
its first occurrence.

Seeds are winnowed anchors: each window chooses, of the hashes of its runs of ``SEED`` words, the smallest, the leftmost of equal ones.
The choice depends on the window's words alone, so equal windows have equal seeds at the same place, and about one word in eight is
a seed. An occurrence of a seed is extended both ways as far as windows choose it: its span, of at most 2 * WINDOW - SEED words.

1. Documents are scanned once. Occurrences of (seed, span) are joined within a block of occurrences first: all but the first there
   repeat whole. What is left, at most one row a block, is dealt out by seed.
2. Occurrences of one seed meet, as a stream of sorted rows. If all its spans are equal, all but the first repeat whole. Else the seed
   is open: its spans differ somewhere, as at the edges of a passage or around an edit. A block that already holds two spans of
   a seed says so by one row and keeps its occurrences apart, so a frequent seed is a row a block, whatever surrounds it.
3. The windows of open spans that are not known to repeat are hashed and dealt out by their own words: all but the first repeat. They too are
   joined within blocks first.
4. Overlapping and adjacent repeats of a document are merged to maximal ones.

No pairs are made, and no group is larger than the number of blocks. Spans and windows are told apart by two independent 64-bit hashes.
Results don't depend on how rows are dealt.

Documents are ordered by id; a null id comes last. Rows of equal id and text are one document given several times, and each row gets its result;
of other rows with one id, and of those without, the one with the smaller hash of its text comes first. Null texts have no words. Texts of any length
are read whole, in slices. Texts with fewer than ``WINDOW`` words stay. An empty table gives an empty result. Other columns pass
through ``deduplicated``; the helper columns are prefixed with ``_rep``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, removed, stored

WINDOW, SEED = 20, 6
#: Seeds to choose from in a window.
CHOICE = WINDOW - SEED + 1
#: Words that are hashed together, and occurrences or windows that a block joins, at most about.
SLICE, BLOCK = 1 << 17, 1 << 18
#: Words whose hashes a task keeps.
KNOWN = 1 << 19
LAST = np.iinfo("i8").max
#: Odd numbers: the bases of the two hashes.
BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_words = re.compile(WORD).findall
_word = re.compile(WORD).finditer

SINGLE, OPEN_SEED, REPEAT, OPEN = range(4)
ROW = "key long, span long, doc long, tie long, start int, more int, kind int"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words; the table is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str) -> np.ndarray:
        if len(text) <= 8 * SLICE:
            found = _words(text)
            return np.fromiter(map(self.__getitem__, found), "u8", len(found))
        words, parts = (m.group() for m in _word(text)), []
        while found := list(itertools.islice(words, SLICE)):
            parts.append(np.fromiter(map(self.__getitem__, found), "u8", len(found)))
        return np.concatenate(parts) if parts else np.zeros(0, "u8")


class Spans:
    """Two hashes of any span of an array of words."""

    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, words: np.ndarray):
        if not self._powers or len(self._powers[0][0]) <= len(words):
            size = max(2 * SLICE, len(words)) + 1
            self._powers[:] = [tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]).cumprod(dtype="u8") for b in (base, np.uint64(pow(int(base), -1, 1 << 64)))) for base in BASES]
        self.sums = [np.concatenate([[np.uint64(0)], (mixed(words ^ base) * up[: len(words)]).cumsum(dtype="u8")]) for base, (up, _) in zip(BASES, self._powers, strict=True)]

    def hashed(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        down = self._powers[which][1]
        return mixed((self.sums[which][end] - self.sums[which][start]) * down[start] + (end - start).astype("u8"))


def anchors(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, seed, span, first window, number of further windows of each occurrence; ``starts``: of documents in ``words``.

    Windows are counted from their document's start.
    """
    n = len(words) - WINDOW + 1
    none = tuple(np.zeros(0, t) for t in ("i8", "u8", "u8", "i8", "i8"))
    if n <= 0:
        return none
    spans = Spans(words)
    at = np.arange(len(words) - SEED + 1)
    seeds = spans.hashed(at, at + SEED, 0)
    best, choice = seeds[:n].copy(), np.zeros(n, "i8")
    for t in range(1, CHOICE):
        other = seeds[t : t + n]
        less = other < best
        np.copyto(best, other, where=less)
        choice[less] = t
    doc = np.searchsorted(starts, np.arange(n), "right") - 1
    whole = np.searchsorted(starts, np.arange(n) + WINDOW - 1, "right") - 1 == doc
    anchor = np.arange(n) + choice
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    if not len(first):
        return none
    # Windows of one anchor follow each other, and those across documents start groups of their own.
    group = np.cumsum(new & whole)
    size = np.bincount(group[whole], minlength=len(first) + 1)[1:]
    seed = best[first]
    return doc[first], seed, spans.hashed(first, first + size + WINDOW - 1, 1), first - starts[doc[first]], size - 1


def runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows with those that touch joined; one row each."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, more = doc[order], tie[order], start[order], more[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + more[:-1] + 1)
    first = np.flatnonzero(new)
    if not len(first):
        return doc, tie, start, more
    end = np.maximum.reduceat(start + more, first)
    return doc[first], tie[first], start[first], end - start[first]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype("u8").view("i8")


def _table(key, span, doc, tie, start, more, kind) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    return pa.RecordBatch.from_arrays([full(_signed(key) if isinstance(key, np.ndarray) else key, "i8"), full(_signed(span) if isinstance(span, np.ndarray) else span, "i8"), full(doc, "i8"), full(tie, "i8"), full(start, "i4"), full(more, "i4"), full(kind, "i4")], names=[c.split()[0] for c in ROW.split(", ")])


def _apart(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key that spreads rows which need no partner."""
    return mixed(doc.astype("u8") * BASES[0] + start.astype("u8"))


def scanned(docs: DataFrame) -> DataFrame:
    """ROW of the seeds of ``docs`` (doc, tie, t), joined within blocks."""

    def block(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        seed, span, doc, tie, start, more = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, tie, doc, span, seed))
        seed, span, doc, tie, start, more = (c[order] for c in (seed, span, doc, tie, start, more))
        new_seed, new = np.ones(len(seed), bool), np.ones(len(seed), bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new[1:] = new_seed[1:] | (span[1:] != span[:-1])
        # Copies of a document within the block are the same occurrence.
        same = np.zeros(len(seed), bool)
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1])
        leader = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & ~((doc == doc[leader]) & (tie == tie[leader]) & (start == start[leader]))
        if again.any():
            found = runs(*(c[again & ~same] for c in (doc, tie, start, more)))
            yield _table(_apart(found[0], found[2]), 0, *found, REPEAT)
        seed, span, doc, tie, start, more, new_seed = (c[new] for c in (seed, span, doc, tie, start, more, new_seed))
        group = np.cumsum(new_seed) - 1
        several = np.bincount(group)[group] > 1
        yield _table(seed[~several], span[~several], doc[~several], tie[~several], start[~several], more[~several], SINGLE)
        if several.any():
            yield _table(_apart(doc[several], start[several]), span[several], doc[several], tie[several], start[several], more[several], OPEN)
            mark = several & new_seed
            yield _table(seed[mark], 0, doc[mark], tie[mark], start[mark], more[mark], OPEN_SEED)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, count = Words(), [], 0
        texts: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def seeds() -> None:
            nonlocal texts, size, count
            if texts:
                starts = np.cumsum([0] + [len(w) for _, _, w in texts])[:-1]
                doc, seed, span, start, more = anchors(np.concatenate([w for _, _, w in texts]), starts)
                ids, ties = np.array([d for d, _, _ in texts], "i8"), np.array([t for _, t, _ in texts], "i8")
                held.append((seed, span, ids[doc], ties[doc], start, more))
                count += len(seed)
            texts, size = [], 0

        for batch in batches:
            for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = known.of(text)
                if len(words) < WINDOW:
                    continue
                texts.append((doc, tie, words))
                size += len(words)
                if size >= SLICE:
                    seeds()
                if count >= BLOCK:
                    yield from block(held)
                    held, count = [], 0
        seeds()
        if held:
            yield from block(held)

    return docs.select("doc", "tie", "t").mapInArrow(scan, ROW)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Arrays of sorted rows in which no group is cut."""
    rest = {c: np.zeros(0, "i8") for c in names}
    for batch in batches:
        rows = {c: np.concatenate([rest[c], batch.column(c).to_numpy(zero_copy_only=False).astype("i8")]) for c in names}
        n = len(rows[names[0]])
        if not n:
            continue
        last = np.ones(n, bool)
        for c in by:
            last &= rows[c] == rows[c][-1]
        cut_at = int(n - last[::-1].argmin()) if not last.all() else 0
        if cut_at:
            yield {c: v[:cut_at] for c, v in rows.items()}
        rest = {c: v[cut_at:] for c, v in rows.items()}
    if len(rest[names[0]]):
        yield rest


def met(rows: DataFrame) -> DataFrame:
    """(doc, tie, start, more, kind): what ROW says once occurrences of a seed have met; kind is REPEAT or OPEN."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, names, ["key"]):
            loose = g["kind"] >= REPEAT
            new = np.ones(len(loose), bool)
            new[1:] = g["key"][1:] != g["key"][:-1]
            group = np.cumsum(new) - 1
            single = g["kind"] == SINGLE
            lead = np.full(group[-1] + 1, len(loose))
            np.minimum.at(lead, group[single], np.flatnonzero(single))
            lead = np.minimum(lead, len(loose) - 1)[group]
            differs = (g["kind"] == OPEN_SEED) | (single & (g["span"] != g["span"][lead]))
            is_open = np.bincount(group, differs)[group] > 0
            first = (g["doc"] == g["doc"][lead]) & (g["tie"] == g["tie"][lead]) & (g["start"] == g["start"][lead])
            kind = np.where(loose, g["kind"], np.where(is_open, OPEN, REPEAT))
            out = loose | (single & (is_open | ~first))
            yield pa.RecordBatch.from_arrays([pa.array(g[c][out].astype(t)) for c, t in (("doc", "i8"), ("tie", "i8"), ("start", "i4"), ("more", "i4"))] + [pa.array(kind[out].astype("i4"))], names=["doc", "tie", "start", "more", "kind"])

    # Spans last: within a seed the first occurrence comes first.
    placed = rows.repartition("key").sortWithinPartitions("key", "doc", "tie", "start")
    return placed.mapInArrow(meet, "doc long, tie long, start int, more int, kind int")


def _covered(starts: list[int], more: list[int]) -> list[tuple[int, int]]:
    """Sorted ranges of windows, joined where they touch: (first, last)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, s + m) for s, m in zip(starts, more, strict=True)):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def open_windows(texts: DataFrame) -> DataFrame:
    """(w1, w2, doc, tie, start, kind) of windows of open spans that aren't known to repeat, joined within blocks: REPEAT or SINGLE.

    ``texts``: (doc, tie, t, repeats, opens), the last two arrays of (start, more).
    """

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        w1, w2, doc, tie, start = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, tie, doc, w2, w1))
        w1, w2, doc, tie, start = (c[order] for c in (w1, w2, doc, tie, start))
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        same = ~new & (doc == doc[lead]) & (tie == tie[lead]) & (start == start[lead])
        columns = [pa.array(c[~same].astype(t)) for c, t in ((_signed(w1), "i8"), (_signed(w2), "i8"), (doc, "i8"), (tie, "i8"), (start, "i4"), (np.where(new, SINGLE, REPEAT), "i4"))]
        return pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "doc", "tie", "start", "kind"])

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, count = Words(), [], 0
        for batch in batches:
            for doc, tie, text, repeats, opens in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "t", "repeats", "opens")), strict=True):
                words = known.of(text)
                wanted = np.zeros(len(words) - WINDOW + 1, bool)
                for r in opens:
                    wanted[r["start"] : r["start"] + r["more"] + 1] = True
                for r in repeats or ():
                    wanted[r["start"] : r["start"] + r["more"] + 1] = False
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                for low in range(0, len(at), SLICE):
                    part = at[low : low + SLICE]
                    spans = Spans(words[part[0] : part[-1] + WINDOW])
                    local = part - part[0]
                    held.append((spans.hashed(local, local + WINDOW, 0), spans.hashed(local, local + WINDOW, 1), np.full(len(part), doc), np.full(len(part), tie), part))
                    count += len(part)
                    if count >= BLOCK:
                        yield block(held)
                        held, count = [], 0
        if held:
            yield block(held)

    return texts.mapInArrow(hash_windows, "w1 long, w2 long, doc long, tie long, start int, kind int")


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc, tie, start, more) of the ranges of repeating windows among ``open_windows``."""
    names = ["w1", "w2", "doc", "tie", "start", "kind"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, names, ["w1", "w2"]):
            new = np.ones(len(g["w1"]), bool)
            new[1:] = (g["w1"][1:] != g["w1"][:-1]) | (g["w2"][1:] != g["w2"][:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            first = (g["doc"] == g["doc"][lead]) & (g["tie"] == g["tie"][lead]) & (g["start"] == g["start"][lead])
            doc, tie, start, more = runs(*(g[c][~first] for c in ("doc", "tie", "start")), np.zeros(int((~first).sum()), "i8"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(start.astype("i4")), pa.array(more.astype("i4"))], names=["doc", "tie", "start", "more"])

    placed = windows.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc", "tie", "start").select(*names)
    return placed.mapInArrow(meet, "doc long, tie long, start int, more int")


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with _rep_doc, _rep_tie, _rep_text and _rep_ranges, its ranges (start, more) of repeating windows; and tables to remove."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumns({"_rep_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))), "_rep_text": text})
    keyed = keyed.withColumn("_rep_tie", F.xxhash64("_rep_text") if _ids_repeat(keyed) else F.lit(0).cast("long"))
    docs = keyed.select(F.col("_rep_doc").alias("doc"), F.col("_rep_tie").alias("tie"), F.col("_rep_text").alias("t"))
    found, first = stored(met(scanned(docs)), "repeats")
    ranges = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "more")))
    of_docs, second = stored(found.groupBy("doc", "tie").agg(ranges(REPEAT).alias("repeats"), ranges(OPEN).alias("opens")), "ranges")
    texts = docs.join(of_docs.where(F.size("opens") > 0), ["doc", "tie"]).select("doc", "tie", "t", "repeats", "opens")
    more, third = stored(later_windows(open_windows(texts)), "windows")
    every = of_docs.select("doc", "tie", F.explode("repeats").alias("r")).select("doc", "tie", "r.start", "r.more").unionByName(more)
    merged = every.groupBy(F.col("doc").alias("_rep_doc"), F.col("tie").alias("_rep_tie")).agg(F.collect_list(F.struct("start", "more")).alias("_rep_ranges"))
    return keyed.join(merged, ["_rep_doc", "_rep_tie"], "left"), [first, second, third]


def _ids_repeat(keyed: DataFrame) -> bool:
    """Whether ids tell rows apart; else the hash of the text is part of the key."""
    return not keyed.groupBy("_rep_doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end: the maximal repeats that go, in words, end exclusive."""
    found, tables = repeated_words(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, e + WINDOW) for i, r in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for s, e in _maximal(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[id_col, "start", "end"])

    out, path = stored(found.where("_rep_ranges is not null").select(id_col, "_rep_ranges").mapInArrow(merge, f"{id_col} {kind}, start long, end long"), "spans")
    removed(df.sparkSession, *tables)
    return out


def _maximal(ranges: list[dict]) -> list[tuple[int, int]]:
    """(first, last) windows of maximal repeats: ranges whose words touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for s, e in _covered([r["start"] for r in ranges], [r["more"] for r in ranges]):
        if out and s <= out[-1][1] + WINDOW:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _kept(text: str, ranges: list[dict] | None) -> tuple[int, int, list[str]]:
    """Number of words, number of removed words, kept words."""
    words = _words(text)
    gone = np.zeros(len(words), bool)
    for s, e in _maximal(ranges or []):
        gone[s : e + WINDOW] = True
    n = int(gone.sum())
    return len(words), n, list(itertools.compress(words, ~gone)) if n else words


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row."""
    found, tables = repeated_words(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [_kept(t, r) for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                shas = [hashlib.sha256(" ".join(w).encode("utf-8", "surrogatepass")).hexdigest() for _, _, w in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(shas, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    out, _ = stored(found.select(id_col, "_rep_text", "_rep_ranges").mapInArrow(sums, f"{id_col} {kind}, n_words long, n_removed long, kept_sha256 string"), "kept")
    removed(df.sparkSession, *tables)
    return out


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the kept words as its text, joined by blanks; texts without repeats stay as they are."""
    found, tables = repeated_words(df, id_col, text_col)
    rest = found.where("_rep_ranges is null").select(*df.columns)
    others = [c for c in df.columns if c != text_col]
    changed = found.where("_rep_ranges is not null").select(*others, F.struct("_rep_text", "_rep_ranges").alias("_rep"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema if f.name != "_rep") + f", `{text_col}` string"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(_kept(r["_rep_text"], r["_rep_ranges"])[2]) for r in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], names=[*others, text_col])

    out, _ = stored(rest.unionByName(changed.mapInArrow(rewrite, schema).select(*df.columns)), "deduplicated")
    removed(df.sparkSession, *tables)
    return out


def oracle() -> str:
    """SQL of ``digest``: all windows as text, for tables of moderate size with one row an id."""
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT x, min((doc_id, i)) AS first FROM x GROUP BY x HAVING count(*) > 1),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN f USING (x) WHERE (doc_id, i) <> first) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) e ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM g) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN o USING (doc_id)"""
