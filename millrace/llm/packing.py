"""Token ids in packed binary rows: best-fit-decreasing packing with a segment tree over capacities.

Texts are tokenised and packed where they are read, in groups of about ``GROUP`` tokens, without a shuffle. A document longer
than a row is split into pieces that together hold every token. Pieces of a group go, longest first, to the row with the least
room that holds them; a segment tree over capacities finds it. A packed row has the ids, padded to the row's width, the
cumulative lengths of its segments, positions that begin at 0 in every segment, and each segment's document, part and offset.

Ids come from a table of byte strings by word: the vocabulary's pattern begins a new match at a single blank between two
other characters, so a text without white space runs is the concatenation of its words' ids. Other texts are encoded whole.

Null and empty texts have no tokens and so no segment. Rows with equal ids are packed each; an empty table gives an empty result.
Strings that look like special tokens are text. Ids stay in Arrow, so they are exact beside nulls too. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
WIDTH, GROUP, PAD = 2048, 1 << 21, 50256
TABLE_ROWS = 300_000
_run = re.compile(r"\s\s").search


class WordIds(dict):
    """word -> ids of a blank and the word, as uint16 bytes."""

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self._encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._encode(" " + word)
        return ids

    def ids(self, text: str) -> np.ndarray:
        if len(self) > TABLE_ROWS:
            self.clear()
        if _run(text):
            return np.frombuffer(self._encode(text), "<u2")
        first, *rest = text.split(" ")
        return np.frombuffer(self._encode(first) + b"".join(map(self.__getitem__, rest)), "<u2")

    def text(self, ids: np.ndarray) -> str:
        return self._encoding.decode(ids.tolist())


class Capacities:
    """Rows by room left; the least room of at least n in logarithmic time."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = np.zeros(2 * self.leaves, "i8").tolist()
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, removed."""
        i = need + self.leaves
        count = self.count
        while not count[i]:
            while i & 1:  # a right child: go up to a left one
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i <<= 1
            if not count[i]:
                i += 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Pieces of each row; no length is above ``width``. Ties keep their order."""
    room, rows = Capacities(width), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        n = lengths[piece]
        found = room.take(n)
        if found is None:
            rows.append([])
            found = width, len(rows) - 1
        rows[found[1]].append(piece)
        if found[0] > n:
            room.add(found[0] - n, found[1])
    return rows


SCHEMA = "shard long, bin long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, parts array<int>, offsets array<long>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group: int = GROUP, vocabulary: str | None = None) -> DataFrame:
    """Packed rows. ``input_ids`` and ``position_ids`` are ``width`` little-endian uint16; shard is the task, bin counts within it."""
    if not 0 < width < 1 << 16:
        raise ValueError("width must fit 16 bits")
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, bins, words = TaskContext.get().partitionId(), 0, WordIds(vocabulary)
        held, size, kinds = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bins, held, size
            rows = best_fit_decreasing([len(p[3]) for p in held], width)
            for at in range(0, len(rows), 500):
                out = []
                for row in rows[at : at + 500]:
                    own = [held[i] for i in row]
                    ends = np.cumsum([0, *(len(p[3]) for p in own)])
                    ids, places = np.full(width, PAD, "<u2"), np.zeros(width, "<u2")
                    for a, p in zip(ends[:-1], own, strict=True):
                        ids[a : a + len(p[3])] = p[3]
                        places[a : a + len(p[3])] = np.arange(len(p[3]))
                    doc, part, offset = zip(*(p[:3] for p in own), strict=True)
                    out.append((shard, bins, int(ends[-1]), len(own), ids.tobytes(), ends.tolist(), places.tobytes(), list(doc), list(part), list(offset)))
                    bins += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0

        for batch in batches:
            n = pa.int32()
            kinds = [pa.int64(), pa.int64(), n, n, pa.binary(), pa.list_(n), pa.binary(), pa.list_(batch.schema.field("id").type), pa.list_(n), pa.list_(pa.int64())]
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if not t:
                    continue
                ids = words.ids(t)
                for part, at in enumerate(range(0, len(ids), width)):
                    held.append((i, part, at, ids[at : at + width]))
                    size += len(held[-1][3])
                    if size >= group:
                        yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA.format(kind=kind))


def unpack(packed: pd.DataFrame, vocabulary: str) -> dict:
    """Texts by document id, from packed rows; ids must be unique. For tests and inspection."""
    words, found = WordIds(vocabulary), {}
    for row in packed.itertuples(index=False):
        ids = np.frombuffer(row.input_ids, "<u2")
        for k, (doc, offset) in enumerate(zip(row.doc_ids, row.offsets, strict=True)):
            found.setdefault(doc, []).append((offset, ids[row.cu_seqlens[k] : row.cu_seqlens[k + 1]]))
    return {d: words.text(np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])])) for d, p in found.items()}
