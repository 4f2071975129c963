"""N-gram Jaccard join by signature trees.

Documents link when the Jaccard similarity of their sets of word n-grams reaches a percentage. The result gives each document
its set's size and the smallest id that it reaches by links.

1. Documents with equal sets are one class, a node of the link graph.
2. Trees can't span all documents, so a prefix deals them out: sets that link share one of the first ``n - ceil(t n) + 1`` members
   in a common order. The order puts rare words first, by a table of word counts of fixed size over all documents, so a passage
   that many documents share comes last. Any order is exact; counts only decide how much is compared. Nodes that share a prefix
   member are a bucket; of buckets of the same nodes one is kept, and it is cut into blocks of bounded size.
3. In a block, nodes are ordered by size and become the leaves of a signature tree: each tree node holds the OR of the token
   bitmaps below it and their range of sizes. A dual traversal from the roots drops pairs of tree nodes whose largest possible
   overlap, or whose sizes, cannot reach the percentage, or which are one component. All trees of a batch descend together.
4. The trees run twice. First each block by itself, with the bucket's smallest node as a guest: every node proposes its best partner, proposals
   are verified on the whole sets, in integers, and connected. So a group of many copies is settled by one comparison a node
   and bucket. Then each bucket that still holds two components: trees of pairs of blocks, in which all that the bitmaps leave
   between different components is verified. The second run alone gives the same result.

So any two linked documents end in one component: they share a bucket, and there they either are connected already or compared.

Null and empty texts have an empty set and link with nothing; texts of fewer words than n have one member, all their words.
Rows with equal ids are one document: their sets, where they differ, are linked to each other. A row with a null id keeps its
size and has no component. Ids never pass through floating point. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, cut, heads_of, in_bitmap, removed, stored

WORDS, PERCENT = 4, 85
COUNTS = 1 << 18  # entries of the table of word counts: 1 MB, whatever the input
BITS = 2048
LEAF, FAN = 16, 8
BLOCK = 2048
HASHES = 300_000  # entries of a worker's table of word hashes
PAIRS = 50_000  # pairs of bitmaps that are compared at once


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a whole text; ASCII letters in lower case, ASCII white space between words."""
        if len(self) > HASHES:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), "u8", len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A hash for each n-gram, in order of the text, and the words that each spans (all of them if there are fewer than n)."""
    span = min(n, len(words))
    if not span:
        return words[:0], 0
    m = len(words) - span + 1
    h = np.full(m, span, "u8")
    for j in range(span):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + m]
    return _mix(h), span


def distinct_shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(text), n)[0])


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How often words occur, by hash, over all documents: (slot, count) by task, then added up. At most COUNTS rows are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, "i8")
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found.update((t or "").encode("utf-8", "surrogatepass").lower().split())
            at = np.fromiter((xxhash.xxh64_intdigest(w) & (COUNTS - 1) for w in found), "i8", len(found))
            np.add.at(total, at, np.fromiter(found.values(), "i8", len(found)))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int32()), "n": pa.array(total[slots], pa.int64())})

    found = docs.select(F.col(text).alias("t")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTS, "f8")
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total


def signatures(docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """id, h (hash of the text), size, set_key, prefix (hashes), bits, spare (members beyond one a bit): one row per row."""
    rarity = np.log2(word_counts(docs, text) + 1).astype("u8") * np.uint64(4)
    shared = docs.sparkSession.sparkContext.broadcast(rarity.astype("u1"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rare = WordHashes(), shared.value.astype("u8")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for t in part.column("t").to_pylist():
                    words = hashes.of(t)
                    h, span = shingles(words, n)
                    if not span:
                        out.append((0, None, None, None, 0))
                        continue
                    w = rare[(words & np.uint64(COUNTS - 1)).astype("i8")]
                    least = w[: len(h)].copy()
                    for j in range(1, span):
                        np.minimum(least, w[j : j + len(h)], out=least)
                    ordered = np.unique((least << np.uint64(56)) | (h >> np.uint64(8)))
                    size = len(np.unique(h))
                    keep = size - (percent * size + 99) // 100 + 1
                    bits = np.zeros(BITS, bool)
                    bits[((h >> np.uint64(8)) % np.uint64(BITS)).astype("i8")] = True
                    out.append((size, xxhash.xxh3_128_digest(ordered.tobytes()), ordered[:keep].view("i8"), np.packbits(bits).tobytes(), size - int(bits.sum())))
                size, key, prefix, bits, spare = zip(*out, strict=True)
                columns = [part.column("id"), part.column("h"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(spare, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "size", "set_key", "prefix", "bits", "spare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return rows.mapInArrow(sign, f"id {kind}, h long, size long, set_key binary, prefix array<long>, bits binary, spare long")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Only texts of nodes (node, id, h) in pairs are moved."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, mine = WordHashes(), None, None
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, mine = a, distinct_shingles(x, n, hashes)
                other = distinct_shingles(y, n, hashes)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both) > 0)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("_t"))
    texts, path = stored(rows.join(wanted.select("node", "id", "h"), ["id", "h"]).select("node", "_t").dropDuplicates(["node"]), "texts")
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("_t").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("_t").alias("tb")), "b").select("a", "b", "ta", "tb")
    found = cut(two.mapInPandas(check, "a long, b long"))
    removed(docs.sparkSession, path)
    return found


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` things: whose they are, and their number within it from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _across(start_a: np.ndarray, n_a: np.ndarray, start_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of members of each pair of ranges, and the number of the pair of ranges."""
    owner, k = _ragged(n_a * n_b)
    return start_a[owner] + k // n_b[owner], start_b[owner] + k % n_b[owner], owner


class Level:
    """Nodes of one height, of all trees: size range, OR of bitmaps, most spare, component (-1: several), children, first node and nodes of each tree."""

    def __init__(self, low, high, bits, spare, comp, child, children, first, count):
        self.low, self.high, self.bits, self.spare, self.comp = low, high, bits, spare, comp
        self.child, self.children, self.first, self.count = child, children, first, count

    def above(self, width: int) -> Level:
        """Its parents: ``width`` neighbours of a tree under one node."""
        count = -(-self.count // width)
        tree, k = _ragged(count)
        child = self.first[tree] + k * width
        children = np.minimum(width, self.count[tree] - k * width)
        least, most = np.minimum.reduceat(self.comp, child), np.maximum.reduceat(self.comp, child)
        return Level(
            self.low[child], np.maximum.reduceat(self.high, child), np.bitwise_or.reduceat(self.bits, child, axis=0), np.maximum.reduceat(self.spare, child),
            np.where(least == most, least, -1), child, children, np.cumsum(count) - count, count,
        )


def tree_join(group: np.ndarray, side: np.ndarray, size: np.ndarray, bits: np.ndarray, spare: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common): rows of one group that may link and are in different components, and the bits that they share.

    Rows of a group are one tree (all of side -1) or two (sides 0 and 1, of which only pairs across are wanted).
    """
    order = np.lexsort((comp, size, side, group))
    group, side = group[order], side[order]
    starts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]) | (side[1:] != side[:-1])) + 1])
    count = np.diff(np.append(starts, len(order)))
    size, bits, spare, comp = size[order], bits[order], spare[order], comp[order]
    rows = Level(size, size, bits, spare, comp, None, None, starts, count)
    levels = [rows, rows.above(LEAF)]
    while levels[-1].count.max() > 1:
        levels.append(levels[-1].above(FAN))
    # The roots, one a tree in order: each with itself, or the two of a group with each other.
    tree_group, tree_side = group[starts], side[starts]
    alone = np.flatnonzero(tree_side < 0)
    left = np.flatnonzero((tree_side[:-1] == 0) & (tree_side[1:] == 1) & (tree_group[:-1] == tree_group[1:]))
    a, b = np.concatenate([alone, left]), np.concatenate([alone, left + 1])
    same = np.concatenate([np.ones(len(alone), bool), np.zeros(len(left), bool)])
    for height in range(len(levels) - 1, -1, -1):
        here = levels[height]
        keep, shared = np.zeros(len(a), bool), np.zeros(len(a), "i8")
        for at in range(0, len(a), PAIRS):
            part = slice(at, at + PAIRS)
            i, j = a[part], b[part]
            one = (here.comp[i] == here.comp[j]) & (here.comp[i] >= 0)
            sizes = (100 * here.high[i] >= percent * here.low[j]) & (100 * here.high[j] >= percent * here.low[i])
            on = np.flatnonzero(sizes & ~one)
            i, j = i[on], j[on]
            common = np.bitwise_count(here.bits[i] & here.bits[j]).sum(-1, dtype="i8")
            # Members that share a bit make the bound loose by ``spare``; no overlap is larger than the smaller set.
            most = np.minimum(common + np.minimum(here.spare[i], here.spare[j]), np.minimum(here.high[i], here.high[j]))
            ok = most * (100 + percent) >= percent * (here.low[i] + here.low[j])
            keep[at + on[ok]] = True
            shared[at + on] = common
        a, b, same = a[keep], b[keep], same[keep]
        if not height or not len(a):
            break
        x, y, owner = _across(here.child[a], here.children[a], here.child[b], here.children[b])
        same = same[owner]
        # Within one tree each pair comes once; a row does not meet itself.
        wanted = ~same | (x < y if height == 1 else x <= y)
        a, b, same = x[wanted], y[wanted], same[wanted]
    return order[a], order[b], shared[keep] if len(a) else np.zeros(0, "i8")


def _tree_pairs(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs of rows (bucket, block, side, node, size, bits, spare, comp); with ``best`` each row's best earlier partner only."""

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["bucket", "block"], sort=False).ngroup().to_numpy()
        size, spare, comp, side, node = (pdf[c].to_numpy("i8") for c in ("size", "spare", "comp", "side", "node"))
        bits = np.frombuffer(b"".join(pdf["bits"]), "u8").reshape(len(pdf), BITS // 64)
        i, j, common = tree_join(group, side, size, bits, spare, comp, percent)
        if best and len(i):
            # Of a row's partners before it in order of size and node, that with the most bits in common for both sizes.
            swap = (size[i] > size[j]) | ((size[i] == size[j]) & (node[i] > node[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            like = common / (size[i] + size[j])
            at = np.lexsort((node[i], -like, j))
            first = np.concatenate([[True], j[at][1:] != j[at][:-1]])
            i, j = i[at][first], j[at][first]
        u, v = node[i], node[j]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)}).query("a < b").drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            bucket, block = pdf["bucket"].to_numpy(), pdf["block"].to_numpy()
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            if len(edge):
                yield groups(pdf.iloc[: edge[-1]])
            rest = pdf.iloc[edge[-1] :] if len(edge) else pdf
        if rest is not None and len(rest):
            yield groups(rest)

    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInPandas(run, "a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, settle: bool = True) -> DataFrame:
    """id, n_shingles, component_id. ``settle``: run the trees of single blocks first; without it the result is the same."""
    spark = docs.sparkSession
    whole, path = stored(signatures(docs, id_col, text_col, words, percent).withColumn("node", F.monotonically_increasing_id()), "signatures")
    signed = cut(whole.select("id", "h", "size", "set_key", "node"))
    known = signed.where("size > 0 and id is not null")
    classes = cut(known.groupBy("set_key").agg(F.min("id").alias("least"), F.min("node").alias("node")))
    nodes = cut(known.join(classes.select("node"), "node", "left_semi").select("node", "id", "h"))
    reps, kept_path = stored(whole.join(nodes.select("node"), "node", "left_semi").select("node", "size", "prefix", "bits", "spare"), "nodes")
    removed(spark, path)
    # Different sets under one id.
    several = known.groupBy("id").agg(F.min(F.xxhash64("set_key")).alias("x"), F.max(F.xxhash64("set_key")).alias("y")).where("x <> y").select("id")
    sets = known.join(several, "id", "left_semi").select("id", "set_key").join(classes.select("set_key", "node"), "set_key").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n"))
    sets = cut(sets.select("id", "node"))
    edges = sets.join(sets.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a < b").distinct()

    rows = reps.select(F.explode("prefix").alias("bucket"), "node")
    # Most members of a prefix are no other document's: they are told apart by counts, the smallest rows there are.
    shared = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    rows = cut(in_bitmap(rows, "bucket", shared, "bucket").join(shared, "bucket"))
    heads = cut(heads_of(rows, "bucket", "node").select("bucket", "head", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    members = cut(rows.join(heads, "bucket"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")
    leaves = reps.select("node", "size", "bits", "spare")
    columns = ["bucket", "block", "side", "node", "size", "bits", "spare", "comp"]

    labelled = members.withColumn("comp", F.col("node"))
    if settle:
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        single = labelled.withColumn("block", F.explode(F.when(F.col("node") == F.col("head"), every).otherwise(F.array(own)))).withColumn("side", F.lit(-1))
        proposed = cut(_tree_pairs(single.join(leaves, "node").select(*columns), percent, True).distinct())
        edges = cut(edges.unionByName(verify(proposed, nodes, docs, id_col, text_col, words, percent)))
        comps = cut(connected_components(edges, "a", "b"))
        labelled = members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        labelled = cut(labelled.select("bucket", "node", "comp", "parts"))
    mixed = cut(labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket"))
    left = labelled.join(mixed, "bucket", "left_semi").withColumn("own", own)
    # Row of part p goes to the blocks (p, q) and (q, p), smaller part first; block = smaller * parts + larger.
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    left = left.withColumn("side", side).join(leaves, "node").select(*columns)
    more = _tree_pairs(left, percent, False).distinct()
    if settle:
        more = more.join(proposed, ["a", "b"], "left_anti")
    edges = edges.unionByName(verify(cut(more), nodes, docs, id_col, text_col, words, percent))
    final = cut(connected_components(edges, "a", "b"))
    removed(spark, kept_path)

    at = cut(classes.join(final, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("component")))
    smallest = cut(at.groupBy("component").agg(F.min("least").alias("component_id")))
    reached = cut(at.join(smallest, "component").select("set_key", "component_id"))
    out = signed.select("id", "size", "set_key").join(reached, "set_key", "left")
    found = out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.expr("CASE WHEN id IS NOT NULL THEN coalesce(component_id, id) END AS component_id"))
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows with a null id stay. Columns are unchanged."""
    joined = jaccard_join(docs, id_col, text_col, words, percent)
    gone = cut(joined.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
