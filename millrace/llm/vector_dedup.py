"""Embedding near-duplicates: all pairs of vectors of a label, in pairs of bounded blocks.

Vectors of a label are dealt to parts of about ``PART`` rows, and each pair of parts is one block that one task multiplies. So every pair of
vectors of equal labels is compared, and nothing rests on a sample. A block emits links that connect what its links connect, at most one a
vector. Vectors of one component are at last compared with each other, in blocks of ``BLOCK``, for their numbers of links. Both take a square:
of a label's size and of a component's. Equal vectors of one label are one vector with a multiplicity.

``rounds`` asks for sorted projection passes instead, which may miss links. Each pass gives a vector the concatenated signs of its products with random
directions, sorts all vectors by (label, signs) and compares each with its successors in a window of the same label. Vectors are centred by their
label's mean first, so a cloud that points one way is divided too. Windows and passes grow by the given rounds until recall is measured as
``GOAL``: ``SAMPLE`` vectors, the first by a hash of their id, are compared with all vectors of their label, and of the links found so (one a
sample vector and batch of rows) the passes must have connected that share. Where no round reaches it, all pairs are compared. The order is
global: a range-partitioned sort with counted offsets, blocks of ``SPAN`` ranks, and the first rows of the next block, as many as the window
has, as a tail.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing. Vectors of
different lengths don't link. Cosines are in double precision. Rows with equal ids are one node. Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, cut
from millrace.llm.mixing import ranked

LEAST = 0.98
SIGNS, SPAN, BLOCK, PART, SEED = 48, 1024, 512, 1024, 11
#: (passes, window) of each round, where rounds are asked for; no window is larger than SPAN.
ROUNDS = ((14, 64), (28, 256), (56, 1024))
SAMPLE, GOAL = 1000, 0.98


def directions(dim: int, passes: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dim, seed]).normal(size=(dim, passes * SIGNS))


def keys(matrix: np.ndarray, passes: int, seed: int = 0) -> np.ndarray:
    """(rows, passes) of sign keys."""
    bits = (matrix @ directions(matrix.shape[1], passes, seed) > 0).reshape(len(matrix), passes, SIGNS)
    return (bits * (1 << np.arange(SIGNS - 1, -1, -1, dtype="i8"))).sum(2)


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, "f8") for v in vectors])
    # Scaling first keeps tiny and huge components within range.
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what (i, j) connect; at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the symmetric matrix ``near`` connects; at most a row less than it has."""
    a, b, unseen = [], [], np.ones(len(near), bool)
    for start in np.flatnonzero(near.any(1)).tolist():
        if not unseen[start]:
            continue
        unseen[start], todo = False, [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & unseen)
            unseen[new] = False
            a.append(np.full(len(new), x))
            b.append(new)
            todo += new.tolist()
    none = [np.empty(0, "i8")]
    return np.concatenate(none + a), np.concatenate(none + b)


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal ``columns``, which come together."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = np.ones(len(pdf) - 1, bool)
        for c in columns:
            v = pdf[c].to_numpy()
            same &= v[1:] == v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield pdf.iloc[s:e]
        rest = pdf.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def label_means(classes: DataFrame) -> DataFrame:
    """label, mean of its unit vectors; sums are made by batch first."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(label, unit(part["v"]).sum(0).tolist(), len(part)) for label, part in pdf.groupby("label")]
            yield pd.DataFrame(rows, columns=["label", "total", "n"])

    partial = classes.select("label", "v").mapInPandas(sums, "label string, total array<double>, n long")
    each = partial.select("label", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))


def _windows(classes: DataFrame, centred: DataFrame, kind: str, least: float, passes: int, window: int, seed: int) -> DataFrame:
    """Links (a, b) that one round of passes finds; they connect what its windows hold."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                m = unit(part["v"]) - np.stack(part["mean"])
                yield pd.DataFrame({"node": part["node"], "label": part["label"], "keys": list(keys(m, passes, seed))})

    signs = centred.mapInPandas(signed, f"node {kind}, label string, keys array<long>")
    order = ranked(signs.select("node", "label", F.posexplode("keys").alias("pass", "key")), "pass", "label", "key", "node")
    order = order.withColumn("block", F.floor(F.col("rank") / SPAN))
    in_tail = (F.col("rank") % SPAN < window) & (F.col("block") > 0)
    order = order.withColumn("block", F.explode(F.when(in_tail, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    placed = order.join(classes.select("node", "v"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _runs(batches, ["block"]):
            out = []
            for _, part in block.groupby(["pass", "label"], sort=False):
                m, node = unit(part["v"]), part["node"].to_numpy()
                # Every window lies within a slice of span + window rows.
                near = m @ m.T >= least
                i, j = np.nonzero(np.triu(near, 1) & ~np.triu(np.ones_like(near), window + 1))
                out += [(node[a], node[b]) for a, b in forest(len(m), i, j)]
            yield pd.DataFrame(out, columns=["a", "b"])

    placed = placed.repartition("block").sortWithinPartitions("block", "rank").select("block", "pass", "label", "node", "v")
    return placed.mapInPandas(compare, f"a {kind}, b {kind}")


def _block_pairs(rows: DataFrame, group: str, n: str, size: int = BLOCK) -> DataFrame:
    """``rows`` of groups of ``n`` in pairs of parts of about ``size`` rows: own and other part, and the pair's number."""
    rows = rows.withColumn("parts", F.ceil(F.col(n) / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("part", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    return rows.repartition(group, "part").sortWithinPartitions(group, "part")


def _all_pairs(classes: DataFrame, kind: str, least: float) -> DataFrame:
    """Links (a, b) that connect all that is connected within each label."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _runs(batches, ["label", "part"]):
            m, node, own = unit(block["v"]), block["node"].to_numpy(), block["own"].to_numpy()
            one, other = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
            near = np.zeros((len(m), len(m)), bool)
            # In a block of two parts only pairs across them count; pairs within a part have a block of their own.
            near[np.ix_(one, other)] = m[one] @ m[other].T >= least
            if len(one) < len(m):
                near |= near.T
            elif block["other"].iloc[0] != own[0]:
                continue
            np.fill_diagonal(near, False)
            i, j = spanning(near)
            yield pd.DataFrame({"a": node[i], "b": node[j]})

    sized = classes.join(cut(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))), "label")
    return _block_pairs(sized, "label", "n", PART).select("label", "part", "own", "other", "node", "v").mapInPandas(compare, f"a {kind}, b {kind}")


def _sampled_links(classes: DataFrame, kind: str, least: float) -> DataFrame:
    """True links (a, b) of a bounded sample a with all vectors b: the weakest of each sample vector and batch."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "label", "v").toPandas()
    shared = classes.sparkSession.sparkContext.broadcast({k: (part["node"].to_numpy(), unit(part["v"])) for k, part in sample.groupby("label")} if len(sample) else {})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                if label not in shared.value:
                    continue
                asked, m = shared.value[label]
                node = part["node"].to_numpy()
                cosine = unit(part["v"]) @ m.T
                cosine = np.where((cosine >= least) & (node[:, None] != asked[None]), cosine, np.inf)
                at = cosine.argmin(0)
                on = np.isfinite(cosine[at, np.arange(len(asked))])
                yield pd.DataFrame({"a": asked[on], "b": node[at[on]]})

    return classes.select("node", "label", "v").mapInPandas(compare, f"a {kind}, b {kind}")


def _recall(links: DataFrame, comps: DataFrame) -> float:
    """Share of ``links`` within one component; 1 if there are none."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    n, found = both.agg(F.count(F.lit(1)), F.count_if(F.col("ca") == F.col("cb"))).first()
    return found / n if n else 1.0


def connect(classes: DataFrame, kind: str, least: float, rounds: tuple[tuple[int, int], ...] | None, exact: bool) -> DataFrame:
    """(node, component) of the links of ``classes`` (node, label, v)."""
    if exact or not rounds:
        return connected_components(_all_pairs(classes, kind, least), "a", "b")
    links = cut(_sampled_links(classes, kind, least))
    centred = classes.select("node", "label", "v").join(cut(label_means(classes)), "label")
    edges = None
    for seed, (passes, window) in enumerate(rounds):
        more = cut(_windows(classes, centred, kind, least, passes, window, seed))
        edges = more if edges is None else edges.unionByName(more)
        comps = cut(connected_components(edges, "a", "b"))
        if _recall(links, comps) >= GOAL:
            # The sample's own links are true, whether a window held them or not.
            return cut(connected_components(edges.unionByName(links), "a", "b"))
    return connected_components(_all_pairs(classes, kind, least), "a", "b")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST,
    rounds: tuple[tuple[int, int], ...] | None = None, exact: bool = False,
) -> DataFrame:
    """id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    # Vectors of other lengths are as if of another label; -0.0 is 0.0.
    valid = valid.select("id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("label"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    valid = valid.withColumn("k", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    classes = cut(valid.groupBy("label", "k").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    kind = df.schema[id_col].dataType.simpleString()
    # Copies under one id, of several labels or vectors, are one node.
    comps = cut(connect(classes, kind, least, rounds, exact))

    size = cut(comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    member = comps.join(size, "component").join(classes.select("node", "label", "v", "copies"), "node")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(batches, ["component", "part"]):
            own, other = group["own"].to_numpy(), group["other"].to_numpy()
            node, label, copies = group["node"].to_numpy(), group["label"].to_numpy(), group["copies"].to_numpy("i8")
            m = unit(group["v"]) if len(set(map(len, group["v"]))) == 1 else None
            if m is None:
                continue
            near = (m @ m.T >= least) & (label[:, None] == label[None])
            np.fill_diagonal(near, False)
            # In a block of two parts only pairs across them count; pairs within a part have a block of their own.
            near &= (own[:, None] != own[None]) | (own == other)[:, None]
            yield pd.DataFrame({"node": node, "links": near @ copies})

    counted = _block_pairs(member, "component", "n").select("component", "part", "node", "label", "own", "other", "copies", "v")
    links = counted.mapInPandas(count, f"node {kind}, links long").groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.join(comps, "node", "left").join(links, "node", "left")
    found = found.select("label", "k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    found = cut(found)
    # Back to rows; null ids and vectors that are out of it stand alone.
    tagged = valid.select(F.col("id"), "label", "k").join(found, ["label", "k"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(cut(tagged), "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
