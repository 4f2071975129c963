"""Folds over ordered rows of a key, for keys of any size: positions, greedy groups under a budget, greedy leaders.

A key that holds most rows is no task of its own. Rows are sorted once over all keys, so positions come from counts by partition; a key's rows are
then cut into blocks by position, and blocks are what tasks work on.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import removed, stored, wide

#: Rows of a key that are decided in order by one task, and rows of a block.
PREFIX, BLOCK = 2000, 20_000


def digest(*columns: Column | str) -> Column:
    """32 bytes that tell rows of different values apart, nulls included."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))


def positions(df: DataFrame, keys: list[str], order: list, name: str = "position") -> tuple[DataFrame, str]:
    """``df`` with ``name``: the place of a row within its key, from 1 (long); and the path of the table that holds the rows."""
    spark = df.sparkSession
    rows, path = stored(df.sort(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "positions")
    # A row a partition: the ranks that it begins with.
    starts, before = [], 0
    for part, n, first in sorted(tuple(r) for r in rows.groupBy("_part").agg(F.count(F.lit(1)), F.min("_row")).collect()):
        starts.append((part, before - first))
        before += n
    shifts = F.broadcast(spark.createDataFrame(starts, "_part int, _shift long"))
    ranked = rows.join(shifts, "_part").withColumn("_rank", F.col("_row") + F.col("_shift"))
    firsts = ranked.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_rank").alias("_first"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = ranked.join(wide(firsts), on).withColumn(name, F.col("_rank") - F.col("_first") + 1)
    return placed.drop("_part", "_row", "_shift", "_rank", "_first", *(f"_k{i}" for i in range(len(keys)))), path


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[dict]]:
    """Rows of equal ``by``, which come together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# Greedy groups


def _next(sums: np.ndarray, opens: np.ndarray, most: int) -> np.ndarray:
    """For each row as the first of a group, the first row of the group after it; the number of rows if it reaches the end."""
    n = len(opens)
    fits = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    fits = np.maximum(fits, np.arange(n) + 1)
    change = np.append(np.where(opens, np.arange(n), n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    return np.minimum(fits, change[1:])


def _chains(sums: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as the first of a group: groups from there to the end, and the size of the last."""
    n = len(following)
    count, last = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in range(n - 1, -1, -1):
        j = following[i]
        count[i], last[i] = (1, sums[n] - sums[i]) if j == n else (count[j] + 1, last[j])
    return count, last


def greedy_groups(df: DataFrame, keys: list[str], order: list, same: Column, size: Column, most: int, block: int = BLOCK) -> DataFrame:
    """``df`` with ``position`` and ``group_no`` from 1: a group ends when ``same`` changes or the next row would pass ``most``.

    Whether a row opens a group depends on all rows before it, but on little of them: the open group's size. So a block of rows is a step
    function from the size it finds to the first row that opens a group, the groups in the block and the size it leaves. Blocks are
    summed up so side by side, the functions of a key's blocks are applied in turn, a few numbers each, and blocks are then numbered side by side.
    """
    spark = df.sparkSession
    rows, path = positions(df, keys, order)
    rows = rows.withColumn("_group", digest(*keys))
    slim = rows.select("_group", "position", digest(same.alias("same")).alias("_same"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"))
    slim, slim_path = stored(slim.withColumn("_block", F.floor((F.col("position") - 1) / block)), "sizes")
    dealt = slim.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "position").select("_group", "_block", "position", "_same", "_size")

    def arrays(held: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate([[0], np.cumsum([r["_size"] for r in held], dtype="i8")])
        opens = np.array([i > 0 and r["_same"] != held[i - 1]["_same"] for i, r in enumerate(held)])
        return sums, opens

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, ["_group", "_block"]):
            sums, opens = arrays(held)
            count, last = _chains(sums, _next(sums, opens, most))
            # Rows that may be the first to open a group: up to a change or to a size that no open group leaves room for.
            change = int(opens.argmax()) if opens.any() else len(held)
            end = min(change, int(np.searchsorted(sums[1:], most, "right")), len(held) - 1)
            firsts = [i for i in range(end + 1) if i == 0 or i == change or sums[i + 1] > sums[i]]
            yield pa.RecordBatch.from_pylist([{
                "_group": held[0]["_group"], "_block": held[0]["_block"], "enters": held[0]["_same"], "leaves": held[-1]["_same"], "total": int(sums[-1]), "change": change,
                "first": firsts, "upto": [int(sums[i + 1]) for i in firsts], "count": count[firsts].tolist(), "last": last[firsts].tolist(),
            }], schema=pa.schema([("_group", pa.binary()), ("_block", pa.int64()), ("enters", pa.binary()), ("leaves", pa.binary()), ("total", pa.int64()), ("change", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("first", "upto", "count", "last"))]))

    summary = "_group binary, _block long, enters binary, leaves binary, total long, change long, first array<long>, upto array<long>, count array<long>, last array<long>"

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the row that opens its first group, and the groups before it."""
        now, inside, open_size, groups = None, None, 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_group"] != now:
                    now, inside, open_size, groups = r["_group"], None, 0, 0
                if groups == 0 or r["enters"] != inside:
                    at = 0
                else:
                    at = next((i for i, (f, s) in enumerate(zip(r["first"], r["upto"], strict=True)) if open_size + s > most or f == r["change"]), None)
                out.append({"_group": now, "_block": r["_block"], "first": None if at is None else r["first"][at], "before": groups})
                if at is None:
                    open_size += r["total"]
                else:
                    groups, open_size = groups + r["count"][at], r["last"][at]
                inside = r["leaves"]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_group", pa.binary()), ("_block", pa.int64()), ("first", pa.int64()), ("before", pa.int64())]))

    entries = dealt.mapInArrow(steps, summary).repartition("_group").sortWithinPartitions("_group", "_block").mapInArrow(applied, "_group binary, _block long, first long, before long")
    # A block's entry comes before its rows.
    entry = entries.select("_group", "_block", F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("_same"), F.lit(0).cast("long").alias("_size"), "first", "before")
    both = slim.withColumns({"first": F.lit(None).cast("long"), "before": F.lit(None).cast("long")}).unionByName(entry)
    both = both.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "position").select("_group", "_block", "position", "_same", "_size", "first", "before")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches, ["_group", "_block"]):
            head, held = held[0], held[1:]
            sums, opens = arrays(held)
            starts = np.zeros(len(held), bool)
            following, at = _next(sums, opens, most), head["first"]
            while at is not None and at < len(held):
                starts[at] = True
                at = following[at]
            yield pa.RecordBatch.from_arrays([pa.array([r["_group"] for r in held], pa.binary()), pa.array([r["position"] for r in held], pa.int64()), pa.array(head["before"] + np.cumsum(starts, dtype="i8"))], names=["_group", "position", "group_no"])

    numbers = both.mapInArrow(numbered, "_group binary, position long, group_no long")
    out, _ = stored(rows.join(wide(numbers), ["_group", "position"]).drop("_group"), "groups")
    removed(spark, path, slim_path)
    return out


# Greedy leaders


@dataclass(frozen=True)
class Rule:
    """One way in which two rows are the same: equal columns, none of them null, and, where given, ranges (low, high) at most ``gap`` apart
    or sets with at least such a Jaccard similarity (two empty ones have 1)."""

    equal: tuple[str, ...]
    near: tuple[str, str, int] | None = None
    alike: tuple[str, float] | None = None

    @property
    def fields(self) -> list[str]:
        return [*self.equal, *(self.near[:2] if self.near else ()), *(self.alike[:1] if self.alike else ())]


class Leaders:
    """Leaders in order, found by rule: a table by equal columns, and there arrays of ranges or lists of leaders by token."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.tables: list[dict] = [{} for _ in rules]
        self.positions: list[int] = []

    def add(self, row: dict) -> None:
        number = len(self.positions)
        self.positions.append(row["position"])
        for rule, table in zip(self.rules, self.tables, strict=True):
            key = tuple(row[c] for c in rule.equal)
            if None in key:
                continue
            if rule.near:
                low, high = row[rule.near[0]], row[rule.near[1]]
                if low is not None and high is not None:
                    ranges = table.setdefault(key, [np.zeros((8, 3), "i8"), 0])
                    if ranges[1] == len(ranges[0]):
                        ranges[0] = np.concatenate([ranges[0], np.zeros_like(ranges[0])])
                    ranges[0][ranges[1]] = low, high, number
                    ranges[1] += 1
            elif rule.alike:
                if row[rule.alike[0]] is not None:
                    tokens = set(row[rule.alike[0]])
                    by = table.setdefault(key, (defaultdict(list), {}))
                    by[1][number] = len(tokens)
                    for t in tokens or {None}:
                        by[0][t].append(number)
            else:
                table.setdefault(key, number)

    def find(self, row: dict) -> int | None:
        """Position of the first leader that is the same as ``row``."""
        best = len(self.positions)
        for rule, table in zip(self.rules, self.tables, strict=True):
            found = table.get(tuple(row[c] for c in rule.equal))
            if found is None:
                continue
            if rule.near:
                low, high, gap = row[rule.near[0]], row[rule.near[1]], rule.near[2]
                if low is not None and high is not None:
                    r = found[0][: found[1]]
                    hit = (r[:, 0] - gap <= high) & (r[:, 1] + gap >= low)
                    at = int(hit.argmax())
                    if hit[at]:
                        best = min(best, int(r[at, 2]))
            elif rule.alike:
                if row[rule.alike[0]] is not None:
                    best = min(best, self._alike(found, set(row[rule.alike[0]]), rule.alike[1], best))
            else:
                best = min(best, found)
        return self.positions[best] if best < len(self.positions) else None

    @staticmethod
    def _alike(found: tuple, tokens: set, least: float, best: int) -> int:
        by, sizes = found
        if not tokens:
            return min(by.get(None, [best]))
        shared: dict[int, int] = defaultdict(int)
        for t in tokens:
            for number in by.get(t, ()):
                shared[number] += 1
        return min((n for n, k in shared.items() if n < best and k / (len(tokens) + sizes[n] - k) >= least), default=best)


def leaders(df: DataFrame, keys: list[str], order: list, rules: tuple[Rule, ...], prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """``df`` with ``position`` within ``keys`` by ``order`` and ``leader``: the position of the first earlier leader that a row is the same as, or its own.

    A row is a leader unless it is the same as an earlier leader: the first independent set in this order. Rows of equal features have
    one leader, so only distinct features are decided. In a round, one task decides the first ``prefix`` undecided rows of a key in order, with an
    index of the leaders; the key's other rows are cut into blocks, which meet these leaders side by side. What is left goes into
    the next round. So a round's leaders precede all that is left, and rounds of a key grow with its leaders, not its rows.
    """
    spark = df.sparkSession
    fields = list(dict.fromkeys(f for rule in rules for f in rule.fields))
    rows, path = positions(df, keys, order)
    rows = rows.withColumn("_group", digest(*keys)).withColumn("_feature", digest(*keys, *fields))
    tables = [path]

    def kept(x: DataFrame, name: str) -> DataFrame:
        x, where = stored(x, name)
        tables.append(where)
        return x

    undecided = rows.groupBy("_feature").agg(F.min("position").alias("position"), *(F.first(c).alias(c) for c in ("_group", *fields)))
    undecided = kept(undecided, "features").withColumn("_at", F.col("position"))
    schema = undecided.select("_group", "_feature", "position", *fields).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names = schema.fieldNames()

    def given(held: list[dict], leader: list[int | None], like: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([r[n] for r in held], like.field(n).type) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(leader, pa.int64())], names=[*names, "leader"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal like
            for batch in batches:
                like = batch.schema
                yield batch

        for held in _runs(watched(), ["_group"]):
            index, leader = Leaders(rules), []
            for row in held:
                found = index.find(row)
                if found is None:
                    index.add(row)
                    found = row["position"]
                leader.append(found)
            yield given(held, leader, like)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            out, leader = [], []
            for row in batch.to_pylist():
                if (row["_group"], row["_block"]) != now:
                    now, index = (row["_group"], row["_block"]), Leaders(rules)
                if row["_rest"] == 0:
                    index.add(row)
                else:
                    out.append(row)
                    leader.append(index.find(row))
            yield given(out, leader, batch.schema)

    decided = []
    while True:
        first, rest = undecided.where(F.col("_at") <= prefix), undecided.where(F.col("_at") > prefix)
        placed = first.repartition("_group").sortWithinPartitions("_group", "position").select(*names)
        done = kept(placed.mapInArrow(decide, f"{ddl}, leader long"), "decided")
        decided.append(done)
        if rest.isEmpty():
            break
        rest = rest.withColumn("_block", F.floor(F.col("_at") / block))
        blocks = rest.select("_group", "_block").distinct()
        # Each block gets the round's leaders of its key: at most ``prefix`` rows beside ``block``.
        told = done.where("leader = position").drop("leader").join(blocks, "_group").withColumn("_rest", F.lit(0))
        both = told.unionByName(rest.drop("_at").withColumn("_rest", F.lit(1)))
        both = both.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_rest", "position").select(*names, "_block", "_rest")
        met = kept(both.mapInArrow(meet, f"{ddl}, leader long"), "met")
        decided.append(met.where("leader is not null"))
        left = met.where("leader is null").drop("leader")
        if left.isEmpty():
            break
        undecided, path = positions(left, ["_group"], ["position"], "_at")
        tables.append(path)
    every = decided[0].select("_feature", "leader")
    for part in decided[1:]:
        every = every.unionByName(part.select("_feature", "leader"))
    out = rows.join(wide(every), "_feature").drop("_feature", "_group")
    out, _ = stored(out, "leaders")
    removed(spark, *tables)
    return out
