"""Conversation prefix trie by MSD radix partitioning over dictionary-encoded turns.

1. Turns (role, text) are encoded: each distinct one, told apart by its SHA-256, gets a number. Only digests, numbers and word counts
   are moved after that.
2. Conversations of equal turns are one class with a weight, so thousands of copies are one sequence. Classes are told apart by their
   length and two 64-bit hashes of (position, turn), which are combined before the shuffle.
3. Radix rounds: in round d the members of each open bucket are dealt by turn d to the bucket's children, which are nodes. A child of
   one class is a chain, and its rows become nodes where they are; a child with at most ``LOCAL`` turns left goes to one task; only larger ones stay open. So
   rounds grow with the depth at which buckets are still large, and hot first turns are aggregated before the shuffle.
4. Tasks finish local buckets by multikey quicksort: classes are parted by the turn at a depth into less, equal and greater; each
   equal part is a node, whose members are parted at the next depth.
5. Sums over subtrees are passed up round by round, from the children of open buckets to their parents.

The ids of a node's own conversations are hashed in order: each range of the sorted ids makes one chunk of text a node, and the chunks
of a node run through one SHA-256 in turn; a task holds one chunk.

Turns are ordered by turn (null first), then role, then the SHA-256 of the turn. Null roles and texts are empty. Rows with a null conv_id belong to
no conversation and are left out. Repeated rows are turns of their own. An empty table gives the root alone, with no member and a
null conv_id. Positions come from a global sort, so a conversation that holds most rows is no task of its own. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, removed, stored
from millrace.llm.mixing import ranked

#: Turns left in a bucket that one task finishes, at most.
LOCAL = 8192
#: Positions of a chain that are summed together.
BLOCK = 4096
#: Characters of a chunk of ids.
CHUNK = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of every turn; positions from 0."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # The length of the role tells (role, text) from any other pair with the same characters.
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = ranked(rows.where("conv is not null"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")).drop("turn", "role")
    starts = order.groupBy("conv").agg(F.min("rank").alias("start"))
    return order.join(starts, "conv").select("conv", (F.col("rank") - F.col("start")).alias("pos"), "digest", "words")


def rebuilt(rows: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv, len) of conversations that begin like the first of their group.

    Conversation c has the first h turns of c - c % ``group``, with h = crc32(c) % ``heads``, then its own after its first h.
    """
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = cut(convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))))
    own = rows.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")).drop("h", "taken")
    # At most ``heads`` - 1 turns of a group's first conversation, for each of its group.
    first = rows.where((F.col("pos") < heads - 1) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "taken"), "base").where("pos < taken").drop("base", "taken")
    return own.unionByName(lent), convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def encoded(rows: DataFrame) -> DataFrame:
    """(conv, pos, tid, words): the digest is replaced by the number of its entry in a dictionary of all distinct turns."""
    entries = cut(rows.select("digest").distinct().withColumn("tid", F.monotonically_increasing_id()))
    return rows.join(entries, "digest").select("conv", "pos", "tid", "words")


def classes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, rep, n) of every conversation: the smallest conversation of equal turns, and how many there are."""
    marks = ("mark1", "mark2")
    own = rows.groupBy("conv").agg(*(F.bit_xor(F.xxhash64("pos", "tid", F.lit(seed))).alias(m) for seed, m in enumerate(marks)))
    marked = cut(convs.join(own, "conv", "left").na.fill(0, list(marks)))
    groups = marked.groupBy("len", *marks).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"))
    return marked.join(groups, ["len", *marks]).select("conv", "rep", "n", "len")


def ends(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): SHA-256 of the decimal ids of each class, ascending and comma-joined."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, 0, [], 0
        out = lambda: pa.RecordBatch.from_pydict({"rep": [now], "first": [first], "ids": [",".join(held)]})
        for batch in batches:
            for rep, conv in zip(batch.column("rep").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if held and (rep != now or size > CHUNK):
                    yield out()
                    held, size = [], 0
                if not held:
                    now, first = rep, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"rep": [now], "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rep == now:
                    state.update(b",")
                else:
                    if state:
                        yield out()
                    now, state = rep, hashlib.sha256()
                state.update(ids.encode())
        if state:
            yield out()

    many = members.where("n > 1").select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    many = many.mapInArrow(chunks, "rep long, first long, ids string").repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids")
    alone = members.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    return alone.unionByName(many.mapInArrow(digests, "rep long, ends_sha256 string"))


def words_after(rows: DataFrame) -> DataFrame:
    """``rows`` (rep, pos, words, ..) with ``after``: the words of all later turns of the class; in blocks, so long ones are divided."""
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    later = lambda *by: _window(*by).rowsBetween(1, _window_end())
    blocks = rows.groupBy("rep", "block").agg(F.sum("words").alias("own"))
    blocks = blocks.select("rep", "block", F.coalesce(F.sum("own").over(later("rep").orderBy("block")), F.lit(0)).alias("beyond"))
    within = F.coalesce(F.sum("words").over(later("rep", "block").orderBy("pos")), F.lit(0))
    return rows.withColumn("after", within).join(blocks, ["rep", "block"]).withColumn("after", F.col("after") + F.col("beyond")).drop("block", "beyond")


def _window(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def _window_end() -> int:
    from pyspark.sql import Window

    return Window.unboundedFollowing


def sort_bucket(bucket: int, depth: int, seqs: list[tuple[int, int, list[int], list[int]]]) -> list[list]:
    """The nodes below the node ``bucket`` at ``depth``, first that node: rows of NODE, by multikey quicksort.

    ``seqs``: (rep, n, turn numbers after depth, their words) of the classes that go on. The top row has no tokens and no end of its own.
    """
    nodes = [[bucket, depth, None, sum(s[1] for s in seqs), 0, 0, 0, None]]
    words, above = [0], [None]
    work = [(seqs, 0, 0)]
    while work:
        part, at, top = work.pop()
        part = [s for s in part if len(s[2]) > at]
        if not part:
            continue
        pivot = part[len(part) // 2][2][at]
        less, equal, greater = [], [], []
        for s in part:
            (less if s[2][at] < pivot else equal if s[2][at] == pivot else greater).append(s)
        work += [(p, at, top) for p in (less, greater) if p]
        node = len(nodes)
        ended = [s[0] for s in equal if len(s[2]) == at + 1]
        nodes.append([min(s[0] for s in equal), depth + at + 1, nodes[top][0], sum(s[1] for s in equal), 0, 0, 0, ended[0] if ended else None])
        words.append(equal[0][3][at])
        above.append(top)
        work.append((equal, at + 1, node))
    # A node follows its parent, so sums are passed up from the last.
    for i in range(len(nodes) - 1, -1, -1):
        row = nodes[i]
        row[5] = row[5] or 1
        row[6] += (row[3] - 1) * words[i]
        if above[i] is not None:
            up = nodes[above[i]]
            up[4] += 1
            up[5] += row[5]
            up[6] += row[6]
    return nodes


def _local_nodes(rows: DataFrame) -> DataFrame:
    """NODE rows of local buckets, with ``top``: whether it stands for the bucket. ``rows``: (bucket, start, rep, n, pos, tid, words)."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, seqs = None, 0, []
        schema = pa.schema([(c.split()[0], pa.int64()) for c in NODE.split(", ")] + [("top", pa.bool_())])

        def out() -> pa.RecordBatch:
            nodes = sort_bucket(now, start, seqs)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*nodes, strict=True)] + [pa.array([i == 0 for i in range(len(nodes))])], schema=schema)

        for batch in batches:
            for bucket, depth, rep, n, tid, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "start", "rep", "n", "tid", "words")), strict=True):
                if bucket != now:
                    if seqs:
                        yield out()
                    now, start, seqs = bucket, depth, []
                if not seqs or seqs[-1][0] != rep:
                    seqs.append((rep, n, [], []))
                seqs[-1][2].append(tid)
                seqs[-1][3].append(words)
        if seqs:
            yield out()

    placed = rows.repartition("bucket").sortWithinPartitions("bucket", "rep", "pos").select("bucket", "start", "rep", "n", "tid", "words")
    return placed.mapInArrow(finish, f"{NODE}, top boolean")


def _sum(c: str) -> Column:
    return F.sum(c).alias(c)


def trie(df: DataFrame, group: int = 20, heads: int = 4, local: int = LOCAL) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations."""
    spark, written = df.sparkSession, []

    def kept(x: DataFrame, name: str) -> DataFrame:
        x, path = stored(x, name)
        written.append(path)
        return x

    original = kept(turns(df), "turns")
    rows, convs = rebuilt(original, group, heads)
    rows = kept(encoded(rows), "encoded")
    members = kept(classes(rows, convs), "members")
    reps = members.where("conv = rep").select("rep", "n", "len")
    seqs = rows.withColumnRenamed("conv", "rep").join(reps.select("rep", "n", "len"), "rep")
    seqs = kept(words_after(seqs).sortWithinPartitions("pos"), "sequences")

    # Round by round: ``open`` has (bucket, rep) of the classes in large nodes at this depth.
    everything = reps.agg(F.min("rep"), F.sum("n"), F.count(F.lit(1)), F.sum("len"), F.max(F.expr("if(len = 0, rep, null)"))).first()
    root, n_convs, n_classes, left, ended = everything
    open_rows = reps.select(F.lit(root).cast("long").alias("bucket"), "rep")
    levels, local_reps, chains, depth = [], [], [], 0
    while n_classes and left:
        at = seqs.where(F.col("pos") == depth).join(open_rows, "rep").select("bucket", "tid", "rep", "n", "len", "words", "after")
        at = kept(at, "digit")
        children = at.groupBy("bucket", "tid").agg(
            F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("classes"), F.sum(F.col("len") - (depth + 1)).alias("left"), F.max("words").alias("words"),
            F.max("after").alias("after"), F.max(F.when(F.col("len") == depth + 1, F.col("rep"))).alias("end"),
        )
        kind = F.when(F.col("classes") == 1, "chain").when(F.col("left") <= local, "local").otherwise("open")
        children = kept(children.withColumn("kind", kind), "children")
        levels.append(children)
        dealt = at.join(children.select("bucket", "tid", F.col("conv_id").alias("child"), "kind"), ["bucket", "tid"]).where(F.col("len") > depth + 1)
        dealt = kept(dealt.select(F.col("child").alias("bucket"), "rep", "kind", F.lit(depth + 1).cast("long").alias("start")), "dealt")
        local_reps.append(dealt.where("kind = 'local'").drop("kind"))
        chains.append(dealt.where("kind = 'chain'").select("rep", "start"))
        open_rows = dealt.where("kind = 'open'").select("bucket", "rep")
        depth += 1
        left = not open_rows.isEmpty()

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    names = [c.split()[0] for c in NODE.split(", ")]
    top_row = (root, 0, None, n_convs or 0, 0, 1, 0, ended)
    if not levels:
        nodes = spark.createDataFrame([top_row], NODE)
    else:
        mine = seqs.join(union(local_reps), "rep").where("pos >= start")
        local_nodes = kept(_local_nodes(mine), "local")
        chain = seqs.join(union(chains), "rep").where("pos >= start")
        saved = (F.col("n") - 1) * (F.col("words") + F.col("after"))
        on_chain = chain.select(
            F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("pos") + 1 < F.col("len"), 1).otherwise(0).alias("n_children"),
            F.lit(1).alias("n_leaves"), saved.alias("saved_tokens"), F.when(F.col("pos") + 1 == F.col("len"), F.col("rep")).alias("end"),
        )
        tops = local_nodes.where("top").select(F.col("conv_id"), "depth", F.col("n_children").alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
        found, below = [local_nodes.where("not top").drop("top"), on_chain], None
        for d in range(len(levels) - 1, -1, -1):
            # What lies below: of a chain by its own words, of a local bucket by its top, of an open one by the round after.
            level = levels[d].withColumn("depth", F.lit(d + 1).cast("long")).join(tops, ["conv_id", "depth"], "left")
            if below is not None:
                level = level.join(below, "conv_id", "left")
            else:
                level = level.withColumns({"cc": F.lit(0), "ll": F.lit(0), "ss": F.lit(0)})
            of = lambda c, cc, chain: F.when(F.col("kind") == "chain", chain).when(F.col("kind") == "local", F.coalesce(c, F.lit(0))).otherwise(F.coalesce(cc, F.lit(0)))
            level = level.select(
                "conv_id", "depth", F.col("bucket").alias("parent_conv_id"), "n_convs", of("c", "cc", F.when(F.col("left") > 0, 1).otherwise(0)).alias("n_children"),
                F.greatest(of("l", "ll", F.lit(1)), F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + of("s", "ss", (F.col("n_convs") - 1) * F.col("after"))).alias("saved_tokens"), "end",
            )
            level = kept(level, "level")
            found.append(level)
            below = level.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("cc"), F.sum("n_leaves").alias("ll"), F.sum("saved_tokens").alias("ss"))
        n_children, n_leaves, total = below.agg(F.sum("cc"), F.sum("ll"), F.sum("ss")).first()
        found.append(spark.createDataFrame([(*top_row[:4], n_children, n_leaves, total, ended)], NODE))
        nodes = union([f.select(*(F.col(c).cast("long") for c in names)) for f in found])

    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(ends(members).withColumnRenamed("rep", "end"), "end", "left").drop("end").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    out = cut(out)
    removed(spark, *written)
    return out


#: CRC-32 of the ASCII digits of an id, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen({0}::VARCHAR)), lambda i: ascii(substr({0}::VARCHAR, (i + 1)::INT, 1))::BIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda v, k: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"


def oracle() -> str:
    """SQL of ``trie``: all prefixes as strings of digests, for tables of moderate size."""
    return rf"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, count(*) AS n FROM t GROUP BY c), v AS (SELECT z.c, z.n, z.c - z.c % 20 AS base, {_CRC.format("z.c")} % 4 AS h FROM z),
u AS (SELECT v.*, least(h, coalesce(b.n, 0)) AS taken FROM v LEFT JOIN z b ON b.c = v.base),
r AS (SELECT u.c, t.pos, t.x, t.w FROM u JOIN t ON t.c = u.base WHERE t.pos < u.taken UNION ALL SELECT u.c, t.pos - u.h + u.taken, t.x, t.w FROM u JOIN t ON t.c = u.c WHERE t.pos >= u.h),
p AS MATERIALIZED (SELECT c, 0 AS depth, '' AS path, '' AS up, 0 AS w FROM z UNION ALL
  SELECT c, pos + 1, sha256(string_agg(x, '') OVER q), coalesce(CASE WHEN pos = 0 THEN '' ELSE sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, ''), w FROM r WINDOW q AS (PARTITION BY c ORDER BY pos)),
e AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
n AS MATERIALIZED (SELECT p.path, p.depth, any_value(p.up) AS up, min(p.c) AS conv_id, count(*) AS n_convs, max(p.w) AS w, coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (p.depth = e.depth), '') AS ids FROM p JOIN e ON e.c = p.c GROUP BY p.path, p.depth),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL), o AS (SELECT n.*, coalesce(k.n, 0) AS kids FROM n LEFT JOIN k ON k.up = n.path AND k.depth = n.depth),
d AS (SELECT DISTINCT a.path, a.depth, b.path AS below, b.depth AS below_depth FROM p a JOIN p b ON b.c = a.c AND b.depth >= a.depth),
s AS (SELECT d.path, d.depth, sum((o.n_convs - 1) * o.w)::BIGINT AS saved, count(*) FILTER (o.kids = 0) AS leaves FROM d JOIN o ON o.path = d.below AND o.depth = d.below_depth GROUP BY d.path, d.depth)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(o.ids) AS ends_sha256
FROM o JOIN s USING (path, depth) LEFT JOIN n u ON o.depth > 0 AND u.path = o.up AND u.depth = o.depth - 1"""
