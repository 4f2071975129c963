"""Vector codes, prefix tries and substring dedup against brute force, and their defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import codes, prefix_trie, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11: vector codes


@pytest.mark.parametrize(("low", "high", "width"), [(-3, 3, 4), (-500, 500, 16), (0, 2, 1), (0, 1, 3)])
def test_tree_finds_the_lowest_of_the_nearest(low, high, width):
    rng = np.random.default_rng(7)
    entries, rows = rng.integers(low, high, (256, width)), rng.integers(low - 2, high + 2, (2000, width))
    found, far = codes.Tree(entries).nearest(rows)
    every = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (far == every.min(1)).all()


def coded(rows):
    """(id, label, q) to (code, error, label_error) by plain rounds."""
    first = {}
    for i, _, q in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, q)
    size = len(rows[0][2]) // 4
    part = lambda q, p: q[p * size : (p + 1) * size]
    books = [[part(q, p) for _, q in sorted(first.items())[:256]] for p in range(4)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for _, _, q in rows:
                own[near(book, part(q, p))[1]].append(part(q, p))
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by = [], Counter()
    for i, label, q in rows:
        hits = [near(books[p], part(q, p)) for p in range(4)]
        error = sum(d for d, _ in hits)
        by[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in hits), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, c, e, by[label], digest) for i, c, e, label in out)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=8).astype("f4")], [None, 0, 1][i % 3]) for i in range(70)]
    good += good[:5] + [(2**53 + 1, [0.5] * 8, 0), (2**53 + 2, [-0.5] * 8, None), (None, [0.25] * 8, 1), (3, [9.0] * 8, 1)]
    bad = [(500, None, 1), (501, [], 1), (502, [1.0] * 7, 1), (503, [1.0] * 4, 1), (-1, [float("nan")] * 8, 1), (-2, [1.0] * 7 + [float("inf")], 0), (-3, [None] + [1.0] * 7, 0)]
    df = spark.createDataFrame(good + bad, VECTORS).selectExpr("*", "1 AS id", "2 AS q", "3 AS of", "4 AS n")
    want = coded([(i, label, [int(np.floor(1024 * x)) for x in v]) for i, v, label in good])
    assert Counter(tuple(r) for r in codes.compressed(df).collect()) == want
    assert Counter(tuple(r) for r in codes.compressed(df.repartition(5)).collect()) == want


def test_codes_of_nothing(spark):
    empty = codes.compressed(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert codes.compressed(spark.createDataFrame([(None, [1.0] * 4, 1), (1, None, 1)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="is not below"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS))


def test_decoded_vectors_have_the_error(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.integers(-400, 400, 8) / 1024], 0) for i in range(600)], VECTORS)
    rows, width = codes.quantised(df)
    books = codes.train(rows, width)
    back = codes.decoded(codes.encode(rows, books), books).join(rows.select("id", "q"), "id").toPandas()
    assert [sum((q - 1024 * v) ** 2 for q, v in zip(r.q, r.vector, strict=True)) for r in back.itertuples()] == list(back.error)
    assert back.error.sum() < ((np.stack(back.q) - np.stack(back.q).mean(0)) ** 2).sum() / 2


# 12: prefix trie


def nodes(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turn = (r or "", x or "")
            by[c].append(((t is not None, t or 0, turn[0], hashlib.sha256(f"{len(turn[0])}:{''.join(turn)}".encode()).digest()), turn))
    own = {c: [b for _, b in sorted(v)] for c, v in by.items()}
    sign = lambda c: 1 if c >= 0 else -1
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - sign(c) * (abs(c) % 20), [])[:h] + v[h:]
    members, kids = defaultdict(list, {(): []}), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = ((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0) + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return Counter((min(m, default=None), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("local", [1, 12, 8192])
@pytest.mark.parametrize("shape", ["few turns", "odd"])
def test_trie_equals_brute_force(spark, shape, local):
    rng, rows = random.Random(3), []
    for c in range(-25, 90):
        if rng.random() < 0.2:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            if shape == "odd":
                rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x y", "z", "", None, "a b c"])))
            else:
                rows.append((c + 10**16, t, rng.choice("ua"), str(rng.randrange(2))))
    rows += [(None, 1, "u", "x")] + rows[:7] + [(10**15 + 1, t, "u", "long") for t in range(40)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS n", "2 AS rep", "3 AS pos", "4 AS bucket", "5 AS depth")
    assert Counter(tuple(r) for r in prefix_trie.trie(df, local=local).select(*COLUMNS).collect()) == nodes(rows)


def test_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "u", f"w {t}") for c in range(0, 4000, 20) for t in range(5)]
    got = {r.depth: r for r in prefix_trie.trie(spark.createDataFrame(rows, TURNS), local=1).collect()}
    assert [(got[d].n_convs, got[d].n_children, got[d].saved_tokens) for d in range(6)] == [(200, 1, 1990), (200, 1, 1990), (200, 1, 1592), (200, 1, 1194), (200, 1, 796), (200, 0, 398)]
    assert got[5].ends_sha256 == hashlib.sha256(",".join(map(str, range(0, 4000, 20))).encode()).hexdigest()
    none = prefix_trie.trie(spark.createDataFrame([], TURNS)).select(*COLUMNS).collect()
    assert [tuple(r) for r in none] == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_long_class_is_summed_in_blocks(spark):
    n = 3 * prefix_trie.BLOCK + 5
    rows = spark.range(n).selectExpr("id div 1 AS turn", "id").crossJoin(spark.createDataFrame([(20,), (40,)], "conv_id long")).selectExpr("conv_id", "turn", "'u' AS role", "concat('w', id, ' x') AS text")
    # Both conversations begin as themselves, so they are one class.
    got = {r.depth: r for r in prefix_trie.trie(rows).collect()}
    assert len(got) == n + 1 and [got[d].saved_tokens for d in (0, 1, 2, n)] == [2 * n, 2 * n, 2 * n - 2, 2]


# 13: substring dedup


def kept(docs):
    """doc_id, words, removed words, digest; ``docs``: (doc_id, text, hash of the text)."""
    words = {((i is None, i or 0), tie): WORD.findall(t or "") for i, t, tie in docs}
    first, gone = {}, {}
    for k in sorted(words):
        w, gone[k] = words[k], set()
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in first:
                gone[k].update(range(p, p + 20))
            else:
                first[tuple(w[p : p + 20])] = k
    out = []
    for i, _, tie in docs:
        k = ((i is None, i or 0), tie)
        out.append((i, len(words[k]), len(gone[k]), hashlib.sha256(" ".join(x for p, x in enumerate(words[k]) if p not in gone[k]).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = lambda n, v=500: [f"w{rng.randrange(v)}" for _ in range(n)]
    base, passage = words(300), words(60)
    out = [" ".join(words(rng.randrange(200))) for _ in range(50)]
    for _ in range(50):
        x = list(base)
        for _ in range(rng.randrange(6)):
            x[rng.randrange(300)] = rng.choice(words(1))
        out.append(" ".join(x))
    out += [" ".join(words(rng.randrange(30)) + passage[rng.randrange(45) :] + words(rng.randrange(30))) for _ in range(40)]
    out += [" ".join(base)] * 20 + [None, "", " \t", " ".join(["a"] * 100), " ".join("ab" * 50), " ".join(["a"] * 19), " ".join(["a"] * 20), "\n".join(words(19)), " ".join(words(200_000, 50_000) + base), "é " * 30]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("ids", ["own", "few"])
def test_repeats_equal_brute_force(spark, texts, ids):
    rng = random.Random(1)
    rows = [(2**53 + i if ids == "own" else rng.choice([None, *range(60)]), t) for i, t in enumerate(texts)]
    rows += rows[:10] if ids == "few" else []
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS tie", "3 AS start", "4 AS kind").repartition(7)
    given = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert Counter(tuple(r) for r in repeats.digest(df).collect()) == kept([tuple(r) for r in given])


def test_small_blocks_give_the_same(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, t string").selectExpr("doc", "0L AS tie", "coalesce(t, '') AS t")
    whole = repeats.met(repeats.scanned(docs.coalesce(1))).collect()
    assert len(whole) and {r.kind for r in whole} == {repeats.REPEAT, repeats.OPEN}
    import pyarrow as pa

    class Frame:
        """Runs a function over Arrow batches here, so the block size can be changed."""

        def __init__(self, batches):
            self.batches = batches

        def select(self, *names):
            return Frame([b.select(names) for b in self.batches])

        def mapInArrow(self, function, _):
            return list(function(iter(self.batches)))

    monkeypatch.setattr(repeats, "BLOCK", 40)
    monkeypatch.setattr(repeats, "SLICE", 64)
    batch = pa.RecordBatch.from_pandas(docs.toPandas(), preserve_index=False)
    rows = [tuple(r.values()) for b in repeats.scanned(Frame([batch])) for r in b.to_pylist()]
    assert len(rows) > 10
    parts = spark.createDataFrame(rows, repeats.ROW)

    def windows(found):
        """Windows known to repeat, and those that are open or known to repeat."""
        sure, either = set(), set()
        for r in found:
            for p in range(r.start, r.start + r.more + 1):
                either.add((r.doc, p))
                if r.kind == repeats.REPEAT:
                    sure.add((r.doc, p))
        return sure, either

    # Blocks decide only which way a repeat is found.
    assert windows(repeats.met(parts).collect())[1] == windows(whole)[1]


def test_spans_texts_and_edges(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a b {passage} c", "x"), (2, f"d {passage} e  f", "y"), (3, "short  text", "z"), (4, f"{passage} {passage}", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, repeats.spans(df).collect())) == [(2, 1, 31), (4, 0, 60)]
    out = repeats.deduplicated(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "d e f", 3: "short  text", 4: ""}
    assert repeats.digest(df.limit(0)).count() == 0 and repeats.spans(df.limit(0)).count() == 0
