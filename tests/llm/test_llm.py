"""The training-data operators against brute force, exact round trips and their defined edge cases."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from oracle import check
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, line_dedup, mixing, ngram_join, packing, queries, secrets, tokencount, toxicity, vector_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0, extra=False):
    rows = [(start + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # Names that helpers might use.
    return df.selectExpr("*", "1 AS id", "'x' AS t", "2 AS size", "'y' AS a", "3 AS component", "4 AS rank", "'z' AS label") if extra else df


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary):03d}{'x' * rng.randrange(4)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], DATA)


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (1, 2), (2, 1), (9, 7), (7, 8)]])
def test_components(spark, links):
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])


# 1: archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_round_trip(spark):
    rows = [(3, "http://a b/\n", "x"), (1, "http://c", "x"), (2, None, None), (4, "//odd", ""), (7, "http://d", "é\r\n\r\nWARC/1.0\r\n"), (None, "u", "x"), (1, "http://c", "x")]
    out = warc.round_trip(pages(spark, rows).selectExpr("*", "1 AS digest", "2 AS first")).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    assert [(r.record_type, r.refers_to) for r in by[1]] == [("response", None)] * 2
    assert (by[3][0].record_type, by[3][0].refers_to) == ("revisit", 1) and (by[None][0].record_type, by[None][0].refers_to) == ("revisit", 1)
    assert (by[2][0].record_type, by[4][0].refers_to, by[2][0].payload_bytes) == ("response", 2, 0)
    assert by[7][0].payload_digest == base64.b32encode(hashlib.sha1("é\r\n\r\nWARC/1.0\r\n".encode()).digest()).decode()
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_both_arc_versions_and_gzip_members(spark):
    record = lambda v, url, body, mime="text/html": warc.arc_header(v, url, "1.2.3.4", "2004010203", mime, len(body)) + body + b"\n"
    files = []
    for v in (1, 2):
        parts = [warc.arc_version_block(v, f"f{v}.arc", "20040101000000"), record(v, "http://x/a b", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"), record(v, "dns:x", b"1.2.3.4", "text/dns"), b"broken line\n", record(v, "http://y", b"plain", "text/plain; charset=x")]
        files += [(f"f{v}", b"".join(parts)), (f"g{v}", b"".join(map(gzip.compress, parts)))]
    out = warc.convert_archives(spark.createDataFrame(files, "path string, content binary")).collect()
    types = defaultdict(list)
    for r in out:
        types[r.path].append(r.record_type)
        assert r.date.startswith("2004-01-0") and r.date.endswith("Z")
    assert set(map(tuple, types.values())) == {("warcinfo", "response", "resource", "resource")}
    one = next(warc.read_warc(io.BytesIO(next(r.record for r in out if r.record_type == "response"))))
    assert one.payload == b"hello" and one.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    assert next(r.date for r in out if r.record_type == "response") == "2004-01-02T03:00:00Z"


# 2: mixing


def test_mix_keeps_words_and_caps(spark):
    rng = random.Random(1)
    d = docs(spark, [" ".join(words(rng, rng.randrange(0, 60))) for _ in range(300)] + [None, "", " \t\n"]).withColumn("source", F.when(F.col("doc_id") % 10 == 9, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    out = mixing.digest(d).toPandas()
    src = out.merge(d.toPandas()[["doc_id", "source"]], on="doc_id").fillna({"source": "￿"})
    by = src.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all() and (out.taken <= 2 * out["size"]).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert by.target.sum() == pytest.approx(1.5 * by["size"].sum())
    # Water filling by hand.
    left, level = dict(zip(by.index, [3, 1, 2, 3, 1], strict=True)), {}
    total = 1.5 * by["size"].sum()
    while True:
        unit = (total - sum(level.values())) / sum(left.values())
        full = [s for s, w in left.items() if w * unit > 2 * by["size"][s]]
        if not full:
            break
        for s in full:
            level[s] = 2 * by["size"][s]
            del left[s]
    want = level | {s: w * unit for s, w in left.items()}
    assert by.target.to_dict() == pytest.approx(want)
    again = mixing.digest(d.repartition(5)).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_mix_edges(spark):
    assert mixing.digest(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.digest(docs(spark, [None, ""])).collect()] == [0, 0]
    d = docs(spark, ["a b c d"] * 9, extra=True)
    out = mixing.mix_rows(d.unionByName(d))
    assert out.columns == d.columns and 20 <= out.count() <= 34


def test_duel_conserves_words_and_expectations():
    rng = np.random.default_rng(4)
    hits = np.zeros(6)
    for trial in range(2000):
        rows = pd.DataFrame({"size": [5, 9, 1, 3, 7, 2], "p": [0.3, 0.6, 0.5, 0.9, 0.2, 0.7], "_mix_key": rng.integers(-(2**63), 2**63 - 1, 6), "open": True, "i": range(6)})
        out = mixing.duel(rows).sort_values("i")
        assert (out["p"] * out["size"]).sum() == pytest.approx((rows["p"] * rows["size"]).sum()) and out["open"].sum() <= 1
        hits += out["p"].to_numpy()
    assert hits / 2000 == pytest.approx([0.3, 0.6, 0.5, 0.9, 0.2, 0.7], abs=0.05)


def test_rank_is_global(spark):
    d = spark.range(100).repartition(7).selectExpr("(id * 37) % 101 AS v")
    got = sorted((r.v, r["rank"]) for r in mixing.ranked(d, "v").collect())
    assert [r for _, r in got] == list(range(100))


# 3: vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).astype("f4").tolist(), label))
                i += 1
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] * 16, 0), (i + 3, [float("inf")] * 16, 1), (i + 4, [1.0], 1), (i + 5, [None] * 16, 0), (i + 6, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in vector_dedup.near_duplicates(d.selectExpr("*", "1 AS node", "2 AS id")).collect()}
    good = [(n, np.array(v, "f8") / np.linalg.norm(np.array(v, "f8")), c) for n, v, c in rows[:i] if c is not None]
    links = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[:k] if p == q and x @ y >= 0.98]
    want = components([r[0] for r in rows], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(out) == len(rows)
    assert {n: (r.n_links, r.component_id, r.kept) for n, r in out.items()} == {n: (degree[n], c, n == c) for n, c in want.items()}


def test_vectors_of_one_dense_group(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(n, (base + rng.normal(size=32) * 0.05).astype("f4").tolist(), 1) for n in range(700)] + [(1000 + n, base.tolist(), 1) for n in range(50)]
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    m = np.array([r[1] for r in rows], "f4").astype("f8")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    degree = (m @ m.T >= 0.98).sum(1) - 1
    assert out.set_index("vec_id").n_links.reindex([r[0] for r in rows]).tolist() == degree.tolist() and out.kept.sum() == 1
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 4: toxicity


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(6)
    bad = ["vilex", "grubbo", "snarfy"]
    texts, labels = [], []
    for n in range(500):
        w = words(rng, rng.randrange(5, 40))
        toxic = n % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "."]))
        texts.append(" ".join(w))
        labels.append((n, int(toxic)))
    d = docs(spark, [*texts, None, ""], extra=True)
    lab = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.digest(d, lab).toPandas().set_index("doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.index]).all()
    held = out[out.held_out & (out.index < 500)]
    truth = np.array([i % 3 == 0 for i in held.index])
    assert (held.predicted[truth] == 1).mean() > 0.9 and (held.predicted[~truth] == 1).mean() < 0.05
    assert out.score.between(0, 1).all() and out.score[500] == out.score[501] and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_calibrates_on_all_rows_that_are_not_trained_on(spark, monkeypatch):
    seen = []
    count = toxicity._histogram
    monkeypatch.setattr(toxicity, "_histogram", lambda *a: seen.append(count(*a)) or seen[-1])
    rng, texts = random.Random(9), []
    for n in range(300):
        w = words(rng, 12) * (1 if n % 10 else 500)
        texts.append(" ".join([*w, "vilex"] if n % 3 == 0 else w))
    d = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 30, "de").otherwise("en"))
    model = toxicity.train(d, spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(300)], "doc_id long, toxic int"), sample=40)
    usable = sum(zlib.crc32(str(n).encode()) % 5 != 0 for n in range(300))
    # At most 80 rows are sampled, a quarter of these or so aren't trained on.
    assert usable - 62 <= seen[0][["pos", "neg"]].sum().sum() < usable
    assert len(seen) == 1 and set(model.thresholds) == {"de", "en"}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.digest(docs(spark, ["a", None]), none).collect()} == {0.0}
    assert toxicity.digest(docs(spark, []), none).count() == 0


def test_slices_of_a_long_text_score_as_the_whole():
    model = toxicity.fit(["a b bad", "a b c", "x bad y", "q r"], [1, 0, 1, 0], epochs=3)
    scorer = toxicity.Scorer(model)
    text = " ".join(f"w{i % 50}" for i in range(toxicity.SLICE * 2 + 5)) + " bad"
    words_ = text.split()
    scorer._learn(words_)
    ids = np.array([*(scorer.index[w] for w in words_), 0, 0])
    assert scorer.logit(text) == pytest.approx(model.logit(model.pooled(scorer.parts[ids])[0]), rel=1e-5)


# 5: lines


def _similar(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1] <= 0.2 * max(len(a), len(b)) + 1e-9


def test_lines_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    lines = [" ".join(words(rng, 12, 5000)) for _ in range(60)]
    texts = []
    for n in range(40):
        own = [lines[rng.randrange(60)] for _ in range(3)]
        own += [re.sub("w", "v", lines[n], count=1), "short one", lines[n].upper() + " "]
        texts.append("\n".join(own))
    out = {r.doc_id: r for r in line_dedup.digest(docs(spark, [*texts, None, ""], extra=True)).collect()}
    normal = lambda t: " ".join(t.lower().split())
    kept, seen = [], {}
    for n, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if len(line.split()) < 5:
                assert k not in out[n].dropped
            elif k not in out[n].dropped:
                kept.append(normal(line))
            seen.setdefault(normal(line), (n, k))
    assert len(kept) == len(set(kept))
    pairs = sum(_similar(a, b) for i, a in enumerate(kept) for b in kept[:i])
    variants = sum(_similar(a, b) for i, a in enumerate(seen) for b in list(seen)[:i] if len(a.split()) > 4 and len(b.split()) > 4)
    assert pairs <= 0.1 * variants  # recall of links at this length of line
    # One occurrence of every group stays: each dropped line has a kept one like it, by links.
    links = [(a, b) for a in seen for b in seen if a < b and _similar(a, b)]
    comp = components(list(seen), links)
    assert {comp[k] for k in kept} == {comp[k] for k in seen if len(k.split()) >= 5}
    assert (out[40].n_lines, out[40].n_dropped, out[41].n_lines) == (1, 0, 1)


def test_lines_edges(spark):
    same = "one two three four five six seven"
    d = docs(spark, [same, same, f"{same}\n{same}", "- - - - - - -", "+ + + + + + +", None], extra=True)
    out = {r.doc_id: r.dropped for r in line_dedup.digest(d).collect()}
    assert out == {0: [], 1: [0], 2: [0, 1], 3: [], 4: [], 5: []}
    text = {r.doc_id: r.text for r in line_dedup.dedup(d).collect()}
    assert line_dedup.dedup(d).columns == d.columns and text[2] == "" and text[0] == same and text[5] is None
    assert line_dedup.digest(docs(spark, [])).count() == 0
    long = " ".join(f"word{i}" for i in range(15_000))
    assert sorted(r.n_dropped for r in line_dedup.digest(docs(spark, [long, long + " tail", "the " * 20_000])).collect()) == [0, 0, 1]


def test_short_copies_go_in_the_query(spark, tmp_path):
    texts = ["Les.\nunspacedscript", "les. \n\nUnspacedScript", "\nmore Les.", "one two three four\nles."]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.dropped for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == {0: [], 1: [0, 2], 2: [], 3: [1]}


def test_lines_of_thousands_of_words_meet(spark):
    rng = random.Random(12)
    texts = []
    for n in (5_995, 11_990):
        line = " ".join(f"{rng.randrange(10**6):06d}" for _ in range(n))
        texts += [line, line + " ten more words than this one had at the end"]
    assert [r.n_dropped for r in line_dedup.digest(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 0, 1]


def _misspelt(rng, line, n):
    out = line.split()
    for k in rng.sample(range(len(out)), n):
        at = rng.randrange(len(out[k]))
        out[k] = out[k][:at] + rng.choice("QXZ").lower() + out[k][at + 1 :]
    return " ".join(out)


@pytest.mark.parametrize("cases", [[(6, 1), (8, 1), (10, 1), (30, 3), (30, 5), (60, 10)], [(90, 30)]])
def test_lines_with_misspelt_words_meet(spark, cases):
    rng, lines = random.Random(11), []
    for n, typos in cases:
        for _ in range(30):
            line = " ".join(words(rng, n, 900))
            lines.append((n, typos, line, _misspelt(rng, line, typos)))
    out = {r.doc_id: r.n_dropped for r in line_dedup.digest(docs(spark, [x for row in lines for x in row[2:]])).collect()}
    for n, typos in cases:
        found = [out[2 * k + 1] for k, row in enumerate(lines) if row[:2] == (n, typos)]
        assert sum(found) >= 0.95 * len(found), (n, typos)


# 6: packing


def test_packing_is_lossless_and_tight(spark):
    import public_tokenizers

    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(80)] + ["a  b\n\nc ", " x", "é🙂<|endoftext|>", None, "", "z" * 50_000]
    out = packing.pack(docs(spark, texts, extra=True), width=256, group=20_000).toPandas()
    assert packing.unpack(out, public_tokenizers.path(packing.VOCABULARY)) == {i: t for i, t in enumerate(texts) if t}
    for r in out.itertuples():
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
        assert pos[: r.n_tokens].tolist() == [k for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True) for k in range(b - a)]
    assert out.n_tokens.sum() > 0.9 * 256 * len(out)
    assert packing.pack(docs(spark, [])).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = random.Random(10)
    for _ in range(50):
        width, lengths = 64, [rng.randrange(1, 65) for _ in range(rng.randrange(60))]
        rows, room = [], []
        for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
            fit = [r for r in room if r >= lengths[p]]
            if fit:
                room[room.index(min(fit))] -= lengths[p]
            else:
                room.append(width - lengths[p])
        rows = packing.best_fit_decreasing(lengths, width)
        assert sorted(width - sum(lengths[p] for p in r) for r in rows) == sorted(room)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))


# 7: n-gram join


def brute_jaccard(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {i: len(s) for i, s in sets.items()}, components(list(sets), links)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join_equals_all_pairs(spark, n, percent):
    rng = random.Random(11)
    shared = words(rng, 12)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randrange(3, 90)) + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += ["A b", "a  B", "É x", "é x", None, "", " \n", "one", "x " * 5000]
    sizes, comp = brute_jaccard(texts, n, percent)
    out = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, texts, extra=True), words=n, percent=percent).collect()}
    assert {i: r.n_shingles for i, r in out.items()} == sizes
    assert {i: r.component_id for i, r in out.items()} == comp


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(12)
    size = rng.integers(20, 60, 400)
    bits = np.zeros((400, ngram_join.BITS), bool)
    for i in range(400):
        bits[i, rng.integers(0, 300, size[i])] = True
        if i % 3 == 0 and i:
            bits[i], size[i] = bits[i - 1], size[i - 1]
    packed = np.packbits(bits, axis=1).view("u8")
    spare, comp = size - bits.sum(1), rng.integers(0, 300, 400)
    group = rng.integers(0, 3, 400)
    group[:40] = np.arange(40) // 2 + 10  # groups of two beside large ones
    shared = (bits[:, None] & bits[None]).sum(-1)
    for side in (np.full(400, -1), rng.integers(0, 2, 400)):
        i, j, common = ngram_join.tree_join(group, side, size, packed, spare, comp, 85)
        got = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
        most = np.minimum(np.minimum(size[:, None], size[None]), shared + np.minimum(spare[:, None], spare[None]))
        ok = (most * 185 >= 85 * (size[:, None] + size[None])) & (100 * np.minimum(size[:, None], size[None]) >= 85 * np.maximum(size[:, None], size[None]))
        ok &= (comp[:, None] != comp[None]) & (group[:, None] == group[None])
        want = {(i, j) for i, j in np.argwhere(np.triu(ok, 1)).tolist() if side[i] < 0 or side[i] != side[j]}
        assert got == want and len(i) == len(want) > 20 and (common == shared[i, j]).all()


def test_trees_alone_find_the_same_links(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(30):
        base = words(rng, rng.randrange(10, 60))
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            texts.append(" ".join(w))
    _, comp = brute_jaccard(texts, 4, 85)
    for settle in (True, False):
        assert {r.doc_id: r.component_id for r in ngram_join.jaccard_join(docs(spark, texts), settle=settle).collect()} == comp


def test_ngram_join_links_the_texts_of_one_id(spark):
    rng = random.Random(22)
    a, b, c = (" ".join(words(rng, 30)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (4, None), (5, c + " x"), (None, a)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    out = defaultdict(set)
    for r in ngram_join.jaccard_join(d).collect():
        out[r.doc_id].add(r.component_id)
    assert out == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, None: {None}}


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_join(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e f", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(d).orderBy("n_shingles").collect()] == [(0, None), (3, None)]
    d = docs(spark, ["a b c d e f", "a b c d e f", "q", None, None], extra=True)
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]


# 8: secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token)|(?i:api)_?(?i:key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(x[2] for x in sorted(out))


def brute_entropy(value, bits):
    from math import log2

    best = 0
    for i in range(len(value) - 19):
        w = value[i : i + 20]
        best = max(best, -sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w)))
    return best >= bits - 1e-5


def test_secrets_against_a_plain_scan(spark):
    rng = random.Random(13)
    parts = ["Token = ", "passWord:'", "api_key=", '"', " ", "é🙂\n", "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef01", "secret", "=", "x1y2z3A4b5C6d7E8f9G0h1", "short", "token: password: abcdefghijklmnop", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(150)] + [None, "", "a" * 100_000]
    out = {r.doc_id: r for r in secrets.digest(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in out[i].spans.split(",") if s and not s.startswith("entropy")] == [s for s in want.split(",") if s] and (out[i].n_assign, out[i].n_hex) == (want.count("assign"), want.count("hex"))
    assert secrets.digest(docs(spark, [])).count() == 0


def test_entropy_windows(spark):
    rng = random.Random(14)
    letters = secrets.MIXED_CHARS[:62]
    values = ["".join(rng.choice(letters[: rng.choice([8, 14, 20, 62])]) for _ in range(rng.randrange(20, 45))) for _ in range(60)]
    values += ["0123456789abcdefghij", "Example9" * 4, "123E4567-e89b-12d3-a456-42661417400Z"[:36]]
    out = {r.doc_id: r.n_entropy for r in secrets.digest(docs(spark, [f"({v})" for v in values])).collect()}
    for i, v in enumerate(values):
        hexed = re.fullmatch("[0-9a-fA-F]+", v)
        free = not brute_base(v) and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(secrets.ALLOW, v.lower()) and not re.match(secrets.UUID, v)
        assert out[i] == int(bool(free) and brute_entropy(v, 3.0 if hexed else 3.7)), v
    check(secrets.digest(docs(spark, [f"({v})" for v in values])), secrets.oracle().replace("FROM documents", f"FROM (SELECT unnest({list(range(len(values)))}) AS doc_id, unnest({[f'({v})' for v in values]}) AS text)"), DATA)


# 9: decontamination


def nearest(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, e in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return min(prev)


def test_decontamination_against_plain_distance(spark, monkeypatch):
    rng = random.Random(15)
    items = [(i, "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(5, 90)))) for i in range(25)] + [(100, None), (101, " "), (102, "Zz\tZz")]
    texts = []
    for _ in range(120):
        y = list(rng.choice(items[:25])[1])
        for _ in range(rng.randrange(0, max(1, len(y) // 7))):
            j = rng.randrange(len(y))
            y[j : j + rng.randrange(2)] = rng.choice(["", "x", "yy"])
        texts.append("".join(rng.choice("abcdefg \n") for _ in range(40)) + "".join(y).upper() + "".join(rng.choice("abcdefg ") for _ in range(40)))
    texts += [None, "", "zz  zz"]
    want = {}
    for i, t in enumerate(texts):
        for n, item in items:
            p = decontaminate.fold(item)
            if p and t and (d := nearest(p, decontaminate.fold(t))) <= int(len(p) * 0.1):
                want[i, n] = d
    b = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs(spark, texts, extra=True), b).collect()}
    assert found() == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert found() == want
    left = {r.doc_id for r in decontaminate.clean(docs(spark, texts), b).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.matches(docs(spark, []), b).count() == 0 and decontaminate.clean(docs(spark, ["a"]), b.where("false")).count() == 1


# 10: token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokencount.vocabulary_path())
    rng = random.Random(16)
    parts = [*"aB'sZ \t\n\r　\x1c\x85\x0b\x0cé́İΣßﬁ1²٣中🙂_-.̸=‍", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", "word "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "ab " * 3000]
    out = {r.doc_id: r for r in tokencount.token_counts(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 2048)
    assert tokencount.token_counts(docs(spark, [])).count() == 0


# ids beside nulls, for all operators


FAR = 2**60 + 1


def test_ids_stay_exact_beside_nulls(spark):
    """Neighbouring ids above 2 ** 53 are one number in floating point, which a null beside them asks pandas for."""
    ids = [FAR, FAR + 2, None, 5]
    long = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(i, f"{long} {n}", "en", "s", 1) for n, i in enumerate(ids)], DOCS).coalesce(1)
    far = lambda rows, c="doc_id": sorted((r[c] for r in rows), key=lambda x: (x is None, x))
    every = [5, FAR, FAR + 2, None]
    html = spark.createDataFrame([(FAR + 2, "u", "x"), (None, "u", "x"), (FAR, "v", "x"), (None, "u", "y")], "page_id long, url string, html string").coalesce(1)
    out = warc.round_trip(html).collect()
    assert far(out, "page_id") == [FAR, FAR + 2, None, None]
    assert {(r.page_id, r.refers_to) for r in out if r.payload_digest == out[0].payload_digest} >= {(FAR + 2, FAR)}
    assert far(mixing.digest(d).collect()) == every and set(far(mixing.mix_rows(d).collect())) == set(every)
    vectors = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in ids], "vec_id long, embedding array<float>, label int").coalesce(1)
    assert {(r.vec_id, r.component_id) for r in vector_dedup.near_duplicates(vectors).collect()} == {(FAR, 5), (FAR + 2, 5), (5, 5), (None, None)}
    labels = spark.createDataFrame([(FAR, 1), (FAR + 2, 0), (None, 1)], "doc_id long, toxic int")
    assert far(toxicity.digest(d, labels).collect()) == every
    lines = {r.doc_id: r.n_dropped for r in line_dedup.digest(d).collect()}
    assert lines == {FAR: 1, FAR + 2: 1, 5: 0, None: 0}
    packed = packing.pack(d).collect()
    assert sorted((i for r in packed for i in r.doc_ids), key=lambda x: (x is None, x)) == every
    near = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(d, percent=60).collect()}
    assert near == {FAR: 5, FAR + 2: 5, 5: 5, None: None}
    assert far(secrets.digest(d).collect()) == every and far(tokencount.token_counts(d).collect()) == every
    b = spark.createDataFrame([(FAR, f"{long} 0"), (None, long)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()} == {(i, FAR) for i in ids}
    assert far(decontaminate.clean(d.where("doc_id is null or doc_id <> 5"), b).collect()) == [None]


def test_repeated_ids(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f"], extra=True).withColumn("doc_id", F.lit(7).cast("long"))
    assert [r.taken for r in mixing.digest(d).collect()].count(0) == 1 and mixing.mix_rows(d).count() >= 4
    assert [i for r in packing.pack(d).collect() for i in r.doc_ids] == [7, 7, 7]
    assert [r.component_id for r in ngram_join.jaccard_join(d).collect()] == [7] * 4 and ngram_join.keep_one(d).count() == 4
    assert sorted(r.n_tokens for r in tokencount.token_counts(d).collect()) == [0, 6, 6, 6]
    two = docs(spark, ["bad word " * 3, "good word " * 3], extra=True).withColumn("doc_id", F.lit(7).cast("long"))
    labels = spark.createDataFrame([(7, 1), (1, 0)], "doc_id long, toxic int")
    other = docs(spark, ["fine", "good"])
    scores = [sorted(r.score for r in toxicity.digest(two.select(other.columns).unionByName(other).repartition(n), labels).collect()) for n in (1, 3)]
    assert scores[0] == scores[1]


def test_pre_tokens_out_of_the_broadcast_part_count_alike(spark):
    rng = random.Random(31)
    texts = [" ".join(words(rng, rng.randrange(0, 80), 50)) for _ in range(40)] + ["x" * 5000 + " x", "long" * 40 + " " + "long" * 40, None]
    counts = [sorted((r.doc_id, r.n_tokens) for r in tokencount.token_counts(docs(spark, texts), head=h).collect()) for h in (tokencount.HEAD, 5, 0)]
    assert counts[0] == counts[1] == counts[2]


def _recall(spark, rows, **options):
    m = np.array([r[1] for r in rows], "f4").astype("f8")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    degree = (m @ m.T >= 0.98).sum(1) - 1
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).toPandas().set_index("vec_id").n_links
    found = out.reindex(range(len(rows))).to_numpy()
    assert (found <= degree).all() and degree.sum() > 100
    return found.sum() / degree.sum()


@pytest.mark.parametrize("mean", [0.0, 2.0, 4.0])
def test_vectors_that_point_one_way_are_found_too(spark, mean):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(1500, 32))
    base[:, 0] += mean * np.sqrt(32)
    near = base[:300] + rng.normal(size=(300, 32)) * 0.12 * (1 + mean) / 2
    rows = [(i, v.astype("f4").tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    assert _recall(spark, rows) >= 0.9
    if mean == 4.0:
        # One narrow round is not enough here; what is measured calls for all pairs.
        assert _recall(spark, rows, rounds=((1, 2),)) == 1.0 and _recall(spark, rows, exact=True) == 1.0


@pytest.mark.parametrize("part", [1024, 100])
def test_links_of_vectors_rest_on_no_sample(spark, monkeypatch, part):
    # A sample of one vector says nothing of the links that windows lose.
    monkeypatch.setattr(vector_dedup, "SAMPLE", 1)
    monkeypatch.setattr(vector_dedup, "PART", part, raising=False)
    rng = np.random.default_rng(19)
    base = rng.normal(size=(1500, 32))
    base[:, 0] += 4 * np.sqrt(32)
    rows = [(i, v.astype("f4").tolist(), 1) for i, v in enumerate(np.concatenate([base, base[:300] + rng.normal(size=(300, 32)) * 0.3]))]
    assert _recall(spark, rows) == 1.0


def test_spanning_links_connect_what_a_matrix_connects():
    near = np.zeros((7, 7), bool)
    for a, b in ((0, 3), (3, 5), (0, 5), (2, 6)):
        near[a, b] = near[b, a] = True
    assert sorted(zip(*(x.tolist() for x in vector_dedup.spanning(near)), strict=True)) == [(0, 3), (0, 5), (2, 6)]


def _typos(rng, n, k):
    ws = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(n)]
    line = " ".join(ws)
    for j in rng.sample(range(n), k):
        at = rng.randrange(len(ws[j]))
        ws[j] = ws[j][:at] + rng.choice("0123456789") + ws[j][at + 1 :]
    return line, " ".join(ws)


def test_recall_of_lines_by_class(spark):
    rng, texts, classes = random.Random(41), [], [(n, k) for n in (8, 12, 25) for k in (1, 2, 3, 4)] + [(100, k) for k in (1, 5, 10, 18)]
    for n, k in classes:
        for _ in range(40):
            texts += _typos(rng, n, k)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(1200)]
    for at in range(0, 1200, 60):
        line = "".join(han[at : at + 60])
        texts += [line, line[:30] + "x" + line[31:]]
    tiny = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(20)) for _ in range(20)]
    for line in tiny:
        texts += [line, line[:25] + "q" + line[26:]]
    out = {r.doc_id: r.n_dropped for r in line_dedup.digest(docs(spark, texts)).collect()}
    for c, name in enumerate([*classes, *["han"] * 1, *["tiny"] * 1]):
        at, n = (c * 80, 40) if c < len(classes) else (len(classes) * 80 + (c - len(classes)) * 40, 20)
        found = [out[at + 2 * i + 1] for i in range(n)]
        assert sum(found) >= 0.9 * n, (name, sum(found), n)
    assert not any(out[2 * i] for i in range(len(texts) // 2))


def _pair_keys(line):
    """Keys of a line of up to 72 characters: neighbouring words and those over one word."""
    w = line.split()
    return {(x, y) for k in (1, 2) for x, y in zip(w, w[k:]) if len(x) + len(y) >= line_dedup.PAIR - 1}


def test_lines_that_share_one_frequent_key_meet(spark, monkeypatch):
    """F16: all lines with a common key are compared, however many have it; with blocks of a few lines."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16, raising=False)
    rng, lines = random.Random(16), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 9))) for _ in range(12)]
    while len(lines) < 240:
        line = " ".join(rng.choice(vocabulary) for _ in range(8))
        lines += [line, _misspelt(rng, line, 5)] if len(line) <= 72 else []
    lines = list(dict.fromkeys(lines))
    keys, often = [_pair_keys(x) for x in lines], defaultdict(int)
    for k in (k for own in keys for k in own):
        often[k] += 1
    links = [(i, j) for i in range(len(lines)) for j in range(i) if keys[i] & keys[j] and _similar(lines[i], lines[j])]
    # Many meet in one key only, that more than eight lines have.
    assert sum(len(keys[i] & keys[j]) == 1 and often[min(keys[i] & keys[j])] > 8 for i, j in links) > 10
    comp = components(list(range(len(lines))), links)
    out = {r.doc_id: r.n_dropped for r in line_dedup.digest(docs(spark, lines)).collect()}
    assert [out[i] for i in range(len(lines))] == [int(comp[i] != i) for i in range(len(lines))]


@pytest.mark.parametrize("n", [24, 60, 300, 700])
def test_similar_is_the_edit_distance(spark, n):
    rng, pairs = random.Random(n), []
    for edits in (0.02, 0.1, 0.18, 0.2, 0.22, 0.3, 1):
        for _ in range(8):
            a = "".join(rng.choice("abcde é") for _ in range(n))
            b = list(a)
            for _ in range(int(edits * n)):
                at = rng.randrange(len(b))
                b[at : at + rng.choice((0, 1, 1))] = rng.choice(["x", "", "b", "é"])
            pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.similar("a", "b").alias("s")).collect()
    assert [r.s for r in got] == [_similar(r.a, r.b) for r in got]


def test_most_lines_are_decided_without_the_whole_distance(spark):
    """lines that share a phrase only, and near copies with other words put in and left out, are decided by bounds, never against the distance."""
    rng, pairs = random.Random(61), []
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    vocabulary = ["".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é")) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    for n in (20, 60, 120):
        for k in range(24):
            a = some(n)
            b = some(n) if k % 2 else list(a)
            if k % 2:
                b[3:6] = a[3:6]
            for _ in range(n // (8 if k % 4 else 16) if not k % 2 else 0):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = some(1)
            a, b = " ".join(a), " ".join(b)
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)):
                pairs.append((a, b))
    x, y = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.similar("a", "b").alias("s"), line_dedup.similar("a", "b", often=False).alias("s2"), line_dedup.apart(x, y, line_dedup.LEADS[1]).alias("no"), line_dedup.chained(x, y).alias("yes")).collect()
    true = [_similar(r.a, r.b) for r in got]
    assert [r.s for r in got] == true and [r.s2 for r in got] == true and 10 < sum(true) < len(true) - 10
    assert not any(r.no and s or r.yes and not s for r, s in zip(got, true, strict=True))
    assert sum(r.no for r in got) >= 0.9 * (len(true) - sum(true)) and sum(r.yes for r in got) >= 0.9 * sum(true)


# the pipeline


def test_pipeline_edges(spark):
    import corpus_pipeline as c

    text = "the first text of some words that nobody wrote before now"
    rows = [(FAR, text, "en", "a", 1), (FAR + 2, f"{text} or later", "en", None, None), (None, "a text without id", None, "a", 3), (3, None, "en", "b", 4), (3, "", "en", "b", 4), (4, text, "en", "b", 4)]
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS id", "'x' AS t", "2 AS size", "'y' AS node", "3 AS component", "4 AS rank", "'z' AS label").coalesce(1)
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, d, DATA)
        assert kept.columns == d.columns, name
        found = {r.doc_id for r in kept.collect()}
        if name == "near_copies":
            # 7 of 9 shingles of five words are shared with the longer text: under 0.8. Of equal texts the smallest id stays.
            assert found == {FAR + 2, None, 3, 4}
        elif name == "mixing":
            # Targets are 30 of 16 words, 10 of 11 and 20 of 13; what has no words is never taken.
            assert {FAR, FAR + 2, None} <= found <= {FAR, FAR + 2, None, 4}
        else:
            assert found == {FAR, FAR + 2, None, 3, 4}, name
    assert {i for r in c.pack_tokens(spark, d, DATA).collect() for i in r.doc_ids} == {FAR, FAR + 2, None, 4}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, d, DATA)
        assert kept.columns == d.columns, name
        d = common.cut(kept)
    rows = d.toPandas()
    assert (rows.groupby("doc_id").size() <= 2).all()
    packed = c.run(spark, DATA).toPandas()
    assert set(rows.doc_id) == {i for r in packed.doc_ids for i in r}
    empty = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, DATA).count() == 0
