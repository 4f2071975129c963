"""The versioned store and the incremental index: writers beside each other, versions, compaction, what an indexing run embeds."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.sources import code, store

DDL = "id int, v string, n int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), DDL)


def values(df):
    return {r.id: r.v for r in df.collect()}


def test_upserts_versions_and_deletes(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=4)
    assert t.current() == 0 and t.count() == 0
    assert t.upsert(rows(spark, *((i, f"a{i}", 1) for i in range(20)), (3, "later", 2))) == 20
    assert t.upsert(rows(spark, (3, "new", 0), (99, "x", 0)), spark.createDataFrame([(5,), (99,), (1000,)], "id int")) == 4
    now = values(t.read())
    # Within an upsert the last by order wins; a later upsert wins over an earlier one; a key that is written isn't deleted.
    assert now == {i: f"a{i}" for i in range(20) if i not in (3, 5)} | {3: "new", 99: "x"}
    assert values(t.read(1))[3] == "later" and 5 in values(t.read(1)) and t.versions() == [1, 2]
    assert t.upsert(rows(spark)) == 0 and t.current() == 2


def test_an_upsert_writes_its_buckets_only(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=8)
    t.upsert(rows(spark, *((i, "a", 1) for i in range(100))))
    before = t.state()
    t.upsert(rows(spark, (7, "b", 1)))
    after = t.state()
    changed = [b for b in after if after[b] != before[b]]
    assert len(before) == 8 and len(changed) == 1 and after[changed[0]][:-1] == before[changed[0]]
    # Buckets of one folder are read as they are; only the changed one is merged.
    assert t.count() == 100 and values(t.read())[7] == "b"


def test_compaction_and_vacuum(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=2)
    for n in range(4):
        t.upsert(rows(spark, *((i, f"{n}", 1) for i in range(n, 12))), spark.createDataFrame([(0,)], "id int") if n == 3 else None)
    want = values(t.read())
    assert t.compact(beyond=10) == 0 and t.compact(beyond=2) == 2
    assert values(t.read()) == want and all(len(f) == 1 for f in t.state().values())
    assert values(t.read(1))[0] == "0" and t.vacuum() >= 4 and t.versions() == [t.current()]
    assert values(t.read()) == want and 0 not in want


def test_a_stale_base_is_refused_and_two_writers_lose_nothing(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=4)
    t.upsert(rows(spark, (0, "a", 1)))
    with pytest.raises(store.Stale):
        t.commit(0, {})
    errors = []

    def write(k):
        try:
            mine = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=4)
            for n in range(3):
                mine.upsert(rows(spark, (100 * k + n, f"w{k}", 1)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and t.versions() == list(range(1, 11))
    assert values(t.read()) == {0: "a"} | {100 * k + n: f"w{k}" for k in (1, 2, 3) for n in range(3)}


def test_compaction_beside_an_upsert(spark, tmp_path, monkeypatch):
    t = store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=1)
    for n in range(3):
        t.upsert(rows(spark, (n, f"{n}", 1)))
    write = t._write

    def slow(df):
        out = write(df)
        if not slow.done:
            slow.done = True
            store.Table(spark, str(tmp_path / "t"), ["id"], ["n"], DDL, buckets=1).upsert(rows(spark, (0, "meanwhile", 1)))
        return out

    slow.done = False
    monkeypatch.setattr(t, "_write", slow)
    assert t.compact(beyond=2) == 1
    assert values(t.read()) == {0: "meanwhile", 1: "1", 2: "2"} and [len(f) for f in t.state().values()] == [2]


SOURCES = {f"m{i}.py": f'def f{i}():\n    """Does {i}."""\n    return {i}\n\n\ndef g{i}():\n    """Is {i}."""\n    return 0\n' for i in range(6)} | {"bad.py": "def broken(:\n"}


def titles(target):
    return {r.title for r in target.read().collect()}


def test_a_second_run_embeds_nothing(spark, tmp_path):
    class Refuses(search.Embedder):
        def embed(self, texts):
            raise RuntimeError("asked")

    target = search.index_table(spark, str(tmp_path / "index"))
    one = search.index_codebase(code.from_map(spark, SOURCES), target)
    assert (one.written, one.unchanged, one.removed) == (12, 0, 0) and [r.path for r in one.errors.collect()] == ["bad.py"]
    two = search.index_codebase(code.from_map(spark, SOURCES), target, Refuses)
    assert (two.written, two.unchanged, two.removed) == (0, 12, 0) and [r.path for r in two.errors.collect()] == ["bad.py"] and target.current() == 1
    # A unit changed, one went with its function, one source went, one can't be read, one isn't parsed any more.
    now = dict(SOURCES)
    now["m0.py"] = now["m0.py"].replace("Does 0", "Did 0")
    now["m1.py"] = now["m1.py"].split("\n\n\n")[0]
    del now["m2.py"]
    now["m3.py"] = "def f3(:\n"
    given = code.from_map(spark, now).withColumn("error", F.lit(None).cast("string"))
    given = given.where("path <> 'm4.py'").unionByName(spark.createDataFrame([("m4.py", None, "refused")], "path string, source string, error string"))
    three = search.index_codebase(given, target)
    assert (three.written, three.removed) == (1, 1) and {r.path: r.error for r in three.errors.collect()}["m4.py"] == "refused"
    assert titles(target) == {f"{x}{i}" for x in "fg" for i in range(6)} - {"g1"}
    four = search.index_codebase(given, target, whole=True)
    # What is known to be gone goes; what could not be read or parsed stays.
    assert four.removed == 2 and titles(target) == {f"{x}{i}" for x in "fg" for i in (0, 1, 3, 4, 5)} - {"g1"}


def test_a_batch_that_fails_is_rows_and_the_others_are_written(spark, tmp_path):
    class Picky(search.HashEmbedder):
        def embed(self, texts):
            if any("f2" in t for t in texts):
                raise ValueError("too long")
            return super().embed(texts)

    target = search.index_table(spark, str(tmp_path / "index"))
    done = search.index_codebase(code.from_map(spark, SOURCES), target, Picky, batch=1)
    failed = [r for r in done.errors.collect() if r.path != "bad.py"]
    assert [(r.path, r.error) for r in failed] == [("m2.py", "ValueError: too long")] and done.written == 11 and "f2" not in titles(target)
    # Only what failed is asked for again.
    again = search.index_codebase(code.from_map(spark, SOURCES), target)
    assert (again.written, again.unchanged) == (1, 11) and "f2" in titles(target)
    vectors = [np.linalg.norm(r.embedding) for r in target.read().collect()]
    assert vectors == pytest.approx([1.0] * 12, abs=1e-5)
