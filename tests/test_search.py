"""Indexing, search, context, and reviews of a git repository."""

import io
import json
import subprocess

import pytest
from conftest import DATA  # noqa: F401
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.plans import pull, review
from millrace.sources import code

SOURCES = {
    "pay.py": 'import store\n\n\ndef refund(order):\n    """Gives money back for an order."""\n    return store.load(order)\n\n\ndef charge(card):\n    """Takes money from a card."""\n    return card\n',
    "store.py": 'def load(key):\n    """Loads an order from the database."""\n    return key\n',
    "bad.py": "def broken(:\n",
    "notes.md": "one\ntwo\n",
}


def indexed(spark, folder):
    target = search.index_table(spark, str(folder / "index"))
    return target, search.index_codebase(code.from_map(spark, SOURCES), target)


def test_index_search_and_count(spark, tmp_path):
    target, done = indexed(spark, tmp_path)
    assert done.written == search.indexed_count(target) == 4 and [r.path for r in done.errors.collect()] == ["bad.py"]
    assert done.summary.first().asDict() == {"files": 3, "units": 4, "functions": 3, "classes": 0, "methods": 0, "chunks": 1}
    search.index_codebase(code.from_map(spark, SOURCES), target, version=2)
    assert search.indexed_count(target) == 4
    asked = spark.createDataFrame([(1, "load an order from the database"), (2, "")], "qid int, query string")
    hits = search.search_codebase(asked, target.read(), 2).orderBy("rank").collect()
    assert [h.rank for h in hits] == [1, 2] and hits[0].title == "load" and hits[0].qid == 1
    assert search.search_codebase(asked, target.read().where("false"), 2).count() == 0


def test_context_of_changes(spark, tmp_path):
    target, _ = indexed(spark, tmp_path)
    edges = pull.build_graph(code.from_map(spark, SOURCES))["edges"]
    rows = [(1, 0, "pay.py", "refund", ["    return store.load(order)  # loads an order from the database"]), (1, 1, "pay.py", "refund", ["x"]), (1, 2, "pay.py", None, ["y"])]
    changes = spark.createDataFrame(rows, "review_id int, pos int, file_path string, function_name string, added_lines array<string>")
    functions = changes.where("pos = 0").withColumn("qid", F.lit(1))
    hits = search.retrieve_for_function(functions, target.read(), edges, least=0.0).collect()
    assert "refund" not in {h.title for h in hits} and {h.title: h.is_direct_dependency for h in hits}["load"]
    out = search.retrieve_for_changes(changes, target.read(), edges, least=0.0).collect()
    assert len(out) == 1 and "`load` in `store.py`" in out[0].context and "direct dependency" in out[0].context and out[0].units <= 3
    assert search.retrieve_for_changes(changes, target.read(), edges, least=0.0, max_tokens=1).count() == 0
    shown = search.function_context(functions.withColumn("snippet", F.lit("return 1")), pull.import_edges(code.from_map(spark, SOURCES)).select("src", "ord", "module")).first()
    assert shown.context == "### `refund` (`pay.py`)\nImports: store\n```python\nreturn 1\n```"


@pytest.fixture
def repository(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("config", "user.email", "x@y")
    git("config", "user.name", "x")
    for name, text in SOURCES.items():
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "work")
    (tmp_path / "pay.py").write_text(SOURCES["pay.py"].replace("return card", "return eval(card)"))
    (tmp_path / "store.py").unlink()
    (tmp_path / "web.js").write_text("function go() {\n}\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    return str(tmp_path)


def test_changes_of_a_repository(spark, repository):
    rows = {r.file_path: r for r in pull.extract_review_changes(spark, repository, "main", "work").collect()}
    assert {p: (r.change_type, r.function_name) for p, r in rows.items()} == {"pay.py": ("modified", "charge"), "store.py": ("deleted", "load"), "web.js": ("added", "go")}
    texts = [r.text for r in pull.changes_text(pull.extract_review_changes(spark, repository, "main", "work")).collect()]
    assert any(t.startswith("Modified charge in pay.py: +1 / -1 lines") for t in texts)
    r = pull.review_repository(spark, repository, "main", "work", with_fixes=False)
    assert [(f.title, f.severity) for f in r.findings.collect()] == [("Use of eval", "medium")] and review.high_or_critical(r.findings).first().urgent == 0


def test_graph_and_pull_request(spark, repository):
    g = pull.build_graph(code.from_map(spark, SOURCES))
    assert [(e.src, e.dst) for e in g["edges"].collect()] == [("pay.py", "store.py")] and [e.path for e in g["errors"].collect()] == ["bad.py"]
    diff = subprocess.run(["git", "-C", repository, "diff", "main...work"], capture_output=True, text=True, check=True).stdout
    posted = []

    def open_url(request, timeout):
        if request.data:
            posted.append((request.full_url, json.loads(request.data)["body"]))
        return io.BytesIO(diff.encode())

    hosted = code.Hosted(open_url=open_url)
    r = pull.review_pull_request(spark, "https://github.com/o/r/pull/7", hosted, comment=True, with_fixes=False)
    assert r.reports.first().review_id == 7 and posted[0][0].endswith("/repos/o/r/issues/7/comments") and "Code Review Report" in posted[0][1]
    with pytest.raises(ValueError):
        pull.review_pull_request(spark, "https://github.com/o/r", hosted)


def test_raw_addresses_come_first():
    asked = []

    def open_url(request, timeout):
        asked.append(request.full_url)
        if "raw" in request.full_url:
            raise OSError
        return io.BytesIO(json.dumps({"content": "aGk="}).encode())

    assert code.Hosted(open_url=open_url).raw("o", "r", "a.py", "main") == "hi" and ["raw" in a for a in asked] == [True, False]


def test_an_indexing_run_parses_a_source_once(spark, tmp_path, monkeypatch):
    sources = [("a.py", "def f():\n    return 1\n"), ("b.py", "def g(:\n"), ("c.py", "    x = 1\n    y = 2\n"), ("d.py", " \n"), ("e.py", "    x = (\n"), ("f.txt", "text\n")]
    rows = spark.createDataFrame(sources, "path string, source string")
    plans = {}

    def watched(df, name, store=search.stored):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(search, "stored", watched)
    run = search.index_codebase(rows, search.index_table(spark, str(tmp_path / "index")))
    checked = rows.where("path like '%.py'").select("path", search.syntax.check_syntax(F.col("source"), F.col("path")).alias("r"))
    want = {(r.path, r.error, r.line) for r in checked.where("not r.valid and r.error <> 'empty'").select("path", "r.error", "r.line").collect()}
    assert {(r.path, r.error, r.line) for r in run.errors.collect()} == want and {w[0] for w in want} == {"b.py", "e.py"} and run.written == 2
    assert plans["units"].count("MapInPandas") == 1 and not any("MapInPandas" in plans[x] or "ArrowEvalPython" in plans[x] for x in plans if x not in ("units", "embedded"))
