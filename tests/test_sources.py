"""Parsers of hosted answers, events and settings."""

import base64
import io
import urllib.error
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import providers
from millrace.schema import Config
from millrace.sources import code, store


def test_answers_and_events(spark, tmp_path):
    tree = spark.createDataFrame([(json.dumps({"tree": [{"path": "a.py", "type": "blob", "size": 3}, {"path": "d", "type": "tree"}]}),), ("{}",), (None,)], "body string")
    assert [r.path for r in code.tree_files(tree).collect()] == ["a.py"]
    body = base64.b64encode("é = 1\n".encode()).decode()
    content = spark.createDataFrame([(json.dumps({"path": "a.py", "content": body[:4] + "\n" + body[4:]}),)], "body string")
    assert code.decoded(content).first().source == "é = 1\n"
    (tmp_path / "event.json").write_text(json.dumps({"repository": {"full_name": "o/r"}, "pull_request": {"number": 7, "title": "t"}}, indent=1))
    assert tuple(code.read_event(spark, str(tmp_path / "event.json")).first()) == ("o", "r", 7, "t")


def test_content_at_ref_falls_back_to_the_working_copy(spark):
    wanted = spark.createDataFrame([("main", "a"), ("main", "b"), ("main", "c")], "ref string, path string")
    committed = spark.createDataFrame([("main", "a", "old")], "ref string, path string, source string")
    working = spark.createDataFrame([("a", "new"), ("b", "only")], "path string, source string")
    assert {r.path: r.source for r in code.at_ref(wanted, committed, working).collect()} == {"a": "old", "b": "only", "c": None}


def test_hosted_api_and_rate_limit():
    asked = []

    def refused(left):
        def opened(request, timeout):
            asked.append((request.full_url, request.get_header("Authorization")))
            raise urllib.error.HTTPError(request.full_url, 403, "Forbidden", {"X-RateLimit-Remaining": left}, None)

        return opened

    with pytest.raises(RuntimeError, match="rate limit"):
        code.Hosted("k", open_url=refused("0")).repo("o", "r")
    assert asked == [("https://api.github.com/repos/o/r", "Bearer k")]
    with pytest.raises(urllib.error.HTTPError):
        code.Hosted("k", open_url=refused("7")).repo("o", "r")


def test_settings():
    c = Config.from_env({"REVIEW_CHUNK_CHARS": "10", "REVIEW_MODEL": "m"})
    assert c.chunk_chars == 10 and not c.ready and Config().ready and "api_key" not in repr(c)
    for bad in ({"REVIEW_CHUNK_CHARS": "0"}, {"REVIEW_MIN_RELEVANCE": "2"}, {"REVIEW_CHUNK_CHARS": "x"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)


def test_providers_and_model_names():
    assert set(providers.PROVIDERS) == {"stub", "ollama", "gemini"} and providers.ModelNames(("llama:7b",)).has("llama") and not providers.ModelNames(("a",)).has("b")


def test_unit_documents_and_index_summary(spark):
    from millrace.operators import syntax

    units = syntax.units(code.from_map(spark, {"a.py": "class A:\n    def f(self):\n        pass\n", "b.js": "x\n" * 70}))
    assert tuple(store.index_summary(units).first()) == (2, 4, 0, 1, 1, 2)
    doc = store.unit_documents(units).where("title = 'f'").first()
    assert doc.category == "codebase" and doc.metadata["unit_type"] == "method" and doc.content.startswith("Method `A.f`.")
    assert units.select(F.max("end_line")).first()[0] == 70


def test_fetch_errors_are_rows_and_the_limit_stops(spark):
    class Refusing(code.Hosted):
        """Answers by name: text, a missing file, and, from the third file on, the rate limit."""

        def raw(self, owner, repo, path, ref):
            if path == "gone.py":
                raise FileNotFoundError("404")
            if path > "m":
                raise code.RateLimit("rate limit reached, reset at 7")
            return f"# {path}"

    paths = spark.createDataFrame([(p,) for p in ("a.py", "gone.py", "n.py", "b.py", "z.py")], "path string").coalesce(1)
    got = {r.path: (r.source, r.error) for r in code.fetched(paths, Refusing(), "o", "r", "main").collect()}
    assert got["a.py"] == ("# a.py", None) and got["gone.py"] == (None, "FileNotFoundError: 404")
    # Once refused, the task asks for nothing more.
    assert {got[p] for p in ("n.py", "b.py", "z.py")} == {(None, "rate limit reached, reset at 7")}


def test_git_files_by_one_process_with_error_rows(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    texts = {f"d/f{i}.py": f"x = {i}\n" * i for i in range(12)} | {"é b.py": "ü", "empty.py": ""}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "x")
    spark.dataSource.register(code.GitFiles)
    rows = spark.read.format("git_files").options(repo=str(tmp_path), ref="HEAD", suffixes=".py", parts="3").load().collect()
    assert {r.path: r.source for r in rows} == texts and {r.error for r in rows} == {None}
    reader = code._GitFilesReader({"repo": str(tmp_path), "ref": "HEAD"})
    assert list(reader.read(code._Paths(["d", "none.py", "d/f2.py"]))) == [("d", None, "a tree"), ("none.py", None, "HEAD:none.py missing"), ("d/f2.py", "x = 2\n" * 2, None)]
