"""Scalar functions on hand-computed values, nulls and non-ASCII text."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], ddl).select(column.alias("r")).first()[0]


def s(v):
    return "string", v


@pytest.mark.parametrize("path, name, code", [("a/b.PY", "Python", "python"), ("x.tsx", "TypeScript", "typescript"), (".env", "Code", "text"), ("Makefile", "Code", "text"), (None, "Code", "text"), ("a.b/c", "Code", "text"), ("m.tf", "Terraform", "hcl")])
def test_language(spark, path, name, code):
    assert tuple(one(spark, T.language(F.col("p")), p=s(path))) == (name, code)


@pytest.mark.parametrize("value, masked", [("abcd", "****"), ("abcde", "abcd*"), ("a" * 40, "aaaa" + "*" * 12)])
def test_mask(spark, value, masked):
    assert one(spark, T.mask(F.col("v")), v=s(value)) == masked


@pytest.mark.parametrize("value, masked", [(None, "****"), ("12345678", "****"), ("123456789", "1234...6789")])
def test_mask_key(spark, value, masked):
    assert one(spark, T.mask_key(F.col("v")), v=s(value)) == masked


def test_normalised_title_keeps_letters_of_any_script(spark):
    assert one(spark, T.normalise_title(F.col("v")), v=s("  SQL-Injection: École_é!  ")) == "sql injection école_é"
    assert one(spark, T.title_tokens(F.col("v")), v=s("a b a!")) == ["a", "b"]
    assert one(spark, T.normalise_title(F.col("v")), v=s(None)) == ""


@pytest.mark.parametrize("a, b, want", [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=("array<string>", a), b=("array<string>", b)) == pytest.approx(want)


@pytest.mark.parametrize("distance, want", [(0.0, 1.0), (0.5, 0.75), (1.3, 0.35), (1.32, 0.34), (2.0, 0.0), (2.5, 0.0)])
def test_relevance(spark, distance, want):
    assert one(spark, T.relevance(F.col("d")), d=("double", distance)) == want


@pytest.mark.parametrize("text, want", [("a\nb\n", ["a", "b"]), ("", []), ("a\r\nb\x0bc\u2028d", ["a", "b", "c", "d"]), ("\n\n", ["", ""]), (None, [])])
def test_lines_are_those_of_universal_line_ends(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=s(text)) == want == (text or "").splitlines()


def test_line_of_offset_counts_code_points(spark):
    assert tuple(one(spark, T.line_of(F.col("t"), F.lit(5)), t=s("é🙂\nabc"))) == (2, 2)


def test_fingerprint_of_line_zero_is_that_of_no_line(spark):
    f = lambda n: one(spark, T.fingerprint(F.lit("T"), F.lit("f"), F.col("n")), n=("int", n))
    assert f(0) == f(None) != f(1)
    import hashlib

    assert f(3) == hashlib.sha256(b"t|f|3").hexdigest()[:16]


@pytest.mark.parametrize("cls, fn, want", [(None, None, "<module>"), ("A", None, "<module>"), (None, "f", "f"), ("A", "f", "A.f"), ("A", "A.f", "A.f")])
def test_display_scope(spark, cls, fn, want):
    assert one(spark, T.display_scope(F.col("c"), F.col("f")), c=s(cls), f=s(fn)) == want


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": [1]} ok', '{"a": [1]}'), ("x [1, 2] y", "[1, 2]"), ("none", "none"), ("", ""), (None, "")],
)
def test_clean_json(spark, text, want):
    assert one(spark, T.clean_json(F.col("t")), t=s(text)) == want


def test_numbered_code_and_payload(spark):
    assert one(spark, T.format_code(F.col("t"), F.lit("a.py")), t=s("x\ny")) == "```python\n   1 | x\n   2 | y\n```"
    payload = "## Changed Code for Review\n```diff\n+a\n```\n"
    assert one(spark, T.format_code(F.col("t"), F.lit("a.py")), t=s(payload)) == payload.rstrip()


def test_retrieval_query(spark):
    q = T.retrieval_query(F.lit("refund"), F.lit("pkg/utils.py"), F.array(*map(F.lit, ["# no", " a = 1", "", "b", "c", "d"])), F.lit("sum"))
    assert one(spark, q) == "refund a = 1 b c sum"
    q = T.retrieval_query(F.lit("refund"), F.lit("pkg/pay.py"), F.array().cast("array<string>"), F.lit(""))
    assert one(spark, q) == "refund pay"


def test_snippet_is_dedented_and_cut(spark):
    source = "def f():\n" + "".join(f"    x{i}\n" for i in range(50))
    out = one(spark, T.snippet(F.col("t"), F.lit(2), F.lit(51)), t=s(source))
    assert out.startswith("x0\nx1\n") or out.startswith("    x0\n")
    assert out.endswith("... (10 more lines)")


@pytest.mark.parametrize("url, want", [("https://github.com/o/r", ("o", "r", None)), ("git@github.com:o/r.git", ("o", "r", None)), ("https://github.com/o/r/pull/12", ("o", "r", 12)), ("https://example.com/x", (None, None, None))])
def test_repository_addresses(spark, url, want):
    assert tuple(one(spark, T.github_parts(F.col("u")), u=s(url))) == want


@pytest.mark.parametrize("path, want", [("a/./b/../c.js", "a/c.js"), ("./lib", "lib"), ("../x", "../x")])
def test_normal_path(spark, path, want):
    assert one(spark, T.normal_path(F.col("p")), p=s(path)) == want
