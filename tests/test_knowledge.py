"""Texts on weaknesses and their place in a scan; exports and settings."""

from pyspark.sql import functions as F

from millrace import knowledge
from millrace.operators import prompts, search
from millrace.plans import review
from millrace.schema import Config


def test_preload_and_scan_with_knowledge(spark, tmp_path):
    target = search.index_table(spark, str(tmp_path / "index"))
    assert knowledge.preload(target) and not knowledge.preload(target) and target.count() == len(knowledge.NOTES)
    sources = spark.createDataFrame([(1, "a.py", "cursor.execute('SELECT ' + table)  # sql statement built from a caller's input values"), (1, "b.py", ""), (2, "c.py", None)], "review_id int, path string, source string")
    out = {r.path: r.knowledge for r in knowledge.with_knowledge(sources, target.read(), k=2).collect()}
    assert len(out) == 3 and out["a.py"].count("### ") == 2 and "(CWE-89)" in out["a.py"] and out["b.py"] is None and out["c.py"] is None
    asked = knowledge.with_knowledge(sources.where("path = 'a.py'"), target.read(), k=1).select(prompts.scan(F.col("path"), F.col("source"), "Scan", None, F.col("knowledge")).alias("p")).first().p
    assert "Instead: " in asked
    done = review.run_review(sources.where("source <> ''"), index=target.read(), with_fixes=False)
    assert done.errors.count() == 0 and done.reports.count() == 1


def test_redacted_texts_are_exported(spark, tmp_path):
    sources = spark.createDataFrame([(1, "d/a.py", "x = 1\npassword = 'hunter2hunter2'\n"), (2, "b.py", "y = 2")], "review_id int, path string, source string")
    done = review.run_review(sources, with_fixes=False)
    review.export_sources(done, str(tmp_path / "out"))
    texts = {r.path: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert texts["b.py"].strip() == "y = 2" and "hunter2" not in texts["d/a.py"] and texts["d/a.py"].startswith("x = 1\n")


def test_settings_hide_the_key():
    shown = dict(Config(api_key="k1", model="m").shown())
    assert shown["REVIEW_API_KEY"] == "********" and shown["REVIEW_MODEL"] == "m" and dict(Config().shown())["REVIEW_API_KEY"] == "(not set)"
