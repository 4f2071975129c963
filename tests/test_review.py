"""A review from source to report, with the offline provider."""

import json

from millrace.operators import providers
from millrace.plans import review

SOURCE = 'password = "hunter2222"\neval(x)\nexec(y)\n'


def sources(spark):
    return spark.createDataFrame([(1, "a.py", SOURCE), (2, "b.py", " "), (3, "c.js", "var x = 1")], "review_id int, path string, source string")


def test_review_runs_to_its_report(spark):
    scan = json.dumps({"results": [{"issue_text": "md5", "test_name": "Weak hash md5", "issue_severity": "LOW", "issue_confidence": "HIGH", "filename": "a.py", "line_number": 90, "line_range": [90]}]})
    r = review.run_review(sources(spark), scanner=spark.createDataFrame([(1, scan), (3, scan)], "review_id int, report string"))
    found = [(x.review_id, x.title, x.severity) for x in r.findings.orderBy("review_id", "rank").collect()]
    assert (1, "Weak hash md5", "high") in found and all(x[0] == 1 for x in found)
    reports = {x.review_id: x for x in r.reports.collect()}
    assert set(reports) == {1, 2, 3} and "hunter2222" not in reports[1].report and "No Issues Found" in reports[2].report
    assert {x.review_id for x in r.fixes.collect()} == {1} and r.errors.count() == 0


def test_human_decisions_hold_reports_back(spark):
    decided = spark.createDataFrame([(1, "approve"), (3, "revise")], "review_id int, decision string")
    r = review.run_review(sources(spark), decisions=decided, with_human=True, with_fixes=False)
    assert {x.review_id: x.next for x in r.status.collect()} == {1: "report", 2: "paused", 3: "fix_suggester"}
    assert {x.review_id for x in r.reports.collect()} == {1}


def test_failed_calls_are_error_rows(spark):
    class Broken(providers.Provider):
        name = "broken"

        def generate(self, prompt, system=""):
            raise TimeoutError

    r = review.run_review(sources(spark), Broken, with_fixes=False)
    assert {x.review_id for x in r.errors.collect()} == {1, 3} and r.findings.count() == 0


def test_diff_review_and_agents(spark):
    from millrace.plans.fixture_queries import DIFF, filled

    r = review.review_diffs(spark.createDataFrame([(1, filled(DIFF).replace("b = 2", "eval(b)"))], "review_id int, diff string"), with_fixes=False)
    assert r.reports.first().total_findings >= 1
    counts = spark.createDataFrame([(1, "static", "completed", 2)], "review_id int, agent string, status string, n long")
    assert {x.agent: (x.status, x.n) for x in review.agent_rows(counts).collect()} == {"static": ("completed", 2), "security": ("not run", 0), "logic": ("not run", 0)}
    checks = spark.createDataFrame([("b", "x", False, True), ("a", "y", True, True)], "phase string, name string, ok boolean, critical boolean")
    assert [(x.phase, x.critical_failed) for x in review.health(checks).collect()] == [("a", 0), ("b", 1)]


def test_two_files_of_one_review_are_kept_apart(spark):
    rows = [(1, "a.py", 'token = "ghp_abcdefghijklmnopqrstuvwxyz0123456789"\neval(x)\n'), (1, "b.py", "y = 1\n")]
    r = review.run_review(spark.createDataFrame(rows, "review_id int, path string, source string"), with_fixes=False)
    assert [(x.file, x.title) for x in r.findings.collect()] == [("a.py", "Use of eval")]
    kept = {x.path: x.source for x in r.sanitized.collect()}
    assert kept["b.py"] == "y = 1\n" and "ghp_" not in kept["a.py"]
    assert r.reports.first().total_findings == 1 and "a.py, b.py" in r.reports.first().report


def test_the_model_is_asked_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Counting(providers.Stub):
        def generate(self, prompt, system=""):
            with open(calls, "a") as f:
                f.write(".")
            return super().generate(prompt, system)

    r = review.run_review(sources(spark), Counting, with_fixes=False)
    for df in (r.findings, r.summary, r.reports, r.errors):
        df.collect()
    assert len(open(calls).read()) == 4  # two sources, two kinds of request


def test_saved_reviews_are_taken_up_again(spark, tmp_path):
    folder = str(tmp_path / "threads")
    r = review.run_review(sources(spark), with_human=True, with_fixes=False)
    assert r.reports.count() == 0
    review.save(r, folder)
    review.save(r, folder)

    class Silent(providers.Stub):
        def generate(self, prompt, system=""):
            assert prompt.startswith(("# Fix", "# Judge"))
            return super().generate(prompt, system)

    out = review.resume_review(spark, folder, spark.createDataFrame([(1, "revise"), (2, "approve")], "review_id int, decision string"), Silent)
    assert {x.review_id for x in out.reports.collect()} == {2} and {x.review_id for x in out.fixes.collect()} == {1}
    assert {x.review_id: x.next for x in out.status.collect()} == {1: "fix_suggester", 2: "report", 3: "paused"}
    linked = review.fixes_with_findings(out.fixes.select("review_id", "title"), r.findings).collect()
    assert linked and all(x.finding_file == "a.py" for x in linked)


def test_small_review_helpers(spark):
    graded = spark.createDataFrame([(1, "critical", "a"), (1, "low", "b"), (2, "low", "c")], "review_id int, severity string, title string")
    assert {x.review_id: x.urgent for x in review.high_or_critical(graded).collect()} == {1: 1, 2: 0}
    counts = spark.createDataFrame([(1, "low", 2), (1, "critical", 1), (1, "info", 0)], "review_id int, severity string, n int")
    assert review.count_text(counts).first().text == "3 finding(s): 1 critical, 2 low."
    reports = spark.createDataFrame([(1, '{"metrics": {"_totals": {"loc": 7, "SEVERITY.HIGH": 2}}}'), (2, "{}")], "review_id int, report string")
    assert sorted(map(tuple, review.metric_totals(reports).collect())) == [(1, 7, 2, 0, 0), (2, 0, 0, 0, 0)]
    buckets = spark.createDataFrame([(1, "low", ["x"]), (3, "high", ["y", "z"])], "review_id int, severity string, titles array<string>")
    assert {(x.review_id, x.title) for x in review.flat_findings(graded, buckets).collect()} == {(1, "a"), (1, "b"), (2, "c"), (3, "y"), (3, "z")}
    assert review.status_counts(spark.createDataFrame([("done",), ("done",), ("planned",)], "status string")).first().asDict() == {"done": 2, "active": 0, "planned": 1}
    asked = review.flags(sources(spark)).collect()
    assert {(x.path, x.static, x.logic) for x in asked} == {("a.py", True, True), ("b.py", False, False), ("c.js", False, True)}


def test_json_mode_falls_back_and_health_names_the_fault():
    import io
    import urllib.error

    sent = []

    def open_url(request, timeout):
        if request.data is None:
            return io.BytesIO(b'{"models": [{"name": "other:7b"}]}')
        sent.append(json.loads(request.data))
        if sent[-1].get("format") == "json":
            raise urllib.error.HTTPError(request.full_url, 400, "no such mode", {}, None)
        return io.BytesIO(b'{"response": "{}"}')

    p = providers.ollama("mine", open_url=open_url)
    assert p.generate_json("x") == "{}" and [m.get("format") for m in sent] == ["json", None]
    assert p.health() == (False, "ollama has no model mine") and providers.ollama("other", open_url=open_url).health() == (True, "")

    def down(request, timeout):
        raise OSError

    assert not providers.ollama("mine", open_url=down).health()[0]
