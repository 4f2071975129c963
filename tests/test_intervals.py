"""Interval joins against plain loops, and what rests on them: scopes of changed lines, large diffs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks, diff, intervals
from millrace.plans import review


def spans(rng, n, most):
    out = []
    for i in range(n):
        low = rng.randrange(most)
        out.append((rng.choice("ab"), i, low, low + rng.choice([0, 0, 3, 7, 8, 63, 64, 65, 500, -1])))
    return out


def test_points_and_overlaps(spark):
    rng = random.Random(2)
    a, b = spans(rng, 120, 900), spans(rng, 150, 900)
    points = [(rng.choice("ab"), i, rng.randrange(1000)) for i in range(200)]
    x, y = spark.createDataFrame(a, "k string, i int, lo int, hi int"), spark.createDataFrame(b, "k string, j int, low int, high int")
    got = intervals.containing(spark.createDataFrame(points, "k string, p int, at int"), y, ["k"], "at", "low", "high").select("p", "j").collect()
    assert Counter(map(tuple, got)) == Counter((p, j) for k, p, at in points for m, j, lo, hi in b if k == m and lo <= at <= hi)
    got = intervals.overlapping(x, y, ["k"], ("lo", "hi"), ("low", "high")).select("i", "j").collect()
    assert Counter(map(tuple, got)) == Counter((i, j) for k, i, lo, hi in a for m, j, s, e in b if k == m and lo <= hi and s <= e and s <= hi and lo <= e)


def test_many_scopes_make_few_candidates(spark):
    """100,000 scopes of one file, nested in blocks of ten, and 20,000 lines: what meets is in the order of what holds."""
    scopes = spark.range(100_000).selectExpr("'f' AS path", "id AS ord", "id AS start_line", "if(id % 10 = 0, id + 9, id) AS end_line")
    points = spark.range(20_000).selectExpr("'f' AS path", "id * 5 AS line")
    binned = intervals.binned(scopes, "start_line", "end_line")
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, intervals.LEVELS)))).withColumn("_bin", F.expr("shiftright(line, _level)"))
    met = asked.join(binned, ["path", "_level", "_bin"]).count()
    held = intervals.containing(points, scopes, ["path"], "line", "start_line", "end_line").count()
    # Lines at the start of a block are in its scope; those in its middle are in a scope of their own too.
    assert held == 30_000 and met <= 6 * held


SCOPES = "review_id int, path string, ord int, name string, qualname string, parent_class string, start_line int, end_line int, is_class boolean"


def loop_scope(at, lo, hi, scopes):
    hits = [(sum(s <= x <= e for x in at), o, n, p, s, e, c) for o, n, p, s, e, c in scopes]
    some = [h for h in hits if h[0]] or [h for h in hits if h[5] >= lo and h[4] <= hi]
    if not some:
        return None, None
    _, o, n, p, s, e, c = min(some, key=lambda h: (h[6], -h[0], h[5] - h[4], h[1]))
    return (None, n) if c else (n, p)


def test_scopes_of_changes_equal_the_loop(spark):
    """Modified, deleted and renamed files; lines that hit, spans that hit, and neither."""
    rng, diffs, scopes, want = random.Random(6), [], [], {}
    for review_id in range(25):
        text = ""
        for f, kind in enumerate(("modified", "deleted", "renamed", "added")):
            path = f"m{f}.py"
            own = []
            for o in range(rng.randrange(6)):
                s = rng.randrange(1, 80)
                own.append((o, f"n{o}", rng.choice([None, "K"]), s, s + rng.choice([0, 3, 20, 60]), rng.random() < 0.3))
            scopes += [(review_id, path, o, n, n, p, s, e, c) for o, n, p, s, e, c in own]
            old = "was.py" if kind == "renamed" else path
            text += f"diff --git a/{old} b/{path}\n" + {"modified": "", "deleted": "deleted file mode 100644\n", "renamed": f"rename from {old}\nrename to {path}\n", "added": "new file mode 100644\n"}[kind]
            for h in range(2):
                start, body, at, n = rng.randrange(1, 90), [], [], 0
                for _ in range(rng.randrange(1, 8)):
                    mark = rng.choice("  -" if kind == "deleted" else "  +" if kind == "added" else " +-")
                    body.append(mark + "x")
                    if mark == ("-" if kind == "deleted" else "+"):
                        at.append(start + n)
                    n += mark in (" -" if kind == "deleted" else " +")
                size = f"{start},{n}"
                text += f"@@ -{size} +{size} @@\n" + "\n".join(body) + "\n"
                want[review_id, path, h] = loop_scope(at, max(1, start), max(1, start, start + max(1, n) - 1), own)
        diffs.append((review_id, text))
    rows = diff.changes(spark.createDataFrame(diffs, "review_id int, diff string"), spark.createDataFrame(scopes, SCOPES)).collect()
    got = {(r.review_id, r.file_path, r.pos % diff.FILE): (r.function_name, r.class_name) for r in rows}
    assert got == want and len({k for k in want.values()}) > 5
    assert {r.change_type for r in rows} == {"modified", "deleted", "renamed", "added"} and {r.old_path for r in rows if r.change_type == "renamed"} == {"was.py"}


def test_diff_of_three_thousand_files(spark):
    text = "".join(f"diff --git a/f{i}.py b/f{i}.py\n@@ -1 +1,2 @@\n x\n+y{i}\n" for i in range(3000))
    rows = diff.changes(spark.createDataFrame([(1, text)], "review_id int, diff string"))
    last = rows.where("file_path = 'f2999.py'").first()
    assert rows.count() == 3000 and last.pos == 2999 * diff.FILE and last.added_lines == ["y2999"]
    out = chunks.chunk_changes(rows).orderBy("group_no").collect()
    assert [r.file_path for r in out] == [f"f{i}.py" for i in range(3000)]


@pytest.mark.parametrize(("files", "name"), [(("a.py", "b.py"), "changes.diff"), (("b.py",), "b.py"), (("x.js",), "changes.diff"), (("a.py", "x.js"), "changes.diff")])
def test_review_of_changes_is_named_by_its_only_python_file(spark, files, name):
    text = "".join(f"diff --git a/{f} b/{f}\n@@ -1 +1,2 @@\n x\n+password = 'hunter2hunter2'\n" for f in files)
    out = review.review_diffs(spark.createDataFrame([(1, text)], "review_id int, diff string"), with_fixes=False)
    assert [r.path for r in out.sanitized.collect()] == [name] and {r.file for r in out.findings.collect()} <= {name}
