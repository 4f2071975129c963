"""Queries over diffs, trees of sources and reviews that are written from the rows of ``part``: a template holds ``¤`` where the key goes.

The shapes that the other templates lack: added, deleted and renamed files, scripts, imports between folders, whole reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diff, findings, providers, report, rubric
from millrace.plans.catalog import query, table
from millrace.plans.code_queries import KEY, duck, made
from millrace.plans.pull import import_edges
from millrace.sources.code import from_map

DIFF = """diff --git a/pay¤.py b/pay¤.py
index 1..2 100644
--- a/pay¤.py
+++ b/pay¤.py
@@ -5,2 +5,3 @@ def refund¤(x):
 a = 1
+b = 2
 c = 3
@@ -9 +10,2 @@
-d = 4
+d = 5
+e = 6
diff --git a/new¤.js b/new¤.js
new file mode 100644
--- /dev/null
+++ b/new¤.js
@@ -0,0 +1,2 @@
+function go¤() {
+}
diff --git a/old¤.py b/old¤.py
deleted file mode 100644
--- a/old¤.py
+++ /dev/null
@@ -1,2 +0,0 @@
-def gone¤():
-    pass
diff --git a/a¤.txt b/b¤.txt
similarity index 100%
rename from a¤.txt
rename to b¤.txt
"""
SOURCES = {
    "utils¤.py": "import os\n\n\ndef helper(x):\n    \"\"\"Helps. A lot.\"\"\"\n    return os.path.join(x)\n",
    "pkg/utils¤.py": "VALUE = 1\n",
    "pkg/__init__.py": "",
    "pkg/a¤.py": "import utils¤\nfrom pkg import a¤\n\n\nclass Pay:\n    def refund(self):\n        return utils¤.helper('x')\n",
    "web/app¤.js": "import {x} from './lib¤'\nconst y = require('react')\n",
    "web/lib¤.ts": "export const x = 1\n",
    "bad¤.py": "def broken(:\n",
}


def filled(template: str, key: str = "") -> str:
    return template.replace("¤", key)


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col(KEY).alias("review_id"), F.expr(made(DIFF)).alias("diff"))


_ROWS = (
    ("pay¤.py", "modified", "refund¤", None, 5, 2, 5, 3, 1, 0), ("pay¤.py", "modified", None, None, 9, 1, 10, 2, 2, 1), ("new¤.js", "added", "go¤", None, 0, 0, 1, 2, 2, 0), ("old¤.py", "deleted", "gone¤", None, 1, 2, 0, 0, 0, 2),
)
_PARSED = " UNION ALL ".join(
    f"SELECT {KEY} AS review_id, {duck(path)} AS file_path, '{kind}' AS change_type, {duck(f) if f else 'NULL'} AS function_name, {', '.join(f'{v} AS {n}' for n, v in zip(('old_start', 'old_lines', 'new_start', 'new_lines', 'n_added', 'n_removed'), numbers, strict=True))} FROM part"
    for path, kind, f, _, *numbers in _ROWS
)


@query(_PARSED)
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.changes(_diffs(spark, sf_dir))
    return rows.select("review_id", "file_path", "change_type", "function_name", "old_start", "old_lines", "new_start", "new_lines", F.size("added_lines").alias("n_added"), F.size("removed_lines").alias("n_removed"))


@query(f"SELECT {KEY} AS review_id, CAST(4 AS BIGINT) AS files, CAST(2 AS BIGINT) AS python_files, CAST(5 AS BIGINT) AS additions, CAST(3 AS BIGINT) AS deletions FROM part")
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.totals(_diffs(spark, sf_dir))


_EDGES = (("pkg/a¤.py", "utils¤.py"), ("pkg/a¤.py", "pkg/__init__.py"), ("web/app¤.js", "web/lib¤.ts"), ("utils¤.py", None), ("web/app¤.js", None))


@query(" UNION ALL ".join(f"SELECT {duck(a)} AS src, {duck(b) if b else 'NULL'} AS dst FROM part" for a, b in _EDGES))
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of seven files a part: a module at the root before the one beside the importer, a package, a script without its suffix, an external one."""
    files = F.array(*(F.struct(F.expr(made(k)).alias("path"), F.expr(made(v)).alias("source")) for k, v in SOURCES.items() if "¤" in k))
    rows = table(spark, sf_dir, "part").select(F.explode(files).alias("f")).select("f.path", "f.source")
    return import_edges(rows.unionByName(from_map(spark, {k: v for k, v in SOURCES.items() if "¤" not in k}))).select("src", "dst")


REPORT = """# 🔍 Code Review Report — `a¤.py`

---

## 📊 Summary

| Metric | Value |
|--------|-------|
| Total Findings | **1** |
| Highest Severity | **🟡 MEDIUM** |
| Secrets Detected | `0` |
| Sanitization Applied | ✅ Yes |
| 🟡 Medium | 1 |

---

## 🚨 Findings

### 🟡 Medium (1)

#### 1. Use of eval

**Tool(s)**: `stub` | **File**: `a¤.py` | **Line**: `1` | **Confidence**: `medium` *(reclassified from `high`)*



<details><summary>Aggregation notes</summary>

- Absorbed duplicate from stub (similarity/overlap detected).
- Severity reclassified from high → medium by rubric.

</details>

---

"""


@query(f"SELECT {KEY} AS review_id, CAST(1 AS BIGINT) AS total_findings, 'medium' AS highest_severity, {duck(REPORT)} AS report FROM part")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col(KEY).alias("review_id"), F.expr(made("a¤.py")).alias("path"))
    security = findings.normalise(providers.scan(parts.withColumn("source", F.lit("eval(x)\nexec(y)\n"))).withColumn("description", F.lit("")), "security")
    none = security.where("false")
    graded = rubric.classify(findings.aggregate(none, security, none))
    return report.render(graded, parts.select("review_id", F.col("path").alias("filename"), F.lit(0).alias("secrets"), F.lit(True).alias("sanitized")))
