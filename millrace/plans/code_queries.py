"""Queries over diffs and sources that are written from the rows of ``part``: the parsers' results are formulas of the row's key.

A template holds ``¤`` where the key goes; both engines make the same text from it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import chunks, diff, findings, graph, search, syntax
from millrace.plans.catalog import query, table
from millrace.sources import store
from millrace.sources.shared import removed, shared_path, stored, wide

KEY = "p_partkey"


def made(template: str, kind: str = "STRING") -> str:
    """SQL text of a template, in the dialect that names strings ``kind``."""
    parts = []
    for n, line in enumerate(template.split("\n")):
        if n:
            parts.append("chr(10)")
        for k, piece in enumerate(line.split("¤")):
            if k:
                parts.append(f"CAST({KEY} AS {kind})")
            if piece:
                parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts or ["''"]) + ")"


def duck(template: str) -> str:
    return made(template, "VARCHAR")


SOURCE = '''import os
from pkg.m import x


class C¤:
    """Doc ¤. More."""

    def m(self):
        def inner():
            return 1
        return inner


@cache
def f¤(x):
    return x
'''
BROKEN = "def f¤(:\n"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``part``, dealt to as many tasks as a shuffle has: the table's one small file is one task else, in which all texts made from it would be parsed."""
    return table(spark, sf_dir, "part").select(KEY).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEY)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a part; every ninth has an error of syntax."""
    text = F.when(F.col(KEY) % 9 == 8, F.expr(made(BROKEN))).otherwise(F.expr(made(SOURCE)))
    return _parts(spark, sf_dir).select(KEY, F.expr(made("src/m¤.py")).alias("path"), text.alias("source"))


VALID = f"(SELECT * FROM part WHERE {KEY} % 9 < 8)"
_PATH = duck("src/m¤.py")
_UNITS = " UNION ALL ".join(
    f"SELECT {KEY}, {_PATH} AS file_path, {duck(name)} AS unit_name, '{kind}' AS unit_type, {parent} AS parent_class, {a} AS start_line, {b} AS end_line, {duck(sig)} AS signature, {duck(doc)} AS docstring, substr(sha256({_PATH} || ':' || {duck(full)}), 1, 16) AS stable_id, {duck(about)} AS summary FROM {VALID}"
    for name, kind, parent, a, b, sig, doc, full, about in (
        ("C¤", "class", "NULL", 5, 11, "class C¤:", "Doc ¤. More.", "C¤", "Class `C¤`. Doc ¤. Defined in `src/m¤.py` at line 5."),
        ("m", "method", duck("C¤"), 8, 11, "    def m(self):", "", "C¤.m", "Method `C¤.m`. Defined in `src/m¤.py` at line 8."),
        ("f¤", "function", "NULL", 15, 16, "def f¤(x):", "", "f¤", "Function `f¤`. Decorators: @cache. Defined in `src/m¤.py` at line 15."),
    )
).replace("\0", "¤")


@query(f"SELECT file_path, unit_name, unit_type, parent_class, start_line, end_line, signature, docstring, stable_id, summary FROM ({_UNITS})")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.units(_sources(spark, sf_dir)).select("file_path", "unit_name", "unit_type", "parent_class", "start_line", "end_line", "signature", "docstring", "stable_id", "summary")


@query(
    f"SELECT stable_id AS id, unit_name AS title, concat_ws(chr(10), substr(summary, 1, 400), nullif(substr(signature, 1, 400), ''), nullif(substr(docstring, 1, 400), '')) AS content, 'codebase' AS category, file_path, unit_type, CAST(start_line AS VARCHAR) AS start_line FROM ({_UNITS})"
)
def unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.unit_documents(syntax.units(_sources(spark, sf_dir)))
    return docs.select("id", "title", "content", "category", *(F.element_at("metadata", F.lit(k)).alias(k) for k in ("file_path", "unit_type", "start_line")))


@query(f"SELECT count(*) AS files, 3 * count(*) AS units, count(*) AS functions, count(*) AS classes, count(*) AS methods, CAST(0 AS BIGINT) AS chunks FROM {VALID}")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.index_summary(syntax.units(_sources(spark, sf_dir)))


_SCOPES = " UNION ALL ".join(
    f"SELECT {KEY}, {_PATH} AS path, {n} AS ord, {duck(name)} AS name, {duck(full)} AS qualname, {parent} AS parent_class, {a} AS start_line, {b} AS end_line, {str(cls).lower()} AS is_class FROM {VALID}"
    for n, name, full, parent, a, b, cls in ((0, "C¤", "C¤", "NULL", 5, 11, True), (1, "m", "C¤.m", duck("C¤"), 8, 11, False), (2, "inner", "C¤.m.inner", duck("C¤"), 9, 10, False), (3, "f¤", "f¤", "NULL", 15, 16, False))
)


@query(f"SELECT path, ord, name, qualname, parent_class, start_line, end_line, is_class FROM ({_SCOPES})")
def source_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.scopes(_sources(spark, sf_dir))


@query(f"SELECT {_PATH} AS path, {KEY} % 9 < 8 AS valid, CASE WHEN {KEY} % 9 = 8 THEN 1 ELSE 0 END AS line, CASE WHEN {KEY} % 9 < 8 THEN 26 ELSE 0 END AS nodes FROM part")
def source_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _sources(spark, sf_dir).select("path", syntax.check_syntax(F.col("source"), F.col("path")).alias("r"))
    return checked.select("path", "r.valid", F.coalesce("r.line", F.lit(0)).alias("line"), "r.nodes")


@query(f"SELECT {_PATH} AS src, m AS module, CASE WHEN m = 'pkg.m' THEN 'src/pkg/m.py' END AS dst FROM {VALID} CROSS JOIN (VALUES ('os'), ('pkg.m')) t(m)")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of every module; one names a package beside the importer, one is external."""
    sources = _sources(spark, sf_dir)
    found = syntax.imports(sources).withColumn("drop_unresolved", F.lit(False))
    found = found.withColumn("candidates", graph.python_candidates(F.col("src"), F.col("module")))
    paths = sources.select("path").unionByName(spark.createDataFrame([("src/pkg/m.py",)], "path string"))
    return graph.resolve(found, paths).select("src", "module", "dst")


_ASKED = f"(SELECT * FROM {VALID} WHERE {KEY} % 20 = 0)"


@query(f"SELECT {KEY} AS qid, 1 AS rank, CAST(1.0 AS DOUBLE) AS relevance FROM {_ASKED}")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit embedded and indexed; each function of an id divisible by 20 is asked for by its own document, whose vector is its nearest."""
    index, table_path = stored(search.index_rows(syntax.units(_sources(spark, sf_dir))), "index")
    path = F.element_at("metadata", F.lit("file_path"))
    own = index.where("title like 'f%'").withColumn("qid", F.regexp_extract(path, r"(\d+)", 1).cast("long")).where("qid % 20 = 0")
    asked = own.select("qid", F.concat_ws("\n", "title", "content").alias("query"))
    asked, asked_path = stored(asked, "asked")
    out, _ = stored(search.search_codebase(asked, index, 1).select("qid", "rank", "relevance"), "hits")
    removed(spark, table_path, asked_path)
    return out


SLOTS = 32


class BySlot(search.Embedder):
    """A model whose texts are equal or at right angles: by the first number in them."""

    def embed(self, texts: list[str]) -> np.ndarray:
        numbers = [int((re.findall(r"\d+", t) or ["0"])[0]) for t in texts]
        return np.eye(SLOTS, dtype="f4")[[n % SLOTS for n in numbers]]


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """A stored index of all units and its path, the functions that are asked for (ids divisible by 20), and imports: each module's of the one that many keys on."""
    index, path = stored(search.index_rows(syntax.units(_sources(spark, sf_dir)), BySlot), "index")
    valid = table(spark, sf_dir, "part").where(f"{KEY} % 9 < 8")
    asked = valid.where(f"{KEY} % 20 = 0").select(F.col(KEY).cast("long").alias("qid"), F.expr(made("f¤")).alias("function_name"), F.expr(made("src/m¤.py")).alias("file_path"), F.array(F.lit("return x")).alias("added_lines"))
    edges = valid.select(F.expr(made("src/m¤.py")).alias("src"), F.expr(f"concat('src/m', CAST({KEY} + {SLOTS} AS STRING), '.py')").alias("dst"))
    return index, path, asked, edges


#: Units in the function's slot by id; seven are fetched, its own is left out, three are kept.
_NEAR = (
    f"WITH u AS (SELECT {KEY} AS k, stable_id AS id, unit_name AS title, file_path, concat_ws(chr(10), substr(summary, 1, 400), nullif(substr(signature, 1, 400), ''), nullif(substr(docstring, 1, 400), '')) AS content FROM ({_UNITS})), "
    f"h AS (SELECT q.{KEY} AS qid, u.*, row_number() OVER (PARTITION BY q.{KEY} ORDER BY u.id) AS fetched FROM {_ASKED} q JOIN u ON u.k % {SLOTS} = q.{KEY} % {SLOTS}), "
    f"n AS (SELECT qid, k, id, title, file_path, content, row_number() OVER (PARTITION BY qid ORDER BY fetched) AS rank FROM h WHERE fetched <= 7 AND NOT (k = qid AND title = 'f' || qid) QUALIFY rank <= 3)"
)


@query(f"{_NEAR} SELECT CAST(qid AS BIGINT) AS qid, id, CAST(rank AS INT) AS rank, CAST(1.0 AS DOUBLE) AS relevance, k = qid + {SLOTS} AS is_direct_dependency, k + {SLOTS} = qid AS is_dependent FROM n")
def function_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related units of functions, with their relation by imports. The functions aren't members of the index; their queries are made from name, file and code."""
    index, path, asked, edges = _slots(spark, sf_dir)
    out, _ = stored(search.retrieve_for_function(asked, index, edges, make=BySlot).select("qid", "id", "rank", "relevance", "is_direct_dependency", "is_dependent"), "neighbours")
    removed(spark, path)
    return out


@query(
    f"{_NEAR}, r AS (SELECT qid, rank, '#### `' || title || '` in `' || file_path || '` - 100%' || CASE WHEN k = qid + {SLOTS} THEN ' (direct dependency)' WHEN k + {SLOTS} = qid THEN ' (caller)' ELSE '' END || chr(10) || content AS text FROM n), "
    "c AS (SELECT *, greatest(1, length(text) // 4) AS tokens, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM r) "
    "SELECT CAST(qid AS BIGINT) AS review_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS units, sum(tokens)::BIGINT AS tokens FROM c WHERE used <= 60 GROUP BY qid"
)
def change_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of reviews of one changed function: units claimed in order, as many as sixty tokens allow."""
    index, path, asked, edges = _slots(spark, sf_dir)
    changes = asked.withColumnRenamed("qid", "review_id").withColumn("pos", F.lit(0))
    out = search.retrieve_for_changes(changes, index, edges, max_tokens=60, make=BySlot).select("review_id", "context", "units", "tokens")
    removed(spark, path)  # the contexts are stored
    return out


@query(f"SELECT 3 * (SELECT count(*) FROM {VALID}) AS first_run, CAST(0 AS BIGINT) AS second_run, 3 * (SELECT count(*) FROM {VALID}) AS unchanged, (SELECT count(*) FROM {VALID} WHERE {KEY} % 5 = 0) AS changed, (SELECT count(*) FROM {VALID} WHERE {KEY} % 5 = 0) AS removed, 3 * (SELECT count(*) FROM {VALID}) - (SELECT count(*) FROM {VALID} WHERE {KEY} % 5 = 0) AS held, (SELECT count(*) FROM part WHERE {KEY} % 9 = 8) AS errors")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over all sources, built, built again, and built after every fifth module lost a function and has its class described anew."""
    target = search.index_table(spark, shared_path(spark, "index-runs"))
    sources = _sources(spark, sf_dir).select(KEY, "path", "source")
    one, two = (search.index_codebase(sources.drop(KEY), target) for _ in range(2))
    edited = F.when((F.col(KEY) % 5 == 0) & (F.col(KEY) % 9 < 8), F.regexp_replace(F.regexp_replace("source", r"(?s)\n\n\n@cache.*", "\n"), "Doc", "Text")).otherwise(F.col("source"))
    three = search.index_codebase(sources.select("path", edited.alias("source")), target)
    counts = (one.written, two.written, two.unchanged, three.written, three.removed, target.count(), three.errors.count())
    removed(spark, target.path)
    return spark.createDataFrame([counts], "first_run long, second_run long, unchanged long, changed long, removed long, held long, errors long")


HUNKS = (
    "@@ -8,2 +8,4 @@\n     def m(self):\n+        a = 1\n+        b = 2\n-        z = 0\n         return a",
    "@@ -9,0 +10,1 @@\n+            c = ¤",
    "@@ -14,1 +15,2 @@\n def f¤(x):\n+    return 2",
    "@@ -40 +41 @@\n-old ¤\n+new ¤",
)
HEAD = "diff --git a/src/m¤.py b/src/m¤.py\nindex 1..2 100644\n--- a/src/m¤.py\n+++ b/src/m¤.py\n"
SCRIPT = "diff --git a/web/x¤.js b/web/x¤.js\nnew file mode 100644\n--- /dev/null\n+++ b/web/x¤.js\n"
SCRIPT_HUNK = "@@ -0,0 +1,2 @@\n+function go¤() {\n+}"


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff a part: four hunks in its module, and every fifth adds a script."""
    text = F.expr(made(HEAD + "\n".join(HUNKS) + "\n"))
    text = F.concat(text, F.when(F.col(KEY) % 5 == 0, F.expr(made(SCRIPT + SCRIPT_HUNK + "\n"))).otherwise(F.lit("")))
    return _parts(spark, sf_dir).where(f"{KEY} % 9 < 8").select(F.col(KEY).alias("review_id"), text.alias("diff"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = syntax.scopes(_sources(spark, sf_dir)).join(wide(_sources(spark, sf_dir).select(F.col(KEY).alias("review_id"), "path")), "path")
    return diff.changes(_diffs(spark, sf_dir), scopes)


_C = duck("C¤")
#: pos, file, type, python, function, class, old start and lines, new start and lines, added, removed, text.
_CHANGE_ROWS = (
    (0, "src/m¤.py", "modified", "inner", _C, 8, 2, 8, 4, 2, 1, HUNKS[0]), (1, "src/m¤.py", "modified", "inner", _C, 9, 0, 10, 1, 1, 0, HUNKS[1]), (2, "src/m¤.py", "modified", "f¤", "NULL", 14, 1, 15, 2, 1, 0, HUNKS[2]),
    (3, "src/m¤.py", "modified", None, "NULL", 40, 1, 41, 1, 1, 1, HUNKS[3]), (diff.FILE, "web/x¤.js", "added", "go¤", "NULL", 0, 0, 1, 2, 2, 0, SCRIPT_HUNK),
)
_CHANGES = " UNION ALL ".join(
    f"SELECT {KEY} AS review_id, {KEY}, CAST({pos} AS BIGINT) AS pos, {duck(path)} AS file_path, '{kind}' AS change_type, {str(path.endswith('.py')).lower()} AS is_python, {duck(f) if f else 'NULL'} AS function_name, {cls} AS class_name, {a} AS old_start, {b} AS old_lines, {x} AS new_start, {y} AS new_lines, {p} AS n_added, {m} AS n_removed, {duck(text)} AS diff_content "
    f"FROM {VALID}{' WHERE ' + KEY + ' % 5 = 0' if pos >= diff.FILE else ''}"
    for pos, path, kind, f, cls, a, b, x, y, p, m, text in _CHANGE_ROWS
)


@query(f"SELECT review_id, pos, file_path, change_type, is_python, function_name, class_name, old_start, old_lines, new_start, new_lines, n_added, n_removed, diff_content FROM ({_CHANGES})")
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks with the innermost scope of their added lines, from parsed sources; scripts by their text."""
    rows = _changes(spark, sf_dir)
    return rows.select(
        "review_id", "pos", "file_path", "change_type", "is_python", "function_name", "class_name", "old_start", "old_lines", "new_start", "new_lines",
        F.size("added_lines").alias("n_added"), F.size("removed_lines").alias("n_removed"), "diff_content",
    )


@query(f"SELECT review_id, count(DISTINCT file_path) AS files, count(DISTINCT file_path) FILTER (is_python) AS python_files, sum(n_added)::BIGINT AS additions, sum(n_removed)::BIGINT AS deletions FROM ({_CHANGES}) GROUP BY review_id")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.totals(_diffs(spark, sf_dir))


@query(
    f"WITH c AS ({_CHANGES}), f AS (SELECT review_id, file_path, function_name, min(pos) AS pos FROM c WHERE function_name IS NOT NULL GROUP BY ALL) SELECT c.review_id, c.file_path, any_value(change_type) AS change_type, count(*) AS hunks, sum(n_added)::BIGINT AS additions, sum(n_removed)::BIGINT AS deletions, "
    "(SELECT string_agg(function_name, ',' ORDER BY pos) FROM f WHERE f.review_id = c.review_id AND f.file_path = c.file_path) AS functions FROM c GROUP BY c.review_id, c.file_path"
)
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.by_file(_changes(spark, sf_dir)).withColumn("functions", F.array_join("functions", ","))


_SCOPE = "CASE WHEN function_name IS NULL THEN '<module>' WHEN class_name IS NULL THEN function_name ELSE class_name || '.' || function_name END"
#: Neighbours of one file and scope are one chunk: a change of either opens the next.
_CHUNKS = (
    f"WITH c AS (SELECT *, {_SCOPE} AS scope FROM ({_CHANGES})), o AS (SELECT *, CASE WHEN lag(file_path || scope) OVER w IS NOT DISTINCT FROM file_path || scope THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY review_id ORDER BY pos)), "
    "g AS (SELECT *, sum(opens) OVER (PARTITION BY review_id ORDER BY pos) AS group_no FROM o), "
    "k AS (SELECT review_id, CAST(group_no AS INT) AS group_no, any_value(file_path) AS file_path, any_value(change_type) AS change_type, any_value(scope) AS scope, min(old_start) AS old_start, CAST(sum(old_lines) AS INT) AS old_lines, min(new_start) AS new_start, CAST(sum(new_lines) AS INT) AS new_lines, "
    "CAST(sum(n_added) AS INT) AS n_added, CAST(sum(n_removed) AS INT) AS n_removed, string_agg(diff_content, chr(10) || chr(10) ORDER BY pos) AS diff_content FROM g GROUP BY review_id, group_no)"
)


@query(f"{_CHUNKS} SELECT *, CAST(greatest(1, length(diff_content) // 4) AS INT) AS estimated_tokens, substr(sha256(file_path || ':' || scope || ':' || old_start || ':' || new_start), 1, 12) AS chunk_id FROM k")
def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.chunk_changes(_changes(spark, sf_dir))
    return rows.select(
        "review_id", F.col("group_no").cast("int").alias("group_no"), "file_path", "change_type", "scope", "old_start", "old_lines", "new_start", "new_lines", F.size("added_lines").alias("n_added"), F.size("removed_lines").alias("n_removed"),
        "diff_content", "estimated_tokens", "chunk_id",
    )


@query(
    f"{_CHUNKS}, t AS (SELECT *, sum(greatest(1, length(diff_content) // 4)) OVER (PARTITION BY review_id ORDER BY group_no) AS cum, count(*) OVER (PARTITION BY review_id) AS total FROM k), "
    "s AS (SELECT *, '### File: `' || file_path || '`' || chr(10) || '- **Scope**: `' || scope || '`' || chr(10) || '- **Change Type**: `' || change_type || '`' || chr(10) || '- **Lines: -' || old_start || ',' || old_lines || ' +' || new_start || ',' || new_lines || '** (+' || n_added || ' / -' || n_removed || ' lines)' || chr(10) || chr(10) "
    "|| '```diff' || chr(10) || diff_content || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS body FROM t WHERE group_no = 1 OR cum <= 60) "
    f"SELECT review_id, {duck(chunks.HEAD)} || string_agg(body, '' ORDER BY group_no) || CASE WHEN max(total) > count(*) THEN chr(10) || '> [!NOTE]' || chr(10) || '> Truncated ' || (max(total) - count(*)) || ' additional review chunk(s) to stay within the token budget (60 tokens).' || chr(10) ELSE '' END AS payload, max(total) - count(*) AS truncated FROM s GROUP BY review_id"
)
def review_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the chunks within sixty tokens."""
    return chunks.payload(chunks.chunk_changes(_changes(spark, sf_dir)), max_tokens=60).select("review_id", "payload", F.col("truncated").cast("long").alias("truncated"))


#: Severity and confidence of a record by its order; files, titles and lines keep groups apart, so leaders are first records of equal fingerprints.
_SEV = "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
_SEV_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END"
_CONF = "CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
_CONF_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_W = "PARTITION BY review_id, file ORDER BY ordinal"
_BEFORE = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH i AS (SELECT o_orderkey AS pos, o_custkey AS l_partkey, o_orderkey // 3 + o_custkey % 2 AS l_suppkey, o_orderkey % 7 AS l_linenumber FROM orders), l AS (SELECT pos // 97 AS review_id, pos, 'file' || (l_partkey % 3) || '.py' AS file, {_SEV} AS severity, {_CONF} AS confidence, 'tool' || (l_suppkey % 4) AS tool, CASE WHEN l_partkey % 3 = 1 THEN 'CWE-' || (l_suppkey % 5) END AS cwe_id,
      'reason ' || chr(CAST(97 + l_suppkey % 3 AS INT)) AS reasoning, repeat('x', CAST(l_partkey % 7 AS INT)) AS fix, l_partkey, l_suppkey FROM i),
    o AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS ordinal, {_SEV_RANK} AS sr, {_CONF_RANK} AS cr FROM l),
    r AS (SELECT *, max(sr) {_BEFORE} AS sr0, max(cr) {_BEFORE} AS cr0, row_number() OVER ({_W}) AS n, row_number() OVER (PARTITION BY review_id, file, tool ORDER BY ordinal) AS tn, row_number() OVER (PARTITION BY review_id, file, reasoning ORDER BY ordinal) AS rn, arg_max(severity, sr * 100000 - ordinal) {_BEFORE} AS held FROM o),
    m AS (SELECT review_id, file, min(ordinal) AS ordinal, count(*) AS duplicate_count, arg_max(severity, sr * 100000 - ordinal) AS severity, max(sr) AS sr, arg_max(confidence, cr * 100000 - ordinal) AS confidence, max(cr) AS cr, arg_max(tool, cr * 100000 - ordinal) AS primary_tool, string_agg(CASE WHEN tn = 1 THEN tool END, ',' ORDER BY ordinal) AS source_tools,
      arg_min(cwe_id, ordinal) AS cwe_id, string_agg(CASE WHEN rn = 1 THEN CASE WHEN n = 1 THEN reasoning ELSE '[' || tool || '] ' || reasoning END END, chr(10) || chr(10) ORDER BY ordinal) AS reasoning, arg_max(fix, length(fix) * 100000 - ordinal) AS suggested_remediation,
      coalesce(string_agg(CASE WHEN n > 1 THEN CASE WHEN sr > sr0 THEN 'Severity elevated from ' || held || ' → ' || severity || ' by ' || tool || '.' || chr(10) ELSE '' END || 'Absorbed duplicate from ' || tool || ' (similarity/overlap detected).' END, chr(10) ORDER BY ordinal), '') AS notes FROM r GROUP BY review_id, file)
    SELECT review_id, file, CAST(duplicate_count AS INT) AS duplicate_count, severity, confidence, primary_tool, source_tools, cwe_id, reasoning, suggested_remediation, notes, substr(sha256('weak hash in ' || replace(file, '.', ' ') || '|' || file || '|7'), 1, 16) AS fingerprint,
      CAST(row_number() OVER (PARTITION BY review_id ORDER BY sr DESC, cr DESC, ordinal) AS INT) AS rank FROM m"""
)
def merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three files a review, merged to one a file: severity, confidence, tools, reasons, remediation, notes, order."""
    item = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pos", "o_custkey AS l_partkey", "o_orderkey div 3 + o_custkey % 2 AS l_suppkey", "o_orderkey % 7 AS l_linenumber")
    file = F.expr("concat('file', l_partkey % 3, '.py')")
    rows = item.select(
        F.expr("pos div 97").alias("review_id"), "pos", file.alias("file"), F.concat(F.lit("Weak hash in "), file).alias("title"), F.lit("").alias("description"),
        F.expr(_SEV).alias("severity"), F.expr(_CONF).alias("confidence"), F.expr("concat('tool', l_suppkey % 4)").alias("tool"), F.expr("CASE WHEN l_partkey % 3 = 1 THEN concat('CWE-', l_suppkey % 5) END").alias("cwe_id"),
        F.expr("concat('reason ', chr(97 + l_suppkey % 3))").alias("reasoning"), F.expr("repeat('x', cast(l_partkey % 7 as int))").alias("suggested_remediation"), F.lit(7).alias("line_number"), F.lit("").alias("affected_code"), F.lit("security").alias("category"),
    )
    rows = findings.normalise(rows, "security")
    none = rows.where("false")
    merged = findings.aggregate(none, rows, none)
    return merged.select(
        "review_id", "file", "duplicate_count", "severity", "confidence", "primary_tool", F.array_join("source_tools", ",").alias("source_tools"), "cwe_id", "reasoning", "suggested_remediation",
        F.array_join("merge_notes", "\n").alias("notes"), "fingerprint", "rank",
    )


