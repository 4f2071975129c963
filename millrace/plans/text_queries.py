"""Queries over documents, conversations, benchmark and pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks, graph, ordered, redact, retrieval, rubric
from millrace.plans.catalog import query, table
from millrace.schema import lookup

def _other_dialect(pattern: str) -> str:
    """The rule for an engine without look-arounds: what precedes a value is matched with it, and a greedy value ends where its letters do."""
    pattern = re.sub(r"\(\?<!\[(.*?)\]\)", r"(?:^|[^\1])", pattern)
    return re.sub(r"\(\?!\[.*?\]\)$", "", pattern).replace("'", "''")


def _rule_sql(n: int) -> str:
    """Hits of one rule; offsets come from gaps and matches numbered in order, a value ends its match but for a closing quote."""
    kind, severity, _, pattern = redact.RULES[n]
    p, tail = _other_dialect(pattern), 1 if pattern.endswith("""['"]""") else 0
    return rf"""SELECT doc_id, t, '{kind}' AS kind, '{severity}' AS severity, {n} AS rule, value, CAST(stop - {tail} AS INT) AS stop, CAST(stop - {tail} - length(value) AS INT) AS start FROM (
  SELECT doc_id, t, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, t, unnest(m) AS hit, unnest(v) AS value, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM (
      SELECT doc_id, text AS t, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', 1) AS v, string_split_regex(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}'))))"""


HITS = "hits AS (" + " UNION ALL ".join(map(_rule_sql, range(len(redact.RULES)))) + r"""),
lined AS (SELECT *, CAST(length(substr(t, 1, start)) - length(replace(substr(t, 1, start), chr(10), '')) + 1 AS INT) AS line, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sev FROM hits),
winners AS (SELECT * FROM lined QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY sev DESC, start, rule) = 1)"""
MASKED = "CASE WHEN length(value) <= 4 THEN '****' ELSE substr(value, 1, 4) || repeat('*', least(length(value) - 4, 12)) END"
MARK = "'<REDACTED_' || upper(kind) || '_L' || line || '>'"


@query(f"WITH {HITS} SELECT doc_id, kind, severity, line, start, stop, {MASKED} AS masked, {MARK} AS placeholder FROM lined")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "kind", "severity", "line", "start", "stop", "masked", "placeholder")


@query(f"WITH {HITS} SELECT doc_id, line, kind, start FROM winners")
def secret_best_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.best_per_line(redact.detect(table(spark, sf_dir, "documents"))).select("doc_id", "line", "kind", "start")


@query(
    f"WITH {HITS}, chosen AS (SELECT DISTINCT l.doc_id, l.start, l.stop, {MARK.replace('kind', 'l.kind').replace('line', 'l.line')} AS mark FROM lined l JOIN winners w ON w.doc_id = l.doc_id AND w.line = l.line AND w.kind = l.kind), "
    "spans AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM chosen), "
    "one AS (SELECT s.doc_id, string_agg(CASE WHEN start >= prev THEN substr(text, CAST(prev + 1 AS BIGINT), CAST(start - prev AS BIGINT)) || mark ELSE '' END, '' ORDER BY start, stop) AS head, max(stop) AS last FROM spans s JOIN documents d ON d.doc_id = s.doc_id GROUP BY s.doc_id), "
    "n AS (SELECT doc_id, count(*) AS n, arg_max(severity, sev) AS highest FROM winners GROUP BY doc_id) "
    "SELECT d.doc_id, CASE WHEN one.doc_id IS NULL THEN text ELSE head || substr(text, last + 1) END AS sanitized, coalesce(n, 0) AS n_secrets, highest FROM documents d LEFT JOIN one USING (doc_id) LEFT JOIN n USING (doc_id)"
)
def secret_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.sanitize(table(spark, sf_dir, "documents")).select("doc_id", "sanitized", "n_secrets", "highest")


@query(f"WITH {HITS}, levels(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low')) SELECT l.severity, count(w.doc_id) AS n FROM levels l LEFT JOIN winners w ON w.severity = l.severity GROUP BY l.severity")
def secret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners are counted within the row that holds them."""
    found = redact.sanitize(table(spark, sf_dir, "documents")).select(F.explode("findings.severity").alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    levels = spark.createDataFrame([(x,) for x in redact.SECRET_RANK], "severity string")
    return levels.join(found, "severity", "left").na.fill(0, ["n"])


@query("SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Code' END AS language, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lookup({"en": "English", "fr": "French", "de": "German"}, F.col("lang"), "Code")
    return table(spark, sf_dir, "documents").groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), t AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM l), "
    "n AS (SELECT doc_id, p, CAST(ceil(len(p) / 20.0) AS INT) AS n FROM t WHERE len(p) > 0), b AS (SELECT doc_id, p, n, unnest(range(1, n + 1)) AS block FROM n) "
    "SELECT doc_id, CAST(block AS INT) AS block, n, 'chunk_' || lpad(CAST(block AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0') AS unit_name, CAST((block - 1) * 20 + 1 AS INT) AS start_line, CAST(least(block * 20, len(p)) AS INT) AS end_line, "
    "substr(sha256('doc' || doc_id || ':chunk_' || lpad(CAST(block AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0')), 1, 16) AS stable_id, substr(array_to_string(p[(block - 1) * 20 + 1 : block * 20], chr(10)), 1, 2000) AS snippet FROM b"
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "text")
    out = chunks.line_blocks(docs, "path", "text", 20)
    return out.select(F.substring("file_path", 4, 30).cast("long").alias("doc_id"), "block", "n", "unit_name", "start_line", "end_line", "stable_id", "snippet")


@query("SELECT conv_id, turn, '```text' || chr(10) || array_to_string(list_transform(range(1, len(p) + 1), lambda i: format('{:4d} | {}', i, p[i])), chr(10)) || chr(10) || '```' AS block FROM (SELECT conv_id, turn, CASE WHEN q[len(q)] = '' THEN q[1:len(q)-1] ELSE q END AS p FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS q FROM conversations))")
def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.format_code(F.col("text"), F.lit("turn.txt")).alias("block"))


NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, substr(sha256({NORMAL} || '|' || source || '|' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id % 7 AS VARCHAR) END), 1, 16) AS fingerprint, substr(sha256(source || ':' || doc_id), 1, 16) AS stable_id, substr(sha256(source || ':' || lang || ':' || doc_id || ':' || n_chars), 1, 12) AS chunk_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.fingerprint(c("text"), c("source"), c("doc_id") % 7).alias("fingerprint"), T.stable_id(c("source"), c("doc_id").cast("string")).alias("stable_id"),
        T.chunk_id(c("source"), c("lang"), c("doc_id"), c("n_chars")).alias("chunk_id"),
    )


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.length("text")).alias("tokens"))


@query(f"SELECT doc_id, {NORMAL} AS title, len(list_distinct(list_filter(string_split({NORMAL}, ' '), lambda x: x <> ''))) AS tokens FROM documents")
def normalise_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_title(text).alias("title"), F.size(T.title_tokens(text)).cast("long").alias("tokens"))


@query(
    f"WITH b AS (SELECT item_id, list_distinct(list_filter(string_split({NORMAL}, ' '), lambda x: x <> '')) AS t FROM benchmark), w AS (SELECT item_id, unnest(t) AS w FROM b), n AS (SELECT item_id, len(t) AS n FROM b), "
    "p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS k FROM w x JOIN w y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL) "
    "SELECT p.a, p.b, round(k / CAST(na.n + nb.n - k AS DOUBLE), 6) AS jaccard FROM p JOIN n na ON na.item_id = p.a JOIN n nb ON nb.item_id = p.b WHERE k / CAST(na.n + nb.n - k AS DOUBLE) >= 0.08"
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items meet on shared tokens; the benchmark is a small reference table."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.title_tokens(F.col("text")).alias("t"))
    words = rows.select("item_id", F.explode("t").alias("w"), F.size("t").alias("n"))
    x, y = (words.select(F.col("item_id").alias(s), "w", F.col("n").alias(f"n{s}")) for s in "ab")
    both = x.join(y, "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return both.where(j >= 0.08).select("a", "b", F.round(j, 6).alias("jaccard"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _rubric_sql(rules, corpus: str, category: str, fallback: str) -> tuple[str, str]:
    def clause(r) -> str:
        any_term = " OR ".join(f"contains({corpus}, '{t}')" for t in r.terms)
        cats = f"{category} IN ({', '.join(repr(c) for c in r.categories)}) AND " if r.categories else ""
        return f"WHEN {cats}({any_term})"

    return "CASE " + " ".join(f"{clause(r)} THEN '{r.severity}'" for r in rules) + f" ELSE {fallback} END", "CASE " + " ".join(f"{clause(r)} THEN {n}" for n, r in enumerate(rules)) + " END"


#: Titles, descriptions and so on are parts of the text here; the category is made from the id.
_DOC_SEV, _DOC_RULE = _rubric_sql(rubric.RUBRIC, "lower(text)", "(CASE doc_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'security' ELSE 'business_logic' END)", "CASE WHEN doc_id % 5 = 0 THEN 'high' WHEN doc_id % 5 = 1 THEN 'medium' ELSE 'low' END")


def _doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    reported = F.expr("CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END")
    category = F.expr("CASE doc_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'security' ELSE 'business_logic' END")
    return table(spark, sf_dir, "documents").select(
        "doc_id", empty.alias("title"), F.col("text").alias("description"), empty.alias("affected_code"), empty.alias("reasoning"), category.alias("category"),
        reported.alias("reported_severity"), reported.alias("severity"), F.array().cast("array<string>").alias("merge_notes"),
    )


@query(f"SELECT doc_id, {_DOC_SEV} AS severity, {_DOC_SEV} <> (CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END) AS changed FROM documents")
def severity_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.classify(_doc_findings(spark, sf_dir)).select("doc_id", "severity", "changed")


PART_RULES = (
    rubric.Rule("critical", ("red", "blue"), "first"), rubric.Rule("high", ("part 1", "steel"), "second", ("ECONOMY", "PROMO")), rubric.Rule("medium", ("9",), "third"), rubric.Rule("low", ("2", "tin"), "fourth"),
)
_PART_SEV, _PART_RULE = _rubric_sql(PART_RULES, "lower(p_name)", "p_type", "'info'")


@query(f"SELECT p_partkey, {_PART_SEV} AS severity, coalesce({_PART_RULE}, -1) AS rule FROM part")
def part_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rubric.first_rule(F.lower("p_name"), F.col("p_type"), PART_RULES)
    level = F.coalesce(F.get(F.array(*(F.lit(r.severity) for r in PART_RULES)), rule), F.lit("info"))
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("severity"), F.coalesce(rule, F.lit(-1)).alias("rule"))


@query(
    "WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS s FROM conversations), "
    "f AS (SELECT conv_id, p, s AS size, 1 AS g FROM o WHERE p = 1 UNION ALL SELECT o.conv_id, o.p, CASE WHEN f.size + o.s > 900 THEN o.s ELSE f.size + o.s END, CASE WHEN f.size + o.s > 900 THEN f.g + 1 ELSE f.g END FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p + 1) "
    "SELECT f.conv_id, CAST(g AS INT) AS group_no, count(*) AS turns, CAST(sum(o.s) AS BIGINT) AS chars FROM f JOIN o ON o.conv_id = f.conv_id AND o.p = f.p GROUP BY f.conv_id, g"
)
def char_budget_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.greedy_groups(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.lit("conversation"), F.length("text"), 900)
    return rows.groupBy("conv_id", F.col("group_no").cast("int").alias("group_no")).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def _budget_sql(keep: str) -> str:
    return f"SELECT conv_id, turn, tokens, rn, total FROM (SELECT conv_id, turn, tokens, row_number() OVER w AS rn, sum(tokens) OVER w AS cum, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE {keep}"


def _budget(spark: SparkSession, sf_dir: str, keep_first: bool) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.length("text")).cast("long").alias("tokens"))
    return chunks.within_budget(rows, ["conv_id"], ["turn"], "tokens", 120, keep_first).select("conv_id", "turn", "tokens", F.col("rn").cast("long").alias("rn"), "total")


@query(_budget_sql("rn = 1 OR cum <= 120"))
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, True)


@query(_budget_sql("cum <= 120"))
def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, False)


LINKS = "l AS (SELECT 'page' || page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages), e AS (SELECT DISTINCT src, dst FROM l)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("ord", "dst")
    src = F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("src")
    return graph.edges(table(spark, sf_dir, "pages").select(src, found))


@query(f"WITH {LINKS} SELECT src, dst FROM e")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("src", "dst")


@query(f"WITH {LINKS} SELECT dst, count(DISTINCT src) AS importers FROM e GROUP BY dst ORDER BY importers DESC, dst LIMIT 20")
def in_degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT dst, string_agg(src, ',' ORDER BY src) AS importers FROM e GROUP BY dst")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse(_links(spark, sf_dir)).select("dst", F.array_join("importers", ",").alias("importers"))


@query(f"WITH {LINKS} SELECT (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM e) AS edges, CAST(0 AS BIGINT) AS errors")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return graph.stats(pages, _links(spark, sf_dir), pages.where("false"))


@query(
    "WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL), i AS (SELECT page_id AS src, CAST(page_id % 97 AS VARCHAR) AS k FROM pages), "
    "c AS (SELECT src, k, unnest([0, 1, 2]) AS priority, unnest(['/en/' || k, '/fr/' || k, '/de/' || k]) AS path FROM i) "
    "SELECT i.src, arg_min(p.path, c.priority) AS dst FROM i LEFT JOIN c USING (src) LEFT JOIN p ON p.path = c.path GROUP BY i.src"
)
def prioritised_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    paths = pages.where("url is not null").select(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    k = (F.col("page_id") % 97).cast("string")
    tried = F.array(*(F.concat(F.lit(f"/{x}/"), k) for x in ("en", "fr", "de")))
    imports = pages.select(F.col("page_id").alias("src"), F.lit(0).alias("ord"), k.alias("module"), tried.alias("candidates"), F.lit(False).alias("drop_unresolved"))
    return graph.resolve(imports, paths).select("src", "dst")


@query("SELECT d.doc_id, lang FROM (SELECT d.doc_id, lang, source, toxic, max(coalesce(toxic, 0)) OVER (PARTITION BY source) AS any_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d WHERE any_toxic = 0 OR toxic = 1")
def fallback_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return retrieval.keep_or_all(rows, "source", F.coalesce(F.col("toxic") == 1, F.lit(False))).select("doc_id", "lang")


@query("SELECT 'semi' AS side, doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) UNION ALL SELECT 'anti', doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    semi = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select(F.lit("semi").alias("side"), "doc_id")
    return semi.unionByName(docs.join(labels, "doc_id", "left_anti").select(F.lit("anti").alias("side"), "doc_id"))


@query("SELECT p_partkey, arg_min(term, rank) AS term FROM part JOIN (VALUES (0, 'blue'), (1, 'part 12'), (2, 'large'), (3, '')) k(rank, term) ON contains(lower(p_name), term) OR contains(term, lower(p_name)) GROUP BY p_partkey")
def substring_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(0, "blue"), (1, "part 12"), (2, "large"), (3, "")], "rank int, term string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return retrieval.match_knowledge(rows, terms.withColumn("cwe", F.col("term")), "name", "cwe").select("p_partkey", "matched.term")


