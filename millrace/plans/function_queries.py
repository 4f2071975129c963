"""Queries that run the scalar functions and the smaller operators over the driver's tables, in forms that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import findings, loop, redact, retrieval, state
from millrace.plans import review
from millrace.plans.catalog import query, table

c = F.col


@query(
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Go' WHEN 3 THEN 'YAML' WHEN 4 THEN 'Python' ELSE 'Code' END AS language, "
    "CASE event_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'yaml' WHEN 4 THEN 'python' ELSE 'text' END AS code, event_id % 7 IN (0, 4) AS is_python FROM events"
)
def path_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("element_at(array('.py', '.TSX', '.go', '.yml', '.x.PYI', '', '.'), cast(event_id % 7 + 1 as int))")
    path = F.concat(F.lit("src/f"), c("event_id").cast("string"), name)
    return table(spark, sf_dir, "events").select("event_id", T.language(path)["name"].alias("language"), T.language(path)["code"].alias("code"), T.is_python(path).alias("is_python"))


@query("SELECT conv_id, turn, turn % 4 < 3 AS is_payload FROM conversations")
def diff_payload_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.expr("element_at(array('\n ## Changed Code for Review\n', 'x ```diff\n', '### File: a\n- **Change Type**: b\n', ''), cast(turn % 4 + 1 as int))")
    text = F.regexp_replace(c("text"), "[#`]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_diff_payload(F.concat(marks, text)).alias("is_payload"))


_KEY = "substr(replace(text, ' ', ''), 1, CAST(1 + conv_id % 14 AS INT))"


@query(
    f"SELECT conv_id, turn, CASE WHEN length(k) > 8 THEN substr(k, 1, 4) || '...' || right(k, 4) ELSE '****' END AS masked, replace('error for ' || k || ': ' || k, k, CASE WHEN length(k) > 8 THEN substr(k, 1, 4) || '...' || right(k, 4) ELSE '****' END) AS message FROM (SELECT conv_id, turn, {_KEY} AS k FROM conversations) WHERE length(k) > 0"
)
def key_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.expr("substr(replace(text, ' ', ''), 1, cast(1 + conv_id % 14 as int))")).where("length(k) > 0")
    message = F.concat(F.lit("error for "), c("k"), F.lit(": "), c("k"))
    return rows.select("conv_id", "turn", T.mask_key(c("k")).alias("masked"), T.mask_in(message, c("k")).alias("message"))


@query(
    "SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 9) END AS jaccard FROM "
    "(SELECT o_orderkey, a, b, list_transform(range(a), lambda i: i) AS x, list_transform(range(b), lambda i: i * 2) AS y FROM (SELECT o_orderkey, o_orderkey % 6 AS a, o_custkey % 5 AS b FROM orders))"
)
def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    up_to = lambda n, step: F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n), lambda i: i * step)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(T.jaccard(up_to(c("o_orderkey") % 6, 1), up_to(c("o_custkey") % 5, 2)), 9).alias("jaccard"))


@query(
    "SELECT p_partkey, CASE WHEN f IS NULL THEN '<module>' WHEN k IS NULL OR starts_with(f, k || '.') THEN f ELSE k || '.' || f END AS scope FROM "
    "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Pay' ELSE NULL END AS k, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Pay.refund' ELSE 'f' || p_partkey END AS f FROM part)"
)
def display_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Pay' END")
    function = F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Pay.refund' ELSE concat('f', p_partkey) END")
    return table(spark, sf_dir, "part").select("p_partkey", T.display_scope(cls, function).alias("scope"))


@query(
    "SELECT p_partkey, substr(trim(concat_ws(' ', 'f' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mod' || p_partkey END, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: trim(w)), lambda w: w <> '' AND NOT starts_with(w, '#'))[1:3], ' '), "
    "CASE WHEN p_partkey % 2 = 0 THEN repeat(p_type || '. ', 20) END)), 1, 400) AS q FROM part"
)
def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("a/mod"), c("p_partkey").cast("string"), F.lit(".py"))).otherwise(F.lit("a/utils.py"))
    added = F.concat(F.array(F.lit("  "), F.lit("# note"), F.lit('"""Doc')), F.split("p_name", " "))
    summary = F.when(c("p_partkey") % 2 == 0, F.repeat(F.concat("p_type", F.lit(". ")), F.lit(20))).otherwise(F.lit(""))
    made = T.retrieval_query(F.concat(F.lit("f"), c("p_partkey").cast("string")), path, added, summary)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("q"))


@query(
    "SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN l_returnflag = 'A' THEN 'direct dependency' END, CASE WHEN l_linestatus = 'O' THEN 'caller' END) AS badge, CAST(trunc(round(1 - l_discount * 5, 4) * 100) AS INT) AS percent, round(1 - l_discount * 5, 4) AS relevance FROM lineitem"
)
def hit_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevance = T.relevance(c("l_discount") * 10)
    badge = T.relationship_badge(c("l_returnflag") == "A", c("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", badge.alias("badge"), T.percent(relevance).alias("percent"), relevance.alias("relevance"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN '🔴' WHEN 'purchase' THEN '🟠' WHEN 'signup' THEN '🟡' WHEN 'click' THEN '🔵' ELSE '⚫' END AS mark, count(*) AS n FROM events GROUP BY ALL")
def severity_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'odd' END")
    return table(spark, sf_dir, "events").groupBy("event_type", T.emoji(level).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


_LINES = "CASE WHEN l[len(l)] = '' THEN l[1:len(l)-1] ELSE l END"


@query(
    f"WITH d AS (SELECT doc_id, {_LINES} AS l, CAST(1 + doc_id % 3 AS INT) AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), s AS (SELECT doc_id, l[a:a + 9] AS own FROM d) "
    "SELECT doc_id, array_to_string(CASE WHEN len(own) > 5 THEN list_append(own[1:5], '... (' || (len(own) - 5) || ' more lines)') ELSE own END, chr(10)) AS snippet FROM s"
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines from a place of each document, at most five shown; all lines are indented alike, but for the note, so one blank goes."""
    start = (1 + c("doc_id") % 3).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(c("text"), start, start + 9, 5).alias("snippet"))


@query(
    "SELECT p_partkey, concat_ws(' ', CASE p_partkey % 3 WHEN 0 THEN 'Class `' || n || '`.' WHEN 1 THEN 'Method `Pay.' || n || '`.' ELSE 'Function `' || n || '`.' END, CASE WHEN p_partkey % 2 = 0 THEN p_type || '.' END, CASE WHEN p_size > 25 THEN 'Decorators: @cache, @x.' END, "
    "'Defined in `a/' || n || '.py` at line ' || p_size || '.') AS summary FROM (SELECT *, 'n' || p_partkey AS n FROM part)"
)
def unit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), c("p_partkey").cast("string"))
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END")
    doc = F.when(c("p_partkey") % 2 == 0, F.concat(c("p_type"), F.lit(". More. Text."))).otherwise(F.lit(""))
    marks = F.when(c("p_size") > 25, F.array(F.lit("cache"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    made = T.unit_summary(kind, name, F.lit("Pay"), doc, marks, F.concat(F.lit("a/"), name, F.lit(".py")), c("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("summary"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'no json' ELSE props END AS body, 'x = ' || event_id AS code FROM events")
def cleaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of models: plain, fenced, amid words, or none."""
    p = c("props")
    fenced = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    text = F.when(c("event_id") % 5 == 0, p).when(c("event_id") % 5 == 1, fenced(p)).when(c("event_id") % 5 == 2, F.concat(F.lit("Sure: "), p, F.lit(" - done"))).when(c("event_id") % 5 == 3, F.concat(F.lit(" \n"), p, F.lit("\n"))).otherwise(F.lit("no json"))
    code = F.concat(F.lit("x = "), c("event_id").cast("string"))
    wrapped = F.when(c("event_id") % 2 == 0, F.concat(F.lit("```python\n"), code, F.lit("\n```"))).otherwise(F.concat(F.lit(" "), code))
    return table(spark, sf_dir, "events").select("event_id", T.clean_json(text).alias("body"), T.strip_fence(wrapped).alias("code"))


@query("SELECT p_partkey, 'node_' || regexp_replace(p_type || '/' || p_name || '.py', '[^a-zA-Z0-9_]', '_', 'g') AS node, p_name || '/b.py' AS below FROM part")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("C:\\work\\"), c("p_name"), F.lit("\\b.py"))
    return table(spark, sf_dir, "part").select("p_partkey", T.mermaid_id(F.concat(c("p_type"), F.lit("/"), c("p_name"), F.lit(".py"))).alias("node"), T.relative(path, F.lit("C:\\work\\")).alias("below"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN 'own-' || c_nationkey END AS owner, CASE WHEN c_custkey % 5 < 4 THEN 're.po' || c_custkey END AS repo, CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey AS INT) ELSE -1 END AS pull FROM customer")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(F.lit("own-"), c("c_nationkey").cast("string"), F.lit("/re.po"), c("c_custkey").cast("string"))
    forms = {0: ("https://github.com/", ""), 1: ("git@github.com:", ".git"), 2: ("http://www.github.com/", "PULL"), 3: ("github.com/", ".git?tab=x"), 4: ("https://example.com/", "")}
    url = F.lit("")
    for k, (head, tail) in forms.items():
        made = F.concat(F.lit(head), both, F.concat(F.lit("/pull/"), c("c_custkey").cast("string"), F.lit("/files")) if tail == "PULL" else F.lit(tail))
        url = F.when(c("c_custkey") % 5 == k, made).otherwise(url)
    return table(spark, sf_dir, "customer").select("c_custkey", T.github_parts(url).alias("g")).select("c_custkey", "g.owner", "g.repo", F.coalesce("g.pull", F.lit(-1)).alias("pull"))


@query(
    "SELECT u.user_id AS review_id, a.agent, coalesce(any_value(s.status), 'not run') AS status, coalesce(sum(s.n), 0)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'error')) u CROSS JOIN (VALUES ('static'), ('security'), ('logic')) a(agent) "
    "LEFT JOIN (SELECT user_id, CASE event_type WHEN 'click' THEN 'security' ELSE 'logic' END AS agent, 'completed' AS status, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL) s ON s.user_id = u.user_id AND s.agent = a.agent GROUP BY ALL"
)
def agent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'click' THEN 'security' ELSE 'logic' END").alias("agent")
    counts = table(spark, sf_dir, "events").where("event_type in ('click', 'error')").groupBy(c("user_id").alias("review_id"), kind).agg(F.lit("completed").alias("status"), F.count(F.lit(1)).alias("n"))
    return review.agent_rows(counts)


@query("SELECT o_orderpriority AS phase, count(*) AS checks, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 200000) AS critical_failed FROM orders GROUP BY 1")
def health_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("phase"), c("o_orderkey").alias("name"), (c("o_orderstatus") == "F").alias("ok"), (c("o_totalprice") > 200000).alias("critical"))
    return review.health(checks)


@query(
    "SELECT user_id, event_id AS line, 'B' || (100 + event_id % 9) AS test_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, CAST(event_id + 2 AS INT) AS end_line, "
    "CASE WHEN event_id % 3 = 0 THEN 'CWE-' || (event_id % 300) END AS cwe_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS pos FROM events"
)
def scanner_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scanner's JSON report a user, taken apart again."""
    e = table(spark, sf_dir, "events")
    cwe = F.when(c("event_id") % 3 == 0, F.struct((c("event_id") % 300).cast("int").alias("id"), F.lit("l").alias("link")))
    level = F.expr("CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM' ELSE 'UNDEFINED' END")
    one = F.struct(
        F.concat(F.lit("B"), (100 + c("event_id") % 9).cast("string")).alias("test_id"), c("event_type").alias("test_name"), level.alias("issue_severity"), F.when(c("event_id") % 2 == 0, "High").otherwise("odd").alias("issue_confidence"),
        c("event_id").cast("int").alias("line_number"), F.array(c("event_id").cast("int"), (c("event_id") + 2).cast("int")).alias("line_range"), cwe.alias("issue_cwe"),
    )
    reports = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("report"))
    return findings.bandit(reports).select("user_id", c("line").cast("long").alias("line"), "test_id", "severity", "confidence", "end_line", "cwe_id", "pos")


_HEX = "substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, CAST(14 + o_orderkey % 12 AS INT))"


@query(
    f"WITH t AS (SELECT o_orderkey, v, CAST(1 + o_orderkey % 2 AS INT) AS line FROM (SELECT o_orderkey, {_HEX} AS v FROM orders WHERE o_orderkey % 3 > 0) WHERE length(v) >= 16), "
    "n AS (SELECT o_orderkey, v, line, ch, count(*) / CAST(length(v) AS DOUBLE) AS p FROM (SELECT o_orderkey, v, line, unnest(string_split(v, '')) AS ch FROM t) GROUP BY o_orderkey, v, line, ch) "
    "SELECT o_orderkey, line, v AS value FROM n GROUP BY o_orderkey, line, v HAVING sum(-p * log2(p)) >= 3.0"
)
def entropy_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted hexadecimal strings of high entropy, but for those that a pattern covers."""
    value = F.expr("substr(sha2(cast(o_orderkey as string), 256), 1, cast(14 + o_orderkey % 12 as int))")
    name = F.when(c("o_orderkey") % 3 == 0, "token").otherwise("colour")
    text = F.concat(F.when(c("o_orderkey") % 2 == 0, "").otherwise("first line\n"), name, F.lit(' = "'), value, F.lit('"'))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    # The pattern's rule asks for sixteen characters too, so a shorter token is neither.
    return redact.entropy_hits(rows, redact.detect(rows, "o_orderkey"), "o_orderkey").select("o_orderkey", "line", "value")


@query(
    "WITH RECURSIVE h AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 4, l_partkey % 5) AS p, l_linenumber AS ch, l_partkey % 5 AS u FROM (SELECT l_orderkey, l_linenumber % 3 AS l_linenumber, l_suppkey, l_partkey FROM lineitem)), "
    "f AS (SELECT r, p, ch, [u] AS got, [{'c': ch, 'u': u}] AS out, 0 AS before, 1 AS mine FROM h WHERE p = 1 UNION ALL SELECT x.r, x.p, x.ch, CASE WHEN take THEN list_append(got, u) ELSE got END, CASE WHEN take THEN list_append(out, {'c': x.ch, 'u': u}) ELSE out END, x.before, CASE WHEN take THEN x.mine + 1 ELSE x.mine END "
    "FROM (SELECT y.*, before < 3 AND mine < 2 AND NOT list_contains(got, u) AS take FROM (SELECT h.r, h.p, h.ch, h.u, f.got, f.out, CASE WHEN h.ch <> f.ch THEN len(f.got) ELSE f.before END AS before, CASE WHEN h.ch <> f.ch THEN 0 ELSE f.mine END AS mine FROM f JOIN h ON h.r = f.r AND h.p = f.p + 1) y) x) "
    "SELECT r AS review_id, CAST(i - 1 AS INT) AS claim_no, out[i].c AS change_no, out[i].u AS unit FROM (SELECT r, out, unnest(range(1, len(out) + 1)) AS i FROM (SELECT r, arg_max(out, p) AS out FROM f GROUP BY r))"
)
def change_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the changes of a review claim in turn: two a change, and no new change once three are claimed."""
    hits = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("review_id"), (c("l_linenumber") % 3).alias("change_no"), (c("l_suppkey") % 4).alias("rank"), (c("l_partkey") % 5).alias("unit"))
    return retrieval.claim_over_changes(hits, "review_id", 2, 3)


@query(
    "WITH l AS (SELECT DISTINCT l_orderkey % 50 AS a, l_partkey % 50 AS b FROM lineitem) SELECT o_orderkey, o_orderkey % 50 AS file_path, o_custkey % 50 AS hit_path, EXISTS (SELECT 1 FROM l WHERE a = o_orderkey % 50 AND b = o_custkey % 50) AS is_direct_dependency, EXISTS (SELECT 1 FROM l WHERE b = o_orderkey % 50 AND a = o_custkey % 50) AS is_dependent FROM orders"
)
def relation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 50).alias("src"), (c("l_partkey") % 50).alias("dst"))
    hits = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderkey") % 50).alias("file_path"), (c("o_custkey") % 50).alias("hit_path"))
    return retrieval.flag_relations(hits, edges)


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'paused' WHEN o_orderstatus = 'O' THEN 'approved' WHEN o_orderstatus = 'F' THEN 'rejected' WHEN o_orderkey % 4 = 1 THEN 'running: report' ELSE 'completed' END AS status FROM orders"
)
def thread_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'human_review' WHEN 1 THEN 'report' END")
    decision = F.expr("CASE o_orderstatus WHEN 'O' THEN 'approve' WHEN 'F' THEN 'reject' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.thread_status(following, decision).alias("status"))


@query(
    "SELECT user_id AS thread_id, max(event_id) AS latest, count(*) AS n, max(CASE WHEN c_name IS NOT NULL THEN 'Report of ' || c_name END) AS report FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0 GROUP BY user_id"
)
def thread_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints = table(spark, sf_dir, "events").select(c("user_id").alias("thread_id"), c("event_id").alias("checkpoint_id"))
    texts = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("thread_id"), F.concat(F.lit("Report of "), c("c_name")).alias("report"))
    return state.reports(checkpoints, texts)


@query(
    "SELECT l_orderkey AS review_id, bool_or(l_returnflag = 'R') AS any_rejected, coalesce(string_agg(CASE WHEN l_returnflag = 'R' THEN '[item ' || l_partkey || ']: no ' || l_linestatus END, ' | ' ORDER BY l_linenumber, l_partkey), '') AS feedback FROM lineitem GROUP BY l_orderkey"
)
def rejection_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = F.expr("CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("review_id"), F.struct("l_linenumber", "l_partkey").alias("finding_id"), F.concat(F.lit("item "), c("l_partkey").cast("string")).alias("title"), accepted.alias("accepted"), F.concat(F.lit("no "), c("l_linestatus")).alias("feedback")
    )
    return loop.review_state(rows)


@query(
    "SELECT p_partkey AS finding_id, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 3 END AS attempts, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS judged, CASE WHEN p_partkey % 4 = 0 THEN true END AS accepted, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Maximum revisions (2) reached.' END AS feedback, 'pass' AS proposed_fix, 2 AS nodes FROM part"
)
def fix_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded loop over one finding a part, with the offline provider: titles with "accept" pass at once."""
    title = F.when(c("p_partkey") % 4 == 0, "please accept").otherwise(F.lit("Injection"))
    rows = table(spark, sf_dir, "part").select((c("p_partkey") % 7).alias("review_id"), c("p_partkey").alias("finding_id"), title.alias("title"), F.lit("a.py").alias("path"), F.lit("x = 1").alias("code"))
    return loop.run(rows).select("finding_id", "attempts", "judged", "accepted", "feedback", "proposed_fix", c("syntax.nodes").alias("nodes"))
