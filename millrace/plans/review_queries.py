"""Queries over findings, reviews, answers of hosts and models, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import findings, graph, providers, redact, search, state
from millrace.plans import pull, review
from millrace.plans.catalog import query, table
from millrace.plans.code_queries import _CHANGES, _SCOPE, _changes
from millrace.plans.event_queries import LEVEL
from millrace.sources import code

c = F.col

_SAME = "x.f = o.f AND (x.t = o.t OR (x.c = o.c AND abs(x.l - o.l) <= 10))"


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id, event_type AS t, event_id % 5 AS f, event_id % 2 AS c, 1 + event_id % 300 AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    r AS (SELECT user_id, p, [{{'p': p, 't': t, 'f': f, 'c': c, 'l': l}}] AS leaders, p AS leader FROM o WHERE p = 1
      UNION ALL SELECT o.user_id, o.p, CASE WHEN len(list_filter(r.leaders, lambda x: {_SAME})) > 0 THEN r.leaders ELSE list_append(r.leaders, {{'p': o.p, 't': o.t, 'f': o.f, 'c': o.c, 'l': o.l}}) END,
        coalesce(list_filter(r.leaders, lambda x: {_SAME})[1].p, o.p) FROM r JOIN o ON o.user_id = r.user_id AND o.p = r.p + 1)
    SELECT user_id, CAST(p AS INT) AS position, CAST(leader AS INT) AS leader FROM r"""
)
def finding_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate of the merge itself: fingerprint, similar title in a file, or near lines of a category."""
    title = F.concat(F.lit("Finding "), c("event_type"))
    file = F.concat(F.lit("f"), (c("event_id") % 5).cast("string"))
    line = (1 + c("event_id") % 300).cast("int")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", file.alias("file"), (c("event_id") % 2).cast("string").alias("category"), T.fingerprint(title, file, line).alias("fingerprint"), line.alias("line_number"), F.lit(None).cast("int").alias("end_line"), T.title_tokens(title).alias("tokens")
    )
    return findings.leaders(rows, ["user_id"], ["event_id"]).select("user_id", c("position").cast("int").alias("position"), c("leader").cast("int").alias("leader"))


@query("SELECT p_type AS kind, count(*) AS calls, CAST(0 AS BIGINT) AS failed, sum(greatest(1, length(p_name) // 4))::BIGINT AS prompt_tokens, sum(length('Summary of ' || length(p_name) || ' characters.') // 4)::BIGINT AS completion_tokens, sum(greatest(1, length(p_name) // 4) + length('Summary of ' || length(p_name) || ' characters.') // 4)::BIGINT AS total_tokens FROM part GROUP BY 1")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = providers.ask(table(spark, sf_dir, "part").select(c("p_type").alias("kind"), "p_name"), c("p_name"), as_json=False)
    return providers.usage(asked, "kind")


@query("SELECT p_partkey, 'n' || p_partkey AS unit_name, CASE WHEN p_partkey % 4 = 0 THEN 'made from parts' ELSE 'Summary of ' || (65 + length(p_partkey::VARCHAR) + length(p_name)) || ' characters.' END AS summary FROM part")
def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the offline provider, which tells the length of its prompt; a failed call leaves the one made from parts."""

    class Moody(providers.Stub):
        def generate(self, prompt: str, system: str = "") -> str:
            if prompt.split("\n")[1].startswith("!"):
                raise TimeoutError
            return super().generate(prompt, system)

    snippet = F.concat(F.when(c("p_partkey") % 4 == 0, "!").otherwise(F.lit("")), c("p_name"))
    units = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("n"), c("p_partkey").cast("string")).alias("unit_name"), snippet.alias("snippet"), F.lit("made from parts").alias("summary"))
    return providers.summaries(units, Moody).drop("snippet")


@query("SELECT 'src/p' || p_partkey || '.py' AS path, p_name || chr(10) || p_type AS source FROM part WHERE p_size <= 25")
def hosted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of a tree and the content answers of its files, as a host gives them."""
    p = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("src/p"), c("p_partkey").cast("string"), F.lit(".py")))
    item = F.struct(c("path"), F.when(c("p_size") <= 25, "blob").otherwise("tree").alias("type"), F.lit(1).alias("size"))
    listed = code.tree_files(p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("tree"))).alias("body")))
    whole = F.base64(F.concat(c("p_name"), F.lit("\n"), c("p_type")).cast("binary"))
    answers = p.select(F.to_json(F.struct("path", F.concat(F.substring(whole, 1, 8), F.lit("\n"), F.expr("substr(base64(cast(concat(p_name, '\n', p_type) as binary)), 9)")).alias("content"))).alias("body"))
    return code.decoded(answers).join(listed.select("path"), "path", "left_semi")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events put in place of earlier ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    middle = 300
    return state.upsert(state.latest(e.where(c("event_id") < middle), ["user_id"], ["event_id"]), e.where(c("event_id") >= middle), ["user_id"], ["event_id"])


@query(
    f"SELECT review_id, pos, upper(change_type[1]) || change_type[2:] || ' ' || {_SCOPE} || ' in ' || file_path || ': +' || n_added || ' / -' || n_removed || ' lines at ' || new_start AS text FROM ({_CHANGES})"
)
def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pull.changes_text(_changes(spark, sf_dir))


@query(f"SELECT DISTINCT file_path, {_SCOPE} AS scope FROM ({_CHANGES})")
def change_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.file_options(_changes(spark, sf_dir))


@query(f"SELECT review_id, file_path, old_start FROM ({_CHANGES}) WHERE {_SCOPE} = '<module>' AND is_python")
def python_module_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.only(_changes(spark, sf_dir).where("is_python"), scope="<module>").select("review_id", "file_path", "old_start")


@query("SELECT p_partkey AS review_id, 'a' || CASE WHEN p_partkey % 3 = 0 THEN '.js' ELSE '.py' END AS path, p_partkey % 4 > 0 AND p_partkey % 3 > 0 AS static, p_partkey % 4 > 0 AS security, p_partkey % 4 > 0 AS logic FROM part")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a"), F.when(c("p_partkey") % 3 == 0, ".js").otherwise(F.lit(".py")))
    source = F.when(c("p_partkey") % 4 == 0, "  ").otherwise(c("p_name"))
    return review.flags(table(spark, sf_dir, "part").select(c("p_partkey").alias("review_id"), path.alias("path"), source.alias("source")))


@query(f"SELECT user_id, count(*) FILTER (s IN ('critical', 'high')) AS urgent, count(*) AS n FROM (SELECT user_id, {LEVEL} AS s FROM events) GROUP BY 1")
def urgent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.high_or_critical(table(spark, sf_dir, "events").select("user_id", F.expr(LEVEL).alias("severity")), "user_id")


@query(
    f"WITH n AS (SELECT user_id, {LEVEL} AS s, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, sum(n) || ' finding(s): ' || string_agg(n || ' ' || s, ', ' ORDER BY CASE s WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END) || '.' AS text FROM n GROUP BY user_id"
)
def count_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", F.expr(LEVEL).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return review.count_text(counts, "user_id")


@query("SELECT c_custkey, c_custkey * 3 AS loc, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END AS high, CAST(0 AS BIGINT) AS medium, c_nationkey + 1 AS low FROM customer")
def scanner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit(', "SEVERITY.HIGH": '), c("c_nationkey").cast("string"))).otherwise(F.lit(""))
    body = F.concat(F.lit('{"metrics": {"_totals": {"loc": '), (c("c_custkey") * 3).cast("string"), high, F.lit(', "SEVERITY.LOW": '), (c("c_nationkey") + 1).cast("string"), F.lit("}}}"))
    return review.metric_totals(table(spark, sf_dir, "customer").withColumn("report", body), "c_custkey")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "X"))


@query(
    "WITH g AS (SELECT o_custkey AS r, o_orderpriority AS title, o_orderkey AS rank, o_orderstatus AS s, 'f' || o_orderkey AS f FROM orders), x AS (SELECT DISTINCT l_suppkey % 400 + 1 AS r, CASE l_partkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'none' END AS title FROM lineitem), "
    "t AS (SELECT r, title, arg_min(s, rank) AS s, arg_min(f, rank) AS f FROM g GROUP BY ALL), a AS (SELECT r, arg_min(s, rank) AS s, arg_min(f, rank) AS f FROM g GROUP BY r) "
    "SELECT x.r AS review_id, x.title, coalesce(t.s, a.s) AS finding_severity, coalesce(t.f, a.f) AS finding_file FROM x LEFT JOIN t ON t.r = x.r AND t.title = x.title LEFT JOIN a ON a.r = x.r"
)
def fixes_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = table(spark, sf_dir, "orders").select(c("o_custkey").alias("review_id"), c("o_orderpriority").alias("title"), c("o_orderkey").alias("rank"), c("o_orderstatus").alias("severity"), F.concat(F.lit("f"), c("o_orderkey").cast("string")).alias("file"))
    title = F.expr("CASE l_partkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'none' END")
    fixes = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 400 + 1).alias("review_id"), title.alias("title")).distinct()
    return review.fixes_with_findings(fixes, graded)


@query(
    f"WITH e AS (SELECT user_id, {LEVEL} AS severity, event_type AS title, event_id FROM events) SELECT user_id, severity, title FROM e WHERE user_id % 2 = 0 UNION ALL SELECT user_id, severity, title || '!' FROM e WHERE user_id % 2 = 1"
)
def flattened_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.expr(LEVEL).alias("severity"), c("event_type").alias("title"))
    buckets = e.groupBy("user_id", "severity").agg(F.collect_list(F.concat("title", F.lit("!"))).alias("titles"))
    return review.flat_findings(e.where("user_id % 2 = 0"), buckets, "user_id")


@query(
    "SELECT l_orderkey, l_linenumber, '#### `u' || l_partkey || '` in `s' || l_suppkey || '.py` - ' || CAST(trunc(round(1 - l_discount * 5, 4) * 100) AS INT) || '%' || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN ' (direct dependency, caller)' WHEN l_returnflag = 'A' THEN ' (direct dependency)' WHEN l_linestatus = 'O' THEN ' (caller)' ELSE '' END || chr(10) || 'does ' || l_partkey AS text FROM lineitem"
)
def related_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("u"), c("l_partkey").cast("string")).alias("title"), F.concat(F.lit("s"), c("l_suppkey").cast("string"), F.lit(".py")).alias("hit_path"), T.relevance(c("l_discount") * 10).alias("relevance"),
        (c("l_returnflag") == "A").alias("is_direct_dependency"), (c("l_linestatus") == "O").alias("is_dependent"), F.concat(F.lit("does "), c("l_partkey").cast("string")).alias("content"),
    )
    return rows.select("l_orderkey", "l_linenumber", search.related_text().alias("text"))


@query(
    "WITH i AS (SELECT l_orderkey, string_agg('m' || l_partkey, ', ' ORDER BY p) FILTER (p <= 4) AS m FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem) GROUP BY l_orderkey) "
    "SELECT o_orderkey AS qid, '### `f' || o_orderkey || '` (`' || o_orderkey || '.py`)' || chr(10) || CASE WHEN m IS NULL THEN '' ELSE 'Imports: ' || m || chr(10) END || '```python' || chr(10) || o_orderstatus || chr(10) || '```' AS context FROM orders LEFT JOIN i ON l_orderkey = o_orderkey"
)
def function_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = lambda k: F.concat(c(k).cast("string"), F.lit(".py"))
    imports = table(spark, sf_dir, "lineitem").select(file("l_orderkey").alias("src"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.concat(F.lit("m"), c("l_partkey").cast("string")).alias("module"))
    functions = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("qid"), F.concat(F.lit("f"), c("o_orderkey").cast("string")).alias("function_name"), file("o_orderkey").alias("file_path"), c("o_orderstatus").alias("snippet"))
    return search.function_context(functions, imports).select("qid", "context")


_V = "substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 20)"


@query(
    f"WITH n AS (SELECT o_orderkey, unnest(string_split({_V}, '')) AS ch FROM orders), b AS (SELECT o_orderkey, sum(-p * log2(p)) >= 3.0 AS high FROM (SELECT o_orderkey, ch, count(*) / 20.0 AS p FROM n GROUP BY ALL) GROUP BY 1) "
    f"SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 2 = 0 THEN 'x = 1' || chr(10) || 'token = \"<REDACTED_GENERIC_SECRET_L2>\"' WHEN high THEN 'x = 1' || chr(10) || 'colour = \"<REDACTED_DETECT_SECRETS_FINDING_L2>\"' ELSE 'x = 1' || chr(10) || 'colour = \"' || {_V} || '\"' END AS sanitized, "
    "CASE WHEN o.o_orderkey % 2 = 0 OR high THEN 1 ELSE 0 END AS n_secrets, CASE WHEN o.o_orderkey % 2 = 0 THEN 'low' WHEN high THEN 'medium' END AS highest FROM orders o JOIN b USING (o_orderkey)"
)
def sanitize_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction by patterns and, on the lines that these leave, by entropy."""
    value = F.expr("substr(sha2(cast(o_orderkey as string), 256), 1, 20)")
    text = F.concat(F.lit("x = 1\n"), F.when(c("o_orderkey") % 2 == 0, "token").otherwise("colour"), F.lit(' = "'), value, F.lit('"'))
    return redact.sanitize(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", entropy=True).select("o_orderkey", "sanitized", "n_secrets", "highest")


@query("WITH l AS (SELECT DISTINCT 'p' || l_orderkey % 40 AS src, 'p' || l_partkey % 60 AS dst FROM lineitem) SELECT dst, string_agg(src, ',' ORDER BY src) AS importers FROM l GROUP BY dst")
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k, n: F.concat(F.lit("p"), (c(k) % n).cast("string"))
    edges = graph.edges(table(spark, sf_dir, "lineitem").select(name("l_orderkey", 40).alias("src"), name("l_partkey", 60).alias("dst"), c("l_linenumber").alias("ord")))
    return graph.reverse(edges).select("dst", F.array_join("importers", ",").alias("importers"))
