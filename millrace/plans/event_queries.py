"""Queries over events, orders and line items: severities, clusters, intervals, upserts, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import findings, ordered, report, retrieval, rubric, state
from millrace.plans.catalog import query, table

#: Event types graded as severities of findings.
LEVEL = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'info' END"
RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
CONFIDENCE = "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
CONF_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("severity", F.expr(LEVEL)).withColumn("confidence", F.expr(CONFIDENCE))


@query(f"SELECT {LEVEL} AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, arg_max(severity, {RANK}) AS highest, count(*) AS n FROM (SELECT user_id, {LEVEL} AS severity FROM events) GROUP BY user_id")
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = findings.severity_rank(F.col("severity"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("severity", rank).alias("highest"), F.count(F.lit(1)).alias("n"))


@query(f"WITH l(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')), e AS (SELECT user_id, {LEVEL} AS severity FROM events) SELECT u.user_id, l.severity, count(e.user_id) AS n FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN l LEFT JOIN e ON e.user_id = u.user_id AND e.severity = l.severity GROUP BY ALL")
def severity_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "severity", F.col("event_id").alias("ordinal"), F.col("event_type").alias("title"))
    return findings.by_severity(rows, "user_id").select("user_id", "severity", F.size("titles").cast("long").alias("n"))


_CHANGED = f"SELECT user_id, {LEVEL} AS severity, CASE WHEN value > 50 THEN 'high' ELSE {LEVEL} END AS after FROM events"


@query(f"SELECT user_id, count(*) FILTER (severity <> after) AS reclassified FROM ({_CHANGED}) GROUP BY user_id")
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.when(F.col("value") > 50, "high").otherwise(F.col("severity"))
    rows = _events(spark, sf_dir).withColumn("changed", F.col("severity") != after)
    return rubric.summary(rows.withColumn("severity", after), "user_id").select("user_id", "reclassified")


SLOT = "CAST(floor(epoch(ts) / 600) AS BIGINT)"


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id, event_type, {SLOT} AS slot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    f AS (SELECT user_id, p, [{{'p': p, 't': event_type, 's': slot}}] AS leaders, p AS leader FROM o WHERE p = 1
      UNION ALL SELECT o.user_id, o.p,
        CASE WHEN len(list_filter(f.leaders, lambda x: x.t = o.event_type AND abs(x.s - o.slot) <= 10)) > 0 THEN f.leaders ELSE list_append(f.leaders, {{'p': o.p, 't': o.event_type, 's': o.slot}}) END,
        coalesce(list_filter(f.leaders, lambda x: x.t = o.event_type AND abs(x.s - o.slot) <= 10)[1].p, o.p)
      FROM f JOIN o ON o.user_id = f.user_id AND o.p = f.p + 1)
    SELECT user_id, CAST(p AS INT) AS position, CAST(leader AS INT) AS leader FROM f"""
)
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leaders by user: same type, at most ten slots of ten minutes apart."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600)
    rows = table(spark, sf_dir, "events").withColumn("slot", slot)
    rules = (ordered.Rule(("event_type",), near=("slot", "slot", 10)),)
    return findings.leaders(rows, ["user_id"], ["event_id"], rules).select("user_id", F.col("position").cast("int").alias("position"), F.col("leader").cast("int").alias("leader"))


_U = f"SELECT user_id, {LEVEL} AS severity, {CONFIDENCE} AS confidence, event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS source_no FROM events"


@query(f"SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {RANK} DESC, {CONF_RANK} DESC, source_no, event_id) AS INT) AS rank FROM ({_U})")
def finding_union_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = findings.union_in_order(*(e.where(F.col("event_type") == t) for t in ("error", "click", "view", "purchase", "signup")))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("source_no", "event_id")))
    return findings.in_order(rows, "user_id").select("user_id", "event_id", "rank")


@query(f"SELECT user_id, severity, string_agg(event_id, ',' ORDER BY {CONF_RANK} DESC, event_id) AS ids FROM (SELECT user_id, event_id, {LEVEL} AS severity, {CONFIDENCE} AS confidence FROM events) GROUP BY ALL")
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "severity", "confidence", F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("title"))
    return rubric.buckets(rows, "user_id").select("user_id", "severity", F.array_join("titles", ",").alias("ids"))


SPANS = "s AS (SELECT c_custkey, o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 60 DAY AS hi, 60 + o_orderkey % 30 AS span FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"WITH {SPANS} SELECT o.o_orderkey AS orderkey, count(*) AS hits FROM s JOIN orders o ON o.o_custkey = s.c_custkey AND o.o_orderdate BETWEEN s.lo AND s.hi GROUP BY 1")
def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in intervals: an equi-join on the key, the range as its residual."""
    o = table(spark, sf_dir, "orders")
    s = o.select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("hi"))
    hit = o.join(s, "o_custkey").where("o_orderdate between lo and hi")
    return hit.groupBy(F.col("o_orderkey").alias("orderkey")).agg(F.count(F.lit(1)).alias("hits"))


@query(f"WITH {SPANS} SELECT orderkey, scope FROM (SELECT o.o_orderkey AS orderkey, s.o_orderkey AS scope, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY span, s.o_orderkey) AS n FROM s JOIN orders o ON o.o_custkey = s.c_custkey AND o.o_orderdate BETWEEN s.lo AND s.hi) WHERE n = 1")
def best_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest interval around each point, first by id: a minimum, aggregated before the shuffle."""
    o = table(spark, sf_dir, "orders")
    s = o.select("o_custkey", F.col("o_orderkey").alias("scope"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("hi"), (60 + F.col("o_orderkey") % 30).alias("span"))
    hit = o.join(s, "o_custkey").where("o_orderdate between lo and hi")
    return hit.groupBy(F.col("o_orderkey").alias("orderkey")).agg(F.min_by("scope", F.struct("span", "scope")).alias("scope"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    half = F.col("event_id") % 2 == 0
    old = state.latest(e.where(half), ["user_id"], ["event_id"])
    # Rows of the batch that are older than the stored ones don't replace them.
    return state.latest(old.unionByName(e.where(~half)), ["user_id"], ["event_id"])


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS first_order FROM orders GROUP BY o_custkey")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT user_id AS thread_id, max(event_id) AS latest, count(*) AS n FROM events GROUP BY user_id ORDER BY latest DESC")
def thread_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("checkpoint_id"))
    return state.threads(rows).orderBy(F.desc("latest"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS types FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'report' WHEN 'F' THEN 'fix_suggester' ELSE 'paused' END AS next FROM orders")
def decision_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.expr("CASE o_orderstatus WHEN 'O' THEN 'approve' WHEN 'F' THEN 'revise' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.route(decision).alias("next"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, exported and parsed again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "event_type")
    return report.to_json(rows).select(F.from_json("value", "event_id long, k int, event_type string").alias("r")).select("r.*")


@query(f"SELECT user_id, string_agg('- [' || severity || '] ' || event_type || ' #' || event_id, chr(10) ORDER BY {RANK} DESC, event_id) AS lines FROM (SELECT *, {LEVEL} AS severity FROM events) GROUP BY user_id")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = -findings.severity_rank(F.col("severity"))
    line = F.format_string("- [%s] %s #%d", "severity", "event_type", "event_id")
    item = F.struct(rank.alias("r"), "event_id", line.alias("line"))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("lines"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(event_id) AS first_seen FROM events GROUP BY event_type")
def first_seen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("event_id").alias("first_seen"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain scan, filter and aggregate, as a yardstick of throughput."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


