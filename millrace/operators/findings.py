"""Findings of several producers: common schema, ordered union, leader clusters and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ordered
from millrace.schema import FINDING_DDL, SEVERITIES, SEVERITY_RANK, confidence_rank, lookup, severity_rank
from millrace.sources.shared import removed

TITLE_LEAST = 0.72
NEAR_LINES = 5


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalise(df: DataFrame, producer: str, file: str = "") -> DataFrame:
    """Rows of a producer (static, security, logic) in the canonical schema; other columns, such as ids, stay behind it."""
    c = lambda name, kind="string": _column(df, name, kind)
    text = lambda name: F.coalesce(c(name), F.lit(""))
    static = producer == "static"
    default_tool = {"static": "bandit", "security": "security_scanner_rag", "logic": "logic_reviewer"}[producer]
    category = F.lit("static") if static else F.coalesce(F.nullif(c("category"), F.lit("")), F.lit({"security": "security", "logic": "business_logic"}[producer]))
    path = F.coalesce(F.nullif(c("file"), F.lit("")), F.lit(file))
    line = c("line", "int") if static else c("line_number", "int")
    tool = F.coalesce(F.nullif(c("tool"), F.lit("")), F.lit(default_tool))
    values = {
        "title": text("title"), "description": text("description"), "category": category,
        "reported_severity": text("severity"), "reported_confidence": text("confidence"), "severity": text("severity"), "confidence": text("confidence"),
        "file": path, "line_number": line, "end_line": c("end_line", "int") if static else F.lit(None).cast("int"),
        "affected_code": text("code_snippet" if static else "affected_code"), "reasoning": F.lit("") if static else text("reasoning"),
        "suggested_remediation": text("more_info") if static else text("suggested_remediation"), "source_tools": F.array(tool), "primary_tool": tool,
        "cwe_id": F.lit(None).cast("string") if producer == "logic" else c("cwe_id"),
        "test_id": {"static": c("test_id"), "security": c("matched_rule_id"), "logic": F.lit(None).cast("string")}[producer],
        "more_info": text("more_info") if static else F.lit(""), "fingerprint": T.fingerprint(text("title"), path, line),
        "merge_notes": F.array().cast("array<string>"), "duplicate_count": F.lit(1),
    }
    rest = [x for x in df.columns if x in ("review_id", "pos")]
    return df.select(*(v.alias(k) for k, v in values.items()), *rest)


def union_in_order(*streams: DataFrame) -> DataFrame:
    """UNION ALL with ``source_no``; each stream brings ``pos``, its order."""
    out = None
    for n, s in enumerate(streams):
        s = s.withColumn("source_no", F.lit(n))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


#: When two records of a group are one finding: fingerprint, similar title in a file, or near lines of a category.
SAME = (ordered.Rule(("fingerprint",)), ordered.Rule(("file",), alike=("tokens", TITLE_LEAST)), ordered.Rule(("file", "category"), near=("line_number", "_last_line", 2 * NEAR_LINES)))


def leaders(df: DataFrame, keys: list[str], order: list[str], rules: tuple[ordered.Rule, ...] = SAME) -> DataFrame:
    """``df`` with ``position`` and ``leader``, the position of the first earlier leader within ``keys`` that the row matches, or its own."""
    if rules is not SAME:
        return ordered.leaders(df, keys, order, rules)
    last = F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), F.col("line_number"))
    return ordered.leaders(df.withColumn("_last_line", last), keys, order, rules).drop("_last_line")


#: Ranks of severities, lowest first, as they can rise within a group.
LEVELS = sorted(set(SEVERITY_RANK.values()) | {0})


def merge(rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a leader from rows with ``position`` and ``leader``: the absorbed records merged into it, in order. ``keep``: further columns of the leader.

    The state of a group is mergeable, so it is combined before the shuffle and no group's records are gathered: the first record, the first
    record of the highest severity and confidence, the longest remediation, the first CWE that isn't empty, and the first record of each
    severity level, from which the notes of rises follow. Two parts depend on the order of more than that. Reasons are
    appended unless the text so far holds them; a repeated reason is held, so only a group's distinct (reason, tool, tools) are folded in order,
    and what is folded becomes the result's text. The notes name the tool of each absorbed record, so positions are gathered by tool: as long as the result's list.
    """
    names = [x.strip().split(" ")[0] for x in FINDING_DDL.split(",")]
    group = [*keys, "leader"]
    rank, sure = severity_rank(F.col("severity")), confidence_rank(F.col("confidence"))
    before = -F.col("position")
    states = {
        "_first": (F.min, F.struct("position", *(F.col(n).alias(f"_{n}") for n in (*names, *keep)))),
        "_severe": (F.max, F.struct(rank.alias("rank"), before.alias("before"), F.col("severity").alias("_severity"), F.col("reported_severity").alias("_reported"))),
        "_sure": (F.max, F.struct(sure.alias("rank"), before.alias("before"), F.col("confidence").alias("_confidence"), F.col("reported_confidence").alias("_reported"), F.col("primary_tool").alias("_tool"))),
        "_fix": (F.max, F.struct(F.length("suggested_remediation").alias("length"), before.alias("before"), F.col("suggested_remediation").alias("_text"))),
        "_cwe": (F.min, F.when(F.coalesce("cwe_id", F.lit("")) != "", F.struct("position", F.col("cwe_id").alias("_id")))),
    } | {f"_level{k}": (F.min, F.when(rank == k, F.struct("position", F.lit(k).alias("rank"), F.col("severity").alias("_severity"), F.col("primary_tool").alias("_tool")))) for k in LEVELS}
    kinds = rows.groupBy(*group, F.col("reasoning").alias("_reason"), F.col("primary_tool").alias("_by"), F.col("source_tools").alias("_tools")).agg(*(f(x).alias(n) for n, (f, x) in states.items()), F.collect_list("position").alias("_at"))
    kind = F.struct(F.array_min("_at").alias("position"), "_reason", "_by", "_tools", "_at")
    g = kinds.groupBy(*group).agg(*(f(n).alias(n) for n, (f, _) in states.items()), F.array_sort(F.collect_list(kind)).alias("_kinds"))

    def reason(s: Column, x: Column) -> Column:
        new = (x["_reason"] != "") & ~F.contains(s, x["_reason"])
        return F.when(F.coalesce(new, F.lit(False)), F.when(s == "", x["_reason"]).otherwise(F.concat(s, F.lit("\n\n["), x["_by"], F.lit("] "), x["_reason"]))).otherwise(s)

    # The first records of the levels, in order; those above all before them are rises.
    levels = F.array_sort(F.array_compact(F.array(*(F.col(f"_level{k}") for k in LEVELS))))
    rise = lambda x, i: F.struct(
        x["position"].alias("position"), x["rank"].alias("rank"), F.coalesce(F.array_max(F.transform(F.slice("_levels", 1, i), lambda e: e["rank"])), F.lit(-1)).alias("above"),
        x["_severity"].alias("to"), x["_tool"].alias("tool"),
    )
    g = g.withColumn("_levels", levels).withColumn("_rises", F.filter(F.transform("_levels", rise), lambda e: e["rank"] > e["above"]))
    note = lambda p, tool: F.concat(
        F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size("_rises"), F.lit(2))), lambda i: F.get("_rises", i - 1)["position"] == p), lambda i: F.format_string("Severity elevated from %s → %s by %s.", F.get("_rises", i - 2)["to"], F.get("_rises", i - 1)["to"], tool)),
        F.array(F.format_string("Absorbed duplicate from %s (similarity/overlap detected).", tool)),
    )
    absorbed = F.array_sort(F.flatten(F.transform("_kinds", lambda x: F.transform(x["_at"], lambda p: F.struct(p.alias("position"), x["_by"].alias("_tool"))))))
    g = g.withColumn("_absorbed", F.slice(absorbed, 2, F.greatest(F.size(absorbed) - 1, F.lit(0))))
    first = lambda n: F.col(f"_first._{n}")
    values = {
        "severity": F.col("_severe._severity"), "reported_severity": F.col("_severe._reported"), "confidence": F.col("_sure._confidence"), "reported_confidence": F.col("_sure._reported"), "primary_tool": F.col("_sure._tool"),
        "source_tools": F.array_distinct(F.flatten(F.transform("_kinds", lambda x: x["_tools"]))), "cwe_id": F.coalesce(F.col("_cwe._id"), first("cwe_id")),
        "reasoning": F.aggregate(F.slice("_kinds", 2, F.greatest(F.size("_kinds") - 1, F.lit(0))), first("reasoning"), reason), "suggested_remediation": F.col("_fix._text"),
        "merge_notes": F.concat(first("merge_notes"), F.flatten(F.transform("_absorbed", lambda x: note(x["position"], x["_tool"])))), "duplicate_count": (first("duplicate_count") + F.size("_absorbed")).cast("int"),
    }
    return g.select(*group, *(values.get(n, first(n)).alias(n) for n in names), *(first(n).alias(n) for n in keep))


def aggregate(static: DataFrame, security: DataFrame, logic: DataFrame, key: str = "review_id") -> DataFrame:
    """Normalised streams with ``key`` and ``pos``: united, deduplicated by file, merged, most severe first."""
    rows = union_in_order(static, security, logic).withColumn("tokens", T.title_tokens(F.col("title")))
    rows, path = ordered.positions(rows, [key], ["source_no", "pos"], "ordinal")
    led = leaders(rows, [key, "file"], ["ordinal"])
    removed(led.sparkSession, path)
    merged = merge(led.withColumn("_file", F.col("file")), [key, "_file"], ("ordinal",))
    return in_order(merged.drop("_file", "leader"), key)


def in_order(df: DataFrame, key: str = "review_id") -> DataFrame:
    """``rank`` by severity, confidence, then input order, within ``key``."""
    w = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc(), "ordinal")
    return df.withColumn("rank", F.row_number().over(w))


def by_severity(df: DataFrame, key: str, levels: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """Every level of every key, with its titles in order; unknown levels count as low."""
    level = F.when(F.col("severity").isin(*levels), F.col("severity")).otherwise(F.lit("low"))
    found = df.withColumn("severity", level).groupBy(key, "severity").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title"))), lambda x: x["title"]).alias("titles"))
    every = df.select(key).distinct().withColumn("severity", F.explode(F.array(*map(F.lit, levels))))
    return every.join(found, [key, "severity"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def bandit(rows: DataFrame, json_col: str = "report") -> DataFrame:
    """Results of a scanner's JSON report: one finding a row, by line, ``pos`` in order. Unknown levels are low."""
    schema = "results array<struct<test_id:string,test_name:string,issue_text:string,issue_severity:string,issue_confidence:string,filename:string,line_number:int,end_col_offset:int,line_range:array<int>,code:string,more_info:string,issue_cwe:struct<id:int,link:string>>>"
    known = {k: k for k in ("critical", "high", "medium", "low")}
    out = rows.select(*(c for c in rows.columns if c != json_col), F.explode(F.from_json(json_col, schema)["results"]).alias("r"))
    out = out.select(
        *(c for c in rows.columns if c != json_col), F.col("r.test_id"), F.col("r.test_name").alias("title"), F.col("r.issue_text").alias("description"),
        lookup(known, F.lower("r.issue_severity"), "low").alias("severity"), lookup(known, F.lower("r.issue_confidence"), "low").alias("confidence"),
        F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), F.array_max("r.line_range").alias("end_line"), F.col("r.code").alias("code_snippet"),
        F.col("r.more_info"), F.when(F.col("r.issue_cwe.id").isNotNull(), F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string"))).alias("cwe_id"), F.lit("bandit").alias("tool"),
    )
    keys = [c for c in rows.columns if c != json_col]
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("line", "test_id")))

