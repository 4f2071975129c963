"""Markdown reports and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.schema import SEVERITIES, severity_rank


def _section(label: str, body: Column) -> Column:
    return F.when(F.length(body) > 0, F.concat(F.lit(label), body, F.lit("\n\n"))).otherwise(F.lit(""))


def finding_text() -> Column:
    """A finding row with ``n``, its number within its level."""
    c = F.col
    tools = F.when(F.size("source_tools") > 1, F.array_join(F.transform("source_tools", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")).otherwise(F.concat(F.lit("`"), F.coalesce("primary_tool", F.lit("unknown")), F.lit("`")))
    moved = F.when((c("reported_severity") != "") & (c("reported_severity") != c("severity")), F.format_string(" *(reclassified from `%s`)*", "reported_severity")).otherwise(F.lit(""))
    line = F.coalesce(F.nullif(c("line_number").cast("string"), F.lit("0")), F.lit("N/A"))
    head = F.format_string("#### %d. %s\n\n**Tool(s)**: %s | **File**: `%s` | **Line**: `%s` | **Confidence**: `%s`%s\n\n%s\n\n", c("n"), c("title"), tools, c("file"), line, c("confidence"), moved, c("description"))
    cwe = F.when(F.length("cwe_id") > 0, F.format_string("**CWE**: [%s](https://cwe.mitre.org/data/definitions/%s.html)\n\n", c("cwe_id"), F.replace(c("cwe_id"), F.lit("CWE-"), F.lit("")))).otherwise(F.lit(""))
    code = _section("**Affected Code:**\n```python\n", F.when(F.length("affected_code") > 0, F.concat(c("affected_code"), F.lit("\n```"))))
    advice = _section("**Suggested Remediation:**\n> ", c("suggested_remediation"))
    notes = F.when(F.size("merge_notes") > 0, F.concat(F.lit("<details><summary>Aggregation notes</summary>\n\n"), F.array_join(F.transform("merge_notes", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n</details>\n\n"))).otherwise(F.lit(""))
    return F.concat(head, cwe, code, advice, notes, F.lit("---\n\n"))


def render(findings: DataFrame, reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """One markdown text a review. reviews: key, filename, secrets, sanitized. findings: classified, with ``ordinal``."""
    from pyspark.sql import Window

    from millrace.schema import confidence_rank

    w = Window.partitionBy(key, "severity").orderBy(confidence_rank(F.col("confidence")).desc(), "ordinal")
    rows = findings.withColumn("n", F.row_number().over(w)).withColumn("_t", finding_text())
    levels = rows.groupBy(key, "severity").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_t"))), lambda x: x["_t"]), "").alias("_b"))
    rank = (-severity_rank(F.col("severity"))).alias("r")
    name = F.concat(T.emoji(F.col("severity")), F.lit(" "), F.initcap("severity"))
    levels = levels.select(key, F.struct(rank, F.format_string("| %s | %d |\n", name, F.col("k")).alias("row"), F.concat(F.format_string("### %s (%d)\n\n", name, F.col("k")), F.col("_b")).alias("text"), "severity", "k").alias("l"))
    by = levels.groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("l"))
    r = reviews.join(by, key, "left")
    total = F.coalesce(F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["k"]), F.lit(0))
    highest = F.coalesce(F.get("l", F.lit(0))["severity"], F.lit("none"))
    yes = F.when(F.coalesce("sanitized", F.lit(False)), "✅ Yes").otherwise("❌ No")
    head = F.format_string(
        "# 🔍 Code Review Report — `%s`\n\n---\n\n## 📊 Summary\n\n| Metric | Value |\n|--------|-------|\n| Total Findings | **%d** |\n| Highest Severity | **%s %s** |\n| Secrets Detected | `%d` |\n| Sanitization Applied | %s |\n",
        F.col("filename"), total, T.emoji(highest), F.upper(highest), F.coalesce("secrets", F.lit(0)), yes,
    )
    table = F.coalesce(F.array_join(F.transform("l", lambda x: x["row"]), ""), F.lit(""))
    body = F.when(total == 0, F.lit("\n---\n\n## ✅ No Issues Found\n\nThe code review pipeline completed without detecting any findings.")).otherwise(F.concat(F.lit("\n---\n\n## 🚨 Findings\n\n"), F.array_join(F.transform("l", lambda x: x["text"]), "")))
    return r.select(key, total.alias("total_findings"), highest.alias("highest_severity"), F.concat(head, table, body).alias("report"))


def to_json(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*(cols or df.columns))).alias("value"))


__all__ = ["SEVERITIES", "finding_text", "render", "to_json"]
