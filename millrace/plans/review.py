"""A whole review, as DataFrames keyed by review: redact, analyse, merge, grade, fix, decide, report; saved and taken up again by thread."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import knowledge
from millrace.functions import text as T
from millrace.operators import chunks, diff, findings, loop, providers, redact, report, rubric, state
from millrace.sources.store import Table


@dataclass(frozen=True)
class Review:
    """The tables of a run; errors are rows with their producer."""

    sanitized: DataFrame
    findings: DataFrame
    summary: DataFrame
    fixes: DataFrame | None
    status: DataFrame
    reports: DataFrame
    errors: DataFrame


def flags(sources: DataFrame, with_scanner: bool = True, with_model: bool = True) -> DataFrame:
    """review_id, path and which agents a source goes to: blank ones to none, only Python to the static scanner."""
    some = F.length(F.trim("source")) > 0
    python = T.is_python(F.col("path"))
    return sources.select("review_id", "path", (some & python & F.lit(with_scanner)).alias("static"), (some & F.lit(with_model)).alias("security"), (some & F.lit(with_model)).alias("logic"))


def run_review(
    sources: DataFrame, make: Callable[[], providers.Provider] = providers.Stub, scanner: DataFrame | None = None, decisions: DataFrame | None = None,
    with_fixes: bool = True, with_human: bool = False, sanitize: bool = True, most_revisions: int = 2, entropy: bool = False, context: str | None = None, index: DataFrame | None = None,
) -> Review:
    """sources: review_id, path, source; a review has one or more paths. scanner: review_id, report (JSON of a static scanner). decisions: review_id, decision.

    ``index``: rows of a store whose texts on weaknesses (``knowledge.preload``) are given to the security scan, the nearest to each source.
    Every source is redacted and analysed by itself. The model's answers are written once; findings, errors, fixes and reports all
    come from them. Blank sources take part in no analysis; a review without findings says so in its report.
    """
    rows = sources.withColumnRenamed("source", "_raw")
    if sanitize:
        code = redact.sanitize(rows, "review_id", "_raw", entropy=entropy).withColumnRenamed("sanitized", "source").drop("_raw", "findings")
    else:
        code = rows.withColumnRenamed("_raw", "source").withColumn("n_secrets", F.lit(0)).withColumn("highest", F.lit(None).cast("string"))
    wanted = code.where(F.length(F.trim("source")) > 0)
    scanned = knowledge.with_knowledge(wanted, index) if index is not None else wanted
    asked = {"Scan": providers.answers(scanned, make, "Scan", context, "knowledge" if index is not None else None), "Logic": providers.answers(wanted, make, "Logic", context)}
    security = findings.normalise(providers.findings_of(asked["Scan"]), "security")
    logic = findings.normalise(providers.findings_of(asked["Logic"]).withColumn("category", F.lit("business_logic")), "logic")
    static = security.where("false")
    if scanner is not None:
        python = wanted.where(T.is_python(F.col("path"))).select("review_id").distinct()
        static = findings.normalise(findings.bandit(scanner.join(python, "review_id", "left_semi")), "static")
    graded = providers.written(rubric.classify(findings.aggregate(static, security, logic)))
    errors = providers.errors_of(asked["Scan"], "security").unionByName(providers.errors_of(asked["Logic"], "logic"))
    begun = Review(code, graded, rubric.summary(graded, "review_id"), None, code.select("review_id").distinct(), graded, errors)
    return _finish(begun, make, decisions, with_fixes, with_human, most_revisions)


def _finish(r: Review, make: Callable[[], providers.Provider], decisions: DataFrame | None, with_fixes: bool, with_human: bool, most_revisions: int) -> Review:
    """What follows the graded findings: fixes, decisions, reports of the reviews that no one has to decide on."""
    fixes = fix_findings(r.findings, make, most_revisions) if with_fixes else None
    status = r.sanitized.select("review_id").distinct()
    if with_human:
        status = status.join(decisions, "review_id", "left") if decisions is not None else status.withColumn("decision", F.lit(None).cast("string"))
        status = status.withColumn("next", state.route(F.col("decision")))
    else:
        status = status.withColumn("next", F.lit("report"))
    ready = status.where("next = 'report'").select("review_id")
    per = r.sanitized.groupBy("review_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("filename"), F.sum("n_secrets").cast("int").alias("secrets"))
    reviews = per.join(ready, "review_id", "left_semi").withColumn("sanitized", F.col("secrets") > 0)
    return replace(r, fixes=fixes, status=status, reports=report.render(r.findings.join(ready, "review_id", "left_semi"), reviews))


def fix_findings(graded: DataFrame, make: Callable[[], providers.Provider] = providers.Stub, most: int = 2) -> DataFrame:
    code = F.coalesce(F.nullif("affected_code", F.lit("")), "description")
    return loop.run(graded.select("review_id", F.col("rank").alias("finding_id"), "title", F.col("file").alias("path"), code.alias("code")), make, most)


def fixes_with_findings(fixes: DataFrame, graded: DataFrame, key: str = "review_id") -> DataFrame:
    """Fixes (key, title) with the severity and file of the first finding of that title; without one, of the review's first finding."""
    item = F.struct("rank", F.col("severity").alias("finding_severity"), F.col("file").alias("finding_file"))
    by_title = graded.groupBy(key, "title").agg(F.min(item).alias("_t"))
    first = graded.groupBy(key).agg(F.min(item).alias("_f"))
    rows = fixes.join(by_title, [key, "title"], "left").join(first, key, "left").withColumn("_m", F.coalesce("_t", "_f"))
    return rows.select(*fixes.columns, "_m.finding_severity", "_m.finding_file")


def save(r: Review, folder: str) -> None:
    """A run by thread (its review): redacted sources, findings and errors; saving a thread again replaces it."""
    for name, df, keys in (("sources", r.sanitized, ["review_id", "path"]), ("findings", r.findings, ["review_id", "rank"]), ("errors", r.errors, ["review_id", "path", "producer"])):
        _table(df.sparkSession, folder, name, keys, df._jdf.schema().toDDL()).upsert(df)
        df.sparkSession.createDataFrame([(df._jdf.schema().toDDL(),)], "ddl string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}-ddl")


def _table(spark: SparkSession, folder: str, name: str, keys: list[str], ddl: str) -> Table:
    return Table(spark, f"{folder.rstrip('/')}/{name}", keys, keys, ddl)


def export_sources(r: Review, folder: str) -> None:
    """The redacted texts as text files, a folder a review and path."""
    rows = r.sanitized.select("review_id", "path", F.col("source").alias("value"))
    rows.hint("rebalance", "review_id", "path").write.mode("overwrite").partitionBy("review_id", "path").text(folder)


def saved(spark: SparkSession, folder: str) -> Review:
    read = lambda name, keys: _table(spark, folder, name, keys, spark.read.parquet(f"{folder.rstrip('/')}/{name}-ddl").first()[0]).read()
    code, graded, errors = read("sources", ["review_id", "path"]), read("findings", ["review_id", "rank"]), read("errors", ["review_id", "path", "producer"])
    return Review(code, graded, rubric.summary(graded, "review_id"), None, code.select("review_id").distinct(), graded, errors)


def resume_review(spark: SparkSession, folder: str, decisions: DataFrame, make: Callable[[], providers.Provider] = providers.Stub, most_revisions: int = 2) -> Review:
    """Saved reviews taken up where they paused: no model is asked again but for the fixes of reviews to revise."""
    r = saved(spark, folder)
    out = _finish(r, make, decisions, False, True, most_revisions)
    again = out.status.where("next = 'fix_suggester'").select("review_id")
    return replace(out, fixes=fix_findings(r.findings.join(again, "review_id", "left_semi"), make, most_revisions))


def review_diffs(diffs: DataFrame, scopes: DataFrame | None = None, make: Callable[[], providers.Provider] = providers.Stub, max_chars: int = 4000, max_tokens: int = 4000, **options) -> Review:
    """diffs: review_id, diff. The payload of the changed code, within its budget, is reviewed as one text."""
    return review_changes(diff.changes(diffs, scopes), make, max_chars, max_tokens, **options)


def review_changes(changes: DataFrame, make: Callable[[], providers.Provider] = providers.Stub, max_chars: int = 4000, max_tokens: int = 4000, **options) -> Review:
    """changes: rows of ``diff.changes``. A review whose changes are all of one Python file goes by its name, so the scanner's results count."""
    payload = chunks.payload(chunks.chunk_changes(changes, max_chars=max_chars), max_tokens=max_tokens)
    names = changes.groupBy("review_id").agg(F.min("file_path").alias("_a"), F.max("file_path").alias("_b"), F.bool_and("is_python").alias("_p"))
    path: Column = F.when((F.col("_a") == F.col("_b")) & F.col("_p"), F.col("_a")).otherwise(F.lit("changes.diff"))
    return run_review(payload.join(names, "review_id").select("review_id", path.alias("path"), F.col("payload").alias("source")), make, **options)


def agent_rows(counts: DataFrame, agents: tuple[str, ...] = ("static", "security", "logic")) -> DataFrame:
    """Status and count of each agent of each review from counts (review_id, agent, status, n); absent ones did not run."""
    every = counts.select("review_id").distinct().withColumn("agent", F.explode(F.array(*map(F.lit, agents))))
    return every.join(counts, ["review_id", "agent"], "left").na.fill({"status": "not run", "n": 0})


def health(checks: DataFrame) -> DataFrame:
    """Checks (phase, name, ok, critical) by phase, in order: how many, failed, and failed critical ones."""
    return checks.groupBy("phase").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & F.col("critical")).alias("critical_failed")).orderBy("phase")


def failing(checks: DataFrame) -> DataFrame:
    """Failed critical checks, in order."""
    return checks.where(~F.col("ok") & F.col("critical")).orderBy("phase", "name")


def high_or_critical(graded: DataFrame, key: str = "review_id") -> DataFrame:
    """How many findings are high or critical."""
    return graded.groupBy(key).agg(F.count_if(F.col("severity").isin("critical", "high")).alias("urgent"), F.count(F.lit(1)).alias("n"))


def flat_findings(flat: DataFrame, buckets: DataFrame, key: str = "review_id") -> DataFrame:
    """Titles by review (key, severity, title) from the flat list; from the buckets (key, severity, titles) for reviews whose list is empty."""
    rest = buckets.join(flat.select(key).distinct(), key, "left_anti").select(key, "severity", F.explode("titles").alias("title"))
    return flat.select(key, "severity", "title").unionByName(rest)


def count_text(counts: DataFrame, key: str = "review_id") -> DataFrame:
    """A sentence a review from counts (key, severity, n): levels from the most severe, and the total."""
    from millrace.schema import severity_rank

    item = F.struct((-severity_rank(F.col("severity"))).alias("r"), F.format_string("%d %s", "n", "severity").alias("t"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ")
    return counts.where("n > 0").groupBy(key).agg(F.format_string("%d finding(s): %s.", F.sum("n"), parts).alias("text"))


def metric_totals(reports: DataFrame, key: str = "review_id", json_col: str = "report") -> DataFrame:
    """Lines and counts by level from a scanner's metrics; what is missing counts as 0."""
    metrics = F.from_json(F.get_json_object(json_col, "$.metrics._totals"), "map<string,double>")
    names = {"loc": "loc", "high": "SEVERITY.HIGH", "medium": "SEVERITY.MEDIUM", "low": "SEVERITY.LOW"}
    return reports.select(key, *(F.coalesce(F.element_at(metrics, F.lit(k)), F.lit(0.0)).cast("long").alias(n) for n, k in names.items()))


def status_counts(items: DataFrame, status: str = "status", known: tuple[str, ...] = ("done", "active", "planned")) -> DataFrame:
    return items.agg(*(F.count_if(F.col(status) == k).alias(k) for k in known))


def file_options(changes: DataFrame) -> DataFrame:
    """Distinct files and their scopes, sorted: the choices of a filter."""
    return changes.select("file_path", T.display_scope(F.col("class_name"), F.col("function_name")).alias("scope")).distinct().orderBy("file_path", "scope")


def only(changes: DataFrame, file: str | None = None, scope: str | None = None) -> DataFrame:
    """Changes of a file and scope, where given."""
    rows = changes if file is None else changes.where(F.col("file_path") == file)
    return rows if scope is None else rows.where(T.display_scope(F.col("class_name"), F.col("function_name")) == scope)


def change_text() -> Column:
    """One line on a change row."""
    scope = T.display_scope(F.col("class_name"), F.col("function_name"))
    return F.format_string("%s %s in %s: +%d / -%d lines at %d", F.initcap("change_type"), scope, F.col("file_path"), F.size("added_lines"), F.size("removed_lines"), F.col("new_start"))
