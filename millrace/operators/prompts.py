"""Prompts of the model calls. The first line names the kind of request and its subject; the last says what shape the answer has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

FINDINGS_SHAPE = '{"findings": [{"title": "", "description": "", "severity": "critical|high|medium|low|info", "confidence": "high|medium|low", "affected_code": "", "reasoning": "", "suggested_remediation": "", "line_number": 0, "cwe_id": "", "category": ""}]}'
FIX_SHAPE = '{"proposed_fix": "", "explanation": ""}'
VERDICT_SHAPE = '{"is_acceptable": true, "feedback": ""}'

SCAN_TASK = (
    "Look for weaknesses that an attacker could use: injection, unsafe deserialisation, broken authentication, secrets in code, weak cryptography, path and request forgery. "
    "Report only what the code shows, one entry a weakness, with its line."
)
LOGIC_TASK = (
    "Look for mistakes in what the code does: wrong conditions, missing checks of input or state, races, amounts or states that can be reached twice. "
    "Leave out style, and what a static scanner finds."
)


def _section(title: str, body: Column) -> Column:
    """A titled part, left out if its body is null or empty."""
    return F.when(F.length(F.trim(body)) > 0, F.concat(F.lit(f"\n\n## {title}\n"), body)).otherwise(F.lit(""))


def _answer(shape: str) -> Column:
    return F.lit(f"\n\nAnswer with JSON only, in this shape:\n{shape}")


def scan(path: Column, code: Column, kind: str = "Scan", context: Column | None = None, knowledge: Column | None = None) -> Column:
    """Of a source or a diff payload; line numbers are shown so that answers can name them."""
    task = LOGIC_TASK if kind == "Logic" else SCAN_TASK
    body = T.format_code(code, path)
    diff = F.when(T.is_diff_payload(code), F.lit("\nOnly changed lines are in question; unchanged ones are context.")).otherwise(F.lit(""))
    out = F.concat(F.lit(f"# {kind} "), path, F.lit("\n"), body, F.lit(f"\n\n## Task\n{task}"), diff)
    if context is not None:
        out = F.concat(out, _section("Related code", F.coalesce(context, F.lit(""))))
    if knowledge is not None:
        out = F.concat(out, _section("Known weaknesses", F.coalesce(knowledge, F.lit(""))))
    return F.concat(out, _answer(FINDINGS_SHAPE))


def fix() -> Column:
    """Of a finding row (title, path, code, feedback and, where present, description, knowledge)."""
    feedback = _section("Feedback on the last attempt", F.coalesce(F.col("feedback"), F.lit("")))
    language = T.language(F.col("path"))["name"]
    return F.concat(
        F.lit("# Fix "), F.col("title"), F.lit("\n"), F.coalesce(F.col("code"), F.lit("")), feedback,
        F.lit("\n\n## Task\nReplace this "), language, F.lit(" code so that the finding no longer holds and nothing else changes. Give code that stands for the part shown, whole and valid."), _answer(FIX_SHAPE),
    )


def judge() -> Column:
    return F.concat(
        F.lit("# Judge "), F.col("title"), F.lit("\n"), F.col("proposed_fix"), _section("Original", F.coalesce(F.col("code"), F.lit(""))),
        F.lit("\n\n## Task\nSay whether the proposal removes the finding without new faults. If not, say in a sentence what to change."), _answer(VERDICT_SHAPE),
    )


def summary(name: Column, snippet: Column) -> Column:
    return F.concat(F.lit("# Summarise "), name, F.lit("\n"), snippet, F.lit("\n\n## Task\nSay in two sentences what this code does."))
