"""Size-bounded grouping and budget cuts over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ordered


def chunk_changes(changes: DataFrame, key: str = "review_id", max_chars: int = 4000, python_only: bool = False, merge: bool = True) -> DataFrame:
    """Review chunks from change rows with ``pos``: adjacent ones of a file and scope within the size, or one each."""
    rows = changes.where("is_python") if python_only else changes
    rows = rows.withColumn("scope", T.display_scope(F.col("class_name"), F.col("function_name")))
    if merge:
        rows = ordered.greedy_groups(rows, [key], ["pos"], F.struct("file_path", "scope"), F.length("diff_content"), max_chars)
    else:
        rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).withColumn("group_no", F.col("position"))
    item = F.struct("position", "diff_content", "added_lines", "removed_lines")
    first = lambda c: F.min_by(c, "position").alias(c)
    g = rows.groupBy(key, "group_no").agg(
        *(first(c) for c in ("file_path", "change_type", "is_python", "function_name", "class_name", "scope")),
        F.min("old_start").alias("old_start"), F.sum("old_lines").cast("int").alias("old_lines"), F.min("new_start").alias("new_start"), F.sum("new_lines").cast("int").alias("new_lines"),
        F.array_sort(F.collect_list(item)).alias("_i"),
    )
    text = (lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) if merge else (lambda x: x)
    g = g.withColumn("diff_content", F.array_join(F.filter(F.transform("_i", lambda x: text(x["diff_content"])), lambda x: (x != "") | F.lit(not merge)), "\n\n"))
    for c in ("added_lines", "removed_lines"):
        g = g.withColumn(c, F.flatten(F.col(f"_i.{c}")))
    g = g.withColumn("char_count", F.length("diff_content")).withColumn("estimated_tokens", T.tokens(F.col("char_count")))
    return g.withColumn("chunk_id", T.chunk_id(F.col("file_path"), F.col("scope"), F.col("old_start"), F.col("new_start"))).drop("_i")


def format_chunk() -> Column:
    """Markdown of a chunk row."""
    where = F.when((F.col("old_start") != 0) | (F.col("new_start") != 0), F.format_string("Lines: -%d,%d +%d,%d", "old_start", "old_lines", "new_start", "new_lines")).otherwise(F.lit("Lines: N/A"))
    head = F.format_string("### File: `%s`\n- **Scope**: `%s`\n- **Change Type**: `%s`\n- **%s** (+%d / -%d lines)\n\n", F.col("file_path"), F.col("scope"), F.col("change_type"), where, F.size("added_lines"), F.size("removed_lines"))
    return F.concat(head, F.lit("```diff\n"), F.regexp_replace("diff_content", r"(?U)^\s+|\s+$", ""), F.lit("\n```\n"))


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: str, most: int, keep_first: bool) -> DataFrame:
    """The longest prefix whose sizes sum to at most ``most``; ``keep_first`` keeps a first row of any size.

    Sizes are positive, so a running sum gives the prefix. Adds ``rn`` and ``total``, the rows of the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    every = Window.partitionBy(*keys)
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.count(F.lit(1)).over(every))
    keep = F.col("_sum") <= most
    return rows.where(keep | (F.col("rn") == 1) if keep_first else keep).drop("_sum")


HEAD = (
    "## Changed Code for Review\n"
    "The following changes represent only the modified hunks and functions extracted from the Git diff. Review them for logic errors, vulnerabilities, and code quality.\n\n"
)


def payload(chunks: DataFrame, key: str = "review_id", max_tokens: int = 4000) -> DataFrame:
    """One markdown text a key: the chunks within the budget, and a note on how many are left out."""
    kept = within_budget(chunks, [key], ["group_no"], "estimated_tokens", max_tokens, True).withColumn("_text", F.concat(format_chunk(), F.lit("\n---\n\n")))
    g = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", "_text"))).alias("_c"), F.max("total").alias("total"))
    body = F.array_join(F.transform("_c", lambda x: x["_text"]), "")
    left = F.col("total") - F.size("_c")
    note = F.when(left > 0, F.format_string(f"\n> [!NOTE]\n> Truncated %d additional review chunk(s) to stay within the token budget ({max_tokens} tokens).\n", left)).otherwise(F.lit(""))
    return g.select(key, F.concat(F.lit(HEAD), body, note).alias("payload"), left.alias("truncated"))


def line_blocks(docs: DataFrame, path_col: str = "path", text_col: str = "source", size: int = 60) -> DataFrame:
    """Blocks of ``size`` lines of each text: path, number of n, name with padded number, first and last line, text, summary."""
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.slice("_l", b * size + 1, F.lit(size)))
    rows = docs.withColumn("_l", T.lines(F.col(text_col))).where(F.size("_l") > 0).withColumn("n", F.ceil(F.size("_l") / size).cast("int"))
    # Each block's lines are taken before the blocks become rows, so no row holds the whole text.
    rows = rows.select(path_col, "n", F.posexplode(cut).alias("_p", "_own")).withColumn("block", F.col("_p") + 1)
    start, own = F.col("_p") * size + 1, F.col("_own")
    name = F.concat(F.lit("chunk_"), F.lpad(F.col("block").cast("string"), F.length(F.col("n").cast("string")), F.lit("0")))
    rows = rows.withColumn("unit_name", name).withColumn("start_line", start).withColumn("end_line", start + F.size(own) - 1).withColumn("snippet", F.substring(F.array_join(own, "\n"), 1, 2000))
    summary = F.format_string("%s code block %d/%d in `%s` (lines %d–%d).", T.language(F.col(path_col))["name"], F.col("block"), F.col("n"), F.col(path_col), F.col("start_line"), F.col("end_line"))
    return rows.select(F.col(path_col).alias("file_path"), "block", "n", "unit_name", T.stable_id(F.col(path_col), F.col("unit_name")).alias("stable_id"), F.lit("chunk").alias("unit_type"), "start_line", "end_line", "snippet", summary.alias("summary"))
