"""Unified diffs: files, hunks, change rows and enclosing scopes. A diff is parsed within its row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import intervals
from millrace.sources.shared import removed, stored, wide

# The header of a hunk, and what looks like the definition of a function or class.
HUNK = r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@(?:\s*(.*))?$"
FUNCTION = r"(?:def|function|func|fn)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)|(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z_$][a-zA-Z0-9_$]*)\s*=>|([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\([^)]*\)\s*(?:\{|throws)"
CLASS = r"(?:class|struct|interface|type)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"


#: Positions of a file's hunks: a file begins at its number times this.
FILE = 1 << 32


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def function_name(text: Column) -> Column:
    return F.coalesce(*(_group(text, FUNCTION, n) for n in (1, 2, 3)))


def class_name(text: Column) -> Column:
    return _group(text, CLASS, 1)


def _first(lines: Column, name) -> Column:
    return F.get(F.filter(F.transform(lines, name), lambda x: x.isNotNull()), F.lit(0))


def _of_head(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, path, old_path, change_type and is_python of files, from ``_head``: the text before a file's first hunk."""
    first = F.substring_index("_head", "\n", 1)
    a, b = (F.trim(F.regexp_extract(first, r"^diff --git a/(.*?) b/(.*?)\s*$", n)) for n in (1, 2))
    meta = lambda p, n=1: F.trim(F.regexp_extract(F.col("_head"), rf"(?m)^{p}", n))
    added, deleted = F.col("_head").rlike(r"(?m)^new file mode"), F.col("_head").rlike(r"(?m)^deleted file mode")
    renamed = F.col("_head").rlike(r"(?m)^rename (?:from|to) ")
    to = F.nullif(meta(r"rename to (.*)$"), F.lit(""))
    rows = rows.where(first.rlike(r"^diff --git a/.*? b/.*?$")).select(
        *keep, F.when(deleted, a).when(renamed, F.coalesce(to, b)).otherwise(b).alias("path"), F.nullif(meta(r"rename from (.*)$"), F.lit("")).alias("old_path"),
        F.when(renamed, "renamed").when(deleted, "deleted").when(added, "added").otherwise("modified").alias("change_type"),
    )
    return rows.withColumn("is_python", F.col("path").endswith(".py"))


def files(diffs: DataFrame, key: str = "review_id", text_col: str = "diff") -> DataFrame:
    """A row a file: key, file_no, path, old_path, change_type, is_python, and ``_hunks``, the texts of its hunks."""
    blocks = F.filter(F.split(F.col(text_col), r"(?m)^(?=diff --git )"), lambda x: x.startswith("diff --git "))
    rows = diffs.select(key, F.posexplode(blocks).alias("file_no", "_block"))
    rows = rows.withColumn("_parts", F.split("_block", r"(?m)^(?=@@)")).withColumn("_head", F.get("_parts", F.lit(0)))
    rows = rows.withColumn("_hunks", F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))))
    return _of_head(rows, [key, "file_no", "_hunks"])


def hunks(diffs: DataFrame, key: str = "review_id", text_col: str = "diff") -> DataFrame:
    """A row a hunk, with line arrays and the numbers of added (new side) and removed (old side) lines."""
    return _of_hunks(files(diffs, key, text_col).select("*", F.posexplode("_hunks").alias("hunk_no", "_text")).drop("_hunks"))


def read_patch(spark: SparkSession, path: str, key: str = "review_id") -> DataFrame:
    """``hunks`` of patch files of any size, a review each: many tasks read one file, and no row holds more than a hunk.

    Spark deals out byte ranges of the files, cut at line ends. A range knows how many lines, files and hunks it holds; sums over the ranges
    before it give each line its number, file and hunk, so headers need not stand in the range of their lines. Lines then meet by hunk. ``key`` is the
    file's path. Rows of hunks are stored in the shared folder.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias(key), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_id"))
    opens = F.col("value").startswith("diff --git ")
    lines = lines.withColumns({"_file": opens.cast("int"), "_hunk": F.col("value").startswith("@@").cast("int")})
    # One row a range: what stands before it in its file.
    ranges = lines.groupBy(key, "_at").agg(F.count(F.lit(1)).alias("n"), F.sum("_file").alias("f"), F.sum("_hunk").alias("h"))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, "_at", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "nfh"))
    inside = Window.partitionBy(key, "_at").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumns({"_line": F.row_number().over(Window.partitionBy(key, "_at").orderBy("_id")), "_files": F.sum("_file").over(inside), "_hunks": F.sum("_hunk").over(inside)}).join(ranges, [key, "_at"])
    placed = placed.select(key, (F.col("_n") + F.col("_line")).alias("line"), (F.col("_f") + F.col("_files")).alias("file"), (F.col("_h") + F.col("_hunks")).alias("hunk"), "value").where("file > 0")
    spark_parts, parts_path = stored(placed, "patch")
    # Hunks are counted through the patch; a file's first one tells where its own begin.
    first = spark_parts.groupBy(key, "file").agg(F.min("hunk").alias("_none"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    parts = spark_parts.groupBy(key, "file", "hunk").agg(text.alias("_text")).join(wide(first), [key, "file"])
    parts = parts.select(key, (F.col("file") - 1).cast("int").alias("file_no"), (F.col("hunk") - F.col("_none") - 1).cast("int").alias("hunk_no"), "_text")
    parts, texts_path = stored(parts, "patch-texts")
    heads = _of_head(parts.where("hunk_no = -1").withColumnRenamed("_text", "_head"), [key, "file_no"])
    out, _ = stored(_of_hunks(parts.where("hunk_no >= 0").join(wide(heads), [key, "file_no"])), "patch-hunks")
    removed(spark, parts_path, texts_path)
    return out


def _of_hunks(rows: DataFrame) -> DataFrame:
    """Rows of hunks from ``_text``, a hunk with its header."""
    rows = rows.withColumn("_lines", T.lines(F.col("_text")))
    header = F.get("_lines", F.lit(0))
    number = lambda n: _group(F.col("header"), HUNK, n).cast("int")
    rows = rows.withColumn("header", header).where(F.col("header").rlike(HUNK))
    rows = rows.withColumns({"old_start": number(1), "old_lines": F.coalesce(number(2), F.lit(1)), "new_start": number(3), "new_lines": F.coalesce(number(4), F.lit(1)), "hint": F.trim(F.regexp_extract("header", HUNK, 5))})
    body = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    rows = rows.withColumn("_body", body).withColumn("diff_content", F.array_join("_lines", "\n"))
    kind = "array<int>"

    def step(s: Column, x: Column) -> Column:
        mark = F.substring(x, 1, 1)
        plus, minus, same = (F.when(mark == m, 1).otherwise(0) for m in "+- ")
        grow = lambda c, m, at: F.when(mark == m, F.concat(s[c], F.array(s[at]))).otherwise(s[c]).alias(c)
        return F.struct((s["old"] + minus + same).alias("old"), (s["new"] + plus + same).alias("new"), grow("a", "+", "new"), grow("r", "-", "old"))

    numbers = F.aggregate("_body", F.struct(F.col("old_start").alias("old"), F.col("new_start").alias("new"), F.array().cast(kind).alias("a"), F.array().cast(kind).alias("r")), step)
    side = lambda m: F.transform(F.filter("_body", lambda x: F.substring(x, 1, 1) == m), lambda x: F.substr(x, F.lit(2)))
    return rows.withColumns({"_n": numbers, "added_lines": side("+"), "removed_lines": side("-"), "context_lines": side(" ")}).withColumns({"added_at": F.col("_n.a"), "removed_at": F.col("_n.r")}).drop("_n", "_text", "_body")


def changes(diffs: DataFrame, scopes: DataFrame | None = None, key: str = "review_id", text_col: str = "diff") -> DataFrame:
    """Change rows: hunks with function and class, from scopes of Python files where given, else from hint, then lines.

    ``scopes``: key, path, name, qualname, parent_class, start_line, end_line, is_class, ord; of the new side, or the old one of deleted files.
    """
    rows, tables = hunks(diffs, key, text_col), []
    if scopes is not None:
        # Diffs and sources are parsed once each; what follows reads their rows several times.
        (rows, a), (scopes, b) = stored(rows, "hunks"), stored(scopes, "scopes")
        rows, tables = rows.join(wide(enclosing(rows, scopes, key)), [key, "file_no", "hunk_no"], "left"), [a, b]
    else:
        rows = rows.withColumns({"_f": F.lit(None).cast("string"), "_c": F.lit(None).cast("string")})
    every = F.concat("added_lines", "removed_lines", "_lines")
    hinted = F.coalesce(function_name(F.col("hint")), class_name(F.col("hint")))
    by_lines = F.col("_f").isNull() & hinted.isNull()
    function = F.coalesce("_f", hinted, _first(every, function_name))
    cls = F.when(F.col("_f").isNotNull(), F.col("_c")).otherwise(
        F.when(by_lines, F.coalesce(_first(every, class_name), class_name(F.col("hint")), F.col("_c"))).otherwise(F.coalesce(class_name(F.col("hint")), F.col("_c")))
    )
    rows = rows.withColumns({"function_name": function, "class_name": cls})
    rows = rows.withColumn("pos", F.col("file_no") * F.lit(FILE) + F.col("hunk_no"))
    rows = rows.select(key, "pos", F.col("path").alias("file_path"), "old_path", "change_type", "is_python", "function_name", "class_name", "old_start", "old_lines", "new_start", "new_lines", "diff_content", "added_lines", "removed_lines", "header")
    if tables:
        rows, _ = stored(rows, "changes")
        removed(rows.sparkSession, *tables)
    return rows


def enclosing(rows: DataFrame, scopes: DataFrame, key: str = "review_id") -> DataFrame:
    """Per hunk the innermost function (``_f``) and its class (``_c``): most changed lines within, then smallest span, then first.

    Lines meet the scopes that hold them through bins of a hierarchy of widths, so a file of many scopes is no quadratic join. Hunks
    without changed lines, or whose lines hit nothing, fall back to the scopes that their span overlaps.
    """
    gone = F.col("change_type") == "deleted"
    at = F.when(gone, F.col("removed_at")).otherwise(F.col("added_at"))
    start = F.when(gone, F.col("old_start")).otherwise(F.col("new_start"))
    count = F.when(gone, F.col("old_lines")).otherwise(F.col("new_lines"))
    low = F.greatest(F.lit(1), start)
    ids = [key, "file_no", "hunk_no"]
    base = rows.where("is_python").select(*ids, "path", at.alias("at"), low.alias("lo"), F.greatest(low, start + F.greatest(F.lit(1), count) - 1).alias("hi"))
    s = scopes.select(key, "path", "ord", "name", "parent_class", "is_class", "start_line", "end_line", (F.col("end_line") - F.col("start_line")).alias("span"))
    what = ["ord", "name", "parent_class", "is_class", "span"]
    hit = intervals.containing(base.select(*ids, "path", F.explode("at").alias("line")), s, [key, "path"], "line", "start_line", "end_line").withColumn("hit", F.lit(1))
    near = intervals.overlapping(base.select(*ids, "path", "lo", "hi"), s, [key, "path"], ("lo", "hi"), ("start_line", "end_line")).withColumn("hit", F.lit(0))
    scored = hit.select(*ids, *what, "hit").unionByName(near.select(*ids, *what, "hit")).groupBy(*ids, *what).agg(F.sum("hit").alias("hits"))
    # A scope that holds no changed line counts only where none does.
    order = F.struct((F.col("hits") == 0).alias("none"), "is_class", (-F.col("hits")).alias("hits"), "span", "ord")
    best = scored.groupBy(*ids).agg(F.min_by(F.struct("name", "is_class", "parent_class"), order).alias("s"))
    return best.select(*ids, F.when(~F.col("s.is_class"), F.col("s.name")).alias("_f"), F.when(F.col("s.is_class"), F.col("s.name")).otherwise(F.col("s.parent_class")).alias("_c"))


def totals(diffs: DataFrame, key: str = "review_id", text_col: str = "diff") -> DataFrame:
    """Files, Python files, added and removed lines of each diff."""
    f = files(diffs, key, text_col).groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.count_if("is_python").alias("python_files"))
    h = hunks(diffs, key, text_col).groupBy(key).agg(F.sum(F.size("added_lines")).alias("additions"), F.sum(F.size("removed_lines")).alias("deletions"))
    return f.join(wide(h), key, "left").na.fill(0, ["additions", "deletions"])


def by_file(rows: DataFrame, key: str = "review_id") -> DataFrame:
    """Rollup of change rows: lines and distinct functions, in order of first sight."""
    sizes = rows.groupBy(key, "file_path").agg(F.first("change_type").alias("change_type"), F.count(F.lit(1)).alias("hunks"), F.sum(F.size("added_lines")).alias("additions"), F.sum(F.size("removed_lines")).alias("deletions"))
    seen = rows.where("function_name is not null").groupBy(key, "file_path", "function_name").agg(F.min("pos").alias("pos"))
    names = seen.groupBy(key, "file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "function_name"))), lambda x: x["function_name"]).alias("functions"))
    return sizes.join(wide(names), [key, "file_path"], "left")
