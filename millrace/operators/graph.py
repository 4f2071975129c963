"""Import graphs: script imports, prioritised resolution, reverse index, statistics and Mermaid text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.shared import wide

# The import forms of scripts, and the suffixes tried in order.
SCRIPT_IMPORT = r"""(?:import\s+(?:(?:[\w*\s{},]+)\s+from\s+)?['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\)|export\s+(?:(?:[\w*\s{},]+)\s+from\s+)?['"]([^'"]+)['"])"""
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".css", ".json")


def script_imports(source: Column) -> Column:
    """array<string> of module names, in order."""
    one, two, three = (F.regexp_extract_all(source, F.lit(SCRIPT_IMPORT), F.lit(n)) for n in (1, 2, 3))
    picked = F.transform(F.arrays_zip(one.alias("a"), two.alias("b"), three.alias("c")), lambda x: F.trim(F.concat(x["a"], x["b"], x["c"])))
    return F.filter(picked, lambda x: x != "")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def python_candidates(path: Column, module: Column) -> Column:
    """Paths in order of priority: module and package from the root, then beside the importer."""
    m, d = F.replace(module, F.lit("."), F.lit("/")), _folder(path)
    root = [F.concat(m, F.lit(".py")), F.concat(m, F.lit("/__init__.py"))]
    near = [F.concat(d, F.lit("/"), x) for x in root]
    return F.when(d == "", F.array(*root)).otherwise(F.array(*root, *near))


def script_candidates(path: Column, module: Column) -> Column:
    """Of a relative module: itself, then each suffix as file and as index of a folder."""
    target = T.normal_path(F.concat_ws("/", F.nullif(_folder(path), F.lit("")), module))
    return F.array(target, *(x for s in SCRIPT_SUFFIXES for x in (F.concat(target, F.lit(s)), F.concat(target, F.lit(f"/index{s}")))))


def resolve(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (src, ord, module, candidates, drop_unresolved) against paths (path): src, ord, module, dst (null: external).

    Candidates are exploded with their priority and meet the paths in one equi-join; the first that exists wins.
    """
    tried = imports.select("src", "ord", "module", F.posexplode("candidates").alias("priority", "path"))
    found = tried.join(wide(paths.select("path").distinct()), "path").groupBy("src", "ord", "module").agg(F.min_by("path", "priority").alias("dst"))
    out = imports.select("src", "ord", "module", "drop_unresolved").join(wide(found), ["src", "ord", "module"], "left")
    return out.where(F.col("dst").isNotNull() | ~F.col("drop_unresolved")).drop("drop_unresolved")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) in order of first import."""
    first = resolved.where("dst is not null").groupBy("src", "dst").agg(F.min("ord").alias("first"))
    return first.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("first", "dst")) - 1).alias("ord"))


def external(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is null").groupBy("src", "module").agg(F.min("ord").alias("ord"))


def reverse(e: DataFrame) -> DataFrame:
    return e.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("importers"))


def in_degree(e: DataFrame, k: int = 20) -> DataFrame:
    """The k targets with the most distinct sources; ties by name."""
    return e.groupBy("dst").agg(F.countDistinct("src").alias("importers")).orderBy(F.desc("importers"), "dst").limit(k)


def stats(paths: DataFrame, e: DataFrame, errors: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(paths, "files").crossJoin(n(e, "edges")).crossJoin(n(errors, "errors"))  # single rows


def mermaid(paths: DataFrame, e: DataFrame, most: int = 50, first: int = 35) -> str:
    """Text of the graph: at most ``most`` edges, and unlinked ones of the first files by folder. Both limits are the feature."""
    node = lambda c: F.concat(T.mermaid_id(F.col(c)), F.lit('["'), F.col(c), F.lit('"]'))
    shown = e.orderBy("src", "ord").limit(most)
    lines = [r[0] for r in shown.select(F.concat(F.lit("    "), node("src"), F.lit(" --> "), node("dst"))).collect()]
    linked = shown.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    folder = F.coalesce(F.nullif(_folder(F.col("path")), F.lit("")), F.lit("root"))
    alone = paths.orderBy("path").limit(first).join(linked, "path", "left_anti")
    item = F.concat(F.lit("        "), T.mermaid_id(F.col("path")), F.lit('["'), F.regexp_extract("path", r"([^/]*)$", 1), F.lit('"]'))
    groups = alone.groupBy(folder.alias("d")).agg(F.min("path").alias("p"), F.array_sort(F.collect_list(item)).alias("items")).orderBy("p").collect()
    for n, g in enumerate(groups):
        lines += [f'    subgraph dir_{n}["📁 {g["d"]}"]', *g["items"], "    end"]
    return "\n".join(["graph TD;", *lines]) if lines else "graph TD;\n    empty[No files found in repository]"
