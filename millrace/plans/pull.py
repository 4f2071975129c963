"""Reviews of repositories and pull requests: changes of two revisions, the graph of a tree, and the job's entry point."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import diff, graph, providers, syntax
from millrace.plans import review
from millrace.sources import code
from millrace.sources.shared import cut


def import_edges(sources: DataFrame) -> DataFrame:
    """Resolved imports of Python and script sources: src, ord, module, dst."""
    kind = T.language(F.col("path"))["code"]
    python = syntax.imports(sources.where(kind == "python"))
    python = python.withColumn("candidates", graph.python_candidates(F.col("src"), F.col("module"))).withColumn("drop_unresolved", F.lit(False))
    script = sources.where(kind.isin("javascript", "typescript")).select(F.col("path").alias("src"), F.posexplode(graph.script_imports(F.col("source"))).alias("ord", "module"))
    near = F.col("module").startswith(".")
    none = F.array().cast("array<string>")
    script = script.withColumn("candidates", F.when(near, graph.script_candidates(F.col("src"), F.col("module"))).otherwise(none)).withColumn("drop_unresolved", near)
    external = script.where(F.size("candidates") == 0).select("src", "ord", "module", F.lit(None).cast("string").alias("dst"))
    return graph.resolve(python.unionByName(script.where(F.size("candidates") > 0)), sources.select("path")).unionByName(external)


def build_graph(sources: DataFrame) -> dict[str, DataFrame]:
    """The import graph of a tree of sources, local or remote: edges, reverse, external, errors and stats."""
    resolved = import_edges(sources)
    edges = graph.edges(resolved)
    checked = sources.where(T.is_python(F.col("path"))).select("path", syntax.check_syntax(F.col("source"), F.col("path")).alias("r"))
    errors = checked.where("not r.valid and r.error <> 'empty'").select("path", F.col("r.error").alias("error"))
    return {"edges": edges, "reverse": graph.reverse(edges), "external": graph.external(resolved), "errors": errors, "stats": graph.stats(sources.select("path"), edges, errors)}


def remote_sources(spark: SparkSession, hosted: code.Hosted, owner: str, repo: str, ref: str, most_bytes: int = 524_288) -> DataFrame:
    """(path, source, error) of a hosted repository at a ref: the tree is listed once, each file is fetched once, by the task that holds its path.

    Files that could not be fetched have a null source; ``unfetched`` names them.
    """
    listed = code.tree_files(spark.createDataFrame([(hosted.tree(owner, repo, ref),)], "body string"))
    wanted = listed.where((F.col("size") <= most_bytes) & ~code.skipped(F.col("path")) & (T.language(F.col("path"))["name"] != "Code"))
    return cut(code.fetched(wanted.select("path"), hosted, owner, repo, ref))


def unfetched(sources: DataFrame) -> DataFrame:
    """path and error of the files of ``remote_sources`` that are missing from it."""
    return sources.where("error is not null").select("path", "error")


def extract_review_changes(spark: SparkSession, repo: str, base: str = "main", head: str = "HEAD", triple_dot: bool = True, context: int = 3, review_id: int = 1) -> DataFrame:
    """Change rows of two revisions of a git repository: its diff, and for Python files the scopes of their content at the revision.

    Deleted files are parsed as of the base. A repository is one review; the workers must be able to open it.
    """
    spark.dataSource.register(code.GitDiff)
    spark.dataSource.register(code.GitFiles)
    diffs = spark.read.format("git_diff").options(repo=repo, base=base, head=head, triple_dot=str(triple_dot).lower(), context=str(context)).load()
    diffs = diffs.select(F.lit(review_id).alias("review_id"), "diff")
    files = diff.files(diffs).where("is_python").select("review_id", "path", "change_type")
    at = lambda ref: spark.read.format("git_files").options(repo=repo, ref=ref, suffixes=".py").load().where("source is not null").select("path", "source")
    # A file that git can't give has no scopes; its changes take their names from the text.
    there = files.where("change_type <> 'deleted'").join(at(head), "path").unionByName(files.where("change_type = 'deleted'").join(at(base), "path"))
    scopes = syntax.scopes(there).join(there.select("path", "review_id"), "path")
    return diff.changes(diffs, scopes)


def changes_text(changes: DataFrame) -> DataFrame:
    """One line a change, in order."""
    return changes.select("review_id", "pos", review.change_text().alias("text")).orderBy("review_id", "pos")


def review_repository(spark: SparkSession, repo: str, base: str = "main", head: str = "HEAD", make: Callable[[], providers.Provider] = providers.Stub, **options) -> review.Review:
    return review.review_changes(extract_review_changes(spark, repo, base, head), make, **options)


def review_pull_request(spark: SparkSession, url: str, hosted: code.Hosted, make: Callable[[], providers.Provider] = providers.Stub, comment: bool = False, **options) -> review.Review:
    """The diff of a pull request reviewed as a whole; with ``comment`` its report is posted there."""
    parts: Column = T.github_parts(F.lit(url))
    owner, name, number = spark.range(1).select(parts.alias("p")).select("p.*").first()
    if number is None:
        raise ValueError(f"not the address of a pull request: {url}")
    diffs = spark.createDataFrame([(number, hosted.pull_diff(owner, name, number))], "review_id int, diff string")
    result = review.review_diffs(diffs, make=make, **options)
    if comment:
        hosted.comment(owner, name, number, result.reports.first()["report"])  # one review, one report
    return result


def main(argv: list[str] | None = None) -> int:
    """Reviews a repository's changes or a pull request; the exit code says whether anything high or critical was found."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("target", help="folder of a git repository, or address of a pull request")
    p.add_argument("--base", default="main")
    p.add_argument("--head", default="HEAD")
    p.add_argument("--token", default="")
    p.add_argument("--comment", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("review").getOrCreate()
    if "/pull/" in a.target:
        result = review_pull_request(spark, a.target, code.Hosted(a.token), comment=a.comment)
    else:
        result = review_repository(spark, a.target, a.base, a.head)
    for row in result.reports.toLocalIterator():
        print(row["report"])
    return 1 if review.high_or_critical(result.findings).where("urgent > 0").limit(1).count() else 0


if __name__ == "__main__":
    raise SystemExit(main())
