"""Sources: trees of source files, repositories, hosted repositories, event files, scanner reports."""

from __future__ import annotations

import base64
import json
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.schema import LANGUAGE_OF, SKIP_DIRS


def skipped(path: Column) -> Column:
    """Whether a step of the path below the root is a directory that scans leave out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def scan_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(LANGUAGE_OF), most_bytes: int = 524_288) -> DataFrame:
    """(path below the root, source) of the files under ``root``, any store. Names and sizes are filtered on metadata, before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.substring_index(F.col("path"), f"{base}/", -1)
    rows = files.where(F.col("length") <= most_bytes).withColumn("_p", below).where(~skipped(F.col("_p")))
    return rows.select(F.col("_p").alias("path"), F.decode("content", "UTF-8").alias("source"))


def from_map(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(sources.items()), "path string, source string")


def pasted(spark: SparkSession, text: str, name: str = "snippet.py") -> DataFrame:
    return from_map(spark, {name: text})


def at_ref(wanted: DataFrame, committed: DataFrame, working: DataFrame) -> DataFrame:
    """wanted (ref, path) with the content at the ref, else the working copy's."""
    rows = wanted.join(committed.select("ref", "path", F.col("source").alias("_a")), ["ref", "path"], "left").join(working.select("path", F.col("source").alias("_b")), "path", "left")
    return rows.select("ref", "path", F.coalesce("_a", "_b").alias("source"))


def read_event(spark: SparkSession, path: str) -> DataFrame:
    """owner, repo, number, title of a pull request event file."""
    e = spark.read.text(path, wholetext=True)
    get = lambda p: F.get_json_object("value", p)
    name = get("$.repository.full_name")
    return e.select(F.split(name, "/")[0].alias("owner"), F.split(name, "/")[1].alias("repo"), get("$.pull_request.number").cast("int").alias("number"), get("$.pull_request.title").alias("title"))


def tree_files(answers: DataFrame, json_col: str = "body") -> DataFrame:
    """Paths of blobs in tree listings of a hosting service's API."""
    t = answers.select(F.explode(F.from_json(json_col, "tree array<struct<path:string,type:string,size:long>>")["tree"]).alias("t"))
    return t.where("t.type = 'blob'").select("t.path", "t.size")


def decoded(answers: DataFrame, json_col: str = "body") -> DataFrame:
    """path and source of content answers, whose text is base64 with line ends."""
    a = answers.select(F.from_json(json_col, "path string, content string").alias("a"))
    return a.select("a.path", F.decode(F.unbase64(F.regexp_replace("a.content", r"\s", "")), "UTF-8").alias("source"))


class GitDiff(DataSource):
    """``spark.read.format("git_diff")``: one row (path, diff) of a repository that the workers can open.

    Options: repo, base, head, triple_dot (default true; falls back to two dots), context.
    """

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "repo string, base string, head string, diff string"

    def reader(self, schema) -> DataSourceReader:
        return _GitDiffReader(dict(self.options))


class _GitDiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        o = self.o
        base, head = o.get("base", "main"), o.get("head", "HEAD")
        wide = o.get("triple_dot", "true").lower() == "true"
        for dots in ("...", "..") if wide else ("..",):
            cmd = ["git", "-C", o["repo"], "diff", f"-U{int(o.get('context', 3))}", f"{base}{dots}{head}"]
            done = subprocess.run(cmd, capture_output=True, text=True, timeout=60)
            if done.returncode == 0:
                yield o["repo"], base, head, done.stdout
                return
        raise RuntimeError(done.stderr.strip())


class GitFiles(DataSource):
    """``spark.read.format("git_files")``: (path, source, error) of a repository at a revision. Options: repo, ref, suffixes (comma-separated), parts."""

    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "path string, source string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _GitFilesReader(dict(self.options))


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _GitFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def _git(self, *args: str) -> bytes:
        done = subprocess.run(["git", "-C", self.o["repo"], *args], capture_output=True, timeout=60)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace").strip())
        return done.stdout

    def partitions(self) -> list[InputPartition]:
        names = self._git("ls-tree", "-r", "-z", "--name-only", self.o.get("ref", "HEAD")).decode(errors="replace").split("\0")
        suffixes = tuple(x for x in self.o.get("suffixes", "").split(",") if x)
        names = [n for n in names if n and (not suffixes or n.endswith(suffixes))]
        step = max(1, -(-len(names) // int(self.o.get("parts", 8))))
        return [_Paths(names[at : at + step]) for at in range(0, len(names), step)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        """One git process for all paths of the partition. A path that is no file at the revision is a row with its error."""
        if not partition.paths:
            return
        ref = self.o.get("ref", "HEAD")
        with subprocess.Popen(["git", "-C", self.o["repo"], "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
            for path in partition.paths:
                if "\n" in path:
                    yield path, None, "a line end in the name"
                    continue
                git.stdin.write(f"{ref}:{path}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().split()
                if len(head) != 3 or head[1:2] not in ([b"blob"], [b"tree"], [b"commit"]):
                    yield path, None, b" ".join(head).decode(errors="replace") or "git ended"
                    continue
                size = int(head[2])
                content = git.stdout.read(size + 1)[:size]
                yield (path, content.decode(errors="replace"), None) if head[1] == b"blob" else (path, None, f"a {head[1].decode()}")
            git.stdin.close()


class RateLimit(RuntimeError):
    """A hosting service's quota is used up."""


def fetched(paths: DataFrame, hosted: Hosted, owner: str, repo: str, ref: str) -> DataFrame:
    """(path, source, error) of paths of a hosted repository, fetched in Arrow batches; the raw address first, then the API.

    A file that fails has a null source and its error. Once a task is refused for the rate limit, it asks for no more of its files: they have that error too.
    """

    @F.pandas_udf("source string, error string")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        refused = None
        for names in batches:
            out = []
            for path in names:
                if refused:
                    out.append((None, refused))
                    continue
                try:
                    out.append((hosted.raw(owner, repo, path, ref), None))
                except RateLimit as e:
                    refused = str(e)
                    out.append((None, refused))
                except (OSError, ValueError, KeyError) as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "error"])

    return paths.select("path", content("path").alias("_r")).select("path", "_r.source", "_r.error")


class Hosted:
    """A hosting service's REST API, driver-side; ``open_url`` is replaceable. Raises at the rate limit."""

    def __init__(self, token: str = "", api: str = "https://api.github.com", open_url: Callable = urllib.request.urlopen, timeout: float = 20, raw_url: str = "https://raw.githubusercontent.com"):
        self.token, self.api, self.open_url, self.timeout, self.raw_url = token, api, open_url, timeout, raw_url

    def _call(self, path: str, accept: str = "application/vnd.github+json", data: dict | None = None) -> str:
        headers = {"Accept": accept} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(self.api + path, json.dumps(data).encode() if data else None, headers)
        try:
            with self.open_url(request, timeout=self.timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            # Refused answers come as exceptions, with their headers.
            if e.code in (403, 429) and e.headers.get("X-RateLimit-Remaining") == "0":
                raise RateLimit(f"rate limit reached, reset at {e.headers.get('X-RateLimit-Reset', 'unknown')}") from e
            raise

    def repo(self, owner: str, repo: str) -> dict:
        return json.loads(self._call(f"/repos/{owner}/{repo}"))

    def tree(self, owner: str, repo: str, ref: str) -> str:
        return self._call(f"/repos/{owner}/{repo}/git/trees/{ref}?recursive=1")

    def raw(self, owner: str, repo: str, path: str, ref: str) -> str:
        """The file by its raw address, which has no quota; the API's base64 answer where that fails."""
        request = urllib.request.Request(f"{self.raw_url}/{owner}/{repo}/{ref}/{path}", headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with self.open_url(request, timeout=self.timeout) as answer:
                return answer.read().decode(errors="replace")
        except OSError:
            return self.content(owner, repo, path, ref)

    def content(self, owner: str, repo: str, path: str, ref: str) -> str:
        return base64.b64decode(json.loads(self._call(f"/repos/{owner}/{repo}/contents/{path}?ref={ref}"))["content"]).decode()

    def pull(self, owner: str, repo: str, number: int) -> dict:
        return json.loads(self._call(f"/repos/{owner}/{repo}/pulls/{number}"))

    def pull_diff(self, owner: str, repo: str, number: int) -> str:
        return self._call(f"/repos/{owner}/{repo}/pulls/{number}", "application/vnd.github.v3.diff")

    def compare(self, owner: str, repo: str, base: str, head: str) -> str:
        return self._call(f"/repos/{owner}/{repo}/compare/{base}...{head}", "application/vnd.github.v3.diff")

    def comment(self, owner: str, repo: str, number: int, body: str) -> str:
        return self._call(f"/repos/{owner}/{repo}/issues/{number}/comments", data={"body": body})


__all__ = ["GitDiff", "GitFiles", "Hosted", "RateLimit", "at_ref", "decoded", "fetched", "from_map", "pasted", "read_event", "scan_sources", "skipped", "tree_files"]
