"""Stores on Parquet: units with vectors, checkpoints, reports."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.state import latest
from millrace.sources.shared import wide


class Stale(RuntimeError):
    """Another writer has committed what this one would replace."""


#: Buckets of a new table, by a hash of its keys, and files of a bucket beyond which it is worth compacting.
BUCKETS, MOST_DELTAS = 16, 4


class Table:
    """A keyed table under ``path``: bucketed files of rows, merged when read, and a log of versions.

    An upsert writes the last row of each of its keys to a new folder, in the buckets of these keys only, and commits the next version of
    the log: for each bucket the folders that hold it, in order. A version is one small file, created only if it isn't there, so of two writers
    that build on one version one is refused; it rebases its change onto the other's and tries again, and nothing is lost. Readers see
    a version or none of it. ``compact`` merges the folders of buckets that have many; ``vacuum`` deletes what no kept version names.

    A bucket of one folder is read as it is; others are merged by key, the last folder first. Rows that were deleted stay as marks until
    their bucket is compacted. The store must create a file only if it is absent, as HDFS and local file systems do.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], ddl: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.ddl, self.buckets = spark, path.rstrip("/"), keys, order, ddl, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/log")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders by bucket, oldest first, as of a version."""
        version = self.current() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/log/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, state: dict[str, list[str]]) -> int:
        """Makes ``state`` the version after ``base``; raises ``Stale`` if that exists."""
        final, draft, taken = (self._path(f"{self.path}/log/{n}") for n in (f"{base + 1:012d}.json", f".{uuid.uuid4().hex}", f".{base + 1:012d}.taken"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        # Of several writers one creates this file; renaming alone replaces what is there on some file systems.
        if base + 1 <= self.current() or not self._create(taken):
            self._fs.delete(draft, False)
            raise Stale(f"version {base + 1} is another writer's")
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"version {base + 1} could not be named")
        return base + 1

    def _create(self, path) -> bool:
        uri = self._fs.makeQualified(path).toUri()
        if uri.getScheme() == "file":
            # Hadoop's local file system looks first and creates then.
            return self.spark._jvm.java.io.File(uri.getPath()).createNewFile()
        return self._fs.createNewFile(path)

    def _committed(self, change: Callable[[dict[str, list[str]]], dict[str, list[str]]], tries: int = 100) -> int:
        for n in range(tries):
            base = self.current()
            try:
                return self.commit(base, change(self.state(base)))
            except Stale:
                # The other writer has taken the name and may still be filling the file.
                time.sleep(min(1.0, 0.02 * 2 ** min(n, 6)) * (0.5 + random.random()))
        raise Stale(f"no version could be committed in {tries} tries; remove the .taken file of a version that isn't there if its writer is gone")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[str], int]:
        """Writes keyed rows (with _gone) to a new folder; its name, the buckets that it has, and its rows."""
        name = f"rows-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(f"{self.ddl}, _gone boolean, _bucket int").parquet(f"{self.path}/{name}")
        found = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        return name, [str(r["_bucket"]) for r in found], sum(r["n"] for r in found)

    def _merged(self, state: dict[str, list[str]], buckets: list[str] | None = None) -> DataFrame:
        """The last row of each key, with _gone."""
        columns = f"{self.ddl}, _gone boolean, _bucket int"
        plan: dict[tuple[str, ...], list[int]] = {}
        for b, folders in state.items():
            if buckets is None or b in buckets:
                plan.setdefault(tuple(folders), []).append(int(b))
        out = self.spark.createDataFrame([], columns)
        single = {f[0]: bs for f, bs in plan.items() if len(f) == 1}
        parts: dict[str, list[tuple[int, list[int]]]] = {}
        for folders, bs in plan.items():
            for n, folder in enumerate(folders):
                if len(folders) > 1:
                    parts.setdefault(folder, []).append((n, bs))
        read = lambda folder, bs: self.spark.read.schema(columns).parquet(f"{self.path}/{folder}").where(F.col("_bucket").isin(bs))
        for folder, bs in single.items():
            out = out.unionByName(read(folder, bs))
        layers = None
        for folder, uses in parts.items():
            for n, bs in uses:
                layer = read(folder, bs).withColumn("_n", F.lit(n))
                layers = layer if layers is None else layers.unionByName(layer)
        if layers is not None:
            rest = [c for c in layers.columns if c not in (*self.keys, "_n")]
            last = layers.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_n").alias("_r"))
            out = out.unionByName(last.select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest)))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """Rows as of a version, the newest by default."""
        return self._merged(self.state(version)).where("not _gone").drop("_gone", "_bucket")

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """The last row a key wins. ``gone``: keys to delete. Returns the distinct keys written or deleted."""
        names = [f.name for f in self.spark.createDataFrame([], self.ddl).schema]
        new = latest(rows.select(*names), self.keys, self.order).withColumn("_gone", F.lit(False))
        if gone is not None:
            empty = {f.name: F.lit(None).cast(f.dataType) for f in rows.select(*names).schema if f.name not in self.keys}
            marks = gone.select(*self.keys).distinct().join(wide(rows.select(*self.keys).distinct()), self.keys, "left_anti")
            new = new.unionByName(marks.withColumns(empty | {"_gone": F.lit(True)}))
        name, buckets, n = self._write(new)
        if n:
            self._committed(lambda state: state | {b: [*state.get(b, []), name] for b in buckets})
        return n

    def compact(self, beyond: int = MOST_DELTAS) -> int:
        """Merges the folders of buckets that have more than ``beyond``. Returns how many buckets."""
        state = self.state()
        many = [b for b, folders in state.items() if len(folders) > beyond]
        if not many:
            return 0
        # Every file of these buckets is merged, so marks of deleted rows have nothing left to hide.
        name, buckets, _ = self._write(self._merged(state, many).where("not _gone").drop("_bucket"))

        def change(now: dict[str, list[str]]) -> dict[str, list[str]]:
            out = dict(now)
            for b in many:
                if now.get(b, [])[: len(state[b])] != state[b]:
                    raise RuntimeError(f"bucket {b} was compacted by another writer")
                out[b] = ([name] if b in buckets else []) + now[b][len(state[b]) :]
            return {b: f for b, f in out.items() if f}

        self._committed(change)
        return len(many)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last ``keep`` versions names, and older versions. Not beside writers, whose folders aren't named yet."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for folders in self.state(v).values() for f in folders}
        dropped = [f.getPath() for f in self._fs.listStatus(self._path(self.path)) if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in named]
        for path in dropped:
            self._fs.delete(path, True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/log/{v:012d}.json"), False)
        return len(dropped)

    def count(self) -> int:
        return self.read().count()

    def preload(self, rows: DataFrame) -> bool:
        """Fills an empty store; false if it holds rows."""
        if not self.read().isEmpty():
            return False
        self.upsert(rows)
        return True


def unit_documents(units: DataFrame, cut: int = 400) -> DataFrame:
    """Units as store documents: id, title, content (summary, signature and docstring, each cut), category and metadata."""
    part = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, cut)
    content: Column = F.concat_ws("\n", part(F.col("summary")), F.nullif(part(F.col("signature")), F.lit("")), F.nullif(part(F.col("docstring")), F.lit("")))
    meta = F.create_map(*(x for c in ("file_path", "unit_type", "start_line", "end_line", "signature") for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))))
    return units.select(F.col("stable_id").alias("id"), F.col("unit_name").alias("title"), content.alias("content"), F.lit("").alias("cwe"), F.lit("info").alias("severity"), F.lit("codebase").alias("category"), meta.alias("metadata"))


def index_summary(units: DataFrame) -> DataFrame:
    """Units by type, and files."""
    of = lambda k: F.count_if(F.col("unit_type") == k).alias(f"{k}s")
    return units.agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("units"), of("function"), F.count_if(F.col("unit_type") == "class").alias("classes"), of("method"), of("chunk"))
