"""Tables that change together: every change is one folder, which appears by a rename and not at all if another came first.

A set of tables is a folder with one subfolder `version=n` a commit, which holds for each table of it what the commit adds
(`kind=name.add`) or what the table is from then on (`kind=name.all`). Data are written beside it first; the rename makes them visible at
once, and fails where that version exists, so two writers that both read version n can't both write n + 1. Readers
name a version and see what was committed up to it, whatever is written meanwhile.

Tables that change by key are logs: the newest row of a key counts, and a row with `gone` removes it (`current`). `folded`
rewrites such a log as its current rows, so that reading costs no more than the table itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scratch folders, by application, of local sessions that name none.
OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which the cluster shares; where that is unset, a local session gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="parlance-tables-")
        OWN[spark.sparkContext.applicationId] = found
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written under a scratch path and read back, where several steps go on from it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(Exception):
    """Another commit took this version."""


class Versions:
    """The tables under one folder, of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *below: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))

    def listed(self, *below: str) -> list[str]:
        at = self.path(*below)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def all(self) -> list[int]:
        """The versions there are, ascending."""
        return sorted(int(x.removeprefix("version=")) for x in self.listed() if x.startswith("version="))

    def latest(self) -> int:
        """The last version, or -1."""
        return max(self.all(), default=-1)

    def tagged(self, tag: str) -> bool:
        """Whether a commit bears this tag; newest first, as it is asked for after a restart."""
        return any(f"_tag-{tag}" in self.listed(f"version={n}") for n in reversed(self.all()))

    def commit(self, seen: int, added: dict | None = None, replaced: dict | None = None, tag: str | None = None) -> int:
        """Write the next version after `seen`, the one that the caller's data were made from; Conflict if that is taken.

        added and replaced: by table the rows, or (rows, columns that its folders are named by).
        """
        staging = f"_staging-{uuid.uuid4().hex}"
        for kind, tables in (("add", added or {}), ("all", replaced or {})):
            for name, rows in tables.items():
                df, by = rows if isinstance(rows, tuple) else (rows, ())
                df.write.partitionBy(*by).parquet(f"{self.root}/{staging}/kind={name}.{kind}")
        if tag:
            self.fs.mkdirs(self.path(staging, f"_tag-{tag}"))
        at = self.path(staging)
        self.fs.mkdirs(at)
        if seen + 1 in self.all():
            self.fs.delete(at, True)
            raise Conflict(seen + 1)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(at, self.path(f"version={seen + 1}"), none)
        except Py4JJavaError as error:
            self.fs.delete(at, True)
            if seen + 1 in self.all():
                raise Conflict(seen + 1) from error
            raise
        return seen + 1

    def changed(self, change: Callable[[int], dict]) -> int:
        """Commit what change(version) returns, arguments of commit, anew from each later version that comes between."""
        while True:
            seen = self.latest()
            try:
                return self.commit(seen, **change(seen))
            except Conflict:
                continue

    def folders(self, name: str, at: int | None = None) -> list[str]:
        """What makes up the table at a version: the last whole one, and what was added since."""
        found: list[str] = []
        for n in reversed(self.all()):
            if at is not None and n > at:
                continue
            here = self.listed(f"version={n}")
            found += [f"{self.root}/version={n}/{x}" for x in (f"kind={name}.add", f"kind={name}.all") if x in here]
            if f"kind={name}.all" in here:
                break
        return found

    def table(self, name: str, schema: T.StructType | str, at: int | None = None) -> DataFrame:
        """The table's rows at a version (the last by default), with the column `version` of the commit that wrote them."""
        schema, found = self.foldered(schema), self.folders(name, at)
        return (self.spark.read.schema(schema).option("basePath", self.root).parquet(*found) if found else self.spark.createDataFrame([], schema)).drop("kind")

    @staticmethod
    def foldered(schema: T.StructType | str) -> T.StructType:
        """The schema with what the names of folders say."""
        plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return T.StructType([*plain.fields, T.StructField("version", T.IntegerType()), T.StructField("kind", T.StringType())])

    def current(self, name: str, schema: T.StructType | str, *keys: str, at: int | None = None) -> DataFrame:
        """Of a log, the newest row of each key unless it is gone, also where its commit has another row of it, with its version; schema leaves out `gone`."""
        plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = self.table(name, T.StructType([*plain.fields, T.StructField("gone", T.BooleanType())]), at)
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*plain.names, "gone", "version"), F.struct("version", F.coalesce("gone", F.lit(False)))).alias("r"))
        return newest.where("r.gone IS NOT TRUE").select("r.*").drop("gone")

    def changes(self, name: str, schema: T.StructType | str, after: int) -> DataFrame:
        """A stream of the rows committed after a version."""
        rows = self.spark.readStream.schema(self.foldered(schema)).option("basePath", self.root).parquet(f"{self.root}/version=*/kind={name}.add")
        return rows.where(F.col("version") > after).drop("kind")

    def subscribed(self, name: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame, int]:
        """What the table holds now, a stream of what comes later, and the version between: no row in both, none in neither."""
        cut = self.latest()
        return self.table(name, schema, cut), self.changes(name, schema, cut), cut


def logged(df: DataFrame, gone: bool = False) -> DataFrame:
    """Rows for a log."""
    return df.withColumn("gone", F.lit(gone))
