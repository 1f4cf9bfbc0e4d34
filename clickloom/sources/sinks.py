"""Where results and intermediate tables go: shared folders, task results, tables kept by key."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting to delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str) -> bool:
    """Whether this call created the file: false if it is there, whoever else creates it at the same time."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":  # a local folder's own create would look first and then write
        return bool(spark._jvm.java.io.File(p.toUri().getPath()).createNewFile())
    try:
        fs.create(p, False).close()
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    return True


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under spark.checkpoint.dir (or, in local mode
    only, /tmp/checkpoints), which all executors share. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    p, fs = _fs(spark, path)
    if fs.mkdirs(p):
        fs.deleteOnExit(p)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor need the
    executors that made it. The files of its shuffles go with the write."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_result(df: DataFrame, path: str, task_id: int) -> None:
    """A task's rows of a result table, in place of those that the same task wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/task_id={task_id}")


class KeyedTable:
    """A table kept by key in a folder, in parts by one column (or in a single part).

    A batch writes, under its number, new versions of just those parts that it has rows for, each made
    from the part's version before that batch: a replayed batch gives the same again, and others'
    parts are neither read nor written. Of each part two versions stay; of parts, the last `keep`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], part: str | None = "date", keep: int | None = None):
        self.spark, self.path, self.schema, self.keys, self.part, self.keep = spark, path.rstrip("/"), schema, keys, part, keep

    def _names(self, path: str, prefix: str) -> list[str]:
        p, fs = _fs(self.spark, path)
        try:
            return [n.removeprefix(prefix) for f in (fs.listStatus(p) if fs.exists(p) else ()) if (n := f.getPath().getName()).startswith(prefix)]
        except Py4JJavaError:
            if fs.exists(p):
                raise
            return []  # another writer removed it meanwhile

    def versions(self) -> list[int]:
        """Numbers of the batches that are written whole."""
        done = lambda v: _fs(self.spark, f"{self.path}/v={v}/_SUCCESS")
        return sorted(int(v) for v in self._names(self.path, "v=") if (s := done(v))[1].exists(s[0]))

    def _parts(self, before: int | None = None) -> dict[str, list[int]]:
        """Versions of each part, in order."""
        return self._kept({v: self._names(f"{self.path}/v={v}", "_part=") for v in self.versions() if before is None or v < before})

    def _kept(self, listed: dict[int, list[str]]) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for v, names in listed.items():
            for p in names:
                found.setdefault(p, []).append(v)
        names = sorted(found)
        return {p: found[p] for p in (names[-self.keep :] if self.keep else names)}

    def read(self, before: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The last version of every part (or of some), or the last before the given batch."""
        paths = [f"{self.path}/v={v[-1]}/_part={p}" for p, v in self._parts(before).items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _touched(self, df: DataFrame) -> list[str]:
        """Names of the parts that df has rows of: as many as a batch has dates."""
        return sorted(r[0] for r in df.select(self._part()).distinct().collect())

    def _part(self):
        # Only characters that no file system writes in another way.
        return F.coalesce(F.regexp_replace(F.col(self.part).cast("string"), "[^A-Za-z0-9-]", "_"), F.lit("none")).alias("_part") if self.part else F.lit("all").alias("_part")

    def claim(self) -> int:
        """A batch number that no other writer has or gets: a file of that name is created, which only one
        writer can do. A number whose writer fails stays unused."""
        taken = [*self.versions(), *map(int, self._names(f"{self.path}/claims", ""))]
        number = max(taken, default=-1) + 1
        while not _create(self.spark, f"{self.path}/claims/{number}"):
            number += 1
        return number

    def write(self, df: DataFrame, batch: int) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        df.select(*columns, self._part()).write.partitionBy("_part").mode("overwrite").parquet(f"{self.path}/v={batch}")
        # Only what one listing shows is judged: other writers may add versions meanwhile.
        listed = {v: self._names(f"{self.path}/v={v}", "_part=") for v in self.versions()}
        kept = self._kept(listed)
        for v, names in list(listed.items())[:-1]:
            old = [p for p in names if p not in kept or v in kept[p][:-2]]
            # A version none of whose parts are left goes whole.
            for path in [f"{self.path}/v={v}"] if len(old) == len(names) else [f"{self.path}/v={v}/_part={p}" for p in old]:
                p, fs = _fs(self.spark, path)
                fs.delete(p, True)

    def replace(self, df: DataFrame, batch: int, keys: list[str] | None = None) -> None:
        """Rows of df in place of all rows with the same keys."""
        keys = keys or self.keys
        old = self.read(batch, self._touched(df)).join(df.select(*keys).distinct(), keys, "left_anti")
        self.write(old.unionByName(df), batch)

    def add(self, df: DataFrame, batch: int, value: str) -> DataFrame:
        """The value of df's rows added to that of the rows with the same keys. Returns the parts that
        this changes, as they are afterwards."""
        touched = self._touched(df)
        self.write(self.read(batch, touched).unionByName(df).groupBy(*self.keys).agg(F.sum(value).alias(value)), batch)
        return self.read(batch + 1, touched)


class GrowingSet:
    """Rows that any batch had, in a folder. A batch writes those that no batch before it had."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.table = KeyedTable(spark, path, schema, [], None)

    def read(self, before: int | None = None) -> DataFrame:
        t = self.table
        paths = [f"{t.path}/v={v}" for v in t.versions() if before is None or v < before]
        return t.spark.read.schema(t.schema).parquet(*paths) if paths else t.spark.createDataFrame([], t.schema)

    def include(self, df: DataFrame, batch: int) -> None:
        new = df.distinct().join(self.read(batch), df.columns, "left_anti").persist()
        try:
            if not new.isEmpty():
                new.write.mode("overwrite").parquet(f"{self.table.path}/v={batch}")
        finally:
            new.unpersist()


class ChangeLog:
    """Rows by key in a folder; of a key's rows the one of the last batch holds.

    A batch writes only the rows that it changes, under its number and in parts by one column (the first
    key, unless another is given): what it writes does not grow with what is there, and a replayed
    batch takes the place of its first attempt. Nothing is rewritten; `drop` removes old parts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.table = KeyedTable(spark, path, schema, keys, None)

    def write(self, df: DataFrame, batch: int, part: Column | None = None, together: bool = False) -> None:
        """together: a part's rows meet in one task first, for small rows of many parts, of which else every
        task writes a file."""
        columns = self.spark.createDataFrame([], self.schema).columns
        part = F.col(self.keys[0]) if part is None else part
        rows = df.select(*columns, part.cast("string").alias("_part"))
        (rows.repartition("_part") if together else rows).write.partitionBy("_part").mode("overwrite").parquet(f"{self.path}/v={batch}")

    def of(self, batch: int) -> DataFrame:
        """The rows that a batch wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={batch}").drop("_part")

    def read(self, before: int | None = None, parts: list | None = None) -> DataFrame:
        """The last row of every key (of the given parts), or the last before a batch."""
        names = None if parts is None else {str(p) for p in parts}
        versions = [v for v in self.table.versions() if before is None or v < before]
        paths = [f"{self.path}/v={v}" for v in versions] if names is None else [f"{self.path}/v={v}/_part={p}" for v in versions for p in self.table._names(f"{self.path}/v={v}", "_part=") if p in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self._last(self.spark.read.schema(f"{self.schema}, v long").option("basePath", self.path).parquet(*paths))

    def _last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "v").alias("_last"))
        return last.select(*self.keys, "_last.*").select(*[c for c in self.spark.createDataFrame([], self.schema).columns])

    def drop(self, before: str) -> None:
        """Remove all parts whose name sorts before the given one (as dates do)."""
        for v in self.table.versions()[:-1]:
            names = self.table._names(f"{self.path}/v={v}", "_part=")
            old = [n for n in names if n < before]
            for path in [f"{self.path}/v={v}"] if len(old) == len(names) else [f"{self.path}/v={v}/_part={n}" for n in old]:
                p, fs = _fs(self.spark, path)
                fs.delete(p, True)


class AppendLog(ChangeLog):
    """Rows whose keys come in one batch only: every row holds, and readers need not compare versions."""

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.spark.createDataFrame([], self.schema).columns)
