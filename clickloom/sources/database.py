"""Result tables in a database: parallel reads, and writes that a repeated task does not double.

Spark's tasks write to a database and read from it themselves where they reach it. Derby inside the driver
they do not: with `folder`, which the tasks and the driver's machine share, they write files there that the
database imports, and read files that it exports.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.readers import read_jdbc
from clickloom.sources.sinks import _fs


def statements(spark: SparkSession, url: str, *sql: str) -> None:
    """Run statements in one transaction; if one fails, none has happened."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in sql:
            statement.executeUpdate(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shared(spark: SparkSession, folder: str) -> str:
    """The folder as the database opens it."""
    p, fs = _fs(spark, folder)
    if fs.getScheme() != "file":
        raise ValueError("the database imports from and exports to a folder of its machine's file system")
    return p.toUri().getPath()


def load_rows(df: DataFrame, url: str, table: str, folder: str | None = None, **options: str) -> None:
    """The rows of df as a table, which is made anew: by Spark's writer, or (with `folder`, a new one) as
    files of numbers, booleans, texts, dates and times that Derby imports one by one."""
    if folder is None:
        df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("overwrite").save()
        return
    spark, path = df.sparkSession, _shared(df.sparkSession, folder)
    if bad := [c for c, t in df.dtypes if t.startswith(("binary", "array", "map", "struct"))]:
        raise ValueError(f"no files for columns {bad}")
    text = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    # What is not null stands in quotes, so that blanks, line ends and empty texts stay as they are.
    df.select(F.concat_ws(",", *[F.coalesce(text(f"`{c}`"), F.lit("")) for c in df.columns]).alias("value")).write.option("compression", "none").text(folder)
    # An empty frame has no tasks: the driver makes the table.
    df.limit(0).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("overwrite").save()
    p, fs = _fs(spark, folder)
    files = sorted(n for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith("part-"))
    statements(spark, url, *[f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, {_quoted(table.upper())}, {_quoted(f'{path}/{n}')}, NULL, NULL, 'UTF-8', 0)" for n in files])


def replace_rows(df: DataFrame, url: str, table: str, task_id: int, folder: str | None = None, **options: str) -> None:
    """The rows of a task in `table`, in place of those that the same task wrote before.

    Spark's tasks write to a table of the task's own, in parallel; then the database deletes the task's
    old rows and takes over the new ones in one transaction. A run that fails anywhere leaves the old
    rows or the new ones, and another run after it one set of rows. The target is made if it is missing.
    """
    task_id = int(task_id)
    staging = f"{table}_task_{task_id}"
    rows = df.withColumn("task_id", F.lit(task_id).cast("long"))
    load_rows(rows, url, staging, folder, **options)
    # An empty frame makes the target, and leaves it as it is if there is one.
    rows.limit(0).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
    names = ", ".join(f'"{c}"' for c in rows.columns)
    statements(df.sparkSession, url, f"DELETE FROM {table} WHERE \"task_id\" = {task_id}", f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}", f"DROP TABLE {staging}")


def upsert_rows(df: DataFrame, url: str, table: str, keys: list[str], batch: int, folder: str | None = None, **options: str) -> None:
    """Rows of df in place of those with the same keys (none of them null), as the sink of a stream that
    emits what it changes: a repeated batch leaves the same rows."""
    staging = f"{table}_batch_{int(batch) if batch >= 0 else f'm{-int(batch)}'}"
    load_rows(df, url, staging, folder, **options)
    df.limit(0).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
    names = ", ".join(f'"{c}"' for c in df.columns)
    same = " AND ".join(f'{staging}."{k}" = {table}."{k}"' for k in keys)
    statements(df.sparkSession, url, f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staging} WHERE {same})", f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}", f"DROP TABLE {staging}")


def _ends(spark: SparkSession, url: str, table: str, column: str) -> tuple[int | None, int | None]:
    """The least and the greatest value of a number column, as the driver reads them."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.createStatement().executeQuery(f'SELECT MIN("{column}"), MAX("{column}") FROM {table}')
        found.next()
        low, high = found.getBigDecimal(1), found.getBigDecimal(2)
        return (None, None) if low is None else (math.floor(low), math.floor(high))
    finally:
        connection.close()


def read_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, folder: str | None = None, **options: str) -> DataFrame:
    """A table in `parts` ranges of a number column, between the bounds that the database finds; rows
    whose column is null come with the first. With `folder` (a new one) Derby exports each range to a file."""
    if folder is None:
        ends = read_jdbc(spark, url, f'(SELECT MIN("{column}") AS "low", MAX("{column}") AS "high" FROM {table}) ends', **options).first()
        if ends[0] is None or parts < 2:
            return read_jdbc(spark, url, table, **options)
        return read_jdbc(spark, url, table, partitionColumn=f'"{column}"', lowerBound=str(ends[0]), upperBound=str(int(ends[1]) + 1), numPartitions=str(parts), **options)
    low, high = _ends(spark, url, table, column)
    path, schema = _shared(spark, folder), read_jdbc(spark, url, table, **options).schema
    p, fs = _fs(spark, folder)
    fs.mkdirs(p)
    cuts = [] if low is None else sorted({low + (high + 1 - low) * k // parts for k in range(1, parts)} - {low})
    over = [None, *(f'"{column}" >= {c}' for c in cuts)]
    under = [*(f'"{column}" < {c}' for c in cuts), None]
    names = ", ".join(f'"{c}"' for c in schema.names)
    for k, (a, b) in enumerate(zip(over, under, strict=True)):
        where = f'{b} OR "{column}" IS NULL' if a is None and b else " AND ".join(x for x in (a, b) if x)
        select = f"SELECT {names} FROM {table}" + (f" WHERE {where}" if where else "")
        statements(spark, url, f"CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY({_quoted(select)}, {_quoted(f'{path}/{k}.csv')}, NULL, NULL, 'UTF-8')")
    # Only what stands without quotes is null; no text is the one that is named here.
    return spark.read.schema(schema).option("multiLine", "true").option("lineSep", "\n").option("escape", '"').option("nullValue", "\0null\0").option("mode", "FAILFAST").csv(folder)
