"""Visits laid out by session: written once, so that what goes by session needs no exchange afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDER = ("session_id", "action_time", "event_id")


def store_by_session(visits: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write visits as the table `name` under path: in partitions by date, in each of them a file for each
    of `buckets` ranges of the hash of session_id, sorted by session and time. Returns the table.

    Aggregations, joins and windows by session_id read a bucket in a task as it lies, and joins of two
    such tables with as many buckets go bucket by bucket. Choose as many buckets as a day's files should
    be: a session's visits of all dates meet in one task.
    """
    rows = visits.repartition(buckets, "session_id").sortWithinPartitions("date", *ORDER)
    rows.write.partitionBy("date").bucketBy(buckets, "session_id").sortBy(*ORDER).option("path", path).mode("overwrite").saveAsTable(name)
    return visits.sparkSession.table(name).select(*visits.columns)


def open_by_session(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """The table that another session stored under path, registered as `name` in this one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY (date) CLUSTERED BY (session_id) SORTED BY ({', '.join(ORDER)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)
