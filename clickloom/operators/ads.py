"""Ad clicks: parsed log lines, daily counts, blacklist, running totals, top ads, trend by minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import millis_time

#: Daily clicks of one user on one ad that put the user on the blacklist.
THRESHOLD = 100


def parse(lines: DataFrame) -> DataFrame:
    """millis, ts, date, province, city, user_id, ad_id of lines "millis province city user ad".

    Lines without five fields, or whose numbers are none, are dropped. Times are UTC.
    """
    f = F.split(F.trim("value"), " ")
    part = lambda i: F.get(F.col("f"), i)
    rows = lines.select(f.alias("f")).where(F.size("f") == 5)
    rows = rows.select(part(0).try_cast("long").alias("millis"), part(1).alias("province"), part(2).alias("city"), part(3).try_cast("long").alias("user_id"), part(4).try_cast("long").alias("ad_id"))
    rows = rows.where("millis is not null and user_id is not null and ad_id is not null").withColumn("ts", millis_time(F.col("millis")))
    return rows.select("millis", "ts", F.date_format("ts", "yyyy-MM-dd").alias("date"), "province", "city", "user_id", "ad_id")


def not_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    return clicks.join(blacklist, "user_id", "left_anti")


def user_daily_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("date", "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def offenders(daily: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return daily.where(F.col("click_count") >= threshold).select("user_id").distinct()


def stats(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("date", "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_top(counts: DataFrame, n: int = 3) -> DataFrame:
    """The n ads with most clicks of each day and province, from counts by city."""
    turn = Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id")
    rows = counts.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))
    return rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).drop("_turn")


def trend(clicks: DataFrame) -> DataFrame:
    """date, hour, minute, ad_id, click_count by the minute of the click."""
    return clicks.groupBy("date", F.date_format("ts", "HH").alias("hour"), F.date_format("ts", "mm").alias("minute"), "ad_id").agg(F.count("*").alias("click_count"))


def entity_dates(counts: DataFrame) -> DataFrame:
    """Running totals as they are stored: date as yyyyMMdd."""
    return counts.withColumn("date", F.regexp_replace("date", "-", ""))
