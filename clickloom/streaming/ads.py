"""The blacklist, and totals without its users, over a stream of log lines.

One query keeps both, because what a batch counts depends on who was listed before it.
Totals of all users are in state.py.

Every query is restartable from its checkpoint: its tables take a replayed batch again without
counting it twice, and what a batch reads is what was there before it, also when it is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import ads, bloom
from clickloom.sources.sinks import ChangeLog, GrowingSet, KeyedTable

BLACKLIST = "user_id long"
USER_COUNTS = "date string, user_id long, ad_id long, click_count long"
STATS = "date string, province string, city string, ad_id long, click_count long"


def tables(spark: SparkSession, folder: str, keep: int | None = None) -> dict[str, KeyedTable | GrowingSet]:
    """The streams' tables, in parts by date; of these the last `keep` stay, all without it."""
    keyed = lambda name, schema, keys: KeyedTable(spark, f"{folder}/{name}", schema, keys, keep=keep)
    return {
        "blacklist": GrowingSet(spark, f"{folder}/blacklist", BLACKLIST),
        "blacklist_bits": ChangeLog(spark, f"{folder}/blacklist_bits", bloom.SCHEMA, ["bucket"]),
        "user_counts": keyed("user_counts", USER_COUNTS, ["date", "user_id", "ad_id"]),
        "stats": keyed("stats", STATS, ["date", "province", "city", "ad_id"]),
    }


def blacklist(kept: dict, users: DataFrame, batch: int) -> None:
    """Put users on the list and into its filter, of which only the rows that change are written."""
    kept["blacklist"].include(users, batch)
    new = bloom.build(users)
    before = kept["blacklist_bits"].read(batch).join(new.select("bucket"), "bucket", "left_semi")
    kept["blacklist_bits"].write(bloom.merge(new, before), batch, part=F.lit("all"))


def blacklist_step(clicks: DataFrame, kept: dict, batch: int, threshold: int, totals: bool = False) -> None:
    """One batch: drop clicks of users blacklisted before it, add the rest to the daily counts (and to
    the running totals), put the users that reach the threshold on the blacklist."""
    # Most clicks pass the filter's 8 MB at most, and only the rest meets the list.
    good = bloom.without(clicks, kept["blacklist"].read(batch), ["user_id"], kept["blacklist_bits"].read(batch)).persist()
    try:
        counts = kept["user_counts"].add(ads.user_daily_counts(good), batch, "click_count")
        if totals:
            kept["stats"].add(ads.stats(good), batch, "click_count")
        blacklist(kept, ads.offenders(counts, threshold), batch)
    finally:
        good.unpersist()


def _start(stream: DataFrame, step, folder: str, name: str, mode: str, every: str | None) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoints/{name}")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def start_blacklist(lines: DataFrame, folder: str, threshold: int = ads.THRESHOLD, every: str | None = "5 seconds", keep: int | None = None) -> StreamingQuery:
    kept = tables(lines.sparkSession, folder, keep)
    return _start(ads.parse(lines), lambda df, batch: blacklist_step(df, kept, batch, threshold), folder, "blacklist", "append", every)


def start_filtered_stats(lines: DataFrame, folder: str, threshold: int = ads.THRESHOLD, every: str | None = "5 seconds", keep: int | None = None) -> StreamingQuery:
    """Running totals by day, province, city and ad without clicks of users who were on the blacklist
    before their batch. The same query keeps the blacklist."""
    kept = tables(lines.sparkSession, folder, keep)
    return _start(ads.parse(lines), lambda df, batch: blacklist_step(df, kept, batch, threshold, totals=True), folder, "stats", "append", every)


def last_hour(trend: DataFrame, minutes: int = 60) -> DataFrame:
    """The trend's rows of the last minutes up to the newest."""
    at = F.unix_timestamp(F.concat_ws(" ", "date", F.concat_ws(":", "hour", "minute")), "yyyy-MM-dd HH:mm")
    newest = F.broadcast(trend.agg(F.max(at).alias("_newest")))
    return trend.crossJoin(newest).where(at > F.col("_newest") - 60 * minutes).drop("_newest")
