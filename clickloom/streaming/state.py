"""Running totals and sliding hours on Spark's state store.

Totals by day live in RocksDB with changelog checkpoints: a batch writes what it changes, to state and
to the sink, and days that the watermark has passed leave the state. Clicks later than `late` behind
the newest are dropped. Every query is restartable from its checkpoint, and a replayed batch writes the
same rows in place of its first attempt's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions import millis_time
from clickloom.operators import ads
from clickloom.sources.sinks import AppendLog, ChangeLog

#: Settings of the state store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
USER_COUNTS = "date string, user_id long, ad_id long, click_count long"
STATS = "date string, province string, city string, ad_id long, click_count long"
TOP = "date string, province string, ads array<struct<ad_id: long, click_count: long>>"
TREND = "date string, hour string, minute string, ad_id long, click_count long"
PANES = "step long, ad_id long, minute long, click_count long"
LAST_HOUR = "step_end long, date string, hour string, minute string, ad_id long, click_count long, ad_total long"
#: Seconds of a pane, and of the window that slides by it.
PANE, HOUR = 10, 3600
#: Steps by which spans and steps are brought together: shorter runs have fewer rows to look at in vain.
RUN = 60


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB. A stream that goes on from a
    checkpoint stays with the store that is named there."""
    for key, value in STORE.items():
        spark.conf.set(key, value)


def tables(spark: SparkSession, folder: str) -> dict[str, ChangeLog]:
    log = lambda name, schema, keys: ChangeLog(spark, f"{folder}/{name}", schema, keys)
    return {
        "user_counts": log("user_counts", USER_COUNTS, ["date", "user_id", "ad_id"]),
        "stats": log("stats", STATS, ["date", "province", "city", "ad_id"]),
        "totals": log("totals", STATS, ["date", "province", "city", "ad_id"]),
        "top": log("top", TOP, ["date", "province"]),
        "trend": log("trend", TREND, ["date", "hour", "minute", "ad_id"]),
        # Panes and windows come once, when they are complete.
        "panes": AppendLog(spark, f"{folder}/panes", PANES, ["step", "ad_id", "minute"]),
        "last_hour": AppendLog(spark, f"{folder}/last_hour", LAST_HOUR, ["step_end", "date", "hour", "minute", "ad_id"]),
    }


def _clicks(lines: DataFrame, late: str) -> DataFrame:
    return ads.parse(lines).withColumn("at", F.timestamp_millis("millis")).withWatermark("at", late)


def _by_day(lines: DataFrame, keys: list[str], late: str) -> DataFrame:
    """date, keys, click_count: totals by day, as state."""
    counts = _clicks(lines, late).groupBy(F.window("at", "1 day").alias("_day"), *keys).agg(F.count("*").alias("click_count"))
    return counts.select(F.date_format(millis_time(F.unix_millis("_day.start")), "yyyy-MM-dd").alias("date"), *keys, "click_count")


def _start(rows: DataFrame, step, folder: str, name: str, mode: str, every: str | None) -> StreamingQuery:
    use_rocksdb(rows.sparkSession)
    w = rows.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoints/{name}")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def start_stats(lines: DataFrame, folder: str, late: str = "1 day", every: str | None = "5 seconds") -> StreamingQuery:
    """Running totals by day, province, city and ad: "stats" gets the totals that a batch changes."""
    log = tables(lines.sparkSession, folder)["stats"]
    return _start(_by_day(lines, ["province", "city", "ad_id"], late), log.write, folder, "stats", "update", every)


def start_user_counts(lines: DataFrame, folder: str, late: str = "1 day", every: str | None = "5 seconds") -> StreamingQuery:
    """Running counts by day, user and ad: "user_counts" gets the counts that a batch changes."""
    log = tables(lines.sparkSession, folder)["user_counts"]
    return _start(_by_day(lines, ["user_id", "ad_id"], late), log.write, folder, "user_counts", "update", every)


def start_province_top(lines: DataFrame, folder: str, n: int = 3, late: str = "1 day", every: str | None = "5 seconds") -> StreamingQuery:
    """Top ads by day and province over running totals: a batch ranks those days and provinces anew in
    which it changes a total."""
    kept = tables(lines.sparkSession, folder)

    def each(df: DataFrame, batch: int) -> None:
        kept["totals"].write(df, batch)
        changed = kept["totals"].of(batch).select("date", "province").distinct()
        days = [r.date for r in changed.select("date").distinct().collect()]
        totals = kept["totals"].read(batch + 1, days).join(changed, ["date", "province"], "left_semi")
        kept["top"].write(ads.province_top(totals, n).groupBy("date", "province").agg(F.collect_list(F.struct("ad_id", "click_count")).alias("ads")), batch)

    return _start(_by_day(lines, ["province", "city", "ad_id"], late), each, folder, "top", "update", every)


def top_rows(log: ChangeLog) -> DataFrame:
    """date, province, ad_id, click_count of what start_province_top keeps."""
    return log.read().select("date", "province", F.inline("ads"))


def start_trend(lines: DataFrame, folder: str, late: str = "60 minutes", every: str | None = "10 seconds") -> StreamingQuery:
    """Clicks by minute and ad of all users: "trend" gets the minutes that a batch changes."""
    log = tables(lines.sparkSession, folder)["trend"]
    counts = _clicks(lines, late).groupBy(F.window("at", "1 minute").alias("w"), "ad_id").agg(F.count("*").alias("click_count"))
    at = millis_time(F.unix_millis("w.start"))
    rows = counts.select(F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"), F.date_format(at, "mm").alias("minute"), "ad_id", "click_count")
    return _start(rows, log.write, folder, "trend", "update", every)


def pane_counts(clicks: DataFrame) -> DataFrame:
    """step (of PANE seconds since the epoch), ad_id, minute (since the epoch), click_count of clicks
    with a column millis. Each click is in one pane."""
    return clicks.groupBy(_div(F.col("millis"), PANE * 1000).alias("step"), "ad_id").agg(F.count("*").alias("click_count")).withColumn("minute", _div(F.col("step"), 60 // PANE)).select("step", "ad_id", "minute", "click_count")


def _div(a: Column, b: int) -> Column:
    """a / b, rounded down."""
    b = F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def _running(panes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, name, since, until: the window's count at every step from `since` to before `until`, where
    it is not 0. A pane is added at its step and subtracted when it leaves, so that each counts twice
    however many steps see it."""
    enters, leaves = F.struct("step", "click_count"), F.struct((F.col("step") + HOUR // PANE).alias("step"), (-F.col("click_count")).alias("click_count"))
    changes = panes.select(*keys, F.inline(F.array(enters, leaves))).groupBy(*keys, "step").agg(F.sum("click_count").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("step")
    sums = changes.select(*keys, F.col("step").alias("since"), F.lead("step").over(order).alias("until"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(name))
    return sums.where(F.col(name) > 0)


def _at(sums: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """sums beside those rows of steps (step and keys) that lie in their spans, which are an hour long at
    most: equal keys and runs of RUN steps are joined, then the span decides."""
    runs = F.sequence(_div(F.col("since"), RUN), _div(F.col("until") - 1, RUN))
    spans = sums.select("*", F.explode(runs).alias("_run"))
    at = steps.withColumn("_run", _div(F.col("step"), RUN))
    return spans.join(at, [*keys, "_run"]).where("step >= since and step < until").drop("_run", "since", "until")


def last_hours(panes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """step_end (epoch seconds), date, hour, minute, ad_id, click_count, ad_total: for every step in which
    a pane has clicks (or for `steps`), the clicks of each minute and ad within the HOUR up to its end,
    and the ad's clicks in all of it. A minute that the window cuts counts with what is inside."""
    steps = panes.select("step").distinct() if steps is None else steps
    totals = _at(_running(panes, ["ad_id"], "ad_total"), steps, [])
    at = millis_time(F.col("minute") * 60_000)
    # Texts are made for spans, of which there are far fewer than rows.
    minutes = _running(panes, ["ad_id", "minute"], "click_count").select("ad_id", "since", "until", F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH").alias("hour"), F.date_format(at, "mm").alias("minute"), "click_count")
    # An ad with clicks in a minute of the window has a total at that step, so that totals are all steps to look at.
    rows = _at(minutes, totals, ["ad_id"])
    return rows.select(((F.col("step") + 1) * PANE).alias("step_end"), "date", "hour", "minute", "ad_id", "click_count", "ad_total")


def start_last_hour(lines: DataFrame, folder: str, late: str = "10 seconds", every: str | None = "10 seconds") -> StreamingQuery:
    """The last hour by minute and ad at every step of 10 seconds, once the watermark has passed it.

    Panes of 10 seconds are counted in state and leave it when they are complete. A batch adds its new
    panes to those of the hour before, of which there are 360 for each ad at most, and writes the
    windows of its own steps to "last_hour".
    """
    kept = tables(lines.sparkSession, folder)
    counts = _clicks(lines, late).groupBy(F.window("at", f"{PANE} seconds").alias("_w"), "ad_id").agg(F.count("*").alias("click_count"))
    step = _div(F.unix_millis("_w.start"), PANE * 1000)
    panes = counts.select(step.alias("step"), "ad_id", _div(step, 60 // PANE).alias("minute"), "click_count")

    def each(df: DataFrame, batch: int) -> None:
        new = df.persist()
        try:
            bounds = new.agg(F.min("step").alias("a"), F.max("step").alias("b")).first()
            width = HOUR // PANE
            kept["panes"].write(new, batch, part=_div(F.col("step"), width), together=True)
            if bounds.a is None:
                return
            # Complete panes come once and in order, so that of earlier ones only two parts can matter.
            before = kept["panes"].read(batch, [bounds.a // width - 1, bounds.a // width]).where(F.col("step") > bounds.a - width)
            rows = last_hours(before.unionByName(new), new.select("step").distinct())
            kept["last_hour"].write(rows, batch, part=F.date_format(millis_time(F.col("step_end") * 1000), "yyyy-MM-dd"))
        finally:
            new.unpersist()

    return _start(panes, each, folder, "last_hour", "append", every)
