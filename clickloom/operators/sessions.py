"""Session analysis: summaries, filters, buckets, samples, top categories and top sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from clickloom.functions import distinct_list, ratio, seconds_between, split_list
from clickloom.params import Params

# Buckets of visit length in seconds (0 falls in none) and of steps, with their ends.
LENGTHS = (("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 31, 60), ("1m_3m", 61, 180), ("3m_10m", 181, 600), ("10m_30m", 601, 1800), ("30m", 1801, None))
STEPS = (("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 31, 60), ("60", 61, None))
DETAIL = "user_id session_id page_id action_time search_keyword click_category_id click_product_id order_category_ids order_product_ids pay_category_ids pay_product_ids".split()


def in_dates(visits: DataFrame, params: Params) -> DataFrame:
    """Visits between the two dates, both included; a missing date does not bound."""
    if params.start_date:
        visits = visits.where(F.col("date") >= params.start_date)
    if params.end_date:
        visits = visits.where(F.col("date") <= params.end_date)
    return visits


def summarise(visits: DataFrame) -> DataFrame:
    """One row per session: distinct keywords and clicked categories, length in seconds, steps, start."""
    s = visits.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        distinct_list(F.col("search_keyword")).alias("search_keywords"),
        F.array_join(F.transform(F.sort_array(F.collect_set("click_category_id")), lambda x: x.cast("string")), ",").alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        F.max("action_time").alias("_end"),
        F.count("*").alias("step_length"),
    )
    return s.select("session_id", "user_id", "search_keywords", "click_category_ids", seconds_between(F.col("start_time"), F.col("_end")).alias("visit_length"), "step_length", "start_time")


def enrich(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their user's age, profession, city and sex; sessions of unknown users go."""
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id").select("session_id", "user_id", "search_keywords", "click_category_ids", "visit_length", "step_length", "start_time", "age", "professional", "city", "sex")


def closed_range(column: Column, low: int | None, high: int | None) -> Column:
    """Within both bounds; passes unless both are given."""
    return F.lit(True) if low is None or high is None else F.coalesce(column.between(low, high), F.lit(False))


def any_of(column: Column, wanted: tuple[str, ...] | None, comma_list: bool = False) -> Column:
    """The value, or any item of a comma list, is wanted; passes if nothing is asked."""
    if wanted is None:
        return F.lit(True)
    found = F.arrays_overlap(split_list(column), F.array(*map(F.lit, wanted))) if comma_list else column.isin(*wanted)
    return F.coalesce(found, F.lit(False))


def equals(column: Column, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.coalesce(column == wanted, F.lit(False))


def keep_sessions(sessions: DataFrame, params: Params) -> DataFrame:
    """Enriched sessions that pass every given filter."""
    return sessions.where(
        closed_range(F.col("age"), params.start_age, params.end_age)
        & any_of(F.col("professional"), params.professionals)
        & any_of(F.col("city"), params.cities)
        & equals(F.col("sex"), params.sex)
        & any_of(F.col("search_keywords"), params.keywords, True)
        & any_of(F.col("click_category_ids"), params.category_ids, True)
    )


def detail(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of the given sessions."""
    return visits.join(sessions.select("session_id"), "session_id", "left_semi").select(*DETAIL)


def within(column: Column, low: int, high: int | None) -> Column:
    return column >= low if high is None else column.between(low, high)


def bucket_counters() -> list[Column]:
    """Aggregates: session_count and the sessions in each bucket."""
    named = [*((n, "visit_length", a, b) for n, a, b in LENGTHS), *((n, "step_length", a, b) for n, a, b in STEPS)]
    return [F.count("*").alias("session_count"), *[F.count_if(within(F.col(c), a, b)).alias(n) for n, c, a, b in named]]


def bucket_counts(sessions: DataFrame) -> DataFrame:
    """One row: session_count and the sessions in each bucket, in one aggregation."""
    return sessions.agg(*bucket_counters())


def write_counted(sessions: DataFrame, path: str) -> DataFrame:
    """Write sessions and return bucket_counts of what was written: counted in passing, in the same pass.
    Tasks that fail and run again count once."""
    counters = bucket_counters()
    seen = Observation()
    sessions.observe(seen, *counters).write.parquet(path)
    names = ["session_count", *[n for n, _, _ in (*LENGTHS, *STEPS)]]
    return sessions.sparkSession.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"`{n}` long" for n in names))


def bucket_ratios(counts: DataFrame) -> DataFrame:
    """bucket, sessions, ratio: each bucket's share of all sessions to two places."""
    names = [n for n, _, _ in (*LENGTHS, *STEPS)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("sessions")) for n in names]))
    return counts.select("session_count", rows.alias("r")).select("r.bucket", "r.sessions", ratio(F.col("r.sessions"), F.col("session_count")).alias("ratio"))


def statistics_row(counts: DataFrame) -> DataFrame:
    """One row: session_count, and result, the map from bucket to ratio as JSON."""
    names = sorted(n for n, _, _ in (*LENGTHS, *STEPS))
    entries = [F.struct(F.lit(n).alias("bucket"), ratio(F.col(n), F.col("session_count")).alias("ratio")) for n in names]
    return counts.select("session_count", F.to_json(F.map_from_entries(F.array(*entries))).alias("result"))


def by_hour(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("date", F.substring("start_time", 1, 10)).withColumn("hour", F.substring("start_time", 12, 2))


def hour_counts(sessions: DataFrame) -> DataFrame:
    return by_hour(sessions).groupBy("date", "hour").agg(F.count("*").alias("sessions"))


def hour_quotas(hours: DataFrame, total: int = 100) -> DataFrame:
    """date, hour, sessions, quota: total shared evenly by day, then by each hour's share of its day."""
    days = hours.groupBy("date").agg(F.sum("sessions").alias("_day"))
    each = days.agg(F.call_function("div", F.lit(total).cast("long"), F.greatest(F.count("*"), F.lit(1))).alias("_each"))
    quota = F.least(F.call_function("div", F.col("sessions") * F.col("_each"), F.col("_day")), F.col("sessions"))
    # `each` is one row and `days` one for each day.
    return hours.join(days, "date").crossJoin(F.broadcast(each)).select("date", "hour", "sessions", quota.alias("quota"))


#: Hexadecimal digits of the digests' slices.
SLICE_DIGITS = 3


def sample(sessions: DataFrame, total: int = 100, seed: str = "42") -> DataFrame:
    """Each hour's quota of sessions, in the order of a seeded digest: the same on every run.

    The lowest digests are found by counting, not by sorting: sessions of an hour are counted by slices of
    the digests' range (summed in each task, 4096 to an hour), the slice that reaches the quota bounds the
    digests that can be chosen, and only sessions up to it are ranked: the quota's and one slice more.
    """
    digest = F.md5(F.concat("session_id", F.lit(seed)))
    rows = by_hour(sessions).select("session_id", "start_time", "search_keywords", "click_category_ids", "date", "hour", digest.alias("_digest")).withColumn("_slice", F.substring("_digest", 1, SLICE_DIGITS))
    slices = rows.groupBy("date", "hour", "_slice").agg(F.count("*").alias("_n"))
    quotas = hour_quotas(slices.groupBy("date", "hour").agg(F.sum("_n").alias("sessions")), total).where("quota > 0").drop("sessions")
    upto = Window.partitionBy("date", "hour").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    reached = slices.withColumn("_upto", F.sum("_n").over(upto)).join(quotas, ["date", "hour"]).where(F.col("_upto") >= F.col("quota"))
    bounds = reached.groupBy("date", "hour").agg(F.min("_slice").alias("_last"), F.first("quota").alias("quota"))
    low = rows.join(bounds, ["date", "hour"]).where(F.col("_slice") <= F.col("_last"))
    turn = Window.partitionBy("date", "hour").orderBy("_digest", "session_id")
    chosen = low.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= total)
    return chosen.where("_turn <= quota").select("session_id", "start_time", "search_keywords", "click_category_ids")


def ids_of(details: DataFrame, source: str) -> DataFrame:
    """category_id: one row for each category that an action clicks, orders or pays (source)."""
    if source == "click":
        return details.where(F.col("click_category_id").isNotNull()).select(F.col("click_category_id").alias("category_id"))
    items = F.explode(split_list(F.col(f"{source}_category_ids")))
    return details.select(items.alias("_id")).select(F.expr("try_cast(trim(_id) as bigint)").alias("category_id")).where("category_id is not null")


def category_ids(details: DataFrame) -> DataFrame:
    return ids_of(details, "click").unionAll(ids_of(details, "order")).unionAll(ids_of(details, "pay")).distinct()


def category_count(details: DataFrame, source: str) -> DataFrame:
    return ids_of(details, source).groupBy("category_id").agg(F.count("*").alias(f"{source}_count"))


def category_counts(details: DataFrame) -> DataFrame:
    """Clicks, orders and payments of every category: one pass and one shuffle for all three."""
    def items(c: str, at: int) -> Column:
        ids = F.array("click_category_id") if c == "click" else F.transform(split_list(F.col(f"{c}_category_ids")), lambda x: x.try_cast("long"))
        return F.transform(ids, lambda x: F.struct(x.alias("category_id"), F.lit(at).alias("kind")))

    rows = details.select(F.explode(F.concat(*[items(c, i) for i, c in enumerate(("click", "order", "pay"))])).alias("r")).where("r.category_id is not null")
    return rows.groupBy("r.category_id").agg(*[F.count_if(F.col("r.kind") == i).alias(f"{c}_count") for i, c in enumerate(("click", "order", "pay"))])


def top_categories(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(n)


def category_session_counts(details: DataFrame) -> DataFrame:
    rows = details.where(F.col("click_category_id").isNotNull())
    return rows.groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))


def top_sessions(counts: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions with most clicks of each of the given categories (a handful of rows)."""
    turn = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    rows = counts.join(F.broadcast(categories.select("category_id")), "category_id")
    return rows.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).drop("_turn").select("category_id", "session_id", "click_count")


def top_session_detail(details: DataFrame, top: DataFrame) -> DataFrame:
    """The actions of top sessions, once for each category in which a session is on top."""
    return details.join(top.select("session_id", "category_id"), "session_id").select("category_id", *DETAIL)
