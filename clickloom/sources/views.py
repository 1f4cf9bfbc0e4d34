"""The five inputs of the jobs, as deterministic views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import EPOCH

# Areas of cities.
AREAS = ("China North", "China East", "China South", "China Middle", "West North", "West South", "Northeast")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_visit_action with event_id as tie-break: one row per action."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.withColumn("k", k).withColumn("b", F.expr("(day(ts) - 1) div 3"))
    e = e.withColumn("d0", F.expr("date_add(DATE'2024-01-01', cast(3 * b as int))"))
    start = F.col("d0").cast("timestamp_ntz")
    squeeze = F.when(F.col("user_id") % 4 == 0, 72).when(F.col("user_id") % 4 == 1, 720).when(F.col("user_id") % 4 == 2, 7200).otherwise(28800)
    passed = F.call_function("div", F.timestamp_diff("SECOND", start, "ts"), squeeze.cast("long"))
    kind = lambda t, value: F.when(F.col("event_type") == t, value)
    text = lambda c: c.cast("string")
    product = F.col("event_id") % 100
    return e.select(
        F.date_format("d0", "yyyy-MM-dd").alias("date"),
        "user_id",
        F.concat(text(F.col("user_id")), F.lit("_"), text(F.col("b"))).alias("session_id"),
        (F.col("k") % 10).alias("page_id"),
        F.date_format(F.timestamp_add("SECOND", (F.col("user_id") % 24) * 3600 + passed, start), "yyyy-MM-dd HH:mm:ss").alias("action_time"),
        kind("view", F.concat(F.lit("kw"), text(F.col("k") % 10))).alias("search_keyword"),
        kind("click", F.col("k")).alias("click_category_id"),
        kind("click", product).alias("click_product_id"),
        kind("signup", F.concat_ws(",", text(F.col("k")), text((F.col("k") + 1) % 100))).alias("order_category_ids"),
        kind("signup", text(product)).alias("order_product_ids"),
        kind("purchase", F.concat_ws(",", text(F.col("k")), text((F.col("k") + 7) % 100))).alias("pay_category_ids"),
        kind("purchase", text(product)).alias("pay_product_ids"),
        (F.col("event_id") % 25).alias("city_id"),
        "event_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    key = F.col("c_custkey").cast("long")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        key.alias("user_id"), F.concat(F.lit("user"), key.cast("string")).alias("username"), F.col("c_name").alias("name"), (key % 60).cast("int").alias("age"), F.col("c_mktsegment").alias("professional"), F.col("n_name").alias("city"), F.when(key % 2 == 0, "male").otherwise("female").alias("sex")
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.col("p_size") % 2).cast("string")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), F.col("p_name").alias("product_name"), F.concat(F.lit('{"product_status": '), status, F.lit("}")).alias("extend_info"))


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    area = F.element_at(F.array(*map(F.lit, AREAS)), (key % len(AREAS) + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(key.alias("city_id"), F.col("n_name").alias("city_name"), area.alias("area"))


def ad_lines(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """value: one ad log line per event; also works on a stream of events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    c = customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    n = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = e.join(c, "user_id").join(n, "c_nationkey")
    millis = F.call_function("div", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)"), F.lit(1000).cast("long"))
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return rows.select(
        F.concat_ws(" ", millis.cast("string"), F.concat(F.lit("P"), F.col("n_regionkey").cast("string")), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), F.col("user_id").cast("string"), k.cast("string")).alias("value")
    )


def ad_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_lines(read(spark, sf_dir, "events"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"))
