"""Page flows: single-step conversion rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import ratio
from clickloom.sources.sinks import cut


#: Views of a session that one task puts in order; a session with more is dealt out by time.
MOST = 1_000_000


def consecutive(visits: DataFrame, most: int = MOST) -> DataFrame:
    """session_id, from_page, to_page: each view with the one before it in its session (null for the
    first), by time then event_id.

    Sessions with more than `most` views are dealt out in ranges of time to several tasks; each orders
    its own, and a range's first view gets the page that the range before it ends with.
    """
    rows = visits.select("session_id", "page_id", "action_time", "event_id")
    within = Window.partitionBy("session_id").orderBy("action_time", "event_id")
    ordered = lambda r, turn: r.select("session_id", F.lag("page_id").over(turn).alias("from_page"), F.col("page_id").alias("to_page"))
    hot = rows.groupBy(F.col("session_id").alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    ranges = hot.agg(F.sum(F.ceil(2 * F.col("_n") / most))).first()[0]
    if not ranges:
        return ordered(rows, within)
    hot = cut(hot, "hot")
    same = F.col("session_id").eqNullSafe(F.col("_hot"))
    # Written, because both halves below need the same ranges.
    dealt = cut(rows.join(hot, same, "left_semi").repartitionByRange(int(ranges), "session_id", "action_time", "event_id").withColumn("_range", F.spark_partition_id()), "ranges")
    last = dealt.groupBy("session_id", "_range").agg(F.max_by("page_id", F.struct("action_time", "event_id")).alias("_page"))
    before = last.select(F.col("session_id").alias("_hot"), (F.col("_range")).alias("_at"), F.lag("_page").over(Window.partitionBy("session_id").orderBy("_range")).alias("_page"))
    turn = Window.partitionBy("session_id", "_range").orderBy("action_time", "event_id")
    split = dealt.select("session_id", "_range", F.col("page_id").alias("to_page"), F.lag("page_id").over(turn).alias("_lag"), (F.row_number().over(turn) == 1).alias("_first"))
    split = split.join(before, same & (F.col("_range") == F.col("_at")), "left")
    split = split.select("session_id", F.when(F.col("_first"), F.col("_page")).otherwise(F.col("_lag")).alias("from_page"), "to_page")
    return ordered(rows.join(hot, same, "left_anti"), within).unionByName(split)


def slices(visits: DataFrame, most: int = MOST) -> DataFrame:
    """session_id, slice, from_page, to_page: consecutive views of a session, by time then event_id."""
    pairs = consecutive(visits, most).where("from_page is not null and to_page is not null")
    return pairs.select("session_id", F.concat_ws("_", F.col("from_page").cast("string"), F.col("to_page").cast("string")).alias("slice"), "from_page", "to_page")


def slice_counts(pairs: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    """slice, pv of the slices that the flow names and that occur."""
    wanted = sorted({f"{a}_{b}" for a, b in zip(flow, flow[1:], strict=False)})
    return pairs.where(F.col("slice").isin(*wanted)).groupBy("slice").agg(F.count("*").alias("pv"))


def start_views(visits: DataFrame, flow: tuple[int, ...]) -> DataFrame:
    return visits.where(F.col("page_id") == flow[0]).agg(F.count("*").alias("pv"))


def convert_rates(visits: DataFrame, flow: tuple[int, ...], most: int = MOST) -> DataFrame:
    """step, slice, pv, rate: each step's slice count over the one before (the first: over the views
    of the start page); null if that is 0. One row for each step, also if a slice comes twice."""
    spark = visits.sparkSession
    if len(flow) < 2:
        return spark.createDataFrame([], "step int, slice string, pv long, rate double")
    views = consecutive(visits, most).select(F.col("from_page").alias("from"), F.col("to_page").alias("to"))
    pairs = list(zip(flow, flow[1:], strict=False))
    # One pass: a sum for the start page and one for each step.
    sums = views.agg(F.count_if(F.col("to") == flow[0]).alias("_0"), *[F.count_if((F.col("from") == a) & (F.col("to") == b)).alias(f"_{i + 1}") for i, (a, b) in enumerate(pairs)])
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(f"{a}_{b}").alias("slice"), F.col(f"_{i + 1}").alias("pv"), F.col(f"_{i}").alias("before")) for i, (a, b) in enumerate(pairs)]
    rows = sums.select(F.explode(F.array(*steps)).alias("s")).select("s.*")
    return rows.select("step", "slice", "pv", ratio(F.col("pv"), F.col("before")).alias("rate"))


def flow_text(rates: DataFrame) -> DataFrame:
    """One row: a_b=0.12|b_c=0.5, in the order of the flow."""
    pair = F.struct("step", F.concat_ws("=", "slice", F.coalesce(F.col("rate").cast("string"), F.lit("null"))).alias("t"))
    return rates.agg(F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["t"]), "|").alias("rate"))
