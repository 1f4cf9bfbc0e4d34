"""The three batch jobs: from inputs and parameters to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.operators import pages, products, sessions
from clickloom.params import Params
from clickloom.sources.readers import Catalog
from clickloom.sources.sinks import cut, scratch
from clickloom.tasks import Job


def session_job(visits: DataFrame, users: DataFrame, params: Params, total: int = 100) -> dict[str, DataFrame]:
    chosen = sessions.in_dates(visits, params)
    # Every result starts from these three, so that each is made once and the visits are read twice.
    passed = sessions.keep_sessions(sessions.enrich(sessions.summarise(chosen), users), params)
    path = scratch(passed.sparkSession, "sessions")
    counts = sessions.write_counted(passed, path)
    kept = passed.sparkSession.read.schema(passed.schema).parquet(path)
    details = cut(sessions.detail(chosen, kept), "details")
    sampled = cut(sessions.sample(kept, total), "sample")
    top = sessions.top_categories(sessions.category_counts(details))
    ranked = sessions.top_sessions(sessions.category_session_counts(details), top)
    return {
        "session_aggr_stat": sessions.statistics_row(counts),
        "session_random_extract": sampled,
        "session_detail": sessions.detail(details, sampled),
        "top_category": top,
        "top_session": ranked,
        "top_session_detail": sessions.top_session_detail(details, ranked),
    }


def page_job(visits: DataFrame, params: Params) -> dict[str, DataFrame]:
    rates = pages.convert_rates(sessions.in_dates(visits, params), params.page_flow or ())
    return {"page_convert_rate": rates, "page_slice_rate": pages.flow_text(rates)}


def product_job(visits: DataFrame, cities: DataFrame, info: DataFrame, params: Params) -> dict[str, DataFrame]:
    counts = products.area_counts(products.with_cities(products.clicks(visits, params), cities))
    return {"area_top_product": products.top_products(products.with_products(counts, info))}


def jobs(catalog: Catalog) -> dict[str, Job]:
    """By task type, reading from a catalog's tables."""
    t = catalog.table

    def on(f, *names: str) -> Job:
        return lambda spark, params: f(*map(t, names), params)

    return {"session": on(session_job, "user_visit_action", "user_info"), "page": on(page_job, "user_visit_action"), "product": on(product_job, "user_visit_action", "city_info", "product_info")}


def register_views(spark: SparkSession, **frames: DataFrame) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


#: SQL over registered views; values are bound, never written into the text.
VISITS_BETWEEN = "select * from user_visit_action where date >= :start and date <= :end"


def run_sql(spark: SparkSession, text: str, **values: object) -> DataFrame:
    return spark.sql(text, args=values)
