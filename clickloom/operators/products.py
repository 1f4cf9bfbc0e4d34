"""Top products of each area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import concat_long_string, json_field
from clickloom.operators.sessions import in_dates
from clickloom.operators.skew import SHARE, salted_join
from clickloom.params import Params


def clicks(visits: DataFrame, params: Params) -> DataFrame:
    """city_id, product_id of product clicks between the dates."""
    return in_dates(visits, params).where(F.col("click_product_id").isNotNull()).select("city_id", F.col("click_product_id").alias("product_id"))


def with_cities(clicked: DataFrame, cities: DataFrame) -> DataFrame:
    return clicked.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def with_cities_salted(clicked: DataFrame, cities: DataFrame, share: float = SHARE) -> DataFrame:
    """The same for more cities than can be broadcast: clicks of heavy cities are spread over tasks."""
    return salted_join(clicked, cities, "city_id", share).select("city_id", "city_name", "area", "product_id")


def area_counts(clicked: DataFrame) -> DataFrame:
    """area, product_id, click_count, city_infos: clicks and the distinct cities (id:name) of each.

    Counts by city come first: a hot area and product is then as many rows as it has cities.
    """
    by_city = clicked.groupBy("area", "product_id", "city_id", "city_name").agg(F.count("*").alias("_n"))
    info = concat_long_string(F.col("city_id"), F.col("city_name"), ":")
    return by_city.groupBy("area", "product_id").agg(F.sum("_n").alias("click_count"), F.array_join(F.sort_array(F.collect_set(info)), ",").alias("city_infos"))


def with_products(counts: DataFrame, products: DataFrame) -> DataFrame:
    """... with product_name and product_status: Self for status 0, Third Party for anything else."""
    status = F.when(json_field(F.col("extend_info"), "product_status") == "0", "Self").otherwise("Third Party")
    return counts.join(products, "product_id").select("area", "product_id", "click_count", "city_infos", "product_name", status.alias("product_status"))


def area_level(area: Column) -> Column:
    # Levels of areas.
    return F.when(area.isin("China North", "China East"), "A Level").when(area.isin("China South", "China Middle"), "B Level").when(area.isin("West North", "West South"), "C Level").otherwise("D Level")


def top_products(full: DataFrame, n: int = 3) -> DataFrame:
    turn = Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id")
    rows = full.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n)
    return rows.select("area", area_level(F.col("area")).alias("area_level"), "product_id", "click_count", "city_infos", "product_name", "product_status")
