"""Where inputs come from: catalog tables or views, parquet, JDBC, control-A text, Kafka or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The flat form of a table.
SEPARATOR, MISSING = "\x01", "null"

USER_VISIT_ACTION = "date string, user_id long, session_id string, page_id long, action_time string, search_keyword string, click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string, city_id long"
USER_INFO = "user_id long, username string, name string, age int, professional string, city string, sex string"
PRODUCT_INFO = "product_id long, product_name string, extend_info string"
CITY_INFO = "city_id long, city_name string, area string"


class Catalog:
    """Named inputs: a path is read as parquet, anything else is a table or view of the session."""

    def __init__(self, spark: SparkSession, **paths: str):
        self.spark, self.paths = spark, paths

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name]) if name in self.paths else self.spark.table(name)

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    """A table of a database; pass partitionColumn, lowerBound, upperBound and numPartitions to read a
    large one in parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options).load()


def read_control_a(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text with fields parted by control-A and missing values written as null."""
    return spark.read.schema(schema).option("sep", SEPARATOR).option("nullValue", MISSING).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def write_control_a(df: DataFrame, path: str) -> None:
    df.write.option("sep", SEPARATOR).option("nullValue", MISSING).option("quote", "\u0000").option("escape", "\u0000").option("emptyValue", "").csv(path)


def kafka_options(servers: str, topics: str, **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topics, **options}


def kafka_values(records: DataFrame) -> DataFrame:
    """value: the text of Kafka records."""
    return records.select(F.col("value").cast("string").alias("value"))


def kafka_lines(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """value: log lines of Kafka topics (needs the Kafka package on the class path)."""
    return kafka_values(spark.readStream.format("kafka").options(**kafka_options(servers, topics, **options)).load())


def file_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """value: log lines of text files as they appear in a folder."""
    return spark.readStream.options(**options).text(path)
