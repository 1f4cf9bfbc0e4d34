"""Column helpers. All are built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def concat_long_string(number: Column, text: Column, sep: str) -> Column:
    """number, sep and text as one string; a null shows as the text null."""
    return F.concat(F.coalesce(number.cast("string"), F.lit("null")), F.lit(sep), F.coalesce(text, F.lit("null")))


def json_field(json: Column, field: str) -> Column:
    """A top-level field of a JSON text by its bare name; null if missing or malformed."""
    return F.get_json_object(json, f"$.{field}")


def random_prefix(value: Column, n: int, seed: int = 0) -> Column:
    """value behind a random number below n and an underscore, to spread a hot key."""
    return F.concat(F.floor(F.rand(seed) * n).cast("int").cast("string"), F.lit("_"), value)


def remove_random_prefix(value: Column) -> Column:
    """What stands behind the first underscore."""
    return F.substr(value, F.instr(value, "_") + 1)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to two places, half up, in integers so that every engine rounds alike; null if
    whole is 0."""
    part, whole = part.cast("long"), whole.cast("long")
    return F.when(whole != 0, F.call_function("div", 200 * part + whole, 2 * whole) / F.lit(100.0))


def split_list(column: Column) -> Column:
    """Items of a comma list; null and blank give an empty array."""
    return F.when(F.trim(column) != "", F.split(column, ",")).otherwise(F.array().cast("array<string>"))


def distinct_list(column: Column) -> Column:
    """Aggregate: distinct non-blank values, sorted, comma-joined; "" if none."""
    return F.array_join(F.sort_array(F.collect_set(F.when(F.trim(column.cast("string")) != "", column))), ",")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two texts yyyy-MM-dd H:mm:ss (the hour may have one digit)."""
    return F.unix_timestamp(parse_time(end)) - F.unix_timestamp(parse_time(start))


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:mm:ss"))


def millis_time(millis: Column) -> Column:
    """A time without zone (UTC) from epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", millis.cast("long"), F.expr(EPOCH))


def iso_date(basic: Column) -> Column:
    """yyyyMMdd to yyyy-MM-dd."""
    return F.date_format(F.to_date(basic, "yyyyMMdd"), "yyyy-MM-dd")


def basic_date(iso: Column) -> Column:
    """yyyy-MM-dd to yyyyMMdd."""
    return F.date_format(F.to_date(iso, "yyyy-MM-dd"), "yyyyMMdd")


def kv_map(text: Column) -> Column:
    """A record k=v|k=v as a map."""
    return F.str_to_map(text, F.lit(r"\|"), F.lit("="))
