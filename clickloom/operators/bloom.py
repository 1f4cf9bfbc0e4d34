"""Bloom filters of a fixed size as tables: what no row of a set can equal is known without a join on it.

A filter has one row for each 32,768 of its bits: at most BITS / 32,768 rows of 4 KB, 8 MB in all,
however many keys it holds, so that it can be broadcast. A fuller filter lets more keys through; what
comes through is to be joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES = 1 << 26, 2
#: Bits of a row: the size of Spark's bitmaps.
ROW = 32_768
SCHEMA = "bucket long, bitmap binary"


def _places(keys: list[Column]) -> list[Column]:
    """Bits of a key, nulls included."""
    shown = [F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]
    return [F.pmod(F.xxhash64(F.lit(i), *shown), F.lit(BITS)) for i in range(HASHES)]


def _bucket(place: Column) -> Column:
    return F.shiftright(place, ROW.bit_length() - 1)


def build(keys: DataFrame) -> DataFrame:
    """The filter (bucket, bitmap) of all columns of keys."""
    places = keys.select(F.explode(F.array(*_places([F.col(f"`{c}`") for c in keys.columns]))).alias("_p"))
    return places.groupBy(_bucket(F.col("_p")).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("_p", F.lit(ROW).cast("long"))).alias("bitmap"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys that any of the filters has."""
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def flag(rows: DataFrame, keys: list[str], bits: DataFrame, name: str = "_maybe") -> DataFrame:
    """rows with a column `name`: false where the filter shows that the keys are not among its own."""
    held = [F.lit(True)]
    bits = F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
    for i, place in enumerate(_places([F.col(k) for k in keys])):
        rows = rows.withColumn("_place", place).join(bits, _bucket(F.col("_place")) == F.col("_bucket"), "left")
        at = F.pmod("_place", F.lit(ROW).cast("long")).cast("int")
        byte = F.conv(F.hex(F.substr("_bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8))).bitwiseAND(F.lit(1)) == 1, F.lit(False))
        rows = rows.withColumn(f"_held{i}", bit).drop("_place", "_bucket", "_bitmap")
        held.append(F.col(f"_held{i}"))
    both = held[0]
    for h in held[1:]:
        both = both & h
    return rows.withColumn(name, both).drop(*[f"_held{i}" for i in range(HASHES)])


def narrowed_join(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with wanted on keys; rows that the filter of wanted's keys rules out are dropped before
    they are dealt out."""
    kept = flag(rows, keys, build(wanted.select(*keys))).where("_maybe").drop("_maybe")
    return kept.join(wanted, keys)


def without(rows: DataFrame, listed: DataFrame, keys: list[str], bits: DataFrame) -> DataFrame:
    """rows whose keys are not listed. Only rows that the filter lets through are joined with the list,
    which is dealt out and never broadcast; a false positive stays in by that join."""
    flagged = flag(rows, keys, bits)
    doubted = flagged.where("_maybe").join(listed.select(*keys).hint("merge"), keys, "left_anti")
    return flagged.where("not _maybe").unionByName(doubted).drop("_maybe")
