"""Joins on keys that a few values dominate: only these are salted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import random_prefix, remove_random_prefix

#: Share of the rows from which a key is heavy, and the items that its sketch tracks: its counts are too
#: high by 1 / ITEMS of the rows or so at most, far below the share.
SHARE, ITEMS = 0.02, 4096
#: Salts of a heavy key.
SALTS = 16


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> list[str]:
    """The keys that hold at least `share` of rows, as text: 1 / share of them at most.

    They come from a sketch of the most frequent items with a bounded number of counters, which each
    task fills and which are merged, so that no key is counted in one place.
    """
    text = F.col(key).cast("string")
    found = rows.agg(F.count("*").alias("n"), F.call_function("approx_top_k", text, F.lit(int(1 / share) + 1), F.lit(ITEMS)).alias("top")).first()
    return [r["item"] for r in found.top if r["item"] is not None and r["count"] >= share * found.n] if found.n else []


def salted_join(left: DataFrame, right: DataFrame, key: str, share: float = SHARE, salts: int = SALTS) -> DataFrame:
    """The inner join of left and right on `key`, which must not be null to match.

    Rows of left with a heavy key get one of `salts` prefixes at random, and right's rows of these keys
    one copy with each; all other keys have the prefix 0 on both sides. left is read twice: for its
    heavy keys, and for the join.
    """
    heavy = heavy_keys(left, key, share)
    text = F.col(key).cast("string")
    if not heavy:
        return left.join(right, key)
    # A null is no key: it must not become a text that matches.
    spread = F.when(text.isin(*heavy), random_prefix(text, salts, 1)).otherwise(F.concat(F.lit("0_"), text))
    copies = F.when(text.isin(*heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.withColumn("_salted", spread).drop(key)
    b = right.withColumn("_salt", F.explode(copies)).withColumn("_salted", F.concat_ws("_", F.col("_salt").cast("string"), F.when(text.isNotNull(), text))).where(text.isNotNull()).drop("_salt")
    kind = left.schema[key].dataType
    joined = a.join(b.drop(key), "_salted").withColumn(key, remove_random_prefix(F.col("_salted")).cast(kind)).drop("_salted")
    return joined.select(*left.columns, *[c for c in right.columns if c != key])
