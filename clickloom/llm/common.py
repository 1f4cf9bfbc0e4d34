"""Helpers that the corpus operators share: table access, durable cuts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickloom.sources.sinks import cut


#: Words whose numbers a task keeps before it starts over.
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def apart(rows: DataFrame) -> DataFrame:
    """rows with columns named by place (_k0, _k1, ...), which no operator's own column is called."""
    return rows.toDF(*[f"_k{i}" for i in range(len(rows.columns))])


def place_of(rows: DataFrame, name: str) -> Column:
    """The column of apart(rows) that is called `name` in rows."""
    names = [c.lower() for c in rows.columns]
    return F.col(f"_k{names.index(name.lower())}")


def together(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, by place, from rows that apart() renamed and others added columns to."""
    return rows.select(*[f"_k{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """_a and _b: 128 bits that tell a row apart from all that differ in doc_id or text, nulls included."""
    shown = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return [F.xxhash64(shown, text).alias("_a"), F.xxhash64(F.lit("b"), text, F.lit("b"), shown).alias("_b")]


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Map every Arrow batch through make()(batch), which returns columns by name.

    make runs once per task, so that caches live in the task. No batch sees another's rows.
    """
    fields = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield pa.RecordBatch.from_arrays([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c]) for c in fields], fields)

    return df.mapInArrow(run, schema)


def map_kept(rows: DataFrame, keep: Iterable[str], inputs: dict[str, Column], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """The columns `keep` of every row behind those (schema) that make()(batch of inputs) returns.

    Kept columns pass through under names of their own, whatever they are called. One that is called
    like an output, in any case, gives way to it.
    """
    made = rows.sparkSession.createDataFrame([], schema).schema
    names = [c for c in dict.fromkeys(keep) if c.lower() not in {f.name.lower() for f in made}]
    source = rows.select(*[quoted(c).alias(f"_k{i}") for i, c in enumerate(names)], *[x.alias(n) for n, x in inputs.items()])
    kept = source.schema.fields[: len(names)]

    def making():
        f = make()
        return lambda batch: f(batch) | {k.name: batch.column(k.name) for k in kept}

    return map_batches(source, StructType([*kept, *made.fields]), making).toDF(*names, *[f.name for f in made])


class Words:
    """64-bit numbers of words; a task-long cache that is emptied when full."""

    def __init__(self, seed: int = 0):
        self.cache: dict[bytes, int] = {}
        self.seed = seed

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache, h, seed = self.cache, xxhash.xxh64_intdigest, self.seed
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = np.empty(len(words), np.uint64)
        for i in range(0, len(words), CACHE_WORDS):
            part = words[i : i + CACHE_WORDS]
            got = list(map(cache.get, part))
            if None in got:
                for k, x in enumerate(got):
                    if x is None:
                        got[k] = cache[part[k]] = h(part[k], seed)
            out[i : i + len(part)] = got
        return out


def second(numbers: np.ndarray) -> np.ndarray:
    """Other 64-bit numbers for the same symbols: runs of them are as good as independent of runs of the first."""
    x = (numbers ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(29))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with the given (src, dst) long edges.

    Returns (node, root): every node with an edge to another, and the smallest node of its component
    (also for the root itself). Alternates large-star and small-star steps, which contract paths
    without gathering a component anywhere; each round is written to the shared folder.
    """
    e = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(),
        "edges",
    )
    while True:
        heads = e.select(F.col("lo").alias("hi")).distinct()
        total = e.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("d")).first()
        if total.n == total.d and e.join(heads, "hi", "left_semi").isEmpty():
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large, "large")
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.select("hi", F.col("m").alias("lo")).unionAll(rest).distinct(), "edges")
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
