"""Benchmark decontamination by a prefix-filtered set join.

Every window of a benchmark item is a set of word shingles, ordered by how few documents hold them.
A document that holds the whole window holds its rarest shingle: at full containment the necessary
prefix is one token. So documents are joined to windows on that shingle alone. Its place in the
window tells where the window would start, bounds drop starts outside the document, and what is left
is compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, apart, cut, map_batches, map_kept, place_of, row_key, together

SHINGLE = 5
#: Shingles of the benchmark that one pass over the documents looks for: 8 bytes each in a broadcast,
#: and FILTER bytes. More are looked for in more passes.
BLOCK_SHINGLES = 2_000_000
FILTER = 1 << 24
#: Windows of a join that are broadcast at most, about 200 bytes each; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
MULTIPLIER = 0x9E3779B97F4A7C15

# Words are runs of digits, ASCII letters (lower-cased) and everything beyond ASCII.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
TO_WORDS = bytes(c if c >= 128 or bytes([c]).lower() in [bytes([k]) for k in _KEEP] else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for each run of `size` ids; equal runs have equal numbers."""
    n = max(0, len(ids) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out *= np.uint64(MULTIPLIER)
        out += ids[j : j + n]
    return out ^ (out >> np.uint64(31))


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, win (words, joined by a space), shingles (numbers, in order) of every window."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    kind = dict(items.dtypes)["item_id"]

    def make():
        number = Words()

        def run(batch: pa.RecordBatch) -> dict:
            at, wins, shingles = [], [], []
            for i, t in enumerate(batch.column("text")):
                words = words_of(t.as_py())
                n = min(size, len(words))
                numbers = rolled(number(words), min(SHINGLE, n)) if n else ()
                for k in range(len(words) - n + 1 if n else 0):
                    at.append(i)
                    wins.append(b" ".join(words[k : k + n]).decode("utf-8", "replace"))
                    shingles.append(numbers[k : k + n - min(SHINGLE, n) + 1].view(np.int64))
            return {"item_id": batch.column("item_id").take(pa.array(at, pa.int64())), "win": pa.array(wins, pa.string()), "shingles": pa.array(shingles, pa.list_(pa.int64()))}

        return run

    return map_batches(items, f"item_id {kind}, win string, shingles array<long>", make)


_PLACES = "array<struct<shingle: bigint, place: int, before: int, context: string>>"


def _occurrences(source: DataFrame, shingles: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """_a, _b, doc_id, n_words, found (_PLACES) per row of source: where the text has one of the given
    shingles, with the words around it that a window can reach. `shingles` fits in a broadcast."""
    numbers = np.sort(shingles.toArrow().column(0).combine_chunks().to_numpy().view(np.uint64))
    shared = source.sparkSession.sparkContext.broadcast(numbers)

    def make():
        numbers, number = shared.value, Words()
        # Most numbers are told apart by their upper bits alone.
        maybe = np.zeros(FILTER, bool)
        maybe[numbers >> np.uint64(40)] = True

        def run(batch: pa.RecordBatch) -> dict:
            n, found = [], []
            for t in batch.column("_text"):
                words = words_of(t.as_py())
                n.append(len(words))
                ids, here = number(words) if len(numbers) else np.zeros(0, np.uint64), []
                for s in sizes:
                    keys = rolled(ids, s)
                    at = np.flatnonzero(maybe[keys >> np.uint64(40)])
                    if len(at):
                        where = np.minimum(np.searchsorted(numbers, keys[at]), len(numbers) - 1)
                        for p in at[numbers[where] == keys[at]].tolist():
                            first = max(0, p + s - size)
                            here.append({"shingle": int(keys[p].view(np.int64)), "place": p, "before": p - first, "context": b" ".join(words[first : p + size]).decode("utf-8", "replace")})
                found.append(here)
            return {"n_words": pa.array(n, pa.int64()), "found": pa.array(found, pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("context", pa.string())])))}

        return run

    return map_kept(source, ["_a", "_b", "doc_id"], {"_text": F.col("_text")}, f"n_words long, found {_PLACES}", make)


def _hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """_a, _b, win, start, n of all occurrences of windows, each once per row of `found`."""
    places = found.select("_a", "_b", F.explode("found").alias("f")).select("_a", "_b", "f.*")
    # How many documents hold a shingle; none is written for shingles that no document holds.
    held = places.groupBy("shingle", "_a", "_b").count().groupBy("shingle").agg(F.count("*").alias("held"))
    tokens = windows.select("win", F.posexplode("shingles").alias("offset", "shingle")).join(held, "shingle", "left")
    rank = F.struct(F.coalesce("held", F.lit(0)).alias("held"), "shingle", "offset")
    prefix = tokens.groupBy("win").agg(F.min(rank).alias("r")).where("r.held > 0")
    prefix = cut(prefix.select("win", F.size(F.split("win", " ")).alias("n"), "r.shingle", "r.offset"), "prefix")
    side = F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix
    both = places.join(side, "shingle").where("before >= offset")  # else it would start before the text
    words = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ")
    return both.where(words == F.col("win")).select("_a", "_b", "win", (F.col("place") - F.col("offset")).alias("start"), "n").distinct()


def _found(source: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per row _a, _b, doc_id, n_words; occurrences of windows; item_id and win of all windows)."""
    all_windows = cut(_windows(benchmark, size), "windows")
    windows = all_windows.dropDuplicates(["win"]).select("win", "shingles")
    shingles = windows.select(F.explode("shingles").alias("shingle"), F.least(F.size(F.split("win", " ")), F.lit(SHINGLE)).alias("s"))
    sizes = sorted(r["s"] for r in shingles.select("s").distinct().collect())  # SHINGLE numbers at most
    shingles = cut(shingles.select("shingle").distinct(), "shingles")
    blocks = max(1, -(-shingles.count() // BLOCK_SHINGLES))
    block: Callable[[int], Column] = lambda k: F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == k
    found = [cut(_occurrences(source, shingles.where(block(k)), sizes, size), "found") for k in range(blocks)]
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    return found[0].drop("found"), cut(_hits(places, windows), "hits"), all_windows.select("item_id", "win").distinct()


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_words, hits (word positions inside window occurrences), items (item_ids) per row.

    Windows are `size` words of an item, or the whole item if it has fewer. Null texts have no words;
    items without words, id or text have no windows; repeated items count once, repeated documents
    give a row each. Ids may be of any type. Other columns are ignored. Without any window nothing is
    hit.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    source = documents.select(*row_key(F.col("doc_id"), body), "doc_id", body.alias("_text"))
    rows, hits, items = _found(source, benchmark, size)
    key = ["_a", "_b"]
    positions = hits.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1))))).alias("hits"))
    named = hits.select(*key, "win").distinct().join(items, "win").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    kind = dict(items.dtypes)["item_id"]
    found = rows.join(positions, key, "left").join(named, key, "left")
    return found.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """documents without the rows that hold a window of a benchmark item. Rows are judged by their own
    text, whatever their doc_id, null or not, and whatever other rows have the same."""
    ids, body = place_of(documents, "doc_id"), F.coalesce(place_of(documents, "text"), F.lit(""))
    rows = apart(documents).select("*", *row_key(ids, body))
    _, hits, _ = _found(rows.select("_a", "_b", ids.alias("doc_id"), body.alias("_text")), benchmark, size)
    return together(rows.join(hits.select("_a", "_b").distinct(), ["_a", "_b"], "left_anti"), documents)
