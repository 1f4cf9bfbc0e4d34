"""Filter interaction audit: what each filter removes after any others, read off the lattice of subsets.

Filters are judged once for each document, as a mask of those that it fails. Applied one after another
in some order they walk up the lattice of subsets: a step is an edge (filters already applied, next
filter), and of 5 filters there are 80 edges under all 600 steps of the 120 orders. Documents are
counted by part and mask, these counts are added to the edges, and edges are joined to the steps.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# White space between words, and the marks of filter D.
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text that is not null: too few words, too few different words, too many
    capitals, a mark."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike(MARKS),
    }


def failure_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit k: fails the k-th filter) per row of documents.

    E, the copy of a smaller doc_id's text, compares 128 bits of the text. A missing text is empty. A
    row without a doc_id is nobody's original and no copy; rows with the same doc_id are no copies of
    each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    failed = text_failures(F.col("_text"))
    mask = sum((F.when(failed[x], 1 << i).otherwise(0) for i, x in enumerate(FILTERS[:4])), F.lit(0))
    # Judged once; what follows reads a few numbers of each document.
    rows = cut(rows.select("doc_id", "part", mask.alias("_own"), F.xxhash64("_text").alias("_a"), F.xxhash64(F.lit("b"), "_text").alias("_b")), "failures")
    first = rows.groupBy("_a", "_b").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return rows.join(first.drop("_last"), ["_a", "_b"], "left").select("doc_id", "part", (F.col("_own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def _edges() -> list[tuple[int, int]]:
    """(applied, filter): all subsets as masks, each with every filter that is not in it."""
    return [(s, 1 << k) for s in range(1 << len(FILTERS)) for k in range(len(FILTERS)) if not s >> k & 1]


def edge_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, applied, filter and the counts of every edge of the lattice, in each part.

    A doc_id is good (toxic) if any of its labels says so.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("_good"), F.max((F.col("toxic") == 1).cast("long")).alias("_toxic"))
    rows = masks.join(marks, "doc_id", "left")
    by_mask = rows.groupBy("part", "mask").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("_good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("_toxic"))
    edges = _edges()
    applied, following = (F.lit([e[i] for e in edges]) for i in range(2))
    at = by_mask.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(edges)))).alias("_e"))
    at = at.select("part", "mask", "_n", "_good", "_toxic", F.element_at(applied, F.col("_e")).alias("applied"), F.element_at(following, F.col("_e")).alias("filter"))
    earlier, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("filter")) != 0
    total = lambda when, n="_n": F.sum(F.when(when, F.col(n)).otherwise(0))
    sums = dict(zip(COUNTS, (total(~earlier & ~fails), total(~earlier & fails), total(earlier & fails), total(~earlier & fails, "_good"), total(~earlier & fails, "_toxic")), strict=True))
    return at.groupBy("part", "applied", "filter").agg(*[c.alias(n) for n, c in sums.items()])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each source (null: the empty string), order of the five filters and step, zeros
    included. documents needs doc_id, text and source, labels doc_id, quality and toxic; other columns
    are ignored. Without documents there are no rows.
    """
    edges = edge_counts(failure_masks(documents), labels)
    n = len(FILTERS)
    size = F.bit_count("applied")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    # Failing one filter only is being removed by it after all others.
    whole = edges.groupBy("part", "filter").agg(F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"), F.sum(orders * F.col("removed")).alias("shapley"))
    bits = {x: 1 << i for i, x in enumerate(FILTERS)}
    steps = [("".join(p), k + 1, sum(bits[x] for x in p[:k]), bits[p[k]]) for p in permutations(FILTERS) for k in range(n)]
    paths = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    rows = edges.join(whole, ["part", "filter"]).join(F.broadcast(paths), ["applied", "filter"])
    return rows.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
