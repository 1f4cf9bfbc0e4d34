"""Anchored windows: what the two operators on repeated passages share.

Every window of `window` symbols holds `window - size + 1` runs of `size` symbols. The one with the
least number (the leftmost of several) is the window's anchor. Equal windows have equal anchors at
equal places, so anchors alone tell where windows may repeat, and there is one for about each
(window - size) / 2 symbols. An anchor's context is all that the windows around it can reach.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Symbols whose anchors are looked for at a time; bounds a task's memory for very long texts.
STRETCH = 1 << 20
#: Documents that a layout is estimated from (1 in 64 if that is more), rows in a part, about, and the
#: least number of times a hot number is seen among them.
LAYOUT_DOCUMENTS, PART_ROWS, LEAST_HOT = 20_000, 200_000, 16
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def mixed(x: np.ndarray) -> np.ndarray:
    a, b, s = _MIX
    x = (x ^ (x >> s)) * a
    x = (x ^ (x >> s)) * b
    return x ^ (x >> s)


def powers(n: int, kept: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of BASE and of its inverse modulo 2^64; a task keeps those of one stretch."""
    if n > len(kept.get("base", ())):
        out = []
        for x in (BASE, INVERSE):
            ones = np.full(max(n, 1 << 14), x, np.uint64)
            ones[0] = 1
            out.append(np.multiply.accumulate(ones))
        if n > 4 * STRETCH:
            return out[0], out[1]
        kept["base"], kept["inverse"] = out
    return kept["base"][:n], kept["inverse"][:n]


class Runs:
    """Numbers (uint64) of runs of symbols; equal runs have equal numbers wherever they stand."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        base, self.back = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * base[:n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else self.sums[:0]

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def least(numbers: np.ndarray, width: int) -> np.ndarray:
    """Places of the least (leftmost) number in each stretch of `width` numbers, each place once."""
    if len(numbers) < width:
        return np.zeros(0, np.int64)
    place = np.uint64((1 << 24) - 1)
    m = (numbers & ~place) | np.arange(len(numbers), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        k = width - step
        m = np.minimum(m[:-k], m[k:])
    keep = np.ones(len(m), bool)
    keep[1:] = m[1:] != m[:-1]
    return np.unique((m[keep] & place).astype(np.int64))


def anchors(symbols: np.ndarray, window: int, size: int, second: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(places, numbers, context numbers) of a text's anchors; none if it has no window.

    A context reaches window - size symbols to both sides, or to the text's ends. With `second`, other
    numbers for the same symbols, there is a second context number, independent of the first.
    """
    reach = window - size
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(1, len(symbols) - window + 1), STRETCH):
        # Windows that start in this stretch, and what their contexts reach.
        low, high = max(0, at - reach), min(len(symbols), at + STRETCH + 2 * window)
        runs = Runs(symbols[low:high])
        numbers = runs.all(size)
        own = numbers[at - low : at - low + STRETCH + reach]
        places = least(own, reach + 1) + (at - low)
        starts, ends = np.maximum(places - reach, 0), np.minimum(places + size + reach, high - low)
        more = () if second is None else (Runs(second[low:high]).at(starts, ends),)
        found.append((places + low, numbers[places], runs.at(starts, ends), *more))
    if len(found) == 1:
        return found[0]
    places, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
    places, first = np.unique(places, return_index=True)
    return places, *(x[first] for x in columns)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place, a number below their count that tells its pair (a, b) from other pairs."""
    order = np.argsort(b, kind="stable")
    change = np.zeros(len(b), np.int64)
    change[1:] = (b[order[1:]] != b[order[:-1]]) | (a[order[1:]] != a[order[:-1]])
    out = np.empty(len(b), np.int64)
    out[order] = np.cumsum(change)
    return out


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted `some`."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def layout(source: DataFrame, numbers: Callable[[], Callable[[str], np.ndarray]]) -> tuple[np.ndarray, int]:
    """(hot numbers, sorted; parts): how to deal out the anchors of source (_text).

    Both are estimated from some of the documents and decide only where rows go, never what is found.
    Hot are numbers that alone would fill a part; there are at most as many as parts.
    """
    n = source.count()
    share = min(1.0, max(LAYOUT_DOCUMENTS / max(n, 1), 1 / 64))
    some = source.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def make():
        of = numbers()

        def run(batch: pa.RecordBatch) -> dict:
            found = [of(t.as_py()) for t in batch.column("_text")]
            short, count = np.unique(np.concatenate(found), return_counts=True)
            return {"short": short.view(np.int64), "n": count}

        return run

    # Copies of one text are in or out together, which makes their anchors look hotter or colder.
    counts = cut(map_batches(some.select("_text"), "short long, n long", make).groupBy("short").agg(F.sum("n").alias("n")), "layout")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / share) // PART_ROWS)
    top = counts.where((F.col("n") >= LEAST_HOT) & (F.col("n") * parts > total)).select("short").collect()
    return np.sort(np.array([r["short"] for r in top], np.int64).view(np.uint64)), parts
