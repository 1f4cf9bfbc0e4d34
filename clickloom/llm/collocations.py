"""Collocations from vertical lists: for every phrase the positions at which it occurs.

Words of all documents are numbered in blocks of at most BLOCK words; pieces and documents stand a
number apart, so that words at consecutive numbers are neighbours. A block is stored by word: its words
and, for each, the ascending list of its positions. Lengths of lists add up over blocks to the exact
frequencies. Frequent phrases are extended by merge-joining the ends of their occurrences with the
postings of adjacent words, block by block; blocks are disjoint, so that no list is ever gathered
whole. A phrase counts in the block that its last word is in: a block that goes on where a piece was
cut begins with the two words before the cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Least frequency of a phrase, its most words, phrases returned of a language, share (in hundredths) of
#: a phrase's occurrences inside a longer one from which it is dropped.
LEAST, LONGEST, BEST, INSIDE = 10, 3, 2000, 50
#: Words of a block, bytes of a text that are split at once.
BLOCK, SLICE = 1 << 19, 1 << 20
#: Bits of the filter that a phrase has to pass to be extended. It is broadcast (8 MB); false positives
#: are counted exactly and then dropped, so that a full filter costs time only.
FILTER_BITS, HASHES = 1 << 26, 3
NO_LANGUAGE = "und"
# What parts pieces and what parts words.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"."
_TABLE = bytes(_MARK[0] if c in _BREAKS else 32 if c == 9 else c for c in range(256))
_EDGE = re.compile(rb"[ .]")
_CODEC = "zstd"


def split_text(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in order, with _MARK between pieces, in lists of limited size."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    start = 0
    while start < len(raw):
        end = min(start + SLICE, len(raw))
        if end < len(raw):
            edge = _EDGE.search(raw, end)
            end = edge.start() if edge else len(raw)
        yield raw[start:end].replace(_MARK, b" . ").split()
        start = end


class Block:
    """Positions by word of a run of words."""

    def __init__(self):
        self.lists: dict[str, dict[bytes, int]] = {}
        self.number = count(1)
        self.parts: list[np.ndarray] = []
        self.size = self.skip = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        """Words and marks in order; a mark takes a position that no list has."""
        if lang not in self.lists:
            known = self.lists[lang] = defaultdict(self.number.__next__)
            known[_MARK] = 0
        self.parts.append(np.array(list(map(self.lists[lang].__getitem__, words)), np.int32))
        self.size += len(words)

    def row(self) -> dict:
        at = np.concatenate([np.zeros(0, np.int32), *self.parts])
        positions = np.flatnonzero(at).astype(np.int32)
        numbers = at[positions]
        langs, words = [], []
        named = sorted((n, lang, w) for lang, known in self.lists.items() for w, n in known.items() if n)
        for _, lang, w in named:
            langs.append(lang)
            words.append(w.decode("utf-8", "surrogatepass"))
        sizes = np.bincount(numbers, minlength=len(named) + 1)[1:]
        own = np.bincount(numbers[positions >= self.skip], minlength=len(named) + 1)[1:]
        return {"skip": self.skip, "langs": langs, "words": words, "own": own, "sizes": sizes, "postings": packed(positions[np.argsort(numbers, kind="stable")])}


def packed(positions: np.ndarray) -> bytes:
    """Lists of ascending positions, one after another, as compressed gaps."""
    gaps = np.diff(positions, prepend=np.int32(0)).astype("<i4")
    return len(gaps).to_bytes(8, "little") + pa.compress(gaps.tobytes(), _CODEC, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(data[8:], 4 * n, _CODEC, asbytes=True), "<i4"), dtype=np.int32)


_BLOCKS = "block long, skip int, langs array<string>, words array<string>, own array<int>, sizes array<int>, postings binary"


def invert(documents: DataFrame) -> DataFrame:
    """Blocks of the documents (lang, text): words with their lists of positions."""
    source = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        block, number = Block(), count(TaskContext.get().partitionId() << 32)

        def closed(b: Block) -> pa.RecordBatch:
            row = {"block": next(number)} | b.row()
            texts, numbers = pa.list_(pa.string()), pa.list_(pa.int32())
            types = {"block": pa.int64(), "skip": pa.int32(), "langs": texts, "words": texts, "own": numbers, "sizes": numbers, "postings": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], types[k]) for k, v in row.items()], list(row))

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang, last = lang.as_py(), []
                for words in split_text(text.as_py()):
                    while words:
                        now, words = words[: BLOCK - block.size], words[BLOCK - block.size :]
                        block.add(lang, now)
                        last = (last + now[-2:])[-2:]
                        if block.size >= BLOCK:
                            yield closed(block)
                            block = Block()
                            block.add(lang, last)
                            block.skip = block.size
                block.add(lang, [_MARK])
                if block.size >= BLOCK:
                    yield closed(block)
                    block = Block()
        if block.size > block.skip:
            yield closed(block)

    return source.mapInArrow(run, _BLOCKS)


def number_words(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frequent words (lang, word, f, id), and the blocks (block, skip, sizes, postings,
    found) with the places and ids of those of their lists that are of frequent words."""
    listed = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "own")).alias("at", "w")).select("block", "at", "w.langs", "w.words", "w.own")
    counts = listed.groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("own").alias("f"))
    # Written once, so that ids stay.
    words = cut(counts.where(F.col("f") >= LEAST).withColumn("id", F.monotonically_increasing_id()), "frequent")
    found = listed.select("block", "at", F.col("langs").alias("lang"), F.col("words").alias("word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    ids = found.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("found"))
    return words, cut(blocks.select("block", "skip", "sizes", "postings").join(ids, "block"), "lists")


def language_sizes(blocks: DataFrame) -> DataFrame:
    """lang, n: all words of each language."""
    rows = blocks.select(F.explode(F.arrays_zip("langs", "own")).alias("w"))
    return rows.groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.own").alias("n"))


class Lists:
    """The lists of a block: occurrences of words in the order of their positions."""

    def __init__(self, sizes: np.ndarray, lists: np.ndarray, found: np.ndarray, postings: bytes):
        ids = np.full(len(sizes), -1, np.int64)
        ids[lists] = found
        all_ids, positions = np.repeat(ids, sizes), unpacked(postings)
        kept = all_ids >= 0
        order = np.argsort(positions[kept], kind="stable")  # the merge of ascending lists
        self.at, self.id = positions[kept][order], all_ids[kept][order]

    def extend(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge-join of ends, ascending, with the postings one further on: indices of the ends that
        are followed by a listed word, and of the postings."""
        places = np.searchsorted(self.at, ends + 1)
        places[places == len(self.at)] = 0
        hit = np.flatnonzero(self.at[places] == ends + 1) if len(self.at) else np.zeros(0, np.int64)
        return hit, places[hit]


def counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(order)))


def filter_places(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Bits of the filter for pairs of ids; the same as _filter_columns."""
    with np.errstate(over="ignore"):
        x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = []
        for _ in range(HASHES):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x >> np.uint64(20)) % np.uint64(FILTER_BITS))
    return out


def phrase_filter(pairs: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits that all of pairs (w1, w2) pass."""

    def run(batches):
        for b in batches:
            bits = np.unique(np.concatenate(filter_places(b.column("w1").to_numpy(), b.column("w2").to_numpy())))
            words, masks = (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))
            starts = np.flatnonzero(np.diff(words, prepend=-1)) if len(words) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[starts]), pa.array(np.bitwise_or.reduceat(masks, starts).view(np.int64) if len(starts) else np.zeros(0, np.int64))], ["i", "bits"])

    # At most FILTER_BITS / 64 rows, however many pairs there are.
    rows = pairs.select("w1", "w2").mapInArrow(run, "i long, bits long").groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    ok = np.ones(len(first), bool)
    for p in filter_places(first, second):
        ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _phrases(lists: DataFrame, words: int, bits=None) -> DataFrame:
    """w1, w2(, w3), a: frequent phrases of 2 or 3 words. Only pairs that pass the filter are extended."""
    names = [f"w{i + 1}" for i in range(words)]

    def run(batches):
        known = bits.value if bits else None
        for b in batches:
            for sizes, found, postings, skip in zip(b.column("sizes"), b.column("found"), b.column("postings"), b.column("skip"), strict=True):
                block = Lists(sizes.values.to_numpy(), found.values.field("at").to_numpy(), found.values.field("id").to_numpy(), postings.as_py())
                left, right = block.extend(block.at)
                columns, ends = [block.id[left], block.id[right]], block.at[right]
                if known is not None:
                    kept = passes(known, *columns)
                    columns, ends = [c[kept] for c in columns], ends[kept]
                    # A longer phrase is frequent only if its last words are, too.
                    left, right = block.extend(ends)
                    third = block.id[right]
                    kept = passes(known, columns[1][left], third)
                    columns, ends = [columns[0][left][kept], columns[1][left][kept], third[kept]], block.at[right][kept]
                own = ends >= skip.as_py()
                different, n = counted(*[c[own] for c in columns])
                yield pa.RecordBatch.from_arrays([*map(pa.array, different), pa.array(n)], [*names, "n"])

    counts = lists.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return cut(counts.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST), "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    square = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", square, wide(left) * wide(right)).cast("long")


def _lowest(cuts: list[Column]) -> Column:
    """The cut (score, k, l, r) with the lowest score, of these the first."""
    return F.array_min(F.array(*cuts))


def collocations(documents: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first BEST phrases of each language.

    Words are lower-cased in A-Z; a missing text is empty, a missing language NO_LANGUAGE. Repeated
    rows count each. Only lang and text are read. Without frequent phrases there are no rows.
    """
    blocks = cut(invert(documents), "blocks")
    words, lists = number_words(blocks)
    pairs = _phrases(lists, 2)
    bits = documents.sparkSession.sparkContext.broadcast(phrase_filter(pairs))
    triples = _phrases(lists, 3, bits)

    f = lambda i: words.select(F.col("id").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"s{i}"))
    cut_at = lambda k, left, right: F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    first = words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1"), F.col("word").alias("s1"))
    inside = triples.select("w1", "w2", "a").unionAll(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("_longer"))
    two = pairs.join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("_longer") < INSIDE * F.col("a"), F.lit(True)))
    two = two.join(first, "w1").join(f(2), "w2").select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", cut_at(1, F.col("f1"), F.col("f2")).alias("c"))
    three = triples.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = three.join(first, "w1").join(f(2), "w2").join(f(3), "w3")
    cuts = _lowest([cut_at(1, F.col("f1"), F.col("f23")), cut_at(2, F.col("f12"), F.col("f3"))])
    three = three.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", cuts.alias("c"))
    scored = two.unionByName(three).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    turn = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= BEST)
    return best.join(language_sizes(blocks), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
