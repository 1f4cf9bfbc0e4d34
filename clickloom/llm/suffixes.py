"""Repeated byte strings by merging Burrows-Wheeler transforms.

Anchors (see anchors.py) tell which 80-byte strings different documents can share windows in. Of
anchors with equal strings around them all but the first document's are settled at once. The strings
that differ are dealt out by anchor, so that equal 50-byte windows meet in one task. There, shards of
strings get their own suffix order and transform; shards are merged by interleave refinement: an
order of shard numbers, refined once for each character, says whose suffix comes next. Where two
neighbours first part gives their common prefix, so 50 refinements leave the intervals of suffixes
that share 50 bytes. Suffixes of merged shards are never sorted again. Strings around hot anchors
would meet in one task; they are compared window by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Runs, among, anchors, joint, layout, mixed
from .common import cut, map_batches, second
from .passages import counted, firsts, gathered

WINDOW, SHORT = 50, 20
REACH = WINDOW - SHORT
#: Strings in a shard.
SHARD = 4096
#: A row's number holds 33 bits of its key and 30 bits of a place.
KEY, PLACE = (1 << 33) - 1, (1 << 30) - 1
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTES2 = second(_BYTES)


def starts_of(change: np.ndarray) -> np.ndarray:
    """For each place of a sorted list, the place where its run of equals begins."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a shard in order, by prefix doubling of what is not settled yet.
    Symbols are 0 at the end of each string (of which the earlier is less), else 1 to 256; strings
    have under 112 symbols."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(7):
        s = padded[j : j + n]
        key = key * 512 + np.where(alive, s, 0)
        alive &= s > 0
    # What follows a string's end does not count.
    ends = np.flatnonzero(symbols == 0)
    end_of = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    order = np.argsort(key, kind="stable")
    change = np.ones(n, bool)
    np.not_equal(key[order[1:]], key[order[:-1]], out=change[1:])
    rank = np.empty(n, np.int64)
    rank[order] = starts_of(change)
    width = 7
    while width < 112:
        alone = change & np.concatenate([change[1:], [True]])
        order = order[~alone]
        if not len(order):
            break
        then = order + width
        key = rank[order] * (n + 2) + np.where(then <= end_of[order], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        change = np.ones(len(order), bool)
        np.not_equal(key[1:], key[:-1], out=change[1:])
        old = rank[order]
        group = np.ones(len(order), bool)
        np.not_equal(old[1:], old[:-1], out=group[1:])
        rank[order] = old + starts_of(change) - starts_of(group)
        width *= 2
    return np.argsort(rank, kind="stable")


def transform(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform (the symbol before each suffix, 0 before a string's first), and
    for each of its places the place of the suffix that is longer by that symbol."""
    before = np.concatenate([[0], symbols])[order].astype(np.uint16)
    longer = np.empty(len(order), np.int64)
    longer[np.argsort(before, kind="stable")] = np.arange(len(order))
    return before, longer


def small(x: np.ndarray) -> np.ndarray:
    """The same order of values in as few bytes as they need, which sorts faster; 0 stays 0."""
    values = np.flatnonzero(np.bincount(np.concatenate([[0], x])))
    if len(values) > 256:
        return x
    codes = np.zeros(int(values[-1]) + 1, np.uint8)
    codes[values] = np.arange(len(values))
    return codes[x]


def interleave(transforms: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, intervals): places in the shards' joined orders, interleaved, and the number of the
    interval each belongs to, of all suffixes that share their first `depth` symbols with another.

    Each round deals the suffixes out by the symbol before them, in the order so far: afterwards they
    are interleaved by one more symbol. Suffixes that a round tells apart from both neighbours have a
    shorter common prefix with all others, and so has all that extends them: they are dropped. So are
    those that start too near their string's first symbol to be extended `depth` times.
    """
    sizes = [len(before) for before, _ in transforms]
    base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    before = small(np.concatenate([t[0] for t in transforms]))
    longer = np.concatenate([t[1] for t in transforms]) + base
    at = np.flatnonzero(starts >= depth)
    interval = np.zeros(len(at), np.int32)
    for _ in range(depth):
        if not len(at):
            break
        symbol = before[at]
        dealt = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[dealt], interval[dealt]
        apart = np.ones(len(at) + 1, bool)
        np.not_equal(interval[1:], interval[:-1], out=apart[1:-1])
        apart[1:-1] |= symbol[1:] != symbol[:-1]
        keep = ~(apart[:-1] & apart[1:])
        at = longer[at[dealt[keep]]]
        interval = np.cumsum(apart[:-1], dtype=np.int32)[keep]
    return at, interval


def least_documents(strings: list[bytes], documents: np.ndarray) -> list[np.ndarray]:
    """For each string, the least document among all strings with the same 50 bytes, by start."""
    lengths = np.array([len(s) for s in strings])
    windows = np.maximum(0, lengths - WINDOW + 1)
    bounds = np.concatenate([[0], np.cumsum(windows)])
    values = np.repeat(documents, windows)
    owners, starts, transforms = [], [], []
    for a in range(0, len(strings), SHARD):
        size = lengths[a : a + SHARD]
        symbols = np.zeros(int(size.sum()) + len(size), np.uint16)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        inside = np.ones(len(symbols), bool)
        inside[first + size] = False
        symbols[inside] = np.frombuffer(b"".join(strings[a : a + SHARD]), np.uint8).astype(np.uint16) + 1
        order = suffix_order(symbols)
        owner = np.repeat(np.arange(len(size)), size + 1)[order]
        owners.append(owner + a)
        starts.append(order - first[owner])
        transforms.append(transform(symbols, order))
    if transforms:
        where = np.concatenate(starts)
        at, interval = interleave(transforms, where, WINDOW)
        if len(at):
            owner, start = np.concatenate(owners)[at], where[at]
            new = np.concatenate([[True], interval[1:] != interval[:-1]])
            least = np.minimum.reduceat(documents[owner], np.flatnonzero(new))[np.cumsum(new) - 1]
            values[bounds[owner] + start] = least
    return [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _source(documents: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select("doc_id", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("doc_id", body).bitwiseAND(F.lit(KEY)).alias("_key"), body.alias("_text"))


def _numbers():
    def of(text: str) -> np.ndarray:
        return anchors(_BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], WINDOW, SHORT)[1]

    return of


def _anchors(source: DataFrame, hot: np.ndarray) -> DataFrame:
    """short, context, _id, row: anchors to be dealt out by their number. Of anchors with equal
    contexts in a batch, those of the least document go out; the others are known to repeat an
    earlier document's and go out with context 0, dealt by document. Hot anchors are dealt out by a
    second number of their context in place of their own; the context's last bit tells them."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for i, k, t in zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_text"), strict=True):
                raw = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) < WINDOW:
                    continue
                if len(raw) > PLACE:
                    raise ValueError(f"a text has over {PLACE} bytes")
                places, short, context, *other = anchors(_BYTES[raw], WINDOW, SHORT, _BYTES2[raw] if len(hot) else None)
                context &= ~np.uint64(1)
                context[context == 0] = 2
                if len(hot):
                    warm = among(short, hot)
                    short = np.where(warm, other[0], short)
                    context |= warm.astype(np.uint64)
                for c, x in zip(cols, (short.view(np.int64), context.view(np.int64), np.full(len(places), i), (k << 30) | places), strict=True):
                    c.append(x)
            short, context, ids, rows = map(np.concatenate, cols)
            inverse = joint(short, context)
            least = np.full(len(context), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, ids)
            later = ids > least[inverse]
            return {"short": np.where(later, mixed(rows.view(np.uint64) >> np.uint64(30)).view(np.int64), short), "context": np.where(later, 0, context), "_id": ids, "row": rows}

        return run

    return map_batches(source.where("_id is not null").select("_id", "_key", "_text"), "short long, context long, _id long, row long", make)


def _survivors(anchors_: DataFrame, parts: int) -> DataFrame:
    """_id, row, short, whole, hot: anchors all of whose windows an earlier document has (whole), and
    anchors of a context's first document whose windows are to be compared with other contexts'.

    Contexts are compared among the anchors with one number, hot ones by two numbers of their own."""

    def run(batches):
        short, context, ids, rows = gathered(batches, 4)
        whole, hot = context == 0, (context & 1) == 1
        ask = np.zeros(len(ids), bool)
        at = np.flatnonzero(~whole)
        # Anchors that one document alone has are of no interest.
        pairs = firsts(mixed(short[at].view(np.uint64)) ^ ids[at].view(np.uint64))
        _, inverse = np.unique(short[at], return_inverse=True)
        several = (np.bincount(inverse, pairs)[inverse] > 1) | hot[at] if len(at) else pairs
        at = at[several]
        inverse = joint(short[at], context[at])
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids[at])
        later = ids[at] > least[inverse]
        whole[at[later]] = True
        at, inverse = at[~later], inverse[~later]
        # What is left differs in context: of one context only its first document's anchors.
        mixed_groups = counted(short[at], firsts(inverse).astype(float)) > 1
        ask[at[mixed_groups | hot[at]]] = True
        keep = whole | ask
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, rows, short, whole, hot)], ["_id", "row", "short", "whole", "hot"])

    return anchors_.repartition(parts, "short").mapInArrow(run, "_id long, row long, short long, whole boolean, hot boolean")


_CANDIDATE = "deal long, a long, b long, known boolean, _id long, row long, bytes binary"


def _candidates(source: DataFrame, survivors: DataFrame) -> DataFrame:
    """What is to be compared: the contexts of the asking anchors (bytes), dealt out by anchor, and the
    windows around hot ones (a and b, 128 bits), dealt out by window.

    The strings of a hot anchor would meet in one task, so that they are compared window by window. Of
    equal windows in a batch one of the least document goes out, which settles the others (known)."""
    at = F.struct(F.col("row").bitwiseAND(F.lit(PLACE)).alias("place"), "short", "hot").alias("_at")
    wanted = survivors.select("_id", F.shiftright("row", 30).alias("_key"), at).groupBy("_id", "_key").agg(F.collect_list("_at").alias("_at"))

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            short, owners, rows, strings = [], [], [], []
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for i, k, t, at in zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_text"), batch.column("_at").to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for x in at:
                    if not x["hot"]:
                        p = x["place"]
                        short.append(x["short"])
                        owners.append(i)
                        rows.append(k << 30 | p)
                        strings.append(raw[max(0, p - REACH) : p + SHORT + REACH])
                hot = np.array([x["place"] for x in at if x["hot"]], np.int64)
                if len(hot):
                    starts = np.unique((hot[:, None] - np.arange(REACH + 1)).ravel())
                    starts = starts[(starts >= 0) & (starts + WINDOW <= len(raw))]
                    symbols = np.frombuffer(raw, np.uint8)
                    a, b = (Runs(table[symbols]).all(WINDOW)[starts].view(np.int64) for table in (_BYTES, _BYTES2))
                    for c, x in zip(cols, (a, b, np.full(len(starts), i), (k << 30) | starts), strict=True):
                        c.append(x)
            a, b, ids, places = map(np.concatenate, cols)
            inverse = joint(a, b)
            least = np.full(len(a), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, ids)
            known = ids > least[inverse]
            deal = np.where(known, mixed(places.view(np.uint64) >> np.uint64(30)).view(np.int64), a)
            none, n = np.zeros(len(short), np.int64), len(short)
            whole = [np.concatenate(x) for x in ((np.array(short, np.int64), deal), (none, a), (none, b), (np.zeros(n, bool), known), (np.array(owners, np.int64), ids), (np.array(rows, np.int64), places))]
            return dict(zip(("deal", "a", "b", "known", "_id", "row"), whole, strict=True)) | {"bytes": pa.array([*strings, *[None] * len(a)], pa.binary())}

        return run

    return map_batches(source.select("_id", "_key", "_text").join(wanted, ["_id", "_key"]), _CANDIDATE, make)


def comparable(strings: list[bytes], places: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Indexes of the strings that can share a window with another: a window holds its anchor and,
    of the REACH bytes around it, half on one side at least, so that these have to be shared too."""
    lengths = np.array([len(s) for s in strings])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    runs = Runs(_BYTES[np.frombuffer(b"".join(strings), np.uint8)])
    anchor, half = first + np.minimum(places, REACH), REACH // 2
    whole = runs.at(first, first + lengths)
    one = firsts(mixed(whole) ^ documents.view(np.uint64))
    good = np.zeros(len(strings), bool)
    for start, end in ((anchor - half, anchor + SHORT), (anchor, anchor + SHORT + half)):
        fits = np.flatnonzero((start >= first) & (end <= first + lengths))
        number = runs.at(start[fits], end[fits])
        good[fits] |= counted(number, firsts(mixed(number) ^ whole[fits]).astype(float)) > 1
    # Of equal strings of one document one is compared.
    return np.flatnonzero(good & one)


def _repeated(candidates: DataFrame, parts: int) -> DataFrame:
    """_id, _key, start of the windows around asking anchors that an earlier document has."""

    def compared(documents: np.ndarray, rows: np.ndarray, strings: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        places = rows & PLACE
        at = comparable(strings, places, documents)
        least = least_documents([strings[i] for i in at.tolist()], documents[at]) if len(at) else []
        found = {(strings[i], documents[i]): x for i, x in zip(at.tolist(), least, strict=True)}
        for i, (n, document) in enumerate(zip(strings, documents.tolist(), strict=True)):
            if (n, document) in found:
                later = np.flatnonzero(found[n, document] < document)
                if len(later):
                    yield i, max(0, int(places[i]) - REACH) + later

    def run(batches):
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        strings: list[bytes | None] = []
        for batch in batches:
            for c, name in zip(columns, ("a", "b", "known", "_id", "row"), strict=True):
                c.append(batch.column(name).to_numpy(zero_copy_only=False))
            strings += batch.column("bytes").to_pylist()
        a, b, known, ids, rows = map(np.concatenate, columns)
        text = np.array([x is not None for x in strings], bool)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        at = np.flatnonzero(text)
        if len(at):
            for i, starts in compared(ids[at], rows[at], [x for x in strings if x is not None]):
                j = at[i]
                for c, x in zip(out, (np.full(len(starts), ids[j]), np.full(len(starts), int(rows[j]) >> 30), starts), strict=True):
                    c.append(x)
        hit = ~text & known.astype(bool)
        at = np.flatnonzero(~text & ~hit)
        inverse = joint(a[at], b[at])
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids[at])
        hit[at] = ids[at] > least[inverse]
        for c, x in zip(out, (ids[hit], rows[hit] >> 30, rows[hit] & PLACE), strict=True):
            c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["_id", "_key", "start"])

    return candidates.repartition(parts, "deal").mapInArrow(run, "_id long, _key long, start long")


def covered(places: list[int], starts: list[int], n: int) -> np.ndarray:
    """Which of n bytes are in a removed window."""
    edges = np.zeros(n + 1, np.int32)
    p = np.asarray(places, np.int64)
    np.add.at(edges, np.maximum(p - REACH, 0), 1)
    np.add.at(edges, np.minimum(p + WINDOW, n), -1)
    s = np.asarray(starts, np.int64)
    np.add.at(edges, s, 1)
    np.add.at(edges, s + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeated(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array<struct<start, end>>) per row.

    Every byte covered by a 50-byte string that also starts in a row with a smaller doc_id is removed;
    strings are judged on the input and never cross rows. Null texts count as empty. Rows without a
    doc_id keep everything and take nothing from others; rows with equal doc_ids take nothing from
    each other. doc_id is a number; a text has under 1 GiB (a longer one raises an error). Other columns
    are ignored.
    """
    source = _source(documents, text)
    hot, parts = layout(source, _numbers)
    found = cut(_survivors(_anchors(source, hot), parts), "anchors")
    starts = _repeated(_candidates(source, found.where("not whole")), parts)
    whole = found.where("whole").select("_id", F.shiftright("row", 30).alias("_key"), F.col("row").bitwiseAND(F.lit(PLACE)).alias("place"), F.lit(None).cast("long").alias("start"))
    spans = whole.unionByName(starts.withColumn("place", F.lit(None).cast("long")))
    spans = spans.groupBy("_id", "_key").agg(F.collect_list("place").alias("_places"), F.collect_list("start").alias("_starts"))
    rows = source.join(spans, ["_id", "_key"], "left").select("doc_id", "_text", "_places", "_starts")
    kind = dict(rows.dtypes)["doc_id"]

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for t, places, starts in zip(batch.column("_text"), batch.column("_places").to_pylist(), batch.column("_starts").to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                spans: list[dict] = []
                kept = raw
                if places or starts:
                    gone = covered(places, starts, len(raw))
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = [{"start": a, "end": b} for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append(spans)
            return {"doc_id": batch.column("doc_id")} | out | {"spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}

        return run

    return map_batches(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>", make)
