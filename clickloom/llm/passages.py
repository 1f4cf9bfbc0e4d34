"""Repeated passages of words, by level-wise doubling.

Windows repeated at one length alone are extended to about twice that length: 9 words, 18 words, the
whole window (35). At 9 words only anchors are looked at (see anchors.py), which every repeated
window shares with its repeats. At 18 words an anchor is extended to the left and to the right; a
window holds at least one of the two. At 35 words all windows around the surviving anchors are
looked at. Of anchors with equal contexts (what all windows around them reach) one is extended, with
the number of them: all have the same windows.

Numbers of 9 and 18 words only choose candidates. Contexts are compared among the anchors with one
number, windows by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Runs, among, anchors, joint, layout, mixed
from .common import Words, cut, map_batches, second

WINDOW, SHORT, MIDDLE = 35, 9, 18
#: In place of a hot anchor's left run: it goes on to the windows at once.
HOT = 1


def gathered(batches, columns: int) -> list[np.ndarray]:
    """The columns of a partition's batches, whole."""
    whole = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate([b[i] for b in whole]) if whole else np.zeros(0, np.int64) for i in range(columns)]


def counted(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each value, how often it occurs (weighted)."""
    _, inverse = np.unique(x, return_inverse=True)
    return np.bincount(inverse, weights)[inverse] if len(x) else np.zeros(0)


def firsts(x: np.ndarray) -> np.ndarray:
    """True at the first occurrence of each value."""
    out = np.zeros(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


def _source(documents: DataFrame, text: str) -> DataFrame:
    """_id and _key tell a row apart from all rows but those that equal it in doc_id and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("doc_id", body).alias("_key"), body.alias("_text"))


_ANCHOR = "deal long, short long, left long, right long, context long, n int, _id long, _key long, place int"


def _numbers():
    number = Words()

    def of(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()
        return anchors(number(words), WINDOW, SHORT)[1] if len(words) >= WINDOW else np.zeros(0, np.uint64)

    return of


def _anchors(source: DataFrame, hot: np.ndarray) -> DataFrame:
    """Anchors to be dealt out by their number. Of anchors with equal contexts in a batch, one goes out
    with their count; the others are known to repeat and go out with n = 0, dealt by document. Hot
    anchors are dealt out by a second number of their context in place of their own."""

    def make():
        number = Words()

        def run(batch: pa.RecordBatch) -> dict:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, k, t in zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_text"), strict=True):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                ids = number(words)
                places, short, context, *other = anchors(ids, WINDOW, SHORT, second(ids) if len(hot) else None)
                runs = Runs(ids)
                fits_left, fits_right = places + SHORT >= MIDDLE, places + MIDDLE <= len(ids)
                start = np.where(fits_left, places + SHORT - MIDDLE, 0)
                left = np.where(fits_left, runs.at(start, start + MIDDLE), np.uint64(0))
                start = np.where(fits_right, places, 0)
                right = np.where(fits_right, runs.at(start, start + MIDDLE), np.uint64(0))
                if len(hot):
                    warm = among(short, hot)
                    short, left = np.where(warm, other[0], short), np.where(warm, np.uint64(HOT), left)
                for c, x in zip(cols, (short, left, right, context, np.full(len(places), i), np.full(len(places), k), places), strict=True):
                    c.append(x)
            short, left, right, context, ids, keys, places = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            same = joint(short, context)
            n, first = counted(same).astype(np.int32), firsts(same)
            n[~first] = 0
            deal = np.where(first, short.view(np.int64), keys)
            signed = lambda x: x.view(np.int64)
            return {"deal": deal, "short": signed(short), "left": signed(left), "right": signed(right), "context": signed(context), "n": n, "_id": ids, "_key": keys, "place": places.astype(np.int32)}

        return run

    return map_batches(source.select("_id", "_key", "_text"), _ANCHOR, make)


def _survivors(anchors_: DataFrame, parts: int) -> DataFrame:
    """_id, _key, place, whole, weight: anchors whose windows all repeat (whole), and anchors (weight
    1, or 2 if whole) whose windows have to be compared with those of other contexts."""

    def run(batches):
        _, short, left, right, context, n, ids, keys, places = gathered(batches, 9)
        sent = n > 0
        whole = ~sent
        weight = np.zeros(len(n), np.int32)
        at = np.flatnonzero(sent)
        same = joint(short[at], context[at])
        whole[at] = counted(same, n[at]) >= 2
        # One anchor for each context goes on, if a run of 18 words around it is in another context too.
        at = at[firsts(same)]
        longer = left[at] == HOT
        at, longer = at[longer | (counted(short[at]) >= 2)], longer[longer | (counted(short[at]) >= 2)]
        for side in (left, right):
            here = (side[at] != 0) & (left[at] != HOT)
            longer[here] |= counted(side[at][here]) >= 2
        weight[at[longer]] = 1 + whole[at[longer]]
        keep = whole | (weight > 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, keys, places, whole, weight)], ["_id", "_key", "place", "whole", "weight"])

    return anchors_.repartition(parts, "deal").mapInArrow(run, "_id long, _key long, place int, whole boolean, weight int")


_WINDOW = "deal long, a long, b long, weight int, known boolean, _id long, _key long, start int"


def _windows(source: DataFrame, survivors: DataFrame) -> DataFrame:
    """The windows around anchors with a weight, each once, with their numbers a and b. Of equal
    windows in a batch one goes out with all their weight; what it settles is known, dealt by document."""
    wanted = survivors.where("weight > 0").groupBy("_id", "_key").agg(F.collect_list(F.struct("place", "weight")).alias("_at"))

    def make():
        number = Words()

        def run(batch: pa.RecordBatch) -> dict:
            out: list[list] = [[] for _ in range(6)]
            for i, k, t, at in zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), batch.column("_text"), batch.column("_at").to_pylist(), strict=True):
                ids = number(t.as_py().encode("utf-8", "surrogatepass").split())
                weights = np.zeros(len(ids) - WINDOW + 1, np.int32)
                for a in at:
                    reach = slice(max(0, a["place"] - WINDOW + SHORT), a["place"] + 1)
                    weights[reach] = np.maximum(weights[reach], a["weight"])
                starts = np.flatnonzero(weights)
                for c, x in zip(out, (Runs(ids).all(WINDOW)[starts].view(np.int64), Runs(second(ids)).all(WINDOW)[starts].view(np.int64), weights[starts], np.full(len(starts), i), np.full(len(starts), k), starts.astype(np.int32)), strict=True):
                    c.append(x)
            a, b, weight, ids, keys, starts = (np.concatenate(x) for x in out)
            same = joint(a, b)
            whole = counted(same, weight)
            known = (whole >= 2) & (weight == 1)
            # One of each goes out, with the weight of all; the others only if they are to be told.
            first = firsts(same)
            sent = first & ~known
            more = first & known
            keep = sent | known
            cols = [np.concatenate([x[keep], x[more]]) for x in (a, b, whole.astype(np.int32), known, ids, keys, starts)]
            cols[3][int(keep.sum()) :] = False
            cols[2][int(keep.sum()) :] = 2
            deal = np.where(cols[3], mixed(cols[5].view(np.uint64)).view(np.int64), cols[0])
            return dict(zip(("deal", "a", "b", "weight", "known", "_id", "_key", "start"), (deal, *cols), strict=True))

        return run

    rows = source.select("_id", "_key", "_text").join(wanted, ["_id", "_key"])
    return map_batches(rows, _WINDOW, make)


def _repeated(windows: DataFrame, parts: int) -> DataFrame:
    """_id, _key, start of the windows that another anchor's windows repeat."""

    def run(batches):
        _, a, b, weight, known, ids, keys, starts = gathered(batches, 8)
        hit = known.astype(bool)
        at = np.flatnonzero(~hit)
        hit[at] = (counted(joint(a[at], b[at]), weight[at]) >= 2) & (weight[at] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ids, keys, starts)], ["_id", "_key", "start"])

    return windows.repartition(parts, "deal").mapInArrow(run, "_id long, _key long, start int")


def covered(places: list[int], starts: list[int], n: int) -> np.ndarray:
    """Which of n words are in a repeated window."""
    edges = np.zeros(n + 1, np.int64)
    p = np.asarray(places, np.int64)
    np.add.at(edges, np.maximum(p - WINDOW + SHORT, 0), 1)
    np.add.at(edges, np.minimum(p + WINDOW, n), -1)
    s = np.asarray(starts, np.int64)
    np.add.at(edges, s, 1)
    np.add.at(edges, s + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeated(documents: DataFrame, text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (string; with digests its kept_sha256) per row.

    Every word covered by a 35-word window whose words also start elsewhere, in the same or another
    row, is removed; windows are judged on the input. kept joins the other words by one space. Null
    texts and texts of fewer words have no window; repeated rows repeat each other's windows and each
    give a row. Other columns are ignored.
    doc_id is a number; a text that is none makes the query fail.
    """
    source = _source(documents, text)
    hot, parts = layout(source, _numbers)
    found = cut(_survivors(_anchors(source, hot), parts), "anchors")
    starts = _repeated(_windows(source, found), parts)
    spans = found.where("whole").select("_id", "_key", "place", F.lit(None).cast("int").alias("start")).unionByName(starts.withColumn("place", F.lit(None).cast("int")))
    spans = spans.groupBy("_id", "_key").agg(F.collect_list("place").alias("_places"), F.collect_list("start").alias("_starts"))
    rows = source.join(spans, ["_id", "_key"], "left").select("doc_id", "_text", "_places", "_starts")
    kind = dict(rows.dtypes)["doc_id"]

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            n, removed, kept = [], [], []
            for t, places, starts in zip(batch.column("_text"), batch.column("_places").to_pylist(), batch.column("_starts").to_pylist(), strict=True):
                words = t.as_py().encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                gone = 0
                if places or starts:
                    out = covered(places, starts, len(words))
                    gone = int(out.sum())
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                removed.append(gone)
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest.decode("utf-8", "replace"))
            return {"doc_id": batch.column("doc_id"), "n_words": n, "n_removed": removed, "kept_sha256" if digests else "kept": pa.array(kept, pa.string())}

        return run

    return map_batches(rows, f"doc_id {kind}, n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string", make)
