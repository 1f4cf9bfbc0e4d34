"""SimHash near-duplicates, linked through pivot distance tables.

Two fingerprints within RADIUS bits have distances to any reference fingerprint (pivot) that differ
by RADIUS at most. Over 64-bit fingerprints of unrelated texts such distances all lie near 32, so
pivots discard pairs well but do not tell which pairs to look at; that comes from agreement: cut
into runs of bits, two linked fingerprints agree on all but RADIUS runs. Every fingerprint gets its row
of distances to PIVOTS references once. Fingerprints meet where they agree, pairs whose rows differ by
more than RADIUS in any column are discarded, and survivors are compared bit by bit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, components, cut, map_batches, place_of, row_key, together

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Of near copies that keep_similar looks for: words in a shingle, least Jaccard similarity of the shingles.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Rows that the order of shingles is estimated from (or that share of all rows, if it is more), and most
#: shingles it puts last, 16 bytes each in a broadcast. Any order gives the same links.
ORDER_ROWS, ORDER_SHARE, ORDER_SHINGLES = 5_000, 0.1, 500_000
#: Nodes that share a shingle and are paired at once; of more, first neighbours only, then what these left apart.
SMALL = 32
#: Reference fingerprints in a table. Each column halves the pairs, roughly.
PIVOTS = 16
#: Fingerprints that share their agreed bits by chance: more than this, and more runs are cut.
CROWD = 4096
#: Fingerprints in one group; a larger one is dealt out in pairs of parts, each pair a task.
GROUP = 50_000
_EDGES = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(PIVOTS)], np.uint64)


def measured(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the bytes of each run of `size` words, or of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n]
    ends = (ends - 1)[min(size, len(words)) - 1 :]
    long, starts, ends = ends - starts, starts.tolist(), ends.tolist()
    h = xxhash.xxh64_intdigest
    return np.concatenate([np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], "<u8") for i in range(0, n, 1 << 16)]), long


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `size` words, or of all words if there are fewer; none without words."""
    return measured(text, size)[0]


def simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's shingles, signed; 0 without words."""
    return simhash(shingles(text))


def fingerprint_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    source = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = dict(source.dtypes)["doc_id"]

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": pa.array([fingerprint(t.as_py()) for t in batch.column("_text")], pa.int64())}

    return map_batches(source, f"doc_id {kind}, fp long", make)


def band_masks(n: int) -> list[int]:
    """Masks of the bits that two linked fingerprints may agree on, for n distinct fingerprints: the
    fewest runs of bits for which an agreement by chance is shared by at most CROWD of them."""
    runs = RADIUS + 1
    while runs < 12 and n >> (BITS * (runs - RADIUS) // runs) > CROWD:
        runs += 1
    edges = [BITS * i // runs for i in range(runs + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(runs)]
    masks = [sum(c) for c in combinations(parts, runs - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivot_table(fp: Column) -> list[Column]:
    """A fingerprint's distances to all pivots, made once and carried along: a byte each, in two longs."""
    signed = [int(p.astype(np.int64)) for p in _EDGES]
    bytes_ = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * (i % 8)) for i, p in enumerate(signed)]
    return [reduce(Column.bitwiseOR, bytes_[k : k + 8]).alias(f"t{k // 8}") for k in range(0, PIVOTS, 8)]


def near(i: int, others: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Those of `others` within RADIUS bits of i: of the pairs, those whose distances to a pivot differ
    by more than RADIUS are discarded, column by column; survivors are verified."""
    for column in table:
        others = others[np.abs(column[others] - column[i]) <= RADIUS]
    return others[np.bitwise_count(fps[others] ^ fps[i]) <= RADIUS]


def link_group(fps: np.ndarray, nodes: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node) for all but the least node of each component of a group. Searches breadth
    first among what no component holds yet, so that dense groups are not compared pair by pair."""
    order = np.argsort(nodes, kind="stable")
    left, links = order, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            found = near(frontier.pop(), left, fps, table)
            if len(found):
                links += [(int(nodes[j]), int(nodes[root])) for j in found]
                frontier += found.tolist()
                left = left[~np.isin(left, found)]
    return links


def link_fingerprints(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect the nodes (node long, fp long, distinct fingerprints) exactly as
    all pairs within RADIUS bits do."""
    n = nodes.count()
    masks = band_masks(n)
    table = ["t0", "t1"]
    nodes = nodes.select("node", "fp", *pivot_table(F.col("fp")))
    rows = nodes.select("node", "fp", *table, F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("band", "mask"))
    rows = rows.select("node", "fp", *table, F.xxhash64("band", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # Groups that would be too large for a task: each row goes to every pair of parts with its own.
    large = cut(rows.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("parts")), "large")
    if not large.isEmpty():
        rows = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("node", "fp", *table, F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 500_000)

    def run(batches):
        whole = [[c.to_numpy() for c in b.columns] for b in batches]
        node, fp, key, t0, t1 = (np.concatenate([b[i] for b in whole]) if whole else np.zeros(0, np.int64) for i in range(5))
        order = np.argsort(key, kind="stable")
        node, fp, key = node[order], fp[order].view(np.uint64), key[order]
        pivots = np.ascontiguousarray(np.stack([t0[order], t1[order]], 1).view(np.int8).T)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
        links: list[tuple[int, int]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                links += link_group(fp[a:b], node[a:b], pivots[:, a:b])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["src", "dst"])

    return rows.select("node", "fp", "key", *table).repartition(parts, "key").mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_copies per row of documents.

    component_id is the smallest doc_id that links within RADIUS bits lead to. Texts without words
    have fingerprint zero and link like others; null texts count as empty; repeated rows each give a
    row. Rows without a doc_id take part, but their fingerprint leads nowhere unless a row with an id
    has it too; their component is null if no such row does. doc_id is a number (a text that is none
    makes the query fail). Unlike texts of one doc_id are one node if it is the smallest of both
    fingerprints: what either links to is then one component. Other columns are ignored.
    n_copies counts the rows with the same fingerprint.
    """
    docs = cut(fingerprint_documents(documents, text), "fingerprints")
    nodes = cut(docs.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node"), F.count("*").alias("n_copies")), "nodes")
    roots = components(link_fingerprints(nodes.where("node is not null").select("node", "fp")))
    found = nodes.join(roots, "node", "left").select("fp", "n_copies", F.coalesce("root", "node").alias("component_id"))
    return docs.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def _least_rows(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """documents with one row of each group: the one with the smallest doc_id, then key. groups has
    _a, _b (see row_key), doc_id and root of all rows with a doc_id. Rows without one stay."""
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", "_a", "_b")).alias("_kept"))
    kept = cut(kept.select("_kept._a", "_kept._b"), "kept")
    ids, text = place_of(documents, "doc_id"), place_of(documents, "text")
    rows = apart(documents).select("*", *row_key(ids, text))
    found = rows.where(ids.isNotNull()).join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return together(found.unionByName(rows.where(ids.isNull())), documents)


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each component of fingerprints: the one with the smallest doc_id.

    Rows are judged, not ids: of different texts with one doc_id each counts for itself. Rows equal in
    doc_id and text count once, whichever of them stays. Rows without a doc_id stay.
    """
    rows = documents.where("doc_id is not null").select("doc_id", F.struct("doc_id", *row_key(F.col("doc_id"), F.col("text"))).alias("_row"), "text")
    docs = cut(fingerprint_documents(rows.select(F.col("_row").alias("doc_id"), "text")), "fingerprints")
    nodes = cut(docs.groupBy("fp").agg(F.min(F.col("doc_id.doc_id").cast("long")).alias("node")), "nodes")
    found = nodes.join(components(link_fingerprints(nodes)), "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return _least_rows(documents, docs.join(found, "fp").select("doc_id.*", "root"))


def least_shared(n: int) -> int:
    """Shingles that a text of n shingles shares at least with one of n or more that is SIMILARITY alike."""
    return int(np.ceil(SIMILARITY * n - 1e-9))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles, each sorted, have SIMILARITY; two without any have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def parity(own: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes, 64 classes or as many as hashes up to twice that: whether the set
    has an odd number of the class. Eight to a byte."""
    classes = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(classes - 1)).view(np.int64), minlength=classes) & 1, bitorder="little")


def open_to(a: np.ndarray, m: int, b: np.ndarray, n: int) -> bool:
    """Whether sets of m and n shingles with these parities may have SIMILARITY: each bit that differs is a
    shingle of one set only. Never false for sets that have it."""
    while len(a) != len(b):  # half as many classes
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= (m + n) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6


def frequent_shingles(source: DataFrame, size: int = NEAR_SHINGLE, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are found more than once in some of the rows (_a, _text), sorted, and how often; with
    `once`, equal texts count once."""
    share = max(ORDER_ROWS / max(source.count(), 1), ORDER_SHARE)
    some = source.where(F.pmod(F.xxhash64("_a"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("_text")
    some = some.distinct() if once else some

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            return {"h": np.concatenate([np.unique(shingles(t.as_py(), size)) for t in batch.column("_text")]).view(np.int64)}

        return run

    shared = cut(map_batches(some, "h long", make).groupBy("h").count().where("count > 1"), "order")
    # The most frequent ones: from the least count that leaves no more than ORDER_SHINGLES.
    least, left = 1 << 62, ORDER_SHINGLES
    for r in shared.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():
        left -= r["n"]
        if left < 0:
            break
        least = r["count"]
    rows = shared.where(F.col("count") >= least).select("h", "count").toArrow().combine_chunks()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _sets(source: DataFrame) -> DataFrame:
    """_a, _b, doc_id, node (a hash of the set of shingles), fp, n (shingles), parity and prefix per row:
    the rarest shingles, so many that texts with SIMILARITY share one. Of those that the order leaves
    equal the longest count as the rarest: runs of small words meet by chance, the more the larger the table."""
    shared = source.sparkSession.sparkContext.broadcast(frequent_shingles(source))

    def make():
        known, often = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"node": [], "fp": [], "n": [], "parity": [], "prefix": []}
            for t in batch.column("_text"):
                h, long = measured(t.as_py(), NEAR_SHINGLE)
                own, first = np.unique(h, return_index=True)
                rank = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, often[at], 0)
                out["node"].append(int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)))
                out["fp"].append(simhash(h))
                out["n"].append(len(own))
                out["parity"].append(parity(own).tobytes())
                out["prefix"].append(own[np.lexsort((-long[first], rank))][: len(own) - least_shared(len(own)) + 1].view(np.int64))
            return {"_a": batch.column("_a"), "_b": batch.column("_b"), "doc_id": batch.column("doc_id"), **out, "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))}

        return run

    return map_batches(source, f"_a long, _b long, doc_id {dict(source.dtypes)['doc_id']}, node long, fp long, n long, parity binary, prefix array<long>", make)


def _strays(n: np.ndarray, at: np.ndarray, root: np.ndarray):
    """Places (i, j) of one shingle's nodes, in order of n, that have different roots and may be
    SIMILARITY alike, in parts. Nodes of the most frequent root are not paired among themselves: large
    groups of copies, which have one root by now, cost nothing but a look at each node."""
    different, own, often = np.unique(root, return_inverse=True, return_counts=True)
    main = own == np.argmax(often)
    for i in np.flatnonzero(~main).tolist() if len(different) > 1 else ():
        low, high = np.searchsorted(n, [SIMILARITY * n[i] - 1e-9, n[i] / SIMILARITY + 1e-9])
        j = np.arange(low, high)
        # Two strays meet once.
        j = j[(root[j] != root[i]) & (main[j] | (j > i))]
        room = np.minimum(n[i] - at[i], n[j] - at[j])
        j = j[room >= SIMILARITY / (1 + SIMILARITY) * (n[i] + n[j]) - 1e-6]
        if len(j):
            yield np.full(len(j), i), j


def _pairs(rows: DataFrame, parts: int, all_pairs: bool) -> DataFrame:
    """a, b, key of rows (key, node, n, at, root): nodes that share a shingle and may be SIMILARITY alike
    by their numbers of shingles and the places of the shared one. With all_pairs, those of different
    roots; else more than SMALL nodes are paired with neighbours only, and the key is given."""

    def run(batches):
        whole = [[c.to_numpy() for c in b.columns] for b in batches]
        key, node, n, at, root = (np.concatenate([b[i] for b in whole]) if whole else np.zeros(0, np.int64) for i in range(5))
        order = np.lexsort((node, n, key))
        key, node, n, at, root = key[order], node[order], n[order], at[order], root[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        large = np.repeat(sizes > SMALL, sizes)
        named = np.zeros(0, np.int64) if all_pairs else key[starts[sizes > SMALL]]
        empty = pa.nulls(len(named), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, pa.array(named, pa.int64())], ["a", "b", "key"])
        if all_pairs:
            for k, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                for i, j in _strays(n[k : k + size], at[k : k + size], root[k : k + size]):
                    pairs = np.unique(np.stack([np.minimum(node[k + i], node[k + j]), np.maximum(node[k + i], node[k + j])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], ["a", "b", "key"])
            return
        left = np.arange(len(key))
        for d in range(1, len(key)):
            left = left[left < len(key) - d]
            left = left[key[left] == key[left + d]]
            if d == 3:
                left = left[~large[left]]
            if not len(left):
                break
            # In order of n, those further on are longer still.
            left = left[n[left] >= SIMILARITY * n[left + d] - 1e-9]
            i, j = left, left + d
            # The first shared shingle of a pair leaves room for all that it must share.
            room = np.minimum(n[i] - at[i], n[j] - at[j])
            found = room >= SIMILARITY / (1 + SIMILARITY) * (n[i] + n[j]) - 1e-6
            i, j = i[found], j[found]
            if len(i):
                pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], ["a", "b", "key"])

    # By a hash of the key: where a join has dealt rows out by the key itself, Spark takes this exchange for done
    # and may then read the join's own one by its writers, a key's rows in several tasks.
    return rows.select("key", "node", "n", "at", "root").repartition(parts, F.xxhash64("key")).mapInArrow(run, "a long, b long, key long")


def _open_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that parities leave open. They take a bit or two for each shingle: texts, fifty times
    as large, move for these pairs only."""
    sides = nodes.select("node", "n", "parity")
    both = pairs.join(sides.toDF("a", "_m", "_p"), "a").join(sides.toDF("b", "_n", "_q"), "b").select("a", "b", "_m", "_p", "_n", "_q")

    def make():
        bits = lambda x: np.frombuffer(x.as_buffer(), np.uint8)

        def run(batch: pa.RecordBatch) -> dict:
            m, n = batch.column("_m").to_pylist(), batch.column("_n").to_pylist()
            yes = pa.array([open_to(bits(p), i, bits(q), j) for p, i, q, j in zip(batch.column("_p"), m, batch.column("_q"), n, strict=True)], pa.bool_())
            return {c: batch.column(c).filter(yes) for c in ("a", "b")}

        return run

    return cut(map_batches(both, "a long, b long", make), "open")


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that have SIMILARITY, by the shingles of their texts."""
    pairs = _open_pairs(pairs, nodes)
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = source.join(nodes.join(ids, "node", "left_semi").select("_a", "_b", "node"), ["_a", "_b"]).dropDuplicates(["node"])
    texts = cut(texts.select("node", "_text"), "texts")
    both = pairs.join(texts.toDF("a", "_a"), "a").join(texts.toDF("b", "_b"), "b").select("a", "b", "_a", "_b")

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            kept: dict[int, np.ndarray] = {}

            def own(node: int, text: pa.StringScalar) -> np.ndarray:
                if node not in kept:
                    if len(kept) > 256:
                        kept.clear()
                    kept[node] = np.unique(shingles(text.as_py(), NEAR_SHINGLE))
                return kept[node]

            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            yes = [similar(own(i, s), own(j, t)) for i, j, s, t in zip(a, b, batch.column("_a"), batch.column("_b"), strict=True)]
            return {"src": [i for i, y in zip(a, yes, strict=True) if y], "dst": [j for j, y in zip(b, yes, strict=True) if y]}

        return run

    return cut(map_batches(both, "src long, dst long", make), "links")


def keep_similar(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of near copies: the one with the smallest doc_id.

    Two texts are linked if their sets of NEAR_SHINGLE-word shingles have a Jaccard similarity of
    SIMILARITY at least; links are transitive. No link is missed: pairs within RADIUS bits of SimHash
    and all pairs that share one of their rarest shingles are candidates, and each is verified on the
    shingles. Rows are known by 128-bit hashes, sets by 64 bits: of n different sets about n * n / 2^65
    pairs count as copies by mistake (1 in 10^9 at 200,000 documents, about 24 at 3 * 10^10). Texts without words are copies of each
    other; null texts count as empty. Rows without a doc_id stay and decide nothing. Of different
    texts with one doc_id each counts for itself.
    """
    source = documents.where("doc_id is not null").select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    sets = cut(_sets(source), "sets")
    nodes = cut(sets.dropDuplicates(["node"]), "nodes")
    size = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 500_000)
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key")).withColumn("at", F.col("at").cast("long"))

    first = cut(_pairs(rows.withColumn("root", F.col("node")), parts, False), "pairs")
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    # Links of equal and of near fingerprints.
    close = link_fingerprints(by_fp.select(F.col("least").alias("node"), "fp")).unionByName(nodes.join(by_fp, "fp").where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")))
    close = close.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    links = _verified(cut(first.where("a is not null").select("a", "b").union(close).distinct(), "pairs"), nodes, source)
    roots = cut(components(links), "roots")

    large = first.where("key is not null").select("key").distinct()
    if not large.isEmpty():
        rest = rows.join(large, "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = cut(_pairs(rest, parts, True).where("a is not null").select("a", "b").distinct(), "pairs")
        if not more.isEmpty():
            roots = cut(components(links.union(_verified(more, nodes, source))), "roots")

    return _least_rows(documents, sets.select("_a", "_b", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
