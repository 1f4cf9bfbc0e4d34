"""Jaccard join of shingle sets by signature trees.

A tree's leaves are sets, each with a bitmap of its shingles; an inner node has the OR of its children's
bitmaps and the range of their sizes. Two trees are walked at once: a pair of nodes is left if no two
sets under them can share enough, by their sizes and the bits that both nodes have, or if all sets under
them are linked already. Pairs of leaves that are left are compared shingle by shingle.

Trees are built where they can find something. Two sets that are LIKE alike share one of their first
shingles in any order. Sets that hold a first shingle in common meet as bitmaps only, in a tree for each
such shingle; pairs of leaves that are left there (and those that these lead to) form a neighbourhood.
Most sets are alone in theirs. A neighbourhood's sets go to one task, each once, where a tree's leaves are
compared in full. A large one is dealt out in parts, and its most typical sets go to every part, so that
dense groups are linked there; then only sets that are not of the largest group are walked against all
other parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators import bloom

from .common import components, cut, map_batches, row_key
from .simhash import frequent_shingles, shingles

SHINGLE = 4
#: Hundredths of the union that linked sets share at least.
LIKE = 85
#: Shingles of the sets in one part; children of a node; most bits of a bitmap.
PART, FANOUT, BITS = 1 << 21, 8, 1 << 14
#: Bytes of a tree's bitmaps, roughly.
MEMORY = 1 << 26
#: Bits of the bitmap that stands for a set by itself: about as many as shingles, up to this.
SIGNATURE = 1 << 14
#: Sets that hold one first shingle and meet as bitmaps; of more, all are one neighbourhood.
CROWD = 20_000
#: Sets that hold one first shingle and are paired at once, where a tree would be hardly more than its
#: leaves; rows of such sets that a task looks at together.
FEW, ROWS = 32, 100_000
#: Typical sets of a neighbourhood that go to all of its parts.
TYPICAL = 16
_EDGES = "src long, dst long"


def least_shared(n: np.ndarray | int):
    """Shingles that a set of n shares at least with any that it is linked to."""
    return -(-LIKE * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LIKE * (len(a) + len(b) - both)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits for each set. The first half of a bitmap or'ed with the second is the one of half as
    many bits."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    rows, values = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    places = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (rows, (places >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (places & np.uint64(63)))
    return out


class Tree:
    """Signature tree over sets of n shingles with bitmaps `leaves`, in their order: levels[0] are these.
    sets has the shingles of each, sorted, if leaves are to be compared in full."""

    def __init__(self, n: np.ndarray, leaves: np.ndarray, sets: list[np.ndarray] | None = None):
        self.sets, self.n = sets, n
        # Shingles that share a bit with another of their set: these a bitmap may hide.
        hidden = self.n - np.bitwise_count(leaves).sum(1, dtype=np.int64)
        self.levels, self.least, self.most, self.hidden = [leaves], [self.n], [self.n], [hidden]
        while len(self.levels[-1]) > 1:
            at = np.arange(0, len(self.levels[-1]), FANOUT)
            self.levels.append(np.bitwise_or.reduceat(self.levels[-1], at, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))
            self.hidden.append(np.maximum.reduceat(self.hidden[-1], at))

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = FANOUT**level
        return node * width, min((node + 1) * width, len(self.n))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1])))


def may_link(s: Tree, t: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether any sets under nodes i of s and j of t can be linked, by sizes and bitmaps."""
    small, large = np.maximum(s.least[level][i], t.least[level][j]), np.minimum(s.most[level][i], t.most[level][j])
    # Both are at least as large as the larger least size, and share that much of it.
    ok = (100 * s.most[level][i] >= LIKE * t.least[level][j]) & (100 * t.most[level][j] >= LIKE * s.least[level][i])
    shared = np.bitwise_count(s.levels[level][i] & t.levels[level][j]).sum(-1, dtype=np.int64) + np.minimum(s.hidden[level][i], t.hidden[level][j])
    if level:
        return ok & (np.minimum(shared, large) >= least_shared(small))
    return ok & ((100 + LIKE) * shared >= LIKE * (s.n[i] + t.n[j]))


class Groups:
    """Labels of sets: equal for sets that are known to be connected."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]

    def one(self, *spans: tuple[int, int]) -> bool:
        first = self.of[spans[0][0]]
        return all(bool((self.of[a:b] == first).all()) for a, b in spans)


def walk(s: Tree, t: Tree, groups: Groups, at: int, shift: int) -> list[tuple[int, int]]:
    """Pairs (set of s, set of t) that connect what links between the trees connect, given what groups
    are connected already. In groups the sets of s begin at `at`, those of t at `shift`. s and t may be
    one tree. Without sets, leaves are taken for linked if their bitmaps are left."""
    found, top = [], max(len(s.levels), len(t.levels)) - 1
    same = s is t

    def up(tree: Tree) -> None:
        while len(tree.levels) <= top:
            for rows in (tree.levels, tree.least, tree.most, tree.hidden):
                rows.append(rows[-1])

    up(s)
    up(t)
    zero = np.zeros(1, np.int64)
    stack = [(top, 0, 0)] if may_link(s, t, top, zero, zero)[0] else []
    while stack:
        level, a, b = stack.pop()
        sa, sb = s.span(level, a), t.span(level, b)
        if groups.one((sa[0] + at, sa[1] + at), (sb[0] + shift, sb[1] + shift)):
            continue
        if level == 0:
            if not (same and a == b) and (s.sets is None or linked(s.sets[a], t.sets[b])):
                found.append((a, b))
                groups.join(a + at, b + shift)
            continue
        i, j = (x.ravel() for x in np.meshgrid(s.children(level, a), t.children(level, b), indexing="ij"))
        if same and a == b:
            i, j = i[i <= j], j[i <= j]
        kept = may_link(s, t, level - 1, i, j)
        i, j = i[kept], j[kept]
        # Last in, first out: a node with itself before it meets others, and neighbours before distant ones.
        order = np.argsort(-np.abs(i - j), kind="stable")
        stack += [(level - 1, int(x), int(y)) for x, y in zip(i[order], j[order], strict=True)]
    return found


def bits_for(sets: list[np.ndarray]) -> int:
    """Bits of a bitmap: four times the largest set, but no more than MEMORY for all of them. Sets that
    fill their bitmap are pruned less, and found all the same."""
    bits = min(4 * max(len(s) for s in sets), 8 * MEMORY // len(sets))
    return min(BITS, max(64, 1 << int(bits).bit_length()))


def link_sets(nodes: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the nodes as all links among sets of side 0 do, and all between sets of sides 1
    and 2. Sets with equal roots are connected already."""
    # Sets whose least shingles agree are likely to be alike and share a node of the tree.
    order = sorted(range(len(sets)), key=lambda k: (sides[k], int(sets[k][0]), len(sets[k])))
    nodes, sets, sides = nodes[order], [sets[k] for k in order], sides[order]
    groups, bits, edges = Groups(roots[order]), bits_for(sets), []
    a, b = np.searchsorted(sides, [1, 2]).tolist()
    tree = lambda x: Tree(np.array([len(s) for s in x], np.int64), bitmaps(x, bits), x)
    if a > 1:
        own = tree(sets[:a])
        edges += walk(own, own, groups, 0, 0)
    if a < b < len(sets):
        edges += [(i + a, j + b) for i, j in walk(tree(sets[a:b]), tree(sets[b:]), groups, a, b)]
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def signature_bits(n: int) -> int:
    return min(SIGNATURE, max(64, 1 << int(n - 1).bit_length()))


def link_bitmaps(nodes: np.ndarray, n: np.ndarray, signatures: list[bytes]) -> list[tuple[int, int]]:
    """Edges that connect the nodes as all pairs do whose bitmaps leave open that they are linked. Linked
    sets' bitmaps are of one length or of one and its double."""
    order = np.lexsort((nodes, n))
    nodes, n, signatures = nodes[order], n[order], [signatures[k] for k in order]
    lengths = np.array([len(x) for x in signatures])
    groups, edges, before = Groups(np.arange(len(nodes))), [], None
    for length in np.unique(lengths).tolist():
        a, b = np.searchsorted(lengths, [length, length + 1]).tolist()
        leaves = np.frombuffer(b"".join(signatures[a:b]), np.uint64).reshape(b - a, -1)
        tree = Tree(n[a:b], leaves)
        edges += [(i + a, j + a) for i, j in walk(tree, tree, groups, a, a)]
        if before and before[2] * 2 == length:
            half = leaves.shape[1] // 2
            edges += [(i + before[0], j + a) for i, j in walk(before[1], Tree(n[a:b], leaves[:, :half] | leaves[:, half:]), groups, before[0], a)]
        before = (a, tree, length)
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def open_pairs(n: np.ndarray, signatures: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bitmaps of sets i and j, in order of n, leave open that they are linked."""
    lengths = np.array([len(x) // 8 for x in signatures], np.int64)
    row, bits = np.zeros(len(n), np.int64), {}
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        row[at] = np.arange(len(at))
        bits[length] = np.frombuffer(b"".join([signatures[k] for k in at.tolist()]), np.uint64).reshape(len(at), length)
    out = np.zeros(len(i), bool)
    for length, a in bits.items():
        for other in (length, 2 * length):
            if other not in bits:
                continue
            those = np.flatnonzero((lengths[i] == length) & (lengths[j] == other))
            for k in range(0, len(those), 50_000):
                at = those[k : k + 50_000]
                x, y = a[row[i[at]]], bits[other][row[j[at]]]
                if other != length:
                    y = y[:, :length] | y[:, length:]
                small, large = n[i[at]], n[j[at]]
                hidden = np.minimum(small - np.bitwise_count(x).sum(1, dtype=np.int64), large - np.bitwise_count(y).sum(1, dtype=np.int64))
                shared = np.bitwise_count(x & y).sum(1, dtype=np.int64) + hidden
                out[at] = (100 + LIKE) * shared >= LIKE * (small + large)
    return out


def link_rows(key: np.ndarray, node: np.ndarray, n: np.ndarray, signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the nodes of every key as all pairs do that their bitmaps leave open."""
    order = np.lexsort((node, n, key))
    key, node, n = key[order], node[order], n[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    sizes = np.diff(starts)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts[:-1][sizes > FEW].tolist(), starts[1:][sizes > FEW].tolist(), strict=True):
        edges = np.array(link_bitmaps(node[a:b], n[a:b], [signatures[k] for k in order[a:b].tolist()]), np.int64).reshape(-1, 2)
        src.append(edges[:, 0])
        dst.append(edges[:, 1])
    # All others at once: each set with the next ones of its key, equal pairs once.
    left, pairs = np.flatnonzero(np.repeat(sizes <= FEW, sizes)), [np.zeros((0, 2), np.int64)]
    different, at = np.unique(node, return_index=True)
    number = np.searchsorted(different, node)
    for d in range(1, FEW):
        left = left[left < len(key) - d]
        left = left[(key[left] == key[left + d]) & (100 * n[left] >= LIKE * n[left + d])]
        if not len(left):
            break
        pairs.append(np.stack([number[left], number[left + d]], 1))
    i, j = np.unique(np.concatenate(pairs), axis=0).T
    n, signatures = n[at], [signatures[k] for k in order[at].tolist()]
    ok = open_pairs(n, signatures, np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i))
    return np.concatenate([*src, different[i[ok]]]), np.concatenate([*dst, different[j[ok]]])


def shingle_sets(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _a, _b (128 bits of the row), _s, _t (128 bits of the set), n, first (its first shingles in
    a fixed order, so many that linked sets share one), signature (its bitmap) per row of documents."""
    source = documents.select("doc_id", *row_key(F.col("doc_id"), F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shared = source.sparkSession.sparkContext.broadcast(frequent_shingles(source, SHINGLE, once=True)[0])

    def make():
        last = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"_s": [], "_t": [], "n": [], "first": [], "signature": []}
            for t in batch.column("_text"):
                own = np.unique(shingles(t.as_py(), SHINGLE))
                late = np.zeros(len(own), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                key = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                out["_s"].append(int(key[0]))
                out["_t"].append(int(key[1]))
                out["n"].append(len(own))
                out["signature"].append(bitmaps([own], signature_bits(len(own))).tobytes() if len(own) else b"")
                out["first"].append(own[np.argsort(late, kind="stable")][: len(own) - least_shared(len(own)) + 1 if len(own) else 0].view(np.int64))
            return {c: batch.column(c) for c in ("doc_id", "_a", "_b")} | out | {"first": pa.array(out["first"], pa.list_(pa.int64()))}

        return run

    return map_batches(source, f"doc_id {dict(source.dtypes)['doc_id']}, _a long, _b long, _s long, _t long, n long, first array<long>, signature binary", make)


def neighbourhoods(nodes: DataFrame) -> DataFrame:
    """node, around (the neighbourhood), n, typical (the share of a node's first shingles that others
    have) of nodes (node, n, first, signature) that are not alone."""
    rows = nodes.select("node", F.explode("first").alias("key"))
    # Summed before they are dealt out: a hot shingle is one row of each task.
    keys = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("_most"), F.count("*").alias("m")).where("least < _most").drop("_most")
    held = cut(rows.join(keys, "key").select("node", "key", "least", "m"), "held")
    edges = held.where(F.col("m") > CROWD).select(F.col("node").alias("src"), F.col("least").alias("dst"))
    few = held.where(F.col("m") <= CROWD).join(nodes.select("node", "n", "signature"), "node").select("key", "node", "n", "signature")

    def run(batches):
        rest: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            key, node, n = (table.column(c).to_numpy() for c in ("key", "node", "n"))
            return pa.RecordBatch.from_arrays(list(map(pa.array, link_rows(key, node, n, table.column("signature").to_pylist()))), ["src", "dst"])

        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= ROWS:
                table = pa.Table.from_batches(rest)
                key = table.column("key").to_numpy()
                # Rows come by key; those of the last one may go on.
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield done(table.slice(0, end))
                rest = table.slice(end).to_batches()
        if rest:
            yield done(pa.Table.from_batches(rest))

    near = few.repartition("key").sortWithinPartitions("key").mapInArrow(run, _EDGES)
    roots = cut(components(edges.unionByName(near).distinct()), "around")
    share = held.groupBy("node").agg(F.count("*").alias("_keys"))
    sized = nodes.select("node", "n", F.size("first").alias("_first"))
    return cut(sized.join(share, "node").join(roots, "node").select("node", F.col("root").alias("around"), "n", (F.col("_keys") / F.col("_first")).alias("typical")), "near")


def _walked(rows: DataFrame) -> DataFrame:
    """Edges within the units of rows (unit, node, side, root, _text)."""
    rows = rows.repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        unit, held = None, []

        def done() -> pa.RecordBatch:
            nodes, sides, roots = (np.array([r[k] for r in held], np.int64) for k in range(3))
            edges = link_sets(nodes, [r[3] for r in held], roots, sides) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], ["src", "dst"])

        for batch in batches:
            for u, *r, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "side", "root")), batch.column("_text"), strict=True):
                if u != unit and held:
                    yield done()
                    held = []
                unit = u
                held.append((r[0], r[1], r[2], np.unique(shingles(text.as_py(), SHINGLE))))
        if held:
            yield done()

    return rows.select("unit", "node", "side", "root", "_text").mapInArrow(run, _EDGES)


def link_nodes(near: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root of connected nodes. near: see neighbourhoods; texts: each node's text, once."""
    sizes = cut(near.groupBy("around").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"), F.count("*").alias("_m")).where("_m > 1").drop("_m"), "sizes")
    near = near.join(sizes, "around").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Every set goes to one part of its neighbourhood, typical ones of large neighbourhoods to all.
    everywhere = typical(near.where("parts > 1")).select("node", "around", "_own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part")).where("_part <> _own")
    rows = near.select("node", "around", F.col("_own").alias("_part")).unionByName(everywhere.drop("_own"))
    rows = rows.select(F.xxhash64("around", "_part").alias("unit"), "node", F.col("node").alias("root"), F.lit(0).alias("side"))
    edges = cut(_walked(rows.join(texts, "node")), "edges")
    roots = cut(components(edges), "roots")
    large = near.where("parts > 1").select("around", "node", "n")
    return roots if large.isEmpty() else _across(large, edges, roots, texts)


def typical(near: DataFrame) -> DataFrame:
    """The TYPICAL rows of each neighbourhood with the largest share of shingles that others have."""
    row = F.struct("typical", "node", "_own", "parts")
    # The best of each of 4096 slices first, so that no neighbourhood is sorted in a task.
    best = near.groupBy("around", F.pmod(F.xxhash64(F.lit("slice"), "node"), F.lit(4096)).alias("_slice")).agg(F.max(row).alias("c"))
    best = best.groupBy("around").agg(F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, TYPICAL).alias("c"))
    return best.select("around", F.explode("c").alias("c")).select("c.node", "around", "c.parts", "c._own")


def _across(near: DataFrame, edges: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """roots after the parts of large neighbourhoods have been walked against each other. Of the
    largest connected group in each, sets meet only those outside it."""
    now = cut(near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "now")
    largest = now.groupBy("around", "root").agg(F.sum("n").alias("_n")).groupBy("around").agg(F.max_by("root", F.struct("_n", "root")).alias("_largest"))
    now = now.join(largest, "around").withColumn("mass", F.col("root") == F.col("_largest"))
    half = lambda mass: F.ceil(F.sum(F.when(F.col("mass") == mass, F.col("n")).otherwise(0)) * 2 / PART).cast("int")
    counts = now.groupBy("around").agg(half(False).alias("p"), half(True).alias("q")).where("p > 0")
    now = cut(now.join(counts, "around").select("around", "node", "root", "mass", "p", "q", F.pmod(F.xxhash64(F.lit("part"), "node"), F.when(F.col("mass"), F.col("q")).otherwise(F.col("p"))).cast("int").alias("_i")), "parts")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    unit = lambda kind, a, b: F.xxhash64(F.lit(kind), "around", a, b).alias("unit")
    others, mass = now.where("not mass"), now.where("mass")
    # Parts of the others meet each other, and all parts of the group.
    pairs = others.select("around", "node", "root", "_i", F.explode(upto("p")).alias("_j")).select(unit("o", F.least("_i", "_j"), F.greatest("_i", "_j")), "node", "root", F.lit(0).alias("side"))
    left = others.select("around", "node", "root", "_i", F.explode(upto("q")).alias("_j")).select(unit("m", F.col("_i"), F.col("_j")), "node", "root", F.lit(1).alias("side"))
    right = mass.select("around", "node", "root", "_i", F.explode(upto("p")).alias("_j")).select(unit("m", F.col("_j"), F.col("_i")), "node", "root", F.lit(2).alias("side"))
    more = cut(_walked(pairs.unionByName(left).unionByName(right).join(texts, "node")), "more")
    return roots if more.isEmpty() else cut(components(edges.union(more)), "roots")


def jaccard_components(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of documents.

    A set is the different SHINGLE-word shingles of a text (its words, if there are fewer), known by 64
    bits each; component_id is the smallest doc_id that links lead to. Texts without words, and null
    ones, have empty sets and are linked with nothing: their component is their own doc_id. Repeated
    rows each give a row. Of different texts with one doc_id each counts for itself. Rows without a
    doc_id take part and have a null component if no row with one is reached. doc_id is a number; other
    columns are ignored.
    """
    rows = cut(shingle_sets(documents, text), "sets")
    own = F.col("doc_id").cast("long")
    # A set is known by one of its rows; numbers are written once, so that they stay.
    nodes = rows.where("n > 0").groupBy("_s", "_t").agg(F.min(own).alias("least"), F.min(F.struct("_a", "_b")).alias("_row"), F.first("n").alias("n"))
    nodes = cut(nodes.select("*", "_row._a", "_row._b", F.monotonically_increasing_id().alias("node")).drop("_row"), "nodes")
    own_row = nodes.select("_a", "_b", "node", "n")
    near = neighbourhoods(cut(rows.select("_a", "_b", "first", "signature").join(own_row, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("node", "n", "first", "signature"), "first"))
    wanted = cut(own_row.select("_a", "_b", "node").join(near.select("node"), "node", "left_semi"), "wanted")
    texts = documents.select(*row_key(F.col("doc_id"), F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Most texts are alone: a filter keeps them from being dealt out.
    texts = cut(bloom.narrowed_join(texts, wanted, ["_a", "_b"]).dropDuplicates(["_a", "_b"]).select("node", "_text"), "texts")
    roots = link_nodes(near, texts)
    at = nodes.select("_s", "_t", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = at.groupBy("root").agg(F.min("least").alias("component_id"))
    found = at.join(least, "root").select("_s", "_t", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "_s", "_t").join(found, ["_s", "_t"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")))
