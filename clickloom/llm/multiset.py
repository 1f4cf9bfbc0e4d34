"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

Every paragraph hashes to a wide vector; a text's fingerprint is the sum of its paragraphs' vectors,
each coordinate modulo a power of two. Order does not matter, and a paragraph is added or removed
by adding or subtracting its vector. The vector has one coordinate that counts paragraphs, 128 that
count set bits of two hashes (modulo 2^24) and 4 that sum halves of those hashes (modulo 2^32). The
bit counts are also sums of +1/-1 projections, whose distances estimate how many paragraphs two
texts share.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two hashes of 64 bits; coordinates i and i + 32 of a hash are counted in one long.
HASHES = 2
LANE = 32
#: Documents in one range of ids, about, and most ranges: beyond them ranges grow, and their sort spills.
RANGE_ROWS, RANGES = 20_000, 20_000


def paragraphs(text: Column) -> Column:
    """Lines, cut again into sentences after ". ", "! " and "? "; empty ones are left out."""
    return F.filter(F.split(text, r"\n+|(?<=[.!?]) +"), lambda p: F.length(p) > 0)


def _hashes(units: Column, i: int) -> Column:
    return F.transform(units, lambda p: F.xxhash64(F.concat(F.lit(f"{i}:"), p)))


def vector(text: Column) -> Column:
    """The fingerprint as array<long>: [n, 128 bit counts, 4 sums]; an empty text gives zeros."""
    units = paragraphs(F.coalesce(text, F.lit("")))
    return F.transform(
        F.array(units),
        lambda u: F.flatten(
            F.transform(
                F.array(*[_hashes(u, i) for i in range(HASHES)]),
                # A long counts two bits of each hash, 32 places apart: one pass over the hashes
                # for each pair of coordinates. Counts stay below 2^31, as arrays do.
                lambda h: F.flatten(
                    F.array(
                        F.array(F.size(h).cast("long")),
                        F.flatten(
                            F.transform(
                                F.transform(
                                    F.sequence(F.lit(0), F.lit(LANE - 1)),
                                    lambda b: F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(0x0000000100000001))),
                                ),
                                lambda s: F.array(s.bitwiseAND(F.lit(0xFFFFFF)), F.shiftrightunsigned(s, 32).bitwiseAND(F.lit(0xFFFFFF))),
                            )
                        ),
                        F.array(
                            F.aggregate(h, F.lit(0).cast("long"), lambda s, x: (s + x.bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))),
                            F.aggregate(h, F.lit(0).cast("long"), lambda s, x: (s + F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0xFFFFFFFF))),
                        ),
                    )
                ),
            )
        ),
    )[0]


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two texts' paragraphs together (sign 1), or of a's without b's (sign -1)."""
    width = 2 * LANE + 3
    return F.transform(
        F.arrays_zip(a.alias("a"), b.alias("b"), F.sequence(F.lit(0), F.size(a) - 1).alias("i")),
        lambda x: (x["a"] + sign * x["b"]).bitwiseAND(F.when(F.pmod(x["i"], F.lit(width)).between(1, 2 * LANE), F.lit(0xFFFFFF)).otherwise(F.lit(0xFFFFFFFF))),
    )


def written(v: Column) -> Column:
    """A fingerprint as a string, from which read_back() gives the vector: 8 hex digits a coordinate,
    so that strings can be added, subtracted and compared like the vectors."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def read_back(fingerprint: Column) -> Column:
    """The vector of a fingerprint string."""
    n = F.floor(F.length(fingerprint) / 8).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs that two texts have in common, as their vectors tell it: 1 minus the
    squared distance of the projections over the sum of their squared lengths, at 0 at least."""
    width = 2 * LANE + 3
    pairs = F.filter(
        F.arrays_zip(a.alias("a"), b.alias("b"), F.sequence(F.lit(0), F.size(a) - 1).alias("i")),
        lambda x: F.pmod(x["i"], F.lit(width)).between(1, 2 * LANE),
    )
    na, nb = a[0], b[0]

    def square(f) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.pow(f(2 * x["a"] - na, 2 * x["b"] - nb).cast("double"), F.lit(2.0)))

    apart = square(lambda x, y: x - y)
    total = square(lambda x, y: x) + square(lambda x, y: y)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / total))


def with_next(documents: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with its `derived` columns and struct _next: the given columns, derived ones too, of the
    row after it in descending doc_id (the first row's for the last).

    Rows are dealt into ranges of doc_id (a number), each ordered by itself; the first row of every
    range is also put behind the range before. Ties in doc_id go by the other columns. Derived columns
    are made once for each row, not again for the rows that are put behind a range.
    """
    derived = derived or {}
    ids = documents.select(F.col("doc_id").cast("double").alias("_id"))
    n = ids.count()
    parts = min(max(64, -(-n // RANGE_ROWS)), RANGES)
    bounds = ids.dropna().approxQuantile("_id", [i / parts for i in range(1, parts)], 0.2 / parts) if n else []
    splits = [float("-inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")
    # Ascending range numbers in descending ids; rows without an id come last.
    rows = cut.transform(documents.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(len(splits) - 2 - F.col("_range")).cast("int")).drop("_id")

    plain = [c for c in columns if c not in derived]
    order = [F.col("doc_id").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in plain if c != "doc_id"]]
    # At most one row for each range, so RANGES + 2 rows: few enough for one task and every executor.
    turn = Window.orderBy("_range")
    firsts = rows.groupBy("_range").agg(F.max("doc_id").alias("_first"))
    firsts = firsts.select("_range", "_first", F.coalesce(F.lag("_range").over(turn), F.max("_range").over(Window.partitionBy())).alias("_before"))
    heads = rows.join(F.broadcast(firsts), (rows["_range"] == firsts["_range"]) & rows["doc_id"].eqNullSafe(firsts["_first"])).select(F.col("_before").alias("_range"), *[rows[c] for c in documents.columns], F.lit(True).alias("_extra"))
    rows = rows.select("_range", *documents.columns, F.lit(False).alias("_extra"))
    # One of several rows with the first id: the one that the order puts first.
    heads = heads.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where("_k = 1").drop("_k")
    both = rows.unionByName(heads).withColumns(derived)
    w = Window.partitionBy("_range").orderBy(F.col("_extra"), *order)
    return both.withColumn("_next", F.lead(F.struct(*columns)).over(w)).where(~F.col("_extra")).drop("_extra", "_range")


def fingerprint_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    Fingerprints are vectors as strings (see written); near_* compare these very vectors. Over texts
    that share a share s of their paragraphs they are s give or take 0.09 (one standard deviation of
    128 projections); tests hold the mean error to 0.06.

    The edited text keeps a text's first part and takes as many code points as its second half has
    (rounded down) from the start of the next document, or all it has. A null text counts as empty;
    rows without a doc_id come after all others; repeated rows each give a row. Other columns are
    ignored. A single document is its own next one. An empty table gives no rows.
    """
    docs = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(docs, ["doc_id", "_text", "_v"], {"_v": vector(F.col("_text"))})
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "_v", F.col("_next._v").alias("_w"), edited.alias("_edited"))
    rows = rows.select("doc_id", "n_chars", "_v", "_w", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), vector(F.col("_edited")).alias("_e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("_v")).alias("fingerprint"), written(F.col("_e")).alias("edited_fingerprint"), likeness(F.col("_v"), F.col("_e")).alias("near_edited"), likeness(F.col("_v"), F.col("_w")).alias("near_next")
    )
