"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers vote good, junk, neither, or cannot tell, on every document. Votes are counted by
pattern over all documents; EM over the patterns estimates how each labeller votes on good documents
and on junk, and so what share of each pattern is junk. It starts from the majority vote; nothing else
is given. The posteriors of a bounded sample of documents are the labels of a logistic scorer over
hashed word features, which then scores every document. Toxicity has labellers of its own, and, if a
table of human labels is given, a scorer fitted on a bounded sample of these.
"""

from __future__ import annotations


import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, map_batches, map_kept, place_of, quoted, together

#: Most documents that each scorer is fitted on.
SAMPLE = 4000
#: Buckets of the quality scorer (word shapes; the last is for words said twice in a row) and of the
#: toxicity scorer (word beginnings).
SHAPE_BUCKETS, STEM_BUCKETS = 1024, 8192
STEM_BYTES = 6
#: Longer words are cut into pieces of so many bytes.
PIECE = 64
CACHE_WORDS = 200_000

Vector = tuple[np.ndarray, np.ndarray]

# Plain insults, in two groups that vote apart.
INSULTS = (frozenset("idiot moron stupid clown loser dumb fool".split()), frozenset("trash pathetic worthless disgusting scum vile garbage".split()))

_DROP = bytes(range(48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))
_SYMBOLS = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()-"))
_UPPER, _LOWER, _NUMERALS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SENTENCE = re.compile(rb"[.!?\n]+")
# Small words of English, German, French and Spanish.
SMALL_WORDS = frozenset(
    "a al an and are as at au auf be by das dans de del dem den der des des die du ein eine el en es est et for from für he il im in is ist it la las le les lo los mit nicht no o of on or par pas por pour qu que qui se sich su sur that the this to und un una une von was with y you zu".encode().split()
)

QUALITY = ("symbols", "capitals", "stutter", "variety", "repeats", "small_words", "sentences", "word_length", "numerals")
TOXIC = ("insults_a", "insults_b", "insult_density")
#: A vote for good (clean), for junk (toxic), for neither, and none for want of text.
FOR, AGAINST, NEITHER, UNABLE = 1, -1, 0, 2


def _either(x: float, good: float, junk: float) -> int:
    """FOR beyond `good`, AGAINST beyond `junk`, on whichever side of each other they lie."""
    return (FOR if x >= good else AGAINST if x < junk else NEITHER) if good > junk else (FOR if x <= good else AGAINST if x > junk else NEITHER)


def votes(text: str) -> tuple[list[int], list[int]]:
    """One vote of each of QUALITY and of TOXIC. Labellers that know one kind of junk never vote for a
    document; those that look at the shape of prose vote both ways, and may contradict each other."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    junk = lambda found: AGAINST if found else NEITHER
    out = dict.fromkeys(QUALITY, UNABLE)
    if n >= 3 or size > 200:
        upper, lower = share(_UPPER), share(_LOWER)
        out["symbols"] = junk(share(_SYMBOLS) > 0.03)
        out["capitals"] = junk(upper > 0.25 * (upper + lower) > 0)
        out["numerals"] = junk(share(_NUMERALS) > 0.3)
    if n >= 3:
        out["stutter"] = junk(sum(map(bytes.__eq__, words[1:], words)) / n > 0.1)
        out["word_length"] = junk(not 3 <= (size - n) / n <= 8)
    if n >= 8:
        out["small_words"] = _either(sum(map(SMALL_WORDS.__contains__, raw.lower().split())) / n, 0.15, 0.1)
        parts = [x for x in _SENTENCE.split(raw) if x.strip()]
        if len(parts) >= 3:
            out["repeats"] = junk(1 - len(set(parts)) / len(parts) > 0.2)
        mean = n / max(1, len(parts))
        out["sentences"] = FOR if 4 <= mean <= 40 else AGAINST if mean < 3 or mean > 60 else NEITHER
    if n >= 20:
        # Variety falls with length, so it is taken over stretches.
        out["variety"] = _either(sum(len(set(words[i : i + 500])) for i in range(0, n, 500)) / n, 0.45, 0.35)
    return list(out.values()), _insulted(raw, n)


def _insulted(raw: bytes, n: int) -> list[int]:
    """Both groups of insults and their density; words are compared whole, without case or signs.
    The density needs two words at least: of one its group has said all there is."""
    low = raw.lower()
    hits = [0, 0]
    for g, group in enumerate(INSULTS):
        if any(w.encode() in low for w in group):
            hits[g] = sum(w.translate(None, _DROP).decode("utf-8", "ignore") in group for w in low.split())
    total = sum(hits)
    return [-1 if hits[0] else 1, -1 if hits[1] else 1, -1 if total > max(1, n // 1000) else 0 if total else 1]


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """(share of the second class in each vote pattern, accuracies, share of the second class), by EM.

    patterns: rows of votes; counts: documents with each. A labeller has, for each class, a chance of
    each vote that it is able to give; all are estimated, from the share of votes against a document as
    the first guess. A labeller's accuracy is the share of its votes that its estimated class agrees
    with, of those that are for or against. Each chance has half a vote added.
    """
    n, cast = counts.sum(), (patterns == FOR) | (patterns == AGAINST)
    if not n:
        return np.zeros(0), np.full(patterns.shape[1] if patterns.ndim > 1 else 0, np.nan), 0.0
    against = (patterns == AGAINST).sum(1)
    # Neither for nor against says a little for a document.
    p = np.where(cast.any(1), np.clip(against / np.maximum(cast.sum(1), 1), 0.02, 0.98), 0.1)
    one = np.stack([patterns == v for v in (FOR, NEITHER, AGAINST)], 2).astype(float)
    share = 0.0
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts], 1)
        classes = (weight.sum(0) + 1) / (n + 2)
        chance = np.einsum("nk,nmv->kmv", weight, one) + 0.5
        chance /= chance.sum(2, keepdims=True)
        like = np.log(classes)[:, None] + np.einsum("nmv,kmv->kn", one, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        share, done = float(classes[1]), np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    right = ((patterns == AGAINST) * p[:, None] + (patterns == FOR) * (1 - p)[:, None]) * counts[:, None]
    given = (cast * counts[:, None]).sum(0)
    return p, np.where(given, right.sum(0) / np.maximum(given, 1), np.nan), share


class Features:
    """Hashed features of a text, as (buckets, values of length 1): word shapes, word beginnings."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.shapes: list[int] = []
        self.stems: list[int] = []

    def code(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text]
        shape = "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])
        stem = text.lower().strip(".,;:!?#$%&*|\"'()").encode("utf-8", "replace")[:STEM_BYTES]
        self.shapes.append(xxhash.xxh32_intdigest(shape.encode("utf-8", "replace")) % (SHAPE_BUCKETS - 1))
        self.stems.append(xxhash.xxh32_intdigest(stem) % STEM_BUCKETS)
        self.codes[word] = got = len(self.shapes) - 1
        return got

    def __call__(self, text: str) -> tuple[Vector, Vector]:
        words = text.encode("utf-8", "surrogatepass").split()
        if max(map(len, words), default=0) > PIECE:  # scripts without spaces, junk: all of it counts
            words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
        shapes, stems = np.zeros(SHAPE_BUCKETS), np.zeros(STEM_BUCKETS)
        for i in range(0, len(words), CACHE_WORDS // 4):
            part = words[i : i + CACHE_WORDS // 4]
            if len(self.codes) + len(part) >= CACHE_WORDS:
                self.__init__()
            get, code = self.codes.get, self.code
            codes = [c if (c := get(w)) is not None else code(w) for w in part]
            shapes += np.bincount([self.shapes[c] for c in codes], minlength=SHAPE_BUCKETS)
            stems += np.bincount([self.stems[c] for c in codes], minlength=STEM_BUCKETS)
        shapes[-1] = sum(map(bytes.__eq__, words[1:], words))
        return unit(shapes), unit(stems)


def unit(counts: np.ndarray) -> Vector:
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / max(np.sqrt((values**2).sum()), 1e-9)


def fit_scorer(rows: list[Vector], labels: np.ndarray, buckets: int, steps: int = 300, balanced: bool = True) -> np.ndarray:
    """Logistic weights (the last is the intercept) for the share of the second class in each label;
    both classes weigh the same in total, or, if not balanced, all rows."""
    w = np.zeros(buckets + 1)
    if not len(rows):
        return w
    sizes = np.array([len(at) for at, _ in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.concatenate([np.asarray(a, np.int64) for a, _ in rows])
    values = np.concatenate([np.asarray(v, float) for _, v in rows])
    second = max(labels.sum(), 1e-3)
    weight = np.where(labels > 0.5, 0.5 / second, 0.5 / max(len(labels) - second, 1e-3))
    if not balanced:
        weight = np.full(len(labels), 1 / len(labels))
    m = np.zeros(buckets + 1)
    for _ in range(steps):
        x = np.bincount(row, w[at] * values, len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels) * weight
        m *= 0.9
        m[:-1] += np.bincount(at, g[row] * values, buckets) + 1e-4 * w[:-1]
        m[-1] += g.sum()
        w -= 2.0 * m
    return w


def score(w: np.ndarray, x: Vector) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[x[0]] @ x[1] + w[-1], -30, 30))))


def _written(v: list[int]) -> str:
    return "".join("0+.-"[i] for i in v)


def _posterior(model: dict[str, float], text: str) -> float:
    """The label model's share of toxic texts among those with this one's votes."""
    raw = text.encode("utf-8", "surrogatepass")
    return model.get(_written(_insulted(raw, len(raw.split()))), 0.0)


def count_votes(source: DataFrame) -> DataFrame:
    """quality, toxic, n: patterns of votes on _text, and the rows with each. At most 4^9 * 3^3 rows,
    however many documents there are."""

    def voting():
        def run(batch: pa.RecordBatch) -> dict:
            # Each pattern of a batch goes out once.
            seen: dict[tuple[str, str], int] = {}
            for t in batch.column("_text"):
                key = tuple(map(_written, votes(t.as_py())))
                seen[key] = seen.get(key, 0) + 1
            return {"quality": [k[0] for k in seen], "toxic": [k[1] for k in seen], "n": list(seen.values())}

        return run

    return map_batches(source.select("_text"), "quality string, toxic string, n long", voting).groupBy("quality", "toxic").agg(F.sum("n").alias("n"))


class LabelModel:
    """What EM finds from a table of vote patterns: posterior by pattern, accuracy by labeller, share."""

    def __init__(self, counted: list, column: str, labellers: tuple[str, ...]):
        sums: dict[str, int] = {}
        for r in counted:
            sums[r[column]] = sums.get(r[column], 0) + r["n"]
        names = sorted(sums)
        votes_ = np.array([[{"+": FOR, "0": NEITHER, "-": AGAINST, ".": UNABLE}[c] for c in x] for x in names]).reshape(len(names), len(labellers))
        p, accuracy, self.share = fit_label_model(votes_, np.array([sums[x] for x in names], float))
        self.posterior = dict(zip(names, map(float, p), strict=True))
        self.accuracy = dict(zip(labellers, map(float, accuracy), strict=False))
        self.votes = dict(zip(labellers, ((votes_ == FOR) | (votes_ == AGAINST)).T @ np.array([sums[x] for x in names], float) if names else np.zeros(len(labellers)), strict=True))


def labeller_accuracies(documents: DataFrame, text: str = "text") -> DataFrame:
    """labeller, kind (quality, toxic), votes (for or against, over all documents), accuracy, share (of
    junk or toxic documents), as the label model estimates them; accuracy is null without a vote."""
    spark = documents.sparkSession
    counted = count_votes(documents.select(F.coalesce(quoted(text), F.lit("")).alias("_text"))).collect()
    rows = []
    for kind, names in (("quality", QUALITY), ("toxic", TOXIC)):
        m = LabelModel(counted, kind, names)
        rows += [(n, kind, int(m.votes[n]), None if m.votes[n] == 0 else m.accuracy[n], m.share) for n in names]
    return spark.createDataFrame(rows, "labeller string, kind string, votes long, accuracy double, share double")


def _sampled(rows: DataFrame, n: int, size: int, by: list[str]) -> DataFrame:
    """At most `size` of n rows, those with the smallest hashes, without sorting all rows."""
    width = 1 << 40
    h = F.pmod(F.xxhash64(*by), F.lit(width))
    return rows.withColumn("_h", h).where(F.col("_h") < min(width, 2 * size * width // max(n, 1) + 1)).orderBy("_h", *by).limit(size).drop("_h")


def _both(scored: float, p: float) -> Vector:
    """The fitted scorer's log-odds and the label model's share, of like size, as features."""
    odds = np.log(np.clip(scored, 0.002, 0.998) / np.clip(1 - scored, 0.002, 0.998))
    return np.array([0, 1]), np.array([odds / 4, p])


def fit_toxic(rows: list[Vector], model: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of the scorer, and of it and the label model's shares together: these are fitted on
    rows that the scorer of the other half has not seen. None with under two rows of a class."""
    order = np.argsort(labels, kind="stable")
    half = np.zeros(len(labels), int)
    half[order] = np.arange(len(labels)) % 2
    if min((labels > 0.5).sum(), (labels < 0.5).sum()) < 2:
        return None
    pick = lambda h: [rows[i] for i in np.flatnonzero(half == h)]
    others = [fit_scorer(pick(1 - h), labels[half == 1 - h], STEM_BUCKETS) for h in (0, 1)]
    joint = [_both(score(others[h], x), p) for x, p, h in zip(rows, model, half, strict=True)]
    return fit_scorer(rows, labels, STEM_BUCKETS), fit_scorer(joint, labels, 2, 2000, balanced=False)


def _toxic_weights(source: DataFrame, labels: DataFrame, sample: int, model: dict[str, float]) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of the toxicity scorer, from at most `sample` labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("_y"))
    known = _sampled(known, known.count(), sample, ["doc_id"])
    # At most `sample` ids; of rows with the same id one is taken.
    rows = source.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("_text", "_y")

    def featuring():
        features = Features()

        def run(batch: pa.RecordBatch) -> dict:
            texts = [t.as_py() for t in batch.column("_text")]
            got = [features(t)[1] for t in texts]
            return {"y": batch.column("_y"), "p": [_posterior(model, t) for t in texts], "at": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), "values": pa.array([g[1] for g in got], pa.list_(pa.float64()))}

        return run

    got = map_batches(rows, "y double, p double, at array<int>, values array<double>", featuring).collect()
    return fit_toxic([(np.array(r["at"], np.int64), np.array(r["values"])) for r in got], np.array([r["p"] for r in got]), np.array([r["y"] for r in got]))


def classify(documents: DataFrame, labels: DataFrame | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns `keep` of every row, with junk_score, toxic_score (0 to 1), toxic and accepted.

    A document is accepted if it has words and neither score reaches one half. The toxic score is
    the label model's or, if labels (doc_id, toxic) with two rows of each class are given, that of
    a logistic model over it and a scorer fitted on them, in which either can overrule the other. Vote
    patterns are counted over all rows; each scorer is fitted on at most `sample` rows, those with
    the smallest hashes. Null and empty texts are not accepted. Repeated rows each give a row, and
    weigh as many; other columns are ignored. An empty table gives no rows.
    """
    source = documents.select("doc_id", F.coalesce(quoted(text), F.lit("")).alias("_text"))

    counted = count_votes(source).collect()
    quality, toxic = (LabelModel(counted, c, names).posterior for c, names in (("quality", QUALITY), ("toxic", TOXIC)))

    def sampling():
        features = Features()

        def run(batch: pa.RecordBatch) -> dict:
            texts = [t.as_py() for t in batch.column("_text")]
            got = [features(t)[0] for t in texts]
            return {"p": [quality[_written(votes(t)[0])] for t in texts], "at": pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), "values": pa.array([g[1] for g in got], pa.list_(pa.float64()))}

        return run

    some = _sampled(source.select("_text").where(F.length("_text") > 0), sum(r["n"] for r in counted), sample, ["_text"])
    rows = map_batches(some, "p double, at array<int>, values array<double>", sampling).collect()
    junk = fit_scorer([(r["at"], r["values"]) for r in rows], np.array([r["p"] for r in rows]), SHAPE_BUCKETS, balanced=False)
    bad = _toxic_weights(source, labels, sample, toxic) if labels is not None else None
    shared = documents.sparkSession.sparkContext.broadcast((junk, bad))

    def scoring():
        features, (junk, bad) = Features(), shared.value

        def run(batch: pa.RecordBatch) -> dict:
            out = {"junk_score": [], "toxic_score": [], "toxic": [], "accepted": []}
            for t in batch.column("_text"):
                t = t.as_py()
                shapes, stems = features(t)
                j, x = score(junk, shapes), _posterior(toxic, t)
                if bad is not None and len(stems[0]):
                    x = score(bad[1], _both(score(bad[0], stems), x))
                out["junk_score"].append(j)
                out["toxic_score"].append(x)
                out["toxic"].append(x >= 0.5)
                out["accepted"].append(j < 0.5 and x < 0.5 and len(shapes[0]) > 0)
            return out

        return run

    return map_kept(documents, keep, {"_text": F.coalesce(quoted(text), F.lit(""))}, "junk_score double, toxic_score double, toxic boolean, accepted boolean", scoring)


def keep_accepted(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of documents that classify() accepts, with their columns, whatever these are called."""
    rows = apart(documents)
    named = rows.withColumns({"doc_id": place_of(documents, "doc_id"), "text": place_of(documents, "text")})
    return together(classify(named, labels, keep=tuple(rows.columns)).where("accepted"), documents)
