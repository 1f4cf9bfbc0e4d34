"""The corpus operators against brute force, on small tables with nulls, ties, empty and long texts,
repeated rows and columns whose names clash with the operators' own."""

import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import anchors, bpe, chat, collocations, common, decontaminate, html, jaccard, lattice, multiset, passages, pii, quality, queries, simhash, suffixes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _key string, _id string, node string, fp string, hits string"


def corpus():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    shared, base = say(60), say(200)
    texts = [say(rnd.randint(1, 120)) for _ in range(20)]
    texts += [f"{say(30)} {shared} {say(20)}" for _ in range(4)] + [base, base, base + " more", base.replace(words[0], "other")]
    texts += [f"{shared}\n{say(5)} {shared}", "", None, " \n\t", "one", "ab " * 400, "x" * 5000, say(9000), "İ😀 é\u0000" * 30]
    return [(i * 3 % 101, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", "i", "n", "f", "h") for i, t in rows], SCHEMA).repartition(3).persist()


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    roots = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}
    kept = simhash.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values())) and kept.columns == docs.columns


def brute_similar(rows):
    """The smallest id of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets})


@pytest.mark.parametrize("small", [32, 3])
def test_near_copies_by_similarity(spark, rows, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(11)
    near = []
    for g in range(12):  # copies with some words changed, around the similarity asked for
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 20, 90, 400]))]
        for c in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            near.append((1000 + g * 10 + c, " ".join(w) + (" and one line that all of the texts have" if g % 2 else "")))
    table = rows + near
    df = spark.createDataFrame([(i, t, "k") for i, t in table], "doc_id long, text string, _row string").repartition(3)
    want = brute_similar(table)
    assert sorted(r.doc_id for r in simhash.keep_similar(df.unionByName(df)).collect()) == want
    assert len(want) < len({i for i, _ in table}) - 20
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "other words than these"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_similar(odd).collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (1, "other words than these")]
    assert simhash.keep_similar(odd.limit(0)).count() == 0


def test_one_root_is_not_paired(spark):
    """Strays of a shingle's group meet all others that can be alike; copies of one root cost no pairs."""
    rnd = np.random.default_rng(3)
    n, at = np.sort(rnd.integers(20, 60, 400)), rnd.integers(0, 6, 400)
    for roots in (np.zeros(400, np.int64), np.where(rnd.random(400) < 0.9, 7, rnd.integers(0, 5, 400)), np.arange(400)):
        got = {(int(min(a, b)), int(max(a, b))) for i, j in simhash._strays(n, at, roots) for a, b in zip(i, j, strict=True)}
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if roots[i] != roots[j] and n[i] >= 0.8 * n[j] - 1e-9 and min(n[i] - at[i], n[j] - at[j]) >= 0.8 / 1.8 * (n[i] + n[j]) - 1e-6}
        assert got == want
    began = time.perf_counter()
    assert not list(simhash._strays(np.full(1_000_000, 50), np.zeros(1_000_000, np.int64), np.zeros(1_000_000, np.int64)))
    assert time.perf_counter() - began < 20
    # A thousand near copies of one text, a hot shingle in all of them, and strays beside them.
    base = [f"w{i}" for i in range(300)]
    table = [(k, " ".join([*base[: k % 40], f"x{k}", *base[k % 40 + 1 :]])) for k in range(1000)] + [(2000 + k, " ".join(base[:5] + [f"s{k}_{i}" for i in range(60)])) for k in range(30)]
    kept = simhash.keep_similar(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(2000, 2030)]


@pytest.mark.parametrize("long", [False, True])
def test_texts_of_unlike_pairs_stay(spark, monkeypatch, long):
    """Texts that share shingles the order does not know move only if they may be near copies."""
    monkeypatch.setattr(simhash, "ORDER_SHINGLES", 0)
    moved, cut = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, label: moved.setdefault(label, cut(df, label)))
    rnd = random.Random(5)
    shared = [f"shared{i:06d}" if long else "abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(30)]
    table = []
    for k in range(40):
        own = [f"word{rnd.randrange(10**8):08d}" for _ in range(60)]
        table.append((k, " ".join([*own[:30], *shared, *own[30:]])))
    table.append((100, table[0][1] + " more"))
    kept = simhash.keep_similar(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == brute_similar(table) == list(range(40))
    assert moved["texts"].count() == 2


def test_parities_leave_similar_sets_open():
    rnd = np.random.default_rng(8)
    closed = 0
    for k in range(3000):
        a = np.unique(rnd.integers(0, 1 << 63, rnd.integers(0, 400)).astype(np.uint64))
        kept = rnd.permutation(a)[: int(len(a) * rnd.uniform(0.75 * (k % 2), 1))]
        b = np.unique(np.concatenate([kept, rnd.integers(0, 1 << 63, rnd.integers(0, 40)).astype(np.uint64)]))
        found = simhash.open_to(simhash.parity(a), len(a), simhash.parity(b), len(b))
        assert found or not simhash.similar(a, b)
        closed += not found
    assert closed > 1500


def test_near_copies_of_a_large_group_after_a_changed_join(spark):
    """Rows of a frequent shingle meet in one task also where adaptive execution turns the join before into a broadcast."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    table = [(0, " ".join(base))]
    for k in range(1, 120):  # 7 words in other places: like the first text, unlike each other
        w = list(base)
        for i in rnd.sample(range(5, 395), 7):
            w[i] = f"new{rnd.randrange(10**8)}"
        table.append((k, " ".join(w)))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = simhash.keep_similar(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.doc_id for r in kept) == brute_similar(table)


def test_simhash_chains_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 40)
    rnd = random.Random(1)
    fps = {0: rnd.getrandbits(64)}
    for i in range(1, 150):  # chains of up to 4 changed bits, and unrelated ones
        fps[i] = rnd.getrandbits(64) if i % 10 == 0 else fps[rnd.randrange(max(0, i - 5), i)] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "node long, fp long"))
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert {i: got.get(i, i) for i in fps} == brute_components(fps)


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {(r.node, r.root) for r in common.components(edges).collect()} == {(i, 0) for i in range(201)}
    assert common.components(edges.limit(0)).count() == 0


def test_bands_are_enough():
    for n in (10, 10**6, 10**9, 10**11):
        masks = [m % (1 << 64) for m in simhash.band_masks(n)]
        for _ in range(200):
            x = sum(1 << b for b in random.sample(range(64), 4))
            assert any(not x & m for m in masks)


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "hi <|x"), (1, 1, "assistant", "<\\|a\\"), (1, 2, "user", None), (2, 0, "assistant", odd), (2, 0, "assistant", odd), (None, 0, "system", "s"), (3, None, None, "t"), (4, 5, "a\nb\\", "\n")]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, _turns string")
    formatted = chat.format_conversations(rows)
    got = {r.conv_id: r for r in chat.digest_formatted(formatted).collect()}
    said = lambda *m: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in m).encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (3, said(("user", "hi <|x"), ("assistant", "<\\|a\\"), ("user", "")), 5)
    assert got[2].loss_sha256 == hashlib.sha256((odd * 2).encode()).hexdigest() and got[2].n_turns == 2
    assert got[4].turns_sha256 == said(("a\nb\\", "\n")) and got[3].turns_sha256 == said(("", "t")) and got[None].n_turns == 1
    assert not any(r.rewrites_history for r in got.values())


def test_chat_rewriting_template():
    last_only = lambda m: "|".join(["…"] * (len(m) - 1) + [m[-1][1]])
    out, turns, texts, rewrites = chat.render_spans([("user", "aaa"), ("assistant", "bbb"), ("user", "c")], last_only)
    assert rewrites and out == "…|…|c" and turns[0] is None and out[slice(*texts[2])] == "c"


def test_chat_with_private_use_roles():
    messages = [("\ue0000\ue001", "hey"), ("assistant", "\ue0001\ue001")]
    out, _, texts, rewrites = chat.render_spans(messages, chat.marked_turns)
    assert [out[slice(*s)] for s in texts] == ["hey", "\ue0001\ue001"] and not rewrites
    assert chat.common_prefix("abcd", "abxd") == 2 and chat.common_prefix("", "a") == 0 and chat.common_prefix("ab", "ab") == 2 and chat.common_prefix("x", "y") == 0
    ordered = lambda m: "".join(sorted(r + t for r, t in m))
    assert chat.render_spans([("b", "x"), ("a", "y")], ordered)[3]


def test_suffix_merge(monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 7)
    rnd = random.Random(3)
    strings = [bytes(rnd.choices(b"ab", k=rnd.randint(20, 80))) for _ in range(60)] + [b"ab" * 30] * 3 + [bytes(80), bytes(60) + b"x" * 20]
    documents = np.array([rnd.randint(0, 30) for _ in strings])
    first = {}
    for s, d in zip(strings, documents.tolist(), strict=True):
        for i in range(len(s) - 49):
            first[s[i : i + 50]] = min(first.get(s[i : i + 50], 99), d)
    for s, got in zip(strings, suffixes.least_documents(strings, documents), strict=True):
        assert got.tolist() == [first[s[i : i + 50]] for i in range(len(s) - 49)]


def brute_bytes(rows):
    raw, first, out = [(i, (t or "").encode()) for i, t in rows], {}, {}
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 10**9), i)
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated(docs).collect()}
    want = brute_bytes(rows)
    assert got == want and sum(v[1] for v in want.values()) > 3000


def brute_words(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    out = {}
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_passages(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeated(docs, digests=True).collect()}
    assert got == brute_words(rows)


def test_hot_anchors_are_spread(spark, monkeypatch):
    """One notice in very many surroundings: neither its anchors nor its windows meet in one task."""
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choices("abcdefghijkl", k=5)) for _ in range(n))
    notice = words(50)
    rows = [(i, f"{words(rnd.randint(25, 45))} {notice} {words(rnd.randint(25, 45))}") for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).persist()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeated(df).collect()}
    assert got == brute_bytes(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeated(df, digests=True).collect()}
    assert got == brute_words(rows)
    monkeypatch.setattr(anchors, "PART_ROWS", 500)
    for module, key in ((suffixes, "short"), (passages, "deal")):
        source = module._source(df, "text")
        hot, parts = anchors.layout(source, module._numbers)
        assert len(hot)
        dealt = module._anchors(source, hot)
        sizes = sorted(r["count"] for r in dealt.repartition(parts, key).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2], (module.__name__, sizes)
    source = passages._source(df, "text")
    windows = passages._windows(source, common.cut(passages._survivors(passages._anchors(source, hot), parts), "test"))
    assert windows.groupBy("deal").count().agg(F.max("count")).first()[0] <= 60


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in passages.remove_repeated(df).collect()) == [(0, 0), (1, 40), (1, 40), (2, 0)]
    assert sum(r.n_removed for r in suffixes.remove_repeated(df).collect()) == 0
    assert simhash.near_duplicates(df).count() == 4


def test_long_texts_in_stretches(monkeypatch):
    symbols = anchors.mixed(np.random.RandomState(0).randint(0, 5, 3000).astype(np.uint64))
    whole = anchors.anchors(symbols, 50, 20)
    monkeypatch.setattr(anchors, "STRETCH", 137)
    for a, b in zip(whole, anchors.anchors(symbols, 50, 20), strict=True):
        assert np.array_equal(a, b)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_equals_patterns():
    rnd = random.Random(5)
    for n in range(4000):
        text = "".join(rnd.choices(["a", "é", "@", ".", "@b.c", "1", "23", "255", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "_", "%", "1.2.3.4"], k=rnd.randint(1, 25)))
        assert pii.base_spans(text) == brute_pii(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii_disguised(spark):
    cases = {
        "write joe (at) mail [dot] example (dot) com now": "joe (at) mail [dot] example (dot) com",
        "joe.b at example dot com": "joe.b at example dot com",
        "jоe＠example．com": "jоe＠example．com",
        "joe ( at ) example.com": "joe ( at ) example.com",
        "joe [ @ ] example.com": "joe [ @ ] example.com",
        "192 dot 168 dot 1 dot 1": "192 dot 168 dot 1 dot 1",
        "one nine two dot one six eight dot one dot one": "one nine two dot one six eight dot one dot one",
        "write joe at example.com now": "joe at example.com",
        "jоe@example.com": "jоe@example.com",
        "plus 4 nine one 2 three four five six 7 eight": "plus 4 nine one 2 three four five six 7 eight",
        "٤١١١ ١١١١ ١١١١ ١١١١": "٤١١١ ١١١١ ١١١١ ١١١١",
        "𝐣𝐨𝐞@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦": "𝐣𝐨𝐞@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦",
        "look at example.com, page one of two three four": None,
        "call plus four nine one two three four five six seven eight": "plus four nine one two three four five six seven eight",
        "at the dot of noon, one two": None,
    }
    for text, want in cases.items():
        spans = pii.disguised_spans(text, pii.base_spans(text))
        assert [text[s:e] for s, e, _ in spans] == ([want] if want else []), text
        if want:  # nothing of it is left when it is masked
            assert not set(re.findall(r"[a-z0-9]{3,}", want)) & set(re.findall(r"[a-z0-9]{3,}", pii.masked(text)))
    df = spark.createDataFrame([(1, "a@b.co x 1.2.3.4", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.spans) for r in pii.find_personal_data(df).collect()}
    assert got == {1: (1, 1, "email:0:6,ip:9:16"), 2: (0, 0, ""), 3: (0, 0, "")}
    assert {r.text for r in pii.mask_personal_data(df).collect()} == {"[email] x [ip]", None, ""}


def test_pii_disguised_without_other_words():
    for text in ("alice@example[.]com", "bob ( at ) example.com", "bob {@} example.com", "bob < at > example.com", "10[.]0[.]0[.]1", "10 dot 0 dot 0 dot 1", "10 (dot) 0 (dot) 0 (dot) 1"):
        spans = pii.disguised_spans(text, pii.base_spans(text))
        assert [text[s:e] for s, e, _ in spans] == [text], text


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    r = quality.classify(docs, train).select("doc_id", "junk_score", "accepted").join(test, "doc_id").collect()
    junk, clean = [x for x in r if not x.quality], [x for x in r if x.quality and not x.toxic]
    assert sum(x.junk_score >= 0.5 for x in junk) >= 0.9 * len(junk)
    assert sum(x.accepted for x in clean) >= 0.95 * len(clean)


def test_label_model_on_known_accuracies():
    rnd = np.random.RandomState(8)
    truth, accuracy = rnd.rand(20_000) < 0.3, [0.95, 0.9, 0.8, 0.7, 0.65, 0.6, 0.85]
    votes = np.stack([np.where(rnd.rand(len(truth)) < 0.3, quality.UNABLE, np.where((rnd.rand(len(truth)) < a) == truth, quality.AGAINST, quality.FOR)) for a in accuracy], 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, found, share = quality.fit_label_model(patterns, counts)
    assert np.abs(found - accuracy).max() < 0.05 and abs(share - 0.3) < 0.05
    guess = p[where.ravel()] >= 0.5
    majority = (votes == quality.AGAINST).sum(1) > (votes == quality.FOR).sum(1)
    any_vote = (votes == quality.AGAINST).any(1)
    right = lambda g: (g == truth).mean()
    assert right(guess) > right(majority) + 0.01 and right(guess) > right(any_vote) + 0.2


def test_label_model_on_labels(spark):
    """EM's labels against human ones it has not seen: better than any vote against, and than most votes."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", "quality").collect()
    votes = np.array([quality.votes(r.text or "")[0] for r in docs])
    junk = np.array([r.quality == 0 for r in docs])
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, accuracy, _ = quality.fit_label_model(patterns, counts)
    right = lambda g: (g == junk).mean()
    any_vote = (votes == quality.AGAINST).any(1)
    most = (votes == quality.AGAINST).sum(1) > (votes == quality.FOR).sum(1)
    guess = p[where.ravel()] >= 0.5
    assert right(guess) > right(any_vote) and right(guess) > right(most) and (guess != any_vote).any()
    for k, a in enumerate(accuracy):
        cast = np.isin(votes[:, k], (quality.FOR, quality.AGAINST))
        if cast.sum() >= 30:
            assert abs(((votes[cast, k] == quality.AGAINST) == junk[cast]).mean() - a) < 0.08, quality.QUALITY[k]


def test_labeller_accuracies(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, "")], "doc_id long, text string")
    rows = quality.labeller_accuracies(df).collect()
    assert [r.labeller for r in rows] == [*quality.QUALITY, *quality.TOXIC] and all(r.accuracy is None or 0 <= r.accuracy <= 1 for r in rows)
    assert quality.labeller_accuracies(df.limit(0)).count() == len(rows)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, True), (2, "", True), (3, "A plain sentence of words, here.", True), (4, "you idiot moron.", True)], "doc_id long, text string, accepted boolean")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    assert not got[1].accepted and not got[2].accepted and len(got) == 4
    assert quality.classify(df.limit(0)).count() == 0


def test_quality_passes_any_columns(spark):
    rows = [(i, f"A plain sentence number {i} of some words that say a thing.", "t", 0.1, True) for i in range(9)] + [(None, None, "t", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, junk_score double, accepted boolean")
    df = df.withColumns({"toxic": F.lit("x"), "a.b": F.lit(1), "Toxic_Score": F.lit(2), "_h": F.lit(3), "_k0": F.lit(4)})
    out = quality.keep_accepted(df)
    assert out.columns == df.columns and out.where("doc_id is null").count() == 0 and out.count() > 0
    assert {r.toxic for r in out.collect()} == {"x"} and out.schema == df.schema
    got = quality.classify(df, keep=tuple(df.columns))
    assert got.columns == ["doc_id", "text", "_text", "a.b", "_h", "_k0", "junk_score", "toxic_score", "toxic", "accepted"] and got.count() == 10
    assert pii.mask_personal_data(df).schema == df.schema
    for c in (simhash.keep_one(df), simhash.keep_similar(df)):
        assert c.columns == df.columns and c.where("_k0 <> 4").count() == 0
    found = pii.find_personal_data(df.withColumn("spans", F.lit(1)).withColumn("_text", F.lit("x")), keep=("doc_id", "spans", "_text"))
    assert found.columns == ["doc_id", "_text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_quality_reads_long_words_whole():
    f = quality.Features()
    a, b = f("x" * 64 + "#" * 64)[0], f("x" * 64)[0]
    assert len(a[0]) > len(b[0])


def test_quality_scorer_overrules_one_listed_word(spark):
    plain = "the people of the town went to the market and came home again"
    assert quality.votes(f"{plain} with the garbage")[1] == [1, -1, 0] and quality.votes(f"{plain} garbage trash")[1] == [1, -1, -1]
    rnd = random.Random(2)
    kind, foul = [f"good{k}" for k in "abcdefghijklmnop"], [f"xbad{k}" for k in "abcdefghijklmnop"]
    kind, foul = [w[4:] * 3 + "day" for w in kind], [w[4:] * 3 + "hate" for w in foul]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        said = rnd.choices(kind, k=20) + (rnd.choices(foul, k=12) + rnd.choices(["idiot", "trash", "scum", "loser"], k=3) * (i % 8 == 0) if toxic else ["garbage"] * (i % 20 == 1))
        rows.append((i, " ".join(rnd.sample(said, len(said))), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.toxic for r in quality.classify(df.select("doc_id", "text"), df.where("doc_id % 3 > 0").select("doc_id", "toxic")).collect()}
    for some in ([r for r in rows if "garbage" in r[1]], [r for r in rows if r[2]], [r for r in rows if not r[2]]):
        assert len(some) > 15 and sum(got[i] == bool(y) for i, _, y in some) >= 0.95 * len(some)


def brute_windows(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for run, of in windows.items():
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    found |= of
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("block,few", [(2_000_000, 100_000), (25, 0)])
def test_decontamination(spark, docs, rows, monkeypatch, block, few):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", few)
    texts = [t for _, t in rows if t]
    items = [(i, " ".join(texts[20 + i].split()[25:45])) for i in range(5)] + [(9, "one"), (10, ""), (11, None), (12, "One, "), (13, "never said in any of these")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == brute_windows(rows, items)
    twice = decontaminate.find_contamination(docs.unionByName(docs), bench)
    assert twice.count() == 2 * len(rows)
    assert decontaminate.find_contamination(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_contaminated_rows_are_judged_apart(spark):
    leak = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([("x", f"{leak} end"), (None, "null id"), ("y", "one")], "item_id string, text string")
    df = spark.createDataFrame([(None, f"a {leak}", 1), (5, f"b {leak}", 2), (5, "clean", 3), (None, "clean", 4), (5, "clean", 5), (6, None, 6), (7, "null id", 7), (8, "One", 8)], "doc_id long, text string, hits int")
    assert sorted(r.hits for r in decontaminate.drop_contaminated(df, bench).collect()) == [3, 4, 5, 6, 7]
    got = decontaminate.find_contamination(df, bench)
    assert {(r.doc_id, tuple(r["items"]), len(r.hits)) for r in got.collect()} == {(None, ("x",), 12), (5, ("x",), 12), (5, (), 0), (None, (), 0), (6, (), 0), (7, (), 0), (8, ("y",), 1)}
    assert got.count() == 8 and decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>m</a></nav><div class="cookie-notice">we use</div>
<article class="post"><h1>Head&amp;line</h1><p>One <b>two<br>three<p>four &#233; </p><script>var a="</p>";</script><div class=ad>buy</div><aside>side</aside><form>f</form><ul><li>x<li>y</ul>
<section id="comments"><article class="comment">bad</article></section></article><footer>f</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", PAGE, "x"), (2, None, None, "x"), (3, "http://A.b", "<p>no article <nav>m</nav> here", "x"), (4, "u", "<!-- open", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {1: "Head&line One two three four é x y", 2: "", 3: "no article here", 4: ""}


def brute_classes(pages):
    """Tokens by their occurrence vectors, gathered outright."""
    counts = [html.page_tokens(p) for p in pages]
    vectors = {}
    for t in {t for c in counts for t in c}:
        v = tuple(c.get(t, (0,))[0] for c in counts)
        n = sum(x > 0 for x in v)
        if n >= html.SUPPORT * len(pages) and (n >= html.LEAST_PAGES or n == len(pages)):
            vectors.setdefault(v, set()).add(t)
    return sorted(map(sorted, vectors.values()))


def test_html_templates(spark):
    page = lambda i: f"<body><div><p>Same words on all pages.</p></div><div><p>Own words {i}.</p></div></body>"
    df = spark.createDataFrame([(i, "http://h/x", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == {f"Own words {i}." for i in range(6)}
    odd = [page(i).replace("</body>", "<hr><i>x</i></body>" * (i % 2) + "<ul><li>a</ul>" * (i % 3)) for i in range(7)]
    classes = html.template_classes(spark.createDataFrame([(i, "http://h/x", h) for i, h in enumerate(odd)], df.schema))
    assert sorted(sorted(t.token for t in c.tokens) for c in classes.collect()) == brute_classes(odd)
    nested = html.nested_classes(classes).collect()
    assert len({c.class_id for c in nested}) == len(nested) and any(c.parent_id is not None for c in nested)


def test_html_slots_by_classes(spark):
    """What a page alone cannot tell: boilerplate without a name, teasers, words that may mean anything."""
    line = lambda i, k: f"Sentence {k} of the story number {i} which is told at some length here."
    story = lambda i: "".join(f"<p>{line(i, k)}</p>" for k in range(4))
    hosts = {
        "plain": lambda i: f"<body><div class=x1><p>Buy our book on all pages now, it is a very good book and cheap too.</p></div><div id=main>{story(i)}<p>Read more on our site every day.</p></div></body>",
        "teaser": lambda i: f"<body><div id=main>{story(i)}</div><article>Teaser {i}</article></body>",
        "words": lambda i: f"<body><article><h1>Title {i}</h1>{story(i)}" + (f'<section class="menu">Soup {i} and bread</section><p class="notice">Closed on day {i}</p>' if i == 2 else "") + "<p>a <math>x+1</math></p></article></body>",
        "boxes": lambda i: f'<body><article>{story(i)}<div class="notice">Notice number {i}</div></article></body>',
    }
    rows = [(k * 10 + i, f"http://{h}/p", f(i)) for k, (h, f) in enumerate(hosts.items()) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    told = lambda i: " ".join(line(i, k) for k in range(4))
    for i in range(5):
        assert got[i] == told(i)
        assert got[10 + i] == told(i)
        assert got[20 + i].startswith(f"Title {i} {told(i)}")
        assert got[30 + i] == told(i)
    assert "Soup 2 and bread Closed on day 2" in got[22]
    alone = {i: html.main_text(html.Page(h), "", frozenset(), frozenset()) for i, _, h in rows}
    assert all(alone[i] != got[i] for i in [*range(5), *range(30, 35)])
    copies = spark.createDataFrame([(i, "http://h/", f"<body><article>{story(1)}</article></body>") for i in range(9)], df.schema)
    assert {r.text for r in html.extract(copies).collect()} == {told(1)}
    assert html.extract(df.limit(0)).count() == 0


def test_html_names_inside_the_article():
    """Words in the names of an article's own elements do not cut its text; whole names of others do."""
    body = " ".join(f"word{i}" for i in range(60))
    kept = ["<p class='share-price'>the price</p>", "<p id='social-policy'>the policy</p>", "<div class='ad-hoc'>the committee</div>", "<section class='subscribe-model'>the model</section>", "<blockquote class=promoted>the quote</blockquote>"]
    page = html.Page(f"<html><body><article><p>{body}</p>{''.join(kept)}<div class='ad'>buy</div><div class='promo big'>now</div></article></body></html>")
    slot = html.densest(Counter({b.path: len(b.text) for b in page.blocks}), list(page.paths))
    text = html.main_text(page, slot, frozenset(), frozenset())
    assert all(re.sub("<[^>]*>", "", k) in text for k in kept) and "buy" not in text and "now" not in text


def test_html_links_and_classes_at_any_depth():
    page = html.Page("<p>x <a href=y><b><i><u><em><strong>deep</strong></em></u></i></b> link</a> after</p>")
    assert [(b.text, b.links) for b in page.blocks] == [("x deep link after", 9)]
    path, classes = "", []
    for i in range(3000):
        path += f">div.c{i}"
        classes.append({"class_id": i, "parent_id": max(0, i - 1), "pages": 4, "n": 4, "tokens": [{"token": path, "chars": 5 if i == 2999 else 0, "doubt": False}]})
    assert html.host_template(classes)[0] == path
    classes[7]["n"] = 9  # opened more than once: nothing inside it bounds a slot
    assert html.host_template(classes)[0].count(">") == 7


def test_html_single_pages(spark):
    real = "<div id=main><p>The real story.</p></div><article>Teaser</article>"
    cases = [real, '<article><p>One story.</p><section class="menu">The soup and the bread.</section><p class="notice">Closed.</p></article>', "<article>a<math>x</math></article>", ""]
    df = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[0] == "The real story." and got[1] == "One story. The soup and the bread. Closed." and got[2] == "ax" and got[3] == ""


def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_library(spark, docs, rows):
    path, lib = tokenizer()
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].decoded) == (ids, lib.decode(ids, skip_special_tokens=False))
    model = bpe.WordBpe(path)
    for t in ("ΣΑΣ İ don't <|endoftext|>x<|startoftext|>", "日本語 😀😀 ﬁ Å 1²Ⅷ", "'s't're", "a" * 3000):
        assert np.frombuffer(model.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def brute_vector(text):
    units = [u for u in re.split(r"\n+|(?<=[.!?]) +", text or "") if u]
    out = []
    for i in range(2):
        h = [xxhash.xxh64_intdigest(f"{i}:{u}".encode(), 42) for u in units]
        bits = [sum(x >> b & 1 for x in h) for b in range(64)]
        out += [len(h), *[bits[b + half] for b in range(32) for half in (0, 32)], sum(x & 0xFFFFFFFF for x in h) % 2**32, sum(x >> 32 for x in h) % 2**32]
    return out


def test_multiset_vectors(spark):
    texts = ["", "a", "a\nb", "b\na", "a\na\nb", "One. Two! Three?\n\nFour", "x " * 100]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(multiset.vector(F.col("t")).alias("v")).collect()]
    assert got == [brute_vector(t) for t in texts] and got[2] == got[3]
    df = spark.createDataFrame([("a\nb", "b", "a")], "x string, y string, z string")
    v = {c: multiset.vector(F.col(c)) for c in "xyz"}
    r = df.select(multiset.merged(v["x"], v["y"], -1).alias("m"), v["z"].alias("z"), multiset.merged(v["z"], v["y"]).alias("s"), v["x"].alias("x")).first()
    assert r.m == r.z and r.s == r.x
    w = multiset.written(v["x"])
    assert df.select(multiset.read_back(w) == v["x"]).first()[0]


def test_multiset_likeness_of_shared_paragraphs(spark):
    rnd = random.Random(4)
    line = lambda: "".join(rnd.choices("abcdefghij ", k=20)).strip() + "x"
    pairs = []
    for k in range(60):
        own, other, both = ([line() for _ in range(30)] for _ in range(3))
        shared = k % 31
        pairs.append((shared / 30, "\n".join(both[:shared] + own[shared:]), "\n".join(both[:shared] + other[shared:])))
    df = spark.createDataFrame(pairs, "share double, a string, b string")
    off = [abs(r.share - r.near) for r in df.select("share", multiset.likeness(multiset.vector(F.col("a")), multiset.vector(F.col("b"))).alias("near")).collect()]
    assert sum(off) / len(off) < 0.06 and max(off) < 0.3


def test_multiset_documents(spark, docs, rows, monkeypatch):
    got = {r.doc_id: r for r in multiset.fingerprint_documents(docs).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in brute_vector(t)) and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in brute_vector(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    one = spark.createDataFrame([(5, "ab"), (5, "ab"), (None, None)], "doc_id long, text string")
    assert multiset.fingerprint_documents(one).count() == 3 and multiset.fingerprint_documents(one.limit(0)).count() == 0
    assert "Python" not in multiset.fingerprint_documents(docs)._jdf.queryExecution().toString()


def test_pipeline(spark):
    """Every stage of a run against brute force, on its own input."""
    p = pytest.importorskip("corpus_pipeline")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    path, lib = tokenizer()
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = before, [before]
    for name, stage in p.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, DATA), "test")
        assert docs.columns == before.columns and docs.schema == before.schema, name
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    known = [(i, labels[i].quality == 1 and not labels[i].toxic) for i in texts[0] if i in labels]
    assert sum((i in texts[1]) == good for i, good in known) >= 0.95 * len(known)
    assert all(texts[1][i] == texts[0][i] for i in texts[1])
    assert sorted(texts[2]) == brute_similar(list(texts[1].items()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = brute_windows(list(texts[2].items()), items)
    assert set(texts[3]) == {i for i, (_, hit, _) in found.items() if not hit} and len(texts[3]) < len(texts[2])
    assert texts[4] == {i: t and pii.masked(t) for i, t in texts[3].items()}
    assert not any(brute_pii(t or "") for t in texts[4].values())
    out = {r.doc_id: r for r in p.STAGES[-1][1](spark, docs, DATA).collect()}
    assert set(out) == set(texts[4])
    for i, t in texts[4].items():
        assert out[i].ids == lib.encode(t or "", add_special_tokens=False).ids and out[i].decoded == lib.decode(out[i].ids, skip_special_tokens=False)


def test_pipeline_stages_lose_nothing(spark, tmp_path):
    """Null and repeated ids with unlike texts, and columns called like every name the stages use."""
    p = pytest.importorskip("corpus_pipeline")
    tokenizer()
    names = "accepted toxic junk_score toxic_score _text _row _a _b node fp root hits items win found ids decoded _k0 spans base_sha256 _h _key _id".split()
    say = lambda k: f"The people of town number {k} went to the market in the morning, and came home with item {k * 7} for the table. It was a day like any other there."
    leak = " ".join(f"benchmarked{i}" for i in range(12))
    texts = [(None, say(1)), (5, say(2)), (5, "A wholly different story about the sea and the ships, told by an old man to the children of the house."), (5, f"{say(3)} {leak}"), (None, f"It is the thing of the day. {leak}"), (6, None), (7, ""), (8, say(2)), (9, "Write to me at joe@example.com about the house and the garden of the family, please.")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    stages = dict(p.STAGES)
    run = lambda name, d=df: stages[name](spark, d, f"file://{tmp_path}")
    key = lambda d: sorted(r.accepted for r in d.collect())
    for name in list(stages)[:-1]:
        out = run(name)
        assert out.columns == df.columns and key(out) == sorted(set(key(out))), name
        assert run(name, df.limit(0)).count() == 0
    assert key(run("benchmark decontamination")) == ["accepted0", "accepted1", "accepted2", "accepted5", "accepted6", "accepted7", "accepted8"]
    # Of equal texts (1 and 7; 5 and 6 have no words) the one with the smallest id stays; rows without an id stay.
    assert key(run("SimHash near-dedup")) == ["accepted0", "accepted1", "accepted2", "accepted3", "accepted4", "accepted5", "accepted8"]
    masked = {r.accepted: r.text for r in run("PII").collect()}
    assert len(masked) == 9 and masked["accepted8"] == "Write to me at [email] about the house and the garden of the family, please." and masked["accepted5"] is None
    assert "accepted5" not in key(run("quality classifier")) and "accepted6" not in key(run("quality classifier"))
    assert run("BPE encoding and decoding").count() == 9


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def table_of(duck, name):
    result = duck.execute(f"select * from {name}")
    names = [d[0] for d in result.description]
    return [dict(zip(names, r, strict=True)) for r in result.fetchall()]


def test_op1_query(spark, duck):
    rows = [(r["doc_id"], r["text"]) for r in table_of(duck, "documents")]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    roots = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, DATA).collect()}
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}


def test_op4_query(spark, duck):
    got = {r.doc_id: r for r in queries.op4_pii(spark, DATA).collect()}
    for r in table_of(duck, "documents"):
        spans, g = brute_pii(r["text"] or ""), got[r["doc_id"]]
        assert g.base_sha256 == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert set(filter(None, pii.written(spans).split(","))) <= set(g.spans.split(","))


def test_op6_query(spark, duck):
    docs = table_of(duck, "documents")
    got = queries.op6_quality(spark, DATA)
    assert got.count() == len(docs) and {"doc_id", "junk_score", "toxic_score", "toxic", "accepted"} <= set(got.columns)


def test_op8_query(spark, duck):
    """Every page of these hosts has one article: its blocks, without elements left out, by a plain parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.blocks.append("") if tag in html.BLOCK else None

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.blocks.append("") if tag in html.BLOCK else None

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    got = {r.page_id: r for r in queries.op8_html(spark, DATA).collect()}
    for r in table_of(duck, "pages"):
        p = Plain()
        p.feed(r["html"])
        want = " ".join(" ".join(b.split()) for b in p.blocks if b.strip())
        assert (got[r["page_id"]].text, got[r["page_id"]].n_chars, got[r["page_id"]].url) == (want, len(want), r["url"])


def test_op9_query(spark, duck):
    _, lib = tokenizer()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, DATA).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in table_of(duck, "documents"):
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))


def test_op10_query(spark, duck):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table_of(duck, "documents")), reverse=True)
    got = {r.doc_id: r for r in queries.op10_multiset_fingerprint(spark, DATA).collect()}
    for k, (i, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in brute_vector(t))


EMPTY = ["near_duplicates", "keep_one", "keep_similar"]


@pytest.mark.parametrize("run", [*[getattr(simhash, n) for n in EMPTY], suffixes.remove_repeated, passages.remove_repeated, pii.find_personal_data, pii.mask_personal_data, quality.classify, quality.keep_accepted, multiset.fingerprint_documents], ids=lambda f: f.__name__)
def test_empty_tables(spark, docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_tables_of_other_kinds(spark):
    path, _ = tokenizer()
    none = spark.createDataFrame([], "doc_id long, text string, conv_id long, turn long, role string, page_id long, url string, html string")
    assert bpe.encode_documents(none, path).count() == 0 and chat.digest_formatted(chat.format_conversations(none)).count() == 0 and html.extract(none).count() == 0


def test_bpe_keeps_any_columns(spark):
    path, lib = tokenizer()
    df = spark.createDataFrame([(1, "a b", 7, "x", "y")], "doc_id long, text string, ids long, decoded string, _text string")
    got = bpe.encode_documents(df, path, keep=tuple(df.columns))
    assert got.columns == ["doc_id", "text", "_text", "ids", "decoded"] and got.first().ids == lib.encode("a b", add_special_tokens=False).ids


def brute_collocations(rows, best=2000, least=10):
    """Phrases of every language, counted word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (other, q), b in f.items() if other == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and b >= least]
        if any(100 * b >= 50 * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:best])}


@pytest.mark.parametrize("block", [1 << 20, 97, 3])
def test_collocations(spark, monkeypatch, block):
    """Nulls, pieces, overlaps, repeated rows, ties, long texts, languages, clashing columns; blocks that
    cut texts anywhere, and a filter that lets everything through."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "SLICE", 50 if block < 100 else 1 << 20)
    monkeypatch.setattr(collocations, "FILTER_BITS", 64 if block == 3 else 1 << 20)
    rnd = random.Random(3)
    words = ["New", "york", "é", "a", "İb", "x\u00a0y", "ab\x00", "the", "of", "\x1c"]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "; "]) for _ in range(n))
    rows = [(rnd.choice(["en", "en", "de", None, ""]), say(rnd.randrange(60))) for _ in range(60)]
    rows += [("en", "new york city " * 12), ("en", "a a a a a a a a a a a a a"), ("en", None), (None, ""), ("en", " ,.\n"), ("und", "new york")] + [("fr", "le chat noir. le chat")] * 11
    rows += [("es", "uno dos " * 900)] if block > 3 else []
    df = spark.createDataFrame([(a, b, "b", 1, 2) for a, b in rows], "lang string, text string, word string, block long, id long").repartition(3)
    got = collocations.collocations(df)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows)
    if block > 100:
        monkeypatch.setattr(collocations, "BEST", 3)
        assert {tuple(r) for r in collocations.collocations(df).collect()} == brute_collocations(rows, 3)
        assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.where("text is null")).count() == 0


def test_collocation_scores_are_exact(spark):
    big = 10**15 + 7
    rows = [(3, 5, 7), (10, 10, 10), (10**12, 10**12 + 1, 10**12 + 3), (big - 1, big, big), (1, big, big)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def brute_jaccard(rows):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if (c := least.get(find(k))) is None else c) for k, (i, _) in enumerate(rows))


def near_copies(rnd):
    """Groups of copies with some words changed, around the likeness asked for; chains; one large group."""
    out = []
    for g in range(14):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 9, 30, 120, 700]))]
        for c in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 45))):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            out.append((1000 + g * 10 + c, " ".join(w)))
    base = [f"h{i}" for i in range(110)]
    for c in range(60):
        w = list(base)
        w[rnd.randrange(len(w))] = f"x{c}"
        if c % 2:
            w[rnd.randrange(len(w))] = f"y{c}"
        out.append((3000 + c, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for c in range(12):
        chain[c * 15] = f"z{c}"
        out.append((5000 + c, " ".join(chain)))
    return out


@pytest.mark.parametrize(("part", "crowd"), [(1 << 21, 20_000), (1500, 20_000), (1500, 3)])
def test_jaccard_join(spark, rows, monkeypatch, part, crowd):
    """Also with neighbourhoods dealt out in parts, and with shingles that too many share to meet by them."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rnd = random.Random(12)
    table = rows + near_copies(rnd)
    table += [(table[0][0], "one id with another text than it has"), (None, table[25][1]), (None, "nobody else says this at all"), (7000, "A B c"), (7001, "a b C"), (7002, "a b"), (7003, None), (7003, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in table], "doc_id long, text string, node long, _a long, root string").repartition(3)
    found = jaccard.jaccard_components(df)
    assert [t for _, t in found.dtypes] == ["bigint"] * 3
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found.collect())
    assert got == [(i, n, i if not n else c) for i, n, c in brute_jaccard(table)]
    if crowd == 3:
        assert jaccard.jaccard_components(df.limit(0)).count() == 0
        assert [tuple(r) for r in jaccard.jaccard_components(df.where("doc_id >= 7003")).collect()] == [(7003, 0, 7003)] * 2


def test_signature_trees_prune_and_miss_nothing():
    """The links of all pairs, from far fewer comparisons; a large group of copies costs one for each."""
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 2**63, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(300)]
    for s in sets[:60]:  # near copies
        sets.append(np.unique(np.concatenate([s[: max(1, int(len(s) * 0.9))], rnd.integers(0, 2**63, max(0, len(s) // 20)).astype(np.uint64)])))
    nodes = np.arange(len(sets))
    compared = []
    real, jaccard.linked = jaccard.linked, lambda a, b: compared.append(1) or real(a, b)
    try:
        edges = jaccard.link_sets(nodes, sets, nodes, np.zeros(len(sets), np.int64))
        assert len(compared) < 400
        compared.clear()
        same = [np.unique(np.concatenate([sets[0], [np.uint64(k)]])) for k in range(500)]
        assert len(jaccard.link_sets(np.arange(500), same, np.arange(500), np.zeros(500, np.int64))) == 499 and len(compared) < 1500
    finally:
        jaccard.linked = real
    want = [(i, j) for i in range(len(sets)) for j in range(i) if real(sets[i], sets[j])]

    def roots(pairs):
        parent = list(range(len(sets)))
        for i, j in pairs:
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            parent[max(i, j)] = min(i, j)
        out = []
        for i in range(len(sets)):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    assert roots(edges) == roots(want) and len(want) > 40
    signatures = [jaccard.bitmaps([s], jaccard.signature_bits(len(s))).tobytes() for s in sets]
    loose = roots(jaccard.link_bitmaps(nodes, np.array([len(s) for s in sets]), signatures))
    assert all(loose[i] == loose[j] for i, j in want)


def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = {}
    for i, q, x in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(x == 1)))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        f |= {"E"} if i is not None and first[t] < i else set()
        fails.append((s or "", f, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    rows, shapley = [], Counter()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = set(order[:k])
                here = [d for d in own if x in d[1] and not d[1] & gone]
                shapley[part, x] += len(here)
                rows.append((part, "".join(order), k + 1, sum(not d[1] & (gone | {x}) for d in own), len(here), sum(x in d[1] and bool(d[1] & gone) for d in own), sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_filter_audit(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice(["Ab", "cd", "e", "É", "x#", "FG"]) + str(rnd.randrange(9 if rnd.random() < 0.3 else 10**5)) for _ in range(n))
    texts = [say(rnd.choice([1, 49, 50, 80])) for _ in range(25)] + [None, "", " \n", "plain " * 60, "a|b", "\u00c0" * 60, say(4000)]
    docs = [(rnd.randrange(60), rnd.choice(texts), rnd.choice(["s1", "s2", None, "", "s3"])) for _ in range(120)]
    docs += [docs[0], docs[0], (None, docs[1][1], "s1"), (None, "only here", "s4")]
    labels = [(rnd.randrange(70), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    d = spark.createDataFrame([(*r, "p", 1, 2) for r in docs], "doc_id long, text string, source string, part string, mask int, quality int").repartition(3)
    x = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, source string")
    got = lattice.audit(d, x)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert lattice.audit(d.limit(0), x).count() == 0 and lattice.audit(d, x.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    assert sorted(map(tuple, lattice.audit(d, x.limit(0)).collect())) == brute_audit(docs, [])
    edges = lattice.edge_counts(lattice.failure_masks(d), x)
    assert {r["count"] for r in edges.groupBy("part").count().collect()} == {80}
