"""BPE encoding and decoding with a public vocabulary file.

Merging keeps a heap of (rank, left position) entries over a doubly linked list of symbols. An entry
is skipped when the pair it was made for is gone. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_kept, quoted

#: Words kept in a task's cache before it is emptied; bounds memory, not results.
CACHE_WORDS = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, shift = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + shift)
            shift += 1
    return letters


class WordBpe:
    """The model of a tokenizer file whose words end in a suffix and whose texts are lower-cased."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*self.vocab.values(), *self.added.values()], default=-1) + 1)
        for piece, i in [*self.vocab.items(), *self.added.items()]:
            self.pieces[i] = piece
        self.letters = byte_letters()
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def merge(self, symbols: list[str]) -> list[str]:
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two was merged since
            symbols[i] = left + right
            alive[j] = False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian 32-bit integers."""
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        return np.array([self.vocab[p] for p in self.merge(letters) if p in self.vocab], "<u4").tobytes()

    def _plain(self, text: str, out: list[bytes]) -> None:
        cache = self.cache
        for w in self.words.findall(self.normalise(text)):
            got = cache.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            out.append(got)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        out: list[bytes] = []
        if self.split_added and any(a in text for a in self.added):
            for part in self.split_added.split(text):
                if part in self.added:
                    out.append(np.array([self.added[part]], "<u4").tobytes())
                else:
                    self._plain(part, out)
        else:
            self._plain(text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids; files without a decoder put a space between them."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(documents: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, with ids (array<int>) and decoded (string) of its text.

    A null text counts as empty and gives no ids. Every row gives one row, repeated rows included;
    other columns are ignored, and a kept column named like an output gives way to it. `vocabulary` is the path of the tokenizer file,
    readable on every executor.
    """
    return _encoded(documents, vocabulary, text, keep, False)


def digest_documents(documents: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_documents, but with n_tokens, ids_sha256 and decoded_sha256 in place of the values,
    so that neither leaves the task."""
    return _encoded(documents, vocabulary, text, keep, True)


def _encoded(documents: DataFrame, vocabulary: str, text: str, keep: tuple[str, ...], digests: bool) -> DataFrame:
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def make():
        model = WordBpe(vocabulary)

        def run(batch: pa.RecordBatch) -> dict:
            n, ids_out, decoded_out = [], [], []
            for t in batch.column("_text"):
                ids = model.encode(t.as_py())
                decoded = model.decode(ids)
                if digests:
                    n.append(len(ids) // 4)
                    ids_out.append(hashlib.sha256(ids).hexdigest())
                    decoded_out.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                else:
                    ids_out.append(np.frombuffer(ids, "<i4"))
                    decoded_out.append(decoded)
            if digests:
                return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_out, pa.string()), "decoded_sha256": pa.array(decoded_out, pa.string())}
            return {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(decoded_out, pa.string())}

        return run

    return map_kept(documents, keep, {"_text": F.coalesce(quoted(text), F.lit(""))}, more, make)
