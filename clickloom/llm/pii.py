"""Personal data, also where it is disguised, with spans in code points of the source text.

Two transducers rewrite a text and keep, for every character they write, the source span it stands
for: one maps homoglyphs and full-width forms to ASCII and drops invisible characters, the other
turns spelled digits into digits and "at"/"dot" disguises into signs. Identifiers found in the
rewritten text are mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, map_batches, map_kept, quoted, together

KINDS = ("email", "ip", "card", "phone")

# The identifiers' patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other alphabets that look like an ASCII letter, and signs like a dot or at.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝүвгкмнтАВЕКМНОРСТХІЈЅԌԚԜҮαορνικυτωγΑΒΕΖΗΙΚΜΝΟΡΤΥΧοօսոցհԱＳıɡɑᴏ․。・·•∙⋅︒﹒＠﹫ⓐ‐‑‒–—−﹣",
        "aeopcyxijshdqwybrkmhtABEKMHOPCTXIJSGQWYaopvikutwyABEZHIKMNOPTYXoouoghUSigao.........@@a-------",
        strict=True,
    )
)
INVISIBLE = frozenset("\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff")


def homoglyphs() -> dict[str, str]:
    """What characters beyond ASCII stand for: those above, every decimal digit of any script, and all
    whose compatibility form is one ASCII character (full width, mathematical, circled letters...)."""
    out = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x1FC00)]):
        if c.isdecimal():
            out[c] = str(unicodedata.decimal(c))
        else:
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1 and " " <= n <= "~":
                out[c] = n
    return out | LOOKALIKES


HOMOGLYPHS = homoglyphs()
ODD = frozenset(HOMOGLYPHS) | INVISIBLE

# Digits as words; zero also as "oh".
DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
SPELLING = frozenset(w.encode() for w in [*DIGITS, "plus", "dot"])
_DIGIT = "(?:" + "|".join(DIGITS) + ")"
_BETWEEN = r"(?:[ ,-]+|\s+dot\s+|\s*[(\[{<]\s*dot\s*[)\]}>]\s*)"
# Runs of numerals and digits as words, one of these at least; "plus" may stand before.
_TOKEN = rf"(?:{_DIGIT}|[0-9]{{1,4}})"
SPELLED = re.compile(rf"(?i)\b(?:plus[ -]+|\+ ?)?{_TOKEN}(?:{_BETWEEN}{_TOKEN}(?![A-Za-z0-9])){{3,}}")
WORDS = re.compile(rf"(?i){_DIGIT}|plus|\+|dot|[0-9]+")
# "name (at) host [dot] tld", "name at host dot tld"
SIGN = re.compile(
    r"(?i)(?<=[A-Za-z0-9._%+-])(?:\s*[(\[{<]\s*(at|dot|@|\.)\s*[)\]}>]\s*|\s+(at)\s+(?=[A-Za-z0-9-]+\s+dot\s+[A-Za-z0-9])|\s+(dot)\s+)(?=[A-Za-z0-9])"
)
# "name at host.tld". Endings of hosts, and words that stand before "at" in plain prose.
PLAIN_AT = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])( +at +)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)(?![A-Za-z0-9-])")
PLAIN_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256)).lower()
BRACKETS = re.compile(r"[(\[{<]")
BEFORE_AT = frozenset("a an and are available be been but called can check contact email find found go he her him hosted i in is it join live look mail me meet more not now of on online open or out page reach read register report seen see send she shop sign site start starts stay stop store story that the them there they this try us version visit was we website were with write you".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plainly written identifiers, per kind leftmost and non-overlapping."""
    out = []
    if "@" in text:
        # The local part is what stands before the sign and after the last match: only there can a
        # match begin, so that no start is tried twice.
        at, end = text.find("@"), 0
        while at >= 0:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                end = m.end()
                out.append((start, end, "email"))
            at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


class Rewritten:
    """A text with the source span [starts[i], ends[i]) of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given disjoint, ordered spans; each new character stands for its whole span."""
        if not edits:
            return
        parts, starts, ends, last = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[last:a], new]
            starts += [*self.starts[last:a], *[self.starts[a]] * len(new)] if new else self.starts[last:a]
            ends += [*self.ends[last:a], *[self.ends[b - 1]] * len(new)] if new else self.ends[last:a]
            last = b
        self.text, self.starts, self.ends = "".join(parts), starts, ends


def spelled_out(found: str) -> str:
    """A run of digits as words and numerals, in digits."""
    return "".join("+" if w in ("plus", "+") else "." if w == "dot" else DIGITS.get(w, w) for w in WORDS.findall(found.lower()))


def _plain_at(text: str, m: re.Match) -> str:
    start = m.start()
    while start > 0 and text[start - 1] in LOCAL:
        start -= 1
    return m[1] if text[start : m.start()].lower() in BEFORE_AT else "@"


def disguised_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of identifiers that only the rewritten text shows. One that reaches beyond a base span of
    its kind is given besides it; one inside a base span of its kind is not."""
    view = Rewritten(text)
    odd = ODD.intersection(set(text)) if not text.isascii() else ()
    if odd:
        view.replace([(m.start(), m.end(), HOMOGLYPHS.get(m[0], "")) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)])
    # The words that the patterns below cannot do without tell which of them to try.
    words = set(view.text.encode("ascii", "replace").translate(PLAIN_WORDS).split())
    if not SPELLING.isdisjoint(words):
        view.replace([(m.start(), m.end(), spelled_out(m[0])) for m in SPELLED.finditer(view.text)])
    if b"at" in words or b"dot" in words or BRACKETS.search(view.text):
        view.replace([(m.start(), m.end(), "@" if (m[1] or m[2] or m[3]).lower() in ("at", "@") else ".") for m in SIGN.finditer(view.text)])
    if b"at" in words:
        view.replace([(*m.span(1), _plain_at(view.text, m)) for m in PLAIN_AT.finditer(view.text)])
    if view.text is text:
        return []
    out = []
    for a, b, kind in base_spans(view.text):
        start, end = view.starts[a], view.ends[b - 1]
        if text[start:end] != view.text[a:b] and not any(k == kind and s <= start and end <= e for s, e, k in base):
            out.append((start, end, kind))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find_personal_data(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, the number of base spans of each kind, base_sha256 and spans.

    spans joins "kind:start:end" of base and disguised spans by start, then kind; base_sha256 is the
    digest of the same string for base spans alone. A null or empty text has no spans (empty string).
    Repeated rows each give a row; other columns are ignored whatever their names, and a kept column
    named like an output gives way to it. Texts are read whole, in time that is linear in their length.
    """
    def make():
        def run(batch: pa.RecordBatch) -> dict:
            counts = {k: [] for k in KINDS}
            digests, spans = [], []
            for t in batch.column("_text"):
                t = t.as_py()
                base = base_spans(t)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + disguised_spans(t, base)))
            return {f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()} | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())}

        return run

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_kept(documents, keep, {"_text": F.coalesce(quoted(text), F.lit(""))}, schema, make)


def masked(text: str) -> str:
    """A text with its spans replaced by their kinds; overlapping ones together by the first one's."""
    base = base_spans(text)
    spans = sorted(base + disguised_spans(text, base), key=lambda s: (s[0], -s[1], KINDS.index(s[2])))
    parts, last = [], 0
    for s, e, k in spans:
        if s >= last:
            parts += [text[last:s], f"[{k}]"]
        last = max(last, e)
    return "".join([*parts, text[last:]]) if spans else text


def mask_personal_data(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with every span replaced by its kind in brackets, as in "[email]"; overlapping spans
    are replaced together by the first one's kind. Null texts stay null, other columns as they are."""
    rows, name = apart(documents), f"_k{[c.lower() for c in documents.columns].index(text.lower())}"

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            new = [t and masked(t) for t in batch.column(name).to_pylist()]
            return {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(new, pa.string())}

        return run

    return together(map_batches(rows, rows.schema, make), documents)
