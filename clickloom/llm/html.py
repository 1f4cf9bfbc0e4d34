"""Main text of web pages by equivalence classes of template tokens.

Pages are cut into tokens: element paths, and blocks of text. Tokens of a host whose occurrence
vectors over the host's pages are equal form a class. Classes that are found on enough pages are the
template, nested by their paths. Elements that the template opens once on a page, inside others of
that kind, bound its slots; the deepest one that still holds most of the text which is neither
template, link nor under a word for something else is the article's slot. Names of elements and words
in their classes are votes: plain ones (nav, footer, ads, comments...) always count, others (menu,
notice...) only where the template has the element or links fill it. Text that is itself template is
left out.

Occurrence vectors are never gathered: a class is known by the sums of two hashes of (page, count)
pairs, which rows add up in any order and any number of tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Share of a host's pages that a template class is found on at least, and pages that text must be
#: repeated on to count as template.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Share of the text that the article's slot holds at least; share of a page's text that its host's slot
#: has to hold, or the page gets a slot of its own; share of a slot's text that its template texts have
#: to leave, or they count as the page's own (a host may hold copies of one article).
DENSE, HELD, LEFT = 0.7, 0.5, 0.25

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title select".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div center td".split())
CLOSED_BY_BLOCK = frozenset({"p"})
LEFT_OUT = frozenset("nav footer aside form menu button dialog header head label fieldset".split()) | RAW
# Elements that hold a piece of running text; words in class, id or role that mark what is
# not main text, plainly or perhaps. Plain ones count as whole names of other elements; as parts of a
# name (share-price), or on a piece of running text, they are votes like the others.
RUNNING = frozenset("p blockquote figure figcaption h1 h2 h3 h4 h5 h6 pre li dd dt td th".split())
PLAIN_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion sidebar nav navbar navigation breadcrumb breadcrumbs masthead topbar cookie cookies consent popup modal overlay newsletter subscribe signup share sharing social recommended comment comments reply replies disqus login toolbar pagination pager complementary contentinfo".split()
)
MARKS = frozenset("banner side aside menu footer header notice notices alert related search widget copyright legal hidden".split())
OF_READERS = frozenset("comment comments reply replies hidden related".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NUMERALS, UNLIKE = re.compile(r"[0-9]+"), re.compile(r"[>=\s]")
SPLIT_MARK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    """A block of text: the path of the element right around it, whether it is plainly not main text,
    the path of the outermost element around it that perhaps is not, and its characters in links."""

    path: str
    text: str
    out: bool
    doubt: str
    links: int


class Page:
    """Blocks of a page in order, and how often each path opens."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.paths: Counter[str] = Counter()
        self.stack: list[tuple[str, str, bool, str, bool]] = [("", "", False, "", False)]
        self.parts: list[str] = []
        self.links = 0
        at = 0
        while m := TOKEN.search(html, at):
            self.say(html[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self.say(m[1])
            elif m[3]:
                name = m[3].lower()
                if m[2]:
                    self.close(name)
                elif self.open(name, m[4]) and name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s>/])[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    self.close(name)
        self.say(html[at:])
        self.flush()

    def say(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.stack[-1][4]:
                self.links += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                _, path, out, doubt, _ = self.stack[-1]
                self.blocks.append(Block(path, text, out, doubt, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def open(self, name: str, attributes: str) -> bool:
        """Whether the element is left open."""
        if name in BLOCK:
            self.flush()
            # A block ends an open paragraph, also with inline elements left open in it.
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in CLOSED_BY_BLOCK and name != "br":
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCK:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == name:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        marks: set[str] = set()
        plain = False
        label, gone = name, False
        for a in ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id") and value:
                label += ("." if key == "class" else "#") + UNLIKE.sub("_", NUMERALS.sub("0", " ".join(value.split())))
            if key == "hidden" or key == "aria-hidden" and value == "true":
                gone = True
            elif key != "aria-hidden":
                names = value.split()
                marks.update(w for v in names for w in SPLIT_MARK.split(v.lower()))
                plain = plain or name not in RUNNING and not PLAIN_MARKS.isdisjoint(v.lower() for v in names)
        _, path, out, doubt, linked = self.stack[-1]
        path = f"{path}>{label}"
        self.paths[path] += 1
        if name in VOID or attributes.endswith("/") and name not in BLOCK | RAW:
            return False
        if name in ("article", "main", "body", "html"):
            marks &= OF_READERS
            plain = plain and not PLAIN_MARKS.isdisjoint(marks)
        out = out or gone or name in LEFT_OUT or plain
        doubt = doubt or (path if marks & (MARKS | PLAIN_MARKS) else "")
        if name in RAW or (out, doubt) != self.stack[-1][2:4]:
            self.flush()
        self.stack.append((name, path, out, doubt, linked or name == "a"))
        return True

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                if name in BLOCK or self.stack[k][2:4] != self.stack[k - 1][2:4]:
                    self.flush()
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "main", "body", "table", "ul", "ol") and name not in BLOCK:
                return


def text_token(path: str, text: str) -> str:
    return f"{path}={xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def above(path: str) -> str:
    return path.rpartition(">")[0]


def name_of(path: str) -> str:
    return re.split(r"[.#]", path.rpartition(">")[2], maxsplit=1)[0]


def densest(weights: dict[str, int], once: Iterable[str]) -> str:
    """Of the elements opened `once`, the deepest that holds DENSE of all weight (by path, of the text
    right in it), or the article or main around it; none if nothing weighs."""
    total, held = sum(weights.values()), Counter()
    for path, w in weights.items():
        while path:
            held[path] += w
            path = above(path)
    once = set(once)
    fit = [p for p in once if total and name_of(p) in CONTAINERS and held[p] >= DENSE * total]
    found = best = max(fit, key=lambda p: (p.count(">"), p), default="")
    while found:
        if name_of(found) in ("article", "main") and found in once:
            return found
        found = above(found)
    return best


def within(blocks: list[Block], slot: str) -> list[Block]:
    return [b for b in blocks if b.path == slot or b.path.startswith(slot + ">")] if slot else blocks


def size(blocks: list[Block]) -> int:
    return sum(len(b.text) - b.links for b in blocks)


def main_text(page: Page, slot: str, doubted: frozenset[str], texts: frozenset[str]) -> str:
    """A page's main text by its host's template: the article's slot, elements in doubt that it has
    (doubted) and texts that it has."""

    def settled(blocks: list[Block], narrow: bool) -> list[Block]:
        share = Counter(), Counter()
        for b in blocks:
            share[0][b.doubt] += b.links
            share[1][b.doubt] += len(b.text)
        return [b for b in blocks if not b.doubt or narrow and slot_holds(b.doubt) and b.doubt not in doubted and 2 * share[0][b.doubt] <= share[1][b.doubt]]

    def slot_holds(path: str) -> bool:
        return path.startswith(slot + ">")

    blocks = [b for b in page.blocks if not b.out]
    own = [b for b in blocks if text_token(b.path, b.text) not in texts]
    sure = [b for b in own if not b.doubt]
    if not slot or size(within(sure, slot)) < HELD * size(sure):
        weights = Counter()
        for b in sure:
            weights[b.path] += len(b.text) - b.links
        slot = densest(weights, (p for p, n in page.paths.items() if n == 1))
    narrow = bool(slot) and name_of(slot) not in ("html", "body")
    found, all_found = within(own, slot), within(blocks, slot)
    if size(found) < LEFT * size(all_found):
        found = all_found
    return " ".join(b.text for b in settled(found, narrow))


def _pages(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"), host.alias("_host"), F.xxhash64("page_id", "url", "html").alias("_page"))


def page_tokens(html: str) -> dict[str, tuple[int, int, bool]]:
    """Of each token of a page: how often it occurs, the characters of its text that weigh, and whether
    it is an element in doubt."""
    page = Page(html)
    out = {path: [n, 0, False] for path, n in page.paths.items()}
    for b in page.blocks:
        if b.doubt:
            out[b.doubt][2] = True
        if not b.out:
            t = out.setdefault(text_token(b.path, b.text), [0, 0, False])
            t[0] += 1
            if not b.doubt:
                for x in (t, out[b.path]) if b.path else (t,):
                    x[1] += len(b.text) - b.links
    return {t: tuple(x) for t, x in out.items()}


def template_classes(pages: DataFrame) -> DataFrame:
    """_host, class_id, pages, n, support, tokens (array<struct<token, chars, doubt>>): the template of
    each host.

    A class is valid if it is found on SUPPORT of the host's pages at least, and on LEAST_PAGES at
    least or on all of them. n counts each token's occurrences; chars its text that weighs.
    """

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"_host": [], "_page": [], "token": [], "n": [], "chars": [], "doubt": []}
            for host, page, html in zip(batch.column("_host").to_pylist(), batch.column("_page").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                tokens = page_tokens(html)
                out["_host"] += [host] * len(tokens)
                out["_page"] += [page] * len(tokens)
                out["token"] += tokens
                for c, values in zip(("n", "chars", "doubt"), zip(*tokens.values(), strict=True) if tokens else ((), (), ()), strict=True):
                    out[c] += values
            return out | {"doubt": pa.array(out["doubt"], pa.bool_())}

        return run

    source = _pages(pages)
    rows = map_batches(source.select("_host", "_page", "_html"), "_host string, _page long, token string, n long, chars long, doubt boolean", make)
    # Partial sums go over the network: one row for each token and task. Halves cannot overflow.
    sums = [F.sum(f(h)).alias(f"_{name}") for k in (0, 1) for h in [F.xxhash64(F.lit(k), "_page", "n")] for name, f in ((f"lo{k}", lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (f"hi{k}", lambda h: F.shiftrightunsigned(h, 32)))]
    tokens = rows.groupBy("_host", "token").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("doubt").alias("doubt"), *sums)
    total = source.groupBy("_host").agg(F.count("*").alias("_total"))
    tokens = tokens.join(total, "_host").where((F.col("pages") >= SUPPORT * F.col("_total")) & ((F.col("pages") >= LEAST_PAGES) | (F.col("pages") == F.col("_total"))))
    vector = ["pages", "n", "_lo0", "_hi0", "_lo1", "_hi1"]
    classes = tokens.groupBy("_host", *vector).agg(F.sort_array(F.collect_list(F.struct("token", "chars", "doubt"))).alias("tokens"), F.max(F.col("pages") / F.col("_total")).alias("support"))
    return classes.select("_host", F.xxhash64(*vector).alias("class_id"), "pages", "n", "support", "tokens")


def nested_classes(classes: DataFrame) -> DataFrame:
    """classes with parent_id: the class that holds the path right above a class's shortest path (an
    element is never without the one around it, so that path is in the template), null at the root."""
    path = lambda t: F.substring_index(t, "=", 1)
    top = F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct(F.length(t["token"]).alias("n"), path(t["token"]).alias("path")))), 1)["path"]
    inner = classes.withColumn("_above", F.regexp_replace(top, ">[^>]*$", ""))
    paths = classes.select("_host", F.col("class_id").alias("parent_id"), F.explode("tokens.token").alias("_above")).where(~F.col("_above").contains("="))
    return inner.join(paths, ["_host", "_above"], "left").drop("_above")


def host_template(classes: list[dict]) -> tuple[str, list[str], list[str]]:
    """(slot, doubted, texts) of a host's nested classes. Elements opened once on a page bound slots if
    the classes around theirs are opened once too."""
    by_id = {c["class_id"]: c for c in classes}

    known: dict[int, bool] = {}

    def once(c: dict) -> bool:
        """Whether a class is opened once on each of its pages, and all those around it."""
        chain: list[int] = []
        while c is not None and c["class_id"] not in known and c["class_id"] not in chain[-1:]:
            chain.append(c["class_id"])
            known[c["class_id"]] = c["n"] == c["pages"]
            c = by_id.get(c["parent_id"])
        whole = c is None or known[c["class_id"]]
        for i in reversed(chain):
            whole = known[i] = known[i] and whole
        return whole

    weights, opened, doubted, texts = Counter(), [], [], []
    for c in classes:
        single = once(c)
        for t in c["tokens"]:
            path, _, text = t["token"].partition("=")
            if text:
                if c["pages"] >= LEAST_PAGES:
                    texts.append(t["token"])
                    weights[path] -= t["chars"]
                continue
            weights[path] += t["chars"]
            opened += [path] if single else []
            doubted += [path] if t["doubt"] and c["pages"] >= LEAST_PAGES else []
    return densest({p: max(w, 0) for p, w in weights.items()}, opened), doubted, texts


def host_templates(pages: DataFrame) -> DataFrame:
    """_host, slot, doubted, texts. A host's template has at most 1 / SUPPORT times an average page's
    tokens, so that it fits in a row."""
    nested = nested_classes(cut(template_classes(pages), "classes"))
    hosts = nested.groupBy("_host").agg(F.collect_list(F.struct("class_id", "parent_id", "pages", "n", "tokens")).alias("classes"))

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            got = [host_template(c) for c in batch.column("classes").to_pylist()]
            return {"_host": batch.column("_host"), "slot": [g[0] for g in got], "doubted": pa.array([g[1] for g in got], pa.list_(pa.string())), "texts": pa.array([g[2] for g in got], pa.list_(pa.string()))}

        return run

    return map_batches(hosts, "_host string, slot string, doubted array<string>, texts array<string>", make)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text per row of pages: the text of the article's slot.

    Left out are elements that are plainly no main text (LEFT_OUT, PLAIN_MARKS, hidden ones), those
    that perhaps are none (MARKS) where the host's template has them, links fill them or no slot
    narrower than the body was found, and text that belongs to the host's template. A page whose host
    has no slot, or which has most of its text elsewhere, gets the slot of its own classes. White space
    in a block becomes one space, blocks are joined by one. Null html counts as empty, null urls as one
    host; repeated rows each give a row; an unclosed tag, comment or script reaches to where a browser
    would end it. Other columns are ignored.
    """
    templates = cut(host_templates(pages), "templates")
    rows = _pages(pages).join(templates, "_host", "left").select("page_id", "url", "_html", "slot", "doubted", "texts")
    kinds = dict(rows.dtypes)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            columns = [batch.column(c).to_pylist() for c in ("_html", "slot", "doubted", "texts")]
            out = [main_text(Page(html), slot or "", frozenset(doubted or ()), frozenset(texts or ())) for html, slot, doubted, texts in zip(*columns, strict=True)]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())}

        return run

    return map_batches(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string", make)
