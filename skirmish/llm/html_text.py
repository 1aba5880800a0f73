"""Main text of web pages, after removing what a site repeats on its pages.

Method (site template removal): each page is parsed into elements; the subtrees that could be template (containers, and
lists, tables and paragraphs of links only) are hashed with their text; Spark counts, per host, on how many distinct pages each hash
occurs; subtrees that recur on at least `MIN_PAGES` pages are deleted. Copies of a page count once, so repeated articles do not
look like a template, and neither paragraphs, lists and tables of text nor what holds half of the main text can be deleted.

Elements that are never main text go by their tag or role, so that small hosts are cleaned too; containers also by class or id,
if one whole name of it says so (`NAMES`, alone or with words of `PLACES`). Both spare what wraps the text: an element that
holds an article (outside another) or main element, a form or a named container with half of the page's text, and, for the
weaker names, sections with a heading of their own. Where a page has an article, the text is what is inside; where it has a
main element in which articles are the lesser part, all of that; without either, everything.

Counts use partial aggregates. Each page gets the recurring hashes of its own subtrees by a join on (host, hash of the page),
in which a page with many copies is dealt out; nothing is collected per host.

Defined cases: null or empty html gives an empty text; a page cut off anywhere is read as far as it goes; a null or
unreadable url counts as one host. Quotes in a tag open only after an equals sign; of an attribute given twice the first
counts. Repeated rows are all returned. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skirmish.llm.common import chunks, join_dealt, materialize, text_values

#: Distinct pages of a host from which on a subtree is its template.
MIN_PAGES = 8

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"\s+")
#: Fixed names of HTML: elements without content, with raw content, and those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
    title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of the page, whatever they hold; and what stands beside it, unless it wraps the text.
NEVER = frozenset("head script style noscript template iframe object svg canvas button select textarea title noembed noframes audio video".split())
BESIDE = frozenset("nav header footer aside form dialog menu search".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of classes and ids that mark what is not main text; the second set only without a heading inside; words that may stand beside either.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors cookie cookies consent gdpr popup modal
    overlay newsletter subscribe subscription signup paywall nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar sidebars masthead footer
    comment comments commentlist disqus""".split())
WEAK_NAMES = frozenset("""promo promos promotion banner banners notice notices alert menu menus toc aside widget widgets header reply replies respond share sharing
    social related recommended recommendations skip""".split())
PLACES = frozenset("""box bar block container wrapper wrap inner outer section list area button buttons link links left right top bottom site page main global
    primary secondary mobile desktop post row item items unit slot zone message panel form""".split())
#: Elements that a name can mark.
NAMED = frozenset("div section ul ol dl table details figure center".split())
#: Elements whose subtrees can be template; and those that can if they hold links only.
CONTAINERS = frozenset("nav header footer aside section div form".split())
LINKS = frozenset("p ul ol dl table".split())
CLOSED_BY = {"li": ("li", frozenset({"ul", "ol", "menu"})), "dt": ("dt dd", frozenset({"dl"})), "dd": ("dt dd", frozenset({"dl"})),
             "tr": ("tr td th", frozenset({"table"})), "td": ("td th", frozenset({"table", "tr"})), "th": ("td th", frozenset({"table", "tr"})),
             "option": ("option", frozenset({"select"}))}


def _named(tag: str, names: list[str]) -> str:
    """strong or weak if a whole name marks the element, else empty."""
    if tag == "article":
        return "strong" if any(n in ("comment", "comments", "reply") for n in names) else ""
    if tag not in NAMED:
        return ""
    found = ""
    for name in names:
        words = re.split(r"[_-]+", name)
        if all(w in NAMES or w in WEAK_NAMES or w in PLACES for w in words):
            if any(w in NAMES for w in words):
                return "strong"
            found = "weak" if any(w in WEAK_NAMES for w in words) else found
    return found


class Page:
    """Elements of a page and the pieces of text in them, from one pass over the markup."""

    def __init__(self, source: str):
        self.tags, self.parents, self.drops, self.names, self._beside = ["#"], [-1], [False], [""], [""]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, raw text
        self._stack, self._open, self._block = [0], Counter(), 0
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            start, end = m.span() if m else (n, n)
            if start > at:
                self.pieces.append((self._stack[-1], self._block, source[at:start]))
            at = end
            if m and (tag := m[2]):
                tag = tag.lower()
                if m[1]:
                    self._end(tag)
                    continue
                closed = end == n and source[end - 1] != ">"
                if closed:  # cut off inside a tag
                    break
                self._start(tag, m[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    at = close.start() if close else n
        self._hashes: list[int] | None = None
        if any(self._beside):
            self._drop_beside()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._block += 1
            if self._open["p"]:
                self._end("p")
        if tag == "br":
            self.pieces.append((self._stack[-1], self._block, " "))
        if tag in CLOSED_BY:
            names, inside = CLOSED_BY[tag]
            for e in reversed(self._stack):
                if self.tags[e] in inside:
                    break
                if self.tags[e] in names.split():
                    self._end(self.tags[e])
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        names = f"{found.get('class', '')} {found.get('id', '')}".split() if found else []
        parent = self._stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.drops.append(self.drops[parent] or tag in NEVER or "hidden" in found or found.get("aria-hidden") == "true")
        self.names.append(found.get("class", ""))
        self._beside.append("tag" if tag in BESIDE or found.get("role") in BESIDE_ROLES else _named(tag, names) if names else "")
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1

    def _below(self) -> list[int]:
        """Characters of text below each element, of what is not dropped."""
        out = [0] * len(self.tags)
        for e, _, text in self.pieces:
            if not self.drops[e]:
                out[e] += len(text.strip())
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def _drop_beside(self) -> None:
        """Drops what stands beside the text: by tag and role first, then, by what is left, forms and named elements."""
        n = len(self.tags)
        wraps, within, headed = [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            within[e] = within[self.parents[e]] or self.tags[self.parents[e]] == "article"
        for e in range(n - 1, 0, -1):
            parent = self.parents[e]
            wraps[parent] = wraps[parent] or wraps[e] or self.tags[e] in ("article", "main") and not (self.drops[e] or within[e])
            headed[parent] = headed[parent] or headed[e] or self.tags[e] in HEADINGS
        for e in range(1, n):
            self.drops[e] = self.drops[e] or self.drops[self.parents[e]] or self._beside[e] == "tag" and self.tags[e] != "form" and not wraps[e]
        sizes = self._below()
        for e in range(1, n):
            named = self._beside[e] in ("strong", "tag") or self._beside[e] == "weak" and not headed[e]
            self.drops[e] = self.drops[e] or self.drops[self.parents[e]] or named and not wraps[e] and 2 * sizes[e] < sizes[0]

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._block += 1
        if not self._open[tag]:
            return
        while True:
            closed = self.tags[self._stack.pop()]
            self._open[closed] -= 1
            if closed == tag:
                return

    def _inside(self, want: str) -> list[bool]:
        inside = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            inside[e] = inside[self.parents[e]] or self.tags[e] == want and not self.drops[e]
        return inside

    def mains(self) -> list[bool]:
        """For each element, whether it is in the article, or in the main element where that holds more beside its articles, or else anywhere."""
        article, main = self._inside("article"), self._inside("main")
        if any(article) and any(main):
            size = lambda inside: sum(len(t.strip()) for e, _, t in self.pieces if inside[e] and not self.drops[e])
            return article if 2 * size(article) >= size(main) else main
        return article if any(article) else main if any(main) else [True] * len(self.tags)

    def sizes(self) -> list[int]:
        """Characters of text below each element."""
        out = [0] * len(self.tags)
        for e, _, text in self.pieces:
            out[e] += len(text)
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def hashes(self) -> list[int]:
        """A hash of each element's subtree: tags, classes and text."""
        if self._hashes is None:
            below: list[list] = [[] for _ in self.tags]
            for e, _, text in self.pieces:
                if text := _SPACE.sub(" ", text).strip():
                    below[e].append(text)
            out = [0] * len(self.tags)
            children: list[list[str]] = [[] for _ in self.tags]
            for e in range(len(out) - 1, -1, -1):
                out[e] = xxhash.xxh64_intdigest("\x1f".join((self.tags[e], self.names[e], *below[e], "\x1e", *reversed(children[e])))) - (1 << 63)
                if e:
                    children[self.parents[e]].append(str(out[e]))
            self._hashes = out
        return self._hashes

    def candidates(self) -> list[int]:
        """Elements that could be template: containers, and lists, tables and paragraphs of links only, with less than half of the main text."""
        sizes, inside = self.sizes(), self.mains()
        plain = [0] * len(self.tags)  # characters outside links
        for e, _, text in self.pieces:
            if self.tags[e] != "a":
                plain[e] += len(text.strip())
        for e in range(len(plain) - 1, 0, -1):
            if self.tags[e] != "a":
                plain[self.parents[e]] += plain[e]
        top = [e for e in range(1, len(self.tags)) if inside[e] and not inside[self.parents[e]]]
        limit = sum(sizes[e] for e in top) / 2 if top else sizes[0] / 2
        return [e for e in range(1, len(self.tags)) if (self.tags[e] in CONTAINERS or self.tags[e] in LINKS and not plain[e]) and 0 < sizes[e] < limit]

    def text(self, templates: frozenset[int] = frozenset()) -> str:
        dropped, inside = list(self.drops), self.mains()
        if templates:
            hashes, could = self.hashes(), set(self.candidates())
            for e in range(1, len(dropped)):
                dropped[e] = dropped[e] or dropped[self.parents[e]] or e in could and hashes[e] in templates
        blocks: dict[int, list[str]] = {}
        for e, block, piece in self.pieces:
            if inside[e] and not dropped[e]:
                blocks.setdefault(block, []).append(piece)
        lines = (_SPACE.sub(" ", entities.unescape("".join(p))).strip() for p in blocks.values())
        return "\n".join(line for line in lines if line)


def _rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), source.alias("html"), host.alias("host"),
                        F.xxhash64(source, host).alias("page"))


def site_templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(page, templates): the recurring hashes among the subtrees of each distinct page that has any; and (page, n), the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            found = [Page(h) for h in text_values(batch["html"])]
            content = [xxhash.xxh64_intdigest(p.text()) - (1 << 63) for p in found]
            hashes = [sorted({p.hashes()[e] for e in p.candidates()}) for p in found]
            yield pa.record_batch([batch["host"], batch["page"], pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page", "content", "hashes"])

    parsed = _rows(pages, key, url, html).select("host", "page", "html").mapInArrow(run, "host string, page long, content long, hashes array<long>")
    stored = materialize(parsed, "page-subtrees")
    subtrees = stored.select("host", "page", "content", F.explode("hashes").alias("hash")).distinct()
    recurring = subtrees.select("host", "hash", "content").distinct().groupBy("host", "hash").agg(F.count("*").alias("on")).filter(F.col("on") >= MIN_PAGES)
    matched = subtrees.join(recurring.select("host", "hash"), ["host", "hash"], "left_semi")
    templates = materialize(matched.groupBy("page").agg(F.collect_set("hash").alias("templates")), "site-templates")
    return templates, stored.groupBy("page").agg(F.count("*").alias("n"))


def main_texts(pages: DataFrame, templates: DataFrame, sizes: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [Page(h).text(frozenset(t or ())) for h, t in zip(text_values(batch["html"]), batch["templates"].to_pylist())]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = join_dealt(_rows(pages, key, url, html), templates, ["page"], sizes, "left")
    return joined.select("page_id", "url", "html", "templates").mapInArrow(run, "page_id long, url string, text string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    return main_texts(pages, *site_templates(pages, key, url, html), key, url, html)
