"""Main text of web pages by templates deduced from pages of the same host.

Every page is cut into tokens: elements told apart by their path of open elements
(with class and id), and whole blocks of text told apart by their path. Tokens of a
host with the same occurrence vector (how often each occurs on each page) form an
equivalence class; vectors are compared by a sum of hashes of (page, count), so they
are aggregated like any sum, combined before the shuffle, and a host with a third of
all pages costs no task more than another. Classes on at least half of a host's
pages, with an element, are valid. Their elements, each within the nearest one around it,
are the template; what stands in an element and not in one within it is the element's slot.
Text blocks of valid classes are the template's constant text; a slot without any other
text is constant itself. The template of a page is walked from the element that holds the
article (told by its name, else the innermost that holds all text): the text of slots is
extracted, constant text and slots are not, inside the article as well, nor is chrome
(menus, headers, footers, sidebars, notices, adverts, forms, comments), by which slots are
labelled. A page that lacks its host's article element is its own template; a page with
constant text alone keeps it.

Defined results: null or empty html gives an empty text; pages without a url form a
host of their own; repeated rows count each; a comment that never closes is read to the end
of the page; where no > follows, the rest is text; a tag whose quotes never close ends at
its first >, and so do those after it; elements are told apart by their outermost ``DEEPEST``
ancestors, and by a checksum of names above ``LONGEST_NAME`` characters; further columns are
ignored. Pages are read in one forward scan.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import settle

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[\"'>]")
DEEPEST = 256
LONGEST_NAME = 200
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
#: Paths at or below the article's element.
INSIDE = re.compile(r"/(?:article|main)(?=[#./]|$)")
# Elements by what they do to text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
CHROME_TAGS = frozenset(
    "head nav menu footer aside form fieldset script style noscript template button select option input textarea"
    " dialog iframe object svg canvas video audio map title".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices alert newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer header masthead comment comments reply replies respond disqus share sharing social related"
    " widget popup modal login signup search toolbar pagination pager copyright skip".split()
)
CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
CLOSED_BY |= {"tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
CLOSED_BY["option"] = frozenset(["option"])
SCOPE = frozenset("article main section div body html ul ol table nav aside header footer form dl blockquote".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Chrome outside the article alone: inside, they hold its headline.
HEADER_NAMES = frozenset("header masthead banner".split())


def chrome(tag: str, marks: set[str], names: set[str], inside_main: bool) -> bool:
    """marks: all words of class, id and role; names: their values as they stand.

    Inside the article one word of a name ('entry-header') is not enough."""
    if tag in CHROME_TAGS or tag == "header":
        return tag != "header" or not inside_main
    if inside_main:
        return tag not in ("article", "main") and not names.isdisjoint(CHROME_NAMES - HEADER_NAMES)
    return tag not in ("html", "body", "article", "main") and not marks.isdisjoint(CHROME_NAMES)


class Page:
    """elements: path -> (count, first position); blocks: (path, chrome, text) in page order."""

    def __init__(self, html: str):
        self.elements: dict[str, list[int]] = {}
        self.blocks: list[tuple[str, bool, str]] = []
        self._stack: list[tuple[str, str, bool]] = [("", "", False)]
        self._text: list[str] = []
        self._open_tags: Counter[str] = Counter()
        at, end, last = 0, len(html), html.rfind(">")
        quoted = True
        while at < end:
            lt = html.find("<", at)
            if lt < 0 or lt > last and not html.startswith("<!--", lt):
                self._text.append(html[at:])
                break
            if lt > at:
                self._text.append(html[at:lt])
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                at = close + 3 if close >= 0 else end
                continue
            if html[lt + 1] in "!?":
                at = html.find(">", lt) + 1
                continue
            m = TAG_NAME.match(html, lt + 1)
            if not m:
                self._text.append("<")
                at = lt + 1
                continue
            stop = self._tag_end(html, m.end()) if quoted else html.find(">", m.end())
            if stop < 0:
                quoted, stop = False, html.find(">", m.end())
            at = stop + 1
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, html[m.end() : stop])
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                self._pop(len(self._stack) - 1)
                at = end if not close or close.start() > last else html.find(">", close.start()) + 1
        self._flush()

    @staticmethod
    def _tag_end(html: str, at: int) -> int:
        """The > that closes a tag, not one in quotes; -1 if there is none."""
        while m := QUOTE_OR_END.search(html, at):
            if m[0] == ">":
                return m.start()
            if (at := html.find(m[0], m.end()) + 1) == 0:
                return -1
        return -1

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            self._text = []
            if text:
                _, path, out = self._stack[-1]
                self.blocks.append((path, out, text))

    def _pop(self, to: int) -> None:
        if to < len(self._stack):
            self._flush()
            self._open_tags.subtract(x[0] for x in self._stack[to:])
            del self._stack[to:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        marks: set[str] = set()
        names: set[str] = set()
        label = tag
        if "=" in attrs:
            for k, *v in MARKS.findall(attrs):
                value = next((x for x in v if x), "").lower()
                marks.update(NAME.findall(value))
                names.update(value.split())
                label += "#." [k.lower() == "class"] + DIGITS.sub("0", " ".join(sorted(value.split()))).replace("/", "_")
        _, path, out = self._stack[-1]
        inside = bool(INSIDE.search(path))
        if tag in INLINE and (names if inside else marks).isdisjoint(CHROME_NAMES):
            return
        if tag not in INLINE:
            self._flush()
            closes = CLOSED_BY.get(tag, frozenset())
            if tag in ENDS_P:
                closes |= {"p"}
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] in closes:
                    self._pop(k)
                    break
                if self._stack[k][0] in SCOPE:
                    break
        else:
            self._flush()
        if tag in VOID:
            return
        _, path, out = self._stack[-1]
        inside = bool(INSIDE.search(path))
        if len(label) > LONGEST_NAME:
            label = f"{tag}.{crc32(label.encode('utf-8', 'replace'))}"
        if len(self._stack) <= DEEPEST:
            path = f"{path}/{label}"
        seen = self.elements.setdefault(path, [0, len(self.elements)])
        seen[0] += 1
        out = out or chrome(tag, marks, names, inside)
        self._stack.append((tag, path, out))
        self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        for k in range(len(self._stack) - 1, 0, -1) if self._open_tags[tag] > 0 else ():
            if self._stack[k][0] == tag:
                self._pop(k)
                return
            if self._stack[k][0] in ("article", "main", "body") and tag not in ("html", "body"):
                break
        if tag not in INLINE:
            self._flush()

    def mass(self) -> Counter[str]:
        """Characters of text outside chrome under each path."""
        out: Counter[str] = Counter()
        for path, skip, text in self.blocks:
            if not skip:
                while path:
                    out[path] += len(text)
                    path = path[: path.rindex("/")]
        return out


def last(path: str) -> str:
    return path[path.rindex("/") + 1 :]


def article_slots(elements: dict[str, tuple[float, bool]]) -> list[str]:
    """Paths of the article's slots. elements: path -> (mass of text outside chrome, once a page)."""
    named = [p for p, (m, _) in elements.items() if m > 0 and re.match(r"(article|main)\b", last(p))]
    named = named or [p for p, (m, _) in elements.items() if m > 0 and re.search(r"#main\b", last(p))]
    if named:
        return [p for p in named if not any(p.startswith(q + "/") for q in named)]
    whole = max((m for m, _ in elements.values()), default=0)
    at = max((p for p, (m, once) in elements.items() if once and m == whole and m > 0), key=len, default="")
    return [at] if at else []


def around(path: str, elements) -> str:
    """The nearest of elements at or around a path; empty if there is none."""
    while path and path not in elements:
        path = path[: path.rindex("/")]
    return path


def deduce(tokens: list[dict]) -> str:
    """The template of a host as JSON: the article's elements, those of them whose slot
    varies, and constant text.

    tokens: path, block (hash of a text block, or null), vector, pages, total, mass."""
    classes: dict[int, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["vector"]].append(t)
    valid = [t for m in classes.values() if any(t["block"] is None for t in m) for t in m]
    elements = {t["path"]: (t["mass"], t["total"] == t["pages"]) for t in valid if t["block"] is None}
    constant = [t for t in valid if t["block"] is not None]
    # Varying text of an element's slot: all in it, less constant text, less what nests in it.
    varying = {p: m for p, (m, _) in elements.items()}
    for t in constant:
        at = t["path"]
        while at := around(at, elements):
            varying[at] -= t["mass"]
            at = at[: at.rindex("/")]
    own = dict(varying)
    for p in elements:
        if parent := around(p[: p.rindex("/")], elements):
            own[parent] -= varying[p]
    roots = article_slots(elements)
    inside = sorted(p for p in elements if within(p, roots))
    return json.dumps(
        {
            "roots": roots,
            "elements": inside,
            "slots": [p for p in inside if own[p] > 0],
            "constant": [[t["path"], t["block"]] for t in constant],
        }
    )


class Template:
    def __init__(self, x: dict):
        self.roots = tuple(x["roots"])
        self.elements, self.slots = frozenset(x["elements"]), frozenset(x["slots"])
        self.constant = frozenset((p, b) for p, b in x["constant"])

    def extracts(self, path: str, text: str) -> bool:
        varies = around(path, self.elements) in self.slots
        return varies and (path, crc32(text.encode("utf-8", "replace"))) not in self.constant


@functools.lru_cache(maxsize=4096)
def template(text: str) -> Template:
    return Template(json.loads(text))


def within(path: str, slots: tuple[str, ...] | list[str]) -> bool:
    return any(path == s or path.startswith(s + "/") for s in slots)


def main_text(html: str, tree: str | None) -> str:
    page = Page(html)
    host = template(tree) if tree else None
    if host and any(r in page.elements for r in host.roots):
        kept = [(path, text) for path, skip, text in page.blocks if not skip and within(path, host.roots)]
        own = [text for path, text in kept if host.extracts(path, text)]
        return "\n".join(own or [text for _, text in kept])
    mass = page.mass()
    roots = article_slots({p: (mass[p], c == 1) for p, (c, _) in page.elements.items()})
    return "\n".join(text for path, skip, text in page.blocks if not skip and (not roots or within(path, roots)))


TOKEN = "host string, path string, block long, vector decimal(38,0), pages long, total long, mass long"
FLUSH = 200_000


def page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page hash, html) -> tokens with what they add to their sums, combined."""
    from decimal import Decimal

    sums: dict[tuple[str, str, int | None], list[int]] = {}
    kinds = [pa.string(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in TOKEN.split(", ")]

    def out() -> pa.RecordBatch:
        rows = [(*k, Decimal(v[0]), *v[1:]) for k, v in sums.items()]
        sums.clear()
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def add(host: str, path: str, block: int | None, row: int, count: int, mass: int) -> None:
        s = sums.setdefault((host, path, block), [0, 0, 0, 0])
        for i, v in enumerate((hash((row, count)) & (1 << 62) - 1, 1, count, mass)):
            s[i] += v

    for batch in batches:
        for host, row, html in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(html or "")
            mass = page.mass()
            for path, (count, _) in page.elements.items():
                add(host, path, None, row, count, mass[path])
            texts = Counter((p, t) for p, skip, t in page.blocks if not skip)
            for (path, text), count in texts.items():
                add(host, path, crc32(text.encode("utf-8", "replace")), row, count, len(text) * count)
            if len(sums) > FLUSH:
                yield out()
    yield out()


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]*)", 1)), F.lit(""))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """pages (host, row, html) -> (host, template)."""
    sums = ("vector", "pages", "total", "mass")
    tokens = settle(
        pages.select("host", "row", "html")
        .mapInArrow(page_tokens, TOKEN)
        .groupBy("host", "path", "block")
        .agg(*(F.sum(c).cast("decimal(38,0)" if c == "vector" else "long").alias(c) for c in sums)),
        "tokens",
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    # Tokens on half of the pages: at most twice as many as one page has.
    common = (
        tokens.join(sizes, "host")
        .where((F.col("pages") >= 2) & (2 * F.col("pages") >= F.col("n_pages")))
        .groupBy("host")
        .agg(F.collect_list(F.struct("path", "block", F.xxhash64("vector").alias("vector"), "pages", "total", "mass")).alias("tokens"))
    )

    def build(tokens: pa.Array) -> pa.Array:
        return pa.array([deduce(t) for t in tokens.to_pylist()], pa.string())

    return settle(common.select("host", F.arrow_udf(build, "string")("tokens").alias("template")), "templates")


def extract(
    pages: DataFrame,
    broadcast_bytes: int = 32 << 20,
    salts: int = 32,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col(key).alias("page_id"),
        F.col(url).alias("url"),
        host_of(F.col(url)).alias("host"),
        F.xxhash64(key, url).alias("row"),
        F.col(html).alias("html"),
    )
    trees = deduce_templates(rows)
    total = trees.agg(F.sum(F.octet_length("template") + F.octet_length("host") + 32)).first()[0] or 0
    if total <= broadcast_bytes:
        joined = rows.join(F.broadcast(trees), "host", "left")
    else:  # salted, so that a hot host's pages are spread
        spread = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def text_of(html: pa.Array, tree: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py() or "", t.as_py()) for h, t in zip(html, tree)], pa.string())

    return joined.select("page_id", "url", F.arrow_udf(text_of, "string")("html", "template").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
