"""Main text of web pages, by removal of what a site repeats.

Pages are parsed twice.  The first pass hashes the subtree of each block element (its tag, the text and the subtrees in
it), so that Spark can count on how many distinct pages of its host a subtree stands.  The second pass gets the subtrees
that recur on many pages of the page's host, deletes them, and joins the text that is left.  What a page itself marks as
beside its text (navigation, footers, forms, scripts, advertisements, comments: see MARKED and WORDS) goes in either
pass.  Where a page has an ``article``, only that is its text, and there only containers (``div``, ``section``, lists,
tables) can be templates: a paragraph or heading that many articles share is text of each of them.

Counts are pre-aggregated by (host, subtree, page), so a host with a third of all pages is spread over as many keys as it
has subtrees.  The subtrees deleted on a host are at most as many as a page has, on the mean, divided by ``share``: their
counts add up to the subtrees of all its pages.  They are one row for each host, and AQE splits a hot host's pages, or
broadcasts the rows where they are small.

Defined results: null html is an empty text, as are pages without any text; a page whose url names no host has no
template; equal pages of a host count once, so copies do not make a template of their text.  White space is what
Python's str.split takes for it.  A header of an article keeps its headings only.  An unclosed element ends with the
element around it or with the page.  Null and repeated ids are returned as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
# Names of the HTML standard, and words that sites use for classes and ids of what is beside the text.
MARKED = frozenset("nav footer aside form script style template svg math iframe object canvas noscript button select dialog menu head title textarea audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup popup modal overlay paywall sidebar menu navbar nav navigation breadcrumb breadcrumbs masthead footer "
    "comment comments disqus respond reply replies share sharing social related recommended recommendations pagination pager toolbar skiplink".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre figure figcaption caption tr td th thead tbody tfoot br hr address summary details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag ends the open elements named here, up to the bounds named behind.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOUNDS = frozenset("td th caption table template html object".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>)|<[!?/][^>]*>", re.S)
UNFINISHED = re.compile(r"<[a-zA-Z!?/]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
PART = re.compile(r"[a-z]+")
#: A name that starts so says what an element has beside it, not what it is ("with-sidebar").
BESIDE = frozenset("has have with without no not is".split())
#: Open elements at most; further ones are taken as siblings of the last.
DEPTH = 512


def traits(tag: str, rest: str) -> tuple[bool, bool, bool]:
    """(whether an element says of itself that it is beside the text, is a header, is the main element)."""
    beside, header, main = tag in MARKED, tag == "header", tag == "main"
    if len(rest) > 5 and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                beside = True
            elif name == "role":
                beside, main, header = beside or value in ROLES, main or value == "main", header or value == "banner"
            elif name in ("class", "id"):
                for one in value.split():
                    words = PART.findall(one)
                    if words and words[0] not in BESIDE:
                        beside, header = beside or not WORDS.isdisjoint(words), header or "header" in words
    return beside, header, main


class Page:
    """The text pieces of a page, and its block elements as ranges of them."""

    def __init__(self, html: str):
        #: (text, whether it stands in an article, in a main element); None is the border of a block.
        self.pieces: list[tuple[str, bool, bool] | None] = []
        #: (first piece, piece behind the last, hash) of each subtree that may be a template.
        self.elements: list[tuple[int, int, int]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        # An open element: tag, first piece, beside the text, in an article, in main, in an article's header, tokens of its subtree.
        stack = [("", 0, False, False, False, False, [])]
        pieces, at, n = self.pieces, 0, len(html)

        def text(t: str) -> None:
            top = stack[-1]
            if top[2] or (top[5] and not any(e[0] in HEADINGS for e in stack)):
                return
            pieces.append((t, top[3], top[4]))
            top[6].append(t)

        def close(k: int) -> None:
            while len(stack) > k:
                tag, first, beside, art, _, _, tokens = stack.pop()
                if tag in INLINE:
                    stack[-1][6].extend(tokens)
                    continue
                pieces.append(None)
                if not beside and any(isinstance(t, int) or not t.isspace() for t in tokens):
                    shape = hash_of(tag, tokens)
                    stack[-1][6].append(shape)
                    if templated(tag, art):
                        self.elements.append((first, len(pieces), shape))

        def opened(tags, bounds) -> int:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in bounds:
                    return 0
            return 0

        while at < n:
            m = TAG.search(html, at)
            if m is None:
                cut_off = UNFINISHED.search(html, at)
                text(html[at : cut_off.start() if cut_off else n])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br" or tag not in INLINE:
                    pieces.append(None)  # a border, also where it closes nothing
                k = opened((tag,), ("table", "template") if tag in TABLE else BOUNDS)
                if k and not (tag in FORMATTING and any(e[0] not in INLINE for e in stack[k + 1 :])):  # else its blocks stay open
                    close(k)
                continue
            rest = m[3]
            if tag == "br" or tag not in INLINE:
                pieces.append(None)
            if tag in VOID or (rest.endswith("/>") and any(e[0] in ("svg", "math") for e in stack)):
                continue
            if tag not in INLINE and tag not in RAW and (k := opened(("p",), BOUNDS | {"button"})):
                close(k)
            if tag in ENDS and (k := opened(*ENDS[tag])):
                close(k)
            if len(stack) >= DEPTH:
                if tag in INLINE:
                    continue
                close(DEPTH - 1)
            top = stack[-1]
            beside, header, main = traits(tag, rest)
            beside = top[2] or ((beside or header) and not (header and top[3] and tag not in MARKED))
            art = top[3] or (tag == "article" and not beside)
            stack.append((tag, len(pieces), beside, art, top[4] or (main and not beside), top[5] or (header and top[3]), []))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else n
        close(1)

    def subtrees(self) -> set[int]:
        return {shape for _, _, shape in self.elements}

    def text(self, gone: frozenset = frozenset()) -> str:
        """The text, without the subtrees of these hashes."""
        pieces = self.pieces
        if gone:
            pieces = list(pieces)
            for first, last, shape in self.elements:
                if shape in gone:
                    pieces[first:last] = [None] * (last - first)
        for place in (1, 2, None):
            here = [None if p is None or (place and not p[place]) else p for p in pieces]
            if place is None or any(p and p[0].strip() for p in here):
                return " ".join("".join(" " if p is None else unescape_piece(p[0]) for p in here).split())
        return ""


def unescape_piece(t: str) -> str:
    return unescape(t) if "&" in t else t


def templated(tag: str, in_article: bool) -> bool:
    return tag not in ("html", "body", "main", "article") and not (in_article and tag in PARAGRAPHS)


def hash_of(tag: str, tokens: list) -> int:
    """63 bits of a subtree: white space counts as one blank; never 0, which stands for the page itself."""
    import xxhash

    words = "\x00".join(str(t) if isinstance(t, int) else " ".join(t.split()) for t in tokens)
    return (xxhash.xxh3_64_intdigest(f"{tag}\x01{words}".encode("utf-8", "replace")) >> 1) or 1


def host_of(url):
    """Host of a url in lower case, null where it names none."""
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def template_counts(pages: DataFrame) -> DataFrame:
    """(host, subtree, n): on how many distinct pages of its host each subtree stands; subtree 0 counts the pages."""

    def hashes(batches):
        import xxhash

        for b in batches:
            which, subtree, page = [], [], []
            for i, html in enumerate(b.column(1).to_pylist()):
                p = Page(html or "")
                found = [0, *p.subtrees()]
                which += [i] * len(found)
                subtree += found
                page += [xxhash.xxh3_64_intdigest(p.text().encode("utf-8", "replace")) >> 1] * len(found)
            yield pa.record_batch({"host": b.column(0).take(pa.array(which, pa.int64())), "subtree": pa.array(subtree, pa.int64()), "page": pa.array(page, pa.int64())})

    rows = pages.filter("host IS NOT NULL").select("host", "html").mapInArrow(hashes, "host string, subtree long, page long")
    return rows.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))


def templates(pages: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, gone): hashes of the subtrees that recur on at least min_pages and this share of the host's distinct pages."""
    counts = cut(template_counts(pages).filter(f"subtree = 0 OR n >= {min_pages}"))
    total = counts.filter("subtree = 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("subtree <> 0").join(total, "host").filter(F.col("n") >= F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_list("subtree").alias("gone"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 3, share: float = 0.3) -> DataFrame:
    """(id_col, url_col, text, n_chars long), one row for each page."""
    if min_pages < 2 or not 0 < share <= 1:
        raise ValueError("min_pages must be 2 or more, share in (0, 1]")
    if {id_col, url_col} & {"text", "n_chars"} or id_col == url_col:
        raise ValueError("the id and the url need names other than text and n_chars")
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    gone = cut(templates(rows, min_pages, share))
    if gone.isEmpty():
        joined = rows.withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        joined = rows.join(gone, "host", "left")
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def texts(batches):
        for b in batches:
            out = [Page(html or "").text(frozenset(gone or ())) for html, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))], names=["id", "url", "text", "n_chars"])

    return joined.select("id", "url", "html", "gone").mapInArrow(texts, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
