"""Main text of web pages: markup roles, and a host suffix array for what markup leaves open.

A page is cut into blocks, each with a role. Blocks inside ``article`` or ``main`` are the main text; blocks of menus,
headers, footers, sidebars, notices, adverts, forms and comments (by element, ARIA role or class name) are
furniture. A page without a marked main text has open blocks instead. Those are decided by repetition
on their host: the token streams of pages (everything outside marked main text) are concatenated,
a suffix array over the streams gives the substrings of ``MIN_RUN`` tokens and more that occur on distinct pages
of one host, and open blocks covered by such substrings are boilerplate; the unique runs stay.

One array over a whole host would not fit a task where a host holds a third of all pages. So tasks build arrays
over blocks of pages as they come (the host is part of every token). Each array hands on one row for every class of suffixes with equal
first ``MIN_RUN`` tokens: its hash, its least and greatest page core, its places. Classes of equal hash are merged over
all blocks by a shuffle of these pre-aggregated rows; a class with two different cores is repeated, and its
places are covered. This is the coverage that one array over the host gives, as any longer repeat consists of such starts.
A core is the hash of a page's longest open block: copies of one page count once, so an article is no boilerplate because it was copied.

Repetition never removes marked main text: an article may share passages with others.

Defined results: null or empty html gives '' and 0; html without text too; a page cut off in the middle is read as far as it goes; a null url
or one without host forms a host of its own name ''; repeated rows are pages of their own; an empty table gives
an empty table; other columns, whatever their names, are not looked at. The page is read whole, whatever its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_slices

MIN_RUN = 8               # tokens of the shortest repeat that counts
COVERED = 0.8             # an open block goes if repeats cover this share of its tokens
LINKED = 0.5              # an open block goes as a menu if links hold more than this share of its characters
ARRAY_TOKENS = 1 << 20    # tokens of one suffix array (one page at least)

MAIN, OPEN, FURNITURE = 0, 1, 2

# Element names by their part in a page.
RAW = "script style textarea title xmp iframe noembed noframes".split()
SILENT = set("head script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select "
             "datalist button input option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody tfoot "
             "thead tr ul".split())
FURNITURE_TAGS = set("nav aside footer form dialog menu search fieldset".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
# The words of class names and ids that mark furniture.
HINTS = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
            "newsletter subscribe subscription signup popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
            "masthead footer share sharing social related recommended recommendations pagination pager toolbar disclaimer".split())
COMMENTS = set("comment comments commentlist disqus respond replies".split())
WRAPPERS = set("has have with without no not is js".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"                                            # comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"   # tag; quoted values may hold >
    r"|<[!?/][^>]*+(?:>|\Z)",                                                  # doctype, instruction, bogus comment
    re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend", "optgroup"}


class _Element:
    __slots__ = ("name", "zone", "silent", "link", "sticky")

    def __init__(self, name: str, zone: int, silent: bool, link: bool, sticky: bool):
        self.name, self.zone, self.silent, self.link, self.sticky = name, zone, silent, link, sticky


def _hinted(names: str) -> str | None:
    """'furniture' or 'comments' if a class name or id begins or ends with such a word."""
    found = None
    for name in names.split():
        words = [w.lower() for w in _WORDS(name)]
        if not words or WRAPPERS & set(words):
            continue
        if words[0] in COMMENTS or words[-1] in COMMENTS:
            return "comments"
        if words[0] in HINTS or words[-1] in HINTS:
            found = "furniture"
    return found


class PageReader:
    """Reads html into blocks of (text, zone, characters in links)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, bool]] = []   # text, zone, linked characters, in an article
        self.stack: list[_Element] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.hints: dict[str, str | None] = {}

    def _zone(self) -> int:
        return self.stack[-1].zone if self.stack else OPEN

    def _text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].silent):
            text = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.stack and self.stack[-1].link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((text, self._zone(), self.linked, any(e.name == "article" for e in self.stack)))
            self.pieces, self.linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        at = {}
        if attributes and not attributes.isspace():
            for k, *v in _ATTRIBUTE.findall(attributes):
                at.setdefault(k.lower(), entities.unescape(v[0] or v[1] or v[2]))
        if name in _CLOSES_P:
            self._close_to(("p",), stop=("button", "table"))
        if name == "li":
            self._close_to(("li",), stop=("ul", "ol", "menu", "dir"))
        elif name in ("dt", "dd"):
            self._close_to(("dt", "dd"), stop=("dl",))
        elif name == "tr":
            self._close_to(("tr",), stop=("table",))
        elif name in ("td", "th"):
            self._text(" ")
        elif name == "body":
            self._close_to(("head",), stop=())
        if name in BLOCKS:
            self._flush()
        if name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        self.stack.append(self._element(name, at))

    def _element(self, name: str, at: dict[str, str]) -> _Element:
        up = self.stack[-1] if self.stack else _Element("", OPEN, False, False, False)
        role = at.get("role", "").lower()
        main = name in ("article", "main") or role in ("main", "article") or "articleBody" in at.get("itemprop", "")
        key = f"{at.get('class', '')} {at.get('id', '')}"
        if key not in self.hints:
            self.hints[key] = _hinted(key) if key != " " else None
        hint = self.hints[key]
        hidden = "hidden" in at and at["hidden"].lower() != "until-found" or bool(_HIDDEN.search(at.get("style", "")))
        silent = up.silent or name in SILENT or hidden
        zone, sticky = up.zone, up.sticky
        if name in ("html", "body"):
            hint = None
        if main and hint != "comments" and not sticky:
            zone = MAIN                                     # also inside a menu that was never closed, or a hinted wrapper
        elif hint == "comments" or name in ("aside", "footer") or role in ("complementary", "contentinfo"):
            zone, sticky = FURNITURE, True                  # an article in here is a teaser or a comment
        elif name in FURNITURE_TAGS or role in FURNITURE_ROLES or hint == "furniture" or name == "header" and zone != MAIN:
            sticky = sticky or bool(re.search(r"sidebar|widget|related|recommend", key, re.I)) and not main
            zone = FURNITURE
        return _Element(name, zone, silent, up.link or name == "a", sticky)

    def _close_to(self, names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Close the nearest open element of ``names`` and all inside it, unless ``stop`` comes first."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k].name
            if name in names:
                self._flush()
                del self.stack[k:]
                return
            if name in stop or (name in BLOCKS and "p" in names and name != "p"):
                return

    def _close(self, name: str) -> None:
        if name == "br":
            self.pieces.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                if any(e.name in BLOCKS for e in self.stack[k:]):
                    self._flush()
                del self.stack[k:]
                return
            # an inline end tag does not close blocks around it
            if name not in BLOCKS and self.stack[k].name in BLOCKS and name not in SILENT:
                return

    def read(self, html: str) -> "PageReader":
        at = 0
        while True:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            self._text(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if not m[0].endswith(">"):
                break                                       # cut off inside a tag
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                at = len(html) if end is None else end.start()
        self._flush()
        return self


def page_blocks(html: str | None) -> list[tuple[str, int]]:
    """(text, zone) of a page's blocks. With marked main text no block is open: the rest is furniture."""
    blocks = PageReader().read(html or "").blocks
    main = [b for b in blocks if b[1] == MAIN]
    if main:
        inner = [b for b in main if b[3]]
        # ``main`` around one or more articles: the articles, unless they are the lesser part
        narrow = inner and 2 * sum(len(b[0]) for b in inner) >= sum(len(b[0]) for b in main)
        return [(b[0], MAIN if b[1] == MAIN and (b[3] or not narrow) else FURNITURE) for b in blocks]
    return [(t, FURNITURE if z == OPEN and links > LINKED * len(t) else z) for t, z, links, _ in blocks]


def read_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """uid, page_id, url, host, main (joined main blocks, null where the page has open blocks), open (texts of the open blocks),
    stream (texts outside the main text), is_open (for each text of the stream)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            main, stream, is_open = [], [], []
            for h in b.column("html").to_pylist():
                blocks = page_blocks(h)
                kept = [t for t, z in blocks if z == MAIN]
                any_open = not kept and any(z == OPEN for _, z in blocks)
                main.append(None if any_open else "\n\n".join(kept))
                stream.append([t for t, z in blocks if z != MAIN])
                is_open.append([z == OPEN for _, z in blocks if z != MAIN])
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("id"), b.column("url"), pa.array(main, pa.string()),
                 pa.array(stream, pa.list_(pa.string())), pa.array(is_open, pa.list_(pa.bool_()))],
                ["uid", "id", "url", "main", "stream", "is_open"])

    src = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
                       F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(read, f"uid long, id {kind}, url string, main string, stream array<string>, is_open array<boolean>")
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return out.withColumn("host", F.coalesce(host, F.lit("")))


def suffix_classes(tokens: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` sorted by their first ``run`` tokens, and where in it a new class of equal starts begins.
    Prefix doubling: ranks by 1, 2, 4, ... tokens, then by ``run`` as two overlapping halves."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    n, length = len(tokens), 1
    while length < run:
        step = min(length, run - length)
        later = np.zeros(n, np.int64)                      # 0: past the end
        later[:n - step] = rank[step:]
        key = rank * (n + 2) + later
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))


def _page_tokens(host: str, stream: list[str]) -> list[int]:
    start = xxhash.xxh3_64_intdigest(host)
    return [xxhash.xxh3_64_intdigest(w, seed=start) & 0x7FFFFFFFFFFFFFFF for t in stream for w in t.split()]


def repeat_classes(read: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """(start, low, high, uids, places): classes of suffixes of a block of pages that begin with the same ``run`` tokens on
    one host, with the least and greatest core of their pages, and where they are."""
    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: list[tuple[int, int, np.ndarray]] = []

        def array() -> pa.RecordBatch:
            size = np.array([len(t) for *_, t in pages], np.int64)
            # a page's end is a token that no other page has: no start goes beyond its page
            flat = np.concatenate([np.append(t, -1 - k) for k, (*_, t) in enumerate(pages)])
            page = np.repeat(np.arange(len(pages)), size + 1)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
            order, first = suffix_classes(flat, run)
            whole = (size[page] - place >= run)[order]       # starts that lie inside their page
            begins = np.zeros(len(order), np.int64)
            begins[first] = 1
            group = np.cumsum(begins)
            order, group = order[whole], group[whole]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            core = np.array([c for _, c, _ in pages], np.int64)[page[order]]
            uid = np.array([u for u, *_ in pages], np.int64)[page[order]]
            start = [xxhash.xxh3_64_intdigest(flat[i:i + run].tobytes()) - (1 << 63) for i in order[first].tolist()]
            off = pa.array(np.append(first, len(order)), pa.int32())
            low, high = (f.reduceat(core, first) if len(first) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))
            return pa.RecordBatch.from_arrays(
                [pa.array(start, pa.int64()), pa.array(low), pa.array(high), pa.ListArray.from_arrays(off, pa.array(uid)),
                 pa.ListArray.from_arrays(off, pa.array(place[order].astype(np.int32)))], ["start", "low", "high", "uids", "places"])

        held = 0
        for b in batches:
            for u, h, c, s in zip(*(b.column(k).to_pylist() for k in ("uid", "host", "core", "stream"))):
                pages.append((u, c, np.array(_page_tokens(h, s), np.int64)))
                held += len(pages[-1][2])
                if held >= ARRAY_TOKENS:
                    yield array()
                    pages.clear()
                    held = 0
        if pages:
            yield array()

    # the core: the longest open block, or without one the longest main text
    longest = F.array_max(F.transform(F.filter(F.arrays_zip("stream", "is_open"), lambda x: x["is_open"]),
                                      lambda x: F.struct(F.length(x["stream"]).alias("n"), x["stream"].alias("t"))))["t"]
    src = read.where(F.size("stream") > 0).select("uid", "host", F.xxhash64(F.coalesce("main", longest)).alias("core"), "stream")
    return src.mapInArrow(classes, "start long, low long, high long, uids array<long>, places array<int>")


def covered_places(classes: DataFrame) -> DataFrame:
    """(uid, places): starts of repeats on each page. A class has one row for each block of pages, so a
    start that a third of all pages share is no hot key."""
    repeated = classes.groupBy("start").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("start")
    at = classes.join(repeated, "start", "left_semi").select(F.explode(F.arrays_zip("uids", "places")).alias("x"))
    return at.groupBy(F.col("x.uids").alias("uid")).agg(F.collect_set("x.places").alias("covered"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    read = staged(read_pages(pages, id_col, url_col, html_col), "pages-read")
    open_ = read.where(F.col("main").isNull())
    classes = staged(repeat_classes(read), "page-suffixes")
    marks = covered_places(classes)

    def unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stream, is_open, covered in zip(*(b.column(c).to_pylist() for c in ("stream", "is_open", "covered"))):
                sizes = [len(t.split()) for t in stream]
                hit = np.zeros(sum(sizes) + 1, np.int64)
                starts = np.array(covered or [], np.int64)
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + MIN_RUN, -1)
                under = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
                cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                share = (under[cut[1:]] - under[cut[:-1]]) / np.maximum(1, sizes)
                out.append("\n\n".join(t for t, o, s in zip(stream, is_open, share.tolist()) if o and s < COVERED))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = read.schema["id"].dataType.simpleString()
    decided = open_.join(marks, "uid", "left").select("id", "url", "stream", "is_open", "covered").mapInArrow(
        unique_runs, f"id {kind}, url string, text string")
    marked = read.where(F.col("main").isNotNull()).select("id", "url", F.col("main").alias("text"))
    return marked.unionByName(decided).withColumnRenamed("id", "page_id")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (extract(table(spark, sf_dir, "pages"))
            .select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")))
