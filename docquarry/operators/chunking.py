"""Sections, tables, parents and children of long markup documents, with exact code-point spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.session import ship_package

MAX_PARENT, MAX_CHILD, HARD_CHILD = 4000, 800, 1600

#: The item numbers of an annual report, and titles that stand for an item without its number.
ITEMS = "1 1A 1B 1C 2 3 4 5 6 7 7A 8 9 9A 9B 9C 10 11 12 13 14 15 16".split()
TITLES = {
    "Risk Factors": "1A",
    "Unresolved Staff Comments": "1B",
    "Cybersecurity": "1C",
    "Properties": "2",
    "Legal Proceedings": "3",
    "Mine Safety Disclosures": "4",
    "Management's Discussion and Analysis of Financial Condition and Results of Operations": "7",
    "Management's Discussion and Analysis": "7",
    "Quantitative and Qualitative Disclosures About Market Risk": "7A",
    "Quantitative and Qualitative Disclosures": "7A",
    "Financial Statements and Supplementary Data": "8",
    "Controls and Procedures": "9A",
}
#: How far a header's surroundings are looked at, and the letters that real prose after it must have.
LOOK_BACK, ANCHOR_BACK, TITLE_AHEAD, SKIP, WINDOW, LETTERS = 80, 400, 800, 200, 2000, 80
#: What may stand between an item's number and its title, spelled out or as an entity; spellings of white space; elements
#: that structure a page; font weights that mark a header.
SEPARATORS, DASHES = ".:-–—", frozenset("&#8212; &mdash; &#8211; &ndash;".split())
BLANK = r"(?:\s|&#160;|&nbsp;|&#x[Aa]0;)+"
STRUCTURE = frozenset("div p td tr li h1 h2 h3 h4 h5 h6 section article header footer main body table tbody thead tfoot".split())
HEAVY = ("700", "800", "900", "bold", "bolder")
_HEADERS = re.compile(rf"\b(?:(?i:item){BLANK}(?P<item>\d+[A-Za-z]?)|(?i:(?P<title>{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})))\b")
#: What a header begins with, in lower case; letters whose other case isn't what ``lower`` makes of them.
_BEGINS = ["item", *(x for x in map(str.lower, TITLES) if not any(x != y and x.startswith(y) for y in map(str.lower, TITLES)))]
_ODD = "\u0130\u0131\u017f\u212a"
_ITEM_OF = {title.lower(): item for title, item in TITLES.items()}
_WEIGHT = re.compile(rf"font-weight\s*[:=]\s*['\"]?(?:{'|'.join(HEAVY)})\b", re.I)
_TAG_NAME, _ENTITIES = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)?"), re.compile(r"&[^;\s<]{1,31};")
_HIDDEN = re.compile(r"<[^>]+>|&[^;]+;")  # in a window; over a whole document see ``_spans``
_SENTENCE = re.compile(r"[.!?]\s+")
#: Elements whose ends a parent may be cut at, and a child.
PARENT_ENDS, CHILD_ENDS = frozenset("p div td li tr table h1 h2 h3 h4 h5 h6".split()), frozenset("p div td li".split())

Counter = Callable[[int], int]


def default_tokens(chars: int) -> int:
    """Tokens of a slice by its length; a counter only needs lengths and grows with them, so that cuts are found by bisection."""
    return -(-chars // 4)


def _spans(html: str, ends: dict[str, str], least: int = 1) -> Iterator[tuple[int, int]]:
    """Spans from one of ``ends``' keys to its value, ``least`` characters between them, one after the other. An end that isn't found once is
    not looked for again, so that the whole is read in one pass."""
    opening, open_ = re.compile("|".join(map(re.escape, ends))), dict(ends)
    m = opening.search(html)
    while m and open_:
        at, end = m.end(), open_.get(m[0])
        stop = html.find(end, at + least) if end else -1
        if end and stop < 0:
            del open_[m[0]]
        if stop >= 0 and (least < 1 or not html.startswith(end, at)):
            yield m.start(), stop + len(end)
            at = stop + len(end)
        m = opening.search(html, at)


def blank_comments(html: str) -> str:
    """Comments become blanks of the same length, so that offsets stay. One that is never closed is text."""
    parts, at = [], 0
    for a, b in _spans(html, {"<!--": "-->"}, 0):
        parts += [html[at:a], " " * (b - a)]
        at = b
    return "".join(parts) + html[at:]


class Page:
    """A document read once: its tags in order, with what the places between them need to know about them. Tags inside comments have no
    name, so that they open and close nothing."""

    def __init__(self, html: str):
        self.html, self.bare = html, blank_comments(html)
        self.starts, self.ends, self.names, self.closing = [], [], [], []
        for a, b in _spans(html, {"<": ">"}):
            m = _TAG_NAME.match(html, a)
            self.starts.append(a)
            self.ends.append(b)
            self.names.append((m[2] or "").lower() if self.bare[a] == "<" else "")
            self.closing.append(m[1] == "/")

    @cached_property
    def hidden(self) -> tuple[list[int], list[int]]:
        """Where tags and entities begin and end."""
        spans = list(_spans(self.html, {"<": ">", "&": ";"}))
        return [a for a, _ in spans], [b for _, b in spans]

    def shows_letters(self, a: int, b: int, least: int) -> bool:
        """Whether at least ``least`` letters stand in [a, b) outside tags and entities. No more is read than that takes."""
        starts, ends = self.hidden
        i, n = bisect_right(ends, a), 0
        while a < b:
            stop = min(b, starts[i] if i < len(starts) else b)
            for lo in range(a, stop, 128):
                n += sum(map(str.isalpha, self.html[lo : min(lo + 128, stop)]))
                if n >= least:
                    return True
            a, i = (ends[i] if i < len(ends) else b), i + 1
        return n >= least

    @cached_property
    def links(self) -> list[int]:
        """For each tag, where the link that is open after it began, or -1. A link has attributes."""
        out, open_ = [], -1
        for a, b, name, closing in zip(self.starts, self.ends, self.names, self.closing):
            if name == "a":
                open_ = -1 if closing else a if b - a > 3 else open_
            out.append(open_)
        return out

    def before(self, at: int) -> int:
        """The last tag that ends at or before a place, -1 without one."""
        return bisect_right(self.ends, at) - 1

    def in_link(self, at: int) -> bool:
        """Whether a place is inside a link that began shortly before: an entry of a table of contents."""
        i = self.before(at)
        return i >= 0 and self.links[i] >= max(0, at - ANCHOR_BACK)

    def opens_block(self, at: int) -> bool:
        """Whether nothing but white space separates a place from the document's start, a comment's end, a structural tag, or one that sets
        a heavy weight. A structural tag that begins further back than what is looked at isn't one."""
        gap = self.html[max(0, at - LOOK_BACK) : at].rstrip()
        if not gap or gap.endswith("-->"):
            return True
        i = self.before(at)
        if i < 0 or self.html[self.ends[i] : at].strip():
            return False
        near = self.starts[i] >= at - LOOK_BACK
        return (near and self.names[i] in STRUCTURE) or bool(_WEIGHT.search(self.html, max(self.starts[i], at - LOOK_BACK), self.ends[i]))

    def prose(self, at: int) -> bool:
        """Whether enough letters stand in the window from a place on, outside tags and entities. What the window cuts in two isn't a tag
        or entity in it: such a window is read by itself."""
        starts, ends = self.hidden
        a, b = min(at, len(self.html)), min(at + WINDOW, len(self.html))
        for place in (a, b):
            i = bisect_right(ends, place)
            if i < len(starts) and starts[i] < place:
                return sum(map(str.isalpha, _HIDDEN.sub("", self.html[a:b]))) >= LETTERS
        return self.shows_letters(a, b, LETTERS)

    def seen(self, at: int, stop: int) -> Iterator[str]:
        """The characters that a reader sees from a place on, one by one; an entity counts as a dash or as a blank."""
        tag = self.before(at) + 1
        while at < min(stop, len(self.html)):
            if tag < len(self.starts) and self.starts[tag] <= at:
                at, tag = max(at, self.ends[tag]), tag + 1
                continue
            entity = _ENTITIES.match(self.html, at) if self.html[at] == "&" else None
            yield ("-" if entity[0] in DASHES else " ") if entity else self.html[at]
            at = entity.end() if entity else at + 1

    def titled(self, at: int) -> bool:
        """Whether a separator and then a capital are the first that is seen from a place on."""
        shown = (c for c in self.seen(at, at + TITLE_AHEAD) if not c.isspace())
        return next(shown, "") in tuple(SEPARATORS) and "A" <= next(shown, "") <= "Z"

    @cached_property
    def tables(self) -> list[tuple[int, int]]:
        """Outermost balanced tables; one that never closes is left to the narrative."""
        out, depth, first = [], 0, 0
        for i, name in enumerate(self.names):
            if name == "table" and not self.closing[i]:
                first = self.starts[i] if not depth else first
                depth += 1
            elif name == "table" and depth:
                depth -= 1
                if not depth:
                    out.append((first, self.ends[i]))
        return out

    def closes(self, names: frozenset[str]) -> list[int]:
        """Where elements of these names end, ascending."""
        return [b for b, n, c in zip(self.ends, self.names, self.closing) if c and n in names]

    @cached_property
    def parent_cuts(self) -> list[int]:
        return self.closes(PARENT_ENDS)

    @cached_property
    def child_cuts(self) -> list[int]:
        """Ends of sentences and of small elements. A full stop inside a tag ends no sentence."""
        ends = np.array([m.end() for m in _SENTENCE.finditer(self.html)], np.int64)
        tag = np.searchsorted(self.starts, ends, "left") - 1
        inside = (tag >= 0) & (ends < np.array([*self.ends, 0], np.int64)[tag])
        return np.union1d(ends[~inside], self.closes(CHILD_ENDS)).tolist()


def _headers(text: str) -> Iterator[re.Match]:
    """The matches of ``_HEADERS``, one after the other. The pattern is tried only where the beginning of a header stands."""
    low = text.lower()
    if len(low) != len(text) or any(c in text for c in _ODD):
        yield from _HEADERS.finditer(text)
        return
    places = []
    for begin in _BEGINS:
        at = low.find(begin)
        while at >= 0:
            places.append(at)
            at = low.find(begin, at + 1)
    end = 0
    for at in sorted(places):
        m = _HEADERS.match(text, at) if at >= end else None
        if m:
            yield m
            end = m.end()


def mentions(page: Page, items: list[str] = ITEMS) -> Iterator[tuple[str, int, int, bool]]:
    """(item, start, title's length, real) of every mention of an item by number (length 0) or by title. By number it is real if a title and
    prose follow; by title, if it opens a block outside links and prose follows. Unknown numbers come too, never real."""
    for m in _headers(page.bare):
        at, end = m.span()
        if m["item"]:
            item = m["item"].upper()
            yield item, at, 0, item in items and page.titled(end) and page.prose(at + SKIP)
        else:
            item = _ITEM_OF[m["title"].lower()]
            yield item, at, end - at, item in items and page.opens_block(at) and not page.in_link(at) and page.prose(end)


def item_candidates(page: Page, items: list[str] = ITEMS) -> list[tuple[str, int, bool]]:
    """(item, start, real) of every mention by number."""
    return [(item, at, real) for item, at, title, real in mentions(page, items) if not title]


def detect_sections(page: Page, items: list[str] = ITEMS) -> list[tuple[str, int, int]]:
    """(name, start, end) in order. An item begins at its best real mention: by number before by title, longer titles before shorter ones,
    then the first. What comes before the first header belongs to no section. Comments hold no headers."""
    best: dict[str, tuple[bool, int, int]] = {}
    for item, at, title, real in mentions(page, items):
        if real:
            best[item] = min(best.get(item, (True, 0, 0)), (title > 0, -title, at)) if item in best else (title > 0, -title, at)
    starts = sorted((at, item) for item, (_, _, at) in best.items())
    stops = [at for at, _ in starts[1:]] + [len(page.html)]
    return [(f"Item {item}", at, stop) for (at, item), stop in zip(starts, stops)]


def table_spans(html: str) -> list[tuple[int, int]]:
    return Page(html).tables


def _packed(cuts: list[int], start: int, end: int, most: int, tokens: Counter) -> list[tuple[int, int]]:
    """Greedy spans that tile [start, end), each up to the last of the ascending ``cuts`` that keeps it within ``most`` tokens, or to its
    first."""
    out, at = [], start
    while at < end:
        if tokens(end - at) <= most:
            return [*out, (at, end)]
        first = bisect_right(cuts, at)
        last = bisect_right(cuts, most, lo=first, key=lambda c: tokens(c - at)) - 1  # noqa: B023
        stop = cuts[max(last, first)] if first < len(cuts) and cuts[first] < end else end
        stop = min(stop, end)
        out.append((at, stop))
        at = stop
    return out


def pack(page: Page, start: int, end: int, most: int = MAX_PARENT, tokens: Counter = default_tokens) -> list[tuple[int, int]]:
    """Greedy spans that tile [start, end): cut at closing tags outside comments; an atom longer than ``most`` stays whole."""
    return _packed(page.parent_cuts, start, end, most, tokens)


def subdivide(page: Page, start: int, end: int, most: int = MAX_CHILD, hard: int = HARD_CHILD, tokens: Counter = default_tokens) -> list[tuple[int, int]]:
    """Child spans that tile a parent, cut at sentences and closing tags; pieces over ``hard`` tokens are an error."""
    out = _packed(page.child_cuts, start, end, most, tokens)
    if any(tokens(b - a) > hard for a, b in out):
        raise ValueError("a passage can't be cut to the child limit")
    return out


#: Detectors of sections by kind of document: html, page -> [(name, start, end)]. A kind with None is known and not chunked yet.
Detector = Callable[[str, Page], list[tuple[str, int, int]]]
DETECTORS: dict[str, Detector | None] = {"10-K": lambda html, page: detect_sections(page), "8-K": None, "transcript": None}


def chunk(html: str, max_parent: int = MAX_PARENT, max_child: int = MAX_CHILD, hard_child: int = HARD_CHILD, detect: Detector | None = DETECTORS["10-K"]) -> tuple[str, list[dict]]:
    """(outcome, chunks): tables are atomic parents of one child; narrative between them is packed, then subdivided. Outcomes: chunked,
    no_sections, quarantined (a passage can't be cut), not_implemented (no detector)."""
    if detect is None:
        return "not_implemented", []
    page = Page(html)
    rows, parent = [], 0
    for name, lo, hi in detect(html, page):
        at = lo
        for a, b in [*(t for t in page.tables if lo <= t[0] and t[1] <= hi), (hi, hi)]:
            for x, y, is_table in [*((x, y, False) for x, y in pack(page, at, a, max_parent)), *([(a, b, True)] if a < b else [])]:
                try:
                    children = [(x, y)] if is_table else subdivide(page, x, y, max_child, hard_child)
                except ValueError:
                    return "quarantined", []
                rows += [{"section": name, "parent_id": parent, "parent_start": x, "parent_end": y, "start": c, "end": d, "from_table": is_table} for c, d in children]
                parent += 1
            at = b
    return ("chunked" if rows else "no_sections"), rows


def chunk_failures(html: Column, start: Column, end: Column, text: Column, parent_start: Column, parent_end: Column) -> Column:
    """Why a chunk isn't what its document holds: ``bad_span``, ``outside_parent``, ``text_differs``; null for a sound one."""
    held = F.substring(html, start + 1, end - start)
    bad = (start < 0) | (end <= start) | (end > F.length(html))
    return F.when(F.coalesce(bad, F.lit(True)), "bad_span").when((start < parent_start) | (end > parent_end), "outside_parent").when(~held.eqNullSafe(text), "text_differs")


def quarantined_chunks(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, reason, section, parent_id, start, end, expected, held) of documents whose chunk set isn't sound, by its first failing chunk in
    order: none of such a document's chunks may be kept."""
    both = chunks.where("text is not null").join(docs.select(key, html), key)
    reason = chunk_failures(F.col(html), F.col("start"), F.col("end"), F.col("text"), F.col("parent_start"), F.col("parent_end"))
    held = F.substring(html, F.col("start") + 1, F.col("end") - F.col("start"))
    failing = both.withColumn("reason", reason).where("reason is not null")
    first = failing.groupBy(key).agg(F.min_by(F.struct("reason", "section", "parent_id", "start", "end", F.col("text").alias("expected"), held.alias("held")), F.struct("parent_id", "start", "end")).alias("x"))
    return first.select(key, "x.*")


def parse_filings(docs: DataFrame, key: str = "doc_id", html: str = "html", kind: str | None = None, detectors: dict[str, Detector | None] = DETECTORS, **limits: int) -> DataFrame:
    """(key, outcome, section, parent_id, parent span, child span, from_table, text): one row a child; documents without chunks give one
    row. ``kind``: the column that picks the detector (absent: annual reports); an unknown kind's outcome is unsupported_doc_type. A parent's
    id counts a document's parents in order; a table's html is its only child's text. Null html: no_sections."""

    def rows(h: str, t: str) -> list[tuple]:
        outcome, chunks = chunk(h, detect=detectors[t], **limits) if t in detectors else ("unsupported_doc_type", [])
        return [(outcome, *(c.get(n) for n in _CHUNK), h[c["start"] : c["end"]] if c else None) for c in chunks or [{}]]

    which = F.lit("10-K") if kind is None else F.col(kind).cast("string")
    return _per_document(docs, key, html, "outcome string, section string, parent_id int, parent_start int, parent_end int, start int, end int, from_table boolean, text string", rows, which)


_CHUNK = ("section", "parent_id", "parent_start", "parent_end", "start", "end", "from_table")
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _per_document(docs: DataFrame, key: str, html: str, columns: str, rows: Callable[[str, str], list[tuple]], with_: Column | None = None) -> DataFrame:
    """(key, ``columns``): the ``rows`` of each document's markup (null is empty) and of ``with_``. Keys never leave Arrow."""
    ship_package(docs.sparkSession)
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # chunks repeat their document's text, so batches stay small
                part = b.slice(lo, 64)
                got = [rows(h.as_py() or "", t.as_py()) for h, t in zip(part.column(1), part.column(2))]
                owner = np.repeat(np.arange(len(got)), [len(x) for x in got])
                cols = list(zip(*(r for x in got for r in x))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())).cast(key_type), *(pa.array(c, _ARROW[k]) for c, k in zip(cols, kinds))], ["k", *names])

    own = docs.select(F.col(key).alias("k"), F.col(html).alias("h"), (F.lit(None).cast("string") if with_ is None else with_).alias("t"))
    return own.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, {columns}").withColumnRenamed("k", key)


def section_rows(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, section, start, end) of each detected section."""
    return _per_document(docs, key, html, "section string, start int, end int", lambda h, _: detect_sections(Page(h)))


def table_rows(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, ordinal, start, end): the outermost balanced tables of each document."""
    return _per_document(docs, key, html, "ordinal int, start int, end int", lambda h, _: [(i, *t) for i, t in enumerate(table_spans(h))])


def audit_items(docs: DataFrame, key: str = "doc_id", html: str = "html", items: list[str] = ITEMS) -> DataFrame:
    """(key, item, candidates, real, known, first_real): every item number that a document mentions, how often, and as a real header."""
    found = _per_document(docs, key, html, "item string, start int, real boolean", lambda h, _: item_candidates(Page(h), items))
    first = F.min(F.when(F.col("real"), F.col("start")))
    return found.groupBy(key, "item").agg(F.count("*").alias("candidates"), F.count_if("real").alias("real"), first.alias("first_real")).withColumn("known", F.col("item").isin(*items))


# --- the parts that column expressions can express -----------------------------------------------------------------------------------
def tile(starts: DataFrame, group: str, start: str, length: str) -> DataFrame:
    """Adds ``end``: the next start of the group, or the document's length."""
    return starts.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(start)), F.col(length)))


def tag_depths(docs: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """(key, ordinal, closing, depth): a tag's occurrences in order with the nesting depth after each."""
    tokens = F.regexp_extract_all(F.col(html), F.lit(rf"(?i)<(/?){tag}\b[^>]*>"), F.lit(1))
    rows = docs.select(F.col(key), F.posexplode(tokens).alias("ordinal", "slash"))
    step = F.when(F.col("slash") == "/", -1).otherwise(1)
    return rows.select(key, "ordinal", (F.col("slash") == "/").alias("closing"), F.sum(step).over(Window.partitionBy(key).orderBy("ordinal")).alias("depth"))


def item_headers(html: Column) -> Column:
    """Item numbers in order of occurrence, with the entity spellings of white space."""
    return F.regexp_extract_all(html, F.lit(rf"\b(?i:item){BLANK}(\d+[A-Za-z]?)\b"), F.lit(1))


def entity_flexible(title: str) -> str:
    """A pattern for a title whose white space may be entities."""
    return BLANK.join("\\Q" + w + "\\E" for w in title.split())


def bucket_waits(times: Column, rate: float, burst: float) -> Column:
    """Total seconds waited by calls at ascending ``times`` under a token bucket: refill at ``rate`` a second up to ``burst``."""

    def step(s: Column, t: Column) -> Column:
        now = F.greatest(t, s["now"])
        have = F.least(F.lit(burst), s["have"] + (now - s["now"]) * rate)
        wait = F.greatest(F.lit(0.0), (1 - have) / rate)
        return F.struct((now + wait).alias("now"), F.greatest(F.lit(0.0), have + wait * rate - 1).alias("have"), (s["waited"] + (now - t) + wait).alias("waited"))

    start = F.struct(F.get(times, 0).alias("now"), F.lit(burst).alias("have"), F.lit(0.0).alias("waited"))
    return F.aggregate(times, start, step, lambda s: s["waited"])
