"""Main text of web pages: markup to blocks, then boilerplate found by suffix arrays over hosts' token streams.

A page becomes blocks in page order, each either *declared* main content (inside ``article``, ``main`` or ``role=main``), *dropped*
(inside menus, headers, footers, sidebars, notices, adverts, forms, comments, ...) or *open* (neither). The pages of every host are
searched for runs: their token streams are concatenated in pieces of bounded size, a suffix array truncated at the least run length
groups a piece's equal runs, and distinct pages are counted by host and run over all pieces. Only runs whose seed, a short part of
the run, recurs can recur; the others are left out by a count of seeds before. Runs that occur on several distinct pages of the host are
covered. Covered stretches of open blocks are boilerplate and go; unique runs stay. Declared content takes part in the search, and what
of it is covered is counted, but never cut: whole articles are republished word for word, and coverage alone can't tell such copies
from boilerplate.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.llm.near_dup import _mix
from docquarry.session import discard, materialize, ship_package

MIN_RUN, MIN_PAGES, BUCKET_BYTES = 8, 3, 2_000_000  # tokens; distinct pages of a host; bytes of streams of a piece
ROWS = 256  # pages whose coverage is looked up at once
#: Words of a seed; bits of the bitmap of seeds: an eighth of the streams' bytes, within these powers of two.
SEED, _LEAST_BITS, _MOST_BITS = 5, 16, 28
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

#: Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|select|iframe|svg|object|canvas|audio|video|xmp|noembed|noframes"
DROP = frozenset("nav footer aside form head button menu dialog fieldset label legend datalist output progress meter".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt msub msup".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
CONTAINERS = frozenset("ul ol dl table article main body html section div aside nav footer header form".split())
#: Words of class names and ids that name furniture; those of them whose articles are other people's or other pages'; and
#: words that may stand beside one without changing what it names.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner menu menubar nav navbar navigation navi breadcrumb breadcrumbs "
    "sidebar rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations pagination pager widget skip".split()
)
OTHERS = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations".split())
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global sticky fixed mobile desktop inner outer box bar block container wrapper wrap section area region zone panel list lists "
    "item items group row column col slot unit form link links button buttons icon icons post posts article articles story stories content text area js id header thread".split()
)
#: Words that make a name say something of an element beside furniture.
FLAGS = frozenset("has no not non with without is hide hides show shows in on off under over above below after before free".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Elements that may wrap a whole page: as furniture they give way to declared content in them.
WRAPPERS = frozenset("form fieldset".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"[^\s/>][^\s/>=]*")
_VALUE = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_NAMES = frozenset(RAW.split("|"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW_NAMES}
_PIECES = re.compile(r"[A-Z]?[^\sA-Z_-]+|[A-Z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _furniture(name: str, declared: bool) -> str:
    """What a class name or id says about its element: "drop", "others" (drop, with all articles in it) or nothing. It must end in a word
    for furniture, or consist of such words and of words that may stand beside them, and hold no flag: ``site-footer``, ``reader-comments``
    and ``share-buttons`` do, ``has-sidebar`` and ``share-price`` don't."""
    words = [w.lower() for w in _PIECES.findall(name)]
    known = DROP_WORDS if declared else DROP_WORDS | {"header"}
    if not any(w in known for w in words) or any(w in FLAGS for w in words):
        return ""
    if words[-1] not in known and any(w not in known and w not in BESIDE for w in words):
        return ""
    return "others" if any(w in OTHERS for w in words) else "drop"


def _drops(tag: str, attrs: dict[str, str], declared: bool) -> str:
    """Whether an element is furniture, by its name, role, class, id or hiding: "drop" for good; "others", for good but for ``main`` in it;
    "soft", unless it holds declared content and the page has none elsewhere; or not. Inside declared content a header is the
    article's own."""
    if tag in WRAPPERS:
        return "soft"
    if tag in DROP or (tag == "header" and not declared):
        return "drop"
    if not attrs or tag in ("html", "body", "main") or _declares(tag, attrs):
        return "hide" if "hidden" in attrs and tag not in ("html", "body") else ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDING.search(attrs.get("style", "").lower()):
        return "hide"
    if attrs.get("role", "").strip().lower() in DROP_ROLES:
        return "drop"
    said = {_furniture(n, declared) for k in ("class", "id") for n in attrs.get(k, "").split()}
    return "others" if "others" in said else "soft" if "drop" in said else ""


def _declares(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").strip().lower() == "main"


def markup(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The page as ("text", text, {}), ("open", name, attributes), ("close", name, {}) and ("void", name, {}) (an element that ends where
    it begins), in order; comments, declarations and elements without markup inside (scripts, styles, ...) are left out. A tag or comment
    that never ends takes the rest of the page. One pass forward: what isn't found once is not looked for again."""
    at, n, lost = 0, len(page), set()

    def find(what: str, start: int) -> int:
        if what in lost:
            return -1
        i = page.find(what, start)
        if i < 0:
            lost.add(what)
        return i

    while at < n:
        i = find("<", at)
        if i < 0:
            yield "text", page[at:], {}
            return
        follows = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = _COMMENT_END.search(page, i + 2)
            stop = end.end() if end else n
        elif follows in ("!", "?") or (follows == "/" and not page[i + 2 : i + 3].isascii()) or (follows == "/" and not page[i + 2 : i + 3].isalpha()):
            stop = find(">", i) + 1 or n
        elif follows == "/":
            if i > at:
                yield "text", page[at:i], {}
            name = _NAME.match(page, i + 2)
            at = find(">", name.end()) + 1 or n
            yield "close", name[0].lower(), {}
            continue
        elif follows.isascii() and follows.isalpha():
            if i > at:
                yield "text", page[at:i], {}
            name, attrs, slash, at = _tag(page, i + 1, find)
            if at > n:
                return
            if name in VOID or (slash and (name in INLINE or name == "svg")):
                yield "void", name, attrs
            elif name in _RAW_NAMES:
                end = None if name in lost else _RAW_END[name].search(page, at)
                if not end:
                    return
                at = find(">", end.end()) + 1 or n
            else:
                yield "open", name, attrs
            continue
        else:
            yield "text", page[at : i + 1], {}
            at = i + 1
            continue
        if i > at:
            yield "text", page[at:i], {}
        at = stop


def _tag(page: str, at: int, find: Callable[[str, int], int]) -> tuple[str, dict[str, str], bool, int]:
    """(name, attributes, whether it ends in a slash, the place behind it) of a start tag whose name begins at ``at``. A quote that is
    never closed is part of a bare value. A tag that never ends: a place beyond the page."""
    m = _NAME.match(page, at)
    name, attrs, at = m[0].lower(), {}, m.end()
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if page.startswith(">", at):
            return name, attrs, gap[0].endswith("/"), at + 1
        m = _ATTR_NAME.match(page, at)
        if not m:
            return name, attrs, False, len(page) + 1
        key, at = m[0].lower(), m.end()
        m = _VALUE.match(page, at)
        value = ""
        if m:
            at = m.end()
            quote = page[at : at + 1]
            end = find(quote, at + 1) if quote in ("'", '"') else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        attrs.setdefault(key, html.unescape(value))


class _Open:
    """The open elements with the state inside each; where the last one of a name stands is kept, so that no search walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, tag: str, state: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((tag, state))

    def cut(self, i: int) -> None:
        """Closes all from the ``i``-th on."""
        while len(self.stack) > i:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()

    def last(self, tag: str) -> int:
        """The last open ``tag``, -1 without one."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    @property
    def container(self) -> int:
        return self.containers[-1] if self.containers else -1

    @property
    def state(self) -> str:
        return self.stack[-1][1] if self.stack else "open"


#: States inside furniture, and what declared content in each is: "held" is declared if the page has no other.
_INSIDE = {"drop": "dropped", "hide": "dropped", "others": "others", "soft": "soft"}


def _inner(state: str, tag: str, attrs: dict[str, str]) -> str:
    """The state inside an element in ``state``."""
    if state == "dropped":
        return state
    drops = _drops(tag, attrs, state in ("declared", "held"))
    if drops in ("drop", "hide"):
        return "dropped"
    if _declares(tag, attrs):
        if state in ("soft", "others"):
            main = tag == "main" or tag != "article"
            return "declared" if main else "held" if state == "soft" else "others"
        return "held" if state == "held" else "declared"
    if state in ("soft", "others"):
        return "others" if drops == "others" else state
    return _INSIDE.get(drops, state)


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(state, text) of each block in page order; state: declared, open or dropped. Text is decoded, white space folded, not empty."""
    out: list[tuple[str, str]] = []
    now = _Open()
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((now.state, text))
            parts.clear()

    for what, name, attrs in markup(page):
        if what == "text":
            parts.append(name)
        elif what == "close":
            place, walled = now.last(name), name not in CONTAINERS
            if place >= 0 and (not walled or place > now.container):
                if name in INLINE and place == len(now.stack) - 1 and (now.stack[place - 1][1] if place else "open") == now.state:
                    now.cut(place)
                else:
                    flush()
                    now.cut(place)
            elif name not in INLINE and not (walled and now.container >= 0):
                flush()
        elif what == "void":
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
        else:
            if name not in INLINE:
                place = max((now.last(t) for t in SELF_END.get(name, {"p"} if name in P_ENDS else ())), default=-1)
                if place > now.container:
                    flush()
                    now.cut(place)
                if name in ("td", "th"):
                    parts.append(" ")
                else:
                    flush()
            inner = _inner(now.state, name, attrs)
            if inner != now.state:
                flush()
            now.push(name, inner)
    flush()
    as_is = "dropped" if any(s == "declared" for s, _ in out) else "declared"
    return [({"held": as_is, "soft": "dropped", "others": "dropped"}.get(s, s), t) for s, t in out]


def _run_ranks(tokens: np.ndarray, block: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``min_run`` tokens start that stay inside a stretch (``block``), and their ranks: equal runs have one rank.

    The suffix array is built by prefix doubling and stops at depth ``min_run``: suffixes of one rank then share their first ``min_run``
    tokens, and longer repeats are unions of such runs."""
    n = len(tokens)
    if n < min_run:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < min_run:
        step = min(depth, min_run - depth)
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:]
        rank, depth = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1, depth + step
    start = np.arange(n)
    at = start[(start + min_run <= n) & (block == block[np.minimum(start + min_run - 1, n - 1)])]
    return at, rank[at]


def _distinct_pages(group: np.ndarray, page: np.ndarray, size: int) -> np.ndarray:
    """The number of distinct pages of each group (0 to ``size`` - 1)."""
    order = np.lexsort((page, group))  # the suffix array's order, by page inside a rank
    r, p = group[order], page[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return np.bincount(r, weights=fresh, minlength=size).astype(np.int64)


def _spread(at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the runs of ``length`` that start ``at``."""
    hit = np.zeros(n + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + length, -1)
    return np.cumsum(hit)[:n] > 0


def repeated_runs(tokens: np.ndarray, page: np.ndarray, block: np.ndarray, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of at least ``min_run`` that occurs on at least ``min_pages`` distinct pages.

    ``tokens``: ids of the concatenated streams; a run doesn't cross blocks (nor, then, pages)."""
    at, rank = _run_ranks(tokens, block, min_run)
    return _spread(at[_distinct_pages(rank, page[at], len(tokens) + 2)[rank] >= min_pages], len(tokens), min_run)


def _word_hashes(words: Iterable[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return pd.util.hash_array(np.array([*words], object), categorize=False)


def _run_hashes(hosts: np.ndarray, words: np.ndarray, at: np.ndarray, min_run: int) -> np.ndarray:
    """A 64-bit hash of (host, run) for the runs of ``words`` (hashes) that start ``at``: the same in every piece. ``hosts``: each run's host's
    hash."""
    acc = hosts.copy()
    for i in range(min_run):
        acc = _mix(acc + words[at + i] * np.uint64(2 * i + 3))
    return acc.view(np.int64)


def _streams(rows: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' concatenated words: (id, hash, stretch, row) of each word, by ``page_streams``."""
    got = [[s for _, s in page_streams(blocks)] for blocks in rows]
    ids: dict[str, int] = {}
    words = [s.split(" ") for streams in got for s in streams]
    tokens = np.array([ids.setdefault(w, len(ids)) for ws in words for w in ws], np.int64)
    stretch = np.repeat(np.arange(len(words)), [len(w) for w in words])
    hashes = _word_hashes(ids)
    owner = np.repeat(np.arange(len(got)), [len(x) for x in got])
    return tokens, hashes[tokens], stretch, owner[stretch]


def page_streams(blocks: list[tuple[str, str]]) -> list[tuple[bool, str]]:
    """(whether it is of the page's main text, words) of a page's token streams. Its open blocks are one, so that runs of short ones count; any
    other block is a stream of its own. Main are the declared ones, or the open one where there are none."""
    declared = any(s == "declared" for s, _ in blocks)
    open_ = " ".join(t for s, t in blocks if s == "open")
    return [(not declared, open_)] * bool(open_) + [(s == "declared", t) for s, t in blocks if s != "open"]


@dataclass
class Piece:
    """Token streams of some pages, concatenated: per word its id and hash, its stretch (stream) and row; per row its host's hash, its page; per
    stretch whether it is of the main text."""

    tokens: np.ndarray
    hashes: np.ndarray
    stretch: np.ndarray
    row: np.ndarray
    hosts: np.ndarray
    pages: np.ndarray
    main: np.ndarray

    def seeds(self, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
        """(start, seed) of each run of ``min_run`` words. Equal runs of a host have equal seeds, and a seed changes with few of a text's
        runs: it is the least hash of ``SEED`` words in the run."""
        w, n = self.hashes, len(self.hashes)
        at = np.arange(max(n - min_run + 1, 0))
        at = at[self.stretch[at] == self.stretch[at + min_run - 1]]
        if not len(at):
            return at, np.empty(0, np.uint64)
        short = sum((w[j : n - SEED + 1 + j] * _ODD[j] for j in range(SEED)), np.zeros(n - SEED + 1, np.uint64))
        short = _mix(short + self.hosts[self.row[: n - SEED + 1]])
        least = short[at]
        for j in range(1, min_run - SEED + 1):
            least = np.minimum(least, short[at + j])
        return at, _mix(least)  # least hashes are small; mixed again they are spread evenly


def _pieces(batch: pa.RecordBatch, most_bytes: int) -> Iterator[Piece]:
    """``batch`` (host, page, main, streams) as pieces of at most ``most_bytes`` of text, or one page."""
    batch = batch.take(pc.sort_indices(batch.column(0)))
    size = np.cumsum(pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        to = max(int(np.searchsorted(size, (size[i - 1] if i else 0) + most_bytes, "right")), i + 1)
        part = batch.slice(i, to - i)
        i = to
        streams = pc.split_pattern(part.column(3), "\n")
        of_row = pc.list_parent_indices(streams).to_numpy()
        split = pc.split_pattern(streams.flatten(), " ")
        stretch = pc.list_parent_indices(split).to_numpy()
        words = split.flatten().dictionary_encode()
        tokens = words.indices.to_numpy().astype(np.int64)
        hashes = _word_hashes(words.dictionary.to_pylist())
        main = np.frombuffer("".join(part.column(2).to_pylist()).encode(), np.uint8) == ord("m")
        yield Piece(tokens, hashes[tokens], stretch, of_row[stretch], _word_hashes(part.column(0).to_pylist()), part.column(1).to_numpy(), main)


def piece_runs(p: Piece, hot: Callable[[np.ndarray], np.ndarray], min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, page, whether it is in the page's main text) of the runs whose seeds are ``hot``, each run and page once. A suffix array over the
    stretches that hold such runs, host by host, tells equal runs."""
    at, seeds = p.seeds(min_run)
    at = at[hot(seeds)]
    out = []
    bounds = np.flatnonzero(np.r_[True, p.hosts[1:] != p.hosts[:-1], True])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own = at[(p.row[at] >= lo) & (p.row[at] < hi)]
        if not len(own):
            continue
        start, end = np.searchsorted(p.row, [lo, hi])
        kept = start + np.flatnonzero(_spread(own - start, end - start, min_run))
        # what isn't covered is left out, so the stretches on both sides of it are told apart
        block = np.cumsum(np.r_[True, (np.diff(kept) > 1) | (np.diff(p.stretch[kept]) != 0)])
        begin, rank = _run_ranks(p.tokens[kept], block, min_run)
        begin, rank = kept[begin], rank[np.isin(kept[begin], own)]
        begin = begin[np.isin(begin, own)]
        _, first, run = np.unique(rank, return_index=True, return_inverse=True)
        number, page = np.unique(p.pages[p.row[begin]], return_inverse=True)
        each, where = np.unique(run * len(number) + page, return_inverse=True)
        main = np.bincount(where, weights=p.main[p.stretch[begin]], minlength=len(each)) > 0
        out.append((_run_hashes(np.repeat(p.hosts[lo], len(first)), p.hashes, begin[first], min_run)[each // len(number)], number[each % len(number)], main))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def main_text(host: str, blocks: list[tuple[str, str]], frequent: np.ndarray) -> str:
    """The main text of a page, without the runs whose hashes are ``frequent``: see the module."""
    return covered_texts([host], [main_blocks(blocks)], frequent)[0][0]


def main_blocks(blocks: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The declared ones, or the open ones of a page without any."""
    return [b for b in blocks if b[0] == "declared"] or [b for b in blocks if b[0] == "open"]


def covered_texts(hosts: list[str], rows: list[list[tuple[str, str]]], frequent: np.ndarray, min_run: int = MIN_RUN) -> list[tuple[str, int]]:
    """(main text, how many words of the main blocks lie in runs whose hashes are ``frequent``) of each row, given its ``main_blocks``. A
    hash is of a run on a host, so what is frequent for one row is for all."""
    out = [("\n".join(t for _, t in blocks), 0) for blocks in rows]
    if not len(frequent):
        return out
    _, hashes, stretch, row = _streams(rows)
    at = np.arange(max(len(hashes) - min_run + 1, 0))
    at = at[stretch[at] == stretch[at + min_run - 1]]
    at = at[np.isin(_run_hashes(_word_hashes(hosts)[row[at]], hashes, at, min_run), frequent)]
    covered = _spread(at, len(hashes), min_run)
    starts, firsts = np.searchsorted(row, np.arange(len(rows) + 1)), np.searchsorted(row[at], np.arange(len(rows) + 1))
    for i, n in enumerate(np.bincount(row, weights=covered, minlength=len(rows)).astype(int).tolist()):
        if n:
            cut = rows[i][0][0] == "open"
            out[i] = (_uncovered(rows[i], at[firsts[i] : firsts[i + 1]] - starts[i], covered[starts[i] : starts[i + 1]], min_run) if cut else out[i][0], n)
    return out


def _uncovered(blocks: list[tuple[str, str]], at: np.ndarray, covered: np.ndarray, min_run: int) -> str:
    """The text of open blocks without what frequent runs, which start ``at``, cover."""
    block = np.repeat(np.arange(len(blocks)), [t.count(" ") + 1 for _, t in blocks])
    # a run across blocks takes only blocks that are covered from end to end, so that it doesn't behead the text after it
    whole = np.bincount(block, weights=~covered, minlength=len(blocks)) == 0
    gone = _spread(at[block[at] == block[at + min_run - 1]], len(covered), min_run) | whole[block]
    kept, start = [], 0
    for _, text in blocks:
        words = text.split(" ")
        left = " ".join(w for w, c in zip(words, gone[start : start + len(words)]) if not c)
        if left:
            kept.append(left)
        start += len(words)
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, url, text, n_covered) of every row. Null or empty html: empty text. Null url: a host of its own. Repeated rows stay, and those of
    one key and url are one page, so that none is covered by its own repeats. Empty table: no rows. Other columns are not read.

    ``n_covered``: words of the page's main blocks in runs of ``MIN_RUN`` words that are on ``MIN_PAGES`` pages of its host or more. All hosts are
    searched, and every page's row is made from its blocks and what covers them.

    Streams stay where their pages are read. First seeds of runs, cut to at most 44 bits, are counted, by ranges of seeds; seeds on enough rows are
    marked in a bitmap of bounded size, which lets some others pass but none of those out. Then only runs with a marked seed are ranked by
    suffix arrays, in pieces of ``bucket_bytes``, and their pages counted by 64-bit hashes over the whole host. The runs that are on
    enough pages meet the pages that hold them."""
    spark = pages.sparkSession
    ship_package(spark)
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"), F.xxhash64(F.lit(0), F.col(key), F.lit(1), F.col(url)).alias("page"))
    kind, key_type = pages.schema[key].dataType.simpleString(), to_arrow_type(pages.schema[key].dataType)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # shorter ones hold no run
            got = [[x for x in page_streams(blocks_of(h.as_py())) if x[1].count(" ") >= MIN_RUN - 1] for h in b.column(2)]
            rows = [("".join("m" if m else "-" for m, _ in g), "\n".join(t for _, t in g)) for g in got]
            t = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m for m, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["host", "page", "main", "streams"])
            yield t.filter(pc.not_equal(t.column(2), ""))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            main = [main_blocks(blocks_of(h.as_py())) if h.is_valid else [] for h in b.column(2)]
            made = [zlib.compress("\n".join([g[0][0] if g else "", *(t for _, t in g)]).encode(), 2) for g in main]
            yield table([b.column(i) for i in (0, 1, 3, 4)], [pa.array(made, pa.binary())], ["k", "url", "host", "page", "blocks"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                rows = []
                for z in b.column(3).to_pylist():
                    state, *texts = zlib.decompress(z).decode().split("\n")
                    rows.append([(state, t) for t in texts])
                held = np.flatnonzero(b.column(4).is_valid())
                got = [("\n".join(t for _, t in x), 0) for x in rows]
                hosts, runs = b.column(2).to_pylist(), b.column(4).flatten().to_numpy()
                for j, x in zip(held, covered_texts([hosts[j] for j in held], [rows[j] for j in held], runs)):
                    got[j] = x
                yield table([b.column(0), b.column(1)], [pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["k", "url", "text", "n_covered"])

    def table(kept: list[pa.Array], made: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        # what is carried along never leaves Arrow, so that keys stay as they are beside nulls
        kept = [c.cast(key_type) if n == "k" else c for n, c in zip(names, kept)]
        return pa.RecordBatch.from_arrays([*kept, *made], names)

    parsed = own.where(F.length("html") > 0).select("host", "page", "html").mapInArrow(streams, "host string, page long, main string, streams string")
    read = materialize(parsed, "html-streams", compression="zstd")
    size = read.agg(F.sum(F.octet_length("streams"))).first()[0] or 0
    marks = spark.sparkContext.broadcast(_marked_seeds(read, size, bucket_bytes))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(marks.value, np.uint8)
        for b in batches:
            for p in _pieces(b, bucket_bytes):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in piece_runs(p, lambda s: _is_marked(s, hot))], ["run", "page", "main"])

    pairs = read.mapInArrow(meet, "run long, page long, main boolean").groupBy("run", "page").agg(F.max("main").alias("main"))
    pairs = materialize(pairs, "html-runs", compression="zstd")
    discard(read)
    frequent = pairs.groupBy("run").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("run")
    held = materialize(pairs.where("main").join(frequent, "run", "left_semi").groupBy("page").agg(F.collect_list("run").alias("frequent")), "html-held", compression="zstd")
    discard(pairs)
    rows = own.select("k", "url", "html", "host", "page").mapInArrow(parse, f"k {kind}, url string, host string, page long, blocks binary")
    done = rows.join(held, "page", "left").select("k", "url", "host", "blocks", "frequent").mapInArrow(cut, f"k {kind}, url string, text string, n_covered long")
    return done.select(F.col("k").alias(key), F.col("url").alias(url), "text", "n_covered")


def _marked_seeds(read: DataFrame, size: int, bucket_bytes: int) -> bytes:
    """A bitmap that has a bit set for each seed that is on ``MIN_PAGES`` rows or more of ``read``: (host, page, main, streams), ``size`` bytes."""
    bits = 1 << min(max(int(size // 8).bit_length(), _LEAST_BITS), _MOST_BITS)
    parts = 1 << min(max(int(size >> 24).bit_length(), 4), 12)
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in _pieces(b, bucket_bytes):
                at, seeds = p.seeds()
                row = p.row[at]
                fresh = np.r_[True, (seeds[1:] != seeds[:-1]) | (row[1:] != row[:-1])][: len(seeds)]
                seeds = np.sort(seeds[fresh])
                # three of one seed say as much as more
                seeds = seeds[np.r_[np.ones(MIN_PAGES, bool), seeds[MIN_PAGES:] != seeds[:-MIN_PAGES]][: len(seeds)]]
                part = (seeds >> shift).astype(np.int32)
                names, first = np.unique(part, return_index=True)
                ends = [*first[1:], len(part)]
                low = seeds.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([low[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())], ["part", "seeds"])

    def mark(t: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(t.column("seeds").to_pylist()), np.uint32)
        seed, n = np.unique(low, return_counts=True)
        flags = np.zeros(bits // parts, bool)
        flags[seed[n >= MIN_PAGES] & np.uint32(bits // parts - 1)] = True
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    marked = read.mapInArrow(count, "part int, seeds binary").groupBy("part").applyInArrow(mark, "part int, bits binary")
    out, each = bytearray(bits // 8), bits // parts // 8
    for r in marked.toLocalIterator():
        out[r["part"] * each : (r["part"] + 1) * each] = r["bits"]
    return parts.to_bytes(4, "little") + bytes(out)


def _is_marked(seeds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    parts = int.from_bytes(marks[:4].tobytes(), "little")
    flags = marks[4:]
    each = len(flags) * 8 // parts
    bit = (seeds >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) * each + (seeds & np.uint64(min(each - 1, 0xFFFFFFFF))).astype(np.int64)
    return (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
