"""Main text of web pages: structure, and the repeats of a host suffix array.

A page is parsed, in time linear in its length, into blocks. Elements that are
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or
styles by tag, role, class or id are boilerplate, unless they wrap the page's main
content (see :func:`_cleared`). If the page has an article (``article``, ``main``,
or a named content container), what is outside of it is boilerplate too. A name
counts by its last word (``post-comments``, ``ad-box``); a boilerplate word in
front of another (``related-work``) is a weak sign only.

The host decides where structure does not. The token streams of a host's blocks
outside articles (block ends are tokens) are its suffix array: suffixes meet sorted
by their first ``RUN`` tokens and host, in packed parts, with the number of
different pages of each run. (A longer common prefix has nothing to add: a token is
in a repeated substring of RUN or more tokens just if it is in a repeated one of RUN
tokens. Tests hold this equal to a sorted suffix array with its LCP.) Every page
gives its streams; pages that are equal as a whole count once. A run that ``PAGES`` or more
different pages have, on a host of any size, covers its
tokens. In blocks of pages without an article, and in those with a weak sign,
covered runs are cut out (those of RUN words or more, or the whole block) and unique
runs stay.
Text in an article without any sign stays, as hosts do serve copies of articles.

Edge cases: null or empty html gives an empty text; unclosed elements end with
their parent or the page; a null url is a host of its own; repeated pages do
not make each other boilerplate (equal pages count once); pages of any length or
depth are parsed whole; an empty table gives an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .exchange import PACKED, Answers, Plan, answered, buffered, deal, judged, pack
from .workspace import pick, written

RUN = 6
PAGES = 2

# HTML element names by kind.
# Verdicts on elements: stays; left out unless it holds the main content; the same, of comments and the like; left out with all it holds.
KEPT, WRAP, BESIDE, GONE, WEAK = 0, 1, 2, 3, 4
#: Verdicts and containers around a text beyond these numbers add nothing.
MOST_WRAPS, MOST_CONTAINERS = 32, 64
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav footer aside form button select iframe object embed canvas svg audio video map dialog menu head noscript template search math applet datalist".split())
# Words of class and id names.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adbox adslot sponsor sponsored promo promotion promoted sidebar sidebars nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations widget widgets toolbar pagination pager skip alert "
    "alerts paywall copyright search".split()
)
HEADER = frozenset("header banner".split())
COMMENT = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words behind another that do not change its kind.
NEUTRAL = frozenset(
    "area areas banner bar block body bottom box button buttons card col column container form group header heading icon icons inner item items left link links list "
    "module outer panel posts articles stories right row section slot strip title top unit wrap wrapper zone".split()
)
STATE = frozenset("no not has with without hide".split())
ASIDE = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
WRAPPERS = frozenset("nav footer aside form dialog menu search header".split())
CONTAINERS = frozenset("content main maincontent article articlebody articlecontent post postbody postcontent entry entrycontent story storybody contentbody pagecontent bodycontent".split())
# Elements that an opening tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
CLOSE_P = BLOCKS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NAMES = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _words(name: str) -> list[str]:
    """The words of a class or id; what follows a word of state (``no-sidebar``) is no part of its kind."""
    words = _NAMES.findall(_CAMEL.sub(" ", name).lower())
    return words[: next((i for i, w in enumerate(words) if w in STATE), len(words))]


def _kind(words: list[str], marks: frozenset[str]) -> tuple[str | None, bool]:
    """The boilerplate word of a name, and whether it is only a weak sign, as another word has the last say."""
    n = len(words)
    while n > 1 and (words[n - 1] in NEUTRAL or words[n - 1].isdigit()) and words[n - 1] not in marks:
        n -= 1
    if n and words[n - 1] in marks:
        return words[n - 1], False
    return next((w for w in words if w in marks), None), True


def _judge(tag: str, attrs: str, in_main: bool) -> tuple[int, bool]:
    """The verdict on an element (see KEPT), and whether its name says that it holds the content."""
    soft = (BESIDE if tag in ("nav", "footer", "aside") else WRAP) if tag in WRAPPERS and (tag != "header" or not in_main) else KEPT
    if tag in LEFT_OUT and not soft:
        return GONE, False
    if not attrs or attrs.isspace():
        return soft, False
    a = {k.lower(): unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(attrs)}
    if tag in ("html", "body"):
        return KEPT, False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return GONE, False
    if soft:
        return soft, False
    role = a.get("role", "").lower()
    if role == "main" or a.get("itemprop", "").lower() == "articlebody":
        return KEPT, True
    given = [a[k] for k in ("class", "id") if a.get(k)]
    if tag != "main" and given:
        names = [_words(x) for g in given for x in g.split()]
        marks = COMMENT if tag == "article" else NOT_MAIN if in_main else NOT_MAIN | HEADER
        found = [k for k in (_kind(w, marks) for w in names) if k[0]]
        strong = {word for word, weak in found if not weak}
        if strong:
            return BESIDE if strong & ASIDE else WRAP, False
        if found:
            return WEAK, False
    if tag != "main" and role in NOT_MAIN_ROLES and not (in_main and role == "banner"):
        return WRAP, False
    return KEPT, any("".join(_NAMES.findall(x.lower())) in CONTAINERS for g in given for x in [g, *g.split()])


def _cleared(verdicts: list[int], containers: list[tuple[int, tuple]], blocks: list[tuple[int, list[tuple]]]) -> set[int]:
    """The verdicts that do not hold, as their element holds the page's main content.

    A container below verdicts is released if it has more text than the page keeps
    (in containers, if it has any; links do not count elsewhere), and no article is
    kept; ``main`` is released unless the page keeps another. Below an element of
    comments or the like, only if no container is kept.
    """
    gone: set[int] = set()
    while any(w not in gone for _, wraps in containers for w in wraps):
        rest = [tuple(w for w in wraps if w not in gone) for _, wraps in containers]
        size, kept, inside, outside = [0] * len(containers), [0] * 4, 0, 0
        for _, pieces in blocks:
            for wraps, chain, text, link in pieces:
                n = len(text.strip())
                own = tuple(w for w in wraps if w not in gone)
                for c in chain:
                    if rest[c] == own:
                        size[c] += n
                if not own and chain:
                    inside += n
                    for level in {containers[c][0] for c in chain}:
                        kept[level] += n
                elif not own and not link:
                    outside += n
        for c in sorted((c for c in range(len(rest)) if rest[c] and size[c]), key=lambda c: (containers[c][0] != 2, -size[c])):
            if containers[c][0] == 2:
                good = not kept[2]
            elif any(verdicts[w] == BESIDE for w in rest[c]):
                good = not inside and size[c] > outside
            else:
                good = not kept[3] and size[c] > (inside or outside)
            if good:
                gone.update(rest[c])
                break
        else:
            break
    return gone


# Implied ends: what each tag closes, as groups of open elements of which a frame knows the last one in its scope.
_GROUPS = {"li": 0, "dt": 1, "dd": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "option": 5, "p": 6}
_ENDS = {"li": (0,), "dt": (1,), "dd": (1,), "td": (2,), "th": (2,), "tr": (2, 3), "thead": (2, 3), "tbody": (2, 3, 4), "tfoot": (2, 3, 4), "option": (5,)}
_NONE = (-1,) * 7


class _Parser:
    """One pass over the tags with a stack of open elements; every step takes constant time but for what it closes."""

    def __init__(self) -> None:
        # Frames: tag, left out, level (3 article, 2 main, 1 named container, 0 none), verdicts and containers above, weak sign, groups, inside a link.
        self.stack: list[tuple] = [("", False, 0, (), (), False, _NONE, 0)]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[int, list[tuple]]] = []
        self.now: list[tuple] = []
        self.verdicts: list[int] = []
        self.containers: list[tuple[int, tuple]] = []

    def flush(self) -> None:
        if self.now:
            self.blocks.append((self.stack[-1][2], self.now))
            self.now = []

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            tag = self.stack[-1][0]
            if tag in BLOCKS:
                self.flush()
            self.open[tag] -= 1
            self.stack.pop()

    def add(self, text: str) -> None:
        _, out, _, wraps, chain, weak, _, link = self.stack[-1]
        if text and not out:
            self.now.append((wraps, chain, text, link > 0, weak))

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.close(k)
        elif tag in BLOCKS:
            self.flush()

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSE_P and self.stack[-1][6][6] > 0:
            self.close(self.stack[-1][6][6])
        ends = [i for i in (self.stack[-1][6][g] for g in _ENDS.get(tag, ())) if i > 0]
        if ends:
            self.close(min(ends))
        if tag == "br":
            self.add(" ")
        if tag in VOID:
            return
        _, out, level, wraps, chain, weak, groups, link = self.stack[-1]
        verdict, named = _judge(tag, attrs, level > 0)
        own = 3 if tag == "article" else 2 if tag == "main" else 1 if named else 0
        level = max(level, own)
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            return
        if verdict in (WRAP, BESIDE):
            if len(wraps) < MOST_WRAPS:
                wraps = (*wraps, len(self.verdicts))
                self.verdicts.append(verdict)
        elif own and not out and len(chain) < MOST_CONTAINERS and not (chain and self.containers[chain[-1]][0] >= own and self.containers[chain[-1]][1] == wraps):
            chain = (*chain, len(self.containers))
            self.containers.append((own, wraps))
        at = len(self.stack)
        if tag in SCOPES:
            groups = _NONE
        elif tag in BLOCKS and groups[6] > 0:
            groups = (*groups[:6], -1)
        if tag in _GROUPS:
            groups = tuple(at if i == _GROUPS[tag] else x for i, x in enumerate(groups))
        self.open[tag] = self.open.get(tag, 0) + 1
        # A link marks the text up to three elements below it.
        # What names itself as the content is not weak for what is around it.
        self.stack.append((tag, out or verdict == GONE, level, wraps, chain, not own and (weak or verdict == WEAK), groups, 4 if tag == "a" else max(0, link - 1)))

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if not m:
                self.add(html[at:])
                break
            self.add(html[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if tag in BLOCKS:
                    self.flush()
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            else:
                self.start(tag, m[3] or "")
        self.close(1)
        self.flush()


def parse(html: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The text, or None if the host must decide; and the blocks (kind, text) in page order.

    Kinds: ``k`` kept, ``w`` kept but for runs that the host repeats (a weak sign, or
    a page without an article), ``d`` left out, but evidence of the host's repeats.
    """
    page = _Parser()
    page.feed(html)
    cleared = _cleared(page.verdicts, page.containers, [(lv, [x[:4] for x in pieces]) for lv, pieces in page.blocks])
    blocks: list[tuple[int, str, float, bool]] = []
    for level, pieces in page.blocks:
        for gone in (False, True):
            own = [(unescape(t) if "&" in t else t, link, weak) for wraps, _, t, link, weak in pieces if cleared.issuperset(wraps) != gone]
            text = " ".join("".join(t for t, _, _ in own).split())
            if text:
                share = sum(len(t) for t, link, _ in own if link) / max(1, sum(len(t) for t, _, _ in own))
                blocks.append((-1 if gone else level, text, share, any(weak for _, _, weak in own)))
    size = [sum(len(t) for lv, t, _, _ in blocks if lv >= k) for k in range(4)]
    # An article that is a small part of <main> is one of many teasers there.
    level = 3 if size[3] and 2 * size[3] >= size[2] else 2 if size[2] else 1 if size[1] and 5 * size[1] >= 2 * size[0] else 0
    if level:
        kinds = [("d" if lv < level else "w" if weak else "k", t) for lv, t, _, weak in blocks]
    else:
        kinds = [("d" if lv < 0 or share > 0.6 else "w", t) for lv, t, share, _ in blocks]
    open_page = any(k == "w" for k, _ in kinds)
    return None if open_page else "\n".join(t for k, t in kinds if k == "k"), kinds


def _page_id(host: str, blocks: list[tuple[str, str]], unsettled: bool) -> int:
    """A number that equal pages of a host share; odd if the host must decide on the page."""
    raw = "\0".join([host, *[t for _, t in blocks]]).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) & ~1 | unsettled


_PARSED = "page_id long, url string, host string, stream long, text string, kinds string, blocks array<string>"


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, blocks = parse(html) if html else ("", [])
            host = host_of(url)
            stream = _page_id(host, blocks, text is None)
            if text is not None:
                blocks = [x for x in blocks if x[0] == "d"]
            rows.append((host, stream, text, "".join(k for k, _ in blocks), [t for _, t in blocks]))
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[x.split()[0] for x in _PARSED.split(", ")])


_END = tv.U(0x45)


def suffixes(hosts: list[str], kinds: list[str], blocks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the streams of some pages: page, block and key of every token (keys only where RUN tokens follow), and the words' counts.

    Kept blocks of an article are no part of the stream; each other block ends with a token of its own.
    """
    part = np.array([k != "k" for k in "".join(kinds)], bool)
    page = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])[part]
    texts = blocks.flatten().filter(pa.array(part))
    salt = np.array([tv.digest(np.frombuffer(h.encode(), np.uint8)) for h in hosts], tv.U)
    tokens, block = np.zeros(0, tv.U), np.zeros(0, np.int64)
    for c in tv.chunks(texts, 1 << 40):
        w = tv.words(c)
        tokens = np.insert(tv.spans(c.data, w.start, w.end), w.first[1:], _END)
        block = np.repeat(np.arange(c.n), w.count + 1)
    of = page[block]
    first = np.searchsorted(of, np.arange(len(kinds) + 1))
    at = tv.starts_of(first, RUN)
    keys = tv.mix(tv.rolling(tokens, RUN)[at] ^ salt[of[at]]) & ~tv.U(1) if len(at) else np.zeros(0, tv.U)
    return at, of, keys, block


def _evidence(plan: Plan) -> Callable:
    """Packed suffixes; of a run that PAGES pages of a buffer have, only so many go on to be counted."""

    def entries(streams: np.ndarray, rows: pa.StructArray) -> Iterator[tuple]:
        for lo in range(0, len(rows), 256):
            some = rows.slice(lo, 256)
            at, of, keys, _ = suffixes(some.field("host").to_pylist(), some.field("kinds").to_pylist(), some.field("blocks"))
            yield keys, streams[lo : lo + 256][of[at]], np.zeros(len(keys), bool)

    def flush(keys: np.ndarray, docs: np.ndarray, _: np.ndarray) -> Iterator[tuple]:
        keys, docs, nth, pages = _distinct(keys, docs)
        rest, known = nth < PAGES, (pages >= PAGES) & (docs & 1 == 1)
        yield from pack(plan.parts_of(keys[rest]), keys[rest], docs[rest], plan)
        yield from pack(plan.parts_of(keys[known]), keys[known], docs[known], plan, known=True)

    return buffered(entries, flush)


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted suffix array: distinct (key, page), the rank of each within its key, and the key's number of pages."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
    keys, docs = keys[new], docs[new]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    pages = np.repeat(np.diff(np.append(start, len(keys))), np.diff(np.append(start, len(keys))))
    return keys, docs, np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys)))), pages


def _repeated(keys: np.ndarray, docs: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of PAGES or more pages, for pages that the host decides on."""
    keys, docs, _, pages = _distinct(keys, docs)
    hit = (pages >= PAGES) & (docs & 1 == 1)
    return keys[hit], docs[hit]


def _long(covered: np.ndarray) -> np.ndarray:
    """Covered words that are cut from a block: all if the whole block is covered, else stretches of RUN words or more.

    Shorter ones are the ends of runs of the blocks before and behind.
    """
    if covered.all():
        return covered
    edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= RUN
    return out


def _cut(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Unsettled pages without the runs that cover their ``w`` blocks."""
    known, texts = Answers(found), []
    rest = rows.column("rest").combine_chunks()
    host, kinds, blocks = [rest.field(n) for n in ("host", "kinds", "blocks")]
    for i, stream in enumerate(rows.column("_id").to_pylist()):
        at, _, keys, block = suffixes([host[i].as_py()], [kinds[i].as_py()], blocks.slice(i, 1))
        mine = known.of(stream)
        covered = tv.cover(at[np.isin(keys, mine)], RUN, len(block)) if len(mine) else np.zeros(len(block), bool)
        out, k = [], 0
        for kind, text in zip(kinds[i].as_py(), blocks[i].as_py()):
            if kind == "k":
                out.append(text)
                continue
            if kind == "w":
                words = text.split(" ")
                gone = _long(covered[np.searchsorted(block, k) : np.searchsorted(block, k, "right") - 1])
                text = " ".join(x for x, g in zip(words, gone) if not g) if gone.any() else text
                if text:
                    out.append(text)
            k += 1
        texts.append("\n".join(out))
    return pa.table([rows.column("_id"), pa.array(texts, pa.string()), rest], names=["_id", "cut", "rest"])


def extract(pages: DataFrame, plan: Plan | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = written(rows.mapInArrow(_parse_pages, _PARSED), "pages")
    plan = plan or Plan.for_bytes(parsed.agg(F.sum(F.octet_length(F.array_join("blocks", " "))).alias("b")).first()["b"] or 0)
    streams = parsed.where(F.size("blocks") > 0).select("stream", F.struct("host", "kinds", "blocks").alias("page"))
    found = judged(deal(streams.mapInArrow(_evidence(plan), PACKED), plan.parts, plan), plan, _repeated)
    unsettled = parsed.where("text IS NULL")
    # Equal pages get equal texts: one of them is cut for all.
    one = unsettled.groupBy("stream").agg(F.first(F.struct("host", "kinds", "blocks")).alias("p")).select("stream", "p.*")
    one = one.select(F.col("stream").alias("_id"), F.lit(None).cast("string").alias("text"), F.struct("host", "kinds", "blocks").alias("rest"))
    cut = answered(one, found, plan, _cut, "_id long, cut string").select(F.col("_id").alias("stream"), F.col("cut").alias("text"))
    cut = unsettled.select("page_id", "url", "stream").join(cut, "stream").select("page_id", "url", "text")
    texts = parsed.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(cut)
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"))
