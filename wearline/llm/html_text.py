"""Main text of web pages by the line-block distribution.

The markup of a page is stripped to lines, one per block-level element.  Elements that are
never part of an article by their tag (menus, footers, asides, forms, scripts ...) and lines
that are mostly links become runs of empty lines.  A class, id or role of a block that names
such a part is evidence, weighed by the fullest windows (``dropped``).  Over the lines'
text lengths a window of ``window`` lines is summed.  A *surge point* is a line from which
the window holds at least the threshold of text, a *dive point* the first line after it from
which the window is empty; the lines between the two are kept.  The threshold is a share of the
fullest window, at most ``surge`` characters.  Where the page names its article (``<article>``
or ``<main>``) and at least half of the text so kept is in it, only lines inside count and any
text is a surge.  An ``<article>`` within boilerplate, or marked as such itself, names nothing.

* NULL html counts as empty; a page without text gives the empty string and 0.
* Broken markup: an unclosed comment, script or tag ends with the page; an unclosed
  boilerplate element ends where the article around it ends or the next one starts.
* Repeated rows are treated each; nothing is cut off: a very long page is one batch.
* An empty table gives no rows; columns other than ``page_id, url, html`` are not read.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm.common import map_arrow

SCHEMA = "page_id long, url string, text string, n_chars long"

TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
LABELS = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements of HTML by their role.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video select textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("head nav aside footer form dialog menu search button label fieldset".split())
# Words in a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner "
    "banners nav navbar navigation menu menus breadcrumb breadcrumbs toolbar sidebar sidebars aside footer header "
    "masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login comment comments reply replies respond disqus share sharing social related "
    "recommended recommendations widget widgets pagination pager skip search form complementary contentinfo".split())
CONTENT = frozenset(("article", "main"))
# Words beside a mark that leave its meaning, words that make it a state of something
# else (``has-sidebar``), and those whose header is a heading of the text (``post-header``).
FILLERS = frozenset(
    "area bar block body bottom box card cards container content desktop form group in inner item items left links "
    "list main mobile outer page panel post posts primary region right row section secondary site text thread title "
    "top up unit wrap wrapper".split())
STATES = frozenset("has no with without not is show hide".split())
OWNERS = frozenset("article chapter content entry page post section story text title".split())
# Marks of parts that hold running text of their own; other marked blocks with a paragraph are text.
WORDY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion sidebar "
    "sidebars aside cookie cookies consent gdpr popup modal overlay newsletter comment comments reply replies respond "
    "disqus related recommended recommendations widget widgets complementary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SELF_ENDING = frozenset("li dt dd tr td th".split())
MARKABLE = BLOCK | {"td", "th"}
# Marks of reader comments, adverts and notices, which are never the article.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos cookie cookies consent gdpr "
    "notice notices alert alerts newsletter popup comment comments reply replies respond disqus".split())
# A mark among other words, of a part without paragraphs, of one with, of what is never the article.
WEAK, SHORT, STRONG, OUT = 1, 2, 3, 4


def _is_aside(tag: str, attributes: str, inside: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    return bool(attributes) and tag not in ("html", "body") and tag not in CONTENT and bool(HIDDEN.search(attributes))


def _mark(tag: str, attributes: str, inside: bool) -> int:
    """How surely the class, id or role of a block says that it is not the article (0: not)."""
    found = 0
    if not attributes or tag not in MARKABLE:
        return 0
    for _, value in LABELS.findall(attributes):
        for token in value.strip("\"'").split():
            words = [w.lower() for w in WORDS.findall(token)]
            marks = MARKS.intersection(words)
            if "header" in marks and (inside or tag not in ("div", "section", "header") or OWNERS.intersection(words)):
                marks = marks - {"header"}
            if not marks or words[0] in STATES:
                continue
            main = [w for w in words if w not in FILLERS] or words
            if main[-1] in NEVER and not STATES.intersection(words):  # "reader-comments", "comment-list"
                return OUT
            if not all(w in MARKS or w in FILLERS for w in words):
                found = max(found, WEAK)
            else:
                found = max(found, STRONG if marks & WORDY else SHORT)
    return found


class Lines:
    """The page's lines: text, length of it that is link text, and whether it is in the article;
    for each the marked block it is in (``marks``: its parent and mark) and whether it is a heading."""

    def __init__(self, gap: int):
        self.gap = gap
        self.rows: list[tuple[str, int, bool]] = []
        self.owners: list[tuple[int, bool]] = []
        self.marks: list[tuple[int, int]] = [(0, 0)]
        self.open: list[tuple[str, int]] = []  # open blocks, each with the marked block it is in or is
        self.count: Counter[str] = Counter()  # of open blocks by tag
        self.parts: list[str] = []
        self.linked = 0

    def end(self, inside: bool, heading: bool = False) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.rows.append((text, self.linked, inside))
            self.owners.append((self.open[-1][1] if self.open else 0, heading))
        self.parts, self.linked = [], 0

    def blank(self) -> None:
        self.rows.extend([("", 0, False)] * self.gap)
        self.owners.extend([(0, False)] * self.gap)

    def block(self, closing: bool, tag: str, mark: int) -> None:
        """Open or close a block; one with an end tag of its own ends those left open in it."""
        if closing:
            if self.count[tag]:
                while self._pop() != tag:
                    pass
            return
        if self.open and self.open[-1][0] == "p":
            self._pop()
        if self.open and self.open[-1][0] == tag and tag in SELF_ENDING:
            self._pop()
        owner = self.open[-1][1] if self.open else 0
        if mark:
            self.marks.append((owner, mark))
            owner = len(self.marks) - 1
        self.open.append((tag, owner))
        self.count[tag] += 1

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        return tag


def _closed(page: str, tag: str) -> set[int]:
    """Where the elements ``tag`` start that have an end tag of their own."""
    found, open_ = set(), []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])", page, re.I | re.S):
        if m.group(1):
            if open_:
                found.add(open_.pop())
        elif m.group(1) is not None:
            open_.append(m.start())
    return found


def page_lines(page: str, gap: int) -> Lines:
    """Strip the markup; what is not the article leaves ``gap`` empty lines."""
    out = Lines(gap)
    lower = None
    at, depth, links = 0, 0, 0  # position, open article or main elements, open links
    skip: list[str] = []  # the boilerplate element and what is open in it
    root = 0  # where that element starts
    closed: dict[str, set[int]] = {}
    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not skip:
            text = page[at:start]
            out.parts.append(text)
            if links:
                out.linked += len(text.strip())
        if start == n:
            break
        m = TAG.match(page, start) or LOOSE_TAG.match(page, start)
        if m is None:
            if not skip:
                out.parts.append("<")
            at = start + 1
            continue
        at = m.end()
        if m.lastindex is None or m.group(2) is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m.group())
            if close:
                end = page.find(close, at)
                at = n if end < 0 else end + len(close)
            continue
        closing, tag, attributes = bool(m.group(1)), m.group(2).lower(), m.group(3)
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                if lower is None:
                    lower = page.lower()
                    if len(lower) != n:  # a letter whose lower case is longer
                        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    at = n
                else:
                    end = page.find(">", end)
                    at = n if end < 0 else end + 1
            if not skip:
                out.parts.append(" ")
            continue
        if skip:
            if closing:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
                elif tag in CONTENT or tag in ("body", "html"):
                    skip.clear()
                else:
                    continue
                if skip:
                    continue
                out.blank()
                if tag not in CONTENT:
                    continue
            else:
                ends = skip == ["p"] and tag in BLOCK or (skip == ["head"] and tag == "body")
                if not ends and tag in CONTENT:
                    if skip[0] not in closed:
                        closed[skip[0]] = _closed(page, skip[0])
                    ends = root not in closed[skip[0]]
                if ends:
                    skip.clear()
                    out.blank()
                elif tag not in VOID and tag not in ("p", "li") and not attributes.rstrip().endswith("/"):
                    skip.append(tag)
                if not ends:
                    continue
        if not closing and tag not in VOID and _is_aside(tag, attributes, depth > 0):
            out.end(depth > 0)
            skip.append(tag)
            root = start
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK:
            out.end(depth > 0, closing and tag in HEADINGS)
            links = 0
            if tag not in VOID:
                out.block(closing, tag, 0 if closing else _mark(tag, attributes, depth > 0))
            if tag in CONTENT:
                depth = max(0, depth + (-1 if closing else 1))
        elif tag in ("br", "td", "th"):
            mark = 0 if closing else _mark(tag, attributes, depth > 0)
            if mark:  # a cell that is a part of the page
                out.end(depth > 0)
            if tag != "br":
                if any(t == tag and out.marks[owner][1] for t, owner in out.open[-2:]):
                    out.end(depth > 0)
                out.block(closing, tag, mark)
            out.parts.append(" ")
    out.end(depth > 0)
    return out


def kept_lines(lines: list[tuple[str, int, bool]], window: int, surge: int, share: float) -> list[str]:
    """The lines between surge and dive points."""
    named = any(inside and text for text, _, inside in lines)
    lengths = []
    for text, linked, inside in lines:
        counts = inside if named else 2 * linked <= len(text)
        lengths.append(len(text) if counts else 0)
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    least = 1 if named else min(surge, max(1.0, share * max(sums, default=0)))
    kept, open_ = [], False
    for (text, _, _), length, block in zip(lines, lengths, sums, strict=True):
        if block == 0:
            open_ = False
        elif block >= least:
            open_ = True
        if open_ and length:
            kept.append(text)
    return kept


def dropped(lines: Lines, window: int, surge: int, share: float) -> set[int]:
    """The marked blocks that are not the article, by the fullest windows of text they hold.

    Comments, adverts and notices always are.  Where the page names its article by an element, so
    is every other surely marked block.  Elsewhere a strong mark holds unless there is no surge
    without it (the block is a wrapper), and one of a part that holds no paragraphs unless the
    page's fullest window is in it.  A weak mark holds only for a block without a surge, that is
    no heading."""
    n = len(lines.marks)
    if n == 1:
        return set()
    own, below, headings_only = [0] * n, [0] * n, [True] * n
    lengths = [len(text) if 2 * linked <= len(text) else 0 for text, linked, _ in lines.rows]
    for i, ((owner, heading), row) in enumerate(zip(lines.owners, lines.rows, strict=True)):
        if row[0]:
            headings_only[owner] &= heading
        own[owner] = max(own[owner], sum(
            length for (o, _), length in zip(lines.owners[i:i + window], lengths[i:i + window], strict=True) if o == owner))
    below[:] = own
    for i in range(n - 1, 0, -1):  # a block comes after the one it is in
        parent = lines.marks[i][0]
        below[parent] = max(below[parent], below[i])
        headings_only[parent] &= headings_only[i]
    least = min(surge, max(1.0, share * max(own)))
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[lines.marks[i][0]].append(i)
    out: set[int] = set()
    full, waiting, ready = 0, [], [0]
    named = any(inside and text and not owner for (text, _, inside), (owner, _) in zip(lines.rows, lines.owners, strict=True))
    while ready or waiting:
        while ready:  # text, and the weakly marked blocks in it
            i = ready.pop()
            full = max(full, own[i])
            for c in children[i]:
                if lines.marks[c][1] == OUT:
                    out.add(c)
                elif lines.marks[c][1] != WEAK:
                    heapq.heappush(waiting, (-below[c], c))
                elif below[c] >= least or headings_only[c]:
                    ready.append(c)
                else:
                    out.add(c)
        if waiting:
            i = heapq.heappop(waiting)[1]
            peak = lines.marks[i][1] == SHORT and below[i] >= max(surge, full)
            if not named and (full < surge <= below[i] or peak):
                ready.append(i)
            else:
                out.add(i)
    for i in range(1, n):
        if lines.marks[i][0] in out:
            out.add(i)
    return out


def without_marked(lines: Lines, window: int, surge: int, share: float) -> list[tuple[str, int, bool]]:
    """The lines, those of dropped blocks replaced by a run of empty lines."""
    out = dropped(lines, window, surge, share)
    if not out:
        return lines.rows
    rows: list[tuple[str, int, bool]] = []
    gone = False
    for row, (owner, _) in zip(lines.rows, lines.owners, strict=True):
        if owner not in out:
            rows.append(row)
        elif not gone:
            rows.extend([("", 0, False)] * lines.gap)
        gone = owner in out
    return rows


def article_lines(lines: list[tuple[str, int, bool]], window: int, surge: int,
                  share: float) -> list[tuple[str, int, bool]]:
    """The lines, without the article's mark where the line blocks find more text outside it."""
    within = sum(len(text) for text, _, inside in lines if inside)
    if not within or all(inside for text, _, inside in lines if text):
        return lines
    plain = [(text, linked, False) for text, linked, _ in lines]
    outside = [(text, linked, False) if not inside else ("", 0, False) for text, linked, inside in lines]
    return plain if sum(map(len, kept_lines(outside, window, surge, share))) > within else lines


def main_text(page: str | None, *, window: int = 3, surge: int = 30, share: float = 0.05) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    if not page:
        return ""
    lines = without_marked(page_lines(page, window), window, surge, share)
    lines = article_lines(lines, window, surge, share)
    return "\n\n".join(kept_lines(lines, window, surge, share))


def extract(pages: DataFrame, *, window: int = 3, surge: int = 30, share: float = 0.05) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; a narrow transformation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, window=window, surge=surge, share=share)
                     for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()),
                 pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").transform(map_arrow, run, SCHEMA)
