"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that form blocks, and the elements among them that hold one paragraph.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3".split())
LISTS = frozenset("ul ol dl menu table tbody thead tr li dd blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold article text; those that do only if an article lies in them; roles.
NEVER = RAW | frozenset("head noscript template svg math canvas audio video object map button select datalist input option dialog".split())
UNLESS_AROUND = frozenset("nav footer aside form header menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status note".split())
#: Words of class and id that mark menus, notices, adverts, forms and reader comments.
MARKED = frozenset(
    "ad ads adv advert advertisement adsbygoogle adbox banner billboard breadcrumb breadcrumbs byline captcha comment comments commentlist "
    "consent cookie cookies dfp disclaimer discussion disqus footer footnav gdpr header hidden login masthead menu menubar modal nav navbar "
    "navigation newsletter notice noprint outbrain overlay pager paginate pagination paywall popup print promo promoted promotion rail "
    "recommended related replies reply respond responses search share sharing shoutbox sidebar sidenav signin signup skip social "
    "sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar tracking warning widget widgets".split()
)
#: Those among them that mark reader comments, however long these are.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: Words before and after a mark that say something of an element around the marked one, and words of class and id
#: that name such an element.
ABOUT = frozenset("has have no non not with without".split())
STATES = frozenset("allowed closed disabled enabled layout mode off on open opened page template theme view".split())
LAYOUTS = frozenset("layout page template theme".split())
#: Words that say nothing beside a mark, and marks that paragraphs of an article may have.
PARTS = frozenset(
    "area author bar block body bottom box button buttons caption container content count date footer form group heading icon info inner item items label left "
    "link links list meta name outer panel post right row section slot small text title top unit wrap wrapper".split()
)
LEADS = frozenset("teaser header print".split())
#: The share of its points that an element keeps if it is marked, and if it is marked but named for a layout; and the
#: points that a marked one needs on a page without any others.
KEPT, KEPT_LAYOUT, LEAST = 0.1, 0.5, 8.0
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)?)*+)>?",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_COMMAS = re.compile("[,،、，]")
#: Fixed values: (what a start tag closes, what keeps it from looking further up).
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}


class _Page:
    """The tree as parallel lists (a parent precedes its children), and its blocks: lists of (node, text).

    Open elements are looked up by name and by the nearest block, never by walking up, so that reading is linear in the page."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [0], [""]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._stack, self._block, self._run = [0], [0], []  # open elements, and the depth of the nearest block of each
        self._depths: defaultdict[str, list[int]] = defaultdict(list)
        self._read(source)

    def _flush(self) -> None:
        if self._run:
            self.blocks.append((self._stack[self._block[-1]], self._run))
            self._run = []

    def _push(self, name: str, attrs: str) -> None:
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.attrs.append(attrs)
        depth = len(self._stack)
        self._block.append(depth if name in BLOCKS else self._block[-1])
        self._stack.append(len(self.tag) - 1)
        self._depths[name].append(depth)

    def _cut(self, depth: int) -> None:
        """Ends the open elements from a depth on."""
        while len(self._stack) > depth:
            self._depths[self.tag[self._stack.pop()]].pop()
            self._block.pop()

    def _nearest(self, names: tuple[str, ...]) -> int:
        return max((self._depths[n][-1] for n in names if self._depths[n]), default=0)

    def _close(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Ends the nearest open element of these names, unless a stop lies nearer."""
        depth = self._nearest(names)
        if depth and depth > self._nearest(stops):
            self._cut(depth)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            text = source[at : found.start() if found else size]
            if text:
                self._run.append((self._stack[-1], html.unescape(text)))
            if not found:
                break
            at = found.end()
            if found[2]:
                name = found[2].lower()
                (self._end if found[1] else self._start)(name, found[3])
                if not found[1] and name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = end.start() if end else size
        self._flush()

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCKS:
            self._flush()
            if name in _CLOSES:
                self._close(*_CLOSES[name])
            else:
                self._close(("p",), ("table", "td", "th", "article", "body", "button"))
        if name == "br":
            self._run.append((self._stack[-1], " "))
        self._push(name, attrs)
        if name in VOID:
            self._cut(len(self._stack) - 1)

    def _end(self, name: str, attrs: str) -> None:
        block = name in BLOCKS
        if block:
            self._flush()
        depth = self._nearest((name,))
        if name not in VOID and depth and (block or depth > self._block[-1]):
            self._cut(depth)


def _marked(value: str) -> tuple[frozenset[str], bool, bool]:
    """Of a class or id: its words that mark no article text, except those that only say what an element has, lacks or is set to;
    whether another word has a meaning of its own; and whether one names a layout."""
    found: set[str] = set()
    other = layout = False
    for name in value.split():
        own = [w.lower() for w in _WORDS.findall(name)]
        for before, w, after in zip(["", *own], own, [*own[1:], ""]):
            if w in MARKED and before not in ABOUT and after not in STATES:
                found.add(w)
            else:
                other |= w not in MARKED and w not in PARTS
                layout |= w in LAYOUTS
    return frozenset(found), other, layout


def _marks(attrs: str, paragraph: bool) -> tuple[bool, float, bool]:
    """Of a start tag's attributes: whether they hide the element, the share of its points that they leave it, and whether
    they mark it as reader comments. On paragraphs and what lies in them a mark counts if no word beside it has a
    meaning of its own."""
    hides, roles, other, layout, words = False, False, False, False, frozenset()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hides = True
        elif name == "style":
            hides |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            roles |= value.lower() in ROLES
        elif name in ("class", "id"):
            found, odd, wide = _marked(value)
            words, other, layout = words | found, other or odd, layout or wide
    if paragraph and (other or words <= LEADS):
        words = frozenset()
    share = KEPT if roles else 1.0
    return hides, min(share, KEPT_LAYOUT if layout else KEPT) if words else share, bool(words & COMMENTS)


def _points(text: str) -> float:
    """What a paragraph passes to the elements around it: more for commas and, up to a limit, for length."""
    return 1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)


def _wrappers(parent: list[int], share: list[float], never: list[bool], comments: list[bool], points: list[float]) -> None:
    """Takes the mark off elements that are around the text rather than beside it, by raising their share to 1.

    A marked element's points count by its share only. The outermost one with most points loses its mark if these are still more
    than those of all unmarked text, and so on inwards. Reader comments stay marked, and so does what has fewer than LEAST points
    and is not named for a layout."""
    count = len(parent)
    children: list[list[int]] = [[] for _ in range(count)]
    total, under = [0.0] * count, [False] * count
    for n in range(1, count):
        never[n] |= never[parent[n]]
        children[parent[n]].append(n)
    for n in range(count - 1, -1, -1):
        total[n] += 0 if never[n] else points[n]
        if n:
            total[parent[n]] += total[n]
    outside = 0.0
    tops: list[tuple[float, int]] = []

    def add(start: int) -> None:
        """Collects the outermost marked elements below start and the points around them."""
        nonlocal outside
        stack = [start]
        while stack:
            n = stack.pop()
            if never[n] or under[n]:
                continue
            under[n] = True
            outside += points[n]
            for c in children[n]:
                if share[c] == 1:
                    stack.append(c)
                elif not comments[c] and (total[c] >= LEAST or share[c] > KEPT):
                    heapq.heappush(tops, (-share[c] * total[c], c))

    add(0)
    while tops:
        most, best = heapq.heappop(tops)
        if outside >= -most:
            return
        share[best] = 1.0
        add(best)


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in order, one a line; empty if there is none.

    Every paragraph has points, one and more for its length and commas. An element that is marked as no article text keeps a
    tenth of its points, or half if its class also names a layout; it is left out unless these are more than the points of all unmarked text,
    and at least LEAST before or named for a layout. What is hidden, reader comments, or made up of links is left out anyway.
    The others pass their points to the elements around them, less with each level; an element's
    sum is discounted by the share of its text that lies in links. The best element is kept, or the article or
    main element around it, with those of its siblings that score a fifth as much, and prose and headings beside it.
    """
    page = _Page(source or "")
    tag, parent, count = page.tag, page.parent, len(page.tag)
    around = [t in ("article", "main") for t in tag]  # an article lies in it, or it is one
    inside, nested = list(around), [False] * count
    for n in range(count - 1, 0, -1):
        around[parent[n]] |= around[n]
    in_link, paragraph = [False] * count, [False] * count
    never, share, comments = [False] * count, [1.0] * count, [False] * count
    for n in range(1, count):
        inside[n] |= inside[parent[n]]
        nested[n] = nested[parent[n]] or tag[parent[n]] == "article"
        in_link[n] = tag[n] == "a" or in_link[parent[n]]
        paragraph[n] = tag[n] in PARAGRAPHS or tag[n] not in BLOCKS and paragraph[parent[n]]
        hides, share[n], comments[n] = _marks(page.attrs[n], paragraph[n]) if page.attrs[n].strip() else (False, 1.0, False)
        named = tag[n] in UNLESS_AROUND and not (tag[n] == "header" and inside[n])
        comments[n] |= tag[n] == "article" and nested[n]
        never[n] = hides or tag[n] in NEVER or tag[n] == "label" and not paragraph[parent[n]]
        if tag[n] == "article" and nested[n] or named:
            share[n] = min(share[n], KEPT)
        if tag[n] in ("html", "body") or around[n] and not (tag[n] == "article" and nested[n]):
            share[n] = 1.0
    points = [0.0] * count
    for owner, run in page.blocks:
        text = "".join(t for n, t in run if not in_link[n] and not never[n]).strip()
        points[owner] += _points(text) if text else 0
    _wrappers(parent, share, list(never), comments, points)
    gone = [False] * count
    for n in range(1, count):
        gone[n] = gone[parent[n]] or never[n] or share[n] < 1
    chars, linked, links = [0] * count, [0] * count, [t == "a" for t in tag]
    blocks: list[tuple[int, str]] = []
    for owner, run in page.blocks:
        own = [(n, t) for n, t in run if not gone[n]]
        text = " ".join("".join(t for _, t in own).split())
        if text:
            blocks.append((owner, text))
            chars[owner] += len(text)
            linked[owner] += sum(len(t) for n, t in own if in_link[n])
    for n in range(count - 1, 0, -1):
        for sums in (chars, linked, links):
            sums[parent[n]] += sums[n]
    density = [min(1.0, k / c) if c else 0.0 for k, c in zip(linked, chars)]
    for n in range(1, count):
        gone[n] |= gone[parent[n]] or tag[n] in BLOCKS and tag[n] != "p" and not around[n] and links[n] >= 3 and density[n] > 0.7
    blocks = [(n, t) for n, t in blocks if not gone[n]]
    score = [0.0] * count
    for owner, text in blocks:
        n = parent[owner] if tag[owner] in PARAGRAPHS else owner
        for level in range(6):
            score[n] += _points(text) / (1, 2, 6, 9, 12, 15)[level]
            if n == 0:
                break
            n = parent[n]
    score = [s * (1 - d) for s, d in zip(score, density)]
    best = max(range(count), key=lambda n: score[n])
    if not score[best]:
        return "\n".join(t for _, t in blocks) if all(tag[n] in ("#root", "html", "body") for n, _ in blocks) else ""
    best = next((a for kind in ("article", "main") for a in [best, *_ancestors(parent, best)] if tag[a] == kind), best)
    while tag[best] in LISTS:
        best = parent[best]
    sums: list[list[str]] = [[] for _ in range(count)]
    for n, t in blocks:
        sums[n].append(t)
    keep = [n == best for n in range(count)]
    for n in range(1, count):
        if n != best and parent[n] == parent[best] and best:
            own = " ".join(sums[n])
            prose_like = tag[n] == "p" and density[n] < 0.25 and (len(own) >= 80 or own.endswith((".", "!", "?", "…")))
            keep[n] = prose_like or tag[n] in HEADINGS and not linked[n] or score[n] >= max(score[best] / 5, 2)
    for n in range(1, count):
        keep[n] |= keep[parent[n]]
    return "\n".join(t for n, t in blocks if keep[n])


def _ancestors(parent: list[int], n: int) -> Iterator[int]:
    while n:
        n = parent[n]
        yield n


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html); other columns are ignored.

    text is main_text() of the whole html: character references decoded, white space within a block turned into one space,
    blocks joined by one line break; n_chars counts its code points. Null and empty pages, and those without
    an article, have an empty text. Rows are read one by one, so repeated rows give equal results.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
