"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block elements from the root to the
leaf. For every path of a page the lengths of its blocks and their punctuation marks are added up
and divided by the number of blocks; these ratios are smoothed over neighbouring blocks, nearer
paths counting more, and fused with the share of text that is not in links. Paths at or above the
standard deviation of these values are content. The articles (or, where a page has none, the
smallest container) that hold the content paths give the text: all their blocks, headings and
short notes among them too.

What HTML itself names as something else never counts: menus, asides, footers, page headers,
forms, scripts, hidden parts, and elements whose role, class or id says advert, cookie notice,
sidebar, comments and the like. A page depends on no other page, so this is one map without a
shuffle; a parse takes time linear in the page.

Defined cases: null html counts as empty; a page without content has an empty text; tags that are
not closed end where HTML says so, a page that breaks off ends there; rows are returned as often
as they come; null ids and urls are kept; further columns are ignored. Nothing is dropped for
being short or long.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Elements of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody
td template textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never content; of WEAK_TAGS those that hold no article.
STRONG_TAGS = frozenset("head noscript template nav aside footer button select option iframe menu textarea svg canvas video audio object dialog search".split())
WEAK_TAGS = frozenset("form header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in classes and ids of what is not content; of the weak ones where the element holds no article.
STRONG = re.compile(
    r"ads?|ads(?:ense|lot|box|by\w+)|advert\w*|sponsor\w*|comments?|commentlist|disqus|respond|responses?|repl(?:y|ies)|discussion|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"cookies?|consent|gdpr|related|recommend\w*|share|sharing|social|newsletter|subscribe|subscription|pagination|pager|login|signup|skip"
)
WEAK = re.compile(r"sidebars?|header|footer|banner|notices?|alerts?|widgets?|promos?|popup|modal|search|toolbar|masthead|form")
NOT_IT = frozenset(("has", "no", "with", "without"))

_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|{_TAG}|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"']\S*)))?")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# Which open elements a start tag ends, and what hides them from it.
_GROUP = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "tr": "tr", "td": "td", "th": "td", "thead": "part", "tbody": "part", "tfoot": "part", "option": "option"}
_CELLS = ("p", "li", "dd", "tr", "td", "part")
_BARRIER = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "table": ("tr", "td", "part"), "td": ("p", "li", "dd"), "th": ("p", "li", "dd"), "caption": ("p",), "button": ("p",), "template": _CELLS}
_ENDS = {"li": ("p", "li"), "dd": ("p", "dd"), "dt": ("p", "dd"), "td": ("td",), "th": ("td",), "tr": ("td", "tr"), "thead": ("td", "tr", "part"), "tbody": ("td", "tr", "part"), "tfoot": ("td", "tr", "part"), "option": ("option",)}
_OPEN_IN_P = frozenset("button caption html head body title option optgroup select iframe noscript template textarea legend".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_HOLDERS = frozenset(("html", "body", "div", "section", "main", "article", "table", "tbody", "tr", "td", "center", "form"))

#: Blocks before and after that count in smoothing, and the width of the Gauss curve.
REACH, WIDTH = 2, 1.0


class Page:
    """Elements and blocks of a page. Elements come after their parents."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.path, self.mark = ["html"], [-1], [0], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.paths: dict[tuple[int, str], int] = {}
        self.path_parent = [-1]
        self.stack, self.at = [0], {}
        self.open: dict[str, list[int]] = {g: [-1] for g in (*_CELLS, "option")}
        self.said: list[str] = []
        self.linked, self.in_link, self.muted = 0, False, 0  # muted: open inline elements that are cut
        self._parse(source)

    def _parse(self, source: str) -> None:
        end, at = len(source), 0
        while at < end:
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end])
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                self._end(name)
            elif name == "plaintext":
                self._text(source[at:])
                break
        self._flush()

    def _text(self, text: str) -> None:
        if text and not self.muted:
            text = html.unescape(text) if "&" in text else text
            self.said.append(text)
            if self.in_link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.said:
            text = " ".join("".join(self.said).split())
            if text:
                e = self.stack[-1]
                while self.tag[e] not in BLOCKS and e:
                    e = self.parent[e]
                self.blocks.append((e, text, min(self.linked, len(text))))
            self.said, self.linked = [], 0

    def _start(self, name: str, rest: str) -> None:
        if name in ("br", "wbr"):
            self.said.append(" " if name == "br" else "")
            return
        if name == "a":
            self.in_link = True
        block = name in BLOCKS
        if not block and name in VOID:
            return
        attributes = self._attributes(rest) if rest.strip(" \t\n\r\f/") else {}
        mark = self._marked(name, attributes)
        if not block and not mark:
            return
        if block:
            self._flush()
            for group in _ENDS.get(name, () if name in _OPEN_IN_P else ("p",)):
                if self.open[group][-1] >= 0:
                    self._pop(self.open[group][-1])
            if name in _HEADINGS and self.tag[self.stack[-1]] in _HEADINGS:
                self._pop(len(self.stack) - 1)
        if name in ("html", "body"):
            return
        if name not in VOID:
            self.muted += not block
            self._push(name, f"{name}.{attributes['class']}" if "class" in attributes else name, mark)

    def _push(self, name: str, label: str, mark: str) -> None:
        top, at = self.stack[-1], len(self.stack)
        path = self.paths.setdefault((self.path[top], label), len(self.path_parent))
        if path == len(self.path_parent):
            self.path_parent.append(self.path[top])
        self.stack.append(len(self.tag))
        self.tag.append(name)
        self.parent.append(top)
        self.path.append(path)
        self.mark.append(mark)
        self.at.setdefault(name, []).append(at)
        if name in _GROUP:
            self.open[_GROUP[name]][-1] = at
        for group in _BARRIER.get(name, ()):
            self.open[group].append(-1)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            name = self.tag[self.stack.pop()]
            self.at[name].pop()
            self.muted -= name not in BLOCKS
            for group in _BARRIER.get(name, ()):
                self.open[group].pop()
            if name in _GROUP:
                self.open[_GROUP[name]][-1] = -1

    def _end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in BLOCKS:
            self._flush()
        if name in _HEADINGS:
            name = max(_HEADINGS, key=lambda h: (self.at.get(h) or [-1])[-1])
        own = self.at.get(name)
        if not own:
            return
        cell = max((self.at.get(x) or [-1])[-1] for x in ("td", "th", "caption"))
        if own[-1] < cell and name not in ("table", "tr", "tbody", "thead", "tfoot"):
            return
        if name in BLOCKS:
            self._flush()
        self._pop(own[-1])

    @staticmethod
    def _attributes(rest: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(rest):
            out.setdefault(m[1].lower(), next((x for x in m.group(2, 3, 4) if x is not None), ""))
        return out

    def _marked(self, name: str, attributes: dict[str, str]) -> str:
        """strong, weak or nothing."""
        if name in STRONG_TAGS:
            return "strong"
        if name in ("html", "body"):
            return ""
        inside = bool(self.at.get("article") or self.at.get("main"))
        mark = "weak" if name in WEAK_TAGS and not (name == "header" and inside) else ""
        if not attributes:
            return mark
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            return "strong"
        if attributes.get("role", "").lower() in ROLES:
            mark = "weak"
        for said in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            words = {w.lower() for w in _WORDS.findall(said)}
            if words & NOT_IT:
                continue
            if name not in ("main", "article") and any(STRONG.fullmatch(w) for w in words):
                return "strong"
            if name == "article" and any(re.fullmatch("comments?|repl(?:y|ies)|responses?|ads?|advert\\w*|sponsor\\w*|related", w) for w in words):
                return "strong"
            if name not in ("main", "article") and any(WEAK.fullmatch(w) and not (w == "header" and inside) for w in words):
                mark = "weak"
        return mark


def path_values(paths: list[int], lengths: list[int], marks: list[int], linked: list[int], parent: list[int]) -> dict[int, float]:
    """The fused, smoothed ratio of each path; the lists have an entry for each block of a page."""
    total: dict[int, list[int]] = {}
    for p, n, m, k in zip(paths, lengths, marks, linked, strict=True):
        t = total.setdefault(p, [0, 0, 0, 0])
        t[0], t[1], t[2], t[3] = t[0] + 1, t[1] + n, t[2] + m, t[3] + k
    weight = [math.exp(-d * d / (2 * WIDTH * WIDTH)) for d in range(REACH + 1)]
    text_ratio = {p: t[1] / t[0] for p, t in total.items()}
    mark_ratio = {p: t[2] / t[0] for p, t in total.items()}
    smooth: dict[int, list[float]] = {p: [0.0, 0.0] for p in total}
    for i, p in enumerate(paths):
        a = b = w = 0.0
        for j in range(max(0, i - REACH), min(len(paths), i + REACH + 1)):
            q = paths[j]
            near = 1.0 if q == p else 0.5 if parent[q] == parent[p] else 0.25 if parent[q] == p or parent[p] == q else 0.1
            near *= weight[abs(i - j)]
            a, b, w = a + near * text_ratio[q], b + near * mark_ratio[q], w + near
        smooth[p][0] += a / w
        smooth[p][1] += b / w
    return {p: (smooth[p][0] / t[0]) * (1 + smooth[p][1] / t[0]) * (1 - t[3] / t[1]) for p, t in total.items()}


def content_blocks(source: str) -> list[str]:
    """The blocks of a page's main text, in the order of the page."""
    page = Page(source)
    n = len(page.tag)
    inner = [False] * n  # has an article or main that is none of the things that are cut
    for e in range(1, n):
        if page.tag[e] in ("article", "main") and not page.mark[e]:
            up = page.parent[e]
            while up >= 0 and not inner[up]:
                inner[up] = True
                up = page.parent[up]
    cut, home = [False] * n, [-1] * n  # home: the outermost article or, without one, main
    spoken = [False] * n  # an article with text of its own so far
    begun = {}
    for e, _, _ in page.blocks:
        begun.setdefault(e, len(begun))
    for e in range(1, n):
        up, tag = page.parent[e], page.tag[e]
        cut[e] = cut[up] or page.mark[e] == "strong" or page.mark[e] == "weak" and not inner[e]
        home[e] = home[up]
        if not cut[e] and tag == "article":
            if home[up] >= 0 and page.tag[home[up]] == "article":
                cut[e] = spoken[home[up]]  # an article in an article that has spoken: a comment, or another page's
            else:
                home[e] = e
        elif not cut[e] and tag == "main" and home[up] < 0:
            home[e] = e
        if e in begun and not cut[e] and home[e] >= 0:
            spoken[home[e]] = True
    blocks = [b for b in page.blocks if not cut[b[0]]]
    if not blocks:
        return []
    paths = [page.path[e] for e, _, _ in blocks]
    value = path_values(paths, [len(t) for _, t, _ in blocks], [len(_PUNCTUATION.findall(t)) for _, t, _ in blocks], [k for _, _, k in blocks], page.path_parent)
    least = pstdev(value.values())
    chosen = [value[p] >= least for p in paths]
    mass = [0] * n  # characters of chosen blocks below each element
    count = [0] * n
    for (e, text, _), good in zip(blocks, chosen, strict=True):
        if good:
            mass[e] += len(text)
            count[e] += 1
    homes = {home[e]: 0 for (e, _, _), good in zip(blocks, chosen, strict=True) if good and home[e] >= 0}
    for (e, text, _), good in zip(blocks, chosen, strict=True):
        if good and home[e] in homes:
            homes[home[e]] += len(text)
    if homes and 10 * sum(homes.values()) >= 3 * sum(mass):
        best = "article" if any(page.tag[h] == "article" for h in homes) else "main"
        inside = [i for i, (e, _, _) in enumerate(blocks) if home[e] in homes and page.tag[home[e]] == best]
    else:
        inside = _container(page, blocks, chosen, mass, count)
    heads = [i for i, (e, _, _) in enumerate(blocks) if page.tag[e] == "h1"]
    if inside and not set(heads) & set(inside):
        inside = [i for i in heads if i < inside[0]][-1:] + inside
    return [blocks[i][1] for i in inside]


def _container(page: Page, blocks: list[tuple[int, str, int]], chosen: list[bool], mass: list[int], count: list[int]) -> list[int]:
    """The blocks of the smallest container that holds the chosen ones, or nine tenths of them."""
    n = len(page.tag)
    for e in range(n - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        count[page.parent[e]] += count[e]
    root = 0
    for e in range(1, n):  # parents come first, so one pass leads from the root down
        if page.parent[e] == root and page.tag[e] in _HOLDERS and (mass[e] == mass[root] and count[e] > 1 or 10 * mass[e] >= 9 * mass[root] and count[e] >= 3):
            root = e
    under = [False] * n
    for e in range(n):
        under[e] = e == root or e > 0 and under[page.parent[e]]
    # list items that are all links are a menu
    return [i for i, (e, t, k) in enumerate(blocks) if under[e] and (chosen[i] or not (page.tag[e] == "li" and 10 * k >= 9 * len(t)))]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [content_blocks(x) if x else [] for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(["\n\n".join(f) for f in found], pa.string()), pa.array([len(f) for f in found], pa.int32())],
            ["id", "url", "text", "n_blocks"],
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text (blocks joined by two line ends), n_blocks for each row of pages."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return map_batches(rows, _extracted, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_blocks int")
