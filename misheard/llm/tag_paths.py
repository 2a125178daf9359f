"""Main text of web pages by tag-path ratios.

A page is cut into tags and text. Every text has a path: the open elements from
the root to it, with their class and role names. Per path the characters, the
punctuation marks and the characters of links are summed over all its texts; the
ratios (per text of the path) are smoothed over the paths in page order and fused
to one score. What a path is part of scales its score: an article or main element
raises it; class and id names of furniture (sidebars, notices, adverts, comments),
a heading that announces reader comments, links, and a place after the end of the
best path's text lower it. Paths that reach a part of the best score are content on
every page, and so are headings, lists and short lines that stand in the same
container as content, unless they are lists of links. Elements that mark page
furniture (menus, headers, footers, forms) are left out at once, and so is what is
named so and does not hold the best path.

Elements of equal path cannot be told apart: comments in a container of the very
path of the text stay.

White space inside a block becomes one space, blocks are joined by a line break.
Null and empty pages give empty text, no pages no rows. Pages are independent: map
only; ids may be null or repeat; other columns, clashing names too, are not read.
"""

import html
import re
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by what they mean for reading.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
FURNITURE = frozenset("nav footer aside form button select option textarea label dialog menu fieldset".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr""".split()
)
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split()
)
# An element that ends when one of its kind begins.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NAMES = re.compile(
    r"""(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|foot\w*|sidebar\w*|side-?bar"""
    r"""|comment\w*|disqus\w*|respond|repl(?:y|ies)|cookie\w*|consent\w*|gdpr|notice\w*|popup\w*|modal\w*|overlay\w*"""
    r"""|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscribe\w*|signup|login|pagination|pager"""
    r"""|widget\w*|alert\w*|(?:site|page|top)[-_]?header|top[-_]?bar|masthead|copyright|legal|disclaimer|skip(?:-?link)?|toolbar|search)(?![a-z])""",
    re.I,
)
# Elements that shape text inside a container; others that are not inline contain it.
SHAPES = frozenset(
    """p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd blockquote pre figure figcaption table caption
    thead tbody tfoot tr td th address center details summary section""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Headings of reader comments, as a whole.
COMMENTS = re.compile(
    r"\W*(?:\d+\W+)?(?:(?:reader|user|leave an?|post an?|write an?|add an?|all|join the)\s+)*"
    r"(?:comments?|reply|replies|kommentare?|commentaires?|comentarios?)(?:\W+\d+)?\W*", re.I
)
# Factors of a path's score.
NAMED_PART = 0.2     # named like furniture
ARTICLE_PART = 4.0   # in an article or main element
TAIL_PART = 0.3      # in another container, after the end of the best path's text
PLAIN_PART = 0.5     # without any punctuation
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe")}
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，！？¿¡\"'«»‘-‟]")


class _Paths:
    """The tag paths of a page as a tree: number, parent and name of each."""

    def __init__(self):
        self.parent, self.name, self.known = [-1], [""], {}
        self.named: set[int] = set()     # paths whose last element is named like furniture

    def child(self, parent: int, name: str, named: bool = False) -> int:
        found = self.known.get((parent, name))
        if found is None:
            found = self.known[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
            if named:
                self.named.add(found)
        return found

    def above(self, path: int):
        while path > 0:
            yield path
            path = self.parent[path]

    def element(self, path: int) -> str:
        return self.name[path].split(".")[0]

    def inherited(self, own) -> list[int]:
        """Of every path the nearest element at or above it that is `own`, else the root."""
        found = [0]
        for p in range(1, len(self.parent)):
            found.append(p if own(p) else found[self.parent[p]])
        return found


class _Element:
    __slots__ = ("name", "path", "skip", "inline", "article", "link")

    def __init__(self, name: str, path: int, skip: bool, article: bool, link: bool = False):
        self.name, self.path, self.skip, self.article, self.link = name, path, skip, article, link
        self.inline = name in INLINE


def _is_named(value: str) -> bool:
    """Whether a class or id is a name of furniture as a whole, or made of such names."""
    return any(
        NAMES.fullmatch(token) or all(NAMES.fullmatch(x) for x in re.split("[-_]+", token.strip("-_")))
        for token in value.split()
    )


def _marks(name: str, attrs: str, header_is_part: bool) -> tuple[str, bool, bool]:
    """(name with classes, whether the element is page furniture or unseen, whether
    it is only named like furniture)."""
    named = False
    skip = name in FURNITURE or name in HIDDEN or (name == "header" and not header_is_part)
    label = name
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                label += "." + ".".join(value.split())
                named = named or (name not in ("body", "html", "article", "main") and _is_named(value))
            elif key == "role":
                skip = skip or value.lower() in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                skip = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                skip = True
    return label, skip, named


def texts(page: str, paths: _Paths):
    """(path, block number, whether it is furniture, whether it is a link's, text) of every text."""
    stack = [_Element("", 0, False, False)]
    opened: Counter = Counter()
    at, block, n = 0, 0, len(page)

    def end(depth: int) -> None:
        opened.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    while at <= n:
        m = _TOKEN.search(page, at)
        top = stack[-1]
        if (m.start() if m else n) > at and top.name not in HIDDEN:
            yield top.path, block, top.skip, top.link, html.unescape(page[at : m.start() if m else n])
        if not m:
            return
        at = m.end()
        if m["cdata"] is not None:
            yield top.path, block, top.skip, top.link, m["cdata"]
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE and name != "br":
            block += 1
        if m["close"]:
            if opened[name]:
                end(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name == "br":
            yield top.path, block, top.skip, top.link, " "
            continue
        if name in VOID:
            continue
        _close_for(stack, name, end)
        parent = stack[-1]
        label, skip, named = _marks(name, m["attrs"] or "", parent.article)
        path = parent.path if name in INLINE and not (skip or named) else paths.child(parent.path, label, named)
        link = parent.link or name == "a" and "href" in (m["attrs"] or "").lower()
        stack.append(_Element(name, path, parent.skip or skip, parent.article or name in ("article", "main"), link))
        opened[name] += 1
        if name in _RAW:
            close = _RAW[name].search(page, at)
            at = close.start() if close else n


def _close_for(stack: list, name: str, end) -> None:
    """End what the start of an element ends: an open paragraph, with inline
    elements left open in it, or the sibling before it."""
    wanted = ("p",) if name in CLOSES_P else SIBLINGS.get(name)
    if not wanted:
        return
    for k in range(len(stack) - 1, 0, -1):
        e = stack[k]
        if e.name in wanted:
            end(k)
            return
        if not (e.inline or name in SIBLINGS and e.name == "p"):
            return


def _smooth(values: list[float]) -> list[float]:
    """A centred mean of three, with double weight in the middle."""
    if len(values) < 2:
        return values
    padded = [values[0], *values, values[-1]]
    return [(padded[k] + 2 * padded[k + 1] + padded[k + 2]) / 4 for k in range(len(values))]


def _scores(found: list[tuple[int, int, bool, str]], paths: _Paths) -> tuple[dict[int, float], dict[int, float]]:
    """(score, part of links) of every path with text, in page order."""
    chars: Counter = Counter()
    marks: Counter = Counter()
    links: Counter = Counter()
    blocks: dict[int, set] = {}
    for path, block, link, text in found:
        if text and not text.isspace():
            size = len(text.strip())
            chars[path] += size
            links[path] += size * link
            marks[path] += len(_MARKS.findall(text))
            blocks.setdefault(path, set()).add(block)
    order = list(chars)
    text_ratio = [chars[p] / len(blocks[p]) for p in order]
    mark_ratio = [marks[p] / len(blocks[p]) for p in order]
    article = paths.inherited(lambda p: paths.element(p) in ("article", "main"))
    linked = {p: links[p] / chars[p] for p in order}
    score = {}
    # a path's own ratios count as far as they exceed the smoothed ones; the
    # summed text keeps a path of many short paragraphs
    for p, a, sa, b, sb in zip(order, text_ratio, _smooth(text_ratio), mark_ratio, _smooth(mark_ratio)):
        fused = sqrt(max(a, sa) * (1 + max(b, sb)) * chars[p])
        fused *= max(0.05, 1 - linked[p]) * (1 if marks[p] else PLAIN_PART)
        score[p] = fused * (ARTICLE_PART if article[p] else 1)
    return score, linked


def content_paths(found: list[tuple[int, int, bool, str]], paths: _Paths, part: float = 0.15) -> set[int]:
    """The paths of content, from (path, block, whether a link's, text) of all texts
    in order: those that reach the part of the best score, and what shapes text in
    their containers."""
    score, linked = _scores(found, paths)
    if not score:
        return set()
    element = [paths.element(p) for p in range(len(paths.parent))]
    container = paths.inherited(
        lambda p: element[p] not in SHAPES and element[p] not in INLINE or paths.name[p].startswith("section.")
    )
    for path, _, _, text in found:
        if element[path] in HEADINGS and COMMENTS.fullmatch(text.strip()):
            paths.named.add(container[path])
    # furniture is what is named so and does not hold the best path
    above = [frozenset()]
    for p in range(1, len(paths.parent)):
        above.append(above[paths.parent[p]] | {p} if p in paths.named else above[paths.parent[p]])
    for p in score:
        score[p] *= NAMED_PART if above[p] else 1
    best = max(score, key=lambda p: (score[p], -p))
    holds = set(paths.above(best)) | {0}
    end = max(k for k, (path, _, _, text) in enumerate(found) if path == best and not text.isspace())
    first: dict[int, int] = {}
    for k, (path, _, _, text) in enumerate(found):
        if text and not text.isspace():
            first.setdefault(container[path], k)
    article = paths.inherited(lambda p: element[p] == "article")
    for p in score:
        if container[p] not in holds and first[container[p]] > end and article[p] in holds:
            score[p] *= TAIL_PART
    inner = [p for p in score if above[p] <= above[best]]
    chosen = {p for p in inner if score[p] >= part * score[best]}
    within = paths.inherited(lambda p: element[p] in ("article", "main"))
    homes = {container[p] for p in chosen}
    homes |= {q for p in chosen for q in paths.above(container[p]) if within[q] and container[q] == q}
    chosen |= {p for p in inner if container[p] in homes and (linked[p] <= 0.5 or element[p] in HEADINGS)}
    if not any(element[p] == "h1" for p in chosen):
        chosen |= {p for p in inner if element[p] == "h1" and container[p] in holds}
    return chosen


def extract(page: str | None) -> str:
    """The main text of a page."""
    paths = _Paths()
    kept = [(path, block, link, text) for path, block, skip, link, text in texts(page or "", paths) if not skip]
    content = content_paths(kept, paths)
    lines, last = [], None
    for path, block, _, text in kept:
        if path in content:
            if block != last:
                lines.append([])
                last = block
            lines[-1].append(text)
    joined = (_SPACE.sub(" ", "".join(line)).strip() for line in lines)
    return "\n".join(line for line in joined if line)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            found = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long"
    )
