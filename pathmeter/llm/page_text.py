"""Main text of web pages by tag-path ratios (operator 13).

A page is read once into blocks, stretches of text between block tags, each with
the path of labelled elements from the root down to it. Characters and
punctuation are summed per path; the ratios to the path's blocks are smoothed
along the page, fused and cut at a threshold. The element that holds the chosen
paths is the article; what lies in it is kept, but for menus, adverts and the
like, which are told by element names and attribute words.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by how they take part.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe noembed noframes xmp template title textarea".split())
BLOCK = set(
    "address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold one stretch of text rather than parts of a page.
LEAF = HEADINGS | set("p li dt dd td th pre blockquote figcaption caption summary legend tr tbody thead table ul ol dl".split())
#: Start tags that end an open ``p``.
ENDS_P = BLOCK - set("br button canvas col colgroup input optgroup option select video audio body html head td th tr".split())
ENDS_P_WITHIN = set("table td th button object body".split())
#: End tags do not reach beyond these.
CELLS = set("table td th caption object body html".split())
#: A start tag ends an open element of these names, unless one of the second names lies between.
ENDS_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
}
#: Elements outside the article whatever they hold.
NEVER = RAW | set("head title nav aside form footer button select textarea input dialog menu search svg math canvas object audio video".split())
#: Words of class, id and role that name such parts, as whole words and as beginnings. An ``article`` or
#: ``main`` within a part of the first kind is an article all the same, within one of the second it is not.
AROUND_WORDS = set("nav toc form forms pager login dialog search skip tools rail alert gdpr".split())
AROUND_STARTS = tuple(
    "banner navig navbar menu breadcrumb sidebar footer header masthead cookie consent notice notification popup modal "
    "overlay newsletter subscri signup paginat widget toolbar complementary contentinfo disclaimer paywall".split()
)
NEVER_WORDS = set("ad ads adv share reply replies respond disqus".split())
NEVER_STARTS = tuple("advert adsense sponsor promo sharing social related recommend comment discussion teaser".split())
#: Words that make a "header" the one of an article, of which headings stay.
ARTICLE_WORDS = set("article post entry content story news".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A whole tag (end sign, name, attributes), the start of a comment, of another declaration, or of a tag that does not match.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(!--)|([!?])|(?=/?[a-zA-Z]))")
#: The same without a look at quotes.
_LOOSE_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(!--)|([!?])|(?=/?[a-zA-Z]))")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)", re.I)
_MARKS = re.compile("[.,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u00a1\u00bf]")

#: A path belongs to the article if its fused ratio reaches this share of the page's highest.
THRESHOLD = 0.2
#: Weights of the blocks before and after, by distance, in the smoothing along the page.
KERNEL = (1.0, 0.6, 0.15)
REACH = len(KERNEL) - 1
#: A path of which links hold more than this share of the characters is a list of links.
LINK_SHARE = 0.8
#: Of several ``article`` or ``main`` elements, the fullest is taken if it holds this share of the chosen characters.
HOLDS = 0.1
#: Paths are told apart by so many labels from the root.
PATH_LABELS = 64
#: Tags whose quotes do not close, before quotes are no longer looked at.
LOOSE_TAGS = 16


class Element:
    """An open or closed element and whether its text belongs to no article."""

    __slots__ = ("name", "parent", "at", "path", "block", "inside", "out", "around", "heads", "main")

    def __init__(self, name: str, parent: Element | None, at: int):
        self.name, self.parent, self.at = name, parent, at
        #: Number of its tag path, and the nearest block around its text.
        self.path, self.block = 0, self
        #: ``out`` for good, or ``around`` an article only; ``heads``: but for headings.
        self.out = self.around = self.heads = self.main = self.inside = False


class Block:
    """Text between two block tags, the characters of it in links, and the element around it."""

    __slots__ = ("element", "parts", "links", "text")

    def __init__(self, element: Element):
        self.element, self.parts, self.links, self.text = element, [], 0, ""


def _named(attributes: str) -> tuple[str, str, bool]:
    """(label, "out", "around" or "heads" by its words or "", whether it is hidden)."""
    label, kind, hidden = "", "", False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id", "role"):
            if name == "class":
                label = ".".join(sorted(value.split()[:3]))
            for one in value.split():
                if one.startswith(("has-", "no-", "with-")) or one.endswith(("-open", "-closed")):
                    continue
                words = [w.lower() for w in _WORD.findall(one)]
                if any(w in NEVER_WORDS or w.startswith(NEVER_STARTS) for w in words):
                    kind = "out"
                elif kind != "out":
                    at = {w for w in words if w in AROUND_WORDS or w.startswith(AROUND_STARTS)}
                    if at == {"header"} and ARTICLE_WORDS & set(words):
                        kind = kind or "heads"
                    elif at:
                        kind = "around"
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
    if "hidden" in attributes.lower() and _BARE_HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)):
        hidden = True
    return label, kind, hidden


class Page:
    """The blocks of one page that may belong to its article; end tags may be missing or wrong."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        root = Element("", None, 0)
        #: All elements in page order, those open, and how many of a name are open.
        self.elements, self.open, self.names = [root], [root], defaultdict(int)
        #: Tag paths by (path above, label), and their labels from the root.
        self.numbers: dict[tuple[int, str], int] = {}
        self.paths: list[tuple[str, ...]] = [()]
        self.fresh = True
        self._read(source)
        for block in self.blocks:
            block.text = " ".join("".join(block.parts).split())
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, raw: str) -> None:
        top = self.open[-1]
        if not raw or top.out or top.around or top.heads or self.fresh and raw.isspace():
            return
        if self.fresh:
            self.blocks.append(Block(top.block))
            self.fresh = False
        block = self.blocks[-1]
        text = html.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if self.names["a"]:
            block.links += len(text)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.fresh = True
        if name in ENDS_P and self.names["p"]:
            self._close({"p"}, ENDS_P_WITHIN)
        if name in ENDS_SAME and any(self.names[n] for n in ENDS_SAME[name][0]):
            self._close(*ENDS_SAME[name])
        if name == "a" and self.names["a"]:
            self._close({"a"}, CELLS)
        if name in VOID or name in ("html", "body") and self.names[name]:
            return
        label, kind, hidden = _named(attributes) if attributes else ("", "", False)
        if name in ("html", "body", "main"):
            kind = ""
        parent = self.open[-1]
        one = Element(name, parent, len(self.elements))
        article = name in ("article", "main")
        if name == "header":
            kind = "heads" if parent.inside else "out"
        one.out = parent.out or name in NEVER or hidden or kind == "out"
        one.around = parent.around and not article or kind == "around"
        one.heads = (parent.heads or kind == "heads") and name not in HEADINGS
        one.main = article and not (one.out or one.around)
        one.inside = parent.inside or one.main
        one.path, one.block = parent.path, parent.block
        if name in BLOCK:
            one.block = one
            if len(self.paths[parent.path]) < PATH_LABELS:
                step = (parent.path, f"{name}.{label}" if label else name)
                if step not in self.numbers:
                    self.numbers[step] = len(self.paths)
                    self.paths.append((*self.paths[parent.path], step[1]))
                one.path = self.numbers[step]
        self.names[name] += 1
        self.elements.append(one)
        self.open.append(one)

    def _close(self, names: set[str], between: set[str]) -> None:
        """Close the innermost open element of these names unless one of ``between`` is further in."""
        open_, count = self.open, self.names
        for at in range(len(open_) - 1, 0, -1):
            name = open_[at].name
            if name in names:
                for gone in open_[at:]:
                    count[gone.name] -= 1
                del open_[at:]
                return
            if name in between:
                return

    def _end(self, name: str) -> None:
        if name in BLOCK or name == "br":
            self.fresh = True
        if not self.names[name]:
            return
        if name == "table":
            self._close({name}, {"body"})
        elif name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self._close({name}, {"table", "body"})
        elif name not in ("body", "html"):
            self._close({name}, CELLS)

    def _read(self, source: str) -> None:
        at, size, loose, pattern = 0, len(source), 0, _TAG
        while tag := pattern.search(source, at):
            sign = tag.start()
            if sign > at:
                self._text(source[at:sign])
            name = tag[2]
            if name is None:
                if tag[4]:
                    stop = source.find("-->", sign + 2)
                    stop += 2 * (stop > sign)
                else:
                    stop = source.find(">", sign)
                    if not tag[5] and stop > sign:
                        loose += 1
                        pattern = _LOOSE_TAG if loose >= LOOSE_TAGS else _TAG
                        tag = _LOOSE_TAG.match(source, sign)
                        name = tag[2]
                if stop <= sign:
                    return
                at = stop + 1
                if name is None:
                    continue
            else:
                at = tag.end()
            name = name.lower()
            if tag[1]:
                self._end(name)
                continue
            self._start(name, tag[3])
            if name in RAW:
                stop = re.compile(rf"</{name}\b", re.I).search(source, at)
                if stop is None:
                    return
                at = stop.start()
        self._text(source[at:size])


def punctuation(text: str) -> int:
    return len(_MARKS.findall(text))


def path_ratios(blocks: list[Block], paths: list[tuple[str, ...]]) -> tuple[list[float], list[bool]]:
    """(fused ratio of each block's path, whether the path holds links only).

    The ratios are characters outside links, and punctuation, over the blocks
    of a path. Each block gets those of its path, then a weighted mean with its
    neighbours on the page in which paths count by their shared beginning; the
    fused value of a path is the mean over its blocks of the geometric mean of
    both, each over its highest value on the page.
    """
    sums: dict[int, list[float]] = {}
    for block in blocks:
        size = len(block.text)
        free = max(size - block.links, 0)
        row = sums.setdefault(block.element.path, [0, 0, 0, 1])
        row[0] += 1
        row[1] += size
        row[2] += free
        row[3] += punctuation(block.text) * free / size
    of = [b.element.path for b in blocks]
    by_path = {p: (free / n, marks / n) for p, (n, _, free, marks) in sums.items()}
    likeness: dict[tuple[int, int], float] = {}
    smooth = []
    for i, here in enumerate(of):
        chars = marks = weight = 0.0
        for j in range(max(0, i - REACH), min(len(of), i + REACH + 1)):
            there = of[j]
            if (here, there) not in likeness:
                likeness[here, there] = _likeness(paths[here], paths[there])
            w = KERNEL[abs(i - j)] * likeness[here, there]
            chars += w * by_path[there][0]
            marks += w * by_path[there][1]
            weight += w
        smooth.append((chars / weight, marks / weight))
    most = max(c for c, _ in smooth) or 1.0, max(m for _, m in smooth) or 1.0
    fused = dict.fromkeys(sums, 0.0)
    for here, (chars, marks) in zip(of, smooth):
        fused[here] += sqrt(chars / most[0] * marks / most[1]) / sums[here][0]
    links = {p: size - free > LINK_SHARE * size for p, (_, size, free, _) in sums.items()}
    return [fused[p] for p in of], [links[p] for p in of]


def _likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Squared share of the labels that two paths begin with alike; 1 for a path and itself."""
    if a == b:
        return 1.0
    shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return (shared / max(len(a), len(b))) ** 2


def main_text(source: str) -> str:
    """Text of the article of one page; empty if there is none."""
    page = Page(source)
    blocks = page.blocks
    if not blocks:
        return ""
    ratio, link_only = path_ratios(blocks, page.paths)
    limit = THRESHOLD * max(ratio)
    good = [r >= limit for r in ratio]
    prose = [g and not l for g, l in zip(good, link_only)]
    chosen = prose if any(prose) else good
    article = _article(page, chosen)
    within = [False] * len(page.elements)
    for one in page.elements[1:]:
        within[one.at] = one is article or within[one.parent.at]
    kept = []
    for block, yes, links in zip(blocks, chosen, link_only):
        inside = within[block.element.at]
        if article is not None and article.main:
            yes = inside
        elif inside:
            yes = yes or not (links and block.element.name == "li")
        if yes:
            kept.append(block.text)
    return " ".join(kept)


def _article(page: Page, chosen: list[bool]) -> Element | None:
    """The element with the chosen blocks: the ``article`` or ``main`` with most of their characters,
    else from the root down as long as one child that can hold parts has nine tenths."""
    mass, text = [0] * len(page.elements), [0] * len(page.elements)
    for block, yes in zip(page.blocks, chosen):
        text[block.element.at] += 1
        mass[block.element.at] += len(block.text) if yes else 0
    for one in reversed(page.elements[1:]):
        mass[one.parent.at] += mass[one.at]
        text[one.parent.at] += text[one.at]
    for name in ("article", "main"):
        named = [e for e in page.elements if e.main and e.name == name and text[e.at]]
        best = max(named, key=lambda e: mass[e.at], default=None)
        if best is not None and (len(named) == 1 or mass[best.at] >= HOLDS * mass[0]):
            return best
    at = page.elements[0]
    for one in page.elements[1:]:
        if one.parent is at and mass[one.at] >= 0.9 * mass[0] and one.name not in LEAF:
            at = one
    # The body itself is no article: only chosen paths are kept there.
    return at if at.name not in ("", "html", "body") else None


def extract(pages: DataFrame, source: str = "html", text: str = "text", length: str = "n_chars") -> DataFrame:
    """Add ``text``, the main text of every page, and ``length``, its code points.

    Every row and every other column stays, in one pass without a shuffle; only
    ``source`` goes through Python. Columns of the new names are replaced. A
    null or empty page, and one without any text, gives the empty string.
    Character references are decoded, white space within a block becomes one
    space and blocks are joined in page order by one space. A page that breaks
    off inside a comment, script or tag is read up to there. Repeated rows give
    repeated results; a page of any length is read as a whole.
    """

    @F.pandas_udf("string")
    def article(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p) if p else "" for p in part], index=part.index, dtype=object)

    kept = [c for c in pages.columns if c not in (text, length)]
    made = pages.select(*[F.col(f"`{c}`") for c in kept], article(F.col(source)).alias(text))
    return made.withColumn(length, F.length(text).cast("long"))
