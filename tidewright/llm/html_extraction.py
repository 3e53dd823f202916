"""Main text of web pages by two passes over their blocks: rules first, then neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches

#: Frequent function words by language. A parameter of ``extract``.
STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the of and to a in is that it for was on with as be by this are at from or an but not have has had they you we he she his her its their which who will would can".split()),
    "de": frozenset("der die und in den von zu das mit sich des für auf im ist nicht dem ein eine als auch es an er hat aus bei sie nach wird sind am wie einer um war noch oder".split()),
    "fr": frozenset("de la le et les en des un du une que est pour qui dans par sur au pas avec il elle ne se ce sont plus ou mais nous vous leur cette ses aux".split()),
    "es": frozenset("de la que el en y los se del las un por con no una para su es al lo como más pero sus le ya o este sí porque esta entre cuando muy".split()),
}

#: Fixed values of HTML: elements whose text is no text, those that end a block, those without an end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without end tags that the key ends by beginning; the search for them stops at BOUNDARY.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ITEMS = frozenset("li dt dd tr td th option".split())
BOUNDARY = frozenset("ul ol dl table menu select".split())
#: Elements and roles that are never the main text.
ASIDE = frozenset("nav footer aside script style title noscript template iframe object svg canvas audio video select button textarea dialog menu head xmp noembed noframes".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class and id names that tell such places, those of headers, those of the main text and those that turn a name's sense.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus feedback footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser teasers toolbar widget widgets".split()
)
HEADER_NAMES = frozenset(["header", "topbar"])
MAIN_NAMES = frozenset("article content entry story main post".split())
TURNED = frozenset("has with no without not is".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*))>""")
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")


@dataclass
class Block:
    """Text between two borders of blocks, with what the rules ask of it."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    main: int = 0
    aside: bool = False
    text: str = ""


@dataclass
class _Open:
    """An element that has not ended: where it is, told once when it begins."""

    name: str
    aside: str = ""
    main: int = 0
    link: bool = False
    heading: bool = False


def _names(value: str) -> set[str]:
    """The parts of class names and ids, lower-cased; a name with a word that turns it says nothing."""
    found: set[str] = set()
    for name in value.split():
        parts = {x.lower() for x in _NAME.findall(name)}
        if not parts & TURNED:
            found |= parts
    return found


def _opened(name: str, attributes: str, parent: _Open, number: int) -> _Open:
    """What the element tells of its text, beside what its parent does. ``aside`` is why it is not the main text, if so."""
    at = _Open(name, parent.aside, parent.main, parent.link or name == "a", parent.heading or name in HEADINGS)
    if name in ("article", "main"):
        at.main = at.main or number
        if at.aside in ("form", "header") or name == "main":
            at.aside = ""
    if not at.aside:
        if name in ASIDE:
            at.aside = "element"
        elif name == "form":
            at.aside = "form"
        elif name == "header":
            at.aside = "header"
    if attributes and name not in ("html", "body"):
        names: set[str] = set()
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "role":
                if value.lower() in ASIDE_ROLES:
                    at.aside = at.aside or "role"
                elif value.lower() == "main":
                    at.main = at.main or number
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                at.aside = at.aside or "hidden"
            elif key in ("class", "id"):
                names |= _names(value)
        if names and name != "main":
            if names & ASIDE_NAMES:
                at.aside = at.aside or "name"
            elif names & HEADER_NAMES:
                at.aside = at.aside or "header"
            elif names & MAIN_NAMES:
                at.main = at.main or number
    return at


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in their order, without scripts and comments, character references decoded.

    Read once from start to end: an end tag closes up to the last open element of its
    name and is passed over where there is none; paragraphs, list items and cells end
    where the next one begins. After a tag that never ends, the rest is text.
    """
    found: list[Block] = []
    stack = [_Open("")]
    now = Block()
    opened: Counter[str] = Counter()
    pattern, place, number, breaks = _TAG, 0, 0, 0

    def cut(depth: int) -> None:
        """End the elements from ``depth`` on."""
        opened.subtract(at.name for at in stack[depth:])
        del stack[depth:]

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                found.append(now)
        now = Block()

    def add(raw: str) -> None:
        nonlocal breaks
        top = stack[-1]
        text = html.unescape(raw) if "&" in raw else raw
        if not now.parts:
            now.aside = bool(top.aside) and not (top.aside == "header" and top.main and top.heading)
            now.main, now.heading = top.main, top.heading
        now.parts.append(text)
        if text.strip():
            breaks = 0
            if top.link:
                now.linked += len("".join(text.split()))

    while True:
        opening = _NEXT.search(page, place)
        if opening is None:
            add(page[place:])
            break
        start = opening.start()
        if start > place:
            add(page[place:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            place = len(page) if stop < 0 else stop + 3
            continue
        if page[start + 1] in "!?" or (page[start + 1] == "/" and not page[start + 2 : start + 3].isalpha()):
            stop = page.find(">", start)
            place = len(page) if stop < 0 else stop + 1
            continue
        tag = pattern.match(page, start)
        if tag is None:
            pattern = _SIMPLE
            tag = pattern.match(page, start)
            if tag is None:
                add(page[start:])
                break
        place = tag.end()
        name = tag[2].lower()
        if name == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                add(" ")
            continue
        if name in BLOCKS:
            close()
        if tag[1]:
            if opened[name] > 0:
                cut(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name == name))
            continue
        if name in VOID:
            continue
        if name in BLOCKS and (opened["p"] > 0 or any(opened[x] > 0 for x in ENDS.get(name, ()))):
            cut(_implied(stack, name))
        number += 1
        at = _opened(name, tag[3], stack[-1], number)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, place)
            if end is None:
                break
            place = page.find(">", end.end())
            if place < 0:
                break
            place += 1
            continue
        if not tag[3].endswith("/") or name in BLOCKS:
            stack.append(at)
            opened[name] += 1
    close()
    return found


def _implied(stack: list[_Open], name: str) -> int:
    """From which depth on the element ``name`` ends the paragraph, item or cell that is open."""
    end = len(stack)
    for depth in range(len(stack) - 1, 0, -1):
        at = stack[depth].name
        if at == "p":
            end = depth
        elif at in ENDS.get(name, ()):
            return depth
        elif at in BOUNDARY or (at in BLOCKS and at not in ITEMS and at not in HEADINGS):
            return end
    return end


def label(found: list[Block], stop_words: dict[str, frozenset[str]], short: int = 70, dense: float = 0.18, sparse: float = 0.06, most_linked: float = 0.5) -> list[bool]:
    """Whether each block is main text.

    Places that say what they are (menus, footers, forms, adverts, comments and so on)
    are left out at once and have no voice. In the first pass a block of which
    ``most_linked`` or more is links is not text; of the others one of ``short``
    characters or more is text with a share of stop words of ``dense`` or more and not
    text below ``sparse``. Stop words are those of the language that the page has
    most of in blocks of that length; on a page that has none, length alone decides.
    Within an article or its like, what is no list of links is only ever found to be
    text or left open. In the second pass what is open takes the label of the nearest decided block, of two at
    the same distance text; in an article only its own blocks are asked. Where there
    is none to ask, it is text.
    """
    told: list[bool | None] = [None] * len(found)
    plain = [_WORD.findall(b.text.lower()) if not b.aside and len(b.text) >= short else [] for b in found]
    hits = {lang: sum(sum(map(known.__contains__, words)) for words in plain) for lang, known in stop_words.items()}
    lang = max(hits, key=hits.get, default=None)
    known = stop_words[lang] if lang is not None and hits[lang] else None
    open_: list[int] = []
    for i, (b, words) in enumerate(zip(found, plain)):
        if b.aside:
            told[i] = False
            continue
        size = len(b.text) - b.text.count(" ")
        if b.linked >= most_linked * size:
            told[i] = False
            continue
        share = sum(map(known.__contains__, words)) / max(1, len(words)) if known is not None else 1.0
        if len(b.text) >= short and share >= dense:
            told[i] = True
        elif len(b.text) >= short and share < sparse and not b.main:
            told[i] = False
        else:
            open_.append(i)
    # The nearest decided block before and after each: links and places apart have no voice within an article.
    nearest: dict[int, list[tuple[int, bool]]] = {i: [] for i in open_}
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            b = found[i]
            if told[i] is None:
                if b.main in last:
                    nearest[i].append((abs(i - last[b.main][0]), last[b.main][1]))
            elif not b.aside and (told[i] or not b.main):
                last[b.main] = (i, told[i])
    for i in open_:
        told[i] = min(((d, not text) for d, text in nearest[i]), default=(0, False))[1] is False
    return told


def main_text(page: str | None, stop_words: dict[str, frozenset[str]] | None = None) -> str:
    """The page's main text, a line for each block; '' where there is none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, text in zip(found, label(found, STOP_WORDS if stop_words is None else stop_words)) if text)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", stop_words: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """``pages`` with the main text of ``html_col`` as ``out_col`` in place of the html.

    Each page is read whole in its own task, in time that grows with its length. A
    null or empty page, or one without main text, gives ''. Repeated rows give
    the same text. A column called ``out_col`` that there is already is replaced, all
    others stay whatever their names. An empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([main_text(page, stop_words) for page in pages_], dtype=object)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out_col)]
    return pages.select(*rest, each(F.col(f"`{html_col}`")).alias(out_col))
