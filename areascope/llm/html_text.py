"""Main text of web pages in two passes over their blocks.

First pass: the page is cut into blocks at block-level tags, and every block
is classed by its own figures: markup that is never text (scripts, styles,
forms, navigation, headers, footers, asides, comments, adverts), link density,
stop-word density and length give ``good``, ``bad``, ``near`` or ``short``.
Second pass: ``near`` and ``short`` blocks inherit the class of the nearest
decided neighbours before and behind them. The text is the good blocks in page
order; blocks of an ``<article>`` or ``<main>`` that no rule refuses outright
count as decided, since the page itself names them, and inside them links mark
only lists of links without text of their own. Outside, a heading goes with the
good text behind it, and a short paragraph with a good one beside it.

Stop words are known for a few languages only. Where a page as a whole has
hardly any of them, and in blocks of another script, words say nothing: length
and link density alone decide there. Long blocks without them that read as
sentences are ``near`` on any page, so none is lost beside good text.

Defined results: null and empty html give an empty text; broken or cut-off
markup is read as far as it goes; every input row gives one row, equal rows
equal ones; an empty table gives an empty one; very long and deeply nested
pages are read whole, with a stack of the open elements; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, schema_of

# Element names by their role in a page.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW = ["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object",
       "canvas"]
BLOCKS = ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
          "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
REFUSED = ["aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "option", "select"]
# Words of class, id and role that name what is not the article.
REFUSED_NAMES = ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs",
                 "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disclaimer", "disqus",
                 "footer", "gdpr", "hidden", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
                 "notice", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "search",
                 "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
                 "widget", "respond", "adsbygoogle"]
# Words that a refused name may have before and behind it in one class or id ("site-footer", "ad-slot-2").
# With any other word a name says nothing of the element itself ("overflow-hidden", "has-sidebar", "search-result").
NAME_BEFORE = ["article", "blog", "bottom", "entry", "footer", "global", "header", "main", "page", "post", "primary", "secondary",
               "site", "top", "wp"]
NAME_BEHIND = ["area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content",
               "form", "group", "header", "heading", "holder", "icon", "icons", "inner", "input", "item", "items", "label", "law",
               "link", "links", "list", "media", "message", "meta", "overlay", "panel", "posts", "section", "slot", "stories", "text",
               "title", "toggle", "top", "unit", "wrap", "wrapper"]
# Names that stand for the element only alone or with these words.
NARROW_NAMES = {"hidden": (["is", "visually"], []), "skip": ([], ["link", "links", "nav"]),
                "search": (["header", "site"], ["bar", "box", "btn", "button", "form", "icon", "input", "toggle"])}
# Names that stand for the element as the first or last part of a class with any other words
# ("left-sidebar", "user-comments"), and words that turn such a class into a state of something else ("has-sidebar").
OUTRIGHT_NAMES = ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment",
                  "comments", "cookie", "cookies", "disqus", "gdpr", "menu", "nav", "navbar", "navigation", "newsletter",
                  "pagination", "replies", "sidebar", "sponsor", "sponsored"]
STATE_WORDS = ["active", "closed", "collapsed", "disabled", "enabled", "expanded", "has", "hide", "is", "no", "not", "open", "overflow",
               "show", "visible", "with", "without"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Names of what follows an article and may itself be made of articles.
AFTER_NAMES = ["comment", "comments", "disqus", "related", "replies", "reply", "respond"]
# Frequent words of the languages that pages come in.
STOP_WORDS = """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
you were her all she there would their we him been has when who will more no if out so said what
de la le les et des en un une du que qui dans pour pas sur par est au avec il son ne se ce plus sont
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
el los las por con para una su al lo como más o pero sus este ya entre cuando muy sin sobre también""".split()

_VOID, _RAW, _BLOCK, _STOP = frozenset(VOID), frozenset(RAW), frozenset(BLOCKS), frozenset(STOP_WORDS)
_REFUSED, _NAMES, _AFTER = frozenset(REFUSED), frozenset(REFUSED_NAMES), frozenset(AFTER_NAMES)
_OUTRIGHT, _STATES, _HEADINGS = frozenset(OUTRIGHT_NAMES), frozenset(STATE_WORDS), frozenset(HEADINGS)
_WIDE = (frozenset(NAME_BEFORE), frozenset(NAME_BEHIND))
_NARROW = {name: tuple(map(frozenset, sides)) for name, sides in NARROW_NAMES.items()}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|<(?![a-zA-Z/])|[^<]++",
                    re.DOTALL)
_BROKEN = re.compile(r"<(/?)([a-zA-Z]?[^\s/>]*)([^>]*)(?:>|$)")
# One attribute after the other, so that nothing is found inside the value of another.
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PIECES = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)
_SHOWN = re.compile(r"(?:^|\s)\w+:(?:block|flex|grid|inline|inline-block|inline-flex|table|contents)(?=\s|$)")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…](?=[\s\"')»”’\]]|$)")
# Scripts that put no spaces between words say in one character what others say in about three.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str = ""
    linked: int = 0
    refused: bool = False
    inside: bool = False
    parts: list = field(default_factory=list)
    named: tuple = ()
    place: tuple = ("", 0, 0, 0)  # element, its number, that of the element around it and of the list it is in
    links: int = 0
    only_links: bool = False


@dataclass(frozen=True)
class Limits:
    """Of the first pass: characters, words and densities."""

    max_link_density: float = 0.33
    only_links: float = 0.9  # share of a list's characters in links from which it has no text of its own
    short: int = 60
    long: int = 160
    low_stop: float = 0.12
    high_stop: float = 0.25
    sentence: int = 400  # characters of a long block in which a sentence should end


@dataclass(eq=False)
class Named:
    """An element that its class, id or role refuses, unless it turns out to hold the article."""

    after: bool
    holds: bool = False


def _unglued(piece: str) -> list[str]:
    """A part of a class or id, cut in two where it is a refused name and a known word without a sign between them."""
    for i in range(2, len(piece) - 1):
        if piece[:i] in _NAMES and piece[i:] in _WIDE[1] or piece[:i] in _WIDE[0] and piece[i:] in _NAMES:
            return [piece[:i], piece[i:]]
    return [piece]


@lru_cache(maxsize=10_000)
def _refused_name(token: str, outright: bool = True) -> str | None:
    """The refused name that a class or id stands for, alone or with words that names are known to have.

    With ``outright``, names that say enough as its first or last part may stand with any words.
    """
    if token.lower() in _NAMES:
        return token.lower()
    pieces = [q for p in _PIECES.split(token) if p for q in ([p.lower()] if p.lower() in _NAMES else _unglued(p.lower()))]
    names = [i for i, p in enumerate(pieces) if p in _NAMES]
    if not names:
        return None
    first, last = names[0], names[-1]
    before, behind = _NARROW.get(pieces[first], _WIDE)[0], _NARROW.get(pieces[last], _WIDE)[1]
    fits = (all(p in before for p in pieces[:first]) and all(p in _NAMES or p in _WIDE[1] for p in pieces[first:last])
            and all(p in behind or p[0].isdigit() for p in pieces[last + 1:])
            and (first == last or "hidden" not in (pieces[first], pieces[last])))
    fits = fits or (outright and _STATES.isdisjoint(pieces) and not _OUTRIGHT.isdisjoint((pieces[0], pieces[-1])))
    return next((pieces[i] for i in names if pieces[i] in _AFTER), pieces[first]) if fits else None


def _hidden(attributes: dict) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", ""))


def _names(attributes: dict, slug: bool) -> list[str]:
    """Refused names of the element, from whole words of class, id and role.

    ``slug``: an id made from a heading or a section of the article ("market-share-of-ads") says what it is about.
    """
    found = [n for n in map(_refused_name, attributes.get("class", "").split()) if n]
    found += [n for n in (_refused_name(i, not slug) for i in attributes.get("id", "").split()) if n]
    if "hidden" in found and _SHOWN.search(attributes.get("class", "").lower()):
        found = [n for n in found if n != "hidden"]  # hidden on small screens alone
    return found + [r for r in attributes.get("role", "").split() if r in _NAMES]


def _attributes(text: str) -> dict:
    out: dict = {}
    for name, a, b, c in _ATTR.findall(text):
        name, value = name.lower(), a or b or c
        out.setdefault(name, value if name in ("class", "id") else value.lower())
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple] = []  # (element, refused from here on, inside an article, inside a link, refused by name, place)
    root = (False, False, False, (), ("", 0, 0, 0))
    refused, inside, linked, named, place = root
    serial = 0
    had_article = False
    block = Block()

    def close() -> None:
        nonlocal block
        text = _SPACE.sub(" ", "".join(block.parts)).strip()
        if text:
            block.text = text
            out.append(block)
        block = Block(refused=refused, inside=inside, named=named, place=place)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at) or _BROKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name == "":
            continue
        if name is None:
            token = m.group()
            if token[:2] in ("<!", "<?"):
                continue
            text = html.unescape(token)
            block.parts.append(text)
            if linked:
                block.linked += len(text)
            continue
        name = name.lower()
        if m.group(1):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in _BLOCK or any(s[0] in _BLOCK for s in stack[depth:]):
                        # an inline end tag does not close blocks opened since
                        if name not in _BLOCK:
                            break
                    del stack[depth:]
                    break
            was = (refused, inside, named)
            refused, inside, linked, named, place = stack[-1][1:] if stack else root
            if name in _BLOCK or was != (refused, inside, named):
                close()
            continue
        attributes = m.group(3) or ""
        if name in _RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            block.parts.append(" ")
            continue
        if name == "br":
            block.parts.append("\n")
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            if name in _BLOCK:
                close()
            continue
        if name in _BLOCK:
            while stack and stack[-1][0] not in _BLOCK:  # inline elements left open end with their block
                stack.pop()
            if stack and (name == stack[-1][0] in ("p", "li", "dd", "dt", "option", "tr", "td", "th") or stack[-1][0] == "p"):
                stack.pop()
            refused, inside, linked, named, place = stack[-1][1:] if stack else root
        main = name in ("article", "main")
        found = _attributes(attributes) if attributes else {}
        # A header is the page's own unless it stands in the article.
        out_here = (name in _REFUSED or name == "header" and not inside
                    or name not in ("html", "body") and _hidden(found))
        names = _names(found, inside or name in _HEADINGS) if found and name not in ("html", "body") else []
        after = not _AFTER.isdisjoint(names)
        here = named
        if main:
            # Names refuse neither an article nor what holds it, but for the comments and teasers behind an article.
            if after and had_article:
                here = (*named, Named(True, False))
            elif not (had_article and any(n.after and not n.holds for n in named)):
                for n in named:
                    n.holds = True
                had_article = had_article or name == "article" and not refused and not out_here
        elif names:
            here = (*named, Named(after))
        spot = place
        if name in _BLOCK:
            serial += 1
            spot = (name, serial, place[1], serial if name in ("ul", "ol", "dl") else place[3])
        elif name == "a":
            block.links += 1
        stack.append((name, refused or out_here, inside or main, linked or name == "a", here, spot))
        changed = (refused, inside, named) != (stack[-1][1], stack[-1][2], here)
        refused, inside, linked, named, place = stack[-1][1:]
        if name in _BLOCK or changed:
            close()
    close()
    for block in out:
        block.refused = block.refused or any(not n.holds for n in block.named)
    return out


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """Known stop words and words of a text."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in _STOP for w in words), len(words)


def _other_script(text: str) -> bool:
    """Whether most letters are of a script in which no stop word is known."""
    if text.isascii():
        return False
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in letters) > len(letters)


def mark_links(blocks: list[Block], limits: Limits) -> None:
    """Marks what is a list of links without text of its own: all items of such a list, or a block of several links."""
    lists: dict = {}
    for b in blocks:
        if b.place[3]:
            linked, size = lists.get(b.place[3], (0, 0))
            lists[b.place[3]] = (linked + b.linked, size + len(b.text))
    for b in blocks:
        between = max(b.links - 1, 0)  # blanks between links are not text
        linked, size = lists[b.place[3]] if b.place[3] else (b.linked, len(b.text) - between)
        b.only_links = (b.linked >= limits.only_links * (len(b.text) - between) and linked >= limits.only_links * size
                        and (b.place[3] > 0 or b.links > 1) and b.place[0] not in _HEADINGS)


def _linked_out(block: Block, limits: Limits) -> bool:
    """Inside an article a link more or less says nothing; only lists of links stay out."""
    return block.refused or (block.only_links if block.inside else block.linked > limits.max_link_density * len(block.text))


def words_known(blocks: list[Block], limits: Limits) -> bool:
    """Whether the page is in a language of the stop words, by all its text that is neither refused nor links."""
    counts = [_stop_words(b.text) for b in blocks if not _linked_out(b, limits) and not _other_script(b.text)]
    return sum(c[0] for c in counts) >= limits.low_stop * sum(c[1] for c in counts)


def first_pass(block: Block, limits: Limits, known: bool = True) -> str:
    """Class of a block by its own figures; ``known`` if its page is in a language of the stop words.

    Text that the page itself puts into an article is never bad for its words, only for its links.
    """
    size = _size(block.text)
    if _linked_out(block, limits):
        return "bad"
    if block.place[0] in _HEADINGS and not block.inside and size <= limits.long:
        return "head"
    if size < limits.short:
        return "short"
    found, n = _stop_words(block.text)
    stop = found / n
    if stop >= limits.high_stop and size > limits.long or block.inside and stop >= limits.low_stop:
        return "good"
    if stop >= limits.low_stop or block.inside:
        return "near"
    if not known or _other_script(block.text):
        return "good" if size > limits.long else "near"
    if size <= limits.long:
        return "short"
    return "near" if block.place[0] == "pre" or len(_SENTENCE.findall(block.text)) * limits.sentence >= size else "bad"


def _decided(blocks: list[Block], classes: list[str]) -> list[str | None]:
    """For each block the class of the nearest decided block before it in its own container."""
    out, last = [], {True: None, False: None}
    for block, kind in zip(blocks, classes):
        out.append(last[block.inside])
        if kind in ("good", "bad") and not block.refused:
            last[block.inside] = kind
        elif block.refused and not block.inside:
            last[False] = "bad"
    return out


def second_pass(blocks: list[Block], classes: list[str]) -> list[str]:
    """Ambiguous blocks inherit from their nearest decided neighbours.

    ``near`` needs one good neighbour, ``short`` two; in an article one is enough, and where an article has no
    decided block its own mark decides. ``head`` needs a good one behind it, and a short paragraph one if it stands
    beside a good one in the same element, unless it is a copyright line.
    """
    good_in = {b.place[2] for b, k in zip(blocks, classes) if k == "good"}
    classes = ["near" if k == "short" and b.place[0] == "p" and b.place[2] in good_in and not _RIGHTS.match(b.text) else k
               for b, k in zip(blocks, classes)]
    before = _decided(blocks, classes)
    behind = _decided(blocks[::-1], classes[::-1])[::-1]
    final = []
    for block, kind, around in zip(blocks, classes, zip(before, behind)):
        if kind == "head":
            kind = "good" if around[1] == "good" else "bad"
        elif kind in ("near", "short"):
            good = around.count("good")
            if block.inside:
                kind = "good" if good or around == (None, None) else "bad"
            else:
                kind = "good" if good == 2 or good and kind == "near" else "bad"
        final.append(kind)
    if "good" not in final:  # nothing is long enough to decide by: the undecided blocks are all there is
        final = ["good" if k in ("near", "short", "head") else k for k in classes]
    return final


def main_blocks(page: str | None, limits: Limits = Limits()) -> list[str]:
    blocks = blocks_of(page or "")
    mark_links(blocks, limits)
    # Words are asked only where they can turn a block away: outside articles.
    known = all(b.inside for b in blocks) or words_known(blocks, limits)
    classes = second_pass(blocks, [first_pass(b, limits, known) for b in blocks])
    return [b.text for b, k in zip(blocks, classes) if k == "good"]


def extract(pages: DataFrame, keep: list[str], page: str = "html", limits: Limits = Limits()) -> DataFrame:
    """Columns ``keep`` of ``pages`` with text, n_chars and n_blocks; one pass, no shuffle."""

    def one(*row):
        found = main_blocks(row[-1], limits)
        text = " ".join(found)
        return (*row[:-1], text, len(text), len(found))

    return map_rows(pages.select(*keep, F.col(page).alias("__page")), one,
                    schema_of(pages, keep, "text string, n_chars long, n_blocks long"))
