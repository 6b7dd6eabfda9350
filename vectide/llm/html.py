"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: the text between the tags of block elements. A
linear classifier over the block's length, links, punctuation, own element and
ancestors gives each block log-odds of being content; these become terminal
capacities. Smoothness edges join neighbours in page order, more weakly the
farther apart they are in the element tree, and successive blocks of one
parent; both fade with the difference of what the ancestors say, so that an
advert between two paragraphs is held by neither. The maximum flow separates
content from boilerplate: a short or linked block goes with its neighbours.

Class and id names are evidence, not verdicts. A name that is wholly a layout
word (``sidebar``, ``comment-list``) counts in full; one with such a word among
others counts less, in as far as the element does not hold most of the page's
text; prefixes of states and categories (``has-``, ``no-``, ``tag-``) count
nothing. Evidence adds up over ancestors within bounds, and what compounds say
ends at ``article`` and ``main``. Forms go, but for one that is a frame around the
page.

Defined results: null html is empty; text of scripts, styles, titles, forms,
comments and hidden elements is never a block; a page without content has the
empty text; unclosed and stray tags are tolerated; an unclosed comment or
script runs to the end; of repeated attributes the first counts; repeated rows
give equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices
from vectide.llm.mincut import min_cut

# Element names of HTML by their part in the layout, and the words
# that class names use.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head template svg math select datalist button iframe object audio video canvas noscript dialog map applet".split())
_CLOSES_P = _BLOCK - {"caption", "head", "html", "body", "option", "optgroup", "legend", "tbody", "thead", "tfoot", "tr", "td", "th"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ELEMENT = {"nav": -6.0, "menu": -6.0, "footer": -6.0, "aside": -6.0, "search": -6.0, "article": 2.5, "main": 2.5, "blockquote": 0.5, "table": -0.5}
_OWN = {"p": 0.5, "h1": 3.0, "h2": 1.0, "h3": 1.0, "h4": 0.5, "pre": 1.5, "blockquote": 1.0, "li": -0.5, "td": -0.5, "th": -0.5, "div": -0.5, "body": -1.0, "html": -1.0}
_BAD = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar rail widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup login comment comments commentlist respond reply replies disqus discussion share sharing social related recommended trending copyright disclaimer toolbar skip search tags meta".split()
)
_PLACES = frozenset(
    "area articles bar block body bottom box buttons col column container content desktop fixed form global group header holder inner item items left link links list lists main menus mobile news outer page panel posts primary region right root row secondary section site slot sticky stories thread top unit wrap wrapper".split()
)
_STATES = frozenset("has no not with without is hide show".split())
_PREFIXES = frozenset("tag category cat tax type status format layout js template theme single".split())
_TALK = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
_AWAY = _TALK | frozenset("ad ads advert advertisement sponsored promo related recommended widget".split())
_GOOD = frozenset("article articlebody content post entry story main text body prose".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Evidence of a name that is a layout word, of one that holds such a word among
#: others, and of a good one; sums over ancestors stay within MOST.
WORD, COMPOUND, GOOD, MOST = -6.0, -4.0, 1.5, 9.0
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea|xmp)\b[^>]*>.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = tuple(".!?:;\"'”»…)。！？")

ADJACENT, SIBLING = 1.2, 0.6
#: Characters of a paragraph of prose; two in a form with most of the page's text, or
#: an article, show that the form is a frame around the page.
PROSE = 80
#: Beyond so many steps a smoothness weight is as good as zero.
FAR = 60


def attributes_of(tag: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    """The attributes in the text of a tag; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), decode(value[1:-1] if value[0] in "\"'" else value) if value else "")
    return found


def _named(value: str, own: frozenset[str]) -> tuple[float, float]:
    """(evidence of layout words, of compounds and good words) of the names in a
    class or id; ``own`` are the words that count."""
    words_only = among = 0.0
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        bad = own.intersection(words)
        if not words or len(words) > 1 and words[0] in _PREFIXES or _STATES.intersection(words[:-1]):
            continue
        if bad:
            good = _GOOD.intersection(words)
            if all(w in _BAD or w in _PLACES for w in words) and (bad & _TALK or not good):
                words_only = WORD
            elif not good or words[-1] in bad:
                among = min(among, COMPOUND)
        elif "header" in words or "head" in words:
            among = min(among, COMPOUND / 2)
        elif _GOOD.intersection(words):
            among = among or GOOD
    return words_only, among


def _hidden(attributes: dict[str, str]) -> bool:
    style = "".join(attributes.get("style", "").lower().split())
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style


class _Element:
    """``firm`` and ``loose`` are the element's own evidence; ``evidence`` the sum
    with its ancestors', once the page's text is placed."""

    __slots__ = ("name", "parent", "depth", "firm", "loose", "evidence", "firmly", "loosely", "dropped", "inside", "size", "form", "prose")

    def __init__(self, name: str, parent: _Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.size = self.prose = 0
        self.form = self if name == "form" else parent.form if parent else None
        inside = bool(parent and parent.inside)
        self.dropped = bool(parent and parent.dropped) or name in _DROPPED
        self.firm, self.loose = _ELEMENT.get(name, 0.0), 0.0
        text = name in ("article", "main")
        if name == "article" and inside and parent.inside == "article":
            self.firm = WORD  # articles in an article are what readers say, or teasers
        if name == "header":
            self.firm = COMPOUND / 2 if inside else WORD
        if text and self.form:
            self.form.prose += 2
        self.inside = name if text else inside and parent.inside
        if attributes:
            held = attributes_of(attributes)
            for key in ("class", "id"):
                if key in held:
                    firm, loose = _named(held[key], _AWAY if text else _BAD)
                    self.firm += firm
                    self.loose += max(loose, 0.0) if text else loose
            role = held.get("role", "").lower()
            if role in _BAD_ROLES:
                self.firm += WORD
            elif role in ("main", "article"):
                self.firm += 2.5
                self.inside = role
            self.dropped |= _hidden(held)


def _weigh(elements: list[_Element]) -> None:
    """Evidence of all elements, parents first, from their own and their sizes."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += e.size
    total = max(1, elements[0].size)
    for e in elements:
        firmly, loosely = (e.parent.firmly, e.parent.loosely) if e.parent else (0.0, 0.0)
        if e.name == "main" or e.name == "article" and firmly > WORD:
            loosely = max(loosely, 0.0)
        own = e.loose
        if own < 0:  # an element with most of the text is a frame around the page
            own *= min(1.0, 2 * (1 - e.size / total))
        e.firmly = min(MOST, max(-MOST, firmly + e.firm))
        e.loosely = min(MOST / 3, max(-MOST, loosely + own))
        e.evidence = min(MOST, max(-MOST, e.firmly + e.loosely))


def blocks(html: str) -> list[tuple[str, float, _Element]]:
    """(text, share of it inside links, element) of each block in page order."""
    out: list[tuple[str, float, _Element]] = []
    top = _Element("html", None, "")
    elements = [top]
    here, at = top, 0
    link_in: _Element | None = None  # the element in which a link is open
    mute: list | None = None  # an open hidden inline element: its name, how many deep, and where
    open_names: Counter[str] = Counter()
    pieces: list[str] = []
    link_size = 0

    def close() -> None:
        nonlocal here, link_in, mute
        if here is link_in:
            link_in = None
        if mute and here is mute[2]:
            mute = None
        open_names[here.name] -= 1
        here = here.parent

    def flush() -> None:
        nonlocal link_size
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, min(1.0, link_size / len(text)), here))
                here.size += len(text)
                if here.form and here.name == "p" and len(text) >= PROSE:
                    here.form.prose += 1
            pieces.clear()
            link_size = 0

    def add(text: str) -> None:
        nonlocal link_size
        if not here.dropped and mute is None:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if link_in is not None:
                link_size += len(text)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, end = name.lower(), m[2]
        if name == "a":
            link_in = None if end else here
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in _BLOCK and name not in _DROPPED:
            if mute and name == mute[0]:
                mute[1] += -1 if end else 1
                mute = mute if mute[1] else None
            elif mute is None and not end and name not in _VOID and ("hidden" in m[4].lower() or "none" in m[4].lower()) and _hidden(attributes_of(m[4])):
                mute = [name, 1, here]
            continue
        flush()
        if name in _VOID:
            continue
        if end:
            if open_names[name]:  # else a stray tag
                while here.name != name:
                    close()
                close()
            continue
        if name in _CLOSES_P and here.name == "p":
            close()
        if here.name in _SIBLINGS.get(name, ()):
            close()
            if name == "tr" and here.name == "tr":
                close()
        if name in _HEADINGS and here.name in _HEADINGS:
            close()
        if name in ("html", "body"):
            continue
        if name != "head" and here.name == "head":
            close()
        here = _Element(name, here, m[4])
        elements.append(here)
        open_names[name] += 1
    if at < len(html):
        add(html[at:])
    flush()
    _weigh(elements)
    forms = {e for e in elements if e.name == "form" and not (e.prose >= 2 and 2 * e.size > top.size)}
    return [b for b in out if b[2].form not in forms]


def log_odds(text: str, links: float, element: _Element) -> float:
    """Classifier score of a block; positive for content."""
    size = min(len(text), 240) / 80
    heading = element.name in _HEADINGS
    ends = 1.0 if heading or text.endswith(_ENDS) else -0.5
    return -1.0 + size + ends - 4.0 * links + _OWN.get(element.name, 0.0) + element.evidence


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree, or FAR if there are more."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def graph(found: list[tuple[str, float, _Element]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of the blocks, and the smoothness edges between them."""
    edges = []
    last: dict[int, int] = {}
    for k, (_, _, element) in enumerate(found):

        def like(j: int, here: _Element = element) -> float:
            return math.exp(-abs(found[j][2].evidence - here.evidence) / 2)

        if k:
            edges.append((k - 1, k, ADJACENT * like(k - 1) * math.exp(-_distance(found[k - 1][2], element) / 4)))
        parent = id(element.parent or element)
        if parent in last:
            edges.append((last[parent], k, SIBLING * like(last[parent])))
        last[parent] = k
    return [log_odds(*b) for b in found], edges


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(b[0] for b, content in zip(found, min_cut(*graph(found))) if content)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars``."""
    some = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = some.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last = batch.num_columns - 1
            made = [main_text(h) for h in batch.column(last).to_pylist()]
            columns = [*batch.columns[:last], pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return some.mapInArrow(run, schema)
