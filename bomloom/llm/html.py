"""HTML extraction by the distribution of text over line blocks.

Markup is stripped into lines (one per block element), each with a weight: its length,
nothing within boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
comments, link lists), more within the heaviest article or main element, little outside
it. A name is no boilerplate if its element holds most of the page's sentences. The
weights are summed over sliding windows of lines. Where that sum first exceeds a share of
the page's own typical line it surges, where it last does it dives; between, the text
dives at lines without weight and surges after them. What lies between a surge and its
dive is kept, on every page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches

BLOCK_LINES = 3
#: Outside the article, where there is one, a line weighs this share of its length.
OUTSIDE = 0.05
#: An article counts if its text is this share of the heaviest one's; together they decide from this share of the page's text.
RIVAL, DECIDES = 0.5, 1 / 3
#: The shortest line that can be a sentence of prose, and how many make a named element more than boilerplate.
PROSE_CHARS, PROSE_LINES = 25, 2
#: A block is dense if its weight is this share of the line length that half of the page's text reaches.
DENSE = 0.25
#: Tags whose quotes don't end, after which quotes in tags count for nothing on the page.
_BAD_TAGS = 16

# HTML element names by role, and names that sites give to boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILERPLATE = frozenset("nav footer aside head menu dialog button noscript template svg select object canvas math".split())
_FORMS = frozenset(["form", "fieldset"])
_COMMENTS = frozenset("comment comments commentlist respond disqus reply replies reviews discussion discussions".split())
_NAMED = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar aside footer colophon masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations teaser teasers results "
    "widget widgets toolbar pagination pager login search complementary contentinfo disclaimer".split()
)
_HEADERS = frozenset("header head masthead topbar banner".split())
#: Parts of class names that say where something stands or what shape it has, not what it is.
_NEUTRAL = frozenset("site page main top bottom left right upper lower box list bar block slot wrap wrapper container section area unit item items inner outer panel row col column group link links button buttons form field icon icons holder zone region primary secondary global mobile desktop js the a s".split())
#: Parts by which a name tells a state or a layout.
_STATES = frozenset("has with without no not is and or content enabled disabled open closed active".split())
_HEADINGS = frozenset(["h1", "h2", "h3"])

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_SPLIT = re.compile(r"[^a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Kinds of boilerplate: what never is text, what is by its name alone, reader comments by theirs, a header within main but for its headings.
_NEVER, _NAME, _COMMENT, _HEADER = 1, 2, 3, 4
_SENTENCE = re.compile(r"[.!?…。][\"'”’»)\]]*\Z")
_SELF_ENDING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


class Line(NamedTuple):
    """boilerplate: within such an element; inside: 1 within the article, 0 beside it in main or on a page without one, -1 outside it; linked: share of link text; heading: of h1 to h3."""

    text: str
    boilerplate: bool
    inside: int
    linked: float
    heading: bool


def _names_boilerplate(token: str, names: frozenset) -> bool:
    """Whether a class, id or role is such a name, or a compound of which one is the head; what only tells a state is not."""
    parts = [p for p in _SPLIT.split(token) if p]
    if not _STATES.isdisjoint(parts):
        return False
    while parts and parts[-1] in _NEUTRAL:
        parts.pop()
    return bool(parts) and parts[-1] in names


def _kind(name: str, rest: str, in_article: bool, in_main: bool) -> int:
    """The kind of boilerplate that an element is, or 0."""
    if name in _BOILERPLATE:
        return _NEVER
    if name == "header" and not in_article:
        return _HEADER if in_main else _NEVER
    named = _NAME if name in _FORMS else 0
    if not rest or rest.isspace() or name in ("html", "body", "main"):
        return named
    names = _NAMED - _HEADERS if in_article or in_main else _NAMED | _HEADERS
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() not in ("false", "until-found") or key == "style" and _INVISIBLE.search(value):
            return _NEVER
        if key in ("class", "id", "role"):
            for token in value.lower().split():
                if _names_boilerplate(token, names):
                    named = _COMMENT if named == _COMMENT or _names_boilerplate(token, _COMMENTS) else _NAME
    return named


def _pieces(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each piece of markup; those without a name are comments and the like.

    Each is found in time that its length bounds, so a page takes time in proportion to its length.
    """
    at, bad, no_end = 0, 0, False
    while m := _OPEN.search(page, at):
        start = m.start()
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if no_end or page.find(">", start) < 0:  # no markup ends from here on
            yield start, len(page), "", False, ""
            return
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            yield start, at, "", False, ""
            continue
        tag = _TAG.match(page, start) if bad < _BAD_TAGS else None
        if tag is None:
            bad, tag = bad + 1, _PLAIN_TAG.match(page, start)
        at = tag.end()
        yield start, at, tag[2].lower(), bool(tag[1]), tag[3]
        if not tag[1] and tag[2].lower() in _RAW:
            end = re.compile(rf"</{re.escape(tag[2])}(?=[\s/>])", re.I).search(page, at)
            start, at = at, end.start() if end else len(page)
            yield start, at, "", False, ""


def _covered(size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which lines lie within a span."""
    change = np.zeros(size + 1, np.int64)
    for start, end in spans:
        change[start] += 1
        change[end] -= 1
    return np.cumsum(change[:size]) > 0


def _flagged(texts: list[tuple[str, float, bool]], elements: list[tuple[int, int, int]]) -> np.ndarray:
    """Which lines are boilerplate; elements: (first line, line after the last, kind).

    An element that is boilerplate by its name alone counts for nothing if it holds more
    than half of the page's sentences, reader comments only if they hold them all.
    """
    size = len(texts)
    headings = np.array([h for _, _, h in texts], bool)
    never = _covered(size, [(s, e) for s, e, kind in elements if kind == _NEVER]) | _covered(size, [(s, e) for s, e, kind in elements if kind == _HEADER]) & ~headings
    prose = np.array([len(t) if len(t) >= PROSE_CHARS and linked <= 0.6 and not h and _SENTENCE.search(t) else 0 for t, linked, h in texts], np.int64) * ~never
    chars, count = np.concatenate([[0], np.cumsum(prose)]), np.concatenate([[0], np.cumsum(prose > 0)])

    def is_text(start: int, end: int, kind: int) -> bool:
        held = chars[end] - chars[start]
        return count[end] - count[start] >= PROSE_LINES and (held == chars[-1] if kind == _COMMENT else 2 * held > chars[-1])

    return never | _covered(size, [(s, e) for s, e, kind in elements if kind in (_NAME, _COMMENT) and not is_text(s, e, kind)])


def _inside(texts: list[tuple[str, float, bool]], flagged: np.ndarray, articles: list[tuple[int, int]], mains: list[tuple[int, int]]) -> np.ndarray:
    """For each line: 1 within the heaviest articles (of main, if it has none), -1 outside them, 0 beside them in main or where they don't decide."""
    size = len(texts)
    length = np.array([0 if f else len(t) for (t, _, _), f in zip(texts, flagged, strict=True)], np.int64)
    sums = np.concatenate([[0], np.cumsum(length)])
    outer: list[tuple[int, int]] = []
    for start, end in sorted(articles, key=lambda x: (x[0], -x[1])):
        if not outer or start >= outer[-1][1]:
            outer.append((start, end))
    weights = [int(sums[e] - sums[s]) for s, e in outer]
    least = RIVAL * max(weights, default=0)
    main, within = _covered(size, mains), _covered(size, outer)
    won = _covered(size, [x for x, w in zip(outer, weights, strict=True) if w and w >= least])
    if length[main & ~within].sum() > length[won].sum():
        won = main & ~within
    lost = within & ~won
    own = sum(length[i] for i in range(size) if won[i] or texts[i][1] <= 0.6)
    if not own or length[won].sum() < DECIDES * own:
        return np.zeros(size, np.int64)
    return np.where(won, 1, np.where(main & ~lost, 0, -1))


def lines(page: str) -> list[Line]:
    """The lines of a page that have text."""
    texts: list[tuple[str, float, bool]] = []
    stack: list[tuple[str, int, int]] = []
    open_ = Counter()
    parts: list[str] = []
    elements: list[tuple[int, int, int]] = []
    spans: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
    linked = last = flagged = links = headings = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                texts.append((text, linked / max(1, sum(map(len, parts))), headings > 0))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal flagged, headings
        name, kind, began = stack.pop()
        open_[name] -= 1
        headings -= name in _HEADINGS
        if kind:
            flagged -= 1
            elements.append((began, len(texts), kind))
        if name in spans and began < len(texts):
            spans[name].append((began, len(texts)))
        return name

    for start, end, name, closes, rest in _pieces(page):
        if start > last:
            parts.append(page[last:start])
            linked += (start - last) * (links > 0)
        last = end
        if not name or name in _RAW:
            continue
        if name == "a":
            links = 0 if closes else 1
        in_article, in_main = open_["article"] > 0, open_["main"] > 0
        if name in _INLINE:  # these end a line only where boilerplate begins or ends
            if closes:
                if not open_[name]:
                    continue
            elif name in _VOID or not (flagged or rest and _kind(name, rest, in_article, in_main)):
                continue
        flush()
        if closes:
            if open_[name]:
                while pop() != name:
                    pass
        elif name not in _VOID and not rest.endswith("/"):
            ended = _SELF_ENDING.get(name)
            if stack and (stack[-1][0] == "p" and name not in _INLINE or ended and stack[-1][0] in ended):
                pop()
            kind = _kind(name, rest, in_article, in_main)
            stack.append((name, kind, len(texts)))
            open_[name] += 1
            flagged += kind > 0
            headings += name in _HEADINGS
    parts.append(page[last:])
    flush()
    while stack:
        pop()
    bad = _flagged(texts, elements)
    inside = _inside(texts, bad, spans["article"], spans["main"])
    return [Line(t, b, i, linked, h) for (t, linked, h), b, i in zip(texts, bad.tolist(), inside.tolist(), strict=True)]


def blocks(weight: np.ndarray, size: int = BLOCK_LINES) -> np.ndarray:
    """The weight of each window of lines, by its first line."""
    padded = np.concatenate([weight, np.zeros(size - 1, np.int64)])
    return np.lib.stride_tricks.sliding_window_view(padded, size).sum(1)


def _bounds(found: list[Line]) -> tuple[int, int]:
    """(line where the text surges, line after its dive) by the distribution of the weight of lines, none of which is boilerplate; (0, 0) if there is none."""
    length = np.array([0 if x.inside < 1 and (x.linked > 0.6 or x.text[0] == "©") else len(x.text) for x in found], np.float64)
    weight = length * np.array([OUTSIDE if x.inside < 0 else 1 for x in found])
    if not weight.any():
        return 0, 0
    size = np.sort(weight)[::-1]
    bound = DENSE * size[np.searchsorted(np.cumsum(size), size.sum() / 2)]
    weight += np.array([x.inside > 0 for x in found]) * (bound + 1)
    dense = np.flatnonzero(blocks(weight) > bound)
    surge, dive = int(dense[0]), min(len(found), int(dense[-1]) + BLOCK_LINES)
    # The lines of the outermost blocks that are neither headings, nor sentences, nor long are what stands around the text.
    own = [w > 0 and (w >= bound or x.inside >= 0 and (x.heading or bool(_SENTENCE.search(x.text)))) for w, x in zip(weight.tolist(), found, strict=True)]
    while not own[surge]:
        surge += 1
    while not own[dive - 1] or found[dive - 1].heading and found[dive - 1].inside < 1:
        dive -= 1
        if dive <= surge:
            return surge, surge + 1
    titles = [i for i in range(max(0, surge - BLOCK_LINES), surge) if found[i].heading and weight[i] and found[i].inside >= 0]
    return titles[0] if titles else surge, dive


def article_spans(found: list[Line]) -> list[tuple[int, int]]:
    """The (surge, dive) of a page: lines from the first to before the second are text.

    Boilerplate neither fills blocks nor parts the lines beside it; between the first surge
    and the last dive, the text dives before such lines and those outside the article.
    """
    at = [i for i, x in enumerate(found) if not x.boilerplate]
    surge, dive = _bounds([found[i] for i in at])
    kept = [i for i in at[surge:dive] if found[i].inside >= 0]
    out: list[tuple[int, int]] = []
    for i in kept:
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def main_text(page: str) -> tuple[str, int, int]:
    """(text, number of the line where it first surges, and of the last before it finally dives)."""
    found = lines(page)
    spans = article_spans(found)
    return " ".join(x.text for surge, dive in spans for x in found[surge:dive]), *((spans[0][0], spans[-1][1] - 1) if spans else (0, 0))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page or "") for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_key", "url")), pa.array([t for t, _, _ in found], pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2))], names=["_key", "url", "text", "surge", "dive"]
        )


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and the lines at which it surges and dives, for each row.

    A null or empty page, and one of boilerplate alone, has the empty text. Pages are
    independent (null and repeated keys stay as they are); nothing is shuffled.
    """
    bounded_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select(F.col(key).alias("_key"), F.col("url").alias("url"), F.col("html").alias("html")).mapInArrow(_extracted, f"_key {kinds[key]}, url {kinds['url']}, text string, surge long, dive long").withColumnRenamed("_key", key)


def op9_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the lines of surge and dive of each page, by extract, which says how odd input counts."""
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "surge", "dive")
