"""HTML extraction by maximum-scoring subsequence.

A page becomes a line of tokens: tags and words.  Words score positive, tags
negative, and one linear scan finds the contiguous run of highest total, the
main region.  Weights come from labelled pages, those that mark their content
themselves with one ``article`` or ``main`` element: a bounded sample of them
counts, on Spark, how often each tag and each kind of word (named by the
element that holds it) lies inside the marked content and outside.  The log odds of these
counts are the weights; kinds of words seen mostly outside turn negative.  Kinds
that no labelled page has fall back on fixed values by element and class names.

Text of elements that are no content wherever they stand (``DROPPED``: menus,
headers, footers, forms, scripts, styles; elements that are hidden) scores slightly
negative and is left out, also inside the region.  Names (class, id, role) only
decide beside the text: an element with a name made of ``DROPPED_NAMES`` alone
(sidebars, notices, adverts, comments of readers) is left out if it holds less
than half of the page's words; a name that only begins or ends so
(``share-price``) makes kinds of words of its own, which score as learned and
slightly negative where unknown.  An element that holds half of the words or
more is judged by its words (one of comments like the latter names).  A page
that has no other words is read without regard to names.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space.

Pages are read once from left to right, in time linear in their length whatever
is in them.  A quote opens a value only behind ``=``, and only if it is closed
somewhere; a tag ends at the next ``>`` outside such a value.  A ``<`` that no
letter, ``/``, ``!`` or ``?`` follows is text.  End tags look up their element by
name; those of elements that are not open are passed over.

Defined results: a null or empty
html, and a page without words, give an empty text.  Unclosed elements end with the
page; a page that ends in a tag or comment ends there.  Rows with null or repeated page_id are pages of their own.
Extra columns are ignored; an empty table gives no rows.  All kinds of the sampled pages
get weights, so their number is bounded by the elements of these pages.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.tasks import map_arrow
from salesops.llm.text import chunks

#: Labelled pages that weights are counted on.
SAMPLE_PAGES = 2000
#: Longest name of a kind; longer ones are told apart by a hash.
NAME = 60
#: Bounds of learned weights: (lowest, highest) of words and of tags.
WORD_RANGE, TAG_RANGE = (-4.0, 1.0), (-4.0, -0.05)
#: Weights of kinds that no labelled page has.
NEW_WORD, NEW_TAG = 0.8, -0.3
#: Mark of kinds inside elements whose names speak against them, and the weight of new ones.
CLUE, CLUE_WORD = "?", -0.4
#: Weights inside elements that are left out: the region may pass over them, but has no gain from it.
DROPPED_WORD, DROPPED_TAG = -0.02, -0.1

# Element names of HTML and usual names of page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select option textarea title svg canvas object embed dialog menu noembed noframes math audio video head".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu sidebar aside header masthead footer comment comments disqus reply replies respond cookie cookies consent notice alert popup modal newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget login search skip".split())
CONTENT = frozenset(("article", "main"))
COMMENTS = frozenset("comment comments reply replies respond".split())
TELLING = frozenset("has have with no without is".split())
IMPLIED_END = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}

RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_PART = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


class _Scanner:
    """Tags of a page from left to right."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        #: Quotes that are not closed behind the place reached.
        self.open_ended: set[str] = set()

    def _quoted(self, quote: str, at: int) -> int:
        """Place of the closing quote, or -1."""
        if quote in self.open_ended:
            return -1
        end = self.page.find(quote, at)
        if end < 0:
            self.open_ended.add(quote)
        return end

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Values by lower-case attribute name (the first of each name), the place behind the tag, and whether it closes itself."""
        page, out = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            name, at = m[1], m.end()
            if name or m[2]:
                value = ""
                if m[2]:
                    quote = page[at : at + 1]
                    end = self._quoted(quote, at + 1) if quote in ('"', "'") and quote else -1
                    if end >= 0:
                        value, at = page[at + 1 : end], end + 1
                    else:
                        bare = _BARE.match(page, at)
                        value, at = bare[0], bare.end()
                out.setdefault(name.lower(), value)
            elif at >= self.size:
                return out, self.size, False
            else:  # only ">" ends here
                return out, at + 1, page[at - 1] == "/"

    def tags(self):
        """(start, end, end tag, name, attributes, closes itself) of tags; comments and the like have no name.  Of a raw element start and end take in its text and end tag."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            after = page[start + 1 : start + 2]
            closes = after == "/"
            m = _NAME.match(page, start + 1 + closes)
            if m:
                name = m[0].lower()
                values, at, alone = self.attributes(m.end())
                if name in RAW and not closes:
                    found = _RAW_END[name].search(page, at)
                    at = self.attributes(found.end())[1] if found else self.size
                yield start, at, closes, name, values, alone
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else self.size
                yield start, at, False, "", {}, False
            elif after and after in "/!?":
                end = page.find(">", start)
                at = end + 1 if end >= 0 else self.size
                yield start, at, False, "", {}, False
            else:
                at = start + 1


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def _furniture(attributes: dict[str, str], names: frozenset[str] = DROPPED_NAMES) -> int:
    """2: a class, id or role is made of the names alone; 1: one begins or ends with them (``has-sidebar`` and the like only tell of others)."""
    level = 0
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            parts = _PART.findall(name)
            if parts and TELLING.isdisjoint(parts):
                level = max(level, 2 if names.issuperset(parts) else int(parts[0] in names or parts[-1] in names))
    return level


def _short(name: str) -> str:
    return name if len(name) <= NAME else f"{name[:NAME // 2]}#{zlib.crc32(name.encode('utf-8', 'surrogatepass')):08x}"


def tokens(page: str, by_name: bool = True) -> list[tuple[str, str, bool, bool, str]]:
    """Tags and texts in page order: (kind, text, dropped, breaks a block, content element opened or closed).

    The kind of a tag is its name with ``<`` or ``</``; that of a text names the
    element that holds it, past inline ones, with its class.  Tags have an empty text."""
    out: list[tuple[str, str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool, int]] = []  # element, kind of its words, left out by an element, place in out
    opened: dict[str, list[int]] = {}  # places in the stack by element
    blocks: list[int] = []  # places in the stack of elements that are not inline
    told: dict[int, int] = {}  # place -> what is known of the element opened there: the constants below
    ends: dict[int, int] = {}
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            kind, dropped = (stack[-1][1], bool(stack[-1][2])) if stack else ("body", False)
            out.append((kind, piece, dropped, False, ""))
        elif piece:
            out.append(("", piece, bool(stack and stack[-1][2]), False, ""))

    def close(k: int) -> None:
        while len(stack) > k:
            name, _, dropped, place = stack.pop()
            opened[name].pop()
            if name not in INLINE:
                blocks.pop()
            ends[place] = len(out)
            out.append((f"</{name}", "", bool(dropped), name not in INLINE, f"/{name}" if name in CONTENT else ""))

    for start, end, closes, name, attributes, alone in _Scanner(page).tags():
        text(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if opened.get(name):
                k = opened[name][-1]
                # An inline element is not closed from inside a block.
                if name not in INLINE or not blocks or blocks[-1] < k:
                    close(k)
            elif name not in INLINE:
                out.append((f"</{name}", "", False, True, ""))
            continue
        if name in RAW:
            out.append((f"<{name}", "", True, True, ""))
            continue
        if name in VOID:
            out.append((f"<{name}", "", False, name not in INLINE, ""))
            continue
        # A block ends an open paragraph; some elements end their like.
        if name not in INLINE and blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in IMPLIED_END.get(name, ())):
            close(blocks[-1])
        above = stack[-1] if stack else ("", "body", False, 0)
        dropped = above[2] or name in DROPPED
        if name in CONTENT:
            told[len(out)] = (COMMENT if _furniture(attributes, COMMENTS) else OWN) if by_name else OWN
        elif attributes and name not in ("html", "body"):
            level = _furniture(attributes) if by_name else 0
            if _hidden(attributes):
                told[len(out)] = HIDDEN
            elif level:
                told[len(out)] = COMMENT if level == 2 and _furniture(attributes, COMMENTS) == 2 else WHOLE if level == 2 else PART
        named = [v for k, v in attributes.items() if k in ("class", "id", "role")] if name not in INLINE else []
        kind = above[1] if name in INLINE else _short(f"{name}.{named[0].lower()}") if named else name
        if not alone or name in ("p", "div", "article", "main", "section", "span", "a"):
            opened.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, kind, dropped, len(out)))
        out.append((f"<{name}", "", dropped, name not in INLINE, name if name in CONTENT else ""))
    text(page[at:])
    close(0)
    return _judged(out, told, ends) if told else out


#: What is known of an element: content, hidden, named as furniture alone, as comments, in part.
OWN, HIDDEN, WHOLE, COMMENT, PART = range(5)


def _judged(out: list[tuple[str, str, bool, bool, str]], told: dict[int, int], ends: dict[int, int]) -> list[tuple[str, str, bool, bool, str]]:
    """Leaves out what is hidden or named as furniture and holds less than half of the words, and marks the kinds of what is in doubt."""
    held = [0]
    for _, piece, dropped, _, _ in out:
        held.append(held[-1] + (0 if dropped or not piece else len(piece.split())))
    judged, open_ = [], [(len(out), 0)]  # end of an element; 0: read, 1: in doubt, 2: left out, 3: left out with what is content inside
    for i, (kind, piece, dropped, breaks, content) in enumerate(out):
        while i > open_[-1][0]:
            open_.pop()
        what, end = told.get(i), ends.get(i)
        if what is not None and end is not None:
            much = 2 * (held[end] - held[i]) >= held[-1]
            above = open_[-1][1]
            if what == OWN:
                level = above if above == 3 else 0
            elif what == COMMENT:
                level = max(above, 1 if much else 3 if content else 2)
            else:
                level = max(above, 2 if what == HIDDEN else 0 if much else 2 if what == WHOLE else 1)
            open_.append((end, level))
        level = open_[-1][1]
        judged.append((CLUE + kind if level == 1 and piece and kind else kind, piece, dropped or level > 1, breaks, content))
    return judged


def _labelled(page: str, cut: list[tuple[str, str, bool, bool, str]]) -> tuple[int, int] | None:
    """Token range that the page marks as its content: one article, else one main."""
    for name in ("article", "main"):
        opened = [i for i, t in enumerate(cut) if t[4] == name]
        if len(opened) == 1:
            closed = [i for i, t in enumerate(cut) if t[4] == f"/{name}" and i > opened[0]]
            if closed:
                return opened[0] + 1, closed[0]
    return None


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weight of each kind of word and tag, from ``sample`` labelled pages drawn by a hash of page_id and html (rows alike in both are drawn together)."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for page in batch.column("html").to_pylist():
                cut = tokens(page)
                found = _labelled(page, cut)
                if not found:
                    continue
                for i, (kind, piece, dropped, _, content) in enumerate(cut):
                    if not kind or content or dropped:
                        continue
                    key, n = (f"w {kind}", len(piece.split())) if piece else (f"t {kind}", 1)
                    counts.setdefault(key, [0, 0])[0 if found[0] <= i < found[1] else 1] += n
            yield pa.RecordBatch.from_pydict({"kind": pa.array(list(counts), pa.string()), "inside": pa.array([c[0] for c in counts.values()], pa.int64()), "outside": pa.array([c[1] for c in counts.values()], pa.int64())})

    marked = F.lower("html").rlike("<(article|main)\\b")
    own = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64(F.lit(47), F.col("page_id").cast("long"), F.col("html").cast("string")).alias("draw")).where(marked)
    # The sample's largest draw is found among the draws alone; pages are then read by it where they lie.
    last = own.select("draw").distinct().orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    if last is None:
        return {}
    drawn = own.where(F.col("draw") <= last).select("html")
    counted = map_arrow(drawn, run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    weights = {}
    for r in counted.collect():
        low, high = WORD_RANGE if r["kind"][0] == "w" else TAG_RANGE
        weights[r["kind"]] = min(high, max(low, math.log((r["inside"] + 0.5) / (r["outside"] + 0.5))))
    return weights


def region(cut: list[tuple[str, str, bool, bool, str]], weights: dict[str, float]) -> tuple[int, int]:
    """Token range of the highest total score; the earliest, and of these the longest."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, (kind, piece, dropped, _, content) in enumerate(cut):
        if piece:
            if not kind:
                continue
            total += (DROPPED_WORD if dropped else weights.get(f"w {kind}", CLUE_WORD if kind[0] == CLUE else NEW_WORD)) * len(piece.split())
        elif content:
            total += TAG_RANGE[0]
        else:
            total += DROPPED_TAG if dropped else weights.get(f"t {kind}", NEW_TAG)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total >= best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the page's main region."""
    if not page:
        return ""
    return _read(tokens(page), weights) or _read(tokens(page, by_name=False), weights)


def _read(cut: list[tuple[str, str, bool, bool, str]], weights: dict[str, float]) -> str:
    begin, end = region(cut, weights)
    blocks, own = [], []
    for _, piece, dropped, breaks, _ in cut[begin:end]:
        if breaks:
            blocks.append("".join(own))
            own = []
        elif piece and not dropped:
            own.append(entities.unescape(piece))
    blocks.append("".join(own))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    weights = learn(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [main_text(p, weights) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
