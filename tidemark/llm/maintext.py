"""Main text of web pages: the maximum-scoring subsequence of words and tags, with weights from labelled pages."""

from __future__ import annotations

import html as markup
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

# What the elements of HTML are.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
#: Controls, graphics and what browsers show in place of their content: it is no text of the page if their end tag is there.
EMBEDDED = frozenset("select object svg canvas audio video noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
NOT_P = BLOCK - {"p"} | EMBEDDED
#: Elements that a start tag closes, within the nearest of the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
INLINE_ENDS = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
LABELS = frozenset(("article", "main"))
NAMED = frozenset(("article", "main", "section", "body"))
#: Elements that are never part of an article, and words of which names (class, id or role) of such elements consist.
OUTSIDE = frozenset("head nav header footer aside form menu dialog button fieldset search".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead footer sidebar aside widget related recommended comment comments disqus reply replies notice notices alert cookie cookies consent"
    " gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social pagination pager toolbar complementary contentinfo"
    " form search searchform skip hidden".split()
)

_TOKEN = re.compile(
    r"(?P<note><!--.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"
    r"|(?P<odd><[!?/][^>]*+(?:>|\Z))"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NAME_WORDS = re.compile(r"[a-z]+", re.ASCII)
#: Names that say what is missing, or how a box is laid out, up to the end of the name.
_NO_SIGN = re.compile(r"(?<![a-z])(?:(?:no|non|not|with|without|has|have)[-_]+|overflow[-_])\S*")
#: Marks the key of an element whose names are no sign, as it holds the article.
HOLDER = "*"


class Token(NamedTuple):
    """A run of text or a tag.

    ``key`` names what its weight is learnt for, ``outside`` tells of an element that no article has, ``element`` is the
    number of the element that holds it.
    """

    key: str
    text: str | None
    words: int
    block: int
    label: bool
    outside: bool
    element: int


class Open(NamedTuple):
    tag: str
    key: str
    outside: bool
    label: bool
    number: int


class Page:
    """A page as a list of tokens. Elements are numbered in the order of their starts, so one holds the numbers up to its ``last``.

    One pass over the markup with the open elements on a stack: implied end tags are supplied, depth costs only memory. Raw elements
    and comments are tags without text, and so are embedded elements that have an end tag. One without holds what follows like any other.
    A tag or quote that never ends swallows the rest. Where elements are open is kept by tag, so no tag costs more for the depth it stands in.
    """

    def __init__(self, source: str):
        self._parse(source, frozenset())
        if holders := self._misnamed():
            self._parse(source, holders)

    def _parse(self, source: str, holders: frozenset[int]) -> None:
        self._holders = holders
        self._never, self._named_outside, self._marked, self.suspects = [False], set(), {}, []
        self.items: list[Token] = []
        self.parent, self.last, self.whole, self._sealed = [0], [0], [True], [False]
        self._stack = [Open("", "top", False, False, 0)]
        self._block, self._before = 0, {}
        self._at, self._blocks, self._bounds = defaultdict(list), [0], [0]  # depths of the open elements by tag, of blocks, of bounds of a p
        for m in _TOKEN.finditer(source):
            if m["text"] is not None:
                self._add("word in " + self._stack[-1].key, m["text"], len(m["text"].split()))
            elif m["raw"]:
                self._add("tag " + m["raw"].lower())
            elif m["tag"] and m["end"]:
                self._end(m["tag"].lower())
            elif m["tag"]:
                self._start(m["tag"].lower(), m["rest"])
        self._close(0)
        if True in self._sealed:
            for number in range(1, len(self.parent)):
                self._sealed[number] |= self._sealed[self.parent[number]]
            self.items = [t for t in self.items if not self._sealed[t.element]]

    def _misnamed(self) -> frozenset[int]:
        """The elements that only a name puts outside although they hold the page's article or, if none is marked, most of its words.

        The page's article is the main element with most words, or else the article element with most; an article with most of the words
        of the main element, or beside it with more words, counts as well.
        """
        if not self._named_outside:
            return frozenset()
        total = [0] * (len(self.parent) + 1)
        for t in self.items:
            if t.words and not self._never[t.element]:
                total[t.element + 1] += t.words
        for number in range(len(self.parent)):
            total[number + 1] += total[number]

        def words(number: int) -> int:
            return total[self.last[number] + 1] - total[number]

        def most(tag: str) -> int:
            return max((n for n, t in self._marked.items() if t == tag), key=words, default=0)

        main, article = most("main"), most("article")
        held = {main or article}
        if words(article) * (2 if main < article <= self.last[main] else 1) > words(main):
            held.add(article)
        if held == {0}:
            return frozenset(n for n in self._named_outside if 2 * words(n) > words(0))
        return frozenset(n for n in self._named_outside if any(n <= h <= self.last[n] for h in held))

    def _add(self, key: str, text: str | None = None, words: int = 0) -> None:
        top = self._stack[-1]
        self.items.append(Token(key, text, words, self._block, top.label, top.outside, top.number))

    def _close(self, depth: int) -> None:
        for element in reversed(self._stack[depth:]):
            self.last[element.number] = len(self.last) - 1
            for depths in (self._at[element.tag], self._blocks, self._bounds):
                if depths and depths[-1] == len(self._stack) - 1:
                    depths.pop()
            self._stack.pop()

    def _imply_ends(self, names: set[str], bounds: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of these names, and all within it, unless a bound stands before."""
        depth = max((self._at[name][-1] for name in names if self._at[name]), default=0)
        bound = self._bounds[-1] if bounds is NOT_P else max((self._at[name][-1] for name in bounds if self._at[name]), default=0)
        if depth > bound:
            self._close(depth)

    def _end(self, tag: str) -> None:
        depth = self._at[tag][-1] if self._at[tag] else 0
        if depth and (tag not in INLINE_ENDS or depth > self._blocks[-1]):  # a stray inline end tag closes no block
            if tag in EMBEDDED:
                self._sealed[self._stack[depth].number] = True
                self._block = self._before[self._stack[depth].number]
            self._close(depth)
        self._block += tag in BLOCK
        self._add("tag /" + tag)

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._add("tag br", " ")
            return
        names = _names(rest) if "=" in rest else ""
        if tag in BLOCK:
            self._imply_ends({"p"}, NOT_P)
            self._block += 1
        if tag in CLOSES:
            self._imply_ends(*CLOSES[tag])
        top = self._stack[-1]
        hidden = "hidden" in rest and _HIDDEN.search(_QUOTED.sub('""', rest)) is not None
        holder = len(self.parent) in self._holders
        outside = top.outside or hidden or is_outside(tag, "" if holder else names)
        own = f"{tag}{HOLDER if holder else ''}.{names}" if names else tag
        if tag not in VOID and (tag in BLOCK or not rest.endswith("/")):
            named = not top.outside and tag not in INLINE_ENDS and tag not in EMBEDDED and (outside or bool(names) or tag in NAMED)
            label = (top.label or tag in LABELS) and not outside
            self.parent.append(top.number)
            self.last.append(0)
            self.whole.append(tag in ("html", "body"))
            self._sealed.append(False)
            number = len(self.parent) - 1
            self._never.append(self._never[top.number] or hidden or is_outside(tag, ""))
            if not self._never[number]:
                if tag in LABELS:
                    self._marked[number] = tag
                if is_outside(tag, names):
                    self._named_outside.add(number)
            depth = len(self._stack)
            self._at[tag].append(depth)
            if tag in BLOCK:
                self._blocks.append(depth)
            if tag in NOT_P:
                self._bounds.append(depth)
            if names and not outside and not OUTSIDE_WORDS.isdisjoint(_NAME_WORDS.findall(_NO_SIGN.sub(" ", names))):
                self.suspects.append(number)
            self._stack.append(Open(tag, own if named else top.key, outside, label, number))
            if tag in EMBEDDED:
                self._before[len(self.parent) - 1] = self._block
                return  # its end tag counts
        self._add("tag " + own)

    def holder(self, first: int, second: int) -> int:
        """The innermost element that holds two elements, the first not after the second."""
        while self.last[first] < second:
            first = self.parent[first]
        return first


@lru_cache(maxsize=4096)
def _names(rest: str) -> str:
    found = [next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(rest)]
    return re.sub(r"[0-9]+", "#", " ".join(found)).lower()


@lru_cache(maxsize=4096)
def is_outside(tag: str, names: str) -> bool:
    """Whether no article has the element: by its tag, or a name of it that consists of such words alone.

    Names of the whole page and of holders, negated ones and those of layouts are no sign. A name with other words in it counts by its learnt weight only.
    """
    if tag in OUTSIDE or tag in RAW:
        return True
    if tag in ("html", "body") or tag.endswith(HOLDER):
        return False
    told = (_NAME_WORDS.findall(name) for name in _NO_SIGN.sub(" ", names).split())
    return any(words and OUTSIDE_WORDS.issuperset(words) for words in told)


# ---------------------------------------------------------------- weights


@lru_cache(maxsize=4096)
def prior(key: str) -> float:
    """The score of what no labelled page has shown: words count for, tags and all in elements that no article has count against."""
    tag, _, names = key.removeprefix("word in ").removeprefix("tag ").lstrip("/").partition(".")
    outside = is_outside(tag, names) or tag in EMBEDDED
    if key.startswith("word"):
        return -1.0 if outside else 1.0
    return -2.0 if outside else -0.25


def label_counts(pages: DataFrame, html_col: str = "html", sample: int = 2000) -> DataFrame:
    """``(key, inside, beyond)``: words and tags of labelled pages inside and outside the marked article.

    A page is labelled if its author marked the article (``article`` or ``main``). At most ``sample`` of them are read, equal ones once: those
    with the smallest hashes of their html, so that the choice is the same in each run. Hashes are sorted, not pages.
    """
    text = F.col(f"`{html_col}`").cast("string")
    marked = pages.where(text.rlike("(?i)<(article|main)[\\s>]")).select(text.alias("html"), F.xxhash64(text).alias("h"))
    first = durable(marked.select("h").distinct().orderBy("h").limit(sample), "labelled-pages")
    chosen = marked.join(F.broadcast(first), "h", "left_semi").dropDuplicates(["h"]).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for page in batch.column(0):
                for token in Page(page.as_py()).items:
                    sums[token.key][not token.label] += token.words if token.key.startswith("word") else 1
        rows = [{"key": k, "inside": v[0], "beyond": v[1]} for k, v in sums.items() if v != [0, 0]]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("inside", pa.int64()), ("beyond", pa.int64())]))

    counts = chosen.repartition(8).mapInArrow(run, "key string, inside long, beyond long")
    return counts.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("beyond").alias("beyond"))


def weights(pages: DataFrame, html_col: str = "html", sample: int = 2000) -> dict[str, float]:
    """Scores by key. The driver receives the counts of a bounded sample, at most one row for each kind of tag in it.

    A score is the prior moved by the log odds of standing inside the article: a word's within -2 to 2, a tag's within -4 to
    -0.01 (inside an article tags cost little, so that its blocks hold together).
    """
    found = {}
    for row in label_counts(pages, html_col, sample).collect():
        odds = math.log((row.inside + 0.5) / (row.beyond + 0.5))
        if row.key.startswith("word"):
            found[row.key] = max(-2.0, min(2.0, prior(row.key) + odds))
        else:
            found[row.key] = max(-4.0, min(-0.01, prior(row.key) + odds))
    return found


# ---------------------------------------------------------------- extraction


def best_range(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous range with the largest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, place, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, place = total, (start, i + 1)
    return place


class Scores(dict):
    """Scores by key, with the prior for keys that were not learnt."""

    def __missing__(self, key: str) -> float:
        return prior(key)


def main_text(page: str | None, scores: Scores) -> str:
    """The article's blocks, one per line.

    The best range is widened to the whole of the innermost named element that holds all of it (unless that is the
    page), so that an aside in the article doesn't cost a short end; what stands in elements that no article
    has is then left out, and so are elements with a word in their names that speaks against them, if their own score is negative.
    """
    tree = Page(page or "")
    items = tree.items
    values = [scores[t.key] * (t.words if t.text is not None else 1) for t in items]
    start, end = best_range(values)
    kept = [t.element for t in items[start:end] if t.words and not t.outside]
    if not kept:
        return ""
    holder = tree.holder(min(kept), max(kept))
    inside = items[start:end] if tree.whole[holder] else [t for t in items if holder <= t.element <= tree.last[holder]]
    cut = _cut(tree, values, min(kept), max(kept))
    blocks: dict[int, list[str]] = {}
    for t in inside:
        if t.text is not None and not t.outside and t.element not in cut:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join(markup.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _cut(tree: Page, values: list[float], first: int, last: int) -> set[int]:
    """The elements within suspects whose own score is negative, unless these hold the best range, from element ``first`` to ``last``."""
    if not tree.suspects:
        return set()
    total = [0.0] * (len(tree.parent) + 1)
    for t, value in zip(tree.items, values):
        total[t.element + 1] += value
    for number in range(len(tree.parent)):
        total[number + 1] += total[number]
    cut: set[int] = set()
    for number in tree.suspects:
        holds = number <= first and last <= tree.last[number]
        if number not in cut and not holds and total[tree.last[number] + 1] - total[number] < 0:
            cut.update(range(number, tree.last[number] + 1))
    return cut


def extract(
    pages: DataFrame, scores: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(page_id, url, text)`` for each row; the text is empty if the page has no main text (null and empty html included).

    ``scores`` are learnt from ``pages`` if not given. Rows are treated one by one: repeated rows give equal results, an
    empty table gives none, other columns are not read.
    """
    known = Scores(weights(pages, html_col) if scores is None else scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(cell.as_py(), known) for cell in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
