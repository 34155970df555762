"""Captured HTML pages: details, gallery entries, block detection and redaction.

HTML needs a tolerant parser, which Spark lacks, so pages go through ``mapInPandas`` in Arrow batches,
one page at a time and whole. Everything that can be decided on the text itself is native.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of anti-bot challenges, the loose ones for suspect statuses only.
BLOCK_MARKERS = [
    "just a moment",
    "cf-chl",
    "cf_chl_opt",
    "attention required! | cloudflare",
    "_cf_chl_",
    "challenge-platform",
    "captcha",
    "verify you are human",
]
STRICT_BLOCK_MARKERS = ["cf_chl_opt", "cdn-cgi/challenge-platform"]
REDACTED = "redacted-when-captured"
REDACTED_TEXT = "Description removed when the page was captured."
CREDENTIAL_META = r'(<meta\b[^>]*\bname="(?:[a-z-]*-api-key|csrf-token)"[^>]*\bcontent=")([^"]*)(")'
DESCRIPTION_META = (
    r'(<meta\b(?=[^>]*(?:name="description"|property="og:description"|name="twitter:description"'
    r'|itemprop="description"))[^>]*\bcontent=")([^"]*)(")'
)
# Elements whose start ends a paragraph, and those that end one of their own kind within some bounds.
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog dl div fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li"
    " main menu nav ol p pre search section table ul".split()
)
_INLINE = frozenset("a abbr b bdi bdo cite code del em font i ins mark q s small span strike strong sub sup time tt u".split())
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


class _Node:
    """An element. ``nodes`` lists all elements of the page in order; those inside this one follow it."""

    __slots__ = ("tag", "attrs", "parent", "children", "nodes", "index", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None, nodes: list[_Node]):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.nodes, self.index, self.end = nodes, len(nodes) - (parent is None), None

    def walk(self) -> list[_Node]:
        return self.nodes[self.index + 1 : self.end]

    def all(self, tag: str | None = None, cls: str | None = None, **attrs):
        for node in self.walk():
            if tag and node.tag != tag:
                continue
            if cls and cls not in node.attrs.get("class", "").split():
                continue
            if all(node.attrs.get(k) == v for k, v in attrs.items()):
                yield node

    def first(self, *args, **kwargs):
        return next(self.all(*args, **kwargs), None)

    def texts(self):
        """The text inside, in order; a stack of what is still to come instead of recursion, whatever the depth."""
        ahead = [iter(self.children)]
        while ahead:
            child = next(ahead[-1], None)
            if child is None:
                ahead.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                ahead.append(iter(child.children))


class _Tree(HTMLParser):
    """Elements and text. An end tag closes up to its nearest open element, strays are ignored, omitted ends are implied."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = []
        self.root = self.here = _Node("", {}, None, self.nodes)
        self.feed(html)
        self.close()

    def _add(self, tag, attrs) -> _Node:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here, self.nodes)
        self.nodes.append(node)
        self.here.children.append(node)
        return node

    def _imply_ends(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: the open element itself or the nearest one before its list, table or block."""
        node = self.here
        while tag in _ENDS_PARAGRAPH and node.tag in _INLINE:
            node = node.parent
        if node.tag == "p" and tag in _ENDS_PARAGRAPH:
            self.handle_endtag("p")
        closed, bounds = _CLOSES.get(tag, ((), ()))
        node = self.here
        while closed and node.parent is not None and node.tag not in bounds:
            if node.tag in closed:
                self.handle_endtag(node.tag)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        node = self._add(tag, attrs)
        if tag in _VOID:
            node.end = len(self.nodes)
        else:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs).end = len(self.nodes)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is None:
            return
        while self.here is not node.parent:
            self.here.end = len(self.nodes)
            self.here = self.here.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _clean(value: str | None) -> str | None:
    return (value or "").strip() or None


def _map_pages(captured: DataFrame, key: str, parse, schema: str) -> DataFrame:
    """Apply ``parse(html) -> rows`` to each page; rows get the page's key."""
    key_type = captured.schema[key].dataType.simpleString()
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(k, *row) for k, body in zip(batch[key], batch.body) for row in parse(body or "")]
            yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    return captured.select(key, "body").mapInPandas(run, f"{key} {key_type}, {schema}")


def _links(tree: _Node):
    for a in tree.all("a"):
        href = _clean(a.attrs.get("href"))
        if href and href.startswith("http"):
            yield href


def _software_page(html: str):
    tree = _Tree(html).root
    container = tree.first(id="app-details-left") or tree.first("div", id="software-description")
    description = None
    if container is not None:
        description = _clean(" ".join(t.strip() for t in container.texts() if t.strip()))
    if not description:
        meta = tree.first("meta", name="description")
        description = _clean(meta.attrs.get("content")) if meta else None
    links = [href for box in tree.all(cls="app-links") for href in _links(box)]
    repo = next((u for u in links if "github.com" in u), None)
    demo = next((u for u in links if "github.com" not in u), None)
    box = tree.first(id="built-with")
    tags = [_clean("".join(t.texts())) for t in box.all(cls="cp-tag")] if box else []
    yield description, repo, demo, [t for t in tags if t]


def software_details(captured: DataFrame, key: str) -> DataFrame:
    """Description, first repository link, first other link and declared tags of a project page."""
    return _map_pages(
        captured, key, _software_page, "description string, repo_url string, demo_url string, tags array<string>"
    )


def _gallery_page(html: str):
    tree = _Tree(html).root
    for position, node in enumerate(n for n in tree.walk() if "data-software-id" in n.attrs):
        link = node.first("a", cls="link-to-software") or next(
            (a for a in node.all("a") if "/software/" in a.attrs.get("href", "")), None
        )
        href = link.attrs.get("href", "") if link else ""
        slug = re.search(r"/software/([^/?#]+)", href)
        if not slug:
            continue
        badge, title, tagline = node.first("aside", cls="entry-badge"), node.first("h5"), node.first("p", cls="tagline")
        label = "".join(badge.texts()) if badge else ""
        won = node.first("img", cls="winner") is not None or "winner" in label.lower()
        people = [img for cls in ("members", "user-profile-link") for box in node.all(cls=cls) for img in box.all("img")]
        names = dict.fromkeys(filter(None, (_clean(img.attrs.get("alt")) for img in people)))
        yield (
            position,
            slug.group(1),
            href.split("?")[0],
            (_clean("".join(title.texts())) if title else None) or slug.group(1),
            _clean("".join(tagline.texts())) if tagline else None,
            won,
            _clean(label) if won else None,
            ", ".join(names) or None,
        )


def gallery_entries(captured: DataFrame, key: str) -> DataFrame:
    """All entries of a gallery page; winners carry a ribbon or a badge."""
    return _map_pages(
        captured,
        key,
        _gallery_page,
        "position int, slug string, url string, title string, tagline string, is_winner boolean, "
        "prize_track string, team_name string",
    )


def _page_outline(html: str):
    tree = _Tree(html).root
    title, meta = tree.first("title"), tree.first("meta", name="description")
    links = [a.attrs["href"] for a in tree.all("a") if _clean(a.attrs.get("href"))]
    yield (
        _clean("".join(title.texts())) if title else None,
        links[0] if links else None,
        len(links),
        _clean(meta.attrs.get("content")) if meta else None,
    )


def page_outlines(captured: DataFrame, key: str) -> DataFrame:
    """Title, first link, number of links and meta description of any page."""
    return _map_pages(
        captured, key, _page_outline, "title string, first_link string, n_links int, meta_description string"
    )


# --- native decisions ------------------------------------------------------------------------


def _first_marker(lowered: Column, markers: list[str]) -> Column:
    found = F.lit(None).cast("string")
    for marker in reversed(markers):
        found = F.when(F.contains(lowered, F.lit(marker)), marker).otherwise(found)
    return found


def block_flags(captured: DataFrame, url: str = "url", status: str = "status", body: str = "body") -> DataFrame:
    """Whether a response is an anti-bot challenge, by which marker, and a note for the run log.

    Loose markers count next to a suspect status, strict ones always; a bare 403 is a block too.
    """
    code = F.col(status)
    rows = captured.withColumn("lowered", F.lower(body)).withColumns(
        {"loose": _first_marker(F.col("lowered"), BLOCK_MARKERS), "strict": _first_marker(F.col("lowered"), STRICT_BLOCK_MARKERS)}
    )
    marker = F.when(code.isin(403, 503) & F.col("loose").isNotNull(), F.col("loose")).when(code != 403, F.col("strict"))
    blocked = marker.isNotNull() | (code == 403)
    flagged = rows.withColumns({"marker": marker, "blocked": blocked}).drop("lowered", "loose", "strict")
    note = F.to_json(
        F.struct(F.lit("blocked").alias("reason"), F.col(url).alias("url"), code.alias("status"), "marker"),
        {"ignoreNullFields": "false"},
    )
    return flagged.withColumn("note", F.when(F.col("blocked"), note))


def redact(body: Column) -> Column:
    """Neutralise credentials and descriptions in the meta tags of a captured page."""
    without_keys = F.regexp_replace(body, CREDENTIAL_META, f"$1{REDACTED}$3")
    return F.regexp_replace(without_keys, DESCRIPTION_META, f"$1{REDACTED_TEXT}$3")


def has_residue(body: Column) -> Column:
    """A credential tag whose content is not the replacement."""
    tag = r'<meta\b[^>]*\bname="(?:[a-z-]*-api-key|csrf-token)"[^>]*\bcontent="'
    return body.rlike(rf'{tag}(?!{REDACTED}")[^"]+"')
