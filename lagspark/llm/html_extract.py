"""Main text of web pages by structure and by site template removal.

Every page is parsed into an element tree with HTML's optional end tags closed. Block
elements that hold text are hashed bottom-up over the whole tree; Spark counts on how many
pages of its host each hash stands, and those on many pages are the site's template.
The second pass drops the template, the elements that are never content (menus, headers,
footers, sidebars, forms, scripts, styles) and those whose class, id or role names a notice,
an advert, a menu or reader comments, then writes the rest as one line per block.
If a page has an article, only articles (else <main>, else the body) give text.

Inside an article or <main> the count goes by boxes only (div, section, lists, tables and the
like, not single paragraphs or headings), and it drops them only if they hold at most
INSIDE of the text there: a passage that many articles share is still theirs, and a page
whose text recurs as a whole is a copy of another page, not its template.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a newline. A null or empty page gives the empty text. Malformed markup is read as
browsers do where that matters for text: a stray '<' is text, unclosed elements end with
their parents. A null url is a host of its own. Rows that repeat an id are pages of their own.
Pages are read whole, however long; an empty table gives an empty one. Only the id, the url
and the html are read, so other columns may have any names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut

#: Template: a subtree on at least this share of the host's pages, and on this many.
RATIO, MIN_PAGES = 0.3, 5
#: Share of the text of an article or <main> that recurring boxes may hold to be template.
INSIDE = 1 / 3
#: Hashes of all hosts' templates that are broadcast (8 MB); more are joined by host and salt.
BROADCAST_HASHES = 1_000_000
#: Keys that the pages of one host are dealt over.
SALTS = 32

#: A tag of common length, and where such a one is looked for; longer and broken ones take the slower way.
TAG, SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"), 512
#: What ends a tag's name, and what matters behind it.
NAME_END, SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=\"'>/])([^\s=\"'>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "xmp")}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
#: What may be template inside an article.
BOX = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
#: Never content.
NOISE = frozenset(
    "aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object script select style svg"
    " template textarea title video".split()
)
#: Words of a class, id or role that mark what is not content.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie"
    " cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager"
    " popup promo promoted promotion related replies search share sharing sidebar sidebars signup social sponsor sponsored"
    " subscribe subscription toolbar widget widgets complementary".split()
)
#: What an opening tag closes: (the open elements it ends, the elements that it can't look past).
SCOPE = frozenset("table td th caption html body button object".split())
CLOSES = {
    "li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu"}),
    "dd": (frozenset(["dd", "dt"]), SCOPE | {"dl"}),
    "dt": (frozenset(["dd", "dt"]), SCOPE | {"dl"}),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
ENDS_P = BLOCK - frozenset("body head html caption legend option tbody td tfoot th thead title tr".split())


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # Elements and strings


class Ahead:
    """What comes next in a page: each stretch is searched once, however often it is asked about."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[re.Pattern | str, tuple[int, int]] = {}
        self.failed: set[int] = set()

    def next(self, what: re.Pattern | str, at: int) -> int:
        """The first place from at on; the page's length if there is none."""
        since, found = self.known.get(what, (0, -1))
        if since <= at <= found:
            return found
        if isinstance(what, str):
            found = self.page.find(what, at)
        else:
            match = what.search(self.page, at)
            found = match.start() if match else -1
        found = len(self.page) if found < 0 else found
        self.known[what] = at, found
        return found

    def tag_end(self, at: int) -> int:
        """The place behind the > that ends a tag whose name ends at at, quoted ones aside; -1 if there is none."""
        way, size = [], len(self.page)
        while at not in self.failed:
            way.append(at)
            special = self.next(SPECIAL, at)
            if special == size:
                break
            if self.page[special] == ">":
                return special + 1
            closing = self.next(self.page[special], special + 1)
            if closing == size:
                break
            at = closing + 1
        self.failed.update(way)
        return -1


class OpenElements:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Element):
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, element: Element) -> None:
        places = self.places.get(element.tag)
        if places is None:
            places = self.places[element.tag] = []
        places.append(len(self.stack))
        if element.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        place = 0
        for tag in tags:
            places = self.places.get(tag)
            if places and places[-1] > place:
                place = places[-1]
        return place

    def end(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place:
            element = self.stack.pop()
            self.places[element.tag].pop()
            if element.tag in BLOCK:
                self.blocks.pop()

    def close(self, names, stop) -> None:
        """Close the innermost element of the names, unless one of stop is open inside it."""
        place = self.last(names)
        if place and place >= self.last(stop):
            self.end(place)


def parse(page: str) -> Element:
    """The element tree of a page, in time that grows with its length, however it is malformed."""
    root = Element("#root")
    open_, ahead = OpenElements(root), Ahead(page)
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            text = page[at:end]
            open_.stack[-1].children.append(html.unescape(text) if "&" in text else text)
            at = end
            continue
        token = TAG.match(page, at, at + SHORT)
        if token:
            ends, tag, attributes = token.groups()
            tag, at = tag.lower(), token.end()
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        elif ahead.next(">", at) == size:  # no more tags: the rest up to a comment is text
            end = page.find("<!--", at)
            end = size if end < 0 else end
            open_.stack[-1].children.append(html.unescape(page[at:end]))
            at = end
            continue
        else:
            after = page[at + 1]
            ends = "/" if after == "/" else ""
            first, behind = at + 1 + len(ends), -1
            if page[first : first + 1].isascii() and page[first : first + 1].isalpha():
                name_end = ahead.next(NAME_END, first)
                behind = ahead.tag_end(name_end)
            if behind < 0:
                if after in "!?/":
                    at = ahead.next(">", at) + 1
                else:
                    open_.stack[-1].children.append("<")
                    at += 1
                continue
            tag, attributes, at = page[first:name_end].lower(), page[name_end : behind - 1], behind
        if ends:
            place = open_.last((tag,))
            # An inline end tag doesn't end the block it stands in.
            if place and (tag in BLOCK or not open_.blocks or place > open_.blocks[-1]):
                open_.end(place)
            continue
        if tag in ENDS_P:
            open_.close(("p",), SCOPE)
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        element = Element(tag, attributes)
        open_.stack[-1].children.append(element)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and (tag in BLOCK or not attributes.endswith("/")):
            open_.push(element)  # a slash means nothing on an HTML element
    return root


def is_noise(element: Element, inside: bool) -> bool:
    """True for what is not content. inside: within an article, whose own header holds its title."""
    if element.tag in NOISE or element.tag == "header" and not inside:
        return True
    if not element.attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(element.attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            if not NOISE_WORDS.isdisjoint(NAME.findall(value)) and element.tag not in ("html", "body", "article", "main"):
                return True
        elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", element.attributes, re.I)) and element.tag not in ("html", "body")


def subtree_hashes(root: Element) -> dict[int, tuple[int, int]]:
    """(hash, characters) by the element's id() of each element that may be template: blocks with text, inside articles boxes only."""
    out: dict[int, tuple[int, int]] = {}
    # Iterative: pages may nest deeper than the interpreter's stack.
    stack = [(root, iter(root.children), xxhash.xxh3_64(root.tag.encode()), [0], False)]
    while stack:
        element, rest, state, size, inside = stack[-1]
        for child in rest:
            if isinstance(child, str):
                words = " ".join(child.split())
                if words:
                    state.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                    size[0] += len(words)
            else:
                within = inside or element.tag in ("article", "main")
                stack.append((child, iter(child.children), xxhash.xxh3_64(child.tag.encode()), [0], within))
                break
        else:
            stack.pop()
            digest = state.intdigest()
            if stack:
                stack[-1][2].update(b"\1" + digest.to_bytes(8, "little"))
                stack[-1][3][0] += size[0]
            if size[0] and element.tag in (BOX if inside else BLOCK) and element.tag not in ("html", "body", "head", "article", "main"):
                out[id(element)] = digest - (1 << 63), size[0]
    return out


def template_elements(root: Element, tops: list[Element], template: frozenset[int]) -> set[int]:
    """id() of the page's elements that are template: recurring ones, inside its articles by the rule of INSIDE."""
    hashed = subtree_hashes(root)
    gone = {key for key, (digest, _) in hashed.items() if digest in template}
    for top in tops:
        total, removed, own, stack = 0, 0, set(), [(top, False)]
        while stack:
            element, under = stack.pop()
            if id(element) in gone:
                own.add(id(element))
                removed += 0 if under else hashed[id(element)][1]
                under = True
            for child in element.children:
                if isinstance(child, str):
                    total += len(" ".join(child.split()))
                else:
                    stack.append((child, under))
        if removed > INSIDE * total:
            gone -= own
    return gone


def roots(root: Element, tags: tuple[str, ...]) -> list[Element]:
    """Outermost content elements with one of the tags, in page order."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.tag in tags:
            found.append(element)
        elif not is_noise(element, False):
            stack += [c for c in reversed(element.children) if not isinstance(c, str)]
    return found


def main_text(root: Element, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, one a line."""
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            blocks.append(text)

    tops = roots(root, ("article",)) or roots(root, ("main",))
    inside = bool(tops)
    gone = template_elements(root, tops, template) if template else set()
    for top in tops or [root]:
        flush()
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                piece.append(item)
            elif item.tag == "br":
                piece.append(" ")
            elif item is not top and (is_noise(item, inside) or id(item) in gone):
                if item.tag in BLOCK:
                    flush()
            else:
                if item.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(item.children)
    flush()
    return "\n".join(blocks)


def host_of(url: str) -> str:
    """The host part of a url column, lower-case."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, __drop): for each host the hashes of the subtrees that many of its pages hold.

    A hash is kept only after it is known to stand on the ratio of its host's pages, so an
    array holds at most (subtrees of a mean page / ratio) hashes.
    """
    rows = pages.select(host_of(url_col).alias("__host"), F.col(html_col).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted({h for h, _ in subtree_hashes(parse(as_text(x.as_py()))).values()}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["__host", "hashes"])

    hashed = rows.mapInArrow(run, "__host string, hashes array<long>")
    counts = hashed.select("__host", F.explode("hashes").alias("hash")).groupBy("__host", "hash").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= min_pages).withColumn("__salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    totals = _salted(rows.groupBy("__host").agg(F.count("*").alias("pages")))
    over = often.join(totals, ["__host", "__salt"]).where(F.col("n") >= ratio * F.col("pages"))
    return over.groupBy("__host").agg(F.collect_list("hash").alias("__drop"))


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    drop = cut(templates(pages, url_col, html_col, ratio, min_pages))
    rows = pages.select(
        F.col(id_col).alias("__id"),
        F.col(url_col).alias("__url"),
        F.col(html_col).cast("binary").alias("__html"),
        host_of(url_col).alias("__host"),
        F.pmod(F.xxhash64(id_col, html_col), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    size = drop.agg(F.sum(F.size("__drop")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(drop), "__host", "left")
    else:
        joined = rows.join(_salted(drop), ["__host", "__salt"], "left")
    joined = joined.select("__id", "__url", "__html", "__drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                texts = [
                    main_text(parse(as_text(page.as_py())), frozenset(gone.as_py() or ()))
                    for page, gone in zip(some.column(2), some.column(3))
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
