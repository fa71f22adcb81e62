"""Main text of HTML pages by site template removal.

Each page's element subtrees are hashed, and so is the slot each stands in: its path of tags, class names and places among
its like. Spark counts, for every host, in how many different pages a slot shows the same subtree. A slot is template where
at least half of what it shows recurs: menus, adverts from a pool, footers, notices. A paragraph that many articles share
stands now here, now there, among paragraphs that do not recur, so it is text. Pages with the same article count once, since
a host may show one article at many addresses: the named article, or else the largest block of the page, tells pages apart.

The same rules hold on hosts of any size. What says by its tag, role or class that it is a menu, an advert, a form or comments goes. Where a
page names its article, the text is the article's, and of what is in it only boxes of links go by the counts. Elsewhere
subtrees that recur go, and boxes that do not in the slots of those that do (an advert that was drawn once); what has half
of the page's text never goes by the counts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, texts_of, unpacked, written

MIN_PAGES = 4  # a template slot shows recurring subtrees on so many pages of its host at least, and a subtree that goes for itself is on so many
MIN_SHARE = 0.5  # of what a template slot shows recurs

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("head script style noscript template title textarea iframe object svg math canvas audio video select option datalist button input xmp noembed noframes".split())
_BOILERPLATE = frozenset("nav header footer aside form dialog menu fieldset".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
#: Class and id words of what a page has besides its main text.
_NAMES = re.compile(_WORDS % "ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|header|footer|sidebar|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|share|sharing|social|comments?|replies|disqus|respond|related|widget|login|signup|search|skip|pagination|pager", re.I)
#: Of these, what may stand in an article without being of it.
_IN_ARTICLE = re.compile(_WORDS % "ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|comments?|replies|disqus|respond|newsletter|share|sharing|related|sidebar", re.I)
_CLOSED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
_BOXES = frozenset("div section ul ol dl table figure center".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
_DIGITS = re.compile(r"[0-9]+")
_BARRIER = frozenset("table td th body html article section div ul ol nav aside footer header main".split())


@dataclass
class Node:
    tag: str
    attributes: str = ""
    parts: list = field(default_factory=list)  # nodes and texts in page order
    hash: int = 0
    size: int = 0  # characters of text
    links: int = 0  # those of them in links
    holds: bool = False  # an article is inside
    slot: int = 0


def parse(page: str) -> Node:
    """A tree of elements and raw texts. Unclosed elements end with their parent; an end tag that closes nothing is ignored."""
    root = Node("")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in ("p", "b", "i", "em", "strong", "span", "a") and stack[i].tag in _BARRIER:
                    break  # an inline or paragraph end does not reach beyond its block
            continue
        if tag in _BLOCKS:
            # a new block ends the paragraph or item it cannot be in, and the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if tag in _CLOSED_BY.get(stack[i].tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in _BARRIER:
                    break
        node = Node(tag, m[3] or "")
        stack[-1].parts.append(node)
        if tag in _VOID or (m[3] or "").rstrip().endswith("/"):
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            node.parts.append(page[at:stop])
            at = end if close is None else (page.find(">", stop) + 1 or end)
            continue
        stack.append(node)
    return root


def measure(root: Node, articles: list[Node]) -> None:
    """Sets slot, hash (of tag, attributes, texts with white space made one, and what is below), size, links and holds of each element."""
    own = {id(a) for a in articles}
    # children first, without recursion: pages may be nested as deeply as they like
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        below = [p for p in n.parts if isinstance(p, Node)]
        seen: dict[str, int] = {}
        for p in below:
            like = f"{p.tag} {_DIGITS.sub('', _attributes(p).get('class', '')) if 'class' in p.attributes else ''}"
            seen[like] = nth = seen.get(like, 0) + 1
            p.slot = xxhash.xxh64_intdigest(f"{n.slot} {like} {nth}")
        todo.extend(below)
    for n in reversed(order):
        h = xxhash.xxh64(f"<{n.tag} {_SPACE.sub(' ', n.attributes).strip()}>")
        for p in n.parts:
            if isinstance(p, Node):
                h.update(p.hash.to_bytes(8, "little"))
                n.size += p.size
                n.links += p.links
                n.holds |= p.holds or id(p) in own
            else:
                t = _SPACE.sub(" ", p).strip()
                h.update(b"\0" + t.encode("utf-8", "replace"))
                n.size += len(t)
        if n.tag in _RAW or n.tag == "head":
            n.size = 0
        n.hash = h.intdigest()
        if n.tag == "a":
            n.links = n.size


def _may_be_template(n: Node) -> bool:
    """Whatever has text, is no part of a line and holds no article."""
    return n.size > 0 and not n.holds and n.tag not in _INLINE


def _mostly_links(n: Node) -> bool:
    return n.tag in _BOXES and n.size > 0 and 2 * n.links >= n.size


def _content(root: Node) -> int:
    """What tells a page without a named article from others: the hash of its largest block, by text outside links, from the outside in."""
    n = root
    while True:
        below = [p for p in n.parts if isinstance(p, Node) and p.size > p.links and p.tag not in _INLINE and not _marked(p)]
        if not below:
            return n.hash
        n = max(below, key=lambda p: p.size - p.links)


def subtrees(page: str) -> tuple[int, list[tuple[int, int]]]:
    """(hash of the articles, or of the largest block; slot and hash of the subtrees that may be template)."""
    root = parse(page)
    articles = _articles(root)
    measure(root, articles)
    found, todo = [], list(articles) or [root]
    while todo:
        n = todo.pop()
        for p in n.parts:
            if isinstance(p, Node):
                if _may_be_template(p) and (_mostly_links(p) or not articles and p.tag not in ("html", "body")):
                    found.append((p.slot, p.hash))
                # what is marked goes anyhow, but for headers, which may be an article's
                if p.tag == "header" or p.holds or not _marked(p):
                    todo.append(p)
    content = xxhash.xxh64_intdigest(b"".join(a.hash.to_bytes(8, "little") for a in articles)) if articles else _content(root)
    return content, found


def _attributes(n: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(n.attributes)} if n.attributes.strip() else {}


def _marked(n: Node) -> bool:
    """An element that says by its tag, role or style that it is not main text."""
    if n.tag in _HIDDEN or n.tag in _BOILERPLATE:
        return True
    if not n.attributes or n.tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(n)
    return a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _named(n: Node, words: re.Pattern, whole: int) -> bool:
    """A box with one of the words in its class or id. What has half of the page's text is no such box, nor is a header that has a heading."""
    if not n.attributes or n.tag in ("html", "body", "article", "main") or 2 * n.size > whole:
        return False
    a = _attributes(n)
    found = [m[0].strip(" \t\r\n_-").lower() for k in ("class", "id") for m in words.finditer(a.get(k, ""))]
    return any(f != "header" for f in found) or bool(found) and not any(isinstance(p, Node) and p.tag == "h1" for p in n.parts)


def _articles(root: Node) -> list[Node]:
    """The outermost article elements that are not marked, or else the main elements."""
    for kind in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == kind:
                found.append(n)
            elif n is root or n.tag not in _HIDDEN and not (n.tag != "header" and (_marked(n) or _named(n, _NAMES, 1 << 62))):
                todo.extend(p for p in reversed(n.parts) if isinstance(p, Node))
        if found:
            return found
    return []


def main_text(page: str, recurring: set[int] | frozenset[int] = frozenset(), rotating: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by an empty line.

    recurring: template slots whose subtree here recurs on the host. rotating: template slots with one that does not.
    """
    root = parse(page)
    articles = _articles(root)
    measure(root, articles)
    text = _blocks(root, articles, recurring, rotating)
    # a page of which all recurs is rather text than nothing
    return text or (_blocks(root, articles, frozenset(), frozenset()) if recurring or rotating else text)


def _unmarked(root: Node) -> int:
    """Characters of a page's text outside what is marked."""
    size, todo = 0, [root]
    while todo:
        for p in todo.pop().parts:
            if not isinstance(p, Node):
                size += len(_SPACE.sub(" ", p).strip())
            elif not _marked(p):
                todo.append(p)
    return size


def _blocks(root: Node, articles: list[Node], recurring: set[int] | frozenset[int], rotating: set[int] | frozenset[int]) -> str:
    own, whole = {id(a) for a in articles}, _unmarked(root) if recurring or rotating else 0
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(inline)).strip()
        inline.clear()
        if text:
            blocks.append(text)

    def goes(n: Node, inside: bool) -> bool:
        if _may_be_template(n) and (_mostly_links(n) or not inside and 2 * n.size <= whole):
            if n.slot in recurring or not inside and n.slot in rotating and n.tag in _BOXES:
                return True
        if n.holds or n.tag == "header" and inside:
            return False
        return _marked(n) or (not inside or n.tag in _BOXES) and _named(n, _IN_ARTICLE if inside else _NAMES, root.size)

    todo: list = [(p, False) for p in reversed(root.parts)]
    while todo:
        p, inside = todo.pop()
        if p is None:
            flush()
            continue
        if not isinstance(p, Node):
            if inside or not articles:
                inline.append(html.unescape(p))
            continue
        if p.tag in _BLOCKS:
            flush()
        elif p.tag in ("br", "wbr"):
            inline.append(" " if p.tag == "br" else "")
        start = id(p) in own
        if not start and goes(p, inside):
            continue
        if p.tag in _BLOCKS:
            todo.append((None, inside))
        todo.extend((x, inside or start) for x in reversed(p.parts))
    flush()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """The host of an address in lower case, without port; an address without host is a site of its own."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), url, F.lit("")))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [subtrees(t.decode("utf-8", "replace")) for t in texts_of(b.column(2))]
        slots, hashes = ([[_signed(x[i]) for x in r] for _, r in rows] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_signed(c) for c, _ in rows], pa.int64()), pa.array(slots, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], ["page_key", "host", "content", "slots", "hashes"])


def templates(keyed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_key, recurring, rotating): the template slots of each page that has any. keyed: page_key, host, html."""
    trees = written(keyed.select("page_key", "host", "html").mapInArrow(_subtrees, "page_key long, host string, content long, slots array<long>, hashes array<long>"), "subtrees")
    each = trees.select("page_key", "host", "content", F.explode(F.arrays_zip("slots", "hashes")).alias("x")).select("page_key", "host", "content", F.col("x.slots").alias("slot"), F.col("x.hashes").alias("hash"))
    different = each.groupBy("host", "slot", "hash", "content").agg(F.lit(1))
    shown = written(different.groupBy("host", "slot", "hash", F.xxhash64("host", "slot", "hash")).agg(F.count("*").alias("n")).select("host", "slot", "hash", "n"), "shown")
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    slots = shown.groupBy("host", "slot").agg(again.alias("again"), F.sum("n").alias("all")).where((F.col("again") >= min_pages) & (F.col("again") >= min_share * F.col("all"))).select("host", "slot")
    judged = shown.join(slots, ["host", "slot"]).select("host", "slot", "hash", (F.col("n") >= min_pages).alias("recurs"))
    return each.select("page_key", "host", "slot", "hash").join(judged, ["host", "slot", "hash"]).groupBy("page_key").agg(F.collect_set(F.when(F.col("recurs"), F.col("slot"))).alias("recurring"), F.collect_set(F.when(~F.col("recurs"), F.col("slot"))).alias("rotating"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of each row, from the whole html.

    Null or empty html: an empty text. Null url: all such pages are one site. Repeated rows count as pages of their host and each get their text.
    Pages of any length or depth are read as a whole. An empty table gives an empty result. Columns besides page_id, url and html are not read.
    """
    small_batches(pages.sparkSession, 200)
    rows = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("page_key"), host(F.col("url")).alias("host"))
    found = templates(rows, min_pages, min_share)
    # repeated rows share a key and so their subtrees
    joined = packed(rows.select("page_id", "url", "html", "page_key"), "html").join(found, "page_key", "left").select("page_id", "url", "html", "recurring", "rotating")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = ({h & (1 << 64) - 1 for h in x or ()} for x in b.column(3).to_pylist()), ({h & (1 << 64) - 1 for h in x or ()} for x in b.column(4).to_pylist())
            text = [main_text((t or b"").decode("utf-8", "replace"), *slots) for t, *slots in zip(unpacked(b.column(2)), *known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
