"""HTML extraction by consensus host paths.

Pass 1 parses each page, scores its containers by the prose in them and names the best one's generalised
tag-class path; Spark sums the votes per host and path, and finds the blocks that a host repeats on pages of
different content.  Pass 2 parses again and takes the text of the elements on the host's winning path and of the
prose next to them, or of the page's own best container where that path is missing or holds a small part of the
page's sentences only.

Containers are noise if a tag, role or attribute says so, or by votes: its name, its share of links and of the
page's text, what its text says, and whether the host repeats it.  No single doubtful sign suffices, and signs
by name are dropped where they would leave no text.  Work is linear in the page: paths are numbers, and what a
container holds is a difference of prefix sums over the blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Up to so many hosts, the table of winning paths goes to all workers; a larger one is joined by shuffles.
HOSTS = 20_000

#: The winning path gives way to the page's own best container if it holds less than this of that one's sentences.
STUB = 0.25
#: Links' most share of a neighbour's text.
LINKED = 0.3
#: A container with less than this of the page's text is short.
SHORT = 0.2
#: A host repeats a block if so many pages of different content have it, and this share of the host's.
REPEATED, REPEATED_SHARE = 3, 0.2
#: Text outside of a repeated container without which that is taken for the page's own.
OWN_TEXT = 100

_SENTENCE = re.compile(r"""[.!?\u2026\u061f\u06d4\u0964]["'\u201d\u2019\u00bb)\]]*(?:\s|\Z)|[\u3002\uff01\uff1f]""")
_HEADINGS = {"h1", "h2"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*'|<)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?].*\Z", re.S)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.I) for tag in _RAW}
_SKIP = {"nav", "aside", "footer", "form", "noscript", "template", "svg", "select", "button", "dialog", "menu", "object", "canvas", "audio", "video", "datalist", "fieldset", "head", "math"}
_CONTAINERS = {"body", "main", "article", "section", "div", "td", "center", "blockquote", "figure", "header", "layer"}
_BLOCKS = _CONTAINERS | _SKIP | {
    "html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "table", "tr", "th", "tbody", "thead", "tfoot",
    "caption", "hr", "br", "address", "details", "summary", "figcaption", "hgroup", "search",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs"
    " comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social"
    " related recommended recommendations widget pagination pager footer masthead topbar toolbar skip legal copyright login signup search tags toc".split()
)
_NOISE_TOKENS = frozenset(("side-bar", "site-header"))
#: A name with one of these tells how its element is laid out, not what it is.
_MODIFIERS = frozenset("has have no not non with without is hide hides hidden show shows one two open opened closed enabled disabled active layout free less off on full column columns grid results".split())
#: What a name may end in and still name the same thing.
_WRAPPERS = frozenset("wrapper wrap container inner outer box block area list section left right top bottom item items row".split())
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_ENDS_P = _BLOCKS - {"br"}


#: What comments, and notices and adverts, say of themselves.
_COMMENT = re.compile(r"(?:reply|replies|re:|comments?|responses?)\b|(?:\S+ ){1,4}(?:says|said|wrote|writes|commented|replied)\s*[:.,]")
_NOTICE = ("cookie", "consent to", "privacy policy", "terms of use", "terms of service", "subscribe", "newsletter", "sign up", "all rights reserved", "\u00a9", "advertisement", "sponsored", "accept all")
_TITLES = re.compile(r"(?:\d+ )?(?:comments?|replies|responses?|reader comments?|leave a (?:reply|comment)|related(?: \w+)?|advertisement|newsletter)\W*(?:\d+\W*)?")


#: (container, text, characters in links, is a headline)
Block = tuple["Node", str, int, bool]


class Node:
    __slots__ = ("container", "end", "holder", "names", "noise", "parent", "path", "prose", "start", "tag")

    def __init__(self, tag, path, parent, noise, container, names, start):
        self.tag, self.path, self.parent, self.noise, self.container, self.names, self.start = tag, path, parent, noise, container, names, start
        self.holder = self if container else parent.holder  # the nearest container
        self.end, self.prose = start, 0.0


class Page:
    """Nodes and blocks in page order; a path is a number, of its parent's and a label."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = []
        self.body = Node("body", self.number(-1, "body"), None, False, True, "", 0)
        self.nodes, self.blocks = [self.body], []

    def number(self, parent: int, label: str) -> int:
        found = self.numbers.setdefault((parent, label), len(self.labels))
        if found == len(self.labels):
            self.labels.append((parent, label))
        return found

    def spelled(self, path: int) -> str:
        out = []
        while path >= 0:
            path, label = self.labels[path]
            out.append(label)
        return "/".join(reversed(out))

    def find(self, spelled: str) -> int | None:
        """The number of a path; None if the page lacks it."""
        at = -1
        for label in spelled.split("/"):
            at = self.numbers.get((at, label))
            if at is None:
                return None
        return at


def attributes(rest: str) -> dict[str, str]:
    """A tag's attributes by lower-cased name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), values[0] or values[1] or values[2])
    return out


def noisy(names: str) -> int:
    """2 if a class or id names noise, 1 if only its first or last part does; a part that makes it a layout modifier undoes that."""
    most = 0
    for token in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        if token in _NOISE_TOKENS:
            return 2
        if not parts or not _MODIFIERS.isdisjoint(parts):
            continue
        while len(parts) > 1 and (parts[-1] in _WRAPPERS or parts[-1].isdigit()):
            parts.pop()
        if _NOISE.issuperset(parts):
            return 2
        if parts[0] in _NOISE or parts[-1] in _NOISE:
            most = 1
    return most


def hashed(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def parse(html: str, by_name: bool = True, common: frozenset[int] = frozenset()) -> Page:
    """by_name: classes and ids vote for noise; common: hashes of the blocks that the host repeats."""
    page = Page()
    nodes, blocks, buffer = page.nodes, page.blocks, []
    stack, open_tags, lists = [page.body], Counter(), []  # lists: the places of ul, ol and li in the stack
    links = anchors = 0
    place = 0
    headline = False

    def flush() -> None:
        nonlocal links, headline
        if buffer:
            text = " ".join("".join(buffer).split())
            if text and not stack[-1].noise:
                blocks.append((stack[-1], text, links, headline))
            buffer.clear()
        links = 0
        headline = False

    def say(text: str) -> None:
        nonlocal links
        if text and not stack[-1].noise:
            text = unescape(text)
            buffer.append(text)
            if anchors:
                links += len(text.strip())

    def leave(k: int) -> None:
        """Close the open elements from place k on."""
        while len(stack) > k:
            node = stack.pop()
            node.end = len(blocks)
            open_tags[node.tag] -= 1
        while lists and lists[-1] >= k:
            lists.pop()

    while (m := _TAG.search(html, place)) is not None:
        say(html[place : m.start()])
        place = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag not in _BLOCKS and tag not in _RAW:
            continue
        if tag in _RAW:
            if not closing:
                place = _RAW_END[tag].search(html, place).end()
            continue
        flush()
        headline = not closing and tag in _HEADINGS
        if tag in _VOID or tag in ("html",):
            continue
        if closing:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                leave(k)
                anchors = 0
            continue
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag == "head":
                leave(len(stack) - 1)
            continue
        if tag in _ENDS_P and stack[-1].tag == "p":
            leave(len(stack) - 1)
        if tag == "li" and lists and stack[lists[-1]].tag == "li":
            leave(lists[-1])
        if tag not in _CONTAINERS and tag not in _SKIP and tag not in ("p", "ul", "ol", "li", "table", "tr", "dl"):
            continue
        marks = attributes(rest) if rest.strip() else {}
        up = stack[-1]
        noise = up.noise or tag in _SKIP or "hidden" in marks or marks.get("role", "").lower() in _NOISE_ROLES
        noise = noise or re.search(r"display\s*:\s*none", marks.get("style", "")) is not None
        if not noise and tag == "header":
            noise = not (open_tags["article"] or open_tags["main"])
        path = up.path
        if tag in _CONTAINERS:
            first = marks.get("class", "").split()[:1]
            path = page.number(path, tag + ("." + re.sub(r"[\d/]+", "N", first[0].lower()) if first else ""))
        node = Node(tag, path, up, noise, tag in _CONTAINERS, f"{marks.get('class', '')} {marks.get('id', '')}".strip(), len(blocks))
        nodes.append(node)
        if tag in ("ul", "ol", "li"):
            lists.append(len(stack))
        stack.append(node)
        open_tags[tag] += 1
    say(_OPEN_TAG.sub("", html[place:]))
    flush()
    leave(0)
    _vote_noise(page, by_name, common)
    page.blocks = [b for b in blocks if not b[0].noise]
    return page


def _vote_noise(page: Page, by_name: bool, common: frozenset[int]) -> None:
    blocks = page.blocks
    sums = lambda values: [0, *accumulate(values)]
    size, linked = sums(len(b[1]) for b in blocks), sums(b[2] for b in blocks)
    again = sums(len(b[1]) if common and hashed(b[1]) in common else 0 for b in blocks)
    low = [b[1].lower() for b in blocks]
    notices, words = sums(sum(x.count(term) for term in _NOTICE) for x in low), sums(x.count(" ") + 1 for x in low)
    opens = [bool(_COMMENT.match(x)) for x in low]
    alike = Counter(n.path for n in page.nodes if n.container and n.start < n.end and opens[n.start])
    whole, own = size[-1], size[-1] - again[-1]
    for node in page.nodes:
        up = node.parent
        if up is None:
            continue
        if node.noise or up.noise:
            node.noise = True
            continue
        a, b = node.start, node.end
        if a == b or node.tag in ("article", "main"):
            continue
        here = size[b] - size[a]
        votes = noisy(node.names) if by_name and node.names else 0
        if node.container:
            votes += linked[b] - linked[a] > 0.5 * here
            said = notices[b] - notices[a]
            votes += 2 if said > 1 and said >= 0.03 * (words[b] - words[a]) else said > 0
            if opens[a]:
                votes += 1 + (alike[node.path] > 1)
            if _TITLES.fullmatch(low[a]) and b - a > 1:
                votes += 2
            if again[b] - again[a] >= 0.8 * here and own - (here - (again[b] - again[a])) >= OWN_TEXT:
                votes += 2
            if votes == 1 and here < SHORT * whole:
                votes += 1
        node.noise = votes >= 2


def best_path(page: Page) -> tuple[str, float]:
    """Path and score of the container with most prose: its own blocks count in full, each level below a fifth less."""
    for node, text, links, _ in page.blocks:
        node.holder.prose += max(0, len(text) - 2 * links)
    for node in reversed(page.nodes):
        if node.container and node.parent is not None:
            node.parent.holder.prose += 0.8 * node.prose
    best, score = None, 0.0
    for node in page.nodes:
        value = node.prose * {"article": 1.5, "main": 1.25, "body": 0.75}.get(node.tag, 1.0)
        if node.container and not node.noise and value > score:
            best, score = node.path, value
    return "" if best is None else page.spelled(best), score


def read_page(html: str, common: frozenset[int] = frozenset()) -> tuple[Page, str]:
    """The page and its best path; where names of noise leave no text, without regard to them."""
    for by_name in (True, False):
        page = parse(html, by_name, common)
        best, _ = best_path(page)
        if best:
            break
    return page, best


def neighbours(page: Page, chosen: set[int], under: dict[int, Node | None]) -> set[int]:
    """Containers beside the chosen ones that hold sentences, or the headline where the chosen have none, and few links.

    Beside an article or main element nothing is taken: the page says itself where its text ends.
    """
    parents = {id(n.parent) for n in page.nodes if id(n) in chosen and n.parent is not None and n.tag not in ("article", "main")}
    beside = {id(n): [0, 0, 0, 0] for n in page.nodes if n.container and id(n.parent) in parents and id(n) not in chosen and not n.noise}
    if not beside:
        return set()
    of = _under(page, set(beside))
    headed = False
    for node, text, links, headline in page.blocks:
        if under[id(node)] is not None:
            headed |= headline
        elif (at := of[id(node)]) is not None:
            sums = beside[id(at)]
            for k, x in enumerate((len(text), links, _SENTENCE.search(text) is not None, headline)):
                sums[k] += x
    return {i for i, (size, links, sentences, headlines) in beside.items() if links < LINKED * size and (sentences or headlines and not headed)}


def _under(page: Page, chosen: set[int]) -> dict[int, Node | None]:
    """For each node the nearest of `chosen` that holds it, itself included."""
    out: dict[int, Node | None] = {}
    for n in page.nodes:
        out[id(n)] = n if id(n) in chosen else out[id(n.parent)] if n.parent is not None else None
    return out


def text_of(html: str, path: str, common: Iterable[int] = ()) -> str:
    """Text of the elements on the path and of their neighbours, or so of the page's own best container."""
    page, best = read_page(html, frozenset(common))

    def on(path: str) -> set[int]:
        number = page.find(path) if path else None
        return {id(n) for n in page.nodes if n.container and n.path == number and not n.noise}

    def said(under) -> int:
        return sum(max(0, len(text) - 2 * links) for node, text, links, _ in page.blocks if under[id(node)] is not None and _SENTENCE.search(text))

    chosen = on(path)
    under = _under(page, chosen)
    if path != best:
        other = on(best)
        beneath = _under(page, other)
        if not any(under[id(b[0])] is not None for b in page.blocks) or said(under) < STUB * said(beneath):
            chosen, under = other, beneath
    if more := neighbours(page, chosen, under):
        under = _under(page, chosen | more)
    return " ".join(text for node, text, _, _ in page.blocks if under[id(node)] is not None)


def _text(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, content, blocks): the best path, a hash of all blocks, and the distinct blocks' hashes."""
    for batch in batches:
        paths, contents, parts = [], [], []
        for html in _text(batch, "html"):
            page, best = read_page(html)
            hashes = [hashed(b[1]) for b in page.blocks]
            paths.append(best)
            contents.append(hashed(" ".join(map(str, hashes))))
            parts.append(sorted(set(hashes)))
        columns = [pa.array(_text(batch, "host")), pa.array(paths, pa.string()), pa.array(contents, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "content", "blocks"])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [x or () for x in batch.column(batch.schema.get_field_index("common")).to_pylist()]
        found = [text_of(h, p, c) for h, p, c in zip(_text(batch, "html"), _text(batch, "path"), common, strict=True)]
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def consensus(pages: DataFrame) -> DataFrame:
    """(won_host, path, common): of a host's paths the one with most votes, ties to the path first in order, and the blocks that it repeats.

    Pages of equal content count once for what is repeated, so an article that many pages copy isn't.
    """
    seen = cut(pages.select("host", "html").mapInArrow(_vote, "host string, path string, content long, blocks array<long>"))
    votes = seen.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    first = votes.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("best"))
    contents = seen.groupBy("host", "content").agg(F.first("blocks").alias("blocks"))
    sizes = contents.groupBy("host").agg(F.count("*").alias("all"))
    often = contents.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    # of a host at most its blocks a page over REPEATED_SHARE
    common = often.join(sizes, "host").where(F.col("n") >= REPEATED_SHARE * F.col("all")).groupBy("host").agg(F.array_sort(F.collect_list("block")).alias("common"))
    return first.join(common, "host", "left").select(F.col("host").alias("won_host"), F.col("best.path").alias("path"), "common")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages (page_id, url, html).

    A null html is empty, and an empty one gives an empty text; pages without a host (null or odd urls) vote
    as one host.  Repeated rows come out repeated and vote as often.  Other columns are not read.  An empty table
    gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    winners = cut(consensus(rows))
    small = winners.limit(HOSTS + 1).count() <= HOSTS
    met = rows.join(F.broadcast(winners) if small else winners, F.col("host") == F.col("won_host"), "left")
    return met.select("page_id", "url", "html", "path", "common").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
