"""Main text of web pages by consensus host paths.

1. Each page is parsed and votes for the smallest container that holds all of its
   text outside boilerplate, though for nothing inside an article or main element.
   A vote counts by its share of the page's text, links counting against it.
2. Votes are summed per host over generalised tag-class paths (digits cut out).
3. Every page is extracted again from its host's winning path: all containers of
   that path, and the text around them up to other div elements, which the host's
   pages leave out.  A page without that path uses its own vote.

Left out everywhere: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers and of the markup.  Outside the container,
text that is mostly links is taken for a menu, unless it is a heading or paragraph.

Defined results: null and empty html give an empty text; a page without a
container gives its body's text; a null or relative url has the host ''; repeated
rows give equal rows; an empty table gives an empty result.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import textvec as tv

# Element names of the HTML standard.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("aside button canvas datalist dialog fieldset footer form header menu nav object select video audio head".split())
# Class, id and role words of boilerplate.
_BOILER = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: What may stand beside a boilerplate word in a class name; other words make another name of it ("share-price").
_PLACES = frozenset("area bar block body bottom box btn button buttons col column container content entry fixed global group inner item items left link links list main middle module outer page panel post primary right row secondary section site slot sticky sub text title top unit wrap wrapper".split())
#: Elements whose links are text like any other.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote dd dt figcaption".split())
_CLOSES_P = _BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dt dd", ("dl",)), "dt": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    path: str
    parent: int
    skip: bool
    name: str
    text: int = 0
    links: int = 0


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(source)} if source.strip(" /\n\t\r") else {}


def _boilerplate(name: str, attributes: dict[str, str]) -> bool:
    if name in _SKIP:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return any(_names_boilerplate(token) for k in ("class", "id", "role") for token in attributes.get(k, "").lower().split())


@lru_cache(100_000)
def _names_boilerplate(token: str) -> bool:
    words = _WORD.findall(token)
    return any(w in _BOILER for w in words) and all(w in _BOILER or w in _PLACES for w in words)


def _step(name: str, attributes: dict[str, str]) -> str:
    """A container's name in a path: its tag and classes, without digits."""
    classes = sorted({re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split()} - {""})
    return ".".join([name, *classes])


#: Characters of a path; of a longer one a hash stands for the beginning, so that deep nesting stays linear.
_PATH = 2_000


def _path(parent: str, step: str) -> str:
    return f"{parent}/{step}" if len(parent) < _PATH else f"#{hashlib.sha256(parent.encode()).hexdigest()[:24]}/{step}"


class Page:
    """One pass over a page: containers with what they hold, and blocks of text with their container."""

    def __init__(self, source: str):
        self.nodes = [Node("", -1, False, "")]
        self.blocks: list[tuple[int, str]] = []
        self._stack = [0]
        self._where: dict[str, list[int]] = {}  # places in the stack by name
        self._buffer: list[str] = []
        self._skipped: list[str] = []  # open inline elements of boilerplate
        self._link = 0
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            if text:
                at = self._stack[-1]
                self.blocks.append((at, text))
                node = self.nodes[at]
                node.text += len(text)
                node.links += min(self._linked, len(text))
            self._buffer = []
        self._linked = 0

    def _say(self, text: str) -> None:
        if not self._skipped and not self.nodes[self._stack[-1]].skip:
            self._buffer.append(text)
            if self._link:
                self._linked += len(text.strip())

    def _open(self, name: str, attributes: dict[str, str]) -> None:
        self._flush()
        if name in _CLOSES_P:
            self._close("p", ("td", "th", "table", "body"))
        if name in _SAME:
            names, until = _SAME[name]
            for other in names.split():
                self._close(other, until)
        up = self._stack[-1]
        parent = self.nodes[up]
        path = _path(parent.path, _step(name, attributes)) if name in _CONTAINERS else parent.path
        self.nodes.append(Node(path, up, parent.skip or _boilerplate(name, attributes), name))
        if name != "hr":
            self._where.setdefault(name, []).append(len(self._stack))
            self._stack.append(len(self.nodes) - 1)

    def _close(self, name: str, until: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of this name and all in it, unless one of `until` stands in between."""
        at = self._where.get(name)
        if not at or any(self._where.get(other, [0])[-1:] > at[-1:] for other in until):
            return
        self._flush()
        to = at[-1]
        while len(self._stack) > to:
            self._where[self.nodes[self._stack.pop()].name].pop()
        self._skipped.clear()

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1  # beyond the last > there are no tags to look for
        while m := _TAG.search(source, at, last):
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(source)
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing = (m[1] or m[4]) == "/"
            if closing:
                if name in _BLOCKS or name in _SKIP:
                    self._flush()
                    self._close(name)
                elif self._skipped and self._skipped[-1] == name:
                    self._skipped.pop()
                elif name == "a":
                    self._link = max(0, self._link - 1)
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "br":
                self._say(" ")
                continue
            if name in _VOID and name != "hr":
                continue
            attributes = _attributes(m[3] or m[6] or "")
            if name in _BLOCKS or name in _SKIP:
                self._open(name, attributes)
            elif self._skipped:
                if self._skipped[-1] == name:
                    self._skipped.append(name)
            elif _boilerplate(name, attributes):
                self._skipped.append(name)
            elif name == "a":
                self._link += 1
        if at < len(source):
            self._say(source[at:].split("<!--")[0])
        self._flush()

    def masses(self) -> list[float]:
        """What each element's subtree holds: characters of text, those in links counting thrice against it."""
        out = [max(0.0, n.text - 3.0 * n.links) for n in self.nodes]
        for i in range(len(out) - 1, 0, -1):
            out[self.nodes[i].parent] += out[i]
        return out

    def _real(self) -> list[int]:
        """Characters of each element's own text, none where it is a menu."""
        return [n.text if n.name in _PROSE or 2 * n.links < n.text else 0 for n in self.nodes]

    def _held(self) -> list[int]:
        """Characters of text outside menus in each element's subtree."""
        out = self._real()
        for i in range(len(out) - 1, 0, -1):
            out[self.nodes[i].parent] += out[i]
        return out

    def vote(self) -> tuple[int, float]:
        """The smallest container with all of the page's text, and its share by mass."""
        held = self._held()
        at = chosen = 0
        for i in range(1, len(self.nodes)):
            if self.nodes[at].name in ("article", "main"):
                break
            if self.nodes[i].parent == at and held[i] and held[i] == held[at]:
                at = i
                if self.nodes[i].name in _CONTAINERS:
                    chosen = i
        mass = self.masses()
        return chosen, mass[chosen] / mass[0] if mass[0] else 0.0

    def text(self, container: int) -> str:
        inside = {container}
        for i in range(container + 1, len(self.nodes)):
            if self.nodes[i].parent in inside:
                inside.add(i)
        return "\n".join(t for at, t in self.blocks if at in inside)

    def text_by(self, path: str) -> str | None:
        """The text of all containers of this path, and what stands around them outside other div elements; None if there is none with text."""
        held = None
        inside: set[int] = set()
        for i, n in enumerate(self.nodes):
            if n.path == path and n.name in _CONTAINERS and not n.skip:
                held = held or self._held()
                if held[i]:
                    inside.add(i)
        if not inside:
            return None
        around = set()
        for i in inside:
            while (i := self.nodes[i].parent) >= 0 and i not in around:
                around.add(i)
        for i, n in enumerate(self.nodes):
            if n.parent in inside:
                inside.add(i)
            elif n.parent in around and i not in inside and n.name not in ("div", "center"):
                around.add(i)
        real = self._real()
        return "\n".join(t for at, t in self.blocks if at in inside or (at in around and real[at]))


def host(url: str | Column = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url) if isinstance(url, str) else url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]*)", 1), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.sliced(batches):
        total: dict[tuple[str, str], float] = {}
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            at, share = page.vote()
            if at:
                key = (name, page.nodes[at].path)
                total[key] = total.get(key, 0.0) + share
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.float64())], ["host", "path", "votes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.sliced(batches, 2):
        texts, used = [], []
        for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = Page(source or "")
            text = page.text_by(path) if path else None
            if text is None:
                at, _ = page.vote()
                text, path = page.text(at), page.nodes[at].path
            texts.append(text)
            used.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], ["id", "url", "text", "n_chars", "path"])


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the path with most votes of each host; ties go to the first path by name."""
    votes = pages.select(host(url_col).alias("host"), F.col(html_col).alias("h")).mapInArrow(_votes, "host string, path string, votes double")
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """One row per page: id, url, text, n_chars (code points), path (the container it came from).

    Winning paths are broadcast up to `broadcast_hosts` hosts (some 100 bytes each) and joined by a shuffle beyond.
    """
    winners = scratch.keep(consensus(pages, url_col, html_col)).withColumnRenamed("host", "of_host")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"), host(url_col).alias("host"))
    out = own.join(winners, F.col("host") == F.col("of_host"), "left").select("id", "url", "h", "path").mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long, path string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
