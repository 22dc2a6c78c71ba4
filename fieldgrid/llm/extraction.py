"""Main text of web pages through wrappers inferred from pages of the same host.

A page is a stream of tokens: start tags with the roles that their attributes name, end tags and texts.  A wrapper is a
union-free regular expression over such streams: below each tag an ordered list of items, each of them one token kind,
optional (``?``) when some page lacks it, repeated (``+``) when some page has it more than once, and text that is
either the same everywhere or a slot.  Inference starts with the first page and aligns one stream after the other:

* text that differs becomes a slot;
* a tag that only one side has becomes optional;
* neighbours of one kind are one repeated item, merged with each other; kinds that come back after others, or in
  another order than elsewhere, form a repeated group of optional items.

Every task aligns its pages to one wrapper per host and sends only wrappers on, so a host with a third of all pages
costs one small row per task.  Wrappers of a host are then aligned with each other in two steps.  In the wrapper, a
region is template or content by the tags and roles on the way to it; text outside an article that all of several
pages share is template too.  Pages are cut by their wrapper to the texts in content slots.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SALTS = 64  # a host's wrappers are aligned in so many groups first
HELD = 2_000  # hosts a task keeps wrappers of before it sends them on
ENOUGH = 4  # pages that must share a text outside an article for it to be template
BROADCAST_BYTES = 32 << 20  # wrappers of all hosts up to this size are broadcast; beyond, pages meet them by a join

# HTML's elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "plaintext")
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "summary", "figcaption"}
_SAME_LEVEL = {  # a start tag closes an open one of these, up to the given container
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_OUT = frozenset(
    "nav footer aside form script style head title noscript template iframe select button input textarea label object svg canvas audio "
    "video menu dialog noembed noframes option fieldset datalist".split()
)
# Words in class, id and role attributes that name what is no article, or an article.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsbygoogle adslot adbox adunit banner sponsor sponsored promo "
    "promotion sidebar side-bar menu menubar nav navbar navigation topnav subnav topbar breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice notices alert announcement disclaimer copyright privacy popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended comment comments commentlist reply replies respond responses discussion feedback "
    "disqus footer header masthead form search toolbar widget complementary contentinfo pagination pager".split()
)
_IN_WORDS = frozenset("article content post entry story main".split())
# Of the former: regions whose articles are not the page's own; and words that say nothing before a content word, as in banner-story.
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
_REGIONS = _COMMENTS | frozenset(
    "menu menubar nav navbar navigation topnav subnav breadcrumb breadcrumbs related recommended footer complementary contentinfo".split()
)
_WEAK = frozenset("banner promo promotion sponsor sponsored notice notices alert announcement header masthead search privacy overlay widget".split())
_MODIFIERS = frozenset("no not non with without has have hide".split())  # what follows is a trait: no-sidebar, page-with-sidebar
_REOPENED = frozenset("form fieldset dialog".split())  # of _OUT, those that may hold the article
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_SIGNS = "+-*~="

_MARK = re.compile(r"<(?=[!?A-Za-z]|/[A-Za-z])")
_DECLARED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in _RAW}
_ONE_COMMENT = re.compile(r"(?:.*[^a-z])?(?:comment|reply)(?:[-_]?[0-9]+)?")
_WORD = re.compile(r"[^a-z0-9]+")


def _named(tag: str, name: str, value: str) -> str:
    """The sign that the words of one attribute give, the strongest of its parts."""
    found = set()
    for part in value.split():
        words = [w for w in _WORD.split(part) if w]
        trait = next((i for i, w in enumerate(words) if w in _MODIFIERS), None)
        if trait is not None:
            words = words[:trait]
        outs = _OUT_WORDS.intersection(words if trait is not None else (*words, part))
        if outs and words[-1] in _IN_WORDS and outs <= _WEAK:
            outs = frozenset()
        if not outs:
            if not _IN_WORDS.isdisjoint(words) or "articlebody" in words:
                found.add("*")
        elif tag in _TEXT or (tag == "section" and name == "id" and outs.isdisjoint(_COMMENTS)) or outs <= {"header", "masthead"}:
            found.add("=")
        elif not outs.isdisjoint(_REGIONS) or part in ("sidebar", "side-bar"):
            return "-"
        else:
            found.add("~")
    return next((x for x in "~*=" if x in found), "")


def _role(tag: str, text: str) -> str:
    """``-`` and ``~`` for elements that are no article by tag or attributes, ``+`` and ``*`` for those that hold one.

    An article below ``~`` is one all the same; ``=`` is for names that also occur inside articles, as of a heading, and
    is no sign there.
    """
    if tag in _OUT and tag not in _REOPENED:
        return "-"
    role = "+" if tag in ("article", "main") else "~" if tag in _REOPENED else ""
    if len(text) > len(tag) + 2:
        for name, a, b, c in _ATTRIBUTE.findall(text[len(tag) + 1 :].rstrip("/>")):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "class" and "hidden" in value.split()) or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return "-"
            if tag == "article" and name in ("class", "id", "itemprop") and any(map(_ONE_COMMENT.fullmatch, value.split())):
                return "-"
            if name in ("class", "id", "role", "itemprop") and tag not in ("html", "body", "article", "main"):
                sign = _named(tag, name, value)
                if sign == "-":
                    return "-"
                if role != "~" and sign and (sign == "~" or role != "*"):
                    role = sign
    return role


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("start", kind, tag)``, ``("end", tag, "")`` and ``("text", raw text, "")``; raw elements give nothing.

    Reads forward only.  A tag that the page ends in is dropped with what follows its name; one with a quote that never
    closes ends at the next ``>``.
    """
    at = 0
    while at < len(page):
        m = _MARK.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if page[m.end()] in "!?":
            at = _DECLARED.match(page, m.start()).end()
            continue
        end = _TAG.match(page, m.start()).end()
        if end < len(page) and page[end] != ">":
            end = page.find(">", end)
        if not 0 <= end < len(page):
            return
        at, text = end + 1, page[m.start() : end + 1]
        tag = _NAME.match(text).group(1).lower()
        if text.startswith("</"):
            yield "end", tag, ""
        elif tag in _RAW_END:
            at = max(_RAW_END[tag].search(page, at).end(), at)
        else:
            yield "start", tag + _role(tag, text), tag
            if tag not in _VOID and text.endswith("/>") and tag in ("svg", "path", "use"):
                yield "end", tag, ""


def tree(page: str) -> list:
    """Nested ``[kind, children]``; a text is ``["#", text]``.  End tags that HTML leaves out are put in.

    Pages nest without limit, so nothing here that reads a tree or a wrapper recurs.
    """
    root: list = ["", []]
    open_ = [("", root)]
    held = Counter()  # open elements of each tag

    def drop(i: int) -> None:
        held.subtract(tag for tag, _ in open_[i:])
        del open_[i:]

    def close(tags, stop) -> None:
        if not any(held[t] for t in tags):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in tags:
                return drop(i)
            if open_[i][0] in stop:
                return

    for what, kind, tag in tokens(page):
        if what == "text":
            open_[-1][1][1].append(["#", kind])
        elif what == "start":
            if tag in _ENDS_P:
                close({"p"}, {"button", "table", "td", "th", "caption", "object"})
            if tag in _SAME_LEVEL:
                same, stop = _SAME_LEVEL[tag]
                close(same, stop)
            node = [kind, []]
            open_[-1][1][1].append(node)
            if tag not in _VOID:
                open_.append((tag, node))
                held[tag] += 1
        elif held[kind]:
            drop(next(i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == kind))
    return root


class Item:
    """One item of a wrapper: how often it occurs, and its own items, or for text its value or None for a slot."""

    __slots__ = ("optional", "repeated", "items", "grouped", "value", "pages")

    def __init__(self, pages: int = 1):
        self.optional = self.repeated = self.grouped = False
        self.items: dict[str, Item] = {}
        self.value: int | None = None
        self.pages = pages


def stored(item: Item) -> bytes:
    """A wrapper as bytes, parents before their items."""
    queue, rows = [item], [("", 0, item.optional, item.repeated, item.grouped, item.value, item.pages)]
    for i, x in enumerate(queue):  # grows while it is read
        for kind, inner in x.items.items():
            queue.append(inner)
            rows.append((kind, i, inner.optional, inner.repeated, inner.grouped, inner.value, inner.pages))
    return pickle.dumps(rows)


def restored(data: bytes) -> Item:
    found: list[Item] = []
    for kind, parent, optional, repeated, grouped, value, pages in pickle.loads(data):
        x = Item(pages)
        x.optional, x.repeated, x.grouped, x.value = optional, repeated, grouped, value
        if found:
            found[parent].items[kind] = x
        found.append(x)
    return found[0]


def _code(text: str) -> int | None:
    words = " ".join(html.unescape(text).split())
    return zlib.crc32(words.encode("utf-8", "replace")) if words else None


def wrapper(node: list) -> Item:
    """The wrapper of one page: repeated neighbours are merged, kinds that come back are grouped."""

    def put(out: Item, kind: str, one: Item, last: str | None) -> None:
        if kind in out.items:
            if last != kind:
                out.grouped = True
            align(out.items[kind], one, again=True)
            out.items[kind].repeated = True
        else:
            out.items[kind] = one

    open_: list[list] = [["", Item(), iter(node[1]), None]]  # kind, item, children to come, kind of the last one
    while True:
        name, out, children, last = open_[-1]
        for kind, inner in children:
            if kind != "#":
                open_.append([kind, Item(), iter(inner), None])
                break
            code = _code(inner)
            if code is not None:
                one = Item()
                one.value = code
                put(out, kind, one, last)
                last = open_[-1][3] = kind
        else:
            open_.pop()
            if not open_:
                return out
            put(open_[-1][1], name, out, open_[-1][3])
            open_[-1][3] = name


def align(a: Item, b: Item, again: bool = False) -> None:
    """Align ``b`` to ``a`` in place; with ``again`` both come from one page."""
    pairs = [(a, b)]
    while pairs:
        a, b = pairs.pop()
        if a.value != b.value:
            a.value = None
        if not again:
            a.pages += b.pages
        a.repeated |= b.repeated
        a.optional |= b.optional
        a.grouped |= b.grouped
        theirs = [k for k in b.items if k in a.items]
        if [k for k in a.items if k in b.items] != theirs:
            a.grouped = True  # another order: only a repeated group of optional items reads both
        for kind, item in a.items.items():
            if kind not in b.items:
                item.optional = True
        for kind, item in b.items.items():
            if kind in a.items:
                pairs.append((a.items[kind], item))
            else:
                item.optional = True
                a.items[kind] = item


def written(item: Item) -> str:
    """The wrapper as a regular expression over tokens."""
    parts = []
    for kind, x in item.items.items():
        one = ("TEXT" if x.value is None else f"'{x.value:08x}'") if kind == "#" else f"<{kind}>{written(x)}</{kind}>"
        many = "+" if x.repeated and not item.grouped else ""
        maybe = "?" if x.optional or item.grouped else ""
        parts.append(f"({one}){many}{maybe}" if many or maybe else one)
    text = " ".join(parts)
    return f"({text})+" if item.grouped and text else text


def regions(item: Item) -> dict[str, tuple[str, dict]]:
    """For each kind below the root, its region and in turn those below it: ``in`` (an article), ``maybe`` (named like one), ``out`` (template), ``shut``
    (template, but an article below is ``in``), ``same`` (text that all pages share) or ``open``."""
    found: dict[str, tuple[str, dict]] = {}
    open_ = [(item, found, "open")]
    while open_:
        x, known, state = open_.pop()
        for kind, inner in x.items.items():
            here = state
            tag, sign = kind.rstrip(_SIGNS), kind[-1]
            if sign == "-" or state == "out":
                here = "out"
            elif sign == "~" or (tag == "header" and state != "in") or (sign == "=" and state not in ("in", "maybe")):
                here = "shut"
            elif sign == "+":
                here = "in"
            elif state == "open" and sign == "*":
                here = "maybe"
            elif kind == "#" and state in ("open", "maybe") and inner.value is not None and inner.pages == item.pages >= ENOUGH:
                here = "same"
            known[kind] = here, {}
            open_.append((inner, known[kind][1], here))
    return found


def headings(nodes: list) -> list:
    """The headings among some nodes and below them, in page order."""
    found, open_ = [], [iter(nodes)]
    while open_:
        node = next(open_[-1], None)
        if node is None:
            open_.pop()
        elif re.fullmatch("h[1-6]", node[0].rstrip(_SIGNS)):
            found.append(node)
        elif node[0] != "#":
            open_.append(iter(node[1]))
    return found


def main_text(page: str, ways: dict[str, tuple[str, dict]]) -> str:
    """Texts in content slots of the host's wrapper, block by block.

    Content is inside articles; in a page without one, inside elements named like one; without those, in all of the
    page that is no template.  Text that all pages of the host share counts as template only where something else is
    left: copies of one page share all of theirs.
    """
    blocks: dict[str, list[list[str]]] = {"in": [[]], "maybe": [[]], "open": [[]], "same": [[]]}

    open_ = [(iter(tree(page)[1]), ways, "open", False)]
    while open_:
        children, known, state, edge = open_[-1]
        for kind, inner in children:
            here, below = known.get(kind, (state, {}))
            if kind == "#":
                if here in blocks:
                    blocks[here][-1].append(inner)
                continue
            tag = kind.rstrip(_SIGNS)
            edge = tag in _BLOCK
            for b in blocks.values():
                if edge and b[-1]:
                    b.append([])
                elif tag == "br" and b[-1]:
                    b[-1].append(" ")
            if tag == "header" and here == "in":  # an article's own header: its headings only
                inner = headings(inner)
            open_.append((iter(inner), below, here, edge))
            break
        else:
            open_.pop()
            for b in blocks.values():
                if edge and b[-1]:
                    b.append([])
    for part in ("in", "maybe", "open", "same"):
        texts = [" ".join(html.unescape("".join(b)).split()) for b in blocks[part]]
        if any(texts):
            return "\n\n".join(t for t in texts if t)
    return ""


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, wrapper`` (a stored wrapper) for every host; pages with a null address share one."""

    def rows(held: dict[str, Item]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([stored(x) for x in held.values()], pa.binary())], names=["host", "wrapper"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Item] = {}
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = wrapper(tree(text.as_py() or ""))
                if host in held:
                    align(held[host], one)
                else:
                    held[host] = one
            if len(held) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        found = [restored(x) for x in sorted(frame["wrapper"])]
        for x in found[1:]:
            align(found[0], x)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [stored(found[0])]})

    one = pages.select(_host(F.col(url)).alias("host"), page).mapInArrow(infer, "host string, wrapper binary")
    salted = one.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    shape = "host string, wrapper binary"
    return salted.groupBy("host", "salt").applyInPandas(merge, shape).groupBy("host").applyInPandas(merge, shape)


def extract(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``, the main text of every row, empty when there is none.

    Whole pages are read; a null page has no text.  Character references are decoded, white space inside a block
    becomes one blank, blocks are joined by two line feeds.  Repeated rows are all kept; an input column named
    ``into`` is replaced.
    """
    known = cut(wrappers(pages, url, page))
    size = known.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    kept = [c for c in pages.columns if c != into]
    hosts = known.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    if size <= BROADCAST_BYTES:
        hosts = F.broadcast(hosts)
    rows = pages.select(*kept).withColumn("_host", _host(F.col(url))).join(hosts, "_host", "left").select(*kept, "_wrapper")
    place = kept.index(page)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[bytes, dict] = {}
        for batch in batches:
            out = []
            for text, known in zip(batch.column(place), batch.column(len(kept))):
                known = known.as_py() or b""
                if known not in ready:
                    if len(ready) > HELD:
                        ready.clear()
                    ready[known] = regions(restored(known)) if known else {}
                out.append(main_text(text.as_py() or "", ready[known]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(out, pa.string())], names=[*kept, into])

    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(into, T.StringType())])
    return rows.mapInArrow(task, schema)


def report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
