"""HTML extraction by composite text density.

For each element: characters, characters in links, tags and link tags under it. Its density is the
characters per tag, adjusted by the share of links (composite text density); its sum is the sum of the densities of
its block children (what is inline is part of its block). Of the elements denser than the body, which is what a path to
the body has at least, the one with the largest sum is the core of the text, whatever its name (of equal sums an
``article`` or ``main``); it is the body itself where what the body holds beside it has a larger sum. Beside the path from
the core to the body a block stays if it is as dense as the least dense element of the path (the body-path threshold) and is a
text by itself: it holds a heading, or its sum is at least ``SHARE`` of the core's. An ``article`` or ``main`` stays, and a heading beside
the path, with what lies between it and the path. Other blocks go, and bare links between blocks. Menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles are cut before densities are computed, by
element, role, and words of class and id; a form or such a word does not cut an element that holds a heading or article, and most of the page's text.
Pages are parsed in linear time, however deep.

Defined results: null, empty and text-free pages give an empty text; unclosed elements end where
HTML's rules end them or with the page; an unclosed comment, script or style runs to the end;
repeated rows and ids have a row each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import arrow_schema, chunks, record_batch, table

_token = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_named = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_words = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CUT = frozenset("nav header footer aside form script style button select option textarea input label fieldset noscript iframe template head title object svg math canvas audio video dialog menu xmp noembed noframes".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
CUT_WORDS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation topnav breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What a start tag closes, and the elements that stop the search for it.
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset(["table", "td", "th", "button", "caption", "object", "html"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Share of the core's density sum from which a block beside its path is a text by itself.
SHARE = 0.25


class Dom:
    """Elements in page order as columns; ``parts`` holds (element, text) and (element, None) at block edges."""

    def __init__(self, text: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.parts: list[tuple[int, str | None]] = []
        self._read(text)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        if tag in BLOCK:
            self.parts.append((len(self.tag) - 1, None))
        return len(self.tag) - 1

    def _close(self, stack: list[int], at: dict[str, list[int]], depth: int) -> None:
        while len(stack) > depth:
            tag = self.tag[stack.pop()]
            at[tag].pop()
            if tag in BLOCK:
                at["block"].pop()
                self.parts.append((stack[-1], None))

    def _read(self, text: str) -> None:
        stack, size = [0], len(text)
        # where in the stack the open elements of each name stand, and all block elements
        open_: defaultdict[str, list[int]] = defaultdict(list)

        def nearest(names: frozenset[str]) -> int:
            return max((open_[x][-1] for x in names if open_.get(x)), default=0)

        at = 0
        while at < size:
            m = _token.search(text, at)
            if not m:
                self.parts.append((stack[-1], text[at:]))
                break
            if m.start() > at:
                self.parts.append((stack[-1], text[at : m.start()]))
            at = m.end()
            closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if closing:
                # an inline end tag doesn't close a block
                if open_.get(name) and (name in BLOCK or open_[name][-1] > (open_["block"] or [0])[-1]):
                    self._close(stack, open_, open_[name][-1])
                continue
            if name in _CLOSES_P and open_.get("p") and open_["p"][-1] > nearest(_SCOPE):
                self._close(stack, open_, open_["p"][-1])
            if (rule := _CLOSES.get(name)) and (near := nearest(rule[0])) > nearest(rule[1]):
                self._close(stack, open_, near)
            node = self._open(name, attrs, stack[-1])
            if name in VOID:
                if name == "br":
                    self.parts.append((stack[-1], " "))
            elif name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = stop.end() if stop else size
            elif not attrs.endswith("/") or name in BLOCK:
                open_[name].append(len(stack))
                if name in BLOCK:
                    open_["block"].append(len(stack))
                stack.append(node)

    def cut(self, texts: list[str]) -> list[bool]:
        """Whether each element is, or lies in, what is no main text; ``texts`` are those of ``parts``.

        A form, and a class, id or role word, doesn't cut an element that holds a heading (or article) and most of the page's text.
        """
        n = len(self.tag)
        heads, whole, menus = [False] * n, [False] * n, [False] * n  # a heading inside; that or an article; a menu right below
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            heads[p] |= heads[i] or self.tag[i] in _HEADINGS
            whole[p] |= whole[i] or heads[p] or self.tag[i] in ("article", "main")
            menus[p] |= self.tag[i] == "nav"
        hard, form = [False] * n, [False] * n
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            # a header below the body's level that holds a heading, and no menu beside it, is the head of a text
            head = tag == "header" and heads[i] and not menus[i] and not menus[p] and self.tag[p] not in ("body", "html", "#root")
            hard[i] = hard[p] or tag in CUT and tag != "form" and not head
            form[i] = tag == "form"
        chars = [0] * n
        for (node, _), text in zip(self.parts, texts, strict=True):
            if not hard[node]:
                chars[node] += len(text)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        out = [False] * n
        for i in range(1, n):
            most = whole[i] and 2 * chars[i] > chars[0]
            out[i] = hard[i] or out[self.parent[i]] or form[i] and not most
            if not out[i] and self.attrs[i] and self.tag[i] not in ("html", "body", "article", "main"):
                for m in _named.finditer(self.attrs[i]):
                    value = (m[2] or m[3] or m[4] or "").lower()
                    found = [value] if m[1].lower() == "role" else _words.findall(value)
                    if not most and not (CUT_ROLES if m[1].lower() == "role" else CUT_WORDS).isdisjoint(found):
                        out[i] = True
                        break
        return out


def densities(dom: Dom, out: list[bool], texts: list[str]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite density, density sum, characters and characters in links of each element."""
    n = len(dom.tag)
    link = [False] * n
    for i in range(1, n):
        link[i] = dom.tag[i] == "a" or link[dom.parent[i]]
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    for (node, _), text in zip(dom.parts, texts, strict=True):
        if text and not out[node] and (k := len(text)):
            chars[node] += k
            if link[node]:
                linked[node] += k
    for i in range(n - 1, 0, -1):
        if out[i]:
            continue
        p = dom.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i] + 1
        links[p] += links[i] + (dom.tag[i] == "a")
    body = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    share = linked[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not out[i]:
            t, lt, lc = max(tags[i], 1), max(links[i], 1), max(linked[i], 1)
            base = math.log(chars[i] / max(chars[i] - linked[i], 1) * linked[i] + share * chars[i] + math.e)
            density[i] = chars[i] / t * max(math.log(max(chars[i] / lc * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else math.log(max(chars[i] / lc * t / lt, 1.0)), 0.0)
        if i:
            total[dom.parent[i]] += density[i]
    return density, total, chars, linked


def main_nodes(dom: Dom, out: list[bool], texts: list[str]) -> tuple[int, list[bool], list[bool]]:
    """The element under which the main text lies, the elements under it that are no part of it, and those whose text stands loose between blocks."""
    n = len(dom.tag)
    density, total, chars, linked = densities(dom, out, texts)
    for i in range(1, n):  # an inline child is part of its block
        if dom.tag[i] not in BLOCK:
            total[dom.parent[i]] -= density[i]
    body = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    # of equal sums an article or main, then the first
    worth = lambda i: (total[i], dom.tag[i] in ("article", "main"), -i)
    core = max((i for i in range(n) if total[i] > 1e-9 and density[i] > density[body] and dom.tag[i] not in ("body", "html", "#root")), key=worth, default=body)
    path = [core]
    while dom.parent[path[-1]] >= 0:
        path.append(dom.parent[path[-1]])
    if core != body and body in path and total[body] - density[path[path.index(body) - 1]] > total[core]:
        core, path = body, path[path.index(body) :]
    path = path[: path.index(body) + 1] if body in path else path
    least = min(density[i] for i in path)
    on, above = set(path), set(path[1:] if core != body else path)
    heads = [dom.tag[i] in _HEADINGS and not out[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        heads[dom.parent[i]] |= heads[i]
    left, loose = [False] * n, [i in above for i in range(n)]
    first: dict[int, int] = {}  # a path element's child on the path
    for i in path[:-1]:
        first[dom.parent[i]] = i
    headed: set[int] = set()  # path elements of which a heading has been met before the path
    for i in range(1, n):
        p = dom.parent[i]
        if i in on:
            continue
        if p not in above:
            left[i], loose[i] = left[p], loose[p]
        elif dom.tag[i] not in BLOCK:
            loose[i] = True  # judged with the text that it stands in
        elif 2 * linked[i] > chars[i] and (density[i] < least or density[i] == 0):
            left[i] = True
        elif p not in first:
            left[i] = False  # the body is the core
        elif dom.tag[i] in _HEADINGS:
            headed.add(p)
        else:
            between = p in headed and i < first[p]
            own = heads[i] or total[i] >= SHARE * total[core]
            left[i] = not (between or dom.tag[i] in ("article", "main") or own and density[i] >= least)
    return path[-1], left, loose


def extract(page: str | None) -> str:
    """The main text: blocks in page order, one a line."""
    if not page:
        return ""
    dom = Dom(page)
    texts = ["" if t is None else _html.unescape(t) if "&" in t else t for _, t in dom.parts]
    measured = [" ".join(t.split()) for t in texts]
    out = dom.cut(measured)
    top, left, loose = main_nodes(dom, out, measured)
    under, link = [False] * len(dom.tag), [False] * len(dom.tag)
    under[top] = True
    for i in range(1, len(under)):
        under[i] |= under[dom.parent[i]]
        link[i] = dom.tag[i] == "a" or link[dom.parent[i]]
    blocks, held = [], []

    def flush() -> None:
        # a menu of bare links between blocks
        if not all(loose[i] for i, _, _ in held) or 2 * sum(k for i, _, k in held if link[i]) <= sum(k for _, _, k in held):
            blocks.append("".join(t for _, t, _ in held))
        held.clear()

    for (node, raw), text, short in zip(dom.parts, texts, measured, strict=True):
        if raw is None:
            if held:
                flush()
        elif under[node] and not out[node] and not left[node]:
            held.append((node, text, len(short)))
    flush()
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


OUT = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(OUT)
    for batch in chunks(batches, "html"):
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield record_batch(list(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), texts, map(len, texts), strict=True)), schema)


def extracted(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extracted, OUT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
