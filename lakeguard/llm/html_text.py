"""Main text of web pages by site style trees.

Every page is read into blocks of text, each under a path of elements (tag with
its class or id).  The pages of a host are merged into one style tree.  A node of
it has two importances, both entropies over the host's different pages, from 0
(all pages alike) to 1 (all pages different): that of its contents, the texts
below it, and that of its presentation, the elements in it and their order.
Their weighted mean is the node's importance; the fewer pages have the node, the
nearer it is taken to 1.  Elements of one name are also judged by their place in the
sequence of their parent's elements, from either end, so that a line that every
page begins or ends with is told from its neighbours.  Branches of low importance
are removed from each page, inside article and main elements too, next to those
whose element or name says what they are (menus, headers, footers, sidebars,
notices, adverts, forms, comments), which may differ from page to page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import keep, only, table

#: A branch's importance is taken as if so many more pages had had it, each with contents of their own.
PRIOR = 2
#: Places from either end of a parent's elements that are judged for themselves.
ENDS = 4
#: Importance below which a branch is removed, and what one under a main element gets on top.
LOW, RAISE = 0.3, 0.15
#: Share of the contents in a node's importance; the rest is that of the presentation.
CONTENTS = 0.9

#: Elements whose contents are no page text.  Fixed values.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
#: Elements around the main text.  Fixed values.
CHROME = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "input", "head"))
#: Elements that hold the main text, in which a header is the text's own.  Fixed values.
MAIN = frozenset(("article", "main"))
#: Elements without contents.  Fixed values.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements inside a block.  Fixed values.
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
#: Words for what stands in or beside a text: adverts, comments, links to share or to read on.  Fixed values.
BESIDE = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored cookie cookies consent popup modal overlay newsletter subscribe subscription signup share sharing social comment comments disqus reply replies respond related recommended recommendations pagination pager breadcrumb breadcrumbs".split())
#: Words for what stands around a text and is left out inside main elements as well, and for what is so only outside these.  Fixed values.
INSIDE = BESIDE | frozenset("nav navbar navigation menu menus footer foot sidebar side aside widget widgets notice notices alert login search toolbar skip legal copyright contentinfo complementary".split())
AROUND = INSIDE | frozenset(("header", "masthead"))
#: Words before "header" that make it the text's own.  Fixed values.
OWN = frozenset(("article", "post", "entry", "story"))
#: Roles of elements around the main text, and elements in which a slash closes one.  Fixed values.
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"))
FOREIGN = frozenset(("svg", "math"))
#: Words that say nothing beside the others.  Fixed values.
NEUTRAL = frozenset("fluid clearfix clear desktop mobile main site page top bottom left right box bar block section area list item items links link wrapper wrap container content inner outer panel col column row unit slot group form button buttons icon icons text the js no primary secondary global post entry article toggle body".split())
#: The words of a name, and where a capital begins the next one.
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What an open element of the first kind is closed by.  Fixed values.
CLOSED_BY = {"p": frozenset(("p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "main", "figure", "fieldset", "address", "details")), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_SPACE = re.compile(r"\s+")
_ODD = re.compile(r"[%/\[]")


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether the last word that says something in one of a class or id's names is of these.

    The words before it only say whose it is (reader-comments), but those that make a header the text's own.
    """
    for one in name.split():
        parts = [w.lower() for w in _NAME_WORDS.findall(one)]
        while len(parts) > 1 and parts[-1] not in words and (parts[-1] in NEUTRAL or len(parts[-1]) == 1):
            parts.pop()
        if parts and parts[-1] in words and not (parts[-1] == "header" and OWN.intersection(parts[:-1])):
            return True
    return False


class Block:
    """A run of text between block elements: its text, its path, what stands above it, and the place of its element in its parent's."""

    __slots__ = ("chrome", "main", "path", "place", "siblings", "text")

    def __init__(self, text: str, path: tuple[str, ...], chrome: bool, main: bool, place: int = 1, siblings: list[int] | None = None) -> None:
        self.text, self.path, self.chrome, self.main, self.place, self.siblings = text, path, chrome, main, place, siblings or [1]

    def branches(self) -> list[tuple[str, ...]]:
        """The nodes that the block is below: all above it, and its element by its place from either end."""
        out = [self.path[:k] for k in range(1, len(self.path) + 1)]
        if self.path:
            last = self.siblings[0] - self.place + 1
            out += [(*self.path[:-1], f"{self.path[-1]}[{k}]") for k, near in ((self.place, self.place), (-last, last)) if near <= ENDS]
        return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order, scripts, styles and comments left out."""
    out: list[Block] = []
    #: tag, name in the path, inside chrome, inside main, how many elements are in it so far, its place in its parent's
    stack: list[tuple[str, str, bool, bool, list[int], int]] = [("", "", False, False, [0], 1)]
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                # the block's element, without inline ones
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE)
                above = next((s[4] for s in reversed(stack[:depth]) if s[0] not in INLINE), [1])
                out.append(Block(text, tuple(s[1] for s in stack[1 : depth + 1]), stack[-1][2], stack[-1][3], stack[depth][5], above))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if where and (tag not in INLINE or not any(s[0] not in INLINE for s in stack[where + 1 :])):
                if tag not in INLINE:
                    flush()
                del stack[where:]
            elif tag == "p" and not where:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                above = stack[i][0]
                if tag in CLOSED_BY.get(above, ()):
                    del stack[i:]
                    break
                if above not in INLINE and above not in CLOSED_BY:
                    break
        if tag in VOID or (m[3].endswith("/") and (tag in FOREIGN or any(x[0] in FOREIGN for x in stack))):
            continue
        named, hide = "", False
        if m[3] and not m[3].isspace():
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    named += " " + value
                hide |= key == "hidden" or (key == "role" and value.lower() in ROLES) or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
        chrome, main = stack[-1][2:4]
        own_header = main and tag == "header"
        chrome = chrome or hide or (tag in CHROME and not own_header) or bool(named and tag not in ("html", "body", *MAIN) and _named(named, INSIDE if main else AROUND))
        place = 1
        if tag not in INLINE:
            above = next(s[4] for s in reversed(stack) if s[0] not in INLINE)
            above[0] += 1
            place = above[0]
        # paths are joined by slashes and places are in brackets, so names must not hold any
        name = tag + ("." + ".".join(sorted(named.split())) if named and tag not in INLINE else "")
        stack.append((tag, _ODD.sub(lambda c: f"%{ord(c[0]):02X}", name), chrome, main or tag in MAIN, [0], place))
    flush()
    return out


def host(url: Column) -> Column:
    """Host of a URL in lower case, without its port; null and odd URLs have the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def nodes(found: list[Block]) -> dict[tuple[str, ...], tuple[list[str], list[str]]]:
    """(texts, layout) of each node that the blocks stand in; the layout is the children's names in their order, # for own text."""
    out: dict[tuple[str, ...], tuple[list[str], list[str]]] = {}
    for b in found:
        for path in b.branches():
            texts, layout = out.setdefault(path, ([], []))
            texts.append(b.text)
            layout.append(b.path[len(path)] if len(b.path) > len(path) else "#")
    return out


def style_tree(pages: DataFrame, prior: float = PRIOR, contents: float = CONTENTS) -> DataFrame:
    """(host, path, importance) of ``pages(host, html)``: the style trees' nodes that stand on two different pages or more.

    The importance of a node's contents is the entropy of the texts below it over
    the pages, divided by the most that so many pages can have; that of its
    presentation the same of its layout.  The node's is their mean, ``contents``
    being the weight of the first, drawn to 1 as by ``prior`` more pages that are all
    different, and RAISE more under the main elements.  Pages
    with the same blocks count once, as copies of a page say nothing about its
    template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, texts, layouts, copies = [], [], [], [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [b for b in blocks(page or "") if not b.chrome]
                whole = _digest("\n".join(b.text for b in found))
                for path, (text, layout) in nodes(found).items():
                    hosts.append(name)
                    paths.append("/".join(path))
                    texts.append(_digest("\n".join(text)))
                    layouts.append(_digest("\n".join(layout)))
                    copies.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(texts, pa.int64()), pa.array(layouts, pa.int64()), pa.array(copies, pa.int64())], ["host", "path", "text", "layout", "page"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, path string, text long, layout long, page long").distinct()
    # text or layout, how many pages have it
    styles = seen.groupBy("host", "path", "text", "layout").agg(F.count("*").alias("k")).select("host", "path", "k", F.posexplode(F.array("text", "layout")).alias("kind", "style")).groupBy("host", "path", "kind", "style").agg(F.sum("k").alias("k"))
    spread = styles.groupBy("host", "path", "kind").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("kk")).filter("n > 1")
    entropy = (F.log2("n") - F.col("kk") / F.col("n")) / F.log2("n")
    raised = F.when(F.col("path").rlike(r"(^|/)(article|main)([./\[]|$)"), RAISE).otherwise(0.0)
    means = spread.groupBy("host", "path").agg(F.max("n").alias("n"), F.sum(entropy * F.when(F.col("kind") == 0, contents).otherwise(1 - contents)).alias("mean"))
    return means.select("host", "path", ((F.col("n") * F.col("mean") + prior) / (F.col("n") + prior) + raised).alias("importance"))


def main_text(page: str, low: frozenset[str] | set[str] = frozenset()) -> str:
    """Main text of one page: blocks outside chrome and unimportant branches, joined by one space."""
    return " ".join(b.text for b in blocks(page) if not b.chrome and not (low and any("/".join(p) in low for p in b.branches())))


def extract(pages: DataFrame, low: float = LOW, prior: float = PRIOR) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    White space inside a block becomes one space, character references are
    decoded, blocks are joined by one space.  Null and empty pages give an empty
    text; pages without a host are judged together; repeated rows stay; an empty
    table gives no rows; extra columns are ignored.
    """
    named = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    tree = style_tree(named, prior).filter(F.col("importance") < low)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for paths in batch.column(1).to_pylist():
                all_ = set(paths)
                lists.append([p for p in paths if not any(p[:i] in all_ for i, c in enumerate(p) if c == "/")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["host", "low"])

    # the judged nodes of one host without those below others, as they stand on many pages each
    # kept, so that the join has plain rows on both sides and a hot host's pages can be split
    lists = keep(tree.groupBy("host").agg(F.collect_list("path").alias("low")).mapInArrow(highest, "host string, low array<string>"), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", set(paths or ())) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])

    return named.join(lists, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_text": query}
ORACLES: dict[str, str] = {}
