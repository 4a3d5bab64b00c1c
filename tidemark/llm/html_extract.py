"""Main text of web pages by a site style tree: same-host DOMs are merged and low-importance branches removed."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import maybe_broadcast, materialize

#: Share of content against presentation in a node's importance; pages of a host from which a node is judged;
#: importance up to which it goes.
GAMMA, LEAST_PAGES, LOW = 0.9, 4, 0.2

# Fixed values of HTML: element names by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea template noembed noframes svg".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol table dl article section div aside nav header footer main body html".split())
# What is not the article, by element, by role and by word of a class or id.
NOISE_TAGS = frozenset("head title nav aside footer form menu dialog button input label select".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Elements that hold the page: a word of their class ("has-sidebar") says what is in them, not what they are.
HOLDERS = frozenset("html body main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Blocks of text with the node that holds them, and the nodes' parents and children.

    A node is named by its path of element names with the words of class and id; the name is a hash of the parent's
    and its own, so that names don't grow with the depth. ``blocks`` has (text, node, noise); noise is 0 for what may
    be the article, 1 inside an article or main that only a word of a class or id around it speaks against, else 2.
    Text of an inline element that is noise is left out of its block.
    """

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int]] = []
        self.parents: dict[int, int] = {}
        self.children: dict[int, list[str]] = {}
        # Tag, node, noise, inside article or main, is a block, and says nothing.
        self._stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, True, False)]
        self._text: list[str] = []
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            end = m.start() if m else n
            if end > at and not self._stack[-1][5]:
                self._text.append(source[at:end])
            if not m:
                break
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self._close(tag)
            elif tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = over.end() if over else n
            else:
                self._open(tag, attrs)
        self._flush()

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text = []
        if text:
            noise, zone = next(s[2:4] for s in reversed(self._stack) if s[4])
            self.blocks.append((text, self._stack[-1][1], 2 if noise and not zone else noise))

    def _pop_to(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._flush()
                del self._stack[i:]
                return
            if self._stack[i][0] in stop:
                return

    def _open(self, tag: str, attrs: str) -> None:
        block = tag in BLOCKS
        if tag == "br":
            self._text.append(" ")
            return
        if block:
            self._flush()
            if tag in ENDS_P:
                self._pop_to(("p",), SCOPES)
            if tag in ENDS_OWN:
                self._pop_to(ENDS_OWN[tag], SCOPES - {tag})
        if tag in VOID:
            return
        _, node, before, zone, _, mute = self._stack[-1]
        noise = before
        words: list[str] = []
        names: list[str] = []
        role = ""
        if attrs and "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = (a or b or c).lower()
                if name.lower() == "role":
                    role = value.strip()
                else:
                    words += _WORDS.findall(value)
                    names += value.split()
        if tag == "main" and noise == 1:
            noise = 0  # the main text is in no side bar
        if tag in NOISE_TAGS or (tag == "header" and not zone) or role in NOISE_ROLES or ("hidden" in attrs and bool(re.search(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))", attrs))):
            noise = 2
        # An article is a comment or an advert only if a whole name says so.
        elif tag not in HOLDERS and any(n in NOISE_WORDS if tag == "article" else _names_noise(n) for n in names):
            noise = max(noise, 2 if zone else 1)
        if block:
            self.children.setdefault(node, []).append(tag)
            parent, name = node, tag + "".join(f".{w}" for w in sorted(set(words)))
            node = int.from_bytes(hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            self.parents.setdefault(node, parent)
            zone = zone or tag in ("article", "main") or role == "main"
        self._stack.append((tag, node, noise, zone, block, not block and (mute or noise > before)))

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                if any(s[4] for s in self._stack[i:]):
                    self._flush()
                del self._stack[i:]
                return
            if tag not in BLOCKS and self._stack[i][4]:
                return  # an inline end never closes a block

    def nodes(self) -> list[tuple[int, int, int, int]]:
        """(node, parent, hash of its children's order, hash of all its text) for each node that has text, parents first."""
        own: dict[int, list[bytes]] = {}
        for text, node, _ in self.blocks:
            own.setdefault(node, []).append(text.encode("utf-8", "surrogatepass"))
        for node in list(own):
            while node and (parent := self.parents[node]) not in own:
                own[parent] = []
                node = parent
        own.pop(0, None)
        # Every node was met after its parent; content goes from the children up.
        order = [node for node in self.parents if node in own]
        content = {node: zlib.crc32(b"\0".join(own[node])) for node in order}
        for node in reversed(order):
            if self.parents[node]:
                parent = self.parents[node]
                content[parent] = zlib.crc32(content[node].to_bytes(4, "big"), content[parent])
        style = lambda node: zlib.crc32(" ".join(t for t, _ in groupby(self.children.get(node, []))).encode())
        return [(node, self.parents[node], style(node), content[node]) for node in order]

    def code(self) -> int:
        """A 64-bit hash of the page's whole text."""
        text = "\0".join(text for text, _, _ in self.blocks).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)

    def article(self) -> list[tuple[str, int]]:
        """(text, node) of the blocks that aren't noise by name. Where words around the article leave nothing, they don't count."""
        least = min((noise for _, _, noise in self.blocks), default=0)
        return [(text, node) for text, node, noise in self.blocks if noise <= min(least, 1)]


def _names_noise(name: str) -> bool:
    """Whether the first or the last word of a class or id is a noise word: "share-buttons", not "post-share-price"."""
    words = _WORDS.findall(name)
    return bool(words) and (words[0] in NOISE_WORDS or words[-1] in NOISE_WORDS)


BLOCK = "struct<text:string,node:int>"
NODE = "struct<number:int,parent:int,node:long,style:long,content:long>"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (hash of all text), blocks (text, number of its node), nodes (number, parent's, name, style, content)."""

    def read(batches):
        for b in batches:
            rows = []
            for page_id, url, host, source in zip(b["page_id"], b["url"], b["host"], b["html"]):
                page = Page(source or "")
                nodes = page.nodes()
                number = {node: i for i, (node, *_) in enumerate(nodes)}
                blocks = [{"text": text, "node": number.get(node, -1)} for text, node in page.article()]
                rows.append((page_id, url, host, page.code(), blocks, [{"number": i, "parent": number.get(parent, -1), "node": n, "style": style, "content": content} for i, (n, parent, style, content) in enumerate(nodes)]))
            yield pd.DataFrame(rows, columns=["page_id", "url", "host", "page", "blocks", "nodes"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "host", "html").mapInPandas(read, f"page_id {kind}, url string, host string, page long, blocks array<{BLOCK}>, nodes array<{NODE}>")


def without_low(pages: DataFrame) -> DataFrame:
    """page_id, url, text from (page_id, url, blocks, nodes, low): a block goes if a node above it is low."""

    def read(batches):
        for b in batches:
            texts = []
            for blocks, nodes, low in zip(b["blocks"], b["nodes"], b["low"]):
                gone = set() if low is None else set(low)
                if gone:
                    for n in nodes:  # parents first
                        if n["parent"] in gone:
                            gone.add(n["number"])
                texts.append(" ".join(x["text"] for x in blocks if x["node"] not in gone))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    return pages.select("page_id", "url", "blocks", "nodes", "low").mapInPandas(read, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, node, pages, importance: the merged style trees.

    A node's importance is (1 - GAMMA) times the entropy of its children's orders plus GAMMA times that of its
    content, over the host's pages that have it, to the base of their number: 0 if all pages agree, 1 if all differ.
    Pages of a host with the same text throughout count once, so that a page's copies don't make it boilerplate.
    """
    seen = parsed.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.node", "n.style", "n.content").distinct()
    both = seen.select("host", "node", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("style").alias("value")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("value")))).alias("x"))
    counts = both.groupBy("host", "node", "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    evenness = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("same"))
    entropy = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(1 - F.col("same") / (F.col("pages") * F.log(F.greatest("pages", F.lit(2)))))
    weight = F.when(F.col("kind") == "c", GAMMA).otherwise(1 - GAMMA)
    return evenness.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.sum(weight * entropy).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Elements that are never the article (menus, headers, footers, forms, comments and so on) go by their names;
    the style tree of the host then removes branches whose presentation and content hardly differ over its
    pages, inside article and main too. What is left is kept wherever it lies. Null html is an empty page with empty
    text; pages with null url form one host. Repeated rows are kept, and as copies of one page don't make it
    boilerplate; other columns are ignored, whatever their names; an empty table gives no rows. Unclosed elements end
    with what holds them or with the page; depth costs no more than length.
    """
    base = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")).alias("host"))
    # Every page is parsed once; what its tree needs is written with its text.
    parsed = materialize(parse(base).withColumn("_uid", F.monotonically_increasing_id()), "pages")
    low = materialize(style_tree(parsed).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") <= LOW)).select(F.col("host").alias("low_host"), F.col("node").alias("low_node")), "low")
    count, size = low.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("low_host") + 72), F.lit(0))).first()
    if not count:
        return parsed.select("page_id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), " ").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    # By (host, node), so that neither a host's number of low nodes nor that of its pages meets in a row.
    nodes = parsed.select("_uid", "host", F.explode("nodes").alias("n")).select("_uid", "host", "n.number", "n.node")
    found = nodes.join(maybe_broadcast(low, size, 1), (F.col("host") == F.col("low_host")) & (F.col("node") == F.col("low_node")))
    marks = materialize(found.groupBy(F.col("_uid").alias("_u")).agg(F.collect_set("number").alias("low")), "marks")
    joined = parsed.join(marks, F.col("_uid") == F.col("_u"), "left")
    return without_low(joined).withColumn("n_chars", F.length("text").cast("long"))
