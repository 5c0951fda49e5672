"""Main text of web pages by wrapper induction.

Pages of a host are aligned by the paths of their nodes, not pair by pair by simple tree matching: that needs
reference pages, and what these lack is no template then, however many other pages carry it.  A block is the text of one block element; its key is the text with the tags on the path to it.  All
pages of a host vote, with no reference page: a key is template

* if it stands on most of the host's pages, or
* on most of the pages of one shape (the set of tag paths of the blocks, cut at depth SHAPE), or
* if of the pages that are alike but for this key (the same other repeated keys), most hold it,

and on LEAST_PAGES pages in each case.  The last two find the layouts of a host that has several; there
only blocks outside a marked article count, and only pages of which at least half of the keys are their
own, since what near copies of an article share is content.  What varies is content.  Copies of one page count once.  Beside the induced template, elements that say by
name that they are no article (menus, forms, adverts, comments and the like) are left out, and where
the page marks its article, blocks outside it are.

One pass parses; its blocks are written, the votes are hashes and summed map-side, and the rest is
DataFrame work.  Templates are broadcast only when they are small (checked), otherwise joined by page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A key is template on this share of the pages, and on so many.
SHARE, LEAST_PAGES, SHAPE = 0.5, 3, 4
MOST_REFERENCE_CHARS = 16_000_000

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head script style noscript template iframe svg canvas object nav footer aside form button select textarea dialog menu".split())
LIST, BOX = frozenset(("ul", "ol", "menu")), frozenset("article section div td th li main body".split())
#: Words of a class, an id or a role that mark something else than the article.
OTHER = frozenset(
    "ad ads adv advert advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer"
    " masthead topbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social"
    " related recommended comment comments disqus reply replies respond widget pagination pager contentinfo complementary".split()
)
#: What may start a tag, and the tag itself; quotes count behind an equals sign only.
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|</[^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("article", "block", "dropped", "parent", "path", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, article: bool):
        self.tag, self.parent, self.dropped, self.article = tag, parent, dropped, article
        self.block = parent.block if parent and tag in INLINE else self  # the nearest block element
        # a hash of the path, so that deep trees cost no more than flat ones; up to SHAPE also that of the cut path
        above = parent.path if parent else (0, b"", b"")
        name = hashlib.blake2b(above[1] + tag.encode(errors="replace"), digest_size=8).digest()
        self.path = (above[0] + 1, name, name if above[0] <= SHAPE else above[2])


def _other(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(w in OTHER for m in _NAMES.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower()))


def parse(page: str) -> list[tuple[Node, str]]:
    """The blocks (nearest block element, text) in page order, in time linear in the page.

    A tag that the page does not end is text, and so is all behind it.
    """
    root = Node("#root", None, False, False)
    at, blocks, run, held = root, [], [], root
    open_: Counter[str] = Counter()  # elements on the path to ``at``, by tag

    def flush() -> None:
        nonlocal run
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                blocks.append((held, text))
            run = []

    def close(x: Node) -> None:
        """Leave x and all elements inside it."""
        nonlocal at
        while at is not x:
            open_[at.tag] -= 1
            at = at.parent
        open_[x.tag] -= 1
        at = x.parent

    pos, n = 0, len(page)
    while pos < n:
        start = _OPEN.search(page, pos)
        m = _TOKEN.match(page, start.start()) if start else None
        end = start.start() if start and m else n
        if end > pos and not at.dropped:
            if not run:
                held = at.block
            run.append(page[pos:end])
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if open_[tag]:
                x = at
                while x.tag != tag:
                    x = x.parent
                close(x)
            continue
        goal = "li" if tag == "li" else "p" if tag in ENDS_P else ""
        if goal and open_[goal]:
            stop = LIST if goal == "li" else BOX
            x = at
            while x.parent and x.tag != goal and x.tag not in stop:
                x = x.parent
            if x.parent and x.tag == goal:
                close(x)
        if tag == "br":
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:  # no markup inside
            end_tag = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end_tag.end() if end_tag else n
            continue
        at = Node(tag, at, at.dropped or _other(tag, m[3], at.article), at.article or tag in ("article", "main"))
        open_[tag] += 1
    flush()
    return blocks


_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("key", pa.int64()), ("article", pa.bool_())]))


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, shape, body); body is a hash of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, shapes, bodies = [], [], []
            for page in batch.column(3).to_pylist():
                blocks = parse(page or "")
                rows = [{"text": text, "key": _hash(node.path[1], text.encode(errors="replace")), "article": node.article} for node, text in blocks]
                out.append(rows)
                shapes.append(_hash(*sorted({node.path[2] for node, _ in blocks})))
                bodies.append(_hash(*(x["key"].to_bytes(8, "little", signed=True) for x in rows)))
            yield pa.record_batch([*batch.columns[:3], pa.array(out, _BLOCK), pa.array(shapes, pa.int64()), pa.array(bodies, pa.int64())], names=["page_id", "url", "host", "blocks", "shape", "body"])

    return pages.mapInArrow(run, "page_id long, url string, host string, blocks array<struct<text:string,key:long,article:boolean>>, shape long, body long")


def main_text(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, most_reference_chars: int = MOST_REFERENCE_CHARS) -> DataFrame:
    """One row for each page: (page_id, url, text), the blocks of the article in page order joined by \\n.

    pages has page_id, url, html.  Null html counts as empty and gives an empty text; null urls make up
    a host of their own.  Repeated rows each give their row; further columns are ignored; an empty
    table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    parsed = scratch.put(_parsed(pages), "blocks")

    bodies = parsed.select("host", "body", "shape", F.array_distinct(F.transform("blocks", lambda b: F.struct(b["key"].alias("key"), b["article"].alias("article")))).alias("keys")).where(F.size("keys") > 0)
    bodies = scratch.put(bodies.groupBy("host", "body", "shape").agg(F.first("keys").alias("keys")), "bodies")
    held = bodies.select("host", "body", "shape", F.explode("keys").alias("k")).select("host", "body", "shape", "k.key", "k.article")
    often = held.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = scratch.put(often.join(bodies.groupBy("host").agg(F.count("*").alias("of")), "host").select("host", "key", (F.col("n") >= share * F.col("of")).alias("most")), "often")
    held = scratch.put(held.join(often, ["host", "key"]), "held")
    # a set of keys is known by the exclusive or of their hashes
    sets = held.groupBy("host", "body").agg(F.bit_xor(F.when(~F.col("article"), F.col("key"))).alias("set"), F.count("*").alias("repeated"))
    own = F.size("keys") >= 2 * F.coalesce("repeated", F.lit(0))
    sets = bodies.join(sets, ["host", "body"], "left").select("host", "body", "shape", F.coalesce("set", F.lit(0)).alias("set"), own.alias("own"))
    sets = scratch.put(sets, "sets")
    alike = scratch.put(sets.where("own").groupBy("host", "set").agg(F.count("*").alias("n")), "alike")
    known = scratch.put(held.join(sets.select("host", "body", "set", "own"), ["host", "body"]), "known")
    votes = known.where("own and not article")
    shapes = sets.where("own").groupBy("host", "shape").agg(F.count("*").alias("of"))
    of_shape = votes.groupBy("host", "shape", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).join(shapes, ["host", "shape"]).where(F.col("n") >= share * F.col("of"))
    of_shape = scratch.put(of_shape.select("host", "shape", "key", F.lit(True).alias("shaped")), "shapes")
    whole = votes.select("host", "set", "key").distinct().join(alike.where(F.col("n") >= least_pages), ["host", "set"])
    less = alike.select("host", F.col("set").alias("rest"), F.col("n").alias("without"))
    of_set = whole.withColumn("rest", F.col("set").bitwiseXOR(F.col("key"))).join(less, ["host", "rest"], "left").where(F.col("n") >= share * (F.col("n") + F.coalesce("without", F.lit(0))))
    of_set = scratch.put(of_set.select("host", "set", "key", F.lit(True).alias("alike")), "alike-but-one")
    kinds = known.select("host", "shape", "set", "key", "most").distinct().join(of_shape, ["host", "shape", "key"], "left").join(of_set, ["host", "set", "key"], "left")
    kinds = kinds.where(F.col("most") | F.col("shaped") | F.col("alike")).groupBy("host", "shape", "set").agg(F.collect_set("key").alias("template"))
    kinds = scratch.put(kinds, "kinds")
    template = scratch.put(sets.join(kinds, ["host", "shape", "set"]).select("host", "body", "template"), "template")
    chars = template.agg(F.sum(F.length("host") + 8 * (F.size("template") + 1))).first()[0] or 0
    out = parsed.join(F.broadcast(template) if chars <= most_reference_chars else template, ["host", "body"], "left")
    marked = F.exists("blocks", lambda b: b["article"])
    kept = F.filter("blocks", lambda b: (b["article"] | ~marked) & ~F.coalesce(F.array_contains("template", b["key"]), F.lit(False)))
    return out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
