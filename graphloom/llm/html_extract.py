"""Main text of web pages by wrapper induction over the pages of a host.

Every page's tree of block elements is aligned with its host's reference page by simple tree
matching. A slot is a kind of block below an aligned node; over all pages of the host, slots
whose content hardly varies between different articles, or is mostly found with other articles
too, here or on another host (the host's own name left out), become the template, the others are
content. A last check drops content slots inside elements that say they are not the article
(menus, footers, adverts, comments and the like), except for elements around the host's most
varied slot.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: A slot is judged from so many different articles on; it is template where its contents number at most this share of them.
LEAST_PAGES = 5
VARIETY = 0.5
#: The same for slots below the element that holds the article's text; and the share of articles with a content that other articles, of any host, show as well.
CONSTANT = 0.1
REPEATED = 0.5
#: Bytes up to which references or templates of all hosts are broadcast; beyond, they are joined by salted host.
BROADCAST_BYTES = 8 << 20
SALTS = 16

#: Siblings from which a row of their table is an array; cells up to which a table is held whole. The results are the same on either side.
WIDE = 48
CELLS = 4_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|\"(?![^\"]*\")|'(?![^']*'))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
# Element kinds of the HTML standard, fixed values.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What a start tag closes when it is open nearer than the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, roles, and words of classes and ids that aren't the article.
_NOT_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "search", "head", "fieldset"}
_NOT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_NOT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert", "comment", "comments", "commentlist", "respond", "reply", "replies", "promo", "promotion", "sponsor", "sponsored", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "breadcrumb", "breadcrumbs", "widget", "popup", "modal", "overlay", "login", "signup", "pagination", "pager", "toolbar", "skip", "disclaimer"}


class Node:
    __slots__ = ("tag", "mark", "kids", "parent", "number", "role")

    def __init__(self, tag: str, mark: str, role: str, parent: Node | None):
        self.tag, self.mark, self.role, self.parent, self.kids, self.number = tag, mark, role, parent, [], -1


def parse(source: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text in page order with their elements."""
    source = source or ""
    root = Node("#root", "", "", None)
    at, blocks, run, skip, place = root, [], [], None, 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((at, text))

    position = 0
    while position < len(source):
        m = _TAG.search(source, position)
        if not m:
            run.append(source[position:])
            break
        if m.start() > position:
            run.append(source[position : m.start()])
        position = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in _RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, position)
                position = end.end() if end else len(source)
                continue
            if tag == "br":
                run.append(" ")
            if tag not in _BLOCK:
                continue
            flush()
            stop = at
            if tag in _CLOSES:
                closes, stops = _CLOSES[tag]
                while stop.parent and stop.tag not in stops and stop.tag not in closes:
                    stop = stop.parent
                at = stop.parent if stop.tag in closes else at
            if tag not in ("option", "optgroup"):
                stop = at
                while stop.parent and stop.tag not in ("p", "td", "th", "li", "div", "article", "section", "body", "table", "button"):
                    stop = stop.parent
                at = stop.parent if stop.tag == "p" else at
            if tag in _VOID:
                continue
            mark, role = "", ""
            if m[3]:
                for name, *values in _ATTR.findall(m[3]):
                    value = "".join(values).lower()
                    if name.lower() == "role":
                        role = value
                    else:
                        mark += " " + value
            node = Node(tag, mark.strip(), role, at)
            at.kids.append(node)
            at = node
        elif tag in _BLOCK:
            flush()
            stop = at
            while stop.parent and stop.tag != tag:
                stop = stop.parent
            at = stop.parent or at if stop.tag == tag else at
    flush()
    return root, blocks


def _same(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.mark == b.mark


def _kinds(root: Node, known: dict[tuple, int], sizes: list[int]) -> dict[int, int]:
    """A number for each element, equal for equal trees; ``sizes``: elements of a kind's tree."""
    order, todo, out = [], [root], {}
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    for node in reversed(order):
        below = tuple([out[id(x)] for x in node.kids])
        kind = known.setdefault((node.tag, node.mark, below), len(known))
        if kind == len(sizes):
            sizes.append(1 + sum(sizes[k] for k in below))
        out[id(node)] = kind
    return out


def _next(above, weights, choose: bool):
    """The next row of the table of most pairs, and how each cell came about: 0 from above, 1 from the left, 2 by a pair. Narrow rows are lists, wide ones arrays."""
    if isinstance(above, list):
        row, ways = [0], bytearray(len(weights))
        for j, weight in enumerate(weights):
            up, left = above[j + 1], row[-1]
            best, way = (up, 0) if up >= left else (left, 1)
            if above[j] + weight > best:
                best, way = above[j] + weight, 2
            row.append(best)
            ways[j] = way
        return row, ways
    paired = above[:-1] + weights
    row = np.maximum.accumulate(np.append(0, np.maximum(above[1:], paired)))
    if not choose:
        return row, None
    return row, np.where(paired > np.maximum(above[1:], row[:-1]), 2, row[:-1] > above[1:]).astype(np.uint8)


def align(a: Node, b: Node) -> tuple[int, list]:
    """Simple tree matching: the most pairs of equal nodes that keep order and ancestry, below two equal nodes; (pairs, which).

    Equal trees are matched whole, others once for each two kinds of them. Works on a stack of
    its own, so nesting may be as deep as it likes. All pairs of siblings are compared, however
    many; of a large table some rows are kept and those between made again, so memory grows
    with its length and not with its area."""
    known: dict[tuple, int] = {}
    sizes: list[int] = []
    kinds = _kinds(a, known, sizes) | _kinds(b, known, sizes)
    counts: dict[tuple[int, int], int] = {}

    def kind_of(x: Node) -> int:
        return kinds[id(x)]

    def weights(x: Node, y: Node):
        """A function from the kids of x to their weights beside those of y."""
        of = list(map(kind_of, y.kids))
        each = {kind_of(k): k for k in y.kids}
        index = {k: i for i, k in enumerate(each)}
        at = None if len(of) < WIDE else np.array([index[k] for k in of])
        rows: dict[int, object] = {}

        def row(kid: Node):
            own = kind_of(kid)
            if own not in rows:
                found = [0 if not _same(kid, k) else sizes[own] if kind == own else counts[own, kind] if kid.kids and k.kids else 1 for kind, k in each.items()]
                rows[own] = [found[index[k]] for k in of] if at is None else np.array(found, np.int64)[at]
            return rows[own]

        return row

    def start(y: Node):
        return [0] * (len(y.kids) + 1) if len(y.kids) < WIDE else np.zeros(len(y.kids) + 1, np.int64)

    def asked(x: Node, y: Node) -> list[tuple[Node, Node]]:
        """Kids that both have kids, of each two kinds one pair that is still to be counted."""
        theirs: dict[tuple[str, str], dict[int, Node]] = {}
        for k in y.kids:
            if k.kids:
                theirs.setdefault((k.tag, k.mark), {})[kind_of(k)] = k
        own = {kind_of(k): k for k in x.kids if k.kids}
        return [(p, q) for i, p in own.items() for j, q in theirs.get((p.tag, p.mark), {}).items() if i != j and (i, j) not in counts]

    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        key = kind_of(x), kind_of(y)
        if key in counts:
            continue
        if key[0] == key[1]:
            counts[key] = sizes[key[0]]
        elif not ready:
            todo.append((x, y, True))
            todo += [(p, q, False) for p, q in asked(x, y)]
        else:
            row, of = start(y), weights(x, y)
            for kid in x.kids:
                row = _next(row, of(kid), False)[0]
            counts[key] = int(row[-1]) + 1

    pairs, matched = [], [(a, b)]
    while matched:
        x, y = matched.pop()
        pairs.append((x, y))
        if kind_of(x) == kind_of(y):
            matched += zip(x.kids, y.kids, strict=True)
            continue
        i, j = len(x.kids), len(y.kids)
        if not i or not j:
            continue
        of = weights(x, y)
        step = i if i * j <= CELLS else math.isqrt(i) + 1
        kept = [start(y)]
        row = kept[0]
        for n, kid in enumerate(x.kids[: (i - 1) // step * step], 1):
            row = _next(row, of(kid), False)[0]
            if n % step == 0:
                kept.append(row)
        while i and j:
            low = (i - 1) // step * step
            row, ways = kept[low // step], []
            for kid in x.kids[low:i]:
                row, way = _next(row, of(kid), True)
                ways.append(way)
            while i > low and j:
                way = ways[i - 1 - low][j - 1]
                if way == 2:
                    i, j = i - 1, j - 1
                    matched.append((x.kids[i], y.kids[j]))
                elif way == 0:
                    i -= 1
                else:
                    j -= 1
    return counts[kind_of(a), kind_of(b)], pairs


def _number(root: Node) -> None:
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        node.number, n = n, n + 1
        todo += reversed(node.kids)


def slot(node: Node, numbers: dict[int, int], known: dict[int, str] | None = None) -> str:
    """The nearest aligned ancestor's number in the reference, and the kinds of elements from there; a long list of kinds by its hash. ``known``: names found so far."""
    known = {} if known is None else known
    path, at = [node], node.parent
    while at is not None and id(at) not in numbers and id(at) not in known:
        path.append(at)
        at = at.parent
    name = "-1>" if at is None else f"{numbers[id(at)]}>" if id(at) in numbers else known[id(at)] + ">"
    for x in reversed(path):
        name += f"{x.tag}.{x.mark}"
        if len(name) > 200:
            name = f"{name.partition('>')[0]}>#{_hash(name)}"
        known[id(x)] = name
        name += ">"
    return name[:-1]


def not_article(node: Node, known: dict[int, tuple] | None = None) -> tuple[list[Node], bool]:
    """Those of a block's element and the ones around it that say they are not the article, and whether it lies in an article or main element. ``known``: what is found so far."""
    known = {} if known is None else known
    path, at = [], node
    while at is not None and id(at) not in known:
        path.append(at)
        at = at.parent
    bad, inside = known[id(at)] if at is not None else ((), False)
    for at in reversed(path):
        if at.tag in ("article", "main"):  # a header around an article is none of the page
            inside, bad = True, tuple(x for x in bad if not x[1])
        named = at.mark and at.tag not in ("html", "body", "article", "main") and _NOT_WORDS.intersection(_WORDS.findall(at.mark))
        if named or at.tag in _NOT_TAGS or at.role in _NOT_ROLES:
            bad = (*bad, (at, False))
        elif at.tag == "header" and not inside:
            bad = (*bad, (at, True))
        known[id(at)] = bad, inside
    return [x for x, _ in bad], inside


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >= 1 << 63 else x


def checked(source: str | None, reference: Node | None, host: str | None = None) -> tuple[list[tuple[str, str, list[int], int, bool]], list[tuple[str, int, int]]]:
    """(slot, text, elements around it that fail the check, its own element, in an article or main) of each block; (slot, hash of all it holds but the host's name, its characters) of each slot."""
    root, blocks = parse(source)
    numbers = {id(p): r.number for p, r in align(root, reference)[1]} if reference is not None else {}
    elements: dict[int, int] = {}
    names: dict[int, str] = {}
    found: dict[int, tuple] = {}
    kinds: dict[int, tuple[str, list[int], int, bool]] = {}
    for node, _ in blocks:
        if id(node) not in kinds:
            bad, inside = not_article(node, found)
            own, *failing = (elements.setdefault(id(n), len(elements)) for n in (node, *bad))
            kinds[id(node)] = (slot(node, numbers, names), failing, own, inside)
    out, held = [], {}
    for node, text in blocks:
        name, *check = kinds[id(node)]
        out.append((name, text, *check))
        held.setdefault(name, []).append(text)
    plain = lambda ts: "\n".join(ts).lower().replace(host, "\n") if host else "\n".join(ts)
    return out, [(name, _hash(plain(ts)), sum(map(len, ts))) for name, ts in held.items()]


def blocks_of(source: str | None, reference: Node | None) -> tuple[list[tuple[str, str, bool]], list[tuple[str, int, int]]]:
    """(slot, text, passes the check) of each block of a page on its own; of each slot as ``checked``."""
    blocks, held = checked(source, reference)
    article = any(inside and not bad for _, _, bad, _, inside in blocks)
    return [(name, text, not bad and (inside or not article)) for name, text, bad, _, inside in blocks], held


def _by_host(pages: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """Left join on ``host``: broadcast while ``size`` bytes are few, else by host and salt, so that no host is one task."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(side), "host", "left")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def _repeated(contents: DataFrame) -> DataFrame:
    """``hash, repeated``: contents that different pages or articles hold, of rows (host, slot, hash, low, high), ``low`` and ``high`` the least and greatest holder there."""
    return contents.groupBy("hash").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low <> _high").select("hash", F.lit(True).alias("repeated"))


def host_of(url_col: str) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` from ``page_id, url, html``, a row for each page.

    A null or empty page gives an empty text. Pages may be as long, as wide and as deeply nested as they like. Pages without a host are taken as one host.
    Repeated pages are extracted each, but copies of an article count once as evidence: a
    page's article is what it holds in the host's most varied slot, that with the most contents no other page holds, and then the most text. Hosts with fewer than ``LEAST_PAGES`` articles have no
    template, and the check alone decides."""
    pages = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    order = F.struct(F.xxhash64(F.lit(17), "url", "page_id"), F.xxhash64("html"))
    references = written(pages.where(F.length("html") > 0).groupBy("host").agg(F.min_by("html", order).alias("reference")), "references")
    size = references.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0

    @F.pandas_udf("blocks array<struct<slot:string,text:string,bad:array<int>,own:int,inside:boolean>>, held array<struct<slot:string,hash:long,chars:long>>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trees: dict[str, Node] = {}
        for hosts, sources, refs in batches:
            out = []
            for host, source, ref in zip(hosts, sources, refs, strict=True):
                tree = trees.get(host)
                if tree is None and ref is not None:
                    if len(trees) >= 256:
                        trees.clear()
                    tree = trees[host] = parse(ref)[0]
                    _number(tree)
                blocks, held = checked(source, tree, host)
                out.append(([{"slot": s, "text": t, "bad": b, "own": o, "inside": i} for s, t, b, o, i in blocks], [{"slot": s, "hash": h, "chars": n} for s, h, n in held]))
            yield pd.DataFrame(out, columns=["blocks", "held"])

    aligned = _by_host(pages, references, size).withColumn("_b", of("host", "html", "reference")).select("page_id", "url", "host", "_b.*")
    aligned = written(aligned, "blocks")
    page = F.xxhash64(F.transform("held", lambda h: h["hash"]))
    each = aligned.select("host", page.alias("by"), F.explode("held").alias("_h")).select("host", "by", F.col("_h.slot").alias("slot"), F.col("_h.hash").alias("hash"), F.col("_h.chars").alias("chars"))
    contents = written(each.groupBy("host", "slot", "hash").agg(F.max("chars").alias("chars"), F.min("by").alias("low"), F.max("by").alias("high")), "slot-contents")
    own = contents.join(_repeated(contents), "hash", "left").groupBy("host", "slot").agg(F.count(F.when(F.col("repeated").isNull(), 1)).alias("n"), F.sum("chars").alias("chars"))
    richest = written(own.groupBy("host").agg(F.max_by("slot", F.struct("n", "chars", "slot")).alias("richest")), "richest")
    size = richest.agg(F.sum(F.octet_length("host") + F.octet_length("richest"))).first()[0] or 0
    article = F.coalesce(F.get(F.filter("held", lambda h: h["slot"] == F.col("richest")), F.lit(0))["hash"], F.xxhash64(F.transform("held", lambda h: h["hash"])))
    held = _by_host(aligned.select("page_id", "url", "host", "held"), richest, size).select("host", article.alias("article"), F.explode("held").alias("_h")).select("host", "article", F.col("_h.slot").alias("slot"), F.col("_h.hash").alias("hash"))
    per_article = held.groupBy("host", "slot", "article").agg(F.min("hash").alias("hash"))
    # a content that different articles show, of whatever host, is no article's own
    each = written(per_article.groupBy("host", "slot", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("article").alias("low"), F.max("article").alias("high")), "contents")
    variety = each.join(_repeated(each), "hash", "left").groupBy("host", "slot").agg(F.sum("n").alias("articles"), F.count(F.lit(1)).alias("contents"), F.sum(F.when(F.col("repeated"), F.col("n")).otherwise(0)).alias("repeated"))
    beside = F.substring_index("slot", ">", 1) == F.substring_index("richest", ">", 1)  # below the same element as the article's text
    few = F.col("contents") <= F.when(beside, CONSTANT).otherwise(VARIETY) * F.col("articles")
    fixed = variety.join(richest, "host").where((F.col("articles") >= LEAST_PAGES) & (few | (~beside & (F.col("repeated") >= REPEATED * F.col("articles")))))
    slots = fixed.groupBy("host").agg(F.collect_set("slot").alias("template"))  # slots of one reference tree
    templates = written(richest.join(slots, "host", "left"), "templates")
    size = templates.agg(F.sum(F.octet_length("host") + F.octet_length("richest") + F.octet_length(F.coalesce(F.array_join("template", ","), F.lit(""))))).first()[0] or 0
    # what stands around the most varied slot holds the article, whatever its name says
    above = F.flatten(F.transform(F.filter("blocks", lambda b: b["slot"] == F.col("richest")), lambda b: F.array_remove(b["bad"], b["own"])))
    ok = lambda b: (F.size(b["bad"]) == 0) | (F.size(F.array_except(b["bad"], F.coalesce("above", F.array().cast("array<int>")))) == 0)
    rows = _by_host(aligned.select("page_id", "url", "host", "blocks"), templates, size).withColumn("above", above)
    rows = rows.withColumn("blocks", F.filter("blocks", ok))
    rows = rows.withColumn("article", F.exists("blocks", lambda b: b["inside"]))
    kept = F.filter("blocks", lambda b: (b["inside"] | ~F.col("article")) & ~F.coalesce(F.array_contains(F.col("template"), b["slot"]), F.lit(False)))
    return rows.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
