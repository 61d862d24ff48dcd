"""Main text of web pages by wrapper induction.

Pages become trees of block elements. Trees of one host are aligned by simple tree matching and folded into one template: a
node whose text is the same on all pages that have it, and that stands on half of the host's distinct pages or more, is
template; any other is a slot, with the amount of text outside links that all pages have in it. Pages of equal text count
once. Runs of like siblings (paragraphs, list items) fold into one node. Folding is associative, so each task folds its own
pages and partial templates are folded by host in two rounds; no task sees all pages of a host.

The host's template tells where the content is: from the root down to the slot that holds most of the varying text of all
pages, as long as no headline stands beside it. A page is read along that path, constant nodes go, and what stays are its
slots. A page of a host with few pages is read along its own tree. Names only support this: an element whose class, id or role
says nothing but boilerplate goes, one whose name merely has such a word goes if most of its text is in links.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.llm.common import fresh, materialise, slices

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = frozenset("html body article main section aside nav header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th caption figure figcaption form fieldset address details summary dialog menu center hgroup search head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select option input textarea iframe object embed applet svg canvas math menu dialog audio video datalist fieldset search".split())
#: What an opening tag ends: the open elements of these names, up to the nearest of the fences.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
ENDS_PARAGRAPH = BLOCK - {"html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"hr"}
#: Words in class, id or role that mark boilerplate.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist commentary disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription subscribebox share sharing social related recommended recommendations widget masthead topbar toolbar pagination pager skip login signup signin register search searchbox copyright complementary contentinfo form tracking outbrain taboola".split())
HEADER_WORDS = frozenset("header head topbar masthead banner".split())
#: Words beside them that tell nothing of the content.
NEUTRAL = frozenset("area bar block body bottom box button buttons column container content entries footer form group header holder inner item items left link links list main message more news outer page panel posts articles stories right row section site slot story text thread title top unit user wrap wrapper".split())
CONTENT_WORDS = frozenset("content article post entry story main maincontent articlebody body text".split())
#: The path to the content goes on to an element that has this share of the varying text, to a marked one from the second on.
SHARE, MARKED_SHARE = 0.8, 0.5
#: A name that merely has a word of boilerplate counts if links have this share of the text.
LINKED = 0.5
#: In an article or main element, a node is template only on this share of so many distinct pages (near copies share text).
INNER_SHARE, INNER_PAGES = 0.9, 10
#: A node is taken for template only if so many pages of the host agree on it and the host's pages differ elsewhere.
LEAST_PAGES = 4
#: And only if it stands on this share of the host's distinct pages.
LEAST_SHARE = 0.5
#: Elements nested deeper are read as blocks of the element at this depth; they open and close like any other.
DEEPEST = 120
#: Pairs of unlike siblings that are weighed against each other; beyond it their names alone are aligned.
MOST_PAIRS = 1600
#: Templates up to so many bytes in all are sent to the workers; larger ones are joined by host.
BROADCAST_BYTES = 32 << 20
#: Parts of a host's pages where wrappers are joined.
SALTS = 32
#: Hosts whose partial templates a task holds before it hands them on.
HELD_HOSTS = 2000

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("attrs", "key", "linked", "parts", "tag", "words")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.parts, self.linked = tag, [], 0  # children and strings of text; characters of text in links
        self.attrs = dict((m[0].lower(), html.unescape(m[1] or m[2] or m[3])) for m in ATTRIBUTE.findall(attrs)) if attrs.strip() else {}
        names = " ".join(self.attrs.get(k, "") for k in ("class", "id", "role"))
        self.words = frozenset(w.lower() for w in WORD.findall(names)) if names.strip() else frozenset()
        self.key = tag + (" " + DIGITS.sub("0", " ".join(sorted(names.split()))) if names.strip() else "")

    def children(self) -> list[Node]:
        return [x for x in self.parts if type(x) is Node]


def parse(page: str) -> Node:
    """The tree of a page's block elements; inline elements become text of the block they stand in."""
    root = Node("html")
    # names of the open elements, and for each the node that takes its text
    names, stack, at, end = ["html"], [root], 0, len(page)
    sinks: set[int] = set()
    inline: set[str] = set()  # names of inline elements that have been opened as nodes
    in_link = False

    def add(text: str) -> None:
        if text:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
            if in_link:
                stack[-1].linked += len(text)

    def close(k: int) -> None:
        nonlocal in_link
        inner, in_link = stack[-1], False
        del names[k:], stack[k:]
        if k >= DEEPEST and inner is stack[-1] and id(inner) not in sinks:
            inner.parts.append(Node("div"))  # a block ends here

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if name == "a":
            in_link = not m[1]
        if m[1]:
            if name in BLOCK or name in DROPPED or name in inline:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        close(k)
                        break
            continue
        if name == "html":
            continue
        if name in ENDS_PARAGRAPH:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == "p":
                    close(k)
                    break
                if names[k] in ("td", "th", "li", "table", "div", "section", "article"):
                    break
        if name in CLOSES:
            ended, fences = CLOSES[name]
            for k in range(len(names) - 1, 0, -1):
                if names[k] in fences:
                    break
                if names[k] in ended:
                    close(k)
        if name in RAW:  # no markup inside
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = shut.start() if shut else end
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            stack[-1].parts.append(" " if name in ("br", "hr", "wbr") else "")
            continue
        if name in BLOCK or name in DROPPED or m[3] and ("hidden" in m[3] or "display" in m[3]):
            node = Node(name, m[3])
            if name not in BLOCK and name not in DROPPED:
                inline.add(name)
            if len(names) >= DEEPEST and id(stack[-1]) in sinks:
                node = stack[-1]
            else:
                stack[-1].parts.append(node)
                if len(names) >= DEEPEST:
                    if boilerplate(node, False):
                        sinks.add(id(node))
                    else:
                        node = stack[-1]
            names.append(name)
            stack.append(node)
    rest = page[at:]
    add(rest if "<" not in rest else rest[: rest.rfind("<")] if re.match(r"<[a-zA-Z/!]", rest[rest.rfind("<") :]) else rest)
    return root


@lru_cache(maxsize=1 << 16)
def named(key: str) -> tuple[str, bool, bool]:
    """(tag, name of boilerplate and nothing else, name with a word of boilerplate) of a node's key."""
    tag, _, names = key.partition(" ")
    tokens = [{w.lower() for w in WORD.findall(x)} for x in names.split()]
    marked = [x for x in tokens if x & BOILERPLATE]
    return tag, any(x <= BOILERPLATE | NEUTRAL for x in marked), bool(marked)


def shown(node: Node) -> tuple[int, int]:
    """Characters of text below a node, and those in links."""
    n, linked = sum(len(x.strip()) for x in node.parts if type(x) is str), node.linked
    for c in node.children():
        more = shown(c)
        n, linked = n + more[0], linked + more[1]
    return n, linked


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element goes by its name, class, id or role; inside: it stands in the content element."""
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", ""):
        return True
    if node.tag in ("html", "body", "main", "p") and not node.words & {"comment", "comments"} or node.tag in HEADINGS:
        return False
    if node.tag == "header" or node.words & HEADER_WORDS and node.tag != "article":
        return not inside
    _, only, some = named(node.key)
    if not some or node.tag != "article" and holds_article(node):
        return False
    if not only:
        n, linked = shown(node)
        return linked >= LINKED * n > 0
    return node.tag != "article" or bool(node.words & {"comment", "comments", "reply", "ad", "related"})


def holds_article(node: Node) -> bool:
    return any(x.tag in ("article", "main") and not x.words & BOILERPLATE or holds_article(x) for x in node.children())


# --- templates: [key, pages, text hash or 0 if it varies, run of siblings?, children, characters outside links, in links]


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=7).digest()) + 1


def own_text(node: Node) -> str:
    return " ".join(" ".join(x for x in node.parts if type(x) is str).split())


def template(node: Node, made: dict[int, list] | None = None) -> list:
    """The template of one page; `made` takes that of each node by its id."""
    children: list[list] = []
    for child in node.children():
        own = template(child, made)
        if children and children[-1][0] == own[0]:  # a run of like siblings is one node, constant only as a whole
            children[-1] = fold(children[-1], own, run=True)
        else:
            children.append(own)
    text = own_text(node)
    linked = min(node.linked, len(text))
    out = [node.key, 1, digest(text) if text else -1, False, children, len(text) - linked, linked]
    if made is not None:
        made[id(node)] = out
    return out


def signature(t: list) -> int | None:
    """A hash of a constant node with its subtree; None if it varies or has no text."""
    parts, said = [t[0], str(t[2])], t[2] > 0
    if not t[2]:
        return None
    for c in t[4]:
        own = signature(c)
        if own is None:
            if varies(c):
                return None
            own = c[0]
        else:
            said = True
        parts.append(str(own))
    return digest("\n".join(parts)) if said else None


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in which None equals nothing.

    Rows are bit vectors of `a`; only every so many are held, and those between are worked out again on the way back.
    """
    at: dict = {}
    for i, x in enumerate(a):
        if x is not None:
            at.setdefault(x, []).append(i)
    if not any(x in at for x in b):
        return []
    masks = {x: sum(1 << i for i in at[x]) for x in {*b} & at.keys()}
    full, step = (1 << len(a)) - 1, isqrt(len(b)) + 1

    def after(row: int, x) -> int:
        m = row & masks.get(x, 0)
        return (row + m | row - m) & full

    held, row = [full], full
    for j, x in enumerate(b, 1):
        row = after(row, x)
        if j % step == 0:
            held.append(row)
    pairs, i, j, first, rows = [], len(a), len(b), len(b) + 1, []
    while i and j:
        if j - 1 < first:
            first = (j - 1) // step * step
            rows = [held[first // step]]
            for x in b[first:j]:
                rows.append(after(rows[-1], x))
        if rows[j - first] >> i - 1 & 1:
            i -= 1
        elif rows[j - 1 - first] >> i - 1 & 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        else:
            j -= 1
    return pairs[::-1]


def weight(a: list, b: list) -> int:
    """Simple tree matching: the number of pairs in the best alignment of two trees, 0 if the roots differ."""
    if a[0] != b[0]:
        return 0
    return 1 + align(a[4], b[4])[0]


def align(xs: list, ys: list) -> tuple[int, list[tuple[int, int]]]:
    """Alignment of two sequences of trees that keeps their order: its weight and its pairs.

    Equal trees are aligned first, by a longest common subsequence; what lies between two of them is aligned for itself.
    """
    if [x[0] for x in xs] == [y[0] for y in ys] and len({x[0] for x in xs}) == len(xs):
        return sum(weight(x, y) for x, y in zip(xs, ys, strict=True)), [(k, k) for k in range(len(xs))]
    total, pairs, i, j = 0, [], 0, 0
    for x, y in [*common([*map(signature, xs)], [*map(signature, ys)]), (len(xs), len(ys))]:
        more, found = between(xs[i:x], ys[j:y])
        total += more
        pairs += [(i + a, j + b) for a, b in found]
        if x < len(xs):
            total += weight(xs[x], ys[y])
            pairs.append((x, y))
        i, j = x + 1, y + 1
    return total, pairs


def between(xs: list, ys: list) -> tuple[int, list[tuple[int, int]]]:
    """Best alignment by weight; of many siblings, one with the most pairs of like names."""
    if not xs or not ys:
        return 0, []
    if len(xs) * len(ys) > MOST_PAIRS:
        found = common([x[0] for x in xs], [y[0] for y in ys])
        return sum(weight(xs[i], ys[j]) for i, j in found), found
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    own = {}
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            own[i, j] = w = weight(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def fold(a: list, b: list, run: bool = False) -> list:
    """Two aligned templates as one; run: they are siblings of one page."""
    text = a[2] if a[2] == b[2] else 0
    if run:
        text = digest(f"{a[2]} {b[2]}") if a[2] and b[2] else 0
    out: list[list] = []
    i = j = 0
    for x, y in [*align(a[4], b[4])[1], (len(a[4]), len(b[4]))]:
        out += a[4][i:x] + b[4][j:y]
        if x < len(a[4]):
            out.append(fold(a[4][x], b[4][y], run))
        i, j = x + 1, y + 1
    return [a[0], max(a[1], b[1]) if run else a[1] + b[1], text, run or a[3] or b[3], out, a[5] + b[5], a[6] + b[6]]


def varies(t: list) -> bool:
    return t[2] == 0 or any(map(varies, t[4]))


def constant_nodes(node: Node, own: list, t: list, pages: int, made: dict[int, list], out: set[int], inside: bool = False) -> None:
    """Ids of the nodes of a page that are template: node and subtree have the same text on all of enough of `pages` pages.

    `own` is the page's template of the node, or of the run that it stands in.
    """
    groups: list[list[Node]] = []
    for child in node.children():
        if groups and groups[-1][0].key == child.key:
            groups[-1].append(child)
        else:
            groups.append([child])
    inside = inside or node.tag in ("article", "main")
    least = max(INNER_PAGES, INNER_SHARE * pages) if inside else max(LEAST_PAGES, LEAST_SHARE * pages)
    mine = made[id(node)][4]
    places = dict(align(own[4], t[4])[1])
    for i, k in [(k, k) for k in range(len(mine))] if own is made[id(node)] else align(mine, own[4])[1]:
        if k not in places:
            continue
        o, c = own[4][k], t[4][places[k]]
        if c[1] >= least and not varies(c) and signature(o) == signature(c):
            out.update(map(id, groups[i]))
        else:
            for child in groups[i]:
                constant_nodes(child, o, c, pages, made, out, inside)


# --- text


def mass(t: list, least: float) -> int:
    """Characters of varying text outside links below a template's node, without boilerplate by name."""
    tag, only, _ = named(t[0])
    if tag in DROPPED or tag == "header" or only and tag not in ("html", "body", "main", "p", "article") or t[1] >= least and not varies(t):
        return 0
    return t[5] + sum(mass(c, least) for c in t[4])


def content(root: Node, own: list, t: list, least: float, made: dict[int, list]) -> Node:
    """The element of a page that the path in a template leads to; `own` and `made` are the page's own template."""
    node = root
    while node.tag not in ("article", "main"):
        masses = [mass(c, least) for c in t[4]]
        best = max(range(len(masses)), key=masses.__getitem__, default=None)
        if best is None:
            break
        tag = named(t[4][best][0])[0]
        marked = tag in ("article", "main") or bool({w.lower() for w in WORD.findall(t[4][best][0].partition(" ")[2])} & CONTENT_WORDS)
        beside = any(m and k != best and named(t[4][k][0])[0] in HEADINGS for k, m in enumerate(masses))
        if tag in HEADINGS or tag in ("p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure") or beside or masses[best] < (MARKED_SHARE if marked else SHARE) * (sum(masses) + t[5]):
            break
        at = next((i for i, k in align(own[4], t[4])[1] if k == best), None)
        if at is None:
            break
        group = [c for c in node.children() if c.key == own[4][at][0]]
        if len(group) != 1:
            break
        node, t = group[0], t[4][best]
        own = made[id(node)]
    return node


def text_blocks(node: Node, constant: frozenset | set, inside: bool) -> list[str]:
    """Text of the blocks below a node in page order, without boilerplate and constant nodes."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    def walk(x: Node) -> None:
        for part in x.parts:
            if type(part) is str:
                held.append(part)
            elif not boilerplate(part, inside) and id(part) not in constant:
                flush()
                walk(part)
                flush()
            else:
                flush()

    walk(node)
    flush()
    return out


def extract(page: str | None, wrapper: list | None) -> str:
    """Main text of a page; empty for null, empty or markup-only pages."""
    if not page:
        return ""
    root = parse(page)
    constant: set[int] = set()
    made: dict[int, list] = {}
    own = template(root, made)
    element = None
    if wrapper is not None and wrapper[1] >= LEAST_PAGES and varies(wrapper):
        constant_nodes(root, own, wrapper, wrapper[1], made, constant)
        element = content(root, own, wrapper, max(LEAST_PAGES, LEAST_SHARE * wrapper[1]), made)
        found = text_blocks(element, constant, element.tag not in ("html", "body"))
        if found:
            return "\n\n".join(found)
    element = content(root, own, own, 2, made)  # nothing of a single page is constant
    return "\n\n".join(text_blocks(element, constant, element.tag not in ("html", "body")))


# --- Spark


@lru_cache(maxsize=256)
def loaded(blob: str) -> list:
    return json.loads(blob)


def host_of(url) -> F.Column:
    """Host of a URL column in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper): the template of all distinct pages of each host, as JSON. Pages without a host give none."""
    source = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).where("host <> '' and html <> ''")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                roots = [parse(x) for x in part.column("html").to_pylist()]
                texts = [digest("\n".join(text_blocks(r, frozenset(), False))) for r in roots]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(texts, pa.int64()), pa.array([json.dumps(template(r)) for r in roots], pa.string())], ["host", "text", "wrapper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(t) for t in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return made

        for batch in batches:
            for part in slices(batch, "wrapper"):
                for host, blob in zip(part.column("host").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                    t = json.loads(blob)
                    held[host] = fold(held[host], t) if host in held else t
                if len(held) > HELD_HOSTS:
                    yield out()
        if held:
            yield out()

    def merge(pdf):
        total = None
        for blob in pdf["wrapper"]:
            t = json.loads(blob)
            total = t if total is None else fold(total, t)
        return pdf.iloc[:1].assign(wrapper=json.dumps(total))[["host", "wrapper"]]

    # pages of equal text are one page; only templates are shuffled
    distinct = source.mapInArrow(single, "host string, text long, wrapper string").groupBy("host", "text").agg(F.min("wrapper").alias("wrapper"))
    partial = distinct.select("host", "wrapper").mapInArrow(run, "host string, wrapper string")
    # two rounds of about the same fan-in
    fan_in = isqrt(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    some = partial.withColumn("salt", F.spark_partition_id() % fan_in).groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract_text(pages: DataFrame, url: str = "url", page: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page.

    A null or empty page has an empty text; a page without a host, or of a host with few pages, is read by element names
    alone. Rows are independent: repeated rows give repeated results, an empty table an empty one. Other columns pass
    through; an input column with the name of the result is replaced.
    """
    spark = pages.sparkSession
    wrappers = materialise(induce(pages, url, page))
    total = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    host, html_, own, salt = (fresh(pages, x) for x in ("__host", "__page", "__wrapper", "__salt"))
    source = pages.withColumns({host: host_of(F.col(url)), html_: F.col(page)})
    if total <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
    else:  # a host's pages are split by a salt, for which its wrapper is repeated
        table = None
        salted = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(own), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        source = source.withColumn(salt, F.pmod(F.xxhash64(html_), F.lit(SALTS)).cast("int")).join(salted, [host, salt], "left")
    kept = [f for f in pages.schema.fields if f.name != name]
    source = source.select(*(f.name for f in kept), host, html_, *([own] * (table is None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html_):
                blobs = [table.value.get(h) for h in part.column(host).to_pylist()] if table is not None else part.column(own).to_pylist()
                texts = [extract(x, loaded(b) if b else None) for x, b in zip(part.column(html_).to_pylist(), blobs, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), name])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.StringType())]))
