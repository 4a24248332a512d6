"""Main text of web pages by wrapper induction.

Pages of one host and layout (the names of their containers, boilerplate apart) form a group; its reference is its distinct
page with the smallest id. Every page's tree is aligned with its group's reference by simple tree matching; over all pages
of the group that are no copies or near copies of the reference, each reference node counts how often it is matched and how
often with the same text. Nodes that stay the same are template, matched nodes whose text varies are slots, and slots are
content; text of nodes that the reference lacks counts for their nearest matched ancestor. The region that holds content is
the smallest subtree with all of the slots' text; all of it is taken but for template nodes.

What varies can still be boilerplate: menus, footers, forms, scripts and the like are known by element or role. Names
(class, id) are weaker evidence: an element named like boilerplate is none where it holds half of its group's slots, or the
page's only article, main or h1. An article or main inside the region stands for it where it has half of the region's text.
A share of few pages is smoothed (``PRIOR``), so no number of pages turns templates on or off; a page that is alone, or
aligns with no slot, has as region the smallest subtree with all of its text outside boilerplate.

Null html is empty and has empty text. Null urls share one host. Repeated rows get equal results; groups of copies keep
their text. Trees may have any depth and any number of siblings; a tag whose quotes don't match ends at its first ``>``.
Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches, written

#: A node is template if ``same / (seen + PRIOR)`` is at least ``CONSTANT``: the prior stands for pages with another text.
PRIOR, CONSTANT = 2, 0.75
#: A page that has this share of its text from the reference is its near copy and no evidence.
NEAR_COPY = 0.8
#: Share of the slots (or of a region's text) that outweighs a name (or lets an article stand for its region).
OUTWEIGHS = 0.5
#: Bytes of templates up to which they are broadcast; beyond, pages and templates are joined.
BROADCAST_BYTES = 64 << 20
#: Cells of a table of best sums that are held at once; pairs of different children of two nodes whose subtrees are matched
#: beforehand (beyond these, unequal children with one tag count as one node in that table; those paired are matched in turn).
CELLS, PAIRS = 4_000_000, 250_000
#: Shapes and matches that a worker remembers.
REMEMBERED = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
#: Elements that end an open paragraph.
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_P_STOPS = {"article", "section", "div", "main", "body", "td", "li", "blockquote", "button"}
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = {"ul", "ol", "dl", "table", "tbody", "select", "menu"}
_NEVER = {"script", "style", "noscript", "template", "head", "title", "nav", "aside", "form", "button", "select", "input", "textarea", "iframe", "svg", "canvas", "object", "embed", "menu", "dialog", "xmp", "noframes", "option", "audio", "video", "map"}
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar", "tablist"}
#: Elements that are no nodes of the trees that are aligned.
_NEVER_TREE = {"script", "style", "noscript", "template", "head", "#text", "br", "wbr", "hr"}
_MARKS = ("article", "main", "h1")
#: Parts of a class or id (between hyphens, underscores, digits) that mark boilerplate, and whole names that do.
_NEVER_PART = re.compile(
    r"(?:^|[-_])(?:ads?|adv|advert\w*|adsense|adsbygoogle|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|footers?|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|notifications?|popup|modal|newsletter|subscribe|subscription|signup|paywall|comments?|commentlist|disqus|respond|replies|"
    r"share|sharing|social|related|recommend\w*|trending|pagination|pager|searchbox|skiplink|copyright|outbrain|taboola)(?:$|[-_\d])",
    re.I,
)
_NEVER_WHOLE = {"header", "site-header", "page-header", "foot", "side", "aside", "banner", "alert", "login", "search", "toolbar", "disclaimer", "tags", "discussion", "hidden", "overlay", "crumbs", "popular", "ad"}
#: Names that tell of a part's presence or absence elsewhere, as of a layout.
_LAYOUT = re.compile(r"(?:^|[-_])(?:has|have|no|not|with|without)[-_]", re.I)
#: ``Node.boiler`` of elements that only their class or id marks.
BY_NAME = 2


class Node:
    """An element or a stretch of text. ``number`` is its place among the nodes that are aligned, or -1."""

    __slots__ = ("tag", "kids", "text", "boiler", "number", "at", "end")

    def __init__(self, tag: str, text: str = "", boiler: int = False):
        self.tag, self.kids, self.text, self.boiler, self.number, self.at, self.end = tag, [], text, boiler, -1, 0, 0


def _named(value: str, tag: str, inside: str) -> bool:
    for word in value.lower().split():
        if word in _NEVER_WHOLE:
            return True
        if not _LAYOUT.search(word) and (m := _NEVER_PART.search(word)) and (tag != "article" or inside in ("article", "main") or "comment" in m[0]):
            return True
    return False


def _boiler(tag: str, attributes: str, inside: str) -> int:
    """Whether an element is boilerplate; ``BY_NAME`` where nothing but its class or id says so."""
    if tag in _NEVER or tag == "footer" or (tag == "header" and inside not in ("article", "main", "section")):
        return True
    if not attributes.strip():
        return False
    named = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in _NEVER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "h1"):
            named = named or _named(value, tag, inside)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return BY_NAME if named else False


def parse(page: str | None) -> Node:
    """The tree of a page; forgiving, as browsers are: what is not closed ends with its parent."""
    root = Node("#root")
    stack, at, raw = [root], 0, None
    open_tags: dict[str, int] = defaultdict(int)  # so that an end tag that closes nothing is no search
    sections: list[tuple[int, str]] = []  # (depth, tag) of open article, main and section elements

    def cut(i: int) -> None:
        for n in stack[i:]:
            open_tags[n.tag] -= 1
        del stack[i:]
        while sections and sections[-1][0] >= i:
            sections.pop()

    def close(tags: set, stops: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i)
                return
            if stack[i].tag in stops:
                return

    while page and at <= len(page):
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if m is None else m.start()
            raw = None
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(Node("#text", text))
        if m is None:
            break
        at = m.end()
        if m[1]:
            stack[-1].kids.append(Node("#text", html.escape(m[1], quote=False)))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if tag in _INLINE and stack[i].tag not in _INLINE:
                        break
            continue
        if tag in _ENDS_P and open_tags["p"] > 0:
            close({"p"}, _P_STOPS)
        if tag in _ITEMS and any(open_tags[t] > 0 for t in _ITEMS[tag]):
            close(_ITEMS[tag], _LISTS)
        attributes = m[4] or ""
        node = Node(tag, boiler=_boiler(tag, attributes, sections[-1][1] if sections else ""))
        stack[-1].kids.append(node)
        if tag in _RAW or tag not in _VOID and not attributes.rstrip().endswith("/"):
            raw = tag if tag in _RAW else None
            if tag in ("article", "main", "section"):
                sections.append((len(stack), tag))
            open_tags[tag] += 1
            stack.append(node)
    _open_wrappers(root)
    at, todo = 0, [(root, False)]
    while todo:
        n, done = todo.pop()
        if done:
            n.end = at
            continue
        n.at = at
        at += 1
        todo.append((n, True))
        todo += [(k, False) for k in reversed(n.kids)]
    return root


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def _look(top: Node) -> tuple[int, bool, list[Node]]:
    """(characters, whether an article, main or h1 is there, named elements) inside a node, outside further boilerplate."""
    chars, mark, named, todo = 0, False, [], [*top.kids]
    while todo:
        n = todo.pop()
        if n.tag == "#text":
            chars += _length(n.text)
        elif n.boiler == BY_NAME:
            named.append(n)
        elif not n.boiler:
            mark = mark or n.tag in _MARKS
            todo += n.kids
    return chars, mark, named


def _open_wrappers(root: Node) -> None:
    """Take back the class or id as evidence against elements that hold the page's content.

    These are elements with an article, main or h1 and more text than all the page outside boilerplate, which has no such
    mark; and, where nothing at all would be left of a page, the element with the most text.
    """
    left, mark, named = _look(root)
    frontier = [(*_look(n), n) for n in named]
    while frontier and not mark:
        held = [x for x in frontier if x[1] or x[3].tag in _MARKS]
        best = max(held or ([] if left else frontier), key=lambda x: x[0], default=None)
        if best is None or left and best[0] <= left:
            return
        if not best[0]:  # an element whose text lies in further ones like it has none of its own: they are opened one after the other
            best = next((x for x in frontier if x[2]), None)
            if best is None:
                return
        best[3].boiler = False
        left, mark = left + best[0], best[1] or best[3].tag in _MARKS
        frontier = [x for x in frontier if x is not best] + [(*_look(n), n) for n in best[2]]


def blocks(node: Node, skip=frozenset()) -> list[str]:
    """Texts of the blocks below a node, references decoded, white space one space; boilerplate and skipped numbers left out."""
    out, line = [], []

    def end() -> None:
        if text := " ".join(html.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    todo: list = [*reversed(node.kids)] if node.tag != "#text" else [node]
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif n.tag == "#text":
            line.append(n.text)
        elif n.tag == "br":
            line.append(" ")
        elif not n.boiler and not (n.number >= 0 and n.number in skip):
            if n.tag in _INLINE:
                todo += reversed(n.kids)
            else:
                end()
                todo.append(None)
                todo += reversed(n.kids)
    end()
    return out


class Shapes:
    """Trees of elements by number: equal subtrees have one number, whatever their texts. Matches are remembered by pair."""

    def __init__(self):
        self.of: dict = {}
        self.tag, self.kids, self.size = [], [], []
        self.matches: dict = {}
        self.templates: dict = {}

    def number(self, tag: str, kids: tuple) -> int:
        if (n := self.of.get((tag, kids))) is None:
            n = self.of[tag, kids] = len(self.tag)
            self.tag.append(tag)
            self.kids.append(kids)
            self.size.append(1 + sum(map(self.size.__getitem__, kids)))
        return n

    def of_tree(self, nodes: list[Node]) -> list[int]:
        """The shape of each of a page's numbered nodes."""
        out = [0] * len(nodes)
        for n in reversed(nodes):
            out[n.number] = self.number(n.tag, tuple(out[k.number] for k in n.kids if k.number >= 0))
        return out

    def match(self, a: int, b: int) -> tuple[int, tuple]:
        """Simple tree matching: (size of the largest top-down match, matched child index pairs)."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.matches:
                todo.pop()
                continue
            if self.tag[x] != self.tag[y]:
                self.matches[x, y] = 0, ()
                continue
            lo, i, j = self._ends(x, y)
            p, q = sorted(set(self.kids[x][lo:i])), sorted(set(self.kids[y][lo:j]))
            wanted = [(s, t) for s in p for t in q if (s, t) not in self.matches] if len(p) * len(q) <= PAIRS else []
            if wanted:
                todo += wanted
                continue
            self.matches[x, y] = self._joined(x, y, lo, i, j, p, q)
        return self.matches[a, b]

    def _ends(self, x: int, y: int) -> tuple[int, int, int]:
        """Equal children at either end always match one another: (first, last of x, last of y) of what is between."""
        a, b = self.kids[x], self.kids[y]
        lo, i, j = 0, len(a), len(b)
        while lo < i and lo < j and a[lo] == b[lo]:
            lo += 1
        while i > lo and j > lo and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        return lo, i, j

    def _joined(self, x: int, y: int, lo: int, i: int, j: int, p: list[int], q: list[int]) -> tuple[int, tuple]:
        a, b = self.kids[x], self.kids[y]
        pairs = [(k, k) for k in range(lo)]
        if i > lo and j > lo:
            if len(p) * len(q) <= PAIRS:
                worth = np.array([[self.matches[s, t][0] for t in q] for s in p], np.int64)
            else:
                tags = {t: k for k, t in enumerate({self.tag[s] for s in (*p, *q)})}
                of = lambda xs: np.array([tags[self.tag[s]] for s in xs])
                worth = (of(p)[:, None] == of(q)) * np.where(np.array(p)[:, None] == np.array(q), np.array([self.size[s] for s in p])[:, None], 1)
            place_p, place_q = {s: k for k, s in enumerate(p)}, {t: k for k, t in enumerate(q)}
            rows, cols = np.array([place_p[s] for s in a[lo:i]]), np.array([place_q[t] for t in b[lo:j]])
            pairs += [(lo + r, lo + c) for r, c in in_order(worth, rows, cols)]
        pairs += [(i + k, j + k) for k in range(len(a) - i)]
        return 1 + sum(self.size[a[r]] if a[r] == b[c] else self.matches.get((a[r], b[c]), (1,))[0] for r, c in pairs), tuple(pairs)


def in_order(worth: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (r, c), both rising, that are worth most in all; pair (r, c) is worth ``worth[rows[r], cols[c]]``.

    A row of the table of best sums at a time; beyond ``CELLS`` the rows are halved where the best way passes, so memory is bounded.
    """
    out, todo = [], [(0, len(rows), 0, len(cols))]
    while todo:
        r0, r1, c0, c1 = todo.pop()
        if r0 >= r1 or c0 >= c1:
            continue
        if (r1 - r0) * (c1 - c0) <= CELLS or r1 - r0 == 1:
            out += [(r0 + r, c0 + c) for r, c in _best_way(worth, rows[r0:r1], cols[c0:c1])]
            continue
        mid = (r0 + r1) // 2
        ahead = _sums(worth, rows[r0:mid], cols[c0:c1])
        behind = _sums(worth, rows[mid:r1][::-1], cols[c0:c1][::-1])[::-1]
        c = c0 + int(np.argmax(ahead + behind))
        todo += [(mid, r1, c, c1), (r0, mid, c0, c)]
    return sorted(out)


def _sums(worth: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    best = np.zeros(len(cols) + 1, np.int64)
    for r in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + worth[r][cols]))
    return best


def _best_way(worth: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    best = np.zeros((len(rows) + 1, len(cols) + 1), np.int32)
    for k, r in enumerate(rows):
        best[k + 1, 1:] = np.maximum.accumulate(np.maximum(best[k, 1:], best[k, :-1] + worth[r][cols]))
    r, c, found = len(rows), len(cols), []
    while r and c:
        w = int(worth[rows[r - 1], cols[c - 1]])
        if w and best[r, c] == best[r - 1, c - 1] + w:
            r, c = r - 1, c - 1
            found.append((r, c))
        elif best[r, c] == best[r - 1, c]:
            r -= 1
        else:
            c -= 1
    return found[::-1]


_known = Shapes()


def shapes() -> Shapes:
    """This worker's shapes; begun anew between pages once there are many."""
    global _known
    if len(_known.tag) + len(_known.matches) > REMEMBERED:
        _known = Shapes()
    return _known


def elements(root: Node) -> list[Node]:
    """The nodes that are aligned, in page order, numbered: elements that are neither inline nor below known boilerplate."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.number = len(out)
        out.append(n)
        if n.boiler is not True:
            todo += [k for k in reversed(n.kids) if k.tag not in _NEVER_TREE and k.tag not in _INLINE]
    return out


def align(known: Shapes, reference: int, page: list[Node], of: list[int]) -> dict[int, int]:
    """Reference node number -> page node number, for matched nodes. ``reference`` is a shape; numbers are in page order."""
    found: dict[int, int] = {}
    todo = [(reference, 0, 0)] if known.tag[reference] == page[0].tag else []
    while todo:
        a, number, b = todo.pop()
        found[number] = b
        kids = [k.number for k in page[b].kids if k.number >= 0]
        first = [number + 1]
        for k in known.kids[a]:
            first.append(first[-1] + known.size[k])
        todo += [(known.kids[a][i], first[i], kids[j]) for i, j in known.match(a, of[b])[1]]
    return found


def own_texts(nodes: list[Node]) -> list[str]:
    """Each node's text outside the numbered nodes below it."""
    out = []
    for n in nodes:
        parts, todo = [], [] if n.boiler is True else [*reversed(n.kids)]
        while todo:
            k = todo.pop()
            if k.tag == "#text":
                parts.append(k.text)
            elif k.tag == "br":
                parts.append(" ")
            elif k.number < 0 and k.tag not in _NEVER_TREE and not k.boiler:
                todo += reversed(k.kids)
        out.append(" ".join(html.unescape("".join(parts)).split()))
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "little")


def host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def layout() -> Column:
    """A digest of the names that a page's containers have, without digits and without names of boilerplate."""
    tags = F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit(r"<(?:div|section|main|article)\b[^<>]*\bclass\s*=\s*[\"']?([^\"'<>]*)"), 1)
    names = F.transform(tags, lambda x: F.regexp_replace(x, r"\d+", ""))
    kept = F.filter(names, lambda x: ~x.rlike(_NEVER_PART.pattern) & ~x.isin(*sorted(_NEVER_WHOLE)))
    return F.md5(F.array_join(F.array_sort(F.array_distinct(kept)), "\n"))


def keyed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, key): pages with their group, which is host and layout."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.concat_ws("\n", layout(), host()).alias("key"))


def references(pages: DataFrame) -> DataFrame:
    """(key, tree): the reference page of each group of ``keyed`` pages: its nodes' tags, sizes and text digests as JSON."""
    first = written(pages.groupBy("key").agg(F.min(F.struct("page_id", F.md5("html").alias("md5"))).alias("r")).select("key", "r.*"))
    first = F.broadcast(first) if first.count() * 200 <= BROADCAST_BYTES else first
    first = first.select(F.col("key").alias("__k"), F.col("page_id").alias("__p"), F.col("md5").alias("__m"))
    mine = pages.join(first, (F.col("key") == F.col("__k")) & F.col("page_id").eqNullSafe(F.col("__p")) & F.md5("html").eqNullSafe(F.col("__m"))).select("key", "html")

    def run(batch: pa.RecordBatch) -> dict:
        trees = []
        for h in batch.column("html").to_pylist():
            nodes, known = elements(parse(h)), shapes()
            of = known.of_tree(nodes)
            tree = {"tags": [n.tag for n in nodes], "sizes": [known.size[x] for x in of], "texts": [_digest(t) for t in own_texts(nodes)], "named": [n.number for n in nodes if n.boiler == BY_NAME]}
            trees.append(json.dumps(tree, separators=(",", ":")))
        return {"key": batch.column("key"), "tree": trees}

    return map_batches(mine, run, "key string, tree string").groupBy("key").agg(F.min("tree").alias("tree"))


def _unpacked(packed: str, known: Shapes) -> dict:
    """A tree from JSON, with its shape's number; remembered."""
    if (tree := known.templates.get(packed)) is None:
        if len(known.templates) > 5000:
            known.templates.clear()
        tree = known.templates[packed] = json.loads(packed)
        tags, sizes = tree["tags"], tree["sizes"]
        of: list[int] = [0] * len(tags)
        for i in range(len(tags) - 1, -1, -1):
            kids, at = [], i + 1
            while at < i + sizes[i]:
                kids.append(of[at])
                at += sizes[at]
            of[i] = known.number(tags[i], tuple(kids))
        tree["shape"] = of[0]
        if "nodes" in tree:
            _decide(tree)
    return tree


class Templates:
    """Trees by group: a broadcast table where they are few, else a column of the pages."""

    def __init__(self, trees: DataFrame):
        size = trees.agg(F.coalesce(F.sum(F.length("tree") + F.length("key")), F.lit(0))).first()[0]
        self.trees = trees
        self.table = None
        if size <= BROADCAST_BYTES:
            self.table = trees.sparkSession.sparkContext.broadcast({r["key"]: r["tree"] for r in trees.collect()})

    def beside(self, pages: DataFrame) -> DataFrame:
        """``keyed`` pages with a column ``tree``, null where a broadcast table has it."""
        if self.table is not None:
            return pages.withColumn("tree", F.lit(None).cast("string"))
        return pages.join(self.trees, "key", "left")

    def reader(self):
        """A function from a batch to its trees, as packed; for workers."""
        table = self.table

        def read(batch: pa.RecordBatch) -> list[str | None]:
            if table is None:
                return batch.column("tree").to_pylist()
            return [table.value.get(k) for k in batch.column("key").to_pylist()]

        return read


COUNTS = ("seen", "same", "chars", "extra")


def evidence(pages: DataFrame, trees: Templates) -> DataFrame:
    """(key, node, seen, same, chars, extra): pages that match a reference node, those with its text, the characters of the others' texts, and those of unmatched nodes below it.

    Counts are summed for each batch before they are shuffled.
    """
    read = trees.reader()

    def run(batch: pa.RecordBatch) -> dict:
        count: dict = defaultdict(lambda: [0, 0, 0, 0])
        for key, packed, page in zip(batch.column("key").to_pylist(), read(batch), batch.column("html").to_pylist(), strict=True):
            if packed is None:
                continue
            known = shapes()
            tree, nodes = _unpacked(packed, known), elements(parse(page))
            texts = own_texts(nodes)
            digests = [_digest(t) for t in texts]
            found = align(known, tree["shape"], nodes, known.of_tree(nodes))
            alike = sum(len(texts[b]) for a, b in found.items() if digests[b] == tree["texts"][a])
            if alike >= NEAR_COPY * sum(map(len, texts)):
                continue
            for n, a in _unmatched(nodes, {b: a for a, b in found.items()}):
                count[key, a][3] += len(texts[n])
            for a, b in found.items():
                c = count[key, a]
                c[0] += 1
                if digests[b] == tree["texts"][a]:
                    c[1] += 1
                else:
                    c[2] += len(texts[b])
        keys = list(count)
        return {"key": [h for h, _ in keys], "node": [n for _, n in keys], **{k: [count[x][i] for x in keys] for i, k in enumerate(COUNTS)}}

    found = map_batches(trees.beside(pages).select("key", "tree", "html"), run, "key string, node long, seen long, same long, chars long, extra long")
    return found.groupBy("key", "node").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _unmatched(nodes: list[Node], matched: dict[int, int]) -> list[tuple[int, int]]:
    """(number, reference number of the nearest matched ancestor) of a page's unmatched nodes."""
    out, todo = [], [(nodes[0], -1)]
    while todo:
        n, above = todo.pop()
        if n.number in matched:
            above = matched[n.number]
        elif above >= 0:
            out.append((n.number, above))
        todo += [(k, above) for k in n.kids if k.number >= 0]
    return out


def templates(trees: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, tree): references with, for each node, the evidence over all pages of the group."""
    of = counts.groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("node", *COUNTS)))).alias("c"))
    grown = F.concat(F.expr("substring(tree, 1, length(tree) - 1)"), F.lit(',"nodes":'), F.coalesce("c", F.lit("[]")), F.lit("}"))
    return trees.join(of, "key", "left").select("key", grown.alias("tree"))


def _decide(tree: dict) -> None:
    """From the evidence: constant nodes, named nodes that are content after all, and the region (or None)."""
    n, sizes = len(tree["tags"]), tree["sizes"]
    tree["constant"] = {c["node"] for c in tree["nodes"] if c["same"] >= CONSTANT * (c["seen"] + PRIOR)}
    slots = np.zeros(n + 1, np.int64)
    for c in tree["nodes"]:
        slots[c["node"]] = c["extra"] + (0 if c["node"] in tree["constant"] else c["chars"])
    total = int(slots.sum())
    inside = lambda i: int(slots[i : i + sizes[i]].sum())
    tree["opened"] = {i for i in tree["named"] if total and inside(i) >= OUTWEIGHS * total}
    for i in tree["named"]:
        if i not in tree["opened"]:
            slots[i : i + sizes[i]] = 0
    upto = np.concatenate([[0], np.cumsum(slots)])
    total, tree["region"] = int(upto[-1]), None
    if total:
        whole = [i for i in range(n) if upto[i + sizes[i]] - upto[i] == total and tree["tags"][i] not in ("p", "li", "td", "h1", "h2", "h3")]
        tree["region"] = whole[-1] if whole else None


def extract(page: str | None, packed: str | None) -> str:
    """The main text of a page under its group's template."""
    root, known = parse(page), shapes()
    nodes = elements(root)
    skipped: set[int] = set()
    region = None
    if packed:
        t = _unpacked(packed, known)
        found = align(known, t["shape"], nodes, known.of_tree(nodes))
        for a in t["opened"]:
            if a in found and nodes[found[a]].boiler == BY_NAME:
                nodes[found[a]].boiler = False
        if t["region"] in found:
            region = nodes[found[t["region"]]]
        if t["constant"]:
            texts = own_texts(nodes)
            skipped = {b for a, b in found.items() if a in t["constant"] and _digest(texts[b]) == t["texts"][a] and not any(k.number >= 0 for k in nodes[b].kids)}
    inner = _chars(root)
    if region is None or region.boiler:
        region = _smallest(root, inner)
    # A mark around the region takes its place; one inside it does where it has half of its text.
    marked = [n for n in _visible(root) if n.tag in ("article", "main")]
    around = [n for n in marked if n.at <= region.at and region.end <= n.end]
    within = [n for n in marked if region.at < n.at and n.end <= region.end]
    regions = [around[-1]] if around else [region]
    if (articles := [n for n in within if n.tag == "article"] or within) and region.tag != "article":
        outer: list[Node] = []
        for n in articles:  # in page order
            if not outer or n.at >= outer[-1].end:
                outer.append(n)
        if sum(inner[n.at] for n in outer) >= OUTWEIGHS * inner[regions[0].at]:
            regions = outer
    texts = [b for n in regions for b in blocks(n, skipped)]
    return " ".join(texts or [b for n in regions for b in blocks(n)])


def _visible(root: Node) -> list[Node]:
    """Elements outside boilerplate, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.boiler:
            out.append(n)
            todo += [k for k in reversed(n.kids) if k.tag != "#text"]
    return out


def _chars(root: Node) -> dict[int, int]:
    """Characters outside boilerplate below each visible element, by place."""
    visible = _visible(root)
    out: dict[int, int] = {}
    for n in reversed(visible):
        out[n.at] = sum(_length(k.text) if k.tag == "#text" else out.get(k.at, 0) for k in n.kids)
    return out


def _smallest(root: Node, inner: dict[int, int]) -> Node:
    """The smallest element that holds all of the text outside boilerplate."""
    now = root
    while total := inner[now.at]:
        deeper = [k for k in now.kids if k.tag not in ("#text", "p", "li", "table", "ul", "ol") and k.tag not in _INLINE and inner.get(k.at, 0) >= total]
        if not deeper:
            break
        now = deeper[0]
    return now


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    pages = keyed(pages)
    trees = written(references(pages))
    found = Templates(written(templates(trees, evidence(pages, Templates(trees)))))
    read = found.reader()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(h, t) for h, t in zip(batch.column("html").to_pylist(), read(batch), strict=True)]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(found.beside(pages).select("page_id", "url", "html", "key", "tree"), run, "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.common import table

    return main_texts(table(spark, sf_dir, "pages"))
