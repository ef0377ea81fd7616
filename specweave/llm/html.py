"""HTML extraction by wrapper induction.

A host's wrapper is learned from ``REFERENCES`` different pages of it. Their DOM trees are
aligned by simple tree matching, the pages of one layout with each other: elements that all
of them have are the template, text that differs from page to page, and elements that only
some have, fill slots. The smallest template element whose slots hold all varying running text
(text outside links and boilerplate) is the content region, so that titles, leads and sections
beside an article's body stay with it; where <article> or <main> hold more than half of
what varies, the region is sought inside them. Where less than ``LITTLE`` of the text varies,
pages are copies of one article and all their text counts. Every page is read by the wrapper
of its host: the text of the region stays, all else goes.

Inside the region, text blocks that ``SHARE`` of the host's different articles of one layout
have at one place (and ``LEAST`` of them at least) are template, too. They are counted over
all pages of the host. Pages whose articles are equal count once, and the template of a
layout only goes if it is the smaller part of all its different articles, so copies of one
article stay whole; it goes from short and long pages alike.

Some of what varies is no article (menus, adverts, footers, forms, notices, comments): tags,
roles and class words tell it apart inside the region, and before the region is chosen.
Pages that no wrapper fits (hosts of fewer than ``LEAST`` different pages, other layouts)
are read by tags: <article>, <main>, or the element with most running text.

Trees are compared up to ``NODES`` elements, the outermost first, ``KIDS`` children of an
element and ``PAIRS`` pairs of elements; runs of like siblings (paragraphs, list items) are
one element. What lies beyond is text of the element above it and is read like all other.

Defined cases: null and empty html give an empty text; a null url is a host of its own;
markup may be cut off anywhere, end tags may lack, elements may be nested to any depth;
repeated rows give equal values; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, store, table

REFERENCES, LEAST = 8, 3
#: Share of elements that pages of one layout have in common.
ALIKE = 0.6
#: Share of the varying text that the region may leave outside where no rule on tags and words tells boilerplate.
LOOSE = 0.2
#: Share of the text of a layout's pages below which what varies does not tell template from article.
LITTLE = 0.1
#: Bounds of a comparison of trees: elements of either, children of an element, pairs.
NODES, KIDS, PAIRS = 4096, 256, 100_000
#: Like siblings that are one element in a comparison: these tags, and longer runs of any.
LISTED, RUN = frozenset("p li tr dt dd h1 h2 h3 h4 h5 h6 pre blockquote option".split()), 16
#: Share of a layout's different articles that have a template block.
SHARE = 0.5
#: Share of the text of a host's articles that the template may have.
MINOR = 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|select"
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Open elements that a start tag ends by itself.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
#: How far up such an end may reach.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NO_TEXT = frozenset("head script style textarea title noscript template iframe svg select nav footer aside form button input dialog menu object canvas audio video map".split())
#: What holds no text for readers, whatever the rules are.
ALWAYS = frozenset("head script style textarea title noscript template iframe svg select object canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup "
    "sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond share sharing social related recommended recommendations "
    "widget toolbar pagination pager login register skip hidden banner alert announcement toast".split()
)

STEMS = ("comment", "advert", "adsby", "sponsor", "cookie", "sidebar", "newsletter", "breadcrumb")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{RAW})\b(?P<rawattr>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|</(?P<end>[a-zA-Z][\w:-]*)[^>]*(?:>|\Z)|<(?P<start>[a-zA-Z][\w:-]*)(?P<attr>(?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*))(?:>|\Z)|<(?P<loose>[a-zA-Z][\w:-]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("attr", "kids", "tag", "up")

    def __init__(self, tag: str, attr: str, up: Node | None) -> None:
        self.tag, self.attr, self.up = tag, attr, up
        self.kids: list[Node | str] = []


def parse(source: str) -> Node:
    """A DOM tree, with the ends that HTML implies."""
    root = here = Node("html", "", None)
    at, seen = 0, set()
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            here.kids.append(source[at : m.start()])
        at = m.end()
        if tag := m["start"] or m["loose"]:
            tag = tag.lower()
            if tag == "html":
                continue
            if tag in BLOCK and tag != "option":
                x = here
                while x.up is not None and x.tag not in ("p", "button", "td", "th", "table") and x.tag not in BLOCK:
                    x = x.up
                if x.tag == "p":
                    here = x.up
            if tag in ENDS:
                x = here
                while x.up is not None and x.tag not in FENCE[tag] and x.tag not in ENDS[tag]:
                    x = x.up
                while x.up is not None and x.tag in ENDS[tag]:
                    here, x = x.up, x.up
            node = Node(tag, m["attr"] or "", here)
            here.kids.append(node)
            if tag not in VOID and not (m["attr"] or "").rstrip().endswith("/"):
                here = node
                seen.add(tag)
        elif (end := m["end"]) and end.lower() in seen:
            end, x = end.lower(), here
            while x.up is not None and x.tag != end:
                x = x.up
            if x.up is not None:
                here = x.up
    if at < len(source):
        here.kids.append(source[at:])
    return root


def _words(attr: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attr)} if attr else {}


def boilerplate(node: Node, in_article: bool) -> bool:
    """Whether a subtree is no article text, whatever it says."""
    if node.tag in NO_TEXT or node.tag == "header" and not in_article:
        return True
    if not node.attr or node.tag in ("html", "body"):
        return False
    a = _words(node.attr)
    if a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    named = {w for k in ("class", "id") for w in _NAME.findall(a.get(k, ""))}
    return bool(named & WORDS) or any(w.startswith(STEMS) and w != "commentary" for w in named) or "header" in named and not in_article


def blocks(node: Node, path: int = 0, in_article: bool = False, rules: bool = True) -> Iterator[tuple[int, str, Node]]:
    """(path hash, text, block element) of every block of a subtree that is not boilerplate."""
    held: list[str] = []
    for item in _walk(node, path, in_article, rules):
        if isinstance(item, str):
            held.append(item)
        else:
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                if text:
                    yield item[0], text, item[1]
                held = []


def _step(path: int, tag: str) -> int:
    return zlib.crc32(tag.encode(), path)


def _walk(node: Node, path: int, in_article: bool, rules: bool = True) -> Iterator[str | tuple[int, Node]]:
    """Strings, and a (path, element) wherever a block begins or ends; without recursion."""
    stack: list[tuple[Node, int, bool, Iterator]] = [(node, path, in_article, iter(node.kids))]
    block = [(path, node)]
    while stack:
        at, p, inside, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                yield kid
            elif kid.tag in ("br", "hr"):
                yield " " if kid.tag == "br" else block[-1]
            elif not (boilerplate(kid, inside) if rules else kid.tag in ALWAYS):
                q = _step(p, kid.tag)
                if kid.tag in BLOCK:
                    yield block[-1]
                    block.append((q, kid))
                stack.append((kid, q, inside or kid.tag in ("article", "main"), iter(kid.kids)))
                break
            elif kid.tag in BLOCK:
                yield block[-1]
            else:
                yield " "
        else:
            stack.pop()
            if at.tag in BLOCK and len(block) > 1 and block[-1][1] is at:
                yield block.pop()
    yield block[0]


def _find(root: Node, test) -> list[tuple[Node, int]]:
    """Topmost elements that pass, with their path hash, outside boilerplate."""
    found, todo = [], [(root, 0)]
    while todo:
        node, path = todo.pop()
        for kid in reversed(node.kids):
            if isinstance(kid, Node):
                q = _step(path, kid.tag)
                if test(kid):
                    found.append((kid, q))
                elif not boilerplate(kid, False):
                    todo.append((kid, q))
    return found[::-1]


def _size(node: Node, path: int) -> int:
    return sum(len(t) for _, t, _ in blocks(node, path, True))


def main(node: Node) -> bool:
    """Whether an element says that it is the page's main part."""
    return node.tag == "main" or "main" in node.attr and _words(node.attr).get("role") == "main" or "articlebody" in node.attr.lower()


def tells(node: Node) -> bool:
    return node.tag == "article" and not boilerplate(node, True) or main(node)


def container(root: Node) -> list[tuple[Node, int]]:
    """The elements that hold the article, by tags: <article>, <main>, or the densest."""
    for test in (lambda n: n.tag == "article" and not boilerplate(n, True), main):
        found = _find(root, test)
        if len(found) > 1:
            sizes = [_size(*f) for f in found]
            if max(sizes) > sum(sizes) / 2:
                found = [found[sizes.index(max(sizes))]]
        if found:
            return found
    return [dense(root)]


def label(node: Node) -> str:
    """Tag and class words, but those with digits, which number things."""
    if not node.attr:
        return node.tag
    a = _words(node.attr)
    return " ".join([node.tag, *sorted({w for k in ("class", "id") for w in _NAME.findall(a.get(k, "")) if w.isalpha()})])


def region(root: Node, wanted: int, rules: bool = True) -> list[tuple[Node, int]]:
    """The elements at a labelled path."""
    todo, found = [(root, 0, False)], []
    while todo:
        node, path, inside = todo.pop()
        if path == wanted:
            found.append((node, path))
            continue
        for k in reversed(node.kids):
            if isinstance(k, Node) and k.tag in BLOCK and not (boilerplate(k, inside) if rules else k.tag in ALWAYS):
                todo.append((k, _step(path, label(k)), inside or k.tag in ("article", "main")))
            elif isinstance(k, Node) and k.tag not in BLOCK and k.kids:
                todo.append((k, path if path != wanted else 0, inside))
    return found


def dense(root: Node) -> tuple[Node, int]:
    """The innermost element with all headings, paragraphs and items outside links and boilerplate, and four fifths of the other text."""
    weight: dict[int, int] = {}  # characters, and of those in LISTED elements
    prose: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and k.tag != "a" and not boilerplate(k, False)]
    for node in reversed(order):
        weight[id(node)] = sum(len(k.strip()) if isinstance(k, str) else weight.get(id(k), 0) for k in node.kids)
        prose[id(node)] = weight[id(node)] if node.tag in LISTED else sum(prose.get(id(k), 0) for k in node.kids if isinstance(k, Node))
    node, path = root, 0
    while True:
        best = max((k for k in node.kids if isinstance(k, Node)), key=lambda k: weight.get(id(k), 0), default=None)
        if best is None or not weight.get(id(best)) or weight[id(best)] < 0.8 * weight[id(root)] or prose[id(best)] < prose[id(node)]:
            return node, path
        if best.tag not in BLOCK or best.tag in ("p", "li", "td", "h1", "h2", "h3"):
            return node, path
        node, path = best, _step(path, best.tag)


# --- wrappers ----------------------------------------------------------------------------


class Sketch(Node):
    """An element of a tree made for comparison: its labelled path, a hash of its own text, and the elements it stands for."""

    __slots__ = ("label", "nodes", "own", "path")

    def __init__(self, tag: str, name: str, path: int, up: Node | None, nodes: list[Node]) -> None:
        super().__init__(tag, "", up)
        self.label, self.path, self.nodes = name, path, nodes
        self.own: int | None = None


def sketch(root: Node, rules: bool = True, limit: int = NODES) -> Sketch:
    """Block elements and their running text, without links and what rules call boilerplate; limit elements at most.

    Runs of like siblings are one element: of paragraphs, items and the like always, of other elements if they are long.
    """
    top = Sketch(root.tag, root.tag, 0, None, [root])
    todo, held = deque([(top, False)]), 1
    while todo:
        s, inside = todo.popleft()
        runs: list[tuple[str, list[Node]]] = []
        stack = [iter(n.kids) for n in reversed(s.nodes)]
        while stack:
            for kid in stack[-1]:
                if isinstance(kid, str):
                    if text := " ".join(kid.split()):
                        s.kids.append(text)
                elif kid.tag == "a" or kid.tag in VOID or (boilerplate(kid, inside) if rules else kid.tag in ALWAYS):
                    continue
                elif kid.tag not in BLOCK or held + len(runs) >= limit:
                    stack.append(iter(kid.kids))
                    break
                elif runs and runs[-1][0] == (name := label(kid)):
                    runs[-1][1].append(kid)
                else:
                    runs.append((label(kid), [kid]))
            else:
                stack.pop()
        s.own = zlib.crc32(" ".join(k for k in s.kids if isinstance(k, str)).encode("utf-8", "surrogatepass"))
        for name, alike in runs:
            for nodes in [alike] if alike[0].tag in LISTED or len(alike) > RUN or held + len(alike) > limit else [[n] for n in alike]:
                kid = Sketch(nodes[0].tag, name, _step(s.path, name), s, nodes)
                s.kids.append(kid)
                held += 1
                todo.append((kid, inside or kid.tag in ("article", "main")))
    return top


def _own(node: Node) -> str:
    return " ".join("".join(k for k in node.kids if isinstance(k, str)).split())


def _children(node: Node) -> list[Node]:
    return [k for k in node.kids if isinstance(k, Node)][:KIDS]


def _align(p: list[Node], q: list[Node], weight: dict[tuple[int, int], int]) -> list[list[int]]:
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, u in enumerate(p, 1):
        row, above = best[i], best[i - 1]
        for j, v in enumerate(q, 1):
            row[j] = max(row[j - 1], above[j], above[j - 1] + weight.get((id(u), id(v)), 0))
    return best


def match(a: Node, b: Node, pairs: int = PAIRS) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of nodes of the heaviest alignment that keeps order and parents.

    Two nodes may match if their tags do; equal own text makes a match heavier. With more
    than ``pairs`` pairs to weigh, those below the last ones weighed count as different.
    """
    weight: dict[tuple[int, int], int] = {}
    todo, own = [(a, b, False)], {}
    left = pairs

    def text(n: Node):
        if isinstance(n, Sketch):
            return n.own
        if id(n) not in own:
            own[id(n)] = _own(n)
        return own[id(n)]

    while todo:
        x, y, ready = todo.pop()
        p, q = _children(x), _children(y)
        if ready:
            weight[id(x), id(y)] = _align(p, q, weight)[-1][-1] + 1 + (text(x) is not None and text(x) == text(y))
        elif x.tag == y.tag:
            todo.append((x, y, True))
            below = [(u, v, False) for u in p for v in q if u.tag == v.tag] if len(p) * len(q) <= left else []
            left -= len(p) * len(q) if below else 0
            todo += below
    if (id(a), id(b)) not in weight:
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        p, q = _children(x), _children(y)
        best, i, j = _align(p, q, weight), len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                todo.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
    return out


def _nodes(top: Node) -> list[Node]:
    """All elements, parents first."""
    out = [top]
    for n in out:
        out += [k for k in n.kids if isinstance(k, Node)]
    return out


def layouts(trees: list[Sketch]) -> list[tuple[Sketch, list[dict[int, Sketch]], list[Sketch]]]:
    """Pages of one layout: the first, and each other with its partners of the first's elements."""
    found: list[tuple[Sketch, list[dict[int, Sketch]], list[Sketch]]] = []
    for t in trees:
        size = len(_nodes(t))
        for first, partners, members in found:
            pairs = match(first, t)
            if 2 * len(pairs) >= ALIKE * (size + len(_nodes(first))):
                partners.append({id(x): y for x, y in pairs})
                members.append(t)
                break
        else:
            found.append((t, [], [t]))
    return found


def content(first: Sketch, partners: list[dict[int, Sketch]], members: list[Sketch], loss: float = 0.0) -> tuple[Sketch, set[int], dict[int, set[str]]] | None:
    """The smallest template element whose slots hold all varying text but a share of ``loss``; the template, and its elements' constant texts.

    Where an element that says it is the article holds more than half of what varies, only its inside counts.
    """
    order = _nodes(first)
    template = {id(n) for n in order if all(id(n) in p for p in partners)}
    texts = lambda n: {k for k in n.kids if isinstance(k, str)}
    always = {id(n): set.intersection(*(texts(p[id(n)]) for p in partners), texts(n)) for n in order if id(n) in template}
    mass, whole = Counter(), Counter()
    for page, p in zip(members, [{i: n for n in order if (i := id(n)) in template}, *partners], strict=True):
        back = {id(y): x for x, y in p.items() if x in template}
        holder: dict[int, int] = {}  # the template element that an element is, or lies in
        for n in _nodes(page):
            at = holder[id(n)] = back.get(id(n), holder.get(id(n.up), id(first)) if n.up is not None else id(first))
            same = always[at] if id(n) in back else ()
            mass[at] += sum(len(k) for k in n.kids if isinstance(k, str) and k not in same)
            whole[at] += sum(len(k) for k in n.kids if isinstance(k, str))
    mass = whole if mass.total() < LITTLE * whole.total() else mass
    if not mass.total():
        return None
    for n in reversed(order):
        if n.up is not None:
            mass[id(n.up)] += mass[id(n)]
    told = [n for n in order if id(n) in template and tells(n.nodes[0])]
    here = max(told, key=lambda n: mass[id(n)], default=first)
    here = here if 2 * mass[id(here)] > mass[id(first)] else first
    while True:
        best = max((k for k in here.kids if isinstance(k, Node) and id(k) in template), key=lambda k: mass[id(k)], default=None)
        if best is None or mass[id(best)] < (1 - loss) * mass[id(here)] or best.tag in LISTED and best.tag != "tr":
            return here, template, always
        here = best


def induce(pages: list[str], rules: bool = True) -> list[list]:
    """The wrapper of pages of one host: for every layout, the commonest first, the labelled path of the content region and the template.

    A template is a list of elements, parents first: place of the parent, tag, hash of the
    own text (null where it varies), and whether it is the region. It is left out where the
    path alone tells the region.
    """
    trees = [sketch(parse(p), rules) for p in dict.fromkeys(pages)]
    found = sorted((x for x in layouts(trees) if len(x[2]) >= LEAST), key=lambda x: -len(x[2]))
    out = []
    for first, partners, members in found:
        got = content(first, partners, members, 0.0 if rules else LOOSE)
        if got is None:
            continue
        here, template, always = got
        if len(found) == 1 and sum(n.path == here.path for n in _nodes(first)) == 1:
            out.append([here.path, None])
            continue
        flat, at = [], {None: -1}
        for n in _nodes(first):
            if id(n) in template:
                at[id(n)] = len(flat)
                varies = any(k not in always[id(n)] for k in n.kids if isinstance(k, str))
                flat.append([at[id(n.up) if n.up is not None else None], n.tag, None if varies else n.own, n is here])
        out.append([here.path, flat])
    return out


class Wrapper:
    """What induce() learned, ready to read pages by."""

    def __init__(self, layouts: list[list] | None) -> None:
        self.layouts = []
        for path, flat in layouts or ():
            nodes: list[Sketch] = []
            wanted = None
            for up, tag, own, here in flat or ():
                n = Sketch(tag, tag, 0, nodes[up] if up >= 0 else None, [])
                n.own = own
                if up >= 0:
                    nodes[up].kids.append(n)
                nodes.append(n)
                wanted = n if here else wanted
            self.layouts.append((path, nodes, wanted))

    def find(self, root: Node, rules: bool = True) -> list[tuple[Node, int]]:
        """The elements of root that hold the article, with their paths; none if the page is of no known layout."""
        if len(self.layouts) == 1 and not self.layouts[0][1]:
            return region(root, self.layouts[0][0], rules)
        best, found, page = 0.0, [], None
        for _, nodes, wanted in self.layouts:
            page = page or sketch(root, rules)
            pairs = match(nodes[0], page)
            share = len(pairs) / len(nodes)
            partner = next((y for x, y in pairs if x is wanted), None)
            if partner is not None and share >= ALIKE and share > best:
                best, found = share, [(n, partner.path) for n in partner.nodes]
        return found


def _key(path: int, text: str) -> int:
    return path << 31 | zlib.crc32(text.encode("utf-8", "surrogatepass")) >> 1


def article(root: Node, wrapper: Wrapper | None, rules: bool = True) -> tuple[int, list[tuple[int, str, Node]]]:
    """Layout, the path of what holds the article, and its blocks. Where no wrapper fits, by tags."""
    found = wrapper.find(root, rules) if wrapper is not None else []
    read = [b for node, path in found for b in blocks(node, path, True, rules)]
    if not read:
        found = container(root) if rules else [(root, 0)]
        read = [b for node, path in found for b in blocks(node, path, True, rules)]
    return found[0][1], read


def extract(source: str | None, constant: frozenset[int] = frozenset(), wrapper: Wrapper | None = None, rules: bool = True) -> str:
    """The article's text: its blocks in page order, one on a line."""
    if not source:
        return ""
    return "\n".join(t for p, t, _ in article(parse(source), wrapper, rules)[1] if _key(p, t) not in constant)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


class _Known(dict):
    """What JSON texts stand for; the last few hundred are kept."""

    def __init__(self, kind) -> None:
        super().__init__()
        self.kind = kind

    def __missing__(self, text: str | None):
        if len(self) > 256:
            self.clear()
        self[text] = None if text is None else self.kind(json.loads(text))
        return self[text]


def wrappers(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """host, constant (keys), learned (what induce() gives, as JSON): one row a host. pages: host, page_id, html."""
    prepare(pages.sparkSession)
    full = pages.where(F.trim(F.translate("html", "\t\r\n\f", "    ")) != "").withColumn("digest", F.md5("html"))
    # one row a different page of a host before the rank: copies take no places
    ranked = full.groupBy("host", "digest").agg(F.min("page_id").alias("least")).withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy("digest")))
    # a written table: Spark knows its size and sends it to the pages only if it is small
    chosen = store(ranked.where(F.col("rank") <= references).select("host", "digest", "least"), "references")
    rows = full.join(chosen, (full["host"] == chosen["host"]) & (full["digest"] == chosen["digest"]) & full["page_id"].eqNullSafe(chosen["least"]), "left_semi")
    picked = rows.groupBy("host", "digest").agg(F.first("html").alias("html")).select("host", "html")

    def learn(t: pa.Table) -> pa.Table:
        return pa.table({"host": [t.column("host")[0].as_py()], "learned": [json.dumps(induce(sorted(t.column("html").to_pylist())))]})

    learned = store(picked.groupBy("host").applyInArrow(learn, "host string, learned string"), "learned")
    return learned.join(_template(full.select("host", "html").join(learned, "host")), "host", "left").select("host", "constant", "learned")


def _template(pages: DataFrame) -> DataFrame:
    """host and constant, the keys of template blocks. pages: host, html, learned."""

    def count(batches):
        known = _Known(Wrapper)
        for b in batches:
            out = []
            for source, learned in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                layout, found = article(parse(source), known[learned])
                size = Counter()
                for p, t, _ in found:
                    size[_key(p, t)] += len(t)
                out.append((md5("\n".join(t for _, t, _ in found).encode("utf-8", "surrogatepass")).hexdigest(), layout, list(size), list(size.values())))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["host", "digest", "layout", "keys", "sizes"])

    each = pages.mapInArrow(count, "host string, digest string, layout long, keys array<long>, sizes array<long>")
    each = store(each.dropDuplicates(["host", "layout", "digest"]), "articles")
    whole = each.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("chars"))
    found = each.select("host", "layout", F.inline(F.arrays_zip("keys", "sizes"))).groupBy("host", "layout", "keys").agg(F.count(F.lit(1)).alias("n"), F.sum("sizes").alias("size"))
    found = found.where(F.col("n") >= LEAST).join(whole, ["host", "layout"]).where(F.col("n") >= SHARE * F.col("articles"))
    layouts = found.groupBy("host", "layout").agg(F.collect_list("keys").alias("keys"), F.sum("size").alias("size"), F.first("chars").alias("chars")).where(F.col("size") <= MINOR * F.col("chars"))
    return layouts.groupBy("host").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("constant"))


def extract_pages(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """page_id, url, text of every row of pages."""
    pages = pages.select("page_id", "url", "html").withColumn("host", _host("url"))
    # a written table has a size: small wrappers are broadcast, large ones are not
    learned = store(wrappers(pages, references), "wrappers")
    rows = pages.join(learned, "host", "left").select("page_id", "url", "html", "constant", "learned")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def run(batches):
        known, keys = _Known(Wrapper), _Known(frozenset)
        for b in batches:
            learned = b.column(4).to_pylist()
            constant = [json.dumps(c) if c else None for c in b.column(3).to_pylist()]
            out = [extract(h, keys[c] or frozenset(), known[w]) for h, c, w in zip(b.column(2).to_pylist(), constant, learned, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
