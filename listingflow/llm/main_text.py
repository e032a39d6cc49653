"""Main text of web pages by wrapper induction.

A page becomes a tree of labelled nodes (tag, and the words of class and id that many of the host's pages use) in which like siblings are one repeating
node. The trees of a host's pages are aligned by simple tree matching (the best order-keeping match of equal labels) and
merged into the host's tree, each node with the number of pages that have it, the smallest and largest hash of
its own text, the length of that text and a sample of the distinct pages. A node is template if nearly all pages that have
its region have it with the same text, and nearly all of those that differ; else it is a slot. In an article, headings and
paragraphs are never template. Subtrees whose tag, or the last word of a class or id, says what they are (menus, headers,
footers, sidebars, notices, adverts, forms, comments) are template too, unless they hold the page's article or, on a page
without one, most of its text. Comments never are the text, however long: a node named for them stays out unless it has an
``h1``, or the page has neither an ``h1`` nor other text. A ``header`` in an article stays if it has the ``h1``. A host's pages with an article or main and those without have trees of their own. The main region is
the article, or without such a node, for each layout, the smallest container of most of the varying text; its slots are the
content. Of a page without a region of its host's, all that isn't template is content.

All pages count. A tree is as large as its layout: classes and ids of few of a host's pages and unknown tags don't tell nodes
apart, and above ``TREE_NODES`` nodes those on the fewest pages go. A wrapper holds only regions, template and what is above them. Tasks merge the trees of their pages before anything is shuffled; a host's partial trees meet first
in groups by a salt, then all. Each page is then aligned with its host's tree, which a join brings to it, and gives the
text of its content slots block by block.

Defined results: null and empty html, and pages without content, give the empty text. A null url, or one without
a host, counts as host "". Text that is the same on all pages is kept when fewer than ``MIN_PAGES`` pages
that differ have it, when all of a region is the same, and inside a line that varies. Broken markup is read to its end, as browsers read it: an unknown
declaration ends at ``>``, a comment that never closes takes the rest. Repeated rows are extracted one by one. Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, staged
from listingflow.llm.url_rules import host_of

MIN_PAGES = 3
NEARLY = 0.9  # share of a region's pages that have a template node
SAMPLE = 20  # marks of distinct pages that a node keeps
COMMON = 0.1  # share of a host's pages that use a class or id which tells its nodes apart
MASS = 0.7
NODES = 100_000  # nodes of partial trees that a task holds
TREE_NODES = 5_000  # nodes of a host's tree that are kept: those of most pages
SALT_TASKS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Tags that a start tag of the key closes when they are open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: An open tag of these ends the search for what a start tag closes.
SCOPES = frozenset("article aside body button div footer form header html main nav ol section table td th ul dl".split())
#: Never text of the page.
HIDDEN_TAGS = frozenset(
    "head script style noscript template iframe object svg math button select textarea input dialog menu canvas audio video".split()
)
#: These, and nodes named by the words below, are dropped unless they hold the page's text.
DROPPED_TAGS = frozenset("nav header footer aside form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo "
    "promoted related replies respond share sharing sidebar skip social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Those of them that say that readers wrote it.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: A name that has one of these says what a node does without, or lies beside.
NOT_NAMED = frozenset("no not non without with has have hide hides hidden show shows".split())
#: Other tags count as one, as code and placeholders in pages make up their own.
KNOWN_TAGS = (
    VOID | INLINE | SCOPES | HIDDEN_TAGS | DROPPED_TAGS
    | frozenset(
        "address blockquote caption center colgroup dd details dir dt fieldset figcaption figure frame frameset h1 h2 h3 h4 h5 "
        "h6 hgroup label legend li marquee noembed noframes optgroup option output p plaintext pre progress rb rtc search "
        "slot summary tbody tfoot thead title tr xmp".split()
    )
)
#: Text of these is content in an article, also where it is the same on all pages.
KEPT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("#page html body div section table tbody tr td center".split())
ROOT = "#page"


_COMMENT_END = re.compile("--!?>")


class Dom(HTMLParser):
    """The page's tree: nodes are [tag, label, children, whether named for comments]; children are nodes and strings."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

    def __init__(self, known=None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.unclosed = set()
        self.root = [ROOT, ROOT, [], False]
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open nodes of each tag
        self.scopes: list[int] = []

    def handle_starttag(self, tag, attrs):
        closed = {"head"} if tag == "body" else CLOSES.get(tag) or (() if tag in INLINE else {"p"})
        at = max((self.places[x][-1] for x in closed if self.places.get(x)), default=0)
        if at and at >= (self.scopes[-1] if self.scopes else 0):
            self.close_from(at)
        label, comments = _label(tag, attrs, self.known)
        node = [tag, label, [], comments]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in SCOPES:
                self.scopes.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void tags only

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def close_from(self, at):
        while len(self.open) > at:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


    # Comments and declarations end where browsers end them.

    def parse_comment(self, i, report=1):
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i)

    def parse_starttag(self, i):
        self.at = i
        return super().parse_starttag(i)

    def set_cdata_mode(self, elem):
        # An element of plain text that never closes is read as markup, so that what follows it isn't lost.
        if elem in self.unclosed:
            return
        if elem in ("script", "style") or re.compile(rf"</\s*{elem}\s*>", re.I).search(self.rawdata, self.at):
            super().set_cdata_mode(elem)
        else:
            self.unclosed.add(elem)


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())


def _label(tag, attrs, known):
    """The tag and those words of its class, id and role that are in ``known`` (None: all), ``!`` before what may be dropped;
    and whether it is named for readers' comments."""
    words, named, comments = set(), False, False
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.split():
                found = _words(token)
                words.update(found)
                if found and found[-1] in DROPPED_WORDS and NOT_NAMED.isdisjoint(found):
                    named, comments = True, comments or found[-1] in COMMENT_WORDS
    named = named and tag not in ("body", "html") and tag not in MAIN_TAGS
    mark = "!" if tag in HIDDEN_TAGS or tag in DROPPED_TAGS or named else ""
    label = mark + " ".join([tag if tag in KNOWN_TAGS else "#other", *sorted(words if known is None else words & known)])
    return label, named and comments


def parsed(html: str, known=None):
    dom = Dom(known)
    dom.feed(html)
    dom.close()
    _keep_holders(dom.root)
    return dom.root


def _keep_holders(root) -> None:
    """Take the ``!`` from nodes that hold the page's article or main, or most of the text of one or of a page without.

    With an article or main outside of ``!`` nodes, those beside it stay as they are, whatever their size. Readers' comments
    count for nothing here, as they may be longer than what they are about: their text isn't the page's, an article in them is
    a comment, and a node named for them stays as it is. It is none if it has an ``h1``, or if the page has neither an ``h1`` nor
    text outside of ``!`` nodes. In an article, a ``header`` with an ``h1`` is its title.
    """
    order, own = [], []  # (node, place of its parent, place of its article); text, text not in ``!`` nodes, article and h1 in it
    stack = [(root, 0, 0, False)]
    while stack:
        node, parent, top, below = stack.pop()
        if node[0] in HIDDEN_TAGS:
            continue
        at, main = len(order), _is_main(node[1])
        below = below or dropped(node[1])
        if main and not below and not top:
            top = at
        order.append((node, parent, top))
        size = sum(len(child.strip()) for child in node[2] if isinstance(child, str))
        own.append((size, size, main, node[0] == "h1"))
        stack.extend((child, at, top, below) for child in node[2] if not isinstance(child, str))
    held, comments = _held(order, own, True)
    if comments and not held[0][1] and not held[0][3]:
        held, comments = _held(order, own, False)  # a page with no other text
    outside = any(top for _, _, top in order)
    for at, ((node, _, top), (text, _, main, titled)) in enumerate(zip(order, held, strict=True)):
        if not dropped(node[1]) or outside and not top or at in comments:
            continue
        if top:
            kept = 2 * text > held[top][0] or node[0] == "header" and titled
        else:
            kept = main if held[0][2] else 2 * text > held[0][0]
        if kept:
            node[1] = node[1][1:]


def _held(order, own, apart: bool):
    """What each node holds, and the nodes named for comments if they are ``apart``: these count for nothing above them."""
    held, comments = [list(x) for x in own], set()
    for at in range(len(order) - 1, 0, -1):
        (node, parent, _), mine = order[at], held[at]
        if apart and node[3] and not mine[3]:
            comments.add(at)
            continue
        above = held[parent]
        above[0] += mine[0]
        above[1] += 0 if dropped(node[1]) else mine[1]
        above[2] = above[2] or mine[2]
        above[3] = above[3] or mine[3]
    return held, comments


def dropped(label: str) -> bool:
    return label.startswith("!")


# Trees: [label, pages, smallest hash, largest hash, text length, children, smallest marks of distinct pages]


def collapsed(nodes: list):
    """Like nodes as one: [label, children by label, own text, nodes]."""
    children: dict[str, list] = {}
    text = []
    for node in nodes:
        for child in node[2]:
            if isinstance(child, str):
                text.append(child)
            else:
                children.setdefault(child[1], []).append(child)
    return [nodes[0][1], [collapsed(x) for x in children.values()], " ".join(" ".join(text).split()), nodes]


def tree_of(shape) -> list:
    tree = _unsigned(shape)
    _sign(tree, tree[6], False)
    return tree


def _unsigned(shape) -> list:
    """The tree with a hash of all text below a node in place of its marks."""
    label, children, text, _ = shape
    mark = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "big")
    kept = [] if dropped(label) else [_unsigned(x) for x in children]
    below = hash((mark, *[x[6] for x in kept if not dropped(x[0])])) % (1 << 48) if kept else mark
    return [label, 1, mark, mark, len(text), kept, below]


def _sign(tree, mark, inside) -> None:
    """Nodes are marked with the text of their article, or of the page: copies of one have equal marks."""
    if not inside and _is_main(tree[0]):
        mark, inside = tree[6], True
    tree[6] = [mark]
    for child in tree[5]:
        _sign(child, mark, inside)


def _marks(mine: list[int], other: list[int]) -> list[int]:
    if mine == other or len(mine) == SAMPLE and other[0] > mine[-1]:
        return mine
    return sorted({*mine, *other})[:SAMPLE]


def weight(a, b, child_of) -> int:
    """Simple tree matching: the size of the best match of two trees that keeps order and depth."""
    if a[0] != b[0]:
        return 0
    return 1 + _table(a[5], child_of(b), child_of)[-1][-1]


def _table(left, right, child_of):
    rows = [[0] * (len(right) + 1)]
    for a in left:
        row = [0]
        for j, b in enumerate(right):
            row.append(max(row[-1], rows[-1][j + 1], rows[-1][j] + weight(a, b, child_of)))
        rows.append(row)
    return rows


def aligned(left, right, child_of) -> list[tuple[int, int]]:
    """Places of matched children, in order."""
    labels = [x[0] for x in left]
    if labels == [x[0] for x in right] and len({*labels}) == len(labels):
        return [(i, i) for i in range(len(left))]
    rows, pairs, i, j = _table(left, right, child_of), [], len(left), len(right)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def merged(mine: list, other: list) -> list:
    """Two trees with equal labels at the top as one; what only one has is kept in place."""
    pairs = aligned(mine[5], other[5], lambda t: t[5])
    children, i, j = [], 0, 0
    for a, b in [*pairs, (len(mine[5]), len(other[5]))]:
        children += mine[5][i:a] + other[5][j:b]
        if a < len(mine[5]):
            children.append(merged(mine[5][a], other[5][b]))
        i, j = a + 1, b + 1
    values = [mine[0], mine[1] + other[1], min(mine[2], other[2]), max(mine[3], other[3]), mine[4] + other[4]]
    return [*values, children, _marks(mine[6], other[6])]


def size(tree: list) -> int:
    count, rest = 0, [tree]
    while rest:
        count += 1
        rest += rest.pop()[5]
    return count


def pruned(tree: list) -> list:
    """The tree, if it has more than ``TREE_NODES`` nodes with only those on the most pages, parents before children.

    What is cut is on few pages, so it is no template, and its text stays content.
    """
    counts, rest = [], [tree]
    while rest:
        node = rest.pop()
        counts.append(node[1])
        rest += node[5]
    if len(counts) <= TREE_NODES:
        return tree
    least = sorted(counts)[-TREE_NODES]  # all nodes on this many pages or fewer go: no tie depends on an order
    top = [*tree[:5], [], *tree[6:]]
    rest = [(tree, top)]
    while rest:
        node, copy = rest.pop()
        for x in node[5]:
            if x[1] > least:
                copy[5].append([*x[:5], [], *x[6:]])
                rest.append((x, copy[5][-1]))
    return top


def dumped(tree: list) -> str:
    """A tree of any depth as text: its nodes in page order, each with its number of children."""
    out, rest = [], [tree]
    while rest:
        node = rest.pop()
        out.append([*node[:5], len(node[5]), *node[6:]])
        rest += reversed(node[5])
    return json.dumps(out, separators=(",", ":"))


def loaded(text: str) -> list:
    nodes = json.loads(text)
    wanting = []
    for node in nodes:
        n, node[5] = node[5], []
        if wanting:
            wanting[-1][0][5].append(node)
            wanting[-1][1] -= 1
        wanting.append([node, n])
        while wanting and not wanting[-1][1]:
            wanting.pop()
    return nodes[0]


def any_depth() -> None:
    """Let the walks below go as deep as pages nest: calls between Python functions take no C stack."""
    sys.setrecursionlimit(1 << 30)


def wrapper(tree: list) -> list:
    """A host's tree as [label, kind, 0, 0, 0, children]: kind is ``region``, ``slot``, ``same`` (template) or ``drop``."""
    region = _regions(tree)

    masses: dict[int, int] = {}

    def weigh(t):
        total = t[4] if t[2] != t[3] else 0
        for x in t[5]:
            weigh(x)
            total += mass(x)
        masses[id(t)] = 0 if dropped(t[0]) else total

    def mass(t):
        return masses[id(t)]

    weigh(tree)

    if not region:
        region = _largest(tree, mass)
    tops = {id(x) for x in region}

    def mark(t, top, around):
        tag = t[0].split(" ")[0]
        kind = "region" if id(t) in tops else "drop" if dropped(t[0]) else "slot"
        if kind == "region":
            top = t
        elif kind == "slot":
            within = top or around
            if mass(within) > 0 and _is_template(t, within) and tag not in INLINE and not (tag in KEPT_TAGS and _is_main(within[0])):
                kind = "same"
        if tag in CONTAINERS and mass(t) > 0 and t[1] >= COMMON * tree[1]:
            around = t  # what a page without a region has its template by
        children = []
        for x in t[5]:
            child = mark(x, top, around)
            if child[5] or child[1] in ("region", "same"):  # others are slots, or dropped, without being named
                children.append(child)
        return [t[0], kind, 0, 0, 0, children]

    return mark(tree, None, tree)


def _largest(t, mass) -> list:
    """The smallest containers that hold most of the varying text of pages that have them: one for each layout."""
    inner = [x for x in t[5] if x[0].split(" ")[0] in CONTAINERS and mass(x) * t[1] >= MASS * max(mass(t), 1) * x[1]]
    if sum([mass(x) for x in inner]) < MASS * max(mass(t), 1):
        return [t]
    found = []
    for x in inner:
        found += _largest(x, mass)
    return found


def _is_template(t, top) -> bool:
    """Whether nearly all pages that have ``top``, and of them nearly all that differ, have the node with the same text."""
    if t[2] != t[3] or not t[4] or len(t[6]) < MIN_PAGES or t[1] < NEARLY * top[1] or not _constant_line(t):
        return False
    return len({*t[6]} & {*top[6]}) >= NEARLY * len(top[6])


def _constant_line(t) -> bool:
    for x in t[5]:
        if x[0].split(" ")[0] in INLINE and (x[2] != x[3] or not _constant_line(x)):
            return False
    return True


def _is_main(label: str) -> bool:
    return label.split(" ")[0] in MAIN_TAGS or label.startswith("div ") and "role" in label and "main" in label


def _regions(t):
    if dropped(t[0]):
        return []
    if _is_main(t[0]):
        return [t]
    found = []
    for child in t[5]:
        found += _regions(child)
    return found


def has_main(shape) -> bool:
    """Whether the page has an article or main; a host's pages with and without have wrappers of their own."""
    if dropped(shape[0]):
        return False
    for child in shape[1]:
        if has_main(child):
            return True
    return _is_main(shape[0])


def extract(html: str, frames: dict[bool, list] | None, known=None) -> str:
    """The text of the page's content slots: blocks in page order, one a line."""
    any_depth()
    shape = collapsed([parsed(html, known)])
    kinds: dict[int, str] = {}
    found = []

    def match(s, w):
        for node in s[3]:
            kinds[id(node)] = w[1]
        if w[1] == "region":
            found.append(s)
        if w[1] != "drop":
            for a, b in aligned(w[5], s[1], lambda x: x[1]):
                match(s[1][b], w[5][a])

    main = has_main(shape)
    frame = (frames or {}).get(main)
    if frame is not None:
        match(shape, frame)
        if not found and not main:  # a page without a region of its host's: all that isn't template
            found.append(shape)
    if not found:
        match(shape, wrapper(tree_of(shape)))
    tops = {id(node) for s in found for node in s[3]}
    blocks: list[str] = []
    line: list[str] = []
    silent: set[int] = set()  # nodes in template; those inside a line are template with it

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    # Walked with a stack of its own: markup can be nested to any depth.
    stack = [(shape[3][0], False, False)]
    while stack:
        node, inside, leaving = stack.pop()
        if leaving:
            flush()
            continue
        if isinstance(node, str):
            line.append(node)
            continue
        if inside and dropped(node[1]) or kinds.get(id(node)) == "drop":
            continue
        block = node[0] not in INLINE
        if node[0] == "br":
            line.append(" ")
            continue
        inside = inside or id(node) in tops
        if block and inside:
            flush()
            stack.append((node, True, True))
        quiet = not inside or kinds.get(id(node)) == "same" or not block and id(node) in silent
        if quiet and inside:
            silent.update(id(c) for c in node[2] if not isinstance(c, str))
        stack.extend((c, inside, False) for c in reversed(node[2]) if not (isinstance(c, str) and quiet))
    flush()
    return "\n".join(blocks)


_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def _word_counts(batches):
    """(host, word, pages): pages of the host that use the word in a class, id or role; word "" counts all pages."""
    held: dict[tuple[str, str], int] = {}

    def rows():
        keys = [*held]
        columns = [pa.array([h for h, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["host", "word", "n"])

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            values = {*_NAMES.findall(html or "")}
            for word in {"", *(w for value in values for w in _words(unescape(value)))}:
                held[host, word] = held.get((host, word), 0) + 1
        if len(held) > NODES:
            yield rows()
            held.clear()
    if held:
        yield rows()


def layout_words(pages: DataFrame) -> DataFrame:
    """(host, words): words of classes and ids on at least ``COMMON`` of the host's pages; a page's own aren't layout."""
    counted = pages.select("host", "html").mapInArrow(_word_counts, "host string, word string, n long")
    counted = staged(counted.groupBy("host", "word").agg(F.sum("n").alias("n")))
    total = counted.where("word = ''").select("host", F.col("n").alias("pages"))
    common = counted.where("word != ''").join(total, "host").where(F.col("n") >= COMMON * F.col("pages"))
    return staged(common.groupBy("host").agg(F.sort_array(F.collect_list("word")).alias("words")))


def _partial_trees(batches):
    """Each task's pages as one tree for a host's pages with an article or main and one for those without."""
    from pyspark import TaskContext

    any_depth()
    salt = TaskContext.get().partitionId() // SALT_TASKS
    held: dict[tuple[str, bool], list] = {}
    sizes: dict[tuple[str, bool], int] = {}
    nodes = 0
    for batch in batches:
        for host, html, words in zip(*(batch.column(x).to_pylist() for x in ("host", "html", "words")), strict=True):
            shape = collapsed([parsed(html or "", frozenset(words or ()))])
            tree, key = tree_of(shape), (host, has_main(shape))
            if key in held:
                tree = merged(held[key], tree)
            count = size(tree)
            if count > 4 * TREE_NODES:
                tree = pruned(tree)
                count = size(tree)
            nodes += count - sizes.get(key, 0)
            held[key], sizes[key] = tree, count
            if nodes > NODES:
                yield _trees(held, salt)
                held, sizes, nodes = {}, {}, 0
    if held:
        yield _trees(held, salt)


def _trees(held, salt):
    keys, trees = zip(*sorted(held.items()), strict=True)
    columns = [pa.array([h for h, _ in keys]), pa.array([m for _, m in keys]), pa.array([salt] * len(keys), pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([dumped(pruned(t)) for t in trees])], ["host", "main", "salt", "tree"])


def _fold(keys: list[str], finish):
    def work(rows: pa.Table) -> pa.Table:
        any_depth()
        whole = None
        for text in sorted(rows["tree"].to_pylist()):  # in an order of their own, whatever the tasks' was
            tree = loaded(text)
            whole = tree if whole is None else pruned(merged(whole, tree))
        out = {k: rows[k].slice(0, 1) for k in keys}
        return pa.table(out | {"tree": pa.array([dumped(finish(whole))])})

    return work


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, plain, main): the wrappers of each host of ``pages`` (host, html, words), for pages without and with a main."""
    of = "host string, main boolean, salt int, tree string"
    partial = pages.select("host", "html", "words").mapInArrow(_partial_trees, of)
    first = partial.groupBy("host", "main", "salt").applyInArrow(_fold(["host", "main", "salt"], lambda t: t), of)
    whole = first.drop("salt").groupBy("host", "main").applyInArrow(_fold(["host", "main"], wrapper), "host string, main boolean, tree string")
    return whole.groupBy("host").agg(
        F.max(F.when(~F.col("main"), F.col("tree"))).alias("plain"), F.max(F.when(F.col("main"), F.col("tree"))).alias("main")
    )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    frame = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        F.col(f"`{html_col}`").alias("html"),
    )
    frame = frame.join(layout_words(frame), "host", "left")
    known = staged(wrappers(frame))

    def make():
        cache: dict[tuple, dict] = {}

        def columns(batch):
            out = []
            for html, words, *trees in zip(*(batch.column(x).to_pylist() for x in ("html", "words", "plain", "main")), strict=True):
                key = tuple(trees)
                if key not in cache:
                    if len(cache) > 500:
                        cache.clear()
                    cache[key] = {bool(i): loaded(t) for i, t in enumerate(key) if t}
                out.append(extract(html, cache[key], frozenset(words or ())) if html else "")
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return columns

    found = appended(frame.join(known, "host", "left").select("page_id", "url", "html", "words", "plain", "main"), make, "text string, n_chars long")
    return found.select("page_id", "url", "text", "n_chars")
