"""Operator 1, main text of web pages by wrapper induction.

Pages become trees of their containers, with text blocks as leaves. All pages of a host are aligned by the paths of their
containers and blocks (the keys from the root down). A container or block whose text stands at its path in most of the distinct
texts that its parent has over the host is the host's template; those that vary are slots. What is template, or says by its
tag, class, id or role that it is a menu, notice, advert or the like, is left out, and the blocks of the slots are the main
text. This holds inside <article> and <main> too; these tags only say which slots are meant. Menus, adverts and footers
often vary from page to page of a host, so that induction alone would call them content; hence the tags and words.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

#: A text is template if it stands in more than SHARE of the distinct parents with its path, and in LEAST of them (containers: in
#: all, if fewer have the path; never in one alone). Blocks that are more than OWN of their container's text aren't left out: such
#: pages are near copies of each other. Up to BROADCAST bytes, all hosts' templates are broadcast.
SHARE, LEAST, OWN, BROADCAST = 0.5, 3, 0.5, 32_000_000
#: Hosts whose pages are kept apart from the rest where templates aren't broadcast.
HOT = 1000

# HTML's element groups, and words of class, id and role that name what isn't main text.
RAW = "script|style|template|textarea|title|iframe|noscript|noembed|noframes|svg|math|select|button|datalist|object|audio|video|canvas"
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl menu table tbody thead tfoot tr figure details dialog fieldset center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary legend hr hgroup option search".split())
VOID = frozenset("br img input meta link hr wbr area base col embed source track param".split())
NOT_MAIN_TAGS = frozenset("nav footer aside form menu dialog head".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOT_MAIN_WORDS = frozenset("nav navbar navigation menu menubar sidebar footer ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager related recommended widget comment comments disqus respond replies skip toolbar copyright masthead topbar".split())
MODIFIERS = frozenset("has no not with without hide show enable enabled disabled open closed active visible hidden fixed sticky layout".split())
ALWAYS_OTHERS = frozenset("comment comments disqus respond replies related recommended".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<shut>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NUMBER = re.compile(r"\d+")
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(str):
    """A block's text; tag: of the element it stands in, or empty; other: whether that says by its names that it isn't main text."""

    tag, other = "", False


class Node:
    """A container: kids are Nodes and Blocks; key names it in alignments."""

    __slots__ = ("tag", "key", "words", "kids", "links")

    def __init__(self, tag: str, key: str, words: frozenset):
        self.tag, self.key, self.words = tag, key, words
        self.kids: list[Node | Block] = []
        self.links = 0  # characters of its own blocks that are link text

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if type(k) is Node]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            if type(k := todo.pop()) is Block:
                out.append(k)
            else:
                todo += reversed(k.kids)
        return "\n".join(out)


_keys: dict[tuple[str, str], tuple[str, frozenset, bool]] = {}


def described(tag: str, attrs: str) -> tuple[str, frozenset, bool]:
    """(key, words of class, id and role, whether it is hidden) of a start tag. Names with a modifier (no-comments, has-sidebar)
    don't say what the element is."""
    if not attrs or attrs == "/":
        return tag, frozenset(), False
    if (tag, attrs) in _keys:
        return _keys[tag, attrs]
    words, names, hidden = set(), [], False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names.append(f"{name}={value.strip().lower()}")
            for one in value.split():
                parts = {w.lower() for w in PART.findall(one)}
                if not parts & MODIFIERS:
                    words |= parts
            if name == "role" and value.strip().lower() in NOT_MAIN_ROLES:
                words.add("navigation")
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    if len(_keys) > 20_000:
        _keys.clear()
    _keys[tag, attrs] = out = f"{tag} {' '.join(sorted(names))}".strip(), frozenset(words), hidden
    return out


def parsed(html: str | None) -> Node:
    """The tree of a page; never fails, whatever the markup. Character references are decoded and white space is collapsed."""
    root = Node("root", "root", frozenset())
    stack, parts, linked, quiet = [root], [], 0, 0
    opened: dict[str, int] = {}  # containers in the stack by tag
    in_link = False
    data, at, kind, other = html or "", 0, "", False

    def flush(then: str = "", then_other: bool = False):
        nonlocal linked, kind, other
        if parts:
            block = Block(" ".join(entities.unescape("".join(parts)).split()))
            parts.clear()
            if block:
                block.tag, block.other = kind, other
                stack[-1].kids.append(block)
                stack[-1].links += min(linked, len(block))
        linked, kind, other = 0, then, then_other

    for m in TOKEN.finditer(data):
        start = m.start()
        if start > at and not quiet:
            parts.append(data[at:start])
            if in_link:
                linked += start - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("math", "svg"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if m["shut"]:
            if quiet:
                if tag in CONTAINERS or tag in BLOCKS or tag == "span":
                    quiet -= 1
            elif tag in CONTAINERS:
                flush()
                while opened.get(tag):
                    shut = stack.pop().tag
                    opened[shut] -= 1
                    if shut == tag:
                        break
            elif tag in BLOCKS:
                flush()
            elif tag == "a":
                in_link = False
            continue
        own = m["attrs"]
        if quiet:
            if (tag in CONTAINERS or tag in BLOCKS or tag == "span") and tag not in VOID:
                quiet += 1
        elif tag in CONTAINERS:
            flush()
            key, words, hidden = described(tag, own)
            if hidden:
                quiet = 1
                continue
            node = Node(tag, key, words)
            stack[-1].kids.append(node)
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        elif tag in BLOCKS:
            _, words, hidden = described(tag, own)
            flush(tag, hidden or bool(words & NOT_MAIN_WORDS))
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = True
    if at < len(data) and not quiet:
        rest = data[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return root


def marks(tree: Node) -> list[tuple[Node | Block, int, int, int]]:
    """(container or block, path, text, text of its parent) of all that have text, as hashes: the path of the keys from the root down.

    Where keys hold numbers (post-123) they also stand at a path without them. A polynomial over the blocks' hashes puts
    the hash of a container's text together from those of its kids, so the time is linear in the page.
    """
    order, paths = [tree], [(0, 0)]
    for at, node in enumerate(order):  # grows: parents before kids
        for k in node.nodes():
            order.append(k)
            paths.append((xxhash.xxh3_64_intdigest(k.key, paths[at][0]), xxhash.xxh3_64_intdigest(NUMBER.sub("0", k.key), paths[at][1])))
    sums: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        value, n = 0, 0
        for k in node.kids:
            v, m = (xxhash.xxh3_64_intdigest(k) % PRIME, 1) if type(k) is Block else sums[id(k)]
            value, n = (value * pow(BASE, m, PRIME) + v) % PRIME, n + m
        sums[id(node)] = value, n
    own = lambda node: "{1} {0}".format(*sums[id(node)])
    out = [(tree, 0, xxhash.xxh3_64_intdigest(own(tree)) >> 1, 0)] if sums[id(tree)][1] else []
    where = {id(node): path for node, path in zip(order, paths, strict=True)}
    for node, path in zip(order, paths, strict=True):
        if not sums[id(node)][1]:
            continue
        within = xxhash.xxh3_64_intdigest(own(node)) >> 1
        for k in node.kids:
            if type(k) is Block:
                for p in dict.fromkeys(path):
                    q = xxhash.xxh3_64_intdigest("#" + k.tag, p)
                    out.append((k, q >> 1, xxhash.xxh3_64_intdigest(k, q) >> 1, within))
            elif sums[id(k)][1]:
                out += [(k, p >> 1, xxhash.xxh3_64_intdigest(own(k), p) >> 1, within) for p in dict.fromkeys(where[id(k)])]
    return out


def matching(a: Node, b: Node, memo: dict | None = None) -> int:
    """Simple tree matching: nodes of the largest order-keeping match of two trees with equal roots. Tests hold paths against it."""
    memo = {} if memo is None else memo
    if a.key != b.key:
        return 0
    if (id(a), id(b)) in memo:
        return memo[id(a), id(b)][0]
    x, y = a.nodes(), b.nodes()
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x, 1):
        row, above = m[i], m[i - 1]
        for j, q in enumerate(y, 1):
            row[j] = max(row[j - 1], above[j], above[j - 1] + matching(p, q, memo))
    memo[id(a), id(b)] = (m[-1][-1] + 1, m)
    return m[-1][-1] + 1


def pairs(a: Node, b: Node) -> list[tuple]:
    """Matched (a's node, b's node) pairs of the largest match. Equal shapes are matched as they stand."""
    memo: dict = {}
    out = []
    todo = [(a, b)] if a.key == b.key else []
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        x, y = p.nodes(), q.nodes()
        if [k.key for k in x] == [k.key for k in y] and len({k.key for k in x}) == len(x):
            todo += zip(x, y, strict=True)
            continue
        matching(p, q, memo)
        m, i, j = memo[id(p), id(q)][1], len(x), len(y)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[i], y[j]))
    return out


def walked(tree: Node) -> list[tuple[Node, int]]:
    """Containers, parents first, each with its parent's place in the list."""
    out = [(tree, -1)]
    for at, (node, _) in enumerate(out):  # grows
        out += [(k, at) for k in node.nodes()]
    return out


def main_text(tree: Node, template: frozenset[int] | None) -> str:
    """Blocks of the page's articles, or of its main part, or of its slots, in page order; what is template is left out of all three.

    Class words don't leave out html, body, the page's only article or <main>, or what holds this and so half of the text. Where
    articles and main part hold nothing but template, the slots elsewhere are the text; where there are none either, tags are
    the only evidence left, and the articles or main part are read as they stand; and if class words and forms leave nothing,
    those of containers with half of the text don't count.
    """
    every = walked(tree)
    lengths: dict[int, tuple[int, int]] = {}  # characters and characters of link text of a container
    for node, _ in reversed(every):
        own = [(len(k) + 1, 0) if type(k) is Block else lengths[id(k)] for k in node.kids]
        lengths[id(node)] = sum(c for c, _ in own), node.links + sum(c for _, c in own)
    fixed: set[int] = set()
    if template:
        fixed = {id(x) for x, _, text, _ in marks(tree) if text in template}
        for node, _ in every:  # blocks that are most of what their container has besides its template
            blocks_ = [k for k in node.kids if type(k) is Block and id(k) in fixed]
            if blocks_ and sum(len(k) + 1 for k in blocks_) > OWN * sum(len(k) + 1 if type(k) is Block else lengths[id(k)][0] for k in node.kids if type(k) is Block or id(k) not in fixed):
                fixed -= {id(k) for k in blocks_}
    sound = immune(every, lengths)
    whole = lengths[id(tree)][0]

    def not_main(node: Node, inside: bool, loose: bool) -> bool:
        if id(node) in sound:
            return False
        most = loose and 2 * lengths[id(node)][0] >= whole and not node.words & ALWAYS_OTHERS
        if node.tag in NOT_MAIN_TAGS and not (most and node.tag == "form"):
            return True
        if most:
            return False
        return bool(node.words & NOT_MAIN_WORDS) or not inside and (node.tag == "header" or "header" in node.words)

    def blocks(root: Node, inside: bool, fixed: set[int], loose: bool = False) -> list[str]:
        out, todo = [], list(reversed(root.kids))
        while todo:
            k = todo.pop()
            if id(k) in fixed:
                continue
            if type(k) is Block:
                if loose or not k.other:
                    out.append(k)
            elif not not_main(k, inside, loose):
                if not inside and k.tag in ("ul", "ol", "table", "div") and (n := lengths[id(k)])[0] and n[1] > 0.6 * (n[0] - 1):
                    continue  # a list of links
                todo += reversed(k.kids)
        return out

    def named(fixed: set[int], loose: bool = False) -> list[str]:
        for tags, roles in ((("article",), ()), (("main",), ("role=main",))):
            roots, todo = [], [tree]
            while todo:
                node = todo.pop()
                if id(node) in fixed or not_main(node, True, loose):
                    continue
                if node.tag in tags or any(r in node.key for r in roles):
                    roots.append(node)
                else:
                    todo += reversed(node.nodes())
            if out := [b for r in roots for b in blocks(r, True, fixed, loose)]:
                return out
        return []

    return "\n".join(named(fixed) or blocks(tree, False, fixed) or named(set()) or named(set(), True) or blocks(tree, False, set(), True))


def immune(every: list[tuple[Node, int]], lengths: dict[int, tuple[int, int]]) -> set[int]:
    """Containers that class words (and form) don't leave out: html and body; the only article, the only <main>; and what holds
    one of these with half of the text outside menus and the like."""
    out = {id(node) for node, _ in every if node.tag in ("root", "html", "body")}
    text, other, among = lengths[id(every[0][0])][0], [False] * len(every), [False] * len(every)  # within menus and the like; within comments and the like
    for at, (node, up) in enumerate(every[1:], 1):
        tagged = node.tag in NOT_MAIN_TAGS and node.tag != "form"
        if tagged and not other[up]:
            text -= lengths[id(node)][0]
        other[at] = other[up] or tagged
        among[at] = among[up] or bool(every[up][0].words & ALWAYS_OTHERS)
    for of in (lambda x: x.tag == "article", lambda x: x.tag == "main" or "role=main" in x.key):
        found = [at for at, (node, _) in enumerate(every) if of(node) and not other[at] and not among[at]]
        if len(found) == 1:
            at = found[0]
            out.add(id(every[at][0]))
            while 2 * lengths[id(every[found[0]][0])][0] >= text and (at := every[at][1]) >= 0:
                out.add(id(every[at][0]))
    return out


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def templates(pages: DataFrame, path: str) -> DataFrame:
    """host, template (texts of marks()), of hosts that have one; (host, html) in.

    A text counts once for each distinct text of its parent, so pages that repeat, and articles that stand on several pages,
    count once. All counts are keyed by more than the host, so that no task gets a large host; only its template is gathered.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                seen: dict[tuple, None] = {}
                for host, html in zip(b.column(0).slice(at, 512).to_pylist(), b.column(1).slice(at, 512).to_pylist(), strict=True):
                    for x, path, text, within in marks(parsed(html)):
                        seen[host, path, text, within, type(x) is Block] = None
                if seen:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen, strict=True), types, strict=True)], ["host", "path", "text", "within", "block"])

    marked = pages.where("html is not null").select("host", "html").mapInArrow(mark, "host string, path long, text long, within long, block boolean")
    distinct = common.stored(marked.distinct(), path)
    texts = distinct.groupBy("host", "path", "text", "block").agg(F.count("*").alias("n")).where("n > 1")
    held = distinct.select("host", "path", "within").distinct().groupBy("host", "path").agg(F.count("*").alias("parents"))
    least = F.when(F.col("block"), F.lit(LEAST)).otherwise(F.least("parents", F.lit(LEAST)))
    most = texts.join(held, ["host", "path"]).where((F.col("n") > SHARE * F.col("parents")) & (F.col("n") >= least))
    return most.groupBy("host").agg(F.collect_set("text").alias("template"))


def with_template(pages: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """pages with their host's template or null. Templates are broadcast if they are few enough; else those of the HOT hosts with
    most pages are, so that no task gets a large host's pages, and the others are joined by sorting."""

    def few(t: DataFrame) -> bool:
        return (t.agg(F.sum(F.size("template") * 8 + F.length("host")).alias("n")).first()["n"] or 0) <= BROADCAST

    if few(found):
        return pages.join(F.broadcast(found), "host", "left")
    hosts = common.stored(pages.groupBy("host").count().orderBy(F.desc("count"), "host").limit(HOT).select("host"), f"{path}/hot")
    hot = common.stored(found.join(F.broadcast(hosts), "host", "left_semi"), f"{path}/hot_templates")
    large = pages.join(F.broadcast(hosts), "host", "left_semi").join(F.broadcast(hot) if few(hot) else hot.hint("merge"), "host", "left")
    return large.unionByName(pages.join(F.broadcast(hosts), "host", "left_anti").join(found.hint("merge"), "host", "left"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, a row per input row.

    Null and empty html gives an empty text, and so does a page without main text. Pages without a host in their url have no
    template and are read by their tags alone, as are hosts with one distinct page. Near copies keep what they share (OWN). html is read whole. Repeated rows give
    repeated rows; other columns are ignored.
    """
    spark = pages.sparkSession
    common.ship(spark)
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    given = given.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    shared = common.shared_dir(spark)
    found = common.stored(templates(given.where("host <> ''"), f"{shared}/marks"), f"{shared}/templates")
    common.dropped(spark, f"{shared}/marks")
    joined = with_template(given, found, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                texts = [main_text(parsed(html), frozenset(template or ())) if html else "" for html, template in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
