"""Main text of web pages by wrapper induction.

Pages of one host come from few templates. Their DOM trees are aligned with an example page of the
host by simple tree matching: nodes that match and hold the same text on all pages are template,
slots whose text varies are content. Trees are compared by shape: neighbouring siblings of equal
tag and class are one list node, so a long article costs as much as a short one.

What a page's own marks already say is used first: elements whose tag, role or class names a menu,
header, footer, sidebar, notice, advert, form, comment section or script are never content (class
and id words count as whole tokens, and not on html, body, main, an outermost article or what such a
content element lies in), and if the page has article or main elements the content lies in them, in all that are outermost. Induction then decides what is
left: constant slots of the host go, inside an article too unless they are running text.

The wrapper of a host is induced from TRAINING different pages, those with the smallest hashes, and
is one for all its pages; a page's slot is template only if it holds the very text that the
training pages share. Pages are dealt by host and a salt, about GROUP to a task, sorted by hash: so a
host of one salt meets its training pages first. For a host of several salts they are gathered in a
pass of their own, and the wrapper travels to each salt. Fewer than MIN_PAGES different pages tell
nothing about what is constant: such a host has no template.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; html without
any markup is one block; broken markup is read as browsers do in outline (void elements, implied
ends of p, li, td and the like, unclosed elements end with the page); repeated rows each get their
result. Other columns are ignored, an empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

GROUP = 256
MIN_PAGES = 4
#: Different pages of a host that its wrapper is induced from.
TRAINING = 64
#: Characters of a batch of results.
HELD = 1 << 24
#: Depth of a tree below which nodes are not aligned.
DEPTH = 100

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements of running text: in an article they are content even if all pages share them.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "dd", "dt"}
#: Elements that end a paragraph and stand as blocks of their own.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
#: Elements that never hold main text.
NEVER = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "header", "aside", "form", "button", "select", "option", "input", "textarea", "iframe", "object", "embed",
    "svg", "canvas", "video", "audio", "dialog", "menu", "noembed", "noframes", "fieldset", "search", "datalist", "output", "progress", "meter",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
#: Elements that class and id words do not make boilerplate; an article inside another one they do.
WHOLE = {"html", "body", "main", "article"}
#: Class names and ids that name boilerplate.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "reply", "replies", "disqus", "respond", "related", "recommended", "recommendations", "pagination", "pager",
    "search", "form", "toolbar", "skip", "hidden", "copyright", "legal", "disclaimer", "tags", "toc",
}
SPACES = re.compile(r"\s+")
ENDS_P = BLOCK
#: An opening tag that ends an open element of these names, up to the given containers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "button", "object", "template"}


class Node:
    __slots__ = ("tag", "mark", "never", "named", "children", "parent", "constant")

    def __init__(self, tag: str, mark: str = "", never: bool = False, parent: Node | None = None):
        self.tag, self.mark, self.never, self.parent = tag, mark, never, parent
        self.children: list = []
        self.constant = self.named = False  # named: never content by class or id alone


def _marks(attributes: str) -> tuple[str, bool, bool]:
    """The class names of an element, whether its role or style hides it or names boilerplate, and
    whether its class names or id do."""
    mark, never, named = "", False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if name == "class":
                mark = value
            named = named or any(w in MARKS for w in value.lower().split())
        elif name == "role":
            never = never or value.lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            never = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            never = True
    return mark, never, named


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the > of a tag stands whose name ends at ``at``, outside quotes if it can be; there is
    one. ``dead`` holds the quotes from which no such > is met: each is passed once only, so
    the scans of a page are linear together."""
    begin, passed = at, []
    while True:
        m = STOP.search(page, at)
        if m is None or m.start() in dead:
            break
        if m[0] == ">":
            return m.start()
        passed.append(m.start())
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(passed)
    return page.find(">", begin)


def parse(page: str) -> Node:
    """The page's tree; children are nodes and strings (character references still undecoded)."""
    root = here = Node("#root")
    at, n = 0, len(page)
    final = page.rfind(">")
    dead: set[int] = set()
    opened: dict[str, int] = {}  # how many elements of a name were opened and not ended by name
    while at < n:
        m = TOKEN.match(page, at)
        tag, begin = m[2], m.end()
        if tag is None:
            at, text = begin, m[0]
            if text[0] != "<" or text == "<":
                here.children.append(text)
            elif text.startswith("<![CDATA["):
                here.children.append(html_lib.escape(text[9:-3]))
            continue
        if begin > final:  # no tag ends any more
            here.children.append(page[at:])
            break
        end = tag_end(page, begin, dead)
        at = end + 1
        tag = tag.lower()
        attributes = page[begin:end]
        if m[1]:
            if tag == "br":
                here.children.append(Node("br", parent=here))
                continue
            if not opened.get(tag):
                continue
            node = here
            while node is not root and node.tag != tag and not (tag not in BLOCK and node.tag in BLOCK):
                node = node.parent
            if node is not root and node.tag == tag:
                here = node.parent
                opened[tag] -= 1
            continue
        if tag in ("html", "body") and any(_open(here, tag)):
            continue
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            node, last = here, None
            while node is not root and node.tag not in stop:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        if tag in ENDS_P:
            node = here
            while node is not root and node.tag != "p" and node.tag not in SCOPE and (node.tag not in BLOCK):
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag not in ("head", "html", "script", "style", "meta", "link", "title", "base", "noscript", "template") and here.tag == "head":
            here = here.parent
        mark, never, named = _marks(attributes) if attributes else ("", False, False)
        never = never or tag in NEVER
        named = named and not never and (tag not in WHOLE or tag == "article" and any(_open(here, "article")))
        node = Node(tag, mark, never or named, here)
        node.named = named
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            here = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _open(node: Node, tag: str):
    while node is not None:
        if node.tag == tag:
            yield node
        node = node.parent


def blocks(root: Node) -> list[tuple[str, Node]]:
    """The text blocks of a subtree in page order, with the block element of each."""
    out: list[tuple[str, Node]] = []
    parts: list[str] = []

    def flush(owner: Node) -> None:
        text = SPACES.sub(" ", html_lib.unescape("".join(parts))).strip(" ")
        parts.clear()
        if text and not text.isspace():
            out.append((text.strip(), owner))

    # an explicit stack, as pages may nest deeply
    stack: list[tuple[Node, int]] = [(root, 0)]
    owner = [root]
    while stack:
        node, i = stack.pop()
        if i == len(node.children):
            if node.tag in BLOCK and node is not root:
                flush(node)
                owner.pop()
            continue
        stack.append((node, i + 1))
        child = node.children[i]
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif child.never or child.constant:
            if child.tag in BLOCK:
                flush(owner[-1])
        else:
            if child.tag in BLOCK:
                flush(owner[-1])
                owner.append(child)
            stack.append((child, 0))
    flush(root)
    return out


def content_roots(root: Node) -> list[Node]:
    """The outermost article and main elements outside boilerplate, in page order. Where all of
    them lie in elements that class or id name boilerplate, these are not taken for such if the
    found elements have more text than the page outside them."""
    amount = lambda x: sum(len(t) for t, _ in blocks(x))
    for named in (False, True):
        found: list[Node] = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag in ("article", "main") or node.mark == "main":
                found.append(node)
                continue
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and (not x.never or named and x.named))
        if named and sum(map(amount, found)) <= amount(root):
            continue
        if any(map(amount, found)):
            for node in (x for f in found for x in _up(f) if x.named):
                node.never = node.named = False
            return found
    return []


class Shape:
    """A node of the shape tree: siblings in a row with equal tag and class are one."""

    __slots__ = ("key", "nodes", "children")

    def __init__(self, key: tuple[str, str]):
        self.key, self.nodes, self.children = key, [], []


def shape(nodes: list[Node], depth: int = 0) -> Shape:
    out = Shape((nodes[0].tag, nodes[0].mark))
    out.nodes = nodes
    if depth > DEPTH:
        return out
    runs: list[list[Node]] = []
    for node in nodes:
        for child in node.children:
            if isinstance(child, Node) and child.tag not in ("br", "head", "script", "style"):
                if runs and (runs[-1][0].tag, runs[-1][0].mark) == (child.tag, child.mark):
                    runs[-1].append(child)
                else:
                    same = next((r for r in runs if (r[0].tag, r[0].mark) == (child.tag, child.mark)), None) if len(nodes) > 1 else None
                    runs.append([child]) if same is None else same.append(child)
    out.children = [shape(r, depth + 1) for r in runs]
    return out


def match(a: Shape, b: Shape, pairs: list[tuple[Shape, Shape]]) -> int:
    """Simple tree matching: the largest number of nodes matched in order, level by level."""
    if a.key != b.key:
        return 0
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    held: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(n):
        for j in range(m):
            if a.children[i].key == b.children[j].key:
                below: list[tuple[Shape, Shape]] = []
                held[i, j] = (match(a.children[i], b.children[j], below), below)
            w = held[i, j][0] if (i, j) in held else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs.append((a, b))
    i, j = n, m
    while i and j:
        if (i - 1, j - 1) in held and best[i][j] == best[i - 1][j - 1] + held[i - 1, j - 1][0]:
            pairs.extend(held[i - 1, j - 1][1])
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[n][m]


def _text(nodes: list[Node]) -> str:
    return "\n".join(t for x in nodes for t, _ in blocks(x))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Wrapper:
    """The template of a host, aligned with an example page. Training pages are added one by one; of
    each only digests of its texts are kept."""

    def __init__(self, page: str = "", constant: dict[int, str] | None = None):
        self.page = page
        self.example: Shape | None = None
        self.bodies: set[str] = set()
        self.number: dict[int, int] = {}
        self.seen: dict[int, list] = {}  # by node of the example: the text's digest (None: it varies) and how many pages have one
        self.constant: dict[int, str] = constant or {}
        if constant:
            self.align_with(parse(page))

    def align_with(self, tree: Node) -> None:
        self.example = shape([tree])
        self.number = self.numbers(self.example)

    def add(self, page: str, tree: Node | None = None) -> bool:
        """Takes a training page; whether there are enough."""
        tree = tree or parse(page)
        body = _digest(_text([tree]))
        if self.example is None:
            self.page = page
            self.align_with(tree)
        if body not in self.bodies:
            self.bodies.add(body)
            pairs: list[tuple[Shape, Shape]] = []
            match(self.example, shape([tree]), pairs)
            for mine, other in pairs:
                text = _text(other.nodes)
                if text:
                    digest = _digest(text)
                    held = self.seen.setdefault(self.number[id(mine)], [digest, 0])
                    held[0] = held[0] if held[0] == digest else None
                    held[1] += 1
        return len(self.bodies) >= TRAINING

    def close(self) -> None:
        if len(self.bodies) >= MIN_PAGES:
            self.constant = {k: digest for k, (digest, n) in self.seen.items() if digest is not None and n >= MIN_PAGES}

    @staticmethod
    def numbers(top: Shape) -> dict[int, int]:
        out, stack = {}, [top]
        while stack:
            x = stack.pop()
            out[id(x)] = len(out)
            stack.extend(reversed(x.children))
        return out

    def mark(self, tree: Node, bodies: list[Node]) -> None:
        """Marks the template nodes of a page; neither the article bodies nor their prose."""
        if not self.constant:
            return
        pairs: list[tuple[Shape, Shape]] = []
        match(self.example, shape([tree]), pairs)
        above = {id(x) for body in bodies for x in _up(body)}
        inside = {id(body) for body in bodies}
        found = [other for mine, other in pairs if self.constant.get(self.number[id(mine)]) == _digest(_text(other.nodes))]
        for other in found:
            for node in other.nodes:
                prose = node.tag in PROSE and any(id(x) in inside for x in _up(node))
                node.constant = id(node) not in above and not prose


def _up(node: Node):
    while node is not None:
        yield node
        node = node.parent


def read(page: str) -> tuple[Node, list[Node]]:
    """A page's tree and its content elements."""
    tree = parse(page)
    return tree, content_roots(tree)


def main_text(wrapper: Wrapper, tree: Node, bodies: list[Node]) -> str:
    wrapper.mark(tree, bodies)
    return "\n\n".join(t for root in bodies or [tree] for t, _ in blocks(root))


def main_texts(pages: list[str]) -> list[str]:
    """The main texts of pages of one host; the first TRAINING different ones train its wrapper."""
    wrapper = Wrapper()
    any(wrapper.add(p) for p in pages)
    wrapper.close()
    return [main_text(wrapper, *read(p)) for p in pages]


def host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    rows = rows.withColumn("hash", F.xxhash64("html"))
    sizes = rows.groupBy("host", "hash").count().groupBy("host").agg(F.ceil(F.sum("count") / group).cast("int").alias("parts"), F.count("*").alias("different"))
    sizes = materialize(sizes, "hosts")  # so that Spark knows how large they are before it deals pages

    def induce(batches):
        now, wrapper, enough = None, None, False
        for batch in batches:
            for h, t in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                if now != h:
                    if wrapper is not None:
                        yield _wrapper_row(now, wrapper)
                    now, wrapper, enough = h, Wrapper(), False
                enough = enough or wrapper.add(t.as_py())
        if wrapper is not None:
            yield _wrapper_row(now, wrapper)

    large = sizes.where("parts > 1")
    # three times as many pages as train, by the rank of their hash; that fewer than needed pass is out of the question
    some = rows.join(large, "host").where(F.col("hash") / F.lit(2.0**64) + 0.5 < 3 * TRAINING / F.col("different"))
    some = some.dropDuplicates(["host", "hash"]).repartition("host").sortWithinPartitions("host", "hash").select("host", "html")
    wrappers = materialize(some.mapInArrow(induce, "host string, example string, constant string"), "wrappers") if not large.isEmpty() else None

    def run(batches):
        now, wrapper, ready, held, out, n = None, Wrapper(), False, [], [], 0

        def done(i, u, t):
            nonlocal n
            out.append((i, u, main_text(wrapper, *read(t))))
            n += len(out[-1][2])

        def results():
            nonlocal n
            ids, urls, texts = zip(*out, strict=True)
            out.clear()
            n = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

        def close():
            """The training pages have been met: the wrapper is made, and they are read with it."""
            nonlocal ready
            wrapper.close()
            ready = True
            for i, u, t in held:
                done(i, u, zlib.decompress(t).decode("utf-8", "surrogatepass"))
                if n > HELD or len(out) >= group:
                    yield results()
            held.clear()

        for batch in batches:
            for h, s, kind, i, u, t, c in zip(*(batch.column(c) for c in ("host", "salt", "kind", "page_id", "url", "html", "constant")), strict=True):
                h, s, i, u, t = h.as_py(), s.as_py(), i.as_py(), u.as_py(), t.as_py()
                if now != (h, s):
                    yield from close()
                    now, wrapper, ready = (h, s), Wrapper(), False
                if kind.as_py() == 0:
                    wrapper, ready = Wrapper(t, {int(k): v for k, v in json.loads(c.as_py()).items()}), True
                elif ready:
                    done(i, u, t)
                else:
                    held.append((i, u, zlib.compress(t.encode("utf-8", "surrogatepass"), 1)))
                    if wrapper.add(t):
                        yield from close()
                if n > HELD or len(out) >= group:
                    yield results()
        yield from close()
        if out:
            yield results()

    salted = rows.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int"))
    dealt = salted.select("host", "salt", F.lit(1).alias("kind"), "hash", "page_id", "url", "html", F.lit(None).cast("string").alias("constant"))
    if wrappers is not None:
        sent = wrappers.join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hash"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("example").alias("html"), "constant")
        dealt = dealt.union(sent)
    return dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "kind", "hash", "page_id").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _wrapper_row(host: str, wrapper: Wrapper) -> pa.RecordBatch:
    wrapper.close()
    return pa.RecordBatch.from_pydict({"host": [host], "example": pa.array([wrapper.page], pa.string()), "constant": [json.dumps(wrapper.constant)]})
