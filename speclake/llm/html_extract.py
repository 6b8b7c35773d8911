"""Main-text extraction with a site style tree.

Every page is parsed to a tree, in time and memory linear in its length. Its nodes, keyed by their path of tags and names, are
merged by host. For each path the pages that have it are counted by presentation (the kinds of child elements) and by content (the
texts below). Both give entropies, to the base of the number of pages: 0 where all pages look or say the same, 1 where all differ.
The composite importance of a node is (1 - DAMPING**l) * entropy of its l presentations + DAMPING**l * the content entropy of the
pages of each presentation, weighted by their share. Branches of little importance that enough pages of the host share are
template and are removed from each page, inside the main element too. There pages whose main elements say the same count once, so
that copies of a page don't make its text template, and only blocks are removed: markup in a line belongs to its block. The main
element itself, headings, tables, quotes, captions, definitions and listings in it stay, however many pages repeat them.

Text is taken from the page's main elements (article, main), or from the body where there is none. Without need of the tree go:
elements that are no content by their tag, those that are hidden, and those named by class, id or role as something else in words
of FRAME and ELSE only (`comment-list`, but not `comment-on-the-law`). A name that only holds such a word (`entry-header`,
`related-work`), or an id inside the main element that is a word of TOPICS (`discussion`), is no reason by itself: such a branch
goes if the tree calls it template or if most of its text is in links.

Defined results: null or empty html gives an empty text; a broken page gives the text of what can be read, without a tag that never ends; a page without host is
judged by its own names only; repeated rows are extracted each and count each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SALTED, by_bytes, stage

#: A node is template from so many pages and so large a share of its host's pages on, and up to this importance.
LEAST_PAGES, LEAST_SHARE, MOST_IMPORTANCE = 5, 0.1, 0.3
DAMPING = 0.9
MOST_BROADCAST = 20_000
#: A branch whose name holds a word of ELSE goes if at least this share of its text is in links.
LINKED = 0.6

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style noscript template svg annotation annotation-xml iframe object canvas audio video".split())
ASIDE = set("nav footer aside form menu dialog button select textarea".split())
MAIN = {"article", "main"}
INLINE = (set("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp select small span strike strong sub sup textarea time tt u var wbr math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()) | VOID | HIDDEN) - {"hr"}
#: Elements that end an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the same kind, up to the container.
ENDS_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_WALLS = MAIN | {"div", "section", "td", "li", "body", "blockquote"}
#: Words of class, id or role for what is no content, and words that may stand beside them.
ELSE = set("ad ads advert advertisement advertisements advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply respond responses search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split())
FRAME = set("area article articles bar block body bottom box buttons button c center column container content fixed form global icons inner item items left level link links list lists main outer page panel popup post posts primary reader readers region right secondary section site slot stories sub sticky thread top user users wrap wrapper wide x".split())
#: Words of ELSE that may be what an article's own section is about, if its id says so.
TOPICS = set("discussion header navigation notice notices pagination promotion related replies reply responses search share sharing social toolbar".split())
#: Elements that are content of a main element, however many pages repeat them.
KEPT = set("h1 h2 h3 h4 h5 h6 table caption colgroup thead tbody tfoot tr td th blockquote figure figcaption dl dt dd pre".split())
#: A tag that begins.
TAG = re.compile(r"<(?=[A-Za-z/!?])")
#: These name the head and foot of an article inside it.
OWN = {"header", "footer"}
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BLANK = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("tag", "names", "id", "hidden", "children", "parent", "chars", "linked", "says", "holds_main")

    def __init__(self, tag: str, names: str, own: str, hidden: bool, parent: Node | None):
        self.tag, self.names, self.id, self.hidden, self.parent, self.children = tag, names, own, hidden, parent, []
        self.chars = self.linked = self.says = 0
        self.holds_main = False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", "", False, None)
        self.open: Counter[str] = Counter()

    def _leave(self, to: Node) -> None:
        while self.at is not to:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, P_WALLS)
        if tag in ENDS_SAME:
            self._close({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, ENDS_SAME[tag])
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or k == "style" and v and CONCEALED.search(v) for k, v in attrs)
        node = Node(tag, names, next((v for k, v in attrs if k == "id" and v), ""), hidden, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(self.at.parent)

    def _close(self, tags, walls):
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in walls:
            if node.tag in tags:
                self._leave(node.parent)
                return
            node = node.parent

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in MAIN | {"body"} and tag in INLINE | {"p"}:
                return
            node = node.parent
        self._leave(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def parse(html: str) -> Node:
    """The tree; each node knows the characters below it, those in links, a digest of the texts below and whether it holds a main element."""
    builder = _Builder()
    end = html.rfind(">") + 1
    builder.feed(html[:end] + TAG.split(html[end:], maxsplit=1)[0])
    builder.close()
    for node in reversed(_walk(builder.root)):
        for c in node.children:
            if isinstance(c, Node):
                if c.tag not in HIDDEN:
                    node.chars += c.chars
                    node.linked += c.chars if c.tag == "a" else c.linked
                    node.says = (node.says + c.says) & (1 << 62) - 1
                node.holds_main |= c.holds_main or c.tag in MAIN
            elif not c.isspace():
                node.chars += len(c)
                node.says = (node.says + xxhash.xxh64_intdigest(c)) & (1 << 62) - 1
    return builder.root


def _named(names: str, inside: bool) -> str:
    """`else` if a name says in full that this is no content, `maybe` if one holds such a word, or ``."""
    out = ""
    for name in names.split():
        parts = [x.lower() for x in WORDS.findall(name)]
        if any(x in ELSE for x in parts):
            if all(x in ELSE or x in FRAME for x in parts) and not (inside and OWN & set(parts)):
                return "else"
            out = "maybe"
    return out


def _no_content(node: Node, inside: bool, template: bool) -> bool:
    """inside: within a main element."""
    if node.hidden or node.tag in HIDDEN:
        return True
    if node.tag in ASIDE:
        return not (node.tag == "form" and node.holds_main)
    if node.tag == "header":
        return not inside
    if node.tag in ("main", "body", "html"):
        return False
    named = _named(node.names, inside) if node.names else ""
    if named == "else" and inside and node.names == node.id and node.id.lower() in TOPICS:
        named = "maybe"
    if named == "else":
        return not (node.holds_main and node.tag not in MAIN)
    return named == "maybe" and node.tag not in MAIN and not node.holds_main and (template or node.linked >= LINKED * max(1, node.chars))


def _path(above: int, node: Node) -> int:
    return xxhash.xxh64_intdigest(f"{above}/{node.tag} {node.names}") >> 1


def style_nodes(root: Node) -> list[tuple[int, int, int, int | None]]:
    """(path, presentation, content, whole) of a page's element nodes; nodes of one path count together. whole: content of the main elements, null outside."""
    looks: dict[int, dict[str, None]] = {}
    says: dict[int, int] = {}
    within: set[int] = set()
    whole = 0
    stack = [(root, 0, False)]
    while stack:
        node, path, inside = stack.pop()
        if inside:
            within.add(path)
        elif node.tag in MAIN:
            inside = True
            whole = (whole + node.says) & (1 << 62) - 1
        looks.setdefault(path, {})[",".join(dict.fromkeys(c.tag for c in node.children if isinstance(c, Node)))] = None
        says[path] = (says.get(path, 0) + node.says) & (1 << 62) - 1
        stack += [(c, _path(path, c), inside) for c in reversed(node.children) if isinstance(c, Node) and c.tag not in HIDDEN]
    return [(p, xxhash.xxh64_intdigest("\n".join(x)) >> 1, says[p], whole if p in within else None) for p, x in looks.items()]


def extract(root: Node, template: set[int]) -> str:
    """The text of the blocks of the main elements, without the branches in `template`."""
    mains: list[tuple[Node, int]] = []
    stack = [(root, 0)]
    while stack:
        node, path = stack.pop()
        if node.tag in MAIN:
            inner = [(c, _path(path, c)) for c in node.children if isinstance(c, Node) and c.tag == "article" and not _no_content(c, True, False)] if node.tag == "main" else []
            mains += inner or [(node, path)]
            continue
        stack += [(c, _path(path, c)) for c in reversed(node.children) if isinstance(c, Node) and not _no_content(c, False, False)]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = BLANK.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    for top, at in mains or [(root, 0)]:
        todo: list = [(top, at)]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
                continue
            if isinstance(item, str):
                line.append(item)
                continue
            node, path = item
            if node.tag == "br":
                line.append(" ")
                continue
            block = node.tag not in INLINE
            dull = path in template and node is not top and (block and node.tag not in KEPT or not mains)
            if node is not top and _no_content(node, bool(mains), dull) or dull:
                if block:
                    flush()
                continue
            if block:
                flush()
                todo.append(None)
            for c in reversed(node.children):
                todo.append(c if isinstance(c, str) else (c, _path(path, c)))
        flush()
    return "\n\n".join(blocks)


def importance(nodes: DataFrame) -> DataFrame:
    """host, path, pages, importance. nodes: host, path, look, say, whole. Nodes with a whole count once for each."""
    entropy = lambda n, n_log_n: F.when(n > 1, (F.log(n) - n_log_n / n) / F.log(n)).otherwise(1.0)
    each = lambda n: F.sum(F.col(n) * F.log(n))
    n = nodes.groupBy("host", "path", "look", "say").agg((F.count_if(F.col("whole").isNull()) + F.count_distinct("whole")).alias("n"))
    looks = n.groupBy("host", "path", "look").agg(F.sum("n").alias("m"), entropy(F.sum("n"), each("n")).alias("said"))
    paths = looks.groupBy("host", "path").agg(F.sum("m").alias("pages"), F.count("*").alias("l"), entropy(F.sum("m"), each("m")).alias("shown"), (F.sum(F.col("m") * F.col("said")) / F.sum("m")).alias("said"))
    damped = F.pow(F.lit(DAMPING), F.col("l"))
    return paths.select("host", "path", "pages", ((1 - damped) * F.col("shown") + damped * F.col("said")).alias("importance"))


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html"):
        hosts, out = [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes = style_nodes(parse(html or ""))
            hosts += [host] * len(nodes)
            out += nodes
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), **{k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("path", "look", "say", "whole"))}})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html"):
        texts = [extract(parse(h), set(t or ())) if h else "" for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.nullif(F.lower(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host.alias("host"))
    known = rows.where("host is not null")
    nodes = stage(known.select("host", "html").mapInArrow(_style_rows, "host string, path long, look long, say long, whole long"), "style")
    sizes = known.groupBy("host").agg(F.count("*").alias("of"))
    dull = importance(nodes).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") <= MOST_IMPORTANCE))
    dull = dull.join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("of"))
    templates = stage(dull.groupBy("host").agg(F.collect_list("path").alias("template")), "templates")
    if templates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(templates), "host", "left")
    else:
        templates = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTED - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTED)).cast("int")).join(templates, ["host", "salt"], "left")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("page_id", "url", "html", "template").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
