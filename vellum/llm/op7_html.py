"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: a node is the path of element names and classes from the root. For each
node, the pages' contents (texts below it) and presentations (sequences of its children) are counted; their entropies,
by the number of pages that have the node, say how much it differs between the site's pages. The content's entropy is
taken relative to that of the whole article (inside one) or page: a site whose pages are copies says nothing about its
nodes. A node's importance is this entropy, lessened by what the markup tells of it: elements for menus, footers,
asides or forms, hidden ones, words of class and id (STRONG, WEAK; weak ones within an article only lessen it), a place
outside the article, and the share of link text there. Nodes below LOW are the site's low branches, and every page
loses its low branches; nothing else is removed but elements without text of the page (TEXTLESS). Headings,
paragraphs, list items and the like within an article are judged with their container, not on their own, and an
article with the elements it lies in stays (not text that stands bare in these); a page without one keeps the branch
with most of its text.

Counts are pre-aggregated for each host, path and value, so a host with a third of all pages is no single task.

Defined results: null and empty html give ''; a url without a host counts as the site ''; nodes of fewer than FEWEST
pages of a site are judged by markup and place alone; white space is what str.split takes as such; repeated rows
repeat; columns other than page_id, url and html are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEWEST, LOW, CONTENT_WEIGHT, LONGEST = 8, 0.15, 0.9, 400
#: What is left of a node's importance: declared noise, weak words within and outside an article, outside an article.
DECLARED, HINTED, NAMED, OUTSIDE, FIRM = 0.1, 0.3, 0.14, 0.4, 0.5

#: Fixed lists of element names and words of class and id.
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
TEXTLESS = frozenset("script style noscript template iframe object embed svg canvas head title audio video map xmp noembed noframes textarea".split())
NOISE_TAGS = frozenset("nav footer aside form button select input dialog menu search".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus reply replies pagination pager skiplink".split())
WEAK = frozenset("banner promo promotion notice notices notification alert popup modal overlay header respond share sharing social related recommended recommendations widget widgets skip copyright legal disclaimer".split())
PHRASE = frozenset("a abbr b bdi bdo cite code data em font i kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements of an article that are not judged on their own.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre br hr blockquote address summary".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Start tags that close an open element of the kinds given.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
STOPS = frozenset("table ul ol dl article section main body div td th nav footer aside form header".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
DIGIT = re.compile(r"[0-9]")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element: its name, classes, children (elements and texts) and what markup tells of it (see declared)."""

    __slots__ = ("tag", "name", "parts", "noise")

    def __init__(self, tag: str, name: str, noise: int):
        self.tag, self.name, self.parts, self.noise = tag, name, [], noise


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def declared(tag: str, attr: dict[str, str], within: bool) -> int:
    """4 for elements without text of the page, 3 for noise by name, role or hiding, 2 and 1 by strong and weak words of class and id, else 0; within: inside an article, where a header may hold its title."""
    if tag in TEXTLESS:
        return 4
    if tag in NOISE_TAGS or tag == "header" and not within:
        return 3
    if not attr or tag in ("html", "body", "main", "article"):
        return 0 if tag != "article" or STRONG.isdisjoint(words_of(attr)) else 2
    if "hidden" in attr or attr.get("aria-hidden") == "true" or attr.get("role", "").lower() in NOISE_ROLES or re.search(r"display\s*:\s*none", attr.get("style", "")):
        return 3
    names = words_of(attr)
    if within and "header" in names:
        return 0
    return 2 if not STRONG.isdisjoint(names) else int(not WEAK.isdisjoint(names))


def words_of(attr: dict[str, str]) -> list[str]:
    return WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attr.get("class", "") + " " + attr.get("id", "")).lower())


def settle(root: Node) -> Node:
    """Takes back noise by words where they name a layout ("has-sidebar") around the article, or around a heading and most of the text."""
    nodes = list(walk(root))
    known: dict[int, tuple[bool, bool, int]] = {}
    for node in reversed(nodes):
        article, heading, size = False, False, 0
        for part in node.parts:
            if isinstance(part, str):
                size += len(part)
            elif part.noise < 3:
                a, h, n = known[id(part)]
                article, heading, size = article or a or part.tag in ("article", "main") and not part.noise, heading or h or part.tag == "h1", size + n
        known[id(node)] = article, heading, size
    whole = known[id(root)][2]
    for node in nodes:
        article, heading, size = known[id(node)]
        if node.noise in (1, 2) and node.tag != "article" and (article or heading and 2 * size > whole):
            node.noise = 0
    return root


def parse(html: str) -> Node:
    """The tree of a page; elements left open end with their parents, stray end tags are ignored."""
    root = Node("", "", 0)
    stack = [root]
    open_: Counter = Counter()  # elements on the stack by name

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    def close_last(kind: str) -> None:
        """Ends the innermost open element of a kind, unless a closer one shields it."""
        if open_[kind]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == kind:
                    close(i)
                    break
                if stack[i].tag in STOPS:
                    break

    at, n = 0, len(html)
    low = None
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("article", "main", "body") and tag not in ("body", "html", "main", "article"):
                        break
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag == "body":
            close(1 + (len(stack) > 1 and stack[1].tag == "html"))
        for kind in CLOSES.get(tag, ()):
            close_last(kind)
        if tag in BLOCK:  # a block ends an open paragraph
            close_last("p")
        attr = attributes(m[3])
        # classes with digits are often a page's own
        name = tag + "".join("." + c for c in sorted(attr.get("class", "").split()) if c.isascii() and not DIGIT.search(c))
        node = Node(tag, name, declared(tag, attr, open_["article"] + open_["main"] > 0))
        stack[-1].parts.append(node)
        if tag in RAW:
            if low is None:
                low = html.lower() if len(html.lower()) == n else html
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else end
        elif tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append(node)
        open_[tag] += 1
    return settle(root)


def text_of(root: Node, drop: frozenset[str] | set[str] = frozenset(), keep: set[int] | frozenset[int] = frozenset(), around: set[int] | frozenset[int] = frozenset(), start: str = "") -> list:
    """Pieces of text in page order, None between blocks; without dropped paths, but for kept nodes, and without what stands bare in the nodes around an article. start: the root's path."""
    out: list = []
    todo = [(iter([root]), start, False, False)]
    while todo:
        parts, path, block, bare = todo[-1]
        part = next(parts, todo)
        if part is todo:
            todo.pop()
            if block:
                out.append(None)
        elif isinstance(part, str):
            if not bare:
                out.append(part)
        else:
            own = path if part is root else step(path, part)
            block = part.tag in BLOCK
            if block:
                out.append(None)
            if part.noise == 4 or own in drop and id(part) not in keep or bare and part.tag in PHRASE:
                continue
            if part.tag == "br":
                out.append(" ")
            else:
                todo.append((iter(part.parts), own, block, id(part) in around))
    return out


def step(path: str, node: Node) -> str:
    """The path of a node below path; what markup tells of it is part of its name. Long paths are cut to a digest."""
    own = f"{path}/{node.name}{'~?!'[node.noise - 1] if 0 < node.noise < 4 else ''}"
    return own if len(own) <= LONGEST else f"{own[:1]}#{stamp(own)}"


def joined(pieces: list) -> str:
    """Blocks with single spaces inside, joined by one space."""
    blocks, now = [], []
    for p in [*pieces, None]:
        if p is None:
            if now:
                blocks.append(" ".join(entities.unescape("".join(now)).split()))
                now = []
        else:
            now.append(p)
    return " ".join(b for b in blocks if b)


def walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))


def articles(root: Node) -> tuple[list[Node], set[int]]:
    """The outermost main elements, or else articles, outside noise, and the ids of these and all they lie in."""
    for tag in ("main", "article"):
        found, around, todo = [], set(), [(root, ())]
        while todo:
            node, above = todo.pop()
            if node.noise:
                continue
            if node.tag == tag:
                found.append(node)
                around.update((*above, id(node)))
            else:
                todo.extend((p, (*above, id(node))) for p in reversed(node.parts) if isinstance(p, Node))
        if found:
            return found, around
    return [], set()


def extract(html: str | None, drop: set[str] | frozenset[str] = frozenset()) -> str:
    """The text of a page without the branches in drop, its site's nodes of low importance."""
    if not html:
        return ""
    root = parse(html)
    own, keep = articles(root)
    if not own and drop:
        # the branch with most text stays even if it hardly differs between pages
        size: dict[int, int] = {}
        for node in reversed(list(walk(root))):
            size[id(node)] = sum(len(p) if isinstance(p, str) else size[id(p)] for p in node.parts) if not node.noise else 0
        node = root
        while node is not None:
            keep.add(id(node))
            parts = [p for p in node.parts if isinstance(p, Node) and not p.noise]
            node = max(parts, key=lambda p: size[id(p)], default=None)
    return joined(text_of(root, drop, keep, keep - {id(a) for a in own} if own else set(), "+" if own else ""))


def host(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def stamp(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Paths that stand for a page's whole text outside noise, and for that of its articles.
PAGE, ARTICLE = "page", "article"


def observe(html: str | None) -> list[tuple[str, float, bool, int, int, int, int]]:
    """(path, weight, firm, content, presentation, letters, letters in links) of the page's nodes; nodes of one path count together.

    weight: what markup and place leave of the importance; firm: whether it is at least FIRM before that. Nodes that are
    low by their weight alone come without contents, and what is below them not at all.
    """
    if not html:
        return []
    root = parse(html)
    own, around = articles(root)
    inside_of = {id(a) for a in own}
    # from the root: each node with its path, its weight if it is judged, and whether it is in an article or a link
    down: list = []
    todo: list = [(root, "+" if own else "", False, False)]
    while todo:
        node, path, inside, link = todo.pop()
        if node.noise == 4:
            continue
        inside, link = inside or id(node) in inside_of, link or node.tag == "a"
        weight = None
        if node is not root and node.tag not in ("html", "body") and (node.noise or node.tag in BLOCK and not (inside and node.tag in INNER)):
            weight = (1.0, HINTED if inside else NAMED, DECLARED, DECLARED)[node.noise] * (OUTSIDE if own and not inside and id(node) not in around else 1.0)
        down.append((node, path, weight, inside, link))
        if weight is None or weight >= LOW:
            todo.extend((p, step(path, p), inside, link) for p in reversed(node.parts) if isinstance(p, Node))
    # from the leaves: digests of contents, letters, and letters in links
    made: dict[int, tuple[str, int, int]] = {}
    found: dict[str, list] = {}  # path: weight, firm, contents, looks, letters, links
    texts: list[str] = []
    for node, path, weight, inside, link in reversed(down):
        if weight is not None and weight < LOW:
            found.setdefault(path, [weight, False, [], [], 0, 0])
            continue
        pieces, letters, links = [], 0, 0
        for p in node.parts:
            if isinstance(p, str):
                if plain := p.strip():
                    pieces.append(plain)
                    letters += len(plain)
                    links += len(plain) * link
            elif id(p) in made:
                digest, size, linked = made[id(p)]
                pieces.append(digest)
                letters, links = letters + size, links + linked
        digest = str(stamp("\0".join(x for x in pieces if x))) if letters else ""
        made[id(node)] = digest, letters, links
        if weight is not None:
            seen = found.setdefault(path, [weight, id(node) in around, [], [], 0, 0])
            seen[2].append(digest)
            seen[3].append(",".join(p.tag for p in node.parts if isinstance(p, Node)))
            seen[4] += letters
            seen[5] += 0 if inside else links
        if id(node) in inside_of:
            texts.append(digest)
    out = [(path, w, firm, stamp("\0".join(sorted(contents))), stamp("|".join(looks)), size, links) for path, (w, firm, contents, looks, size, links) in found.items()]
    out.append((PAGE, 1.0, True, stamp(made[id(root)][0]), 0, 0, 0))
    if own:
        out.append((ARTICLE, 1.0, True, stamp("\0".join(texts)), 0, 0, 0))
    return out


def style_tree(pages: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(host, path, pages, importance) of the nodes of each site."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                counts: dict[tuple, list[int]] = {}
                for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    site = host(url)
                    for path, weight, firm, content, look, size, links in observe(html):
                        for kind, value in ((0, content), (1, look)):
                            seen = counts.setdefault((site, path, weight, firm, kind, value), [0, 0, 0])
                            seen[0] += 1
                            if not kind:
                                seen[1] += size
                                seen[2] += links
                if counts:
                    keys, sums = list(zip(*counts)), list(zip(*counts.values()))
                    kinds = (pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), *(pa.array(x, pa.int64()) for x in sums)], names=["host", "path", "weight", "firm", "kind", "value", "n", "size", "links"])

    seen = pages.select("url", "html").mapInArrow(run, "host string, path string, weight double, firm boolean, kind int, value long, n long, size long, links long")
    node = ["host", "path", "weight", "firm"]
    values = seen.groupBy(*node, "kind", "value").agg(*[F.sum(c).alias(c) for c in ("n", "size", "links")])
    sums = [F.sum(F.when(F.col("kind") == k, x)).alias(f"{c}{k}") for k in (0, 1) for c, x in (("n", F.col("n")), ("s", F.col("n") * F.log("n")))]
    nodes = values.groupBy(*node).agg(*sums, F.sum("size").alias("size"), F.sum("links").alias("links"))

    def entropy(k: int) -> Column:
        n = F.col(f"n{k}").cast("double")
        return F.when(n >= fewest, F.greatest(F.lit(0.0), (F.log(n) - F.col(f"s{k}") / n) / F.log(n))).otherwise(1.0)

    nodes = nodes.select(*node, F.col("n0").alias("pages"), entropy(0).alias("content"), entropy(1).alias("look"), F.coalesce(F.col("links") / F.when(F.col("size") > 0, F.col("size")), F.lit(0.0)).alias("links"), F.col("path").isin(PAGE, ARTICLE).alias("whole"))
    scope = nodes.where("whole").groupBy("host").agg(*[F.max(F.when(F.col("path") == p, F.col("content"))).alias(p) for p in (PAGE, ARTICLE)])
    nodes = nodes.where("not whole").join(scope, "host")
    reference = F.coalesce(F.when(F.col("path").startswith("+"), F.col(ARTICLE)), F.col(PAGE))
    relative = F.when(reference < LOW, 1.0).otherwise(F.least(F.lit(1.0), F.col("content") / reference))
    differs = CONTENT_WEIGHT * relative + (1 - CONTENT_WEIGHT) * F.col("look")
    importance = F.col("weight") * F.when(F.col("firm"), F.greatest(differs, F.lit(FIRM))).otherwise(differs) * (1 - F.col("links"))
    return nodes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.max(importance).alias("importance"))


def low_nodes(pages: DataFrame, fewest: int = FEWEST, low: float = LOW) -> DataFrame:
    """(host, drop): the paths of low importance at each site."""
    tree = style_tree(pages, fewest)
    return tree.where(F.col("importance") < low).groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("drop"))


def main_text(pages: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars); drops: the low nodes of each site, found in these pages if None."""
    drops = common.materialize(low_nodes(pages) if drops is None else drops, "low")
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
    own = pages.select("page_id", "url", "html", site.alias("host")).join(drops, "host", "left").select("page_id", "url", "html", "drop")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, frozenset(d or ())) for h, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return common.map_arrow(own, one, f"page_id {kind}, url string, text string, n_chars long", text=2)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))


QUERIES = {"op7_main_text": op7_main_text}
