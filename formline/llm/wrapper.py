"""Main text of web pages by wrapper induction.

Pages of one host are laid over each other: their DOM trees, with runs of like siblings folded, are aligned by
simple tree matching into one template tree per host. A template node knows on how many pages it occurs, how
much text and linked text it holds, and its most frequent texts. Nodes whose text is the same on most pages are
template; so are link lists and elements that name themselves page furniture. The varying nodes are the slots;
where a page has an article or main element, the slots in it count, else those outside the furniture.

Templates are built from all pages: each task folds its own, partial templates meet per host in two steps, so a
host with a third of all pages costs no task more than a few small trees. Each page is then aligned with its
host's template and its slots are read out.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm.common import few_rows, pick
from formline.session import cut

#: Pages that must carry a node before a constant text makes it template, and the share that must agree.
CONSTANT_PAGES, CONSTANT_SHARE = 5, 0.8
#: Share of linked text from which a node outside an article is a link list.
LINKED_SHARE = 0.6
#: Frequent texts kept per node (the least frequent give way).
TEXTS_KEPT = 8
#: Bytes of all templates up to which they are broadcast; above, pages are joined with them.
BROADCAST_BYTES = 16 << 20
#: Groups in which the partial templates of a host meet first.
SALTS = 64

#: Elements and names of page furniture: fixed values.
FURNITURE_TAGS = frozenset(
    "nav header footer aside form script style noscript template head title iframe object svg button select input textarea dialog menu".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav "
    "navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
LANDMARK_TAGS = frozenset(["article", "main"])
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
#: Neighbours of these kinds are folded only if they hold the same elements.
CONTAINER_TAGS = frozenset("div section span table td".split())
#: Elements that an opening tag of the first kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = BLOCK_TAGS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("sig", "children", "place")

    def __init__(self, sig: str):
        self.sig, self.children, self.place = sig, [], 0

    @property
    def tag(self) -> str:
        return self.sig.partition(".")[0]


def parse(source: str) -> Node:
    """Tree of elements and texts; whatever is malformed is taken as far as it goes."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    opened: Counter[str] = Counter()  # open elements by name

    def close(depth: int) -> None:
        opened.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    while at < n:
        found = _TAG.search(source, at)
        if not found:
            stack[-1].children.append(source[at:])
            break
        if found.start() > at:
            stack[-1].children.append(source[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if opened[name] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                close(depth)
            continue
        if name in ENDS_PARAGRAPH and opened["p"] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCK_TAGS:
                    break
        for depth in range(len(stack) - 1 if name in ENDS else 0, 0, -1):
            if stack[depth].tag in ENDS[name]:
                close(depth)
                break
            if stack[depth].tag in BLOCK_TAGS:
                break
        names = sorted({w for m in _NAMES.finditer(found[3]) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}) if found[3] else []
        node = Node(".".join([name, *names]))
        stack[-1].children.append(node)
        if name in VOID_TAGS or found[3].rstrip().endswith("/") and name not in BLOCK_TAGS:
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[name] += 1
    return root


def furniture(sig: str) -> bool:
    tag, *names = sig.split(".")
    return tag in FURNITURE_TAGS or (tag not in LANDMARK_TAGS and tag not in ("html", "body") and not FURNITURE_NAMES.isdisjoint(names))


# A template node: [sig, pages, characters, linked characters, {text hash: pages}, children]. Pages may be nested to any
# depth, so nothing here calls itself.


def shape(node: Node, linked: bool = False) -> list:
    """Template of a single page: like neighbours are folded into one node; ``place`` names each node's own one."""
    own = [node.sig, 1, 0, 0, {}, []]
    kinds = _kinds(node)
    todo = [([node], own, linked)]
    while todo:
        nodes, made, above = todo.pop()
        todo += _fold(nodes, made, above, kinds)
    number(own)
    return own


def _kinds(root: Node) -> dict[int, int]:
    """What neighbours must share to be folded, as a number for each node (by identity)."""
    order, numbers, kinds = [root], {}, {}
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        inner = dict.fromkeys(kinds[id(c)] for c in node.children if isinstance(c, Node)) if node.tag in CONTAINER_TAGS else ()
        kinds[id(node)] = numbers.setdefault((node.sig, tuple(inner)), len(numbers))
    return kinds


def _fold(nodes: list[Node], own: list, linked: bool, kinds: dict[int, int]) -> list[tuple[list[Node], list, bool]]:
    """Fills ``own`` from the nodes folded into it; the groups of their children are still to be folded."""
    texts, size = [], 0
    made: dict[int, list[Node]] = {}  # children of one node, or of several folded ones, by kind in order of appearance
    for node in nodes:
        node.place = own
        for child in node.children:
            if isinstance(child, Node):
                made.setdefault(kinds[id(child)], []).append(child)
            elif child := child.strip():
                texts.append(child)
                size += len(child)
    inside = linked or own[0].partition(".")[0] == "a"
    own[2], own[3] = size, size if inside else 0
    if texts:
        own[4] = {zlib.crc32("\n".join(texts).encode("utf-8", "surrogatepass")): 1}
    own[5] += [[group[0].sig, 1, 0, 0, {}, []] for group in made.values()]
    return [(group, child, inside) for group, child in zip(made.values(), own[5])]


def number(template: list) -> list[list]:
    """All nodes in document order."""
    out = [template]
    for node in out:
        out.extend(node[5])
    return out


def dumps(template: list) -> str:
    """A template as JSON without nesting: each node in document order with the number of its children."""
    return json.dumps([[*node[:5], len(node[5])] for node in number(template)])


def loads(blob: str) -> list:
    nodes = json.loads(blob)
    at = 1
    for node in nodes:
        node[5], at = nodes[at : at + node[5]], at + node[5]
    return nodes[0]


def form(template: list) -> str:
    out, todo = [], [template]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        out.append(node[0])
        if node[5]:
            todo.append(")")
            for i, child in enumerate(reversed(node[5])):
                todo += [",", child] if i else [child]
            todo.append("(")
    return "".join(out)


def _aligned(a: list, b: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """``matching`` of the two nodes and of all nodes below them that may meet, by identity."""
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    order = [(a, b)]
    for x, y in order:
        order.extend((c, d) for c in x[5] for d in y[5] if c[0] == d[0])
    for x, y in reversed(order):
        known[id(x), id(y)] = _matched(x[5], y[5], known)
    return known


def _matched(left: list, right: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    gain = [[0] * len(right) for _ in left]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            gain[i][j] = known[id(x), id(y)][0] if x[0] == y[0] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs[::-1]


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of one signature: nodes matched in all, and the pairs of their children."""
    return _aligned(a, b)[id(a), id(b)]


def _add(a: list, b: list) -> None:
    for k in (1, 2, 3):
        a[k] += b[k]
    for key, n in b[4].items():
        a[4][key] = a[4].get(key, 0) + n
    if len(a[4]) > TEXTS_KEPT:
        a[4] = dict(sorted(a[4].items(), key=lambda x: (-x[1], x[0]))[:TEXTS_KEPT])


def merge_same(a: list, b: list) -> None:
    """``merge`` of two templates of one form: every node meets its own place."""
    for x, y in zip(number(a), number(b)):
        _add(x, y)


def merge(a: list, b: list) -> None:
    """Adds template ``b`` of the same signature to ``a``: aligned nodes add up, others are put in place."""
    known, todo = _aligned(a, b), [(a, b)]
    while todo:
        a, b = todo.pop()
        _add(a, b)
        out, i, j = [], 0, 0
        for x, y in [*known[id(a), id(b)][1], (len(a[5]), len(b[5]))]:
            out += a[5][i:x] + b[5][j:y]
            if x < len(a[5]) and y < len(b[5]):
                todo.append((a[5][x], b[5][y]))
                out.append(a[5][x])
            i, j = x + 1, y + 1
        a[5] = out


def has_landmark(node: list) -> bool:
    """Whether an article or main element stands outside the furniture."""
    todo = [node]
    while todo:
        node = todo.pop()
        if not furniture(node[0]):
            if node[0].partition(".")[0] in LANDMARK_TAGS:
                return True
            todo += node[5]
    return False


def slots(template: list, landmarks: bool) -> dict[int, bool]:
    """Whether each template node (by identity) is content, for pages with or without a landmark."""
    found: dict[int, bool] = {}
    weights: dict[int, tuple[int, int]] = {}  # text and linked text of a node and all below it
    for node in reversed(number(template)):
        below = [weights[id(child)] for child in node[5]]
        weights[id(node)] = node[2] + sum(s for s, _ in below), node[3] + sum(k for _, k in below)
    todo = [(template, False, False)]
    while todo:
        node, inside, out = todo.pop()
        tag = node[0].partition(".")[0]
        inside = inside or tag in LANDMARK_TAGS
        out = out or furniture(node[0])
        if not inside and not landmarks and not out and tag in ("ul", "ol", "div", "section", "table", "p"):
            size, linked = weights[id(node)]
            out = size > 0 and linked >= LINKED_SHARE * size
        constant = not inside and node[1] >= CONSTANT_PAGES and max(node[4].values(), default=0) >= CONSTANT_SHARE * node[1]
        found[id(node)] = (inside or not landmarks) and not out and not constant
        todo += [(child, inside, out) for child in node[5]]
    return found


def labels(page: list, template: list) -> dict[int, bool]:
    """Content or not for each node of a page's shape, by its place in the host's template."""
    known, out, aligned = slots(template, has_landmark(page)), {}, _aligned(page, template)
    todo: list[tuple[list, list | None, bool, bool]] = [(page, template, False, False)]
    while todo:
        node, other, above, barred = todo.pop()
        barred = barred or furniture(node[0])
        mine = known[id(other)] if other is not None else above and not barred
        out[id(node)] = mine
        pairs = dict(aligned[id(node), id(other)][1]) if other is not None else {}
        for i, child in enumerate(node[5]):
            todo.append((child, other[5][pairs[i]] if i in pairs else None, mine or child[0].partition(".")[0] in LANDMARK_TAGS, barred))
    return out


def blocks(root: Node, wanted: dict[int, bool]) -> list[str]:
    """Texts of content nodes in page order, one per block element, white space folded."""
    out, line = [], []

    def end() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [root]
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, tuple):
            line.append(node[0])
        else:
            breaks = node.tag in BLOCK_TAGS
            if breaks:
                end()
                todo.append(None)
            keep = wanted[id(node.place)]
            for child in reversed(node.children):
                if isinstance(child, str):
                    if keep:
                        todo.append((child,))
                else:
                    todo.append(child)
    end()
    return out


def _host() -> F.Column:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host.alias("host")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template json): one template for each host, from all its pages."""
    rows = pick(pages, url=url_col, html=html_col).select(_host(), "html")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[str, str], list] = {}
        for batch in few_rows(batches):
            for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                if source:
                    own = shape(parse(source))
                    key = host, form(own)
                    if key in held:
                        merge_same(held[key], own)
                    else:
                        held[key] = own
        salt, out = TaskContext.get().partitionId() % SALTS, {}
        for (host, _), template in sorted(held.items(), key=lambda x: x[0]):
            if host in out:
                merge(out[host], template)
            else:
                out[host] = template
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([salt] * len(out), pa.int32()), pa.array([dumps(t) for t in out.values()])], names=["host", "salt", "template"])

    def meet(group: pa.Table) -> pa.Table:
        blobs = sorted(group["template"].to_pylist())
        whole = loads(blobs[0])
        for blob in blobs[1:]:
            merge(whole, loads(blob))
        return group.select(["host", "salt"]).slice(0, 1).append_column("template", pa.array([dumps(whole)]))

    partial = rows.mapInArrow(fold, "host string, salt int, template string")
    schema = "host string, salt int, template string"
    return partial.groupBy("host", "salt").applyInArrow(meet, schema).groupBy("host").applyInArrow(meet, schema).select("host", "template")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page; text is empty where there is no content.

    A missing or empty html has no text. A page without a host (missing url) shares the template of all such
    pages. Repeated rows each give a row.
    """
    templates = cut(induce(pages, url_col, html_col))
    size = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    known = F.broadcast(templates) if size <= BROADCAST_BYTES else templates
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        decided: dict[tuple[str, str], list[bool]] = {}
        for batch in few_rows(batches):
            texts = []
            for source, template in zip(batch["html"].to_pylist(), batch["template"].to_pylist()):
                if not source or template is None:
                    texts.append("")
                    continue
                root = parse(source)
                own = shape(root)
                key = template, form(own)
                if len(decided) > 4096:
                    decided.clear()
                    parsed.clear()
                if key not in decided:
                    if template not in parsed:
                        parsed[template] = loads(template)
                    found = labels(own, parsed[template])
                    decided[key] = [found[id(x)] for x in number(own)]
                wanted = {id(x): keep for x, keep in zip(number(own), decided[key])}
                texts.append("\n".join(blocks(root, wanted)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    with_host = rows.withColumn("host", _host())
    joined = with_host.join(known, "host", "left").select("id", "url", "html", "template")
    return joined.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
