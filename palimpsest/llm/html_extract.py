"""Operator 1: main text of web pages by wrapper induction.

Pages of one host share a template. Each host's wrapper is grown from several of
its pages, so that every place in the tree (tags and numbers on the way to it)
that ``CONSTANT_PAGES`` pages have is in it: for each such place one page is
taken, and what the wrapper lacks of it is put in beside what both have. Null,
empty, broken or odd pages thus can't stand for a host. Every page is aligned
with the wrapper by simple tree matching (the largest order-preserving mapping
between two trees that respects tags and ancestors), and so all pages with each
other. Per node of the wrapper, the pages that have it and the pages that have
the same text there are counted. A text that most pages have in the same node is
template; what varies, or has no counterpart, fills the template's slots and is
content. Copies of a page count as one: they say nothing about what is constant.

Varying slots also hold menus, adverts and footers; which slot is the article is
learnt too. For each container of the wrapper the mean share of a page's text
that lies in it is taken over all pages that have it. From the root on, the
child that holds ``MAIN_SHARE`` or more is entered, until a container has a
heading of its own or marks itself as an article: that is the main slot. Several
layouts of a host have a slot each. A page whose host has no wrapper is judged by
itself in the same way.

Tags, roles, classes and ids are priors: elements that they name as something
else are left out with all they contain, and of the slot only the part counts
that is marked as article or main part, if there is one; inside such a part only
whole and plain names count. If nothing were left of a marked article, its
constant text stays.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one newline in page order. Null and
empty pages, and those without content, have an empty text. Markup may be
broken: unclosed elements end where HTML ends them. Elements nested deeper than
``DEPTH`` count as if they lay side by side, their texts stay. Very long pages are
read whole; child lists of more than ``CELLS`` pairs are mapped in order by tag
instead of by the dynamic programme. Pages without a host form one group of their own. Repeated rows give
equal rows.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, as_batches, stored, texts
from palimpsest.llm.url_rules import host_of

#: A text is template in a node if this share of the pages that have the node have it, and this many at least.
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 3
#: Share of a page's text that the main slot holds; nesting that is told apart; pairs of children that are weighed.
MAIN_SHARE, DEPTH, CELLS = 0.5, 100, 40_000
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is known of all hosts together is broadcast up to this size; beyond it pages are joined with it by host.
BROADCAST_BYTES = 32 << 20

# Fixed values of HTML: elements whose content is no markup or no text, that have no end tag, that end a paragraph, and that separate blocks.
RAW = "script style noscript template iframe textarea title svg object select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul button".split()
)
ENDS_P = BLOCKS - frozenset("button caption tbody td tfoot th thead tr html head body".split())
OPTIONAL_END = frozenset("p li dt dd tr td th tbody thead tfoot caption body html head".split())
#: An element that starts ends open ones of these tags, up to the nearest of the second set.
IMPLIED = {
    tag: (frozenset(ends.split()), frozenset(stop.split()))
    for tag, ends, stop in (
        ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"),
        ("tbody", "tr td th tbody thead", "table"), ("tfoot", "tr td th tbody thead", "table"),
    )
}
LEFT_OUT = frozenset("head nav footer aside form dialog menu button search".split())
MARKED = frozenset(("article", "main"))
_ROLE = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|dialog|alert|alertdialog|menu|menubar|toolbar)\b""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?=[\s=]|$)(?!-)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")
#: Words that tell an article's own header from the page's.
OWN_HEADER = frozenset("article entry post story".split())
#: Words in a class or id that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
#: Of these, what says little about a part inside an article.
VAGUE = frozenset("alert aside discussion notices related reply replies respond share sharing skip social teaser toolbar topbar widget widgets".split())
_TOKEN = re.compile(
    rf"""<(?:!--.*?(?:-->|\Z)|(?P<raw>{RAW.replace(" ", "|")})(?=[\s>/])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|[!?][^>]*>
    |(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>)""",
    re.I | re.S | re.X,
)


_NOWHERE, _P, _P_STOP = frozenset(), frozenset(("p",)), frozenset(("td", "th", "button", "caption", "article", "section", "div", "main", "body", "li"))


class Node:
    """A block element, or with tag "" a piece of text. ``shape`` identifies the tags below; ``out`` marks boilerplate."""

    __slots__ = ("children", "number", "out", "shape", "size", "tag", "text")

    def __init__(self, tag: str, text: str = "", out: bool = False):
        self.tag, self.text, self.out, self.children, self.shape, self.size, self.number = tag, text, out, [], 0, 1, -1


def _is_boilerplate(tag: str, rest: str, stack: list[Node]) -> bool:
    if tag in LEFT_OUT or tag == "header" and not any(n.tag in MARKED for n in stack):
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    if _ROLE.search(rest) or _HIDDEN.search(rest):
        return True
    names = [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(rest)]
    words = {w.lower() for name in names for w in _WORD.findall(name)}
    inside = any(n.tag in MARKED for n in stack)
    if tag in ("body", "html"):
        return False
    if tag in MARKED and not inside:
        return bool(words & {"comment", "comments"})
    if inside:
        return bool({w.lower() for name in names for w in name.split()} & (BOILERPLATE - VAGUE))
    return bool(words & BOILERPLATE) or "header" in words and not inside and not words & OWN_HEADER


def parse(page: str) -> Node:
    """The tree of block elements; inline markup melts into the text around it, except inline elements that are boilerplate."""
    root = Node("#")
    stack = [root]
    parts: list[str] = []
    skipped: list[str] = []  # open inline elements that are left out
    sunk: dict[str, int] = {}  # open elements beyond DEPTH

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            stack[-1].children.append(Node("", text))

    def close(wanted: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in wanted:
                del stack[k:]
                return
            if tag in stop:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start > at and not skipped:
            parts.append(page[at:start])
        at = m.end()
        _, end, tag, rest, end2, tag2, rest2 = m.groups()
        if tag is None:
            if tag2 is None:
                continue
            end, tag, rest = end2, tag2, rest2
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                if not skipped:
                    parts.append(" ")
            elif end:
                if tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
            elif tag not in VOID and not rest.endswith("/") and (skipped or rest and _is_boilerplate(tag, rest, stack)):
                skipped.append(tag)
            continue
        if parts:
            flush()
        if skipped:
            skipped.clear()
        if end:
            if sunk.get(tag):
                sunk[tag] -= 1
            elif stack[-1].tag == tag:
                if len(stack) > 1:
                    stack.pop()
            else:
                close(frozenset((tag,)), _NOWHERE)
            continue
        if tag in ENDS_P:
            if stack[-1].tag == "p":
                stack.pop()
            else:
                close(_P, _P_STOP)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in VOID:
            continue
        node = Node(tag, out=_is_boilerplate(tag, rest, stack))
        stack[-1].children.append(node)
        if len(stack) < DEPTH or node.out and len(stack) == DEPTH:
            stack.append(node)
        elif tag not in OPTIONAL_END:
            sunk[tag] = sunk.get(tag, 0) + 1
    if not skipped:
        parts.append(page[at:])
    flush()
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Shapes, sizes and numbers in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.number = len(order)
        order.append(n)
        if n.children:
            stack += n.children[::-1]
    for n in reversed(order):
        if n.children:
            n.size = 1 + sum([c.size for c in n.children])
            n.shape = hash((n.tag, *[c.shape for c in n.children]))
        else:
            n.shape = hash(n.tag)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest mapping. Equal heads and tails of two child lists are mapped directly, which loses nothing."""
    if a.tag != b.tag:
        return []
    memo: dict[tuple[int, int], int] = {}

    def weight(x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        found = memo.get((x.number, y.number))
        if found is None:
            found = memo[x.number, y.number] = 1 + sum(weight(p, q) for p, q in match(x, y))
        return found

    def match(x: Node, y: Node) -> list[tuple[Node, Node]]:
        xs, ys = x.children, y.children
        low, most = 0, min(len(xs), len(ys))
        while low < most and xs[low].shape == ys[low].shape:
            low += 1
        tail = 0
        while tail < most - low and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        out = list(zip(xs[:low], ys[:low], strict=True))
        left, right = xs[low : len(xs) - tail], ys[low : len(ys) - tail]
        if left and right:
            out += _best(left, right, weight)
        if tail:
            out += zip(xs[-tail:], ys[-tail:], strict=True)
        return out

    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        stack += match(x, y)
    return pairs


def _best(xs: list[Node], ys: list[Node], weight) -> list[tuple[Node, Node]]:
    """The dynamic programme over two child lists; long ones are mapped in order by tag."""
    if len(xs) * len(ys) > CELLS:
        pairs, at, places_of = [], 0, {}
        for i, x in enumerate(xs):
            places_of.setdefault(x.tag, []).append(i)
        for y in ys:
            there = places_of.get(y.tag, [])
            k = bisect_left(there, at)
            if k < len(there):
                pairs.append((xs[there[k]], y))
                at = there[k] + 1
        return pairs
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(row[j], above[j + 1], above[j] + weight(x, y)))
        rows.append(row)
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out[::-1]


def skeleton(root: Node) -> bytes:
    """A wrapper's tree without texts: tags and numbers of children in page order."""
    flat, stack = [], [root]
    while stack:
        n = stack.pop()
        flat.append((n.tag, len(n.children)))
        stack += n.children[::-1]
    return zlib.compress(pickle.dumps(flat))


def unpack(data: bytes) -> Node:
    flat = pickle.loads(zlib.decompress(data))
    root = Node(flat[0][0])
    stack = [(root, flat[0][1])]
    for tag, n in flat[1:]:
        while not stack[-1][1]:
            stack.pop()
        parent, left = stack[-1]
        stack[-1] = (parent, left - 1)
        node = Node(tag)
        parent.children.append(node)
        stack.append((node, n))
    _finish(root)
    return root


def grow(wrapper: Node, page: Node) -> None:
    """Puts the page's nodes that have no counterpart into the wrapper, before the next that has one."""
    partner = {y.number: x for x, y in align(wrapper, page)}
    stack = [(wrapper, page)]
    while stack:
        x, y = stack.pop()
        own, children = {id(c): k for k, c in enumerate(x.children)}, []
        at = 0
        for c in y.children:
            mate = partner.get(c.number)
            if mate is None:
                children.append(c)
            else:
                children += x.children[at : own[id(mate)] + 1]
                at = own[id(mate)] + 1
                stack.append((mate, c))
        x.children = children + x.children[at:]
    _finish(wrapper)


def places(root: Node) -> list[int]:
    """Identifies each place outside boilerplate by the tags on the way to it and their numbers among siblings of the same tag."""
    out, stack = [], [(root, 0)]
    while stack:
        n, above = stack.pop()
        seen: dict[str, int] = {}
        for c in n.children:
            if not c.out:
                seen[c.tag] = k = seen.get(c.tag, 0) + 1
                place = _signed(xxhash.xxh64_intdigest(f"{above} {k} {c.tag}"))
                out.append(place)
                stack.append((c, place))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def matches(page: Node, wrapper: Node) -> dict[int, int]:
    """The page's nodes -> wrapper nodes."""
    return {y.number: x.number for x, y in align(wrapper, page)}


def shares(page: Node, placed: dict[int, int]) -> dict[int, float]:
    """Wrapper containers that the page has -> the share of its text in them."""
    order, stack = [], [page]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not c.out]
    mass: dict[int, int] = {}
    for n in reversed(order):
        mass[n.number] = len(n.text) + sum(mass[c.number] for c in n.children if not c.out)
    whole = max(1, mass[page.number])
    return {placed[n.number]: mass[n.number] / whole for n in order if n.number in placed and any(c.tag for c in n.children)}


def main_slots(wrapper: Node, share: dict[int, float]) -> list[tuple[int, int]]:
    """Spans of wrapper nodes: the containers that hold the article, given the mean shares; none if no child of the root holds enough."""
    out, stack = [], [(wrapper, False)]
    while stack:
        n, entered = stack.pop()
        heavy = [c for c in n.children if c.tag and share.get(c.number, 0.0) >= MAIN_SHARE]
        if entered and (n.tag in MARKED or not heavy or any(c.tag in HEADINGS for c in n.children)):
            out.append((n.number, n.number + n.size - 1))
        else:
            stack += [(c, entered or c.tag not in ("html", "body")) for c in heavy]
    return sorted(out)


def key_of(node: int, text: str) -> int:
    """Identifies a text in a wrapper node."""
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=node))


def blocks(page: Node, placed: dict[int, int]) -> list[tuple[str, int, bool, int]]:
    """The page's blocks outside boilerplate: text, wrapper node (or -1), whether it lies in a marked part, and the nearest wrapper node around it (or -1)."""
    out: list[tuple[str, int, bool, int]] = []
    stack = [(page, False, -1)]
    while stack:
        n, inside, around = stack.pop()
        if n.out:
            continue
        around = placed.get(n.number, around)
        if n.tag == "":
            out.append((n.text, placed.get(n.number, -1), inside, around))
        inside = inside or n.tag in MARKED
        stack += [(c, inside, around) for c in n.children[::-1]]
    return out


def main_text(found: list[tuple[str, int, bool, int]], constant: frozenset[tuple[int, str]], slots: list[tuple[int, int]]) -> str:
    """Content of a page's blocks; ``extracted`` says the same in column functions."""
    slot = [b for b in found if any(low <= b[3] <= high for low, high in slots)]
    marked = [b for b in slot if b[2]] or [b for b in found if b[2]]
    chosen = [b[0] for b in marked or slot or found if (b[1], b[0]) not in constant]
    return "\n".join(chosen or [b[0] for b in marked])


def wrappers_of(rows: DataFrame) -> DataFrame:
    """One row per host with pages that share places: host and wrapper (a skeleton). It grows with the host's places, not with its pages."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places(parse(t.decode("utf-8", "replace"))) if t else [] for t in texts(b, "html")]
            yield from as_batches({"host": (b.column(0), pa.string()), "tag": (b.column(2), pa.int64()), "places": (found, pa.list_(pa.int64()))})

    tagged = rows.select("host", "html", F.xxhash64("html").alias("tag"))
    seen = arrow_map(tagged, ("host", "html", "tag"), find, "host string, tag long, places array<long>")
    shared = seen.select("host", "tag", F.explode("places").alias("place")).groupBy("host", "place").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("tag")).filter(F.col("n") >= CONSTANT_PAGES)
    first = stored(shared.select(F.col("host").alias("first_host"), F.col("tag").alias("first_tag")).distinct())
    chosen = tagged.join(if_small(first, F.length("first_host") + 8), (F.col("host") == F.col("first_host")) & (F.col("tag") == F.col("first_tag"))).select("host", "html")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from as_batches({"host": (b.column(0), pa.string()), "wrapper": ([skeleton(parse((t or b"").decode("utf-8", "replace"))) for t in texts(b, "html")], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                trees = sorted((unpack(x) for x in parts), key=lambda t: -t.size)  # sorting is stable
                for tree in trees[1:]:
                    grow(trees[0], tree)
                out.append(skeleton(trees[0]))
            yield from as_batches({"host": (b.column(0), pa.string()), "wrapper": (out, pa.binary())})

    parts = arrow_map(chosen, ("host", "html"), build, "host string, wrapper binary").groupBy("host").agg(F.array_sort(F.collect_set("wrapper")).alias("parts"))
    return arrow_map(parts, ("host", "parts"), merge, "host string, wrapper binary")


def aligned(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Per page: page_id, url, host, content (its texts' digest), blocks (text, node, key of both, marked, around), shares of containers, and own (blocks in the page's own main slot, where its host has no wrapper)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Node] = {}
        kind = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("key", pa.int64()), ("marked", pa.bool_()), ("around", pa.int32()), ("own", pa.bool_())]))
        parts = pa.list_(pa.struct([("node", pa.int32()), ("millionths", pa.int64())]))
        for b in batches:
            all_content, all_blocks, all_shares = [], [], []
            for page, data in zip(texts(b, "html"), b.column(4).to_pylist(), strict=True):
                tree, wrapper = parse((page or b"").decode("utf-8", "replace")), _known(known, data)
                itself = {k: k for k in range(tree.size)}
                placed = matches(tree, wrapper) if wrapper is not None else itself
                found, part = blocks(tree, placed), shares(tree, placed)
                slots = main_slots(tree, part) if wrapper is None else []
                all_content.append(_signed(xxhash.xxh64_intdigest("\n".join([f[0] for f in found]).encode("utf-8", "surrogatepass"))))
                all_blocks.append([
                    {"text": t, "node": k if wrapper is not None else -1, "key": key_of(k, t) if k >= 0 and wrapper is not None else None, "marked": m, "around": a, "own": any(low <= a <= high for low, high in slots)}
                    for t, k, m, a in found
                ])
                all_shares.append([] if wrapper is None else [{"node": k, "millionths": round(x * 1e6)} for k, x in part.items()])
            yield from as_batches({
                "page_id": (b.column(0), pa.int64()), "url": (b.column(1), pa.string()), "host": (b.column(2), pa.string()),
                "content": (all_content, pa.int64()), "blocks": (all_blocks, kind), "shares": (all_shares, parts),
            })

    schema = "page_id long, url string, host string, content long, blocks array<struct<text:string,node:int,key:long,marked:boolean,around:int,own:boolean>>, shares array<struct<node:int,millionths:long>>"
    return arrow_map(with_wrappers(rows, wrappers, []), ("page_id", "url", "host", "html", "wrapper"), run, schema)


def template_texts(pages: DataFrame) -> DataFrame:
    """One row per host with template text: host, constant (keys). A node has two at most."""
    copies = stored(pages.groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumnsRenamed({"host": "__host", "content": "__content"}))
    weighed = pages.join(if_small(copies, F.length("__host") + 16), (F.col("host") == F.col("__host")) & (F.col("content") == F.col("__content")), "left")
    placed = weighed.select("host", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"), F.explode("blocks").alias("b")).filter("b.node >= 0")
    texts_ = placed.groupBy("host", "b.node", "b.key").agg(F.sum("weight").alias("n"))
    # sums of fractions are rounded, so that their order doesn't matter
    frequent = texts_.filter(F.round("n", 6) >= CONSTANT_PAGES)
    nodes = placed.groupBy(F.col("host").alias("__host"), F.col("b.node").alias("__node")).agg(F.sum("weight").alias("all"))
    good = frequent.join(nodes, (F.col("host") == F.col("__host")) & (F.col("node") == F.col("__node"))).filter(F.round("n", 6) >= F.round(CONSTANT_SHARE * F.col("all"), 6))
    return good.groupBy("host").agg(F.collect_set("key").alias("constant"))


def slots_of(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per host with a main slot: host, slots (spans of wrapper nodes)."""
    rows = pages.select("host", F.explode("shares").alias("s")).groupBy("host", "s.node").agg((F.sum("s.millionths") / F.count(F.lit(1)) / 1e6).alias("share"))
    means = rows.groupBy("host").agg(F.collect_list(F.struct("node", "share")).alias("means"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_slots(unpack(w), {m["node"]: m["share"] for m in means}) for w, means in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield from as_batches({"host": (b.column(0), pa.string()), "slots": ([[{"low": x, "high": y} for x, y in f] for f in found], kind)})

    joined = means.join(wrappers, "host").select("host", "wrapper", "means")
    return arrow_map(joined, ("host", "wrapper", "means"), find, "host string, slots array<struct<low:int,high:int>>")


def _known(store: dict[bytes, Node], data: bytes | None) -> Node | None:
    if data is None:
        return None
    found = store.get(data)
    if found is None:
        if len(store) >= 512:
            store.clear()
        found = store[data] = unpack(data)
    return found


def with_wrappers(rows: DataFrame, wrappers: DataFrame, more: list[str]) -> DataFrame:
    """Rows with their host's wrapper: broadcast if all wrappers together are small, joined by host otherwise."""
    side = wrappers.select(F.col("host").alias("__host"), "wrapper", *more)
    return rows.join(if_small(side, F.length("wrapper") + F.length("__host")), F.col("host") == F.col("__host"), "left")


def if_small(side: DataFrame, width: Column) -> DataFrame:
    """A stored table, marked for broadcast if its measured size allows that; ``width``: bytes of a row."""
    size = side.agg(F.coalesce(F.sum(width + 16), F.lit(0))).first()[0]
    return F.broadcast(side) if size <= BROADCAST_BYTES else side


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    wrappers = stored(wrappers_of(rows))
    found = stored(aligned(rows, wrappers))
    hosts = stored(template_texts(found).join(slots_of(found, wrappers), "host", "full").select(
        F.col("host").alias("__host"), F.coalesce("constant", F.array().cast("array<long>")).alias("constant"), F.coalesce("slots", F.array().cast("array<struct<low:int,high:int>>")).alias("slots"),
    ))
    joined = found.join(if_small(hosts, F.length("__host") + 8 * F.size("constant") + 8 * F.size("slots")), F.col("host") == F.col("__host"), "left").withColumns({
        "constant": F.coalesce("constant", F.array().cast("array<long>")), "slots": F.coalesce("slots", F.array().cast("array<struct<low:int,high:int>>")),
    })
    slot = F.filter("blocks", lambda b: b["own"] | F.exists("slots", lambda s: (b["around"] >= s["low"]) & (b["around"] <= s["high"])))
    joined = joined.withColumn("slot", slot)
    in_slot, anywhere = F.filter("slot", lambda b: b["marked"]), F.filter("blocks", lambda b: b["marked"])
    joined = joined.withColumn("marked", F.when(F.size(in_slot) > 0, in_slot).otherwise(anywhere))
    marked = F.col("marked")
    pool = F.when(F.size(marked) > 0, marked).when(F.size("slot") > 0, F.col("slot")).otherwise(F.col("blocks"))
    chosen = F.filter(pool, lambda b: b["key"].isNull() | ~F.array_contains("constant", b["key"]))
    kept = F.when(F.size(chosen) > 0, chosen).otherwise(marked)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
