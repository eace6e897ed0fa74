"""Main text of pages by wrapper induction.

All pages of each host are aligned, as trees of blocks by simple tree matching, with one that has
many tags. Each slot of that tree is judged by what the pages have in it: one text in
all of them is template; mostly links, or few texts for many pages, is a menu, an advert or a
list of other pages; texts that differ from page to page are free. The part of the tree that
holds most of the free text is the host's content. A page is aligned with its host's wrapper,
its text is taken from the content part, and slots of the other kinds go. Tags, classes, ids
and roles break ties: they settle where a free slot that names itself an advert, a notice, a
form or comments is none of the article, and where a host has too few pages to compare.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream.llm.common import cut_lineage, schema
from pagestream.llm.components import joined_by_hub
from pagestream.llm.url_filter import host_of
from pagestream.session import shuffle_partitions

#: Different pages of a host that a wrapper is induced from at least.
LEAST_PAGES = 3
#: Pages are aligned with the longest, by tags, of this share of the host's different pages, the
#: shorter ones: nearly all blocks are there, and a few pages unlike the others aren't taken for the model.
USUAL = 0.9
#: Skeletons or wrappers of all hosts up to so many bytes go to every task, rather than the pages to them.
SMALL_BYTES = 8_000_000
#: Blocks lie at most this deep in a tree; deeper ones are put beside each other, in order.
DEEPEST = 120
#: Up to so many pairs of siblings are weighed against each other; more are paired by label and number.
MOST_PAIRS = 40_000

BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "pre blockquote figure figcaption address details summary fieldset hgroup center hr nav header footer aside form "
    "menu dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas audio video".split())
DROPPED = frozenset("head nav footer aside form menu dialog button label input option fieldset".split()) | RAW
#: Start tags that end an open p; and for each item tag, what ends an open one.
_ENDS_P = BLOCKS
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in a class, id or role that name what isn't the main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice popup "
    "modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments reply replies disqus respond login search pagination pager toolbar copyright disclaimer hidden "
    "contentinfo complementary alert dialog form".split()
)
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
_WORDS = re.compile(r"[A-Za-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}


class Node:
    """A block: its label, what is known of it, and its child blocks and pieces of text in order."""

    __slots__ = ("tag", "label", "noise", "main", "parts", "linked")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.noise, self.main = tag, tag in DROPPED, tag in ("article", "main")
        self.label = tag
        self.parts: list[Node | str] = []
        self.linked = 0  # code points of its own text that lie in links
        if attributes and len(attributes) > 3:
            names = []
            for kind, *values in _NAMED.findall(attributes):
                value = next(filter(None, values), "")
                names.append(value)
                if kind.lower() == "role" and value.lower() in ("main", "article"):
                    self.main = True
            if names:
                self.label = f"{tag}.{names[0]}"
                self.noise = self.noise or not NOISE.isdisjoint(w.lower() for n in names for w in _WORDS.findall(n))
            self.noise = self.noise or bool(_HIDDEN.search(attributes))

    def blocks(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]

    def again(self) -> Node:
        """An empty block like this one."""
        node = Node(self.tag)
        node.label, node.noise, node.main = self.label, self.noise, self.main
        return node

    def own_text(self) -> str:
        return " ".join("".join(p if isinstance(p, str) else "\n" for p in self.parts).split())


def parse(page: str | None) -> Node:
    """The tree of blocks of a page, however broken; inline tags are not nodes, a cut-off tag is none."""
    root = Node("#root")
    stack, page = [root], page or ""
    opened: Counter[str] = Counter()
    at, search, link = 0, _TAG.search, 0

    def here() -> Node:
        """The innermost open block; one put beside its parent goes on in a new block if another came between."""
        if len(stack) > DEEPEST and stack[DEEPEST - 1].parts[-1] is not stack[-1]:
            stack[-1] = stack[-1].again()
            stack[DEEPEST - 1].parts.append(stack[-1])
        return stack[-1]

    def add(text: str) -> None:
        if text:
            node = here()
            node.parts.append(entities.unescape(text) if "&" in text else text)
            if link:
                node.linked += len(text)

    def put(node: Node) -> None:
        if len(stack) >= DEEPEST:
            node.noise = node.noise or len(stack) > DEEPEST and stack[-1].noise
            stack[DEEPEST - 1].parts.append(node)
        else:
            stack[-1].parts.append(node)

    def cut(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    def close_to(tags: tuple[str, ...], walls: frozenset) -> None:
        if not any(opened[tag] > 0 for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                cut(depth)
                return
            if stack[depth].tag in walls:
                return

    while m := search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag in BLOCKS or tag in DROPPED:
                close_to((tag,), frozenset() if tag != "p" else frozenset(("article", "section", "div", "li", "td")))
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            here().parts.append(" ")
        elif tag in BLOCKS or tag in DROPPED:
            if tag in _ENDS_P and stack[-1].tag == "p":
                cut(len(stack) - 1)
            if tag in _ITEMS:
                close_to(_ITEMS[tag], _LISTS)
            if tag == "body":
                close_to(("head",), frozenset())
            node = Node(tag, m[3])
            put(node)
            if tag not in VOID and not m[3].endswith("/"):
                stack.append(node)
                opened[tag] += 1
        elif m[3] and len(m[3]) > 6 and (node := Node(tag, m[3])).noise:
            # An inline element that names itself an advert or the like is a part of its own.
            if tag not in VOID:
                put(node)
                at = _end_of(page, tag, at)
        elif tag == "a":
            link = 1
    add(page[at:])
    return root


def _end_of(page: str, tag: str, at: int) -> int:
    """Where an element that begins before `at` ends, elements of its name in it counted; `at` if it never does."""
    open_, end = 1, at
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).finditer(page, at):
        if m[0].endswith("/>") and not m[1]:
            continue
        open_ += -1 if m[1] else 1
        if m[1]:
            end = m.end()
        if not open_:
            return end
    return end


def matched(a: Node, b: tuple) -> list[tuple[Node, tuple]]:
    """Pairs of an alignment of two trees by simple tree matching; `b` is (label, of it, children)."""
    if a.label != b[0]:
        return []
    pairs: list[tuple[Node, tuple]] = []
    _size(a, b, pairs)
    return pairs


def _size(a: Node, b: tuple, pairs: list | None) -> int:
    """Nodes in the largest order-keeping alignment of two trees with equal roots."""
    left, right = a.blocks(), b[2]
    if pairs is not None:
        pairs.append((a, b))
    if not left or not right:
        return 1
    if len(left) == len(right) == 1:
        return 1 + (_size(left[0], right[0], pairs) if left[0].label == right[0][0] else 0)
    if len(left) * len(right) > MOST_PAIRS:
        return 1 + sum(_size(x, y, pairs) for x, y in _numbered(left, right))
    weight = [[0] * len(right) for _ in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        row, above, mine = best[i + 1], best[i], weight[i]
        label, inner = x.label, any(not isinstance(p, str) for p in x.parts)
        for j, y in enumerate(right):
            if label == y[0]:
                mine[j] = _size(x, y, None) if inner and y[2] else 1
            w = above[j] + mine[j] if mine[j] else 0
            row[j + 1] = max(w, above[j + 1], row[j])
    if pairs is not None:
        i, j, chosen = len(left), len(right), []
        while i and j:
            if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                chosen.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        for x, y in reversed(chosen):
            _size(x, y, pairs)
    return 1 + best[-1][-1]


def _numbered(left: list[Node], right: list[tuple]) -> list[tuple[Node, tuple]]:
    """Siblings paired as the n-th of their label, those that keep the order; linear, for very long lists."""
    places: dict[tuple[str, int], int] = {}
    seen: Counter[str] = Counter()
    for j, y in enumerate(right):
        places[y[0], seen[y[0]]] = j
        seen[y[0]] += 1
    seen, found, last = Counter(), [], -1
    for x in left:
        j = places.get((x.label, seen[x.label]), -1)
        seen[x.label] += 1
        if j > last:
            found.append((x, right[j]))
            last = j
    return found


class Slot:
    """What the pages have at one place of the aligned trees."""

    __slots__ = ("many", "different", "size", "linked", "text", "kind", "free")

    def __init__(self, many: int = 0, different: int = 0, size: int = 0, linked: int = 0, text: int = 0):
        self.many, self.different, self.size, self.linked, self.text = many, different, size, linked, text
        self.kind, self.free = "", 0.0

    def judge(self, pages: int) -> None:
        """fixed: one text on all pages; links, few: other pages' names, or texts that come again; else free."""
        if not self.many:
            self.kind = "box"
        elif self.different == 1 and self.many == pages:
            self.kind = "fixed"
        elif self.linked * 2 > self.size:
            self.kind = "links"
        elif self.many >= 4 and self.different * 2 <= self.many:
            self.kind = "few"
        else:
            self.kind, self.free = "free", self.size / pages


def _frozen(node: Node) -> tuple:
    """The tree without its texts: (label, (number, whether it names itself something else than content), children)."""
    count = iter(range(1 << 40))

    def freeze(x: Node) -> tuple:
        return (x.label, (next(count), x.noise and not x.main), [freeze(y) for y in x.blocks()])

    return freeze(node)


def _told(text: str) -> int:
    """64 bits that tell a text from others."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slots_of(page: str, skeleton: tuple) -> list[tuple[int, int, int, int]]:
    """(number, text by `_told`, its code points, those in links) of each slot where the page has text.

    The first is one of number -1 for the page itself.
    """
    found = [(-1, 0, 0, 0)]
    for node, slot in matched(parse(page), skeleton):
        if text := node.own_text():
            found.append((slot[1][0], _told(text), len(text), min(node.linked, len(text))))
    return found


def induce(pages: list[str]) -> tuple | None:
    """The wrapper of these pages, see `wrapper_of`: `host_wrappers` for a few pages, without Spark."""
    pages = sorted(set(pages), key=lambda p: (p.count("<"), p))
    if not pages:
        return None
    skeleton = _frozen(parse(pages[int((len(pages) - 1) * USUAL)]))
    texts: defaultdict[int, Counter] = defaultdict(Counter)
    sizes, linked = Counter(), Counter()
    for page in pages:
        for number, text, size, links in slots_of(page, skeleton):
            texts[number][text] += 1
            sizes[number] += size
            linked[number] += links
    return wrapper_of(skeleton, [(n, sum(c.values()), len(c), sizes[n], linked[n], max(c)) for n, c in texts.items()])


def wrapper_of(skeleton: tuple, found: Iterable[tuple]) -> tuple | None:
    """The wrapper: (label, (kind, text where it is fixed, whether the content is here), children) of one page's tree.

    `found` has (number, texts, different ones, code points, those in links, one text) of each slot,
    counted over the host's different pages, and of them all as number -1. None with fewer than
    LEAST_PAGES pages, or where nothing varies: then nothing tells what is template.
    """
    slots = {number: Slot(*counts) for number, *counts in found}
    pages = slots[-1].many if -1 in slots else 0
    if pages < LEAST_PAGES:
        return None

    def filled(node: tuple) -> tuple:
        label, (number, out), children = node
        slot = (label, slots.get(number) or Slot(), [filled(x) for x in children])
        if out:
            noise.add(id(slot))
        return slot

    noise: set[int] = set()
    base = filled(skeleton)

    def weigh(slot: tuple, out: bool) -> float:
        out = out or id(slot) in noise
        own = slot[1]
        own.judge(pages)
        below = sum([weigh(x, out) for x in slot[2]])
        own.free = (0.0 if out else own.free) + below
        return own.free

    if not weigh(base, False):
        return None
    content, path = base, [base]
    while inner := [x for x in content[2] if x[2] and x[1].free * 2 > base[1].free]:
        content = inner[0]
        path.append(content)
    # A part that names itself the article, or holds its headings, is taken whole.
    for outer in reversed(path[:-1]):
        if _names_article(outer) or any(x[0].split(".")[0] in HEADINGS and x[1].kind == "free" for x in outer[2]):
            content = outer
    chosen = {id(content)}
    if _names_article(content):
        # A page may have more than one; those inside the chosen part or around it are no others.
        def others(slot: tuple) -> None:
            if slot is content or id(slot) in noise and not _names_article(slot):
                return
            if _names_article(slot) and slot[1].free and not any(x is slot for x in path):
                chosen.add(id(slot))
                return
            for x in slot[2]:
                others(x)

        others(base)

    def strip(slot: tuple) -> tuple:
        own = slot[1]
        text = own.text if own.kind == "fixed" else None
        return (slot[0], (own.kind, text, id(slot) in chosen), [strip(x) for x in slot[2]])

    return strip(base)


def _names_article(slot: tuple) -> bool:
    return slot[0].split(".")[0] in ("article", "main")


def main_text(page: str | None, wrapper: tuple | None) -> str:
    """The article's blocks, in page order, one to a line."""
    return extracted(page, wrapper)[0]


def extracted(page: str | None, wrapper: tuple | None) -> tuple[str, bool]:
    """(text, whether the wrapper says where it is)."""
    root = parse(page)
    kinds = {id(node): slot[1] for node, slot in matched(root, wrapper)} if wrapper is not None else {}
    content = [node for node in _walk(root) if kinds.get(id(node), ("", None, False))[2]]
    regions = content or _named_regions(root)

    def stays(text: str, node: Node) -> bool:
        kind, fixed, _ = kinds.get(id(node), ("free", None, False))
        return not (kind == "fixed" and _told(text) == fixed or kind in ("links", "few") and not node.tag == "p" and node.tag not in HEADINGS)

    lines = [t for region in regions for t, node in _lines(region, region is not root) if stays(t, node)]
    return "\n".join(lines), bool(content)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.blocks())


def _named_regions(root: Node) -> list[Node]:
    """The outermost parts that name themselves articles, else the main part, else all of the page."""
    articles, mains, todo = [], [], [root]
    while todo:
        node = todo.pop()
        if node.main and node.tag != "main":
            articles.append(node)
            continue
        if node.main:
            mains.append(node)
        todo += [x for x in reversed(node.blocks()) if x.main or not x.noise]
    return articles or mains[:1] or [root]


def _lines(region: Node, inside: bool) -> Iterator[tuple[str, Node]]:
    """Blocks of text with their nodes. A heading in an article's own header is part of the article."""
    run: list[str] = []

    def flush(node: Node) -> Iterator[tuple[str, Node]]:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            yield text, node

    def walk(node: Node, headings_only: bool) -> Iterator[tuple[str, Node]]:
        for part in node.parts:
            if isinstance(part, str):
                if not headings_only or node.tag in HEADINGS:
                    run.append(part)
                continue
            inline = part.tag not in BLOCKS
            if not inline:
                yield from flush(node)
            only = headings_only
            if part.noise or part.tag == "header":
                heads = inside and (part.tag == "header" or "header" in part.label.lower()) and part.tag not in DROPPED
                if not heads:
                    continue
                only = True
            yield from walk(part, only)
            if not inline:
                yield from flush(part)

    yield from walk(region, False)
    yield from flush(region)


def _packed(tree: tuple) -> bytes:
    return zlib.compress(pickle.dumps(tree), 1)


@lru_cache(maxsize=512)
def _unpacked(packed: bytes | None) -> tuple | None:
    return pickle.loads(zlib.decompress(packed)) if packed else None


@F.pandas_udf(T.BinaryType())
def _skeleton(pages: pd.Series) -> pd.Series:
    return pd.Series([_packed(_frozen(parse(p))) for p in pages], dtype=object)


@F.pandas_udf(T.ArrayType(schema("slot int, text long, size long, linked long")))
def _slots(pages: pd.Series, skeletons: pd.Series) -> pd.Series:
    names = ("slot", "text", "size", "linked")
    return pd.Series([[dict(zip(names, s)) for s in slots_of(p, _unpacked(k))] for p, k in zip(pages, skeletons)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _induced(skeletons: pd.Series, found: pd.Series) -> pd.Series:
    names = ("slot", "many", "different", "size", "linked", "text")
    wrappers = (wrapper_of(_unpacked(k), [tuple(s[n] for n in names) for s in some]) for k, some in zip(skeletons, found))
    return pd.Series([None if w is None else _packed(w) for w in wrappers], dtype=object)


@F.pandas_udf(schema("text string, by_wrapper boolean"))
def _extracted(pages: pd.Series, wrappers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extracted(p, _unpacked(w)) for p, w in zip(pages, wrappers)], columns=["text", "by_wrapper"])


def _small(hosts: DataFrame, size: Column) -> bool:
    """Whether a checkpoint with a row per host, as measured, is to go to every task."""
    threshold = hosts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return not threshold.startswith("-") and (hosts.agg(F.sum(size)).first()[0] or 0) <= SMALL_BYTES


def _with_hosts(own: DataFrame, hosts: DataFrame, size: Column) -> DataFrame:
    """Pages with the one row of their host, of `size` bytes.

    Where these rows are many bytes, pages are dealt by host, those of a host with many of them to
    several tasks, each with a copy.
    """
    if _small(hosts, size + F.length("host")):
        return own.join(F.broadcast(hosts), "host", "left")
    share = min(0.02, max(0.001, 1 / shuffle_partitions(own.sparkSession)))  # more than a task's part
    return joined_by_hub(own, hosts, "host", "deal", "left", share)


def host_skeletons(own: DataFrame) -> DataFrame:
    """(host, skeleton): of the page of each host that its pages are aligned with, see USUAL.

    Of several with as many tags it is the one with the largest hash. Only hashes and counts are
    shuffled to choose it. `own` has host, html and its hash `deal`.
    """
    tags = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    different = cut_lineage(own.select("host", "deal", tags.alias("tags")).distinct())
    most = cut_lineage(different.groupBy("host").agg(F.percentile("tags", F.lit(USUAL)).alias("most")))
    usual = _with_hosts(different, most, F.lit(8)).where(F.col("tags") <= F.col("most"))
    chosen = cut_lineage(usual.groupBy("host").agg(F.max(F.struct("tags", "deal"))["deal"].alias("deal")))
    hinted = F.broadcast(chosen) if _small(chosen, F.length("host") + F.lit(8)) else chosen
    return own.join(hinted, ["host", "deal"]).dropDuplicates(["host"]).select("host", _skeleton("html").alias("skeleton"))


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): induced from all different pages of each host.

    Their texts are counted per slot by their hashes, first on the map side; a host's slots, no
    more than the blocks of the page that all are aligned with, meet in one row. Copies of a page
    count once.
    """
    html = F.col(html_col)
    own = pages.where(html != "").select(
        host_of(F.col(url_col)).alias("host"), html.alias("html"), F.xxhash64(html).alias("deal")
    )
    skeletons = cut_lineage(host_skeletons(own))
    aligned = _with_hosts(own, skeletons, F.length("skeleton")).select("host", "deal", _slots("html", "skeleton").alias("slots"))
    found = aligned.dropDuplicates(["host", "deal"]).select("host", F.explode("slots").alias("s")).select("host", "s.*")
    texts = found.groupBy("host", "slot", "text").agg(
        F.count(F.lit(1)).alias("many"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )
    slots = texts.groupBy("host", "slot").agg(
        F.sum("many").alias("many"), F.count(F.lit(1)).alias("different"), F.sum("size").alias("size"),
        F.sum("linked").alias("linked"), F.max("text").alias("text"),
    )
    listed = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "many", "different", "size", "linked", "text")).alias("found"))
    return listed.join(skeletons, "host").select("host", _induced("skeleton", "found").alias("wrapper"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, by_wrapper) for each row; by_wrapper tells that the host's wrapper said where the text is.

    Null or empty html gives an empty text. A null url, or one without a host, belongs to the
    host "". Repeated rows each give a row, an empty table none; other columns are not read.
    However deep or wide a page is, it is parsed and aligned without recursion into all of it
    and in time that follows its length. Every page is parsed and aligned twice, once to count what
    its host's slots hold and once to extract it; skeletons and wrappers are checkpoints.
    """
    wrappers = cut_lineage(host_wrappers(pages, url_col, html_col))
    own = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"),
        F.xxhash64(html_col, id_col).alias("deal"),
    )
    out = _with_hosts(own, wrappers, F.coalesce(F.length("wrapper"), F.lit(0))).select("id", "url", _extracted("html", "wrapper").alias("t"))
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t.text").alias("text"),
        F.length("t.text").cast("long").alias("n_chars"), F.col("t.by_wrapper").alias("by_wrapper"),
    )
