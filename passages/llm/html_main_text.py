"""Main text of web pages by minimum cut.

A page is cut into blocks. A linear classifier over each block's tags, class names and text gives a cost for either label;
costs are terminal capacities, and blocks that are neighbours or share a container are joined by smoothness edges. The
maximum flow from `content` to `boilerplate` separates the blocks at least total cost. All of a page is in one row, so the
work is one narrow pass inside Arrow functions: no shuffle, and memory bounded by an Arrow batch.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import ship

# Element names of HTML by their role here.
RAW = frozenset("script style noscript template iframe svg head select datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes first, if one of them is the innermost open one.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT_TAGS = frozenset(("article", "main"))
#: How strongly an element speaks for furniture (below 0) by its tag; `header` only outside an article.
TAG_HINTS = {"nav": -5.0, "footer": -5.0, "aside": -5.0, "menu": -5.0, "search": -5.0, "form": -3.5, "header": -5.0}
#: What names say, strong, weak and soft ones. Strong ones exceed the 4.6 that length and punctuation of a block can say for it: a reader's comment is
#: left out however well written; weak and soft ones don't.
STRONG, WEAK, SOFT = -5.0, -2.5, -0.8
ARTICLE_HINT, NAME_HINT, LEAST_HINT, MOST_HINT = 1.5, 0.8, -6.0, 2.5
#: Words of class names, ids and roles that name page furniture beyond doubt.
STRONG_NAMES = frozenset(
    "nav navbar navigation menu menubar masthead topbar footer foot bottombar sidebar ad ads advert adverts advertisement advertising adsense adsbygoogle "
    "sponsor sponsored cookie cookies consent gdpr newsletter signup login breadcrumb breadcrumbs pagination pager contentinfo complementary "
    "comment comments commentlist disqus".split()
)
#: Words for what readers say or may read next, which are also words for parts of an article, such as a paper's discussion: soft inside one.
SOFT_NAMES = frozenset("reply replies respond response responses discussion related recommended recommendations".split())
#: Words that often name furniture, but not always: length, punctuation and neighbours may outweigh them.
WEAK_NAMES = frozenset(
    "side rail aside widget promo promotion banner notice notices alert warning disclaimer popup modal overlay subscribe subscription search searchbox "
    "form share sharing social tags toolbar skip dialog toc header".split()
)
#: Furniture in which an article is no main text: the readers' comments, teasers in a margin.
LASTING_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion sidebar related recommended recommendations complementary".split())
LASTING_TAGS = frozenset("nav aside footer menu".split())
#: The ones among them that also count on inline elements.
INLINE_NAMES = frozenset("ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo cookie comment comments share sharing social subscribe newsletter".split())
CONTENT_NAMES = frozenset("article content main post entry story body text prose".split())
#: Last parts of a name that only say what kind of box it is, and first parts that say what an element has or lacks, not what it is.
BOX_PARTS = frozenset("wrapper wrap container box area section block item items inner outer list links link bar left right top bottom body text content slot unit panel group row col column cell main primary secondary".split())
ASIDE_PARTS = frozenset("has no not with without hide show is".split())
LACK_PARTS = frozenset("has no with without".split())
OWNER_PARTS = frozenset("site page top main global left right sticky user blog post entry article".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>|[^<]++|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_BLOCK_START = re.compile(r"(?=</?(?:%s)\b)" % "|".join(sorted(BLOCK, key=lambda x: (-len(x), x))), re.IGNORECASE)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    element: int  # number of the innermost open element
    hint: float  # what the elements around it say: below 0 furniture, above 0 the article


class Elements:
    """Parent and depth of each element of a page, by number."""

    def __init__(self) -> None:
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int, most: int = 12) -> int:
        """Steps from one element to the other through the tree; at most `most`, so deep nesting costs no more."""
        steps = 0
        while a != b and steps < most:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def name_hint(name: str) -> tuple[float, str]:
    """What a class, id or role says, and by which word: the whole name, else its last part that is not just a kind of box.

    A weak word counts in a longer name only where the rest says whose it is, as in site-header; a strong word beside it makes it strong.
    """
    low = name.lower()
    if low in STRONG_NAMES or low in SOFT_NAMES:
        return STRONG, low
    parts = [x.lower() for x in _PARTS.split(name) if x]
    if not parts or parts[0] in ASIDE_PARTS or any(x in LACK_PARTS for x in parts):
        return 0.0, ""
    while len(parts) > 1 and parts[-1] in BOX_PARTS:
        parts.pop()
    if parts[-1] in STRONG_NAMES or parts[-1] in SOFT_NAMES:
        return STRONG, parts[-1]
    if parts[-1] in WEAK_NAMES:
        strong = [x for x in parts if x in STRONG_NAMES]
        if strong:
            return STRONG, strong[-1]
        if all(x in OWNER_PARTS or x in WEAK_NAMES for x in parts[:-1]):
            return WEAK, parts[-1]
    return 0.0, ""


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or bool(_INVISIBLE.search(found.get("style", "")))


def element_hint(tag: str, attributes: str, hint: float, in_article: bool, lasting: bool) -> tuple[float, bool]:
    """The hint for what an element holds, from that of what is around it, and whether the furniture it is in lasts.

    Hints are bounded features of the classifier. Names count for less than all that text can say, if they are weak. An article
    ends what names and tags around it said, unless that was one of the lasting ones.
    """
    found = _attributes(attributes) if attributes else {}
    own = TAG_HINTS.get(tag, 0.0) if tag != "header" or not in_article else 0.0
    named = [x for key in ("class", "id", "role") for x in found.get(key, "").split()]
    content = tag in CONTENT_TAGS or any(x.lower() in CONTENT_NAMES for x in named)
    last = lasting or tag in LASTING_TAGS
    if tag not in ("html", "body", "main"):
        for x in named:
            score, word = name_hint(x)
            if not score or content and x.lower() != word or word == "header" and in_article:
                continue
            soft = word in SOFT_NAMES and in_article
            own = min(own, SOFT if soft else score)
            last = last or word in LASTING_NAMES and not soft
    if found and _hidden(found) or tag == "dialog" and "open" not in found:
        own = STRONG
    if own < 0:
        return max(LEAST_HINT, min(hint, 0.0) + own), last
    if tag == "main" or tag == "article" and not lasting:
        return ARTICLE_HINT if hint <= 0 else min(MOST_HINT, hint + ARTICLE_HINT), False
    if content and not lasting:
        return min(MOST_HINT, hint + NAME_HINT), last
    return hint, last


def blocks_of(page: str) -> tuple[list[Block], Elements]:
    """The page's blocks in order: white space folded, character references decoded, raw elements and comments left out.

    A raw element that is never closed ends at the next block, but for script and style, whose content could be anything.
    """
    found: list[Block] = []
    elements = Elements()
    # tag, number, hint, in article, in lasting furniture, in inline furniture
    stack: list[tuple[str, int, float, bool, bool, bool]] = [("", 0, 0.0, False, False, False)]
    parts, linked, in_link = [], 0, 0
    opened: Counter[str] = Counter()  # open elements by tag, so that an end that fits none costs nothing
    unclosed: set[str] = set()  # raw tags that no end follows any more

    def push(tag: str, *rest) -> None:
        stack.append((tag, *rest))
        opened[tag] += 1

    def pop(depth: int = -1) -> None:
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, min(linked, len(text)), stack[-1][0], stack[-1][1], stack[-1][2]))
        parts, linked = [], 0

    at, end, form_end = 0, len(page), 0
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text = html.unescape(m[0])
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m[1]:
            if tag == "a":
                in_link = 0
            if opened[tag] > 0:  # what is passed over on the way down the stack is closed as well
                if tag not in BLOCK:
                    flush()
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag == "a":
            in_link = 1
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = None if tag in unclosed else _closing(tag).search(page, at)
                if not close:
                    unclosed.add(tag)
                if tag == "head":  # one that is never closed ends where the body starts
                    close = close or re.compile(r"(?=<body\b)", re.IGNORECASE).search(page, at)
                    at = close.end() if close else at
                elif close or tag in ("script", "style"):
                    at = close.end() if close else end
                else:
                    start = _BLOCK_START.search(page, at)
                    at = start.end() if start else end
            continue
        if tag not in BLOCK:
            # inline furniture, such as an advert in a span, is a block of its own; so are like elements inside it
            nested = stack[-1][5] and opened[tag] > 0
            if nested or m[3] and _inline_furniture(m[3]):
                flush()
                _, number, hint, in_article, _, _ = stack[-1]
                push(tag, elements.add(number), hint if nested else max(LEAST_HINT, min(hint, 0.0) + STRONG), in_article, True, True)
            continue
        while stack[-1][0] and stack[-1][0] not in BLOCK and stack[-2][0] == "p":  # left open in a paragraph that ends here
            pop()
        if stack[-1][0] == "p":
            pop()
        while stack[-1][0] in CLOSED_BY.get(tag, ()):
            pop()
        _, number, hint, in_article, lasting, inline = stack[-1]
        if tag == "form":
            form_end = page.find("</form", at) if 0 <= form_end < at else form_end
            tag = "div" if form_end - at > len(page) // 2 else tag  # a form around most of the page is its frame
        own, last = element_hint(tag, m[3], hint, in_article, lasting)
        push(tag, elements.add(number), own, in_article or own > 0, last, inline)
    flush()
    return found, elements


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


def _inline_furniture(attributes: str) -> bool:
    found = _attributes(attributes)
    return _hidden(found) or any(name_hint(x)[1] in INLINE_NAMES for key in ("class", "id", "role") for x in found.get(key, "").split())


def evidence(block: Block, longest: int = 40) -> float:
    """The classifier: positive for content. Linear in bounded features: surroundings, links, length, punctuation and tag.

    Short blocks speak against content, as menus, captions and buttons are short; only what is around them tells a short paragraph from those.
    How long is long depends on the longest unlinked block of the page, between 6 and 40 words.
    """
    words = block.text.count(" ") + 1
    density = block.linked / len(block.text)
    score = block.hint - 4.0 * density
    score += 4.5 * min(1.0, math.log(1 + words) / math.log(1 + max(6, min(40, longest)))) - 2.5
    score += 0.5 * (block.text[-1] in ".!?…\"'”»:") + 0.2 * min(3, block.text.count(","))
    score += 1.0 * (block.tag in HEADINGS) + 0.5 * (block.tag in ("p", "pre", "blockquote"))
    return score


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: node i costs gain[i] if cut off while positive, -gain[i] if kept while negative.

    Maximum flow by shortest augmenting paths (level graph and blocking flow).
    """
    n = len(gain)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[node] < len(heads[node]):
                e = heads[node][at[node]]
                if room[e] > 1e-9 and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
                continue
            path.append(e)
            node = to[e]


def label(blocks: list[Block], elements: Elements, adjacency: float = 1.2, proximity: float = 0.3) -> list[bool]:
    """True for blocks of the main text.

    Each block is tied to the next, the less the further apart they are in the tree, and to the next one of the same parent.
    """
    weights: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            weights[i - 1, i] += adjacency / max(1, elements.distance(blocks[i - 1].element, b.element))
        parent = elements.parent[b.element]
        if parent in last:
            weights[last[parent], i] += proximity
        last[parent] = i
    edges = [(a, b, w) for (a, b), w in weights.items()]
    longest = max((b.text.count(" ") + 1 for b in blocks if 2 * b.linked < len(b.text) and b.hint >= 0), default=0)
    return minimum_cut([evidence(b, longest) for b in blocks], edges)


def main_text(page: str | None) -> str:
    blocks, elements = blocks_of(page or "")
    return " ".join(b.text for b, kept in zip(blocks, label(blocks, elements), strict=True) if kept)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, text, n_chars), one per input row, repeated ids and equal rows included; null ids are kept.

    text joins the main text's blocks in page order by one space; '' for null or empty pages and pages without main text.
    Unclosed, misnested and cut-off markup is read as far as it goes; nothing is dropped for its length. Where labels tie in
    cost, a block counts as furniture. Kept columns named text or n_chars come back with an underscore behind their names; other columns are ignored.
    """
    ship(pages.sparkSession)
    names = [c + "_" * (c in ("text", "n_chars")) for c in (id_col, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    rows = pages.select(F.col(html_col).alias("_html"), *[F.col(c).alias(n) for c, n in zip((id_col, *keep), names, strict=True)])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
