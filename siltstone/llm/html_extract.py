"""Operator 2: main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags. Two costs of each block, as content and as boilerplate, come from a
log-linear classifier; they are the capacities of its terminal edges. What its ancestors and their class, id and role names
say has fixed weights. The weights of the block's own features (kind of tag, length, share of link text) are learned from a
bounded sample of the pages themselves: blocks whose ancestors leave little doubt are the weak labels, and a Gaussian prior
around PRIOR keeps the weights near it where the sample says little (all of PRIOR, if there are no such blocks of both kinds). Neighbouring blocks, and blocks that are near in the element tree, are joined
by smoothness edges. The minimum cut of that graph, found by maximum flow, labels the blocks; content blocks are joined in
page order by one space.

Scripts, styles, navigation and hidden elements are hard terminals. All other signs are finite: tags and names of
boilerplate count against a block, by whole class and less by a class's first or last part, and an article, main or content
element inside such an element outweighs it. The text of <math> stays, but for annotations, which no browser shows. A form that holds most of the page's text is a wrapper and costs nothing. Null and empty
pages give an empty text, as do pages without content blocks. Markup may be broken: stray end tags are skipped, unclosed
elements end with their parents, but for raw text (scripts, styles, titles, text areas, frames), which ends with the page. Each row
gives one row, repeated ones too; null ids and urls are passed through. Very long and deeply nested pages are read whole. Further
columns aren't read; an empty table gives no rows."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, sigmoid, table, tuned, uniform

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN_ATTRIBUTE = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_LAYOUT = re.compile(r"(?:^|[-_])(?:has|no|with|without)[-_]", re.I)
_TOKEN = re.compile(r"[a-z]+")
_EMPTY = re.compile(r"/\s*\Z")
_ANNOTATION_END = re.compile(r"</(?:annotation|annotation-xml|semantics|math)\b", re.I)

# What HTML's own elements mean here.
RAW = frozenset("script style textarea title iframe xmp".split())
UNSEEN_TAGS = frozenset("noscript template object svg canvas noframes noembed".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HARD_TAGS = UNSEEN_TAGS | {"nav"}
BOILER_TAGS = frozenset("footer aside button select option menu dialog datalist".split())
FORMS = frozenset("form fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Words of class, id and role names.
BOILER_NAMES = frozenset("ad ads adsbygoogle advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr legal login menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup privacy promo promoted recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets masthead copyright contentinfo complementary".split())
# Parts of longer names that tell little: page builders' widgets at either end, and subjects at the start.
VAGUE_FIRST = frozenset("widget widgets legal notice notices popup privacy respond response responses search social tags".split())
VAGUE_LAST = frozenset("widget widgets".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
HIDDEN_CLASSES = frozenset("hidden is-hidden screen-reader-text sr-only visually-hidden".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post story text".split())

# Weights of what ancestors say: log odds for content.
CONTENT_TAG, CONTENT_NAME, HEADER = 4.0, 2.0, -3.0
#: Prior weights of a block's own features: 1, a paragraph's tag, h1 or h2, log(1 + characters / 20) up to 4, share of link text.
PRIOR = np.array([-1.0, 1.0, 0.5, 0.5, -5.0])
#: Precision of the prior against the mean loss of the weak labels.
PRECISION = 0.25
# Of elements of boilerplate: by tag, by a whole name and by a name's part, of small forms, and the least of all ancestors.
BOILER_TAG, BOILER_NAME, BOILER_PART, FORM, LEAST = -8.0, -4.0, -2.5, -4.0, -10.0
#: What stays of content around boilerplate, and of boilerplate around content.
OUTER_CONTENT, OUTER_BOILER = 0.25, 0.5
#: From here on a block is surely boilerplate to its neighbours.
SURE = -3.0
HARD = 50.0
SMOOTH, PROXIMITY = 0.8, 0.4
#: Stands among an element's names for one of HIDDEN_CLASSES.
UNSEEN = "(hidden)"


class Node:
    """An element's place in the tree: its parent and how many elements it is within, itself included."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Node | None = None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 1

    def shared(self, other: Node) -> int:
        """Elements that both are within."""
        a, b = self, other
        while a is not b:
            if a.depth >= b.depth:
                a = a.parent
            else:
                b = b.parent
        return a.depth


class Block:
    __slots__ = ("text", "links", "tag", "node", "hidden", "context", "forms")

    def __init__(self, tag, node, hidden, context, forms):
        self.text, self.links, self.tag, self.node = [], 0, tag, node
        self.hidden, self.context, self.forms = hidden, context, forms

    @property
    def boiler(self) -> bool:
        return self.hidden or self.context.odds() <= SURE


class Context:
    """What a block's ancestors say: boilerplate's cost, then content tags, content names and headers inside it."""

    __slots__ = ("cost", "content", "named", "header")

    def __init__(self, cost=0.0, content=False, named=False, header=False):
        self.cost, self.content, self.named, self.header = cost, content, named, header

    def odds(self) -> float:
        inside = self.content or self.named
        return self.cost * (OUTER_BOILER if inside else 1.0) + CONTENT_TAG * self.content + CONTENT_NAME * self.named

    def within(self, tag: str, whole: set[str], parts: set[str], ends: set[str]) -> Context:
        """Of an element in this context, with these names, their parts, and the parts of longer names that count as boilerplate."""
        header = self.header or tag == "header" or "header" in parts
        own = 0.0
        if tag in BOILER_TAGS or tag not in ("body", "html", "main", "article") and "footer" in whole | ends:
            own = BOILER_TAG
        elif tag == "article" and parts & COMMENT_NAMES or tag not in ("body", "html", "main", "article") and whole & BOILER_NAMES:
            own = BOILER_NAME
        elif ends and tag not in ("body", "html", "main", "article") and not whole & CONTENT_NAMES:
            own = BOILER_PART
        if own:
            outer = self.odds()
            return Context(max(LEAST, own + (OUTER_CONTENT * outer if outer > 0 else outer)), header=header)
        content, named = tag in CONTENT_TAGS, bool(parts & CONTENT_NAMES)
        if not content and not named and header == self.header:
            return self
        return Context(self.cost, self.content or content, self.named or named, header)


def names(attributes: str) -> tuple[set[str], set[str], set[str]]:
    """Whole names, all parts of names, and first and last parts of longer names that count as boilerplate."""
    whole: set[str] = set()
    parts: set[str] = set()
    ends: set[str] = set()
    for m in _NAMES.finditer(attributes):
        for value in (m[1] or m[2] or m[3] or "").split():
            if _LAYOUT.search(value):  # "has-sidebar" and the like tell of a page's layout, not of the element
                continue
            whole.add(value.lower())
            found = _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            parts.update(found)
            if len(found) > 1:
                if found[0] in BOILER_NAMES and found[0] not in VAGUE_FIRST:
                    ends.add(found[0])
                if found[-1] in BOILER_NAMES and found[-1] not in VAGUE_LAST:
                    ends.add(found[-1])
            elif found:
                whole.add(found[0])
    if not HIDDEN_CLASSES.isdisjoint(whole):
        whole.add(UNSEEN)
    return whole, parts, ends


def hidden(attributes: str) -> bool:
    """By attribute or style; clipping (overflow: hidden) hides nothing."""
    return bool(_HIDDEN_STYLE.search(attributes)) or bool(_HIDDEN_ATTRIBUTE.search(_QUOTED.sub('""', attributes)))


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order, with white space still in pieces."""
    stack: list[tuple] = [("", Node(), False, Context(), ())]  # tag, node, hidden, context, numbers of forms
    made, links, out, current, at = 0, 0, [], None, 0
    held: Counter = Counter()  # open elements by tag, so that a stray end tag needs no search
    drawings: list[int] = []  # places of drawings and of HTML in them; some may be gone from the stack

    def close(k: int) -> None:
        held.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            current = Block(*stack[-1])
            out.append(current)
        current.text.append(piece)
        if links:
            current.links += len(piece)

    for m in iter(_Scan(page).__next__, None):
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m[1] else 1
            continue
        if name in ("br", "wbr", "img"):
            if name == "br":
                add(" ")
            continue
        if name in MATH:
            if name in ("mtd", "mtr"):
                add(" ")
            continue
        if name in ("annotation", "annotation-xml"):
            if not m[1] and not _EMPTY.search(m[3] or "") and (end := _ANNOTATION_END.search(page, at)):
                at = m.scan.at = end.start()
            continue
        while drawings and (drawings[-1] >= len(stack) or stack[drawings[-1]][0] not in ("svg", "foreignobject")):
            drawings.pop()
        drawing = drawings[-1] if drawings else 0
        if drawing and stack[drawing][0] == "foreignobject":
            drawing = 0
        current = None
        if (drawing or name == "svg") and not m[1] and _EMPTY.search(m[3] or ""):
            continue
        if drawing and not m[1] and (name in ENDS_P or name in ("body", "li", "dd", "dt")):  # ends a drawing that isn't closed
            close(drawing)
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if held[name] > 0 else ():
                if stack[k][0] == name:
                    close(k)
                    links = 0
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            m.scan.at = at
        elif name not in VOID:
            if name in ENDS_P and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
                close(len(stack) - 1)
            if name == "body":  # ends the head, closed or not
                for k in range(len(stack) - 1, 0, -1) if held["head"] > 0 else ():
                    if stack[k][0] == "head":
                        close(k)
                        break
            _, _, unseen, context, forms = stack[-1]
            attributes = m[3] or ""
            whole, parts, ends = names(attributes) if "=" in attributes else (set(), set(), set())
            made += 1
            unseen = unseen or name in HARD_TAGS or UNSEEN in whole or ("=" in attributes or "hidden" in attributes.lower()) and hidden(attributes)
            if name in FORMS:
                forms = (*forms, made)
            elif name in CONTENT_TAGS:
                forms = ()
            if name in ("svg", "foreignobject"):
                drawings.append(len(stack))
            held[name] += 1
            stack.append((name, Node(stack[-1][1]), unseen, context.within(name, whole, parts, ends), forms))
    add(page[at:])
    return out


class _Match:
    """A match that knows its scan, so that raw elements can be skipped."""

    __slots__ = ("m", "scan")

    def __init__(self, m, scan):
        self.m, self.scan = m, scan

    def __getitem__(self, k):
        return self.m[k]

    def start(self):
        return self.m.start()

    def end(self):
        return self.m.end()


class _Scan:
    def __init__(self, page: str):
        self.page, self.at = page, 0

    def __next__(self):
        m = _TAG.search(self.page, self.at)
        if m is None:
            return None
        self.at = m.end()
        return _Match(m, self)


def own_features(block: Block, text: str) -> list[float]:
    return [1.0, float(block.tag in PARAGRAPHS), float(block.tag in ("h1", "h2")), min(4.0, float(np.log1p(len(text) / 20))), min(1.0, block.links / max(1, len(text)))]


def log_odds(block: Block, text: str, weights: np.ndarray = PRIOR) -> float:
    """For content; -HARD for what is hidden."""
    if block.hidden:
        return -HARD
    score = float(weights @ own_features(block, text)) + block.context.odds() + (FORM if block.forms else 0.0)
    if block.context.header and block.tag not in ("h1", "h2"):  # a page's or an article's header, but for headings
        score += HEADER * (3 if not block.context.content else 1.5)
    return score


def learned(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of the least mean logistic loss, both labels counting alike, plus the prior's cost; by Newton's method."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    share, w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y), PRIOR.copy()
    cost = lambda v: float((share * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + PRECISION / 2 * ((v - PRIOR) ** 2).sum())
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), x.T @ (share * (p - y)) + PRECISION * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w = w - size * step
    return w


def fit(pages: DataFrame, most: int = 2000, seed: int = 13) -> np.ndarray:
    """The weights of the blocks' own features, from about `most` pages drawn by a hash of the id."""
    rows = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    drawn = rows.where(uniform("page_id", seed) < min(1.0, most / max(1, rows.count()))).select(F.col("page_id").cast("long"), "html")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, page in zip(column(batch, "page_id").to_pylist(), column(batch, "html").to_pylist()):
                for b in blocks(page):
                    odds, text = b.context.odds(), " ".join(entities.unescape("".join(b.text)).split())
                    if text and not b.hidden and not b.forms and abs(odds) >= -SURE:
                        found.append((i, float(odds > 0), own_features(b, text)))
            cols = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.float64()))], ["page_id", "y", "x"])

    got = drawn.mapInArrow(labelled, "page_id long, y double, x array<double>")
    sums = got.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n")).collect()  # different feature vectors of a bounded sample
    sums.sort(key=lambda r: (r["y"], r["x"]))
    x, y, n = np.array([r["x"] for r in sums]).reshape(-1, len(PRIOR)), np.array([r["y"] for r in sums]), np.array([r["n"] for r in sums], dtype=int)
    return learned(np.repeat(x, n, axis=0), np.repeat(y, n))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the source side. odds: capacity from the source if positive, to the sink if negative; edges are undirected.

    Shortest augmenting paths between nodes with excess and nodes with room, which are few once each block's own two
    terminals are set against each other."""
    n = len(odds)
    left, near = list(odds), [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        near[a].append(len(head))
        near[b].append(len(head) + 1)
        head += (b, a)
        room += (c, c)
    while True:
        came, queue, goal = {i: -1 for i in range(n) if left[i] > 1e-12}, deque(i for i in range(n) if left[i] > 1e-12), -1
        while queue:
            i = queue.popleft()
            if left[i] < -1e-12:
                goal = i
                break
            for e in near[i]:
                if room[e] > 1e-12 and head[e] not in came:
                    came[head[e]] = e
                    queue.append(head[e])
        if goal < 0:
            return [i in came for i in range(n)]
        path, i = [], goal
        while came[i] >= 0:
            path.append(came[i])
            i = head[came[i] ^ 1]
        flow = min([left[i], -left[goal], *(room[e] for e in path)])
        left[i] -= flow
        left[goal] += flow
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, the stronger the more of their ancestors they share, and between blocks of one parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        parent = b.node.parent
        if i:
            a = found[i - 1].node
            shared = a.shared(b.node)
            sure = found[i - 1].boiler != b.boiler  # an advert between two paragraphs says little about them
            edges.append((i - 1, i, SMOOTH * shared / max(a.depth, b.node.depth) * (0.25 if sure else 1.0)))
        if parent in last and last[parent] < i - 1 and found[last[parent]].boiler == b.boiler:
            edges.append((last[parent], i, PROXIMITY))
        last[parent] = i
    return edges


def unwrap(found: list[Block], texts: list[str]) -> None:
    """Forms around most of the page's text are taken from their blocks."""
    held: dict[int, int] = {}
    total = 0
    for b, t in zip(found, texts):
        if not b.hidden:
            total += len(t)
            for f in b.forms:
                held[f] = held.get(f, 0) + len(t)
    for b in found:
        b.forms = tuple(f for f in b.forms if 2 * held.get(f, 0) <= total)


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    if not page:
        return ""
    found = blocks(page)
    texts = [" ".join(entities.unescape("".join(b.text)).split()) for b in found]
    keep = [i for i, t in enumerate(texts) if t]
    if not keep:
        return ""
    found, texts = [found[i] for i in keep], [texts[i] for i in keep]
    if any(b.forms for b in found):
        unwrap(found, texts)
    side = minimum_cut([log_odds(b, t, weights) for b, t in zip(found, texts)], smoothness(found))
    return " ".join(t for t, s in zip(texts, side) if s)


def extracted(pages: DataFrame, weights: np.ndarray = PRIOR) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(tuned(spark), sf_dir, "pages")
    return extracted(pages, fit(pages))
