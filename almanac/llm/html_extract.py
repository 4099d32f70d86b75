"""Main text of web pages by inference on the DOM tree.

Every block element of a page is a node of a tree-structured graphical model
with four states: *text* (the article), *top* (where clutter begins: a menu, an
advert, a list of comments), *rest* (inside clutter) and *frame* (a container of
all).  A node's tag, its class and id words and
the shape of its own text give its evidence; parent and child are tied by a
potential.  Messages go once from the leaves to the root and once back
(sum-product), which gives exact marginals; blocks whose state is more likely
*text* than not are the article.

Evidence and potentials are counted, with smoothing, on labelled pages: by
default on those that ``labelled_pages`` lays out, page by page with different
wrappers, orders and kinds of clutter; ``fit`` takes any others.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REST, TEXT, FRAME, TOP = 0, 1, 2, 3
STATES = (REST, TEXT, FRAME, TOP)
OUT_BYTES = 8 << 20

# Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # up to the end tag, or the page's end
# Nodes that may stand in a line, with the tag whose evidence they share.
INSETS = {"button": "form", "select": "form", "datalist": "form", "object": "div", "noscript": "div", "svg": "figure", "canvas": "div", "audio": "div", "video": "div"}
BLOCKS = frozenset((
    "html body main article section nav aside header footer div form fieldset h1 h2 h3 h4 h5 h6 hgroup p blockquote pre ul ol li dl dt dd menu "
    "table caption thead tbody tfoot tr td th figure figcaption address details summary dialog center search").split())
NODES = BLOCKS | INSETS.keys()
_PAIRED = {t: re.compile(rf"<(/?){t}(?![^\s/>])", re.I) for t in (*INSETS, "template")}
CLOSES = {  # an opening tag ends these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "thead": ({"caption"}, {"table"}),
}
# Fixed words of class, id and role names.
GOOD = frozenset("article content post entry story main body text prose".split())
BAD = frozenset((
    "nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar sidebar side aside rail widget ad ads adv advert adverts advertisement "
    "advertising banner promo promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login register search share sharing social related recommended recommendations more comment comments commentlist discussion disqus reply replies respond reader "
    "form pager pagination tags legal copyright hidden sr skip teaser toolbar complementary contentinfo").split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
_WORDS = re.compile(r"[a-z]+")
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)


@dataclass
class Page:
    """Block nodes in document order; ``runs`` are (node, text pieces) in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    runs: list[tuple[int, list[str]]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    labels: list[int | None] = field(default_factory=list)


def _hint(attrs: str) -> tuple[str, int | None]:
    words: set[str] = set()
    label = None
    for m in _NAMES.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("hidden", "aria-hidden"):
            words |= {"hidden"} if value != "false" else set()
        elif name == "style":
            words |= {"hidden"} if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else set()
        else:
            words.update(_WORDS.findall(value))
    return ("bad" if words & BAD else "good" if words & GOOD else "own" if words else "none"), label


def parse(text: str) -> Page:
    """A tolerant reading of HTML: unclosed and misnested tags, comments, raw
    elements.  ``head`` is no node: what may stand in it has no text, and
    anything else begins the body.  The tag of an inset or template without an
    end tag is passed over, and what follows it is read as if it were not there."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements: tag, nearest block node
    links = 0
    run: list[str] = []
    at, end = 0, len(text)

    def begin() -> None:
        """The body of a page that has not named it."""
        if not stack or len(stack) == 1 and len(page.tags) == 1 and stack[0][0] == "html":
            add("body", "")

    def add(tag: str, attrs: str) -> None:
        if tag not in ("html", "body"):
            begin()
        page.parents.append(stack[-1][1] if stack else -1)
        page.tags.append(INSETS.get(tag, tag))
        page.hints.append(_hint(attrs)[0] if attrs else "none")
        page.linked.append(0)
        label = re.search(r'data-label="(\d)"', attrs) if "data-label" in attrs else None
        page.labels.append(int(label[1]) if label else None)
        stack.append((tag, len(page.tags) - 1))

    def flush() -> None:
        nonlocal run
        if run:
            if not stack:
                add("body", "")
            page.runs.append((stack[-1][1], run))
            run = []

    def pop(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    def put(piece: str) -> None:
        if piece:
            if not piece.isspace():
                begin()
            if stack:
                run.append(piece)
                if links:
                    page.linked[stack[-1][1]] += len(piece)

    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            put(text[at:])
            break
        m = _TOKEN.match(text, lt)
        if m is None:
            put(text[at:lt + 1])  # a lone < is text
            at = lt + 1
            continue
        put(text[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW:
                if tag == "title":
                    flush()
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(text, at)
                    at = close.end() if close else end
                if stack:
                    run.append(" ")
            elif tag == "head" or tag in _PAIRED and (m[3].endswith("/") or (near := _PAIRED[tag].search(text, at)) is None or not near[1]):
                continue
            elif tag == "template":
                at = near.start()
            elif tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    run.append(" ")
            else:
                if tag in NODES:
                    flush()
                    if tag in BLOCKS and tag not in ("html", "body"):
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == "p":
                                pop(k)
                                break
                            if stack[k][0] in NODES:
                                break
                    if tag in CLOSES:
                        ends, stop = CLOSES[tag]
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in ends:
                                pop(k)
                                break
                            if stack[k][0] in stop:
                                break
                    if tag in ("html", "body") and (open_ := [n for t, n in stack if t == tag]):
                        if page.hints[open_[0]] == "none" and m[3]:
                            page.hints[open_[0]] = _hint(m[3])[0]
                        continue
                    add(tag, m[3])
                else:
                    begin()
                    if tag == "a":
                        links += 1
                    stack.append((tag, stack[-1][1]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in NODES:
                        flush()
                    pop(k)
                    break
                if tag not in NODES and stack[k][0] in NODES:
                    break
            else:
                if tag in BLOCKS:
                    flush()
    flush()
    return page


def evidence(page: Page) -> list[tuple[str, ...]]:
    """Of each node: its tag, its names, and for its tag the shape of its own
    text (length, share in links, how it ends)."""
    size = [0] * len(page.tags)
    last = [""] * len(page.tags)
    for node, run in page.runs:
        piece = "".join(run).strip()
        size[node] += len(piece)
        last[node] = piece[-1:] or last[node]
    out = []
    for k, tag in enumerate(page.tags):
        n = size[k]
        length = "0" if n == 0 else "s" if n < 25 else "m" if n < 80 else "l" if n < 300 else "x"
        share = "-" if n == 0 else "0" if page.linked[k] == 0 else "s" if page.linked[k] < 0.3 * n else "m" if page.linked[k] < 0.7 * n else "l"
        end = "-" if n == 0 else "." if last[k] in ".!?\"'»”:;)" else "w"
        out.append((f"{tag} {length}{share}{end}" if n else tag, page.hints[k]))
    return out


@dataclass
class TreeModel:
    root: list[float]
    pair: list[list[float]]  # [parent state][child state]
    emit: list[list[dict[str, float]]]  # [feature][state]
    rare: list[list[float]]  # of a value that a feature never had

    def marginals(self, page: Page) -> list[float]:
        """Probability of the state *text* of each node.  Beliefs are kept as
        logarithms, so a node may have any number of children."""
        n = len(page.tags)
        pair, log, exp = self.pair, math.log, math.exp
        full = [[0.0] * len(STATES) for _ in range(n)]  # own evidence and the children's messages
        sent: list[list[float]] = [[]] * n  # message to the parent
        for k, f in enumerate(evidence(page)):
            for i, v in enumerate(f):
                for s in STATES:
                    full[k][s] += log(self.emit[i][s].get(v, self.rare[i][s]))
        for k in range(n - 1, -1, -1):  # a parent stands before its children
            top = max(full[k])
            b = [exp(x - top) for x in full[k]]
            sent[k] = [log(sum(pair[r][s] * b[s] for s in STATES)) for r in STATES]
            if page.parents[k] >= 0:
                above = full[page.parents[k]]
                for r in STATES:
                    above[r] += sent[k][r]
        belief: list[float] = []
        for k in range(n):
            p = page.parents[k]
            if p < 0:
                down = self.root
            else:
                out = [full[p][r] - sent[k][r] for r in STATES]  # what the parent knows without this child
                top = max(out)
                out = [exp(x - top) for x in out]
                down = [sum(out[r] * pair[r][s] for r in STATES) for s in STATES]
            full[k] = [x + log(d) for x, d in zip(full[k], down, strict=True)]
            top = max(full[k])
            b = [exp(x - top) for x in full[k]]
            belief.append(b[TEXT] / sum(b))
        return belief


def fit(pages: Iterable[Page]) -> TreeModel:
    """Smoothed counts over pages whose nodes are labelled *rest*, *text* or
    *frame*; a *rest* node whose parent is none is a *top*."""
    pair = [[0.5] * len(STATES) for _ in STATES]
    root = [0.1, 1.0, 8.0, 0.1]
    seen: list[list[Counter]] = [[Counter() for _ in STATES] for _ in range(2)]
    for page in pages:
        states = [TOP if s == REST and (p < 0 or page.labels[p] != REST) else s for s, p in zip(page.labels, page.parents, strict=True)]
        for k, f in enumerate(evidence(page)):
            s, p = states[k], page.parents[k]
            if s is None:
                continue
            if p >= 0 and states[p] is not None:
                pair[states[p]][s] += 1
            for i, v in enumerate(f):
                seen[i][s][v] += 1
    emit, rare = [], []
    for i in range(2):
        values = len({v for s in STATES for v in seen[i][s]}) + 1
        total = [sum(seen[i][s].values()) + 0.5 * values for s in STATES]
        emit.append([{v: (n + 0.5) / total[s] for v, n in seen[i][s].items()} for s in STATES])
        rare.append([0.5 / total[s] for s in STATES])
    return TreeModel([x / sum(root) for x in root], [[x / sum(row) for x in row] for row in pair], emit, rare)


def labelled_pages(n: int = 800, seed: int = 3) -> Iterator[Page]:
    """Pages laid out by rule, each block element with its state."""
    rng = random.Random(seed)

    def words(lo: int, hi: int, stop: str = ".") -> str:
        out = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))
        return out + stop

    def el(tag: str, label: int, inner: str, names: str = "") -> str:
        return f'<{tag} data-label="{label}"{names}>{inner}</{tag}>'

    def named(*names: str) -> str:
        return f' {rng.choice(("class", "id"))}="{rng.choice(names)}"'

    def links(k: int, tag: str = "li") -> str:
        return "".join(el(tag, REST, f"<a>{words(1, 3, '')}</a>") for _ in range(k))

    def menu() -> str:
        return el("ul", REST, links(rng.randint(2, 8)))

    def clutter() -> str:
        kind = rng.randrange(12)
        say = words(3, 18)
        if kind == 0:
            return el("nav", REST, menu() if rng.random() < 0.8 else f"<a>{words(1, 2, '')}</a> <a>{words(1, 2, '')}</a>")
        if kind == 1:
            return el("header", REST, el(rng.choice(("div", "h1", "p")), REST, words(1, 4, "")) + (menu() if rng.random() < 0.5 else ""))
        if kind == 2:
            return el("footer", REST, say if rng.random() < 0.5 else el("p", REST, say) + (menu() if rng.random() < 0.4 else ""))
        if kind == 3:
            return el("aside", REST, el("h3", REST, words(1, 4, "")) + (menu() if rng.random() < 0.5 else el("p", REST, words(3, 40))))
        if kind == 4:
            inner = say if rng.random() < 0.6 else el("p", REST, say)
            return el("div", REST, inner, named("ad", "ads", "ad-banner", "advert", "sponsored", "promo box"))
        if kind == 5:
            return el(rng.choice(("div", "section")), REST, el("p", REST, words(5, 40)) + (el("div", REST, words(1, 2, "")) if rng.random() < 0.4 else ""), named("cookie-notice", "notice", "consent", "alert", "gdpr"))
        if kind == 6:
            return el("form", REST, el(rng.choice(("div", "p", "fieldset")), REST, words(1, 8, rng.choice(("", ":", ".")))) if rng.random() < 0.7 else words(1, 6, ""), named("search", "newsletter", "f1") if rng.random() < 0.5 else "")
        if kind in (7, 8):
            one = lambda: el(rng.choice(("div", "li", "article")), REST, el("p", REST, words(2, 40)), named("comment", "reply") if rng.random() < 0.7 else "")
            return el(rng.choice(("section", "div", "ol")), REST, (el("h2", REST, words(1, 3, "")) if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 4))), named("comments", "comment-list", "discussion", "reader-comments"))
        if kind == 9:
            return el("div", REST, menu() if rng.random() < 0.5 else el("p", REST, words(3, 30)), named("sidebar", "side", "related", "share", "social", "widget"))
        if kind == 10:
            return el("div", REST, menu(), named("menu", "breadcrumbs", "topbar"))
        return el("div", REST, links(rng.randint(2, 5), "div"), named("x1", "row") if rng.random() < 0.5 else "")

    def block() -> str:
        kind = rng.randrange(20)
        if kind < 14:
            return el("p", TEXT, words(*rng.choice(((1, 4), (3, 14), (8, 30), (12, 50), (12, 50), (20, 120))), rng.choice(("", ".", ".", ".", "."))))
        if kind == 14:
            return el(rng.choice(("h2", "h3")), TEXT, words(1, 9, rng.choice(("", "."))))
        if kind == 15:
            return el(rng.choice(("ul", "ol")), TEXT, "".join(el("li", TEXT, words(2, 25, rng.choice(("", ".")))) for _ in range(rng.randint(2, 5))))
        if kind == 16:
            return el("blockquote", TEXT, words(5, 40) if rng.random() < 0.5 else el("p", TEXT, words(5, 40)))
        if kind == 17:
            return el("table", TEXT, el("tr", TEXT, "".join(el("td", TEXT, words(1, 5, "")) for _ in range(3))) * 2)
        if kind == 18:
            return el("figure", TEXT, el("figcaption", TEXT, words(3, 15)))
        return el("pre", TEXT, words(3, 30, "")) if rng.random() < 0.5 else el("p", TEXT, f"{words(3, 20, '')} <a>{words(1, 3, '')}</a> {words(3, 40)}")

    for _ in range(n):
        title = el("h1", TEXT, words(2, 12, rng.choice(("", "."))))
        body = "".join(block() if rng.random() < 0.85 else clutter() for _ in range(rng.randint(1, 14)))
        style = rng.randrange(8)
        if style < 3:
            story = el("article", TEXT, title + body)
        elif style == 3:
            story = el("main", TEXT, title + body)
        elif style == 4:
            story = el("main", FRAME, el("article", TEXT, title + body) + "".join(clutter() for _ in range(rng.randrange(2))))
        elif style == 5:
            story = el(rng.choice(("div", "section")), TEXT, title + body, named("content", "post", "entry-content", "story", "article-body", "main-text"))
        elif style == 6:
            story = el("div", TEXT, title + body, named("c1", "box"))
        else:
            story = title + "".join(block() for _ in range(rng.randint(2, 9)))
        before = "".join(clutter() for _ in range(rng.randrange(4)))
        after = "".join(clutter() for _ in range(rng.randrange(4)))
        inside = before + story + after
        if rng.random() < 0.3:
            inside = el("div", FRAME, inside, named("page", "wrapper", "container"))
        yield parse(el("html", FRAME, el("body", FRAME, inside)))


def main_text(model: TreeModel, source: str) -> str:
    """The article's blocks in page order, one line each."""
    page = parse(source)
    if not page.tags:
        return ""
    share = model.marginals(page)
    out = []
    for node, run in page.runs:
        if share[node] > 0.5 and (line := " ".join(html.unescape("".join(run)).split())):
            out.append(line)
    return "\n".join(out)


def extract(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html_col``, and ``text``: the article, empty if there is none.

    Map-only.  Null and empty pages give an empty text; rows are not told apart
    by any key, so null and repeated ids pass through.  A column named ``text``
    is replaced.
    """
    model = model or fit(labelled_pages())
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    src = pages.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(html_col).alias("html"))
    schema = T.StructType([src.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, out, size = batch.column(0), 0, [], 0
            for k in range(batch.num_rows):
                out.append(main_text(model, batch.column(1)[k].as_py() or ""))
                size += len(out[-1])
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([rows.slice(first, len(out)), pa.array(out, pa.string())], ["row", "text"])
                    first, out, size = k + 1, [], 0

    return src.mapInArrow(run, schema).select("row.*", "text")
