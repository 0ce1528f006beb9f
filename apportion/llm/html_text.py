"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

Pages are parsed into block nodes inside tasks. Every node gets numbers: depth, place and size
among its siblings, text and link density of its subtree, and words of its tag, class, id and
role. Gradient-boosted trees give each node log odds of being article. Decoding then chooses for
each node, from the leaves up, between keeping its whole subtree, dropping it whole, and letting
its children decide, so that no node contradicts the ones around it.

Teaching needs no labelled table: nodes that the page's own markup names beyond doubt (article,
main; nav, header, footer, aside, form, and well-known class words) are the examples, from at
most TEACHING_PAGES pages by hash order, together with generated layouts in which the article is
known although nothing names it.

Defined results: null and empty pages and pages without article text give the empty text;
unclosed and stray tags are closed as browsers do; repeated rows get equal results. Only the html
column is read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEACHING_PAGES = 300
LAYOUTS = 240  # generated pages
TREES, LEVELS, RATE, BINS = 40, 4, 0.3, 32
LEAST_LEAF = 8.0

# Fixed values of the HTML standard: elements that begin a new block, elements without content,
# elements whose content is no markup, and those that a following element closes.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup li dt dd tr td th tbody thead tfoot legend summary".split())
PEERS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]{0,4096}"|'[^']{0,4096}')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-keep)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+|[0-9]+")

# Words of tags and attributes that say what a node is for, one feature each.
PURPOSES = (
    ("nav", ("nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs")),
    ("header", ("header", "masthead", "banner", "topbar", "logo", "hgroup")),
    ("footer", ("footer", "foot", "copyright", "legal", "colophon", "contentinfo")),
    ("side", ("aside", "sidebar", "side", "widget", "rail", "complementary", "related", "recommended", "popular")),
    ("notice", ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "banner", "dialog", "newsletter", "subscribe")),
    ("ad", ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "advertising")),
    ("form", ("form", "search", "login", "signup", "fieldset", "select", "option", "input", "legend", "button")),
    ("comment", ("comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "reader")),
    ("share", ("share", "social", "tags", "meta", "byline", "tools", "print", "rating")),
    ("content", ("article", "main", "content", "post", "entry", "story", "body", "text", "articlebody", "blog")),
    ("list", ("ul", "ol", "li", "dl", "dt", "dd", "menu")),
    ("paragraph", ("p", "blockquote", "pre")),
    ("heading", ("h1", "h2", "h3", "h4", "h5", "h6", "title", "headline")),
    ("table", ("table", "tr", "td", "th", "tbody", "thead", "tfoot")),
)
WORDS = {w: sum(1 << i for i, (_, ws) in enumerate(PURPOSES) if w in ws) for _, ws in PURPOSES for w in ws}
_AWAY = sum(1 << i for i, (n, _) in enumerate(PURPOSES) if n in ("nav", "header", "footer", "side", "notice", "ad", "form", "comment"))
_LANDMARK = frozenset(("article", "main"))
_AWAY_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "select"))


@dataclass
class Page:
    """Block nodes in the order of their start tags; texts are (node, text) in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    purpose: list[int] = field(default_factory=lambda: [0])
    keep: list[int] = field(default_factory=lambda: [-1])
    texts: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters in links, by text


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block node
    buffer: list[str] = []
    state = {"link": 0, "in_link": 0, "head": False}

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                page.texts.append((stack[-1][1], text))
                page.links.append(state["link"])
            buffer.clear()
        state["link"] = 0

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the nearest open element of one of the names, unless a stop is nearer."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                if any(x in BLOCKS for x, _ in stack[i:]):
                    flush()
                state["in_link"] -= sum(x == "a" for x, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    def text(piece: str) -> None:
        if piece and not state["head"]:
            buffer.append(piece)
            if state["in_link"]:
                state["link"] += len(piece)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ending:
            if name == "head":
                state["head"] = False
            elif name in BLOCKS or name not in VOID:
                close((name,), () if name in BLOCKS else ("td", "th", "body"))
            continue
        if name in RAW:
            if name in ("svg", "math", "object", "noscript", "template") and attributes.endswith("/"):
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if name == "head":
            state["head"] = True
            continue
        if name == "body":
            state["head"] = False
        if name in ("html", "body"):
            continue
        if name == "br":
            text(" ")
            continue
        if name in PEERS:
            close(*PEERS[name])
        if name in CLOSES_P:
            close(("p",), ("button", "td", "th", "caption"))
        if name[0] == "h" and len(name) == 2 and stack[-1][0][:1] == "h" and len(stack[-1][0]) == 2 and name != "hr":
            close((stack[-1][0],), ())
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        node = stack[-1][1]
        if name in BLOCKS:
            node = len(page.parent)
            page.parent.append(stack[-1][1])
            page.tag.append(name)
            purpose, keep = WORDS.get(name, 0), -1
            for key, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'")
                if key.lower() == "data-keep":
                    keep = int(value)
                    continue
                for w in _TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                    purpose |= WORDS.get(w, 0)
            page.purpose.append(purpose)
            page.keep.append(keep)
        elif name == "a":
            state["in_link"] += 1
        stack.append((name, node))
    flush()
    return page


NAMES = (
    *(f"is_{n}" for n, _ in PURPOSES),
    *(f"under_{n}" for n, _ in PURPOSES),
    *("depth", "order", "siblings", "same_tag", "children", "blocks", "chars", "own_chars", "mean_block", "link_share"),
    *("density", "page_share", "starts_at", "commas", "stops", "p_share", "li_share", "parent_chars", "before_chars", "after_chars"),
)


def features(page: Page) -> np.ndarray:
    """Rows of NAMES, one for each node."""
    n = len(page.parent)
    parent = np.array(page.parent)
    own = np.zeros((n, 7))  # chars, blocks, link chars, commas, full stops, p chars, li chars
    start = np.full(n, np.inf)
    total = max(1, sum(len(t) for _, t in page.texts))
    so_far = 0
    for (node, t), link in zip(page.texts, page.links, strict=True):
        size, tag = len(t), page.tag[node]
        own[node] += (size, 1, min(link, size), t.count(","), t.count(".") + t.count("?") + t.count("!"), size * (tag == "p"), size * (tag == "li"))
        start[node] = min(start[node], so_far / total)
        so_far += size
    sub, size = own.copy(), np.ones(n)
    children, depth = np.zeros(n), np.zeros(n)
    under = np.zeros(n, dtype=np.int64)
    purpose = np.array(page.purpose, dtype=np.int64)
    order, same = np.zeros(n), np.zeros(n)
    seen: dict[tuple[int, str], int] = {}
    before, after = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    for v in range(1, n):
        p = page.parent[v]
        depth[v] = depth[p] + 1
        under[v] = under[p] | purpose[p]
        order[v] = children[p]
        children[p] += 1
        key = (p, page.tag[v])
        seen[key] = seen.get(key, 0) + 1
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        sub[p] += sub[v]
        size[p] += size[v]
        start[p] = min(start[p], start[v])
    for v in range(1, n):
        p = page.parent[v]
        same[v] = seen[(p, page.tag[v])] / children[p]
        if p in last:
            before[v] = sub[last[p], 0]
            after[last[p]] = sub[v, 0]
        last[p] = v
    chars = sub[:, 0]
    some = np.maximum(chars, 1)
    bits = np.arange(len(PURPOSES))
    top = np.maximum(parent, 0)
    return np.column_stack(
        [
            (purpose[:, None] >> bits) & 1,
            (under[:, None] >> bits) & 1,
            depth,
            order,
            children[top],
            same,
            children,
            sub[:, 1],
            np.log1p(chars),
            np.log1p(own[:, 0]),
            chars / np.maximum(sub[:, 1], 1),
            sub[:, 2] / some,
            chars / size,
            chars / total,
            np.where(np.isfinite(start), start, 1.0),
            100 * sub[:, 3] / some,
            100 * sub[:, 4] / some,
            sub[:, 5] / some,
            sub[:, 6] / some,
            np.log1p(chars[top]),
            np.log1p(before),
            np.log1p(after),
        ]
    ).astype(np.float32)


def examples(page: Page) -> np.ndarray:
    """1 for nodes that are article beyond doubt, 0 for those that are not, -1 for the others."""
    n = len(page.parent)
    out = np.full(n, -1)
    for v in range(1, n):
        p, tag = page.parent[v], page.tag[v]
        if page.keep[v] >= 0:
            out[v] = page.keep[v]
        elif out[p] == 0 or tag in _AWAY_TAGS or (page.purpose[v] & _AWAY and tag in ("div", "section", "ul", "ol", "p")):
            out[v] = 0
        elif tag in _LANDMARK or out[p] == 1:
            out[v] = 1
    return out


def layouts(count: int = LAYOUTS, seed: int = 11) -> Iterator[str]:
    """Generated pages whose nodes carry data-keep; many name nothing, so that the numbers count."""
    rnd = random.Random(seed)

    def words(n: int) -> str:
        out = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
        return " ".join(w + rnd.choice(("", "", "", "", ",", ".")) for w in out).capitalize() + "."

    def links(n: int) -> str:
        return "".join(f'<li data-keep="0"><a href="/x">{words(rnd.randint(1, 3))}</a></li>' for _ in range(n))

    def named(tags: tuple[str, ...], classes: tuple[str, ...], keep: int, body: str) -> str:
        tag = rnd.choice(tags)
        mark = f' class="{rnd.choice(classes)}"' if classes and rnd.random() < 0.6 else ""
        return f'<{tag}{mark} data-keep="{keep}">{body}</{tag}>'

    for _ in range(count):
        short = lambda: f'<p data-keep="0">{words(rnd.randint(2, 14))}</p>'
        menu = named(("nav", "div", "ul"), ("menu", "nav", "navbar", "breadcrumbs"), 0, links(rnd.randint(3, 12)))
        head = named(("header", "div"), ("header", "masthead", "banner"), 0, f'<h2 data-keep="0">{words(2)}</h2>{short()}')
        side = named(("aside", "div"), ("sidebar", "widget", "related"), 0, f'<h3 data-keep="0">{words(2)}</h3><ul data-keep="0">{links(rnd.randint(3, 9))}</ul>')
        foot = named(("footer", "div"), ("footer", "legal"), 0, f"&copy; {words(rnd.randint(3, 15))}")
        ad = f'<div class="{rnd.choice(("ad", "ads", "promo", "sponsored", "advert"))}" data-keep="0">{words(rnd.randint(3, 25))}</div>'
        note = f'<div class="{rnd.choice(("cookie notice", "consent", "newsletter popup"))}" data-keep="0">{short()}</div>'
        form = f'<form data-keep="0">{short()}<select data-keep="0"><option data-keep="0">{words(1)}</option></select></form>'
        talk = f'<{rnd.choice(("div", "section", "ol"))} class="{rnd.choice(("comments", "comment-list", "replies", "discussion"))}" data-keep="0">' + "".join(
            f'<div data-keep="0"><p data-keep="0">{words(rnd.randint(4, 60))}</p></div>' for _ in range(rnd.randint(1, 6))
        )
        talk += f"</{talk[1 : talk.index(' ')]}>"
        parts = [f'<h1 data-keep="1">{words(rnd.randint(2, 12))}</h1>']
        for _ in range(rnd.randint(1, 16)):
            parts.append(f'<p data-keep="1">{words(rnd.choice((1, 2, 5, 15, 40, 80, 120)))}</p>')
            if rnd.random() < 0.1:
                parts.append(f'<h2 data-keep="1">{words(rnd.randint(1, 7))}</h2>')
            if rnd.random() < 0.1:
                parts.append('<ul data-keep="1">' + "".join(f'<li data-keep="1">{words(rnd.randint(2, 20))}</li>' for _ in range(3)) + "</ul>")
            if rnd.random() < 0.15:
                parts.append(rnd.choice((ad, form, side)))
        body = named(("article", "main", "div", "section"), ("content", "post", "story", "entry"), 1, "".join(parts))
        lead = [x for x in (note, head, menu, ad, form) if rnd.random() < 0.6]
        tail = [x for x in (talk, side, ad, form, foot) if rnd.random() < 0.6]
        rnd.shuffle(lead)
        page = "".join([*lead, body, *tail])
        yield f"<html><body>{page if rnd.random() < 0.5 else f'<div>{page}</div>'}</body></html>"


@dataclass
class Trees:
    feature: np.ndarray  # tree by inner node, of a complete tree
    border: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, feature[at]] > border[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic boosting with histogram splits on a bounded table."""
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(borders)])
    inner = (1 << LEVELS) - 1
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    margin = np.full(len(x), base)
    trees = Trees(np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(LEVELS):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            pick, cut = np.zeros(count, dtype=np.int64), np.full(count, BINS)
            for f in range(x.shape[1]):
                key = (at - first) * (BINS + 1) + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < LEAST_LEAF / 8) | (ha - hs < LEAST_LEAF / 8)] = 0
                gain = gain[:, :-1]
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better], pick[better], cut[better] = gain[np.arange(count), top][better], f, top[better]
            trees.feature[t, first : first + count] = pick
            for i in range(count):
                if cut[i] < len(borders[pick[i]]):
                    trees.border[t, first + i] = borders[pick[i]][cut[i]]
            right = x[np.arange(len(x)), pick[at - first]] > trees.border[t, at]
            at = 2 * at + 1 + right
        slot = at - inner
        gs, hs = (np.bincount(slot, weights=v, minlength=inner + 1) for v in (g, h))
        trees.leaf[t] = RATE * gs / (hs + 1)
        margin += trees.leaf[t][slot]
    return trees


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each text is kept. A node keeps all, drops all or leaves it to its children; what
    is its own text then goes by its own odds."""
    n = len(page.parent)
    own = np.zeros(n)
    for node, t in page.texts:
        own[node] += len(t)
    weight = np.sqrt(own) + 0.5
    keep = weight * odds
    best = np.abs(np.where(own > 0, keep, 0.0))  # children decide: own text by its sign
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        # The subtree's whole and mixed values are complete once all later nodes are in.
        best[v] = max(best[v], keep[v], -keep[v])
        keep[p] += keep[v]
        best[p] += best[v]
    single = weight * odds
    kept = np.zeros(n, dtype=bool)
    fixed = np.zeros(n, dtype=np.int8)  # 1 kept with an ancestor, -1 dropped with it
    for v in range(n):
        p = page.parent[v]
        if v and fixed[p]:
            fixed[v] = fixed[p]
        elif v and keep[v] >= best[v]:
            fixed[v] = 1
        elif v and -keep[v] >= best[v]:
            fixed[v] = -1
        kept[v] = fixed[v] == 1 or (not fixed[v] and single[v] > 0)
    return [bool(kept[node]) for node, _ in page.texts]


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels = [], []
        for source in batch.column(0).to_pylist():
            page = parse(source or "")
            y = examples(page)
            rows.append(features(page)[y >= 0])
            labels.append(y[y >= 0])
        x = np.concatenate(rows) if rows else np.empty((0, len(NAMES)), np.float32)
        y = np.concatenate(labels) if labels else np.empty(0, int)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([values, pa.array(y, pa.int32())], names=["x", "y"])


def learn(pages: DataFrame, html_col: str = "html") -> Trees:
    """Trees from the plain nodes of at most TEACHING_PAGES pages and from the layouts."""
    source = pages.select(F.col(html_col).cast("string").alias("html")).filter("html is not null")
    sample = source.orderBy(F.xxhash64("html"), F.length("html")).limit(TEACHING_PAGES)
    got = sample.mapInArrow(_taught, "x array<float>, y int").toArrow()
    x = [np.array(got["x"].to_pylist(), dtype=np.float32).reshape(-1, len(NAMES))]
    y = [np.array(got["y"].to_pylist(), dtype=float)]
    for source in layouts():
        page = parse(source)
        label = examples(page)
        x.append(features(page)[label >= 0])
        y.append(label[label >= 0].astype(float))
    # Real pages and layouts count alike as a whole, and so do the two labels.
    sizes = [len(y[0]), sum(map(len, y[1:]))]
    x, y = np.concatenate(x), np.concatenate(y)
    weight = np.repeat([1.0, max(1.0, sizes[0]) / max(1, sizes[1])], sizes)
    for label in (0, 1):
        part = y == label
        weight[part] *= len(y) / (2 * max(weight[part].sum(), 1e-9))
    return boost(x, y, weight)


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [parse(s) if s else None for s in sources]
    some = [p for p in pages if p is not None]
    out, at = [], 0
    odds = trees.log_odds(np.concatenate([features(p) for p in some])) if some else np.empty(0)
    for page in pages:
        if page is None:
            out.append("")
            continue
        n = len(page.parent)
        kept = decode(page, odds[at : at + n])
        at += n
        out.append("\n\n".join(t for (_, t), k in zip(page.texts, kept, strict=True) if k))
    return out


def main_text(source: Column, trees: Trees, spark) -> Column:
    """Main text of an html column; empty if there is none."""
    shared = spark.sparkContext.broadcast(trees)

    def run(column: pa.Array) -> pa.Array:
        sources = column.to_pylist()
        out: list[str] = []
        for at in range(0, len(sources), 256):
            out += extract(sources[at : at + 256], shared.value)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(source.cast("string"))
