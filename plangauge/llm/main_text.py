"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of elements.  Each element gets features of itself, its subtree, its
ancestors and its siblings; boosted trees give the log-odds that it belongs to the article; decoding picks
the keep and drop labels of greatest total log-odds in which nothing under a dropped element is kept.

The trees are fitted to a bounded sample of pages whose elements are labelled by meaning (article or main
against nav, footer, advert, comment and so on).  To learn more than those tags, each sampled page is
also laid out anew in other ways from its own texts.

Null and empty pages give an empty text.  Broken markup (unclosed, stray or cut off tags) is read as browsers do,
in the main; pages of any length, and hostile ones, are read whole in time in proportion.  Every row in gives one row out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import map_rows

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Scripts, styles, parts of the head, frames, form controls, and what browsers never show of formulas and drawings.
HIDDEN = frozenset("script style noscript template head title iframe textarea select option button annotation annotation-xml desc metadata".split())
WITH_PARENT = frozenset("math svg".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "li", "dd", "dt", "summary", "figcaption"}
PARTNER = {"td": ("th",), "th": ("td",), "dd": ("dt",), "dt": ("dd",)}
SAME = {"li": "ul ol menu", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "dd": "dl", "dt": "dl", "option": "select"}
TAG_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*+")
# White space and slashes, or a name with perhaps a value: in quotes, or up to white space.  A quote inside an unquoted value is part of it,
# one that is never closed part of a name.  Nothing is tried twice, so long tags cost time in proportion.
INSIDE = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+""")
UNQUOTED_END = re.compile(r"""=\s*+[^\s>"'][^\s>]*+\Z""")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")

TAGS = "html body main article section div p span a b i em strong h1 h2 h3 h4 ul ol li nav header footer aside form table tr td figure blockquote pre details dl".split()
# Hints in class, id, role and the like, by kind of page part.
HINTS = [
    "article content main post story entry body text".split(),
    "nav menu menubar navigation breadcrumb breadcrumbs tabs toolbar links skip".split(),
    "header head banner masthead top branding logo".split(),
    "footer foot bottom copyright legal colophon contentinfo".split(),
    "sidebar aside side widget related recommended trending complementary more".split(),
    "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "cookie consent notice gdpr alert popup modal overlay dialog newsletter subscribe signup warning".split(),
    "comment comments reply replies discussion respond disqus thread reader feedback".split(),
    "form search login input share social follow tags meta".split(),
]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    hints: tuple[int, ...] = ()
    pieces: list = field(default_factory=list)  # texts and child indexes, in page order


def next_markup(html: str, at: int) -> tuple[int, int, str, str] | None:
    """The next tag, comment or declaration from ``at``: where it begins and ends, its name (with a slash in front of an end tag's; empty for the others), and its attributes.

    A tag or declaration that the page's end cuts off goes to the end, as a comment does.
    """
    while (begin := html.find("<", at)) >= 0:
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 2)
            return begin, end + 3 if end >= 0 else len(html), "", ""
        named = TAG_NAME.match(html, begin)
        if named:
            end = INSIDE.match(html, named.end()).end()
            return begin, min(end + 1, len(html)), named[0][1:].lower() if end < len(html) else "", html[named.end() : end]
        if html.startswith(("<!", "<?", "</"), begin):
            end = html.find(">", begin)
            return begin, end + 1 if end >= 0 else len(html), "", ""
        at = begin + 1
    return None


def parse(html: str) -> list[Node]:
    """Elements in page order; element 0 is the page."""
    nodes = [Node("html", -1, 0)]
    stack, at, open_ = [0], 0, Counter()

    def close(k: int) -> None:
        """Close the element at place ``k`` of the stack and all inside it."""
        for i in stack[k:]:
            open_[nodes[i].tag] -= 1
        del stack[k:]

    def text(raw: str) -> None:
        if raw:
            nodes[stack[-1]].pieces.append(unescape(raw))

    while at < len(html):
        found = next_markup(html, at)
        if found is None:
            text(html[at:])
            break
        begin, end, name, attributes = found
        text(html[at:begin])
        at = end
        if not name:
            continue
        tag = name.removeprefix("/")
        if name[0] == "/":
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    close(k)
                    break
                if nodes[stack[k]].tag in BLOCKS:
                    break
        if tag in SAME and (open_[tag] or any(open_[other] for other in PARTNER.get(tag, ()))):
            for k in range(len(stack) - 1, 0, -1):
                other = nodes[stack[k]].tag
                if other == tag or other in PARTNER.get(tag, ()):
                    close(k)
                    break
                if other in SAME[tag].split():
                    break
        parent = stack[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, _hints(attributes) if attributes else ()))
        nodes[parent].pieces.append(len(nodes) - 1)
        if tag in VOID or attributes.endswith("/") and not UNQUOTED_END.search(attributes):
            continue
        if tag in RAW:
            end_tag = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end_tag.end() if end_tag else len(html)
            continue
        open_[tag] += 1
        stack.append(len(nodes) - 1)
    return nodes


def _hints(attributes: str) -> tuple[int, ...]:
    """Kinds of page part whose words stand in the attributes."""
    tokens = {t.lower() for m in ATTRIBUTE.finditer(attributes) for t in TOKEN.findall(m[2] or m[3] or m[4] or "")}
    return tuple(k for k, known in enumerate(HINTS) if any(t in known or t.rstrip("s") in known for t in tokens))


TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = 18 + 3 * len(HINTS) + 6


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each element: itself, its subtree, its ancestors, its siblings."""
    n, kinds = len(nodes), len(HINTS)
    chars_, words_, marks_, in_links_ = [0] * n, [0] * n, [0] * n, [0] * n
    kids, rank, part, linked = [0] * n, [0] * n, [0] * n, [False] * n  # part: 1 in an article or main, -1 in what its tag calls another part
    hint, up, inside = [0] * n, [0] * n, [0] * n  # sets of kinds as bits
    for i, x in enumerate(nodes):
        p = x.parent
        tag = x.tag
        for k in x.hints:
            hint[i] |= 1 << k
        if p >= 0:
            rank[i] = kids[p]
            kids[p] += 1
            up[i], part[i], linked[i] = up[p] | hint[p], part[p], linked[p]
        if tag == "a":
            linked[i] = True
        elif tag in ("article", "main"):
            part[i] = 1
        elif tag in ("nav", "footer", "aside", "form", "header"):
            part[i] = -1
        if tag not in HIDDEN:
            texts = [s for s in x.pieces if s.__class__ is str]
            if texts:
                s = " ".join(texts) if len(texts) > 1 else texts[0]
                chars_[i], words_[i], marks_[i] = len(s), s.count(" ") + 1, s.count(".") + s.count("!") + s.count("?")
                in_links_[i] = len(s) if linked[i] else 0
    tags = np.array([TAG_INDEX.get(x.tag, len(TAGS)) for x in nodes], dtype=float)
    own = np.array([chars_, words_, marks_, in_links_], dtype=float).T
    whole = np.column_stack([own, np.ones(n), tags == TAG_INDEX["a"], tags == TAG_INDEX["p"], tags == TAG_INDEX["li"]])
    for i in range(n - 1, 0, -1):
        inside[nodes[i].parent] |= inside[i] | hint[i]
    # elements are in page order, so a subtree is a range
    end = list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        end[p] = max(end[p], end[i])
    sums = np.vstack([np.zeros(whole.shape[1]), np.cumsum(whole, axis=0)])
    whole = sums[end] - sums[:n]
    bits = lambda sets: (np.array(sets)[:, None] >> np.arange(kinds)) & 1
    hint, up, inside, kids = bits(hint), bits(up), bits(inside), np.array(kids, dtype=float)
    parent = np.array([max(x.parent, 0) for x in nodes])
    chars, words, marks, in_links, size, links, paragraphs, items = whole.T
    total = max(1.0, chars[0])
    depth = np.array([x.depth for x in nodes], dtype=float)
    order = np.array(rank, dtype=float)
    columns = [
        tags, tags[parent], depth, np.log1p(kids), np.log1p(size), np.log1p(chars), chars / total, chars / np.maximum(1, size), in_links / np.maximum(1, chars),
        words / np.maximum(1, size), marks / np.maximum(1, words), links / size, paragraphs / size, items / size, np.log1p(own[:, 0]),
        chars / np.maximum(1, chars[parent]), order / np.maximum(1, kids[parent]), np.arange(n) / n,
        part, in_links[parent] / np.maximum(1, chars[parent]), np.log1p(chars[parent]), np.log1p(kids[parent]), np.log1p(links), np.log1p(paragraphs),
    ]
    return np.column_stack([*columns, hint, up, inside])


# --- trees


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: split column and threshold of each inner place, value of each leaf; ``base`` log-odds."""

    base: float
    column: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, threshold, value in zip(self.column, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(value)))):
                at = 2 * at + 1 + (x[rows, column[at]] > threshold[at])
            out += value[at - len(column)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Logistic boosting with histogram splits."""
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    score, inner = np.full(len(y), base), 2**depth - 1
    columns, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        column, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for place in range(inner):
            rows = np.flatnonzero(at == place)
            best = 0.0
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for c, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, c], weights=g[rows], minlength=len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, c], weights=h[rows], minlength=len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs**2 / (hs + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best + 1e-9:
                        best, column[place], threshold[place] = float(gain[k]), c, float(e[k])
            at[rows] = 2 * place + 1 + (x[rows, column[place]] > threshold[place])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        score = score + value[leaf]
        columns.append(column)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.array(columns), np.array(thresholds), np.array(values))


# --- training pages

DROPPED_TAGS = frozenset("nav header footer aside form dialog menu".split())


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 in or around an article, 0 elsewhere, by tags and hints; None for a page without an article."""
    label = np.zeros(len(nodes))
    inside = np.zeros(len(nodes), dtype=bool)
    named = [i for i, x in enumerate(nodes) if x.tag == "article"] or [i for i, x in enumerate(nodes) if x.tag == "main"]
    if not named:
        return None
    for i, x in enumerate(nodes):
        inside[i] = i in named or (x.parent >= 0 and inside[x.parent] and x.tag not in DROPPED_TAGS | HIDDEN and not set(x.hints) & {1, 4, 5, 6, 7})
        label[i] = inside[i]
    for i in named:
        while i >= 0:
            label[i] = 1
            i = nodes[i].parent
    return label


def lay_out(texts: list[str], draw: np.random.Generator) -> str:
    """A page in another layout, made of a page's texts; its article is marked ``data-part``."""
    pick = lambda options: options[int(draw.integers(len(options)))]
    some = lambda low, high: [pick(texts) for _ in range(int(draw.integers(low, high)))]
    short = lambda: " ".join(pick(texts).split()[: int(draw.integers(1, 5))])
    sentence = lambda: " ".join(pick(texts).split()[: int(draw.integers(5, 30))])
    word = lambda kind: pick(HINTS[kind][:5])
    links = lambda: "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(int(draw.integers(2, 9))))
    named = lambda tag, kind: pick([f"<{tag}>", f'<{tag} class="{word(kind)}">', f'<{tag} id="{word(kind)}">', f'<{tag} class="{word(kind)}-box x{int(draw.integers(9))}">'])
    part = lambda tag, kind, body: (named(tag, kind) if tag != "div" else pick([f'<div class="{word(kind)}">', f'<div id="{word(kind)}">'])) + body + f"</{tag}>"
    closing = pick(["</p>", "</p>", ""])
    plain = lambda: pick([pick(texts), pick(texts), sentence(), f"<b>{sentence()}</b> {sentence()}", f'{sentence()} <a href="/x">{short()}</a> {sentence()}'])
    paragraphs = [f"<p>{plain()}{closing}" for _ in range(int(draw.integers(1, 9)))]
    if draw.random() < 0.2:
        paragraphs.insert(int(draw.integers(len(paragraphs) + 1)), "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
    if draw.random() < 0.15:
        paragraphs.append(f"<blockquote>{sentence()}</blockquote>")
    if draw.random() < 0.15:
        paragraphs.append(f"<h2>{short()}</h2><p>{pick(texts)}{closing}")
    advert = lambda: part(pick(["div", "aside", "section"]), 5, pick([sentence(), f"<p>{sentence()}</p>"]))
    if draw.random() < 0.3:
        paragraphs.insert(int(draw.integers(len(paragraphs) + 1)), advert())
    heading = pick([f"<h1>{short()}</h1>", f"<h1>{sentence()}</h1>", ""])
    article = heading + "".join(paragraphs)
    opening, tag = pick([('<article data-part>', "article"), ('<main data-part>', "main"), (f'<div data-part class="{word(0)}">', "div"), (f'<div data-part id="{word(0)}">', "div"), (f'<section data-part class="{word(0)}">', "section"), ("<div data-part>", "div")])
    comments = part(pick(["div", "section", "ul"]), 7, "".join(f"<{pick(['div', 'p', 'li'])}>{sentence()}</{'p'}>" for _ in range(int(draw.integers(1, 6)))))
    before = [part("nav", 1, f"<ul>{links()}</ul>"), part("div", 1, f"<ul>{links()}</ul>"), part("header", 2, f"<p>{short()}</p>"), part("div", 2, sentence()), advert(), part("div", 6, f"<p>{sentence()}</p>")]
    after = [comments, part("footer", 3, f"<p>{sentence()}</p>"), part("div", 3, sentence()), part("aside", 4, f"<h3>{short()}</h3><ul>{links()}</ul>"), part("div", 4, "".join(f"<p>{s}</p>" for s in some(1, 4))), advert(), part("form", 8, f'<label>{short()}</label><input name="q">'), part("div", 6, sentence())]
    chosen = lambda parts, chance: "".join(x for x in parts if draw.random() < chance)
    tail = comments if draw.random() < 0.2 and tag in ("article", "main") else ""
    body = chosen(before, 0.4) + f"{opening}{article}{tail}</{tag}>" + chosen(after, 0.4)
    if draw.random() < 0.4:
        body = f'<div class="{pick(["wrapper", "page", "container", "layout"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{short()}</title></head><body>{body}"


def layout_labels(html: str) -> tuple[list[Node], np.ndarray]:
    """Labels of a page of :func:`lay_out`: the marked element, what it holds but parts of other kinds, and what holds it."""
    nodes = parse(html)
    marked = html.index(" data-part")
    # the marked element is the one that many elements opened before
    opened, at = 0, 0
    while (found := next_markup(html, at)) and found[1] <= marked:
        opened += bool(found[2]) and found[2][0] != "/" and found[2] != "html"
        at = found[1]
    label, inside = np.zeros(len(nodes)), np.zeros(len(nodes), dtype=bool)
    target = opened + 1
    for i, x in enumerate(nodes):
        inside[i] = i == target or (x.parent >= 0 and inside[x.parent] and not set(x.hints) & {5, 7})
        label[i] = inside[i]
    i = target
    while i >= 0:
        label[i] = 1
        i = nodes[i].parent
    return nodes, label


def train(pages: DataFrame, html: str = "html", max_pages: int = 160, layouts: int = 3) -> Forest:
    """Fit on at most ``max_pages`` pages, the first by a hash of their markup, and ``layouts`` new layouts of each."""
    first = pages.filter(F.col(html).isNotNull()).select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    few = first.select("h").distinct().orderBy("h").limit(max_pages)
    rows = first.join(F.broadcast(few), "h").dropDuplicates(["h"]).orderBy("h").limit(max_pages).collect()
    xs, ys, ws = [], [], []

    def add(nodes: list[Node], label: np.ndarray) -> None:
        x = features(nodes)
        xs.append(x)
        ys.append(label)
        ws.append(np.full(len(label), 1 / np.sqrt(len(label))))

    for row in rows:
        nodes = parse(row["html"])
        label = weak_labels(nodes)
        if label is not None:
            add(nodes, label)
        texts = [t for t in ("".join(s for s in x.pieces if isinstance(s, str)).strip() for x in nodes if x.tag not in HIDDEN) if t and len(t) < 5000]
        draw = np.random.default_rng(zlib.crc32(row["html"].encode("utf-8", "replace")))
        for _ in range(layouts if texts else 0):
            texts_safe = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts]
            add(*layout_labels(lay_out(texts_safe, draw)))
    if not xs:
        return Forest(0.0, np.zeros((0, 15), dtype=np.int64), np.zeros((0, 15)), np.zeros((0, 16)))
    return boost(np.vstack(xs), np.concatenate(ys), np.concatenate(ws))


# --- decoding


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Keep flags of greatest total log-odds (a kept element counts its log-odds, a dropped one the opposite) with nothing kept under a dropped one.

    Formulas and drawings stay or go with the element they stand in: training pages hold too few to judge their parts.
    """
    n = len(nodes)
    follows = np.zeros(n, dtype=bool)
    for i, x in enumerate(nodes):
        follows[i] = x.parent >= 0 and (x.tag in WITH_PARENT or follows[x.parent])
    log_odds = np.where(follows, 0.0, log_odds)
    kept_gain, drop_gain = log_odds.copy(), -log_odds
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        kept_gain[p] += max(kept_gain[i], drop_gain[i])
        drop_gain[p] += drop_gain[i]
    keep = kept_gain > drop_gain
    for i, x in enumerate(nodes):
        keep[i] = (keep[i] or follows[i]) and (x.parent < 0 or keep[x.parent]) and x.tag not in HIDDEN
    return keep


def blocks(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Texts of the kept elements in page order, one for each run of text between block elements."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        joined = SPACE.sub(" ", "".join(run)).strip()
        if joined:
            out.append(joined)
        run.clear()

    todo: list = [0]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            close()
        elif keep[x]:
            node = nodes[x]
            if node.tag == "br":
                run.append(" ")
            edge = [None] if node.tag in BLOCKS else []
            todo += [*edge, *reversed(node.pieces), *edge]
        elif nodes[x].tag in BLOCKS:
            todo.append(None)
    close()
    return out


def extract(html: str | None, forest: Forest) -> str:
    if not html:
        return ""
    nodes = parse(html)
    return "\n\n".join(blocks(nodes, decode(nodes, forest.log_odds(features(nodes)))))


def main_text(pages: DataFrame, forest: Forest, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``carry`` with ``text`` and ``n_chars`` of every page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast((forest.base, forest.column, forest.threshold, forest.value))
    kinds = dict(pages.dtypes)

    def make():
        trees = Forest(*shared.value)

        def work(htmls, *rest):
            parsed = [parse(h or "") for h in htmls]
            odds = trees.log_odds(np.vstack([features(nodes) for nodes in parsed]))
            at = 0
            for nodes, *others in zip(parsed, *rest):
                text = "\n\n".join(blocks(nodes, decode(nodes, odds[at : at + len(nodes)])))
                at += len(nodes)
                yield *others, text, len(text)

        return work

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "text string, n_chars long"])
    return map_rows(pages.select(html, *carry), schema, make, 64)
