"""Main text of web pages by a tree-structured graphical model.

Block elements and runs of text are the nodes of a tree. Each is content (it holds main text) or not.
Node potentials come from tag, names in class and id, size and link share; parent-child potentials
from how labels follow each other. Sum-product messages go up and down the tree once and give every
run of text its marginal. The potentials are fitted to labelled pages, here generated ones, so that the model is trained where it is used and needs no file.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of HTML.
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "figure figcaption form fieldset legend address center details summary dialog menu hr hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown as text of the page.
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the first kind closes an open element of the second kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}

# Names in class, id and role that tell what an element is for.
CUES = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc links sitemap skip",
    "head": "header masthead topbar toolbar logo branding",
    "foot": "footer copyright legal colophon bottom contentinfo disclaimer",
    "side": "sidebar aside side rail widget widgets related recommended popular trending complementary more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall message",
    "form": "form search login signup register signin",
    "comment": "comment comments commentlist disqus reply replies respond discussion feedback reader readers responses",
    "share": "share sharing social follow tags meta byline author",
    "content": "article content main post entry story body text hentry page copy",
}
_CUE = {word: cue for cue, words in CUES.items() for word in words.split()}
_ORDER = list(CUES)

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether an end tag, tag in small letters, attributes) of the markup of a page; comments and the like have no tag.

    Goes over the page once: where a quote or a tag is never closed, this is found out once and kept in mind.
    """
    unclosed = {'"': len(page), "'": len(page)}  # from here on no such quote follows
    at = page.find("<")
    while at >= 0:
        end = -1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, None, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, False, None, ""
        elif m := _OPEN.match(page, at):
            closing, tag = bool(m[1]), m[2].lower()
            if tag in _RAW_END and not closing:
                end = page.find(">", m.end())
                if end < 0:
                    return
                found = _RAW_END[tag].search(page, end + 1)
                end = found.end() if found else len(page)
                yield at, end, False, None, ""
            else:
                i = m.end()
                while end < 0:
                    stop = _STOP.search(page, i)
                    if stop is None:
                        return  # no > is left: the rest is text
                    quote = stop[0]
                    if quote == ">":
                        end = stop.end()
                        break
                    close = page.find(quote, stop.end()) if stop.start() < unclosed[quote] else -1
                    if close < 0:
                        # the tag ends at the next > as if the quote were none
                        unclosed[quote] = min(unclosed[quote], stop.start())
                        end = page.find(">", stop.end()) + 1
                        if not end:
                            return
                    else:
                        i = close + 1
                yield at, end, closing, tag, page[m.end() : end - 1]
        at = page.find("<", max(end, at + 1))


_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    parent: int
    cue: str = "none"
    pieces: list[str] | None = None
    size: int = 0
    linked: int = 0
    heading: bool = False
    inside: bool = False  # within an article or main element
    children: list[int] = field(default_factory=list)


def _cue(attrs: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the element is hidden."""
    if not attrs or attrs.isspace():
        return "none", False
    found: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            found.update(_CUE[w] for w in map(str.lower, _NAME.findall(value)) if w in _CUE)
    for cue in _ORDER:
        if cue in found:
            return cue, hidden
    return "none", hidden


def parse(page: str) -> list[Node]:
    """The tree of block elements and runs of text (tag ``#``), in page order; node 0 is the root."""
    nodes = [Node("#root", -1)]
    # open elements: (tag, its node, unseen); where each tag and any block stands among them
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
    open_at: dict[str, list[int]] = {}
    blocks_at: list[int] = []
    run: Node | None = None
    links = 0

    def say(text: str) -> None:
        nonlocal run
        if not text or stack[-1][2]:
            return
        if run is None:
            if text.isspace():
                return
            at = stack[-1][1]
            run = Node("#", at, pieces=[], inside=nodes[at].inside, heading=nodes[at].heading)
            nodes[at].children.append(len(nodes))
            nodes.append(run)
        run.pieces.append(text)
        n = len(text.strip())
        run.size += n
        if links:
            run.linked += n

    def close(k: int) -> None:
        nonlocal run, links
        for tag, _, _ in stack[k:]:
            open_at[tag].pop()
            if tag in BLOCKS:
                run = None
                blocks_at.pop()
            elif tag == "a":
                links -= 1
        del stack[k:]

    def opened(tag: str, node: int, unseen: bool) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            blocks_at.append(len(stack))
        stack.append((tag, node, unseen))

    def nearest(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at = 0
    for start, end, closing, tag, attrs in tokens(page):
        if start > at:
            say(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if open_at.get(tag):
                close(open_at[tag][-1])
            elif tag in BLOCKS:
                run = None
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                run = None
            continue
        block = tag in BLOCKS
        if block:
            run = None
            if tag in _CLOSES:
                while (k := nearest(_CLOSES[tag])) > nearest(_SCOPE[tag]):
                    close(k)
                    if tag in ("li", "dt", "dd"):
                        break
            if blocks_at and stack[blocks_at[-1]][0] == "p":
                close(blocks_at[-1])
        cue, hidden = _cue(attrs)
        unseen = stack[-1][2] or hidden or tag in UNSEEN
        if attrs.rstrip().endswith("/") and not block:
            continue
        if tag == "a":
            links += 1
        # an inline element is a node only if its names say what it is for
        if block or (cue not in ("none", "content") and tag not in ("a", "b", "i", "em", "strong")):
            up = stack[-1][1]
            if not block:
                run = None
            nodes.append(Node(tag, up, cue, heading=nodes[up].heading or tag in HEADINGS, inside=nodes[up].inside or tag in ("article", "main")))
            nodes[up].children.append(len(nodes) - 1)
            opened(tag, len(nodes) - 1, unseen)
        else:
            opened(tag, stack[-1][1], unseen)
    say(page[at:])
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag != "#":
            nodes[i].size += sum(nodes[c].size for c in nodes[i].children)
            nodes[i].linked += sum(nodes[c].linked for c in nodes[i].children)
    return nodes


_TAGS = frozenset("nav aside header footer form menu dialog article main section body html div p ul ol li table figure figcaption blockquote pre dl address #".split())


def _features(node: Node, up: Node) -> tuple[str, ...]:
    share = node.linked / node.size if node.size else 0.0
    links = "links:" + ("none" if share < 0.05 else "few" if share < 0.4 else "half" if share < 0.8 else "all")
    if node.tag == "#":
        size = "run:" + ("tiny" if node.size < 12 else "short" if node.size < 40 else "line" if node.size < 120 else "long")
        return size, f"#{links}"
    tag = "h" if node.tag in HEADINGS else node.tag if node.tag in _TAGS else "other"
    if tag in ("header", "footer", "aside", "section", "form"):
        tag += "@in" if up.inside else "@out"
    size = "size:" + ("none" if not node.size else "short" if node.size < 60 else "medium" if node.size < 400 else "long")
    return f"tag:{tag}", f"cue:{node.cue}", links, size


@dataclass(frozen=True)
class Model:
    """Log potentials: of features by label, and of a child's label by its parent's."""

    node: dict[str, tuple[float, float]]
    edge: tuple[tuple[float, float], tuple[float, float]]
    root: tuple[float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of being content for each node: one pass of messages up, one down."""
        n = len(nodes)
        known = self.node
        e00, e01 = self.edge[0]
        e10, e11 = self.edge[1]
        own = [(0.0, 0.0)] * n
        up0, up1 = [0.0] * n, [0.0] * n  # node's belief from itself and below
        own[0] = self.root
        for i in range(1, n):
            a = b = 0.0
            for f in _features(nodes[i], nodes[nodes[i].parent]):
                x = known.get(f)
                if x is not None:
                    a += x[0]
                    b += x[1]
            own[i] = (a, b)
        for i in range(n):
            up0[i], up1[i] = own[i]
        to0, to1 = [0.0] * n, [0.0] * n  # message of a node to its parent
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            to0[i] = _add(a + e00, b + e01)
            to1[i] = _add(a + e10, b + e11)
            up0[nodes[i].parent] += to0[i]
            up1[nodes[i].parent] += to1[i]
        all0, all1 = up0[:], up1[:]
        for i in range(1, n):
            p = nodes[i].parent
            a, b = all0[p] - to0[i], all1[p] - to1[i]
            all0[i] = up0[i] + _add(a + e00, b + e10)
            all1[i] = up1[i] + _add(a + e01, b + e11)
        out = []
        for i in range(n):
            d = all0[i] - all1[i]
            out.append(1.0 / (1.0 + math.exp(d)) if d < 700 else 0.0)
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(pages: list[tuple[str, str]], epochs: int = 6) -> Model:
    """Fits to labelled pages: (html, marker), where runs of text that begin with marker are content.

    An element is content if a run of text within it is.
    """
    by_label: tuple[Counter, Counter] = (Counter(), Counter())
    kinds: Counter = Counter()
    totals = [Counter(), Counter()]
    edges = [[1.0, 1.0], [1.0, 1.0]]
    seen = []
    for page, marker in pages:
        nodes = parse(page)
        labels = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].pieces is not None:
                labels[i] = int("".join(nodes[i].pieces).lstrip().startswith(marker))
            elif any(labels[c] for c in nodes[i].children):
                labels[i] = 1
        names = [_features(n, nodes[n.parent]) if i else () for i, n in enumerate(nodes)]
        seen.append((nodes, labels, names))
        for i in range(1, len(nodes)):
            y = labels[i]
            edges[labels[nodes[i].parent]][y] += 1
            for f in names[i]:
                kind = f.partition(":")[0]
                by_label[y][f] += 1
                totals[y][kind] += 1
                kinds[f] += 1
    sizes = Counter(f.partition(":")[0] for f in kinds)
    weights = {}
    for f in kinds:
        kind = f.partition(":")[0]
        one, none = (math.log((by_label[y][f] + 0.5) / (totals[y][kind] + 0.5 * sizes[kind])) for y in (1, 0))
        weights[f] = 0.5 * (one - none)
    edge = tuple(tuple(math.log(edges[p][c] / sum(edges[p])) for c in (0, 1)) for p in (0, 1))
    model = Model({f: (0.0, w) for f, w in weights.items()}, edge, (math.log(0.05), math.log(0.95)))
    # counts see each feature alone; gradient steps on the marginals make them fit together
    for epoch in range(epochs):
        rate = 0.25 / (1.0 + epoch)
        for nodes, labels, names in seen:
            for i, p in enumerate(model.marginals(nodes)):
                if i and abs(labels[i] - p) > 0.01:
                    for f in names[i]:
                        model.node[f] = (0.0, model.node[f][1] * (1 - 1e-4) + rate * (labels[i] - p))
    return model


_MARK = "≡"


def labelled_pages(count: int = 400, seed: int = 7) -> list[tuple[str, str]]:
    """Generated pages of many layouts; content runs begin with a mark."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi)))

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def wrap(tag: str, names: str, inner: str) -> str:
        # the purpose stands in the tag, in the names, or in both
        style = rng.random()
        if style < 0.35 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        name = f' {pick(("class", "id"))}="{pick(names.split())}"'
        return f"<div{name}>{inner}</div>" if style < 0.8 or tag == "div" else f"<{tag}{name}>{inner}</{tag}>"

    def prose(n: int, mark: str) -> str:
        out = []
        for _ in range(n):
            kind, text = rng.random(), mark + words(2, 60)
            if kind < 0.7:
                if rng.random() < 0.3:
                    text += f" <a href='/x'>{words(1, 2)}</a> {words(1, 8)}"
                # now and then all of a paragraph is a link
                out.append(f"<p><a href='/x'>{mark}{words(1, 14)}</a></p>" if rng.random() < 0.08 else f"<p>{text}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{mark}{words(1, 8)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark}{words(1, 15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{mark}{words(1, 5)}</td><td>{mark}{words(1, 5)}</td></tr></table>")
            else:
                out.append(f"<div>{text}</div>")
        return "".join(out)

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        return pick((f"<ul>{items}</ul>", items, " ".join(link() for _ in range(rng.randint(2, 6)))))

    def aside(kind: str) -> str:
        body = prose(rng.randint(1, 3), "") if rng.random() < 0.6 else words(2, 30)
        return {
            "nav": lambda: wrap("nav", CUES["nav"], menu()),
            "header": lambda: wrap("header", CUES["head"], pick((words(1, 6), menu(), f"<h1>{words(1, 4)}</h1>", f"<h1>{words(1, 4)}</h1>{menu()}", f"<p>{words(1, 9)}</p>"))),
            "footer": lambda: wrap("footer", CUES["foot"], pick((words(2, 20), menu(), f"<p>{words(2, 20)}</p>"))),
            "side": lambda: wrap("aside", CUES["side"], pick((body, menu(), f"<h3>{words(1, 4)}</h3>{menu()}"))),
            "ad": lambda: wrap("div", CUES["ad"], pick((body, link(), words(3, 20)))),
            "notice": lambda: wrap("div", CUES["notice"], pick((body, f"{words(3, 30)} {link()}"))),
            "form": lambda: wrap("form", CUES["form"], f"<label>{words(1, 4)}</label><input name=q>{pick(('', f'<p>{words(2, 12)}</p>'))}"),
            "comments": lambda: wrap("div", CUES["comment"], "".join(f"<div>{prose(1, '')}</div>" for _ in range(rng.randint(1, 5)))),
            "share": lambda: wrap("div", CUES["share"], pick((menu(), words(1, 4)))),
        }[kind]()

    pages = []
    for _ in range(count):
        before = "".join(aside(pick(("nav", "header", "ad", "notice", "form", "side"))) for _ in range(rng.randint(0, 4)))
        after = "".join(aside(pick(("footer", "side", "ad", "comments", "nav", "notice", "form", "share"))) for _ in range(rng.randint(0, 4)))
        holder = rng.random()
        title = f"<h1>{_MARK}{words(1, 9)}</h1>"
        if rng.random() < 0.2 and holder < 0.7:
            title = f"<header>{title}</header>"
        inner = title + prose(rng.randint(1, 8), _MARK)
        if rng.random() < 0.35:
            inner += aside(pick(("ad", "share", "side", "comments", "form", "footer", "notice", "nav")))
            inner += prose(rng.randint(0, 3), _MARK)
        if holder < 0.5:
            inner = f"<article>{inner}</article>"
        elif holder < 0.7:
            inner = f"<main>{inner}</main>"
        elif holder < 0.95:
            inner = f'<div {pick(("class", "id"))}="{pick(CUES["content"].split())}">{inner}</div>'
        if rng.random() < 0.3:
            inner = f"<div>{inner}</div>"
        body = before + inner + after
        if rng.random() < 0.3:
            body = f'<div class="{pick(("wrapper", "container", "site", "page"))}">{body}</div>'
        pages.append((f"<html><body>{body}</body></html>", _MARK))
    return pages


@lru_cache(maxsize=1)
def production_model() -> Model:
    return train(labelled_pages())


def extract(page: str | None, model: Model) -> str:
    """Blocks of main text joined by line breaks; empty if there are none."""
    if not page:
        return ""
    nodes = parse(page)
    blocks = []
    for node, p in zip(nodes, model.marginals(nodes), strict=True):
        if node.pieces is not None and p > 0.5:
            text = " ".join(entities.unescape("".join(node.pieces)).split())
            if text:
                blocks.append(text)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    A null or empty html, and one without main text, give an empty text. Repeated rows each get a row;
    an empty table none; other columns are ignored.
    """
    model = production_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
