"""Main-text extraction from HTML by a tree-structured graphical model.

The nodes are a page's block elements, and the inline ones in them whose names tell
something or are not HTML's own; a node is content or not. Each node has a
potential from its features (tag, words of its class and id, lengths, links), each
parent and child share one by the child's kind of tag. Sum-product messages, once
upward and once downward, give exact marginals; runs of text whose node is more
likely content than not are the main text (one that is as likely as not is left out);
what an inline node holds is judged with it, and stands in the line of the block around it. What is not
shown (hidden, display:none, visibility:hidden) is no text, inline or not. The weights are trained by gradient
ascent on the likelihood of labelled pages, whose gradients come from the same
messages. The labelled pages are made by ``labelled_pages`` from a fixed seed.

Null and empty html give an empty text, and so do pages without content. Broken
pages are read as far as they go: unclosed elements, hidden ones too, end with their
parent, a tag cut off at the end is dropped. A head is no element of its own: what it
may hold is hidden anyway, and whatever else follows belongs to the body, with or
without </head>. Repeated pages give repeated rows. Pages of any length
are read whole; nesting of any depth needs no recursion.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Tags by what they do. Block elements are nodes; all others belong to the node around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is not the page's, whatever holds them.
HIDDEN = frozenset("script style template noscript iframe object svg annotation annotation-xml title textarea select button audio video canvas datalist".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks whose start ends an open paragraph; and items that end an open item of their own kind.
NO_PARAGRAPH = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption".split())
ITEMS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = frozenset("table ul ol dl menu dir body html".split())
#: Elements that leave a head open, and those of them that may hold any tag's name.
METADATA = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
CODE = frozenset("script style template".split())
#: Drawings and formulas, their parts that hold markup, and the starts that end them where those are not open.
FOREIGN = ("svg", "math")
INTEGRATION = ("foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN_END = re.compile(r"</(?:svg|math)(?=[\s/>])", re.IGNORECASE)
#: Starts that end an open select.
NOT_IN_SELECT = NO_PARAGRAPH - frozenset("hr div legend".split()) | {"select", "input", "textarea"}

TOKEN = re.compile(
    r"""<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(>|\Z)""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+")
NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)

#: Words of class, id and role names, by what they tell.
HINTS = {
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs topbar",
    "frame": "header masthead footer foot banner copyright legal logo branding colophon contentinfo",
    "side": "sidebar side aside rail widget widgets complementary related recommended trending popular more",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer warning",
    "comments": "comment comments commentlist reply replies respond response discussion disqus thread reviews reader",
    "social": "share sharing social follow tweet facebook like likes meta tags byline author bio",
    "form": "form search login signin register contact input",
    "content": "article content main post entry story body text page prose blog hentry articlebody maincontent",
}
HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
KINDS = [
    "html body", "div", "section", "article", "main", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu dir", "li dt dd", "blockquote pre figure figcaption details summary",
    "table tbody thead tfoot tr caption", "td th", "nav", "header hgroup", "footer address", "aside dialog", "form fieldset legend search",
]
KIND_OF = {tag: k for k, tags in enumerate(KINDS) for tag in tags.split()}
OTHER = len(KINDS)
FEATURES = OTHER + 1 + len(HINTS) + 2 + 6 + 4 + 3 + 1


class Page:
    """Nodes in page order: ``tags``, ``parents`` (-1 for the root), hints, whether they are not shown
    (``hidden``) or not read aloud (``silent``); and the runs of text."""

    __slots__ = ("tags", "parents", "hints", "hidden", "silent", "runs", "linked", "links")

    def __init__(self) -> None:
        self.tags, self.parents, self.hints, self.hidden, self.silent = ["html"], [-1], [()], [False], [False]
        self.runs: list[list] = []  # [block, pieces of text, the node of each: the block or an inline one in it]
        self.linked, self.links = [0], [0]


class Opened:
    """Names of open elements in page order; the last place of a name is at hand, so unmatched end tags cost no search."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def cut(self, place: int) -> None:
        while len(self.names) > place:
            self.places[self.names.pop()].pop()


def _attributes(text: str) -> tuple[tuple, bool, bool]:
    """(hints, whether the element is not shown, whether it is not read aloud)."""
    words, off, silent = [], False, False
    for key, a, b, c in ATTRIBUTE.findall(text):
        value = a or b or c
        key = key.lower()
        if key == "hidden":
            off = off or value.lower() != "until-found"
        elif key == "style":
            off = off or bool(NOT_SHOWN.search(value))
        elif key == "aria-hidden":
            silent = silent or value.lower() == "true"
        else:
            words += NAME_PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
    return _hints(words), off, silent


def _hints(words: list[str]) -> tuple:
    return tuple({HINT_OF[w] for w in words if w in HINT_OF})


def parse(source: str) -> Page:
    """Reads a page's block tree and its runs of text; one pass, no recursion."""
    page, at, n = Page(), 0, len(source)
    opened = Opened()  # open elements that are no nodes: inline ones, and all in a hidden one
    stack: list[tuple[str, int, int]] = [("html", 0, 0)]  # open block elements: name, node, how many were opened before
    inline: list[tuple[int, int]] = []  # open inline nodes: place in ``opened``, node
    node, link, run = 0, 0, None  # the innermost open node; in a link; the run that goes on
    hidden = -1  # place of the open hidden element in ``opened``
    head = True  # nothing of the body has been seen
    endless: set[str] = set()  # elements without markup that no later end tag closes

    def text(piece: str) -> None:
        nonlocal run, head
        if run is None or run[0] != stack[-1][1]:
            if not piece or piece.isspace():
                return
            head = False
            page.runs.append(run := [stack[-1][1], [], []])
        run[1].append(piece)
        run[2].append(node)
        if link:
            page.linked[node] += len(piece)

    def settle() -> None:
        """The innermost open node, after elements have ended."""
        nonlocal node
        while inline and inline[-1][0] >= len(opened.names):
            inline.pop()
        node = inline[-1][1] if inline and inline[-1][0] >= stack[-1][2] else stack[-1][1]

    def add(name: str, hints: tuple, off: bool, silent: bool) -> int:
        page.tags.append(name)
        page.parents.append(node)
        page.hints.append(hints)
        page.hidden.append(off)
        page.silent.append(silent)
        page.linked.append(0)
        page.links.append(0)
        return len(page.tags) - 1

    def close(depth: int) -> None:
        nonlocal run
        opened.cut(stack[depth][2])
        del stack[depth:]
        run = None
        settle()

    def close_nearest(tags: tuple, until: frozenset) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return close(depth)
            if stack[depth][0] in until:
                return None
        return None

    def broken_off(name: str) -> int:
        """The place of the open element, hidden or in a hidden one, that a start tag ends; -1 if it ends none."""
        first = opened.names[hidden]
        if head:
            return hidden if name == "body" or (name in BLOCKS and first not in CODE) else -1
        k = max(map(opened.last, FOREIGN))
        if k >= hidden and name in BREAKOUT and max(map(opened.last, INTEGRATION)) < k:
            return k
        k = opened.last("select")
        if k >= hidden and name in NOT_IN_SELECT:
            return k
        if name == "button" and (k := opened.last(name)) >= hidden:
            return k
        if name in ITEMS and first != "template" and max(map(opened.last, SCOPES)) < hidden:
            kinds = ITEMS[name]
            return hidden if any(s[0] in kinds for s in stack[_floor(stack) :]) else -1
        return -1

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and hidden < 0:
            text(source[at:lt])
        if lt == n:
            break
        m = TOKEN.match(source, lt)
        if not m:
            if hidden < 0 and lt + 1 < n:
                text("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if not name or not m[4]:  # a comment, a declaration, or a tag cut off
            continue
        name = name.lower()
        if m[1]:
            place = opened.last(name)
            if hidden >= 0:
                if place >= hidden:
                    opened.cut(place)
                    hidden = -1 if place == hidden else hidden
                    continue
                # the end of an open parent ends it too
                if not (any(s[0] == name for s in stack[1:]) if name in BLOCKS else place >= stack[-1][2] or (head and name == "head")):
                    continue
                opened.cut(hidden)
                hidden = -1
            if place >= stack[-1][2]:
                opened.cut(place)
            settle()
            if name == "a":
                link = 0
            elif name == "head":
                head = False
            elif name in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
            continue
        attributes = m[3]
        empty = name in VOID or (attributes.endswith("/") and name not in BLOCKS)
        foreign = False
        if hidden >= 0:
            place = broken_off(name)
            if place >= 0:
                selects = name == opened.names[place] == "select"
                opened.cut(place)
                hidden = -1 if place == hidden else hidden
                if selects:
                    continue
            foreign = hidden >= 0 and max(map(opened.last, FOREIGN)) >= hidden
        if name in RAW and not (foreign and empty):
            end = None
            if name not in endless:
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.IGNORECASE).search(source, at)
                if not end:
                    endless.add(name)
            if end and not (foreign and FOREIGN_END.search(source, at, end.start() + 1)):
                at = end.end()
                continue
        if hidden >= 0:
            if not empty:
                opened.push(name)
            continue
        if name not in METADATA:
            head = False
        hints, off, silent = _attributes(attributes) if attributes else ((), False, False)
        if name in HIDDEN or name in RAW or (off and name not in BLOCKS and name not in ("html", "body")):
            if not empty:
                hidden = len(opened.names)
                opened.push(name)
            continue
        if not empty and name not in BLOCKS:
            opened.push(name)
            if "-" in name:
                hints = (*hints, *(h for h in _hints(name.split("-")) if h not in hints))
            if hints or "-" in name:
                node = add(name, hints, False, silent)
                inline.append((len(opened.names) - 1, node))
        if name == "a":
            link = 1
            page.links[node] += 1
        elif name == "br":
            if run is not None:
                text(" ")
        elif name in ("html", "body") and name in page.tags[:2]:
            continue
        elif name in BLOCKS:
            link = 0
            if name in NO_PARAGRAPH:
                close_nearest(("p",), SCOPES | {"td", "th", "li", "div"})
            if name in ITEMS:
                kinds = ITEMS[name]
                while len(stack) > 1 and stack[-1][0] not in SCOPES and any(s[0] in kinds for s in stack[_floor(stack) :]):
                    close_nearest(kinds, SCOPES)
            run = None
            if name == "hr":
                continue
            node = add(name, hints, off, silent)
            stack.append((name, node, len(opened.names)))
    return page


def _floor(stack: list[tuple[str, int, int]]) -> int:
    """The place above the innermost list, table or body."""
    for depth in range(len(stack) - 1, -1, -1):
        if stack[depth][0] in SCOPES:
            return depth + 1
    return 0


def _line(pieces: list[str]) -> str:
    """References decoded, white space as one space, trimmed."""
    raw = "".join(pieces)
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def blocks(page: Page) -> list[tuple[int, str]]:
    """(block, text) of each run."""
    return [(block, line) for block, pieces, _ in page.runs if (line := _line(pieces))]


def owned(page: Page) -> list[tuple[int, str]]:
    """(node, text) of each part of a run that one node holds."""
    out = []
    for block, pieces, nodes in page.runs:
        if all(k == block for k in nodes):
            out.append((block, _line(pieces)))
        else:
            out += [(node, _line([p for p, k in zip(pieces, nodes) if k == node])) for node in dict.fromkeys(nodes)]
    return [(node, text) for node, text in out if text]


class Forest:
    """The nodes of many pages as arrays: parent (-1 for roots), depth, features, edge kinds."""

    def __init__(self, pages: list[Page], runs: list[list[tuple[int, str]]]) -> None:
        self.first = np.cumsum([0, *(len(p.tags) for p in pages)])
        n = int(self.first[-1])
        self.parent, self.depth, self.kind = np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
        x = self.x = np.zeros((n, FEATURES), np.float64)
        hint_at, size_at = OTHER + 1, OTHER + 3 + len(HINTS)
        chars, stops = np.zeros(n), np.zeros(n)
        for base, page, lines in zip(self.first.tolist(), pages, runs):
            for k, tag in enumerate(page.tags):
                i, p = base + k, page.parents[k]
                kind = KIND_OF.get(tag, OTHER)
                self.kind[i] = kind
                x[i, kind] = 1
                if p >= 0:
                    self.parent[i], self.depth[i] = base + p, self.depth[base + p] + 1
                for h in page.hints[k]:
                    x[i, hint_at + h] = 1
                if page.hidden[k]:
                    x[i, hint_at + len(HINTS)] = 1
                if page.silent[k]:
                    x[i, hint_at + len(HINTS) + 1] = 1
            for k, line in lines:
                chars[base + k] += len(line)
                stops[base + k] += sum(map(line.count, ".!?。"))
            linked = np.array(page.linked, float)
            own = chars[base : base + len(page.tags)]
            share = np.divide(linked, np.maximum(own, 1))
            x[base : base + len(page.tags), size_at + 6 :][:, :4] = np.stack([(own > 0) & (share > 0.9), (share > 0.3) & (share <= 0.9), (own > 0) & (share <= 0.3), own == 0], 1)
        size = np.digitize(chars, [1, 20, 60, 150, 400])
        x[np.arange(n), size_at + size] = 1
        rate = stops / np.maximum(chars, 1)
        x[:, size_at + 10 :][:, :3] = np.stack([(chars > 0) & (stops == 0), (stops > 0) & (rate < 0.05), rate >= 0.05], 1)
        x[:, -1] = 1
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if n else [order]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


class TreeModel:
    """``unary``: weights of the features for the state content. ``pair[kind]``: log-potentials [parent, child]."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node marginals [n, 2], edge marginals [n, 2, 2] by child, log partition), by two passes of messages."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = forest.x @ self.unary
        up, message = own.copy(), np.zeros((n, 2))
        for nodes in reversed(forest.levels[1:]):
            message[nodes] = _lse(up[nodes][:, None, :] + self.pair[forest.kind[nodes]], 2)
            np.add.at(up, forest.parent[nodes], message[nodes])
        down, belief, edges = np.zeros((n, 2)), up.copy(), np.zeros((n, 2, 2))
        for nodes in forest.levels[1:]:
            parents = forest.parent[nodes]
            outside = (belief[parents] - message[nodes])[:, :, None] + self.pair[forest.kind[nodes]]
            down[nodes] = _lse(outside, 1)
            belief[nodes] = up[nodes] + down[nodes]
            joint = outside + up[nodes][:, None, :]
            edges[nodes] = np.exp(joint - _lse(joint.reshape(-1, 4), 1)[:, None, None])
        log_z = _lse(belief, 1)
        return np.exp(belief - log_z[:, None]), edges, log_z[forest.levels[0]] if n else log_z


def train(pages: list[tuple[Page, list[int]]], rounds: int = 200, rate: float = 0.15, decay: float = 2e-3) -> TreeModel:
    """Gradient ascent (with Adam's steps) on the log-likelihood of the labels of all nodes."""
    parsed = [p for p, _ in pages]
    forest = Forest(parsed, [owned(p) for p in parsed])
    labels = np.array([v for _, own in pages for v in own])
    edge = np.flatnonzero(forest.parent >= 0)
    kinds = OTHER + 1
    seen_pair = np.zeros((kinds, 2, 2))
    np.add.at(seen_pair, (forest.kind[edge], labels[forest.parent[edge]], labels[edge]), 1)
    weights, mean, square = np.zeros(FEATURES + kinds * 4), 0.0, 0.0
    for step in range(1, rounds + 1):
        model = TreeModel(weights[:FEATURES], weights[FEATURES:].reshape(kinds, 2, 2))
        nodes, edges, _ = model.marginals(forest)
        expected = np.zeros_like(seen_pair)
        np.add.at(expected, forest.kind[edge], edges[edge])
        gradient = np.concatenate([forest.x.T @ (labels - nodes[:, 1]), (seen_pair - expected).ravel()]) / len(pages) - decay * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return TreeModel(weights[:FEATURES], weights[FEATURES:].reshape(kinds, 2, 2))


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Made pages with the lines of their main text. Layouts, wrappers, names and lengths vary;
    boilerplate stands before, after, beside and inside the article, with and without telling names."""
    draw, marks, more = random.Random(seed), random.Random(seed + 1), random.Random(seed + 2)
    syllables = "an er in on re th the ti en al ou le é ö ch st und de la ción que ment pre no".split()

    def words(low: int, high: int) -> str:
        out = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        for k in range(0, len(out), 9):
            out[k] = out[k].capitalize()
            if k:
                out[k - 1] += draw.choice([".", ".", "?", "!", ","])
        return " ".join(out) + draw.choice([".", ".", ".", "", "!"])

    def named(names: str, chance: float = 0.85) -> str:
        if draw.random() > chance:
            return ""
        name = draw.choice(names.split())
        return draw.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-box"', f" class='{name} c{draw.randint(1, 9)}'"])

    def silent(chance: float) -> str:
        return ' aria-hidden="true"' if marks.random() < chance else ""

    def beside(line: str) -> str:
        """A line with something inline: an advert or a note that is not of the text, or a part of the text with a name."""
        said = " ".join("".join(more.choice(syllables) for _ in range(more.randint(1, 4))) for _ in range(more.randint(1, 12)))
        kind, chance = more.choice(["advert", "advert", "social", "notice", "comments", "side"]), more.random()
        name = more.choice(HINTS[kind].split())
        if chance < 0.05:
            tag = more.choice(["span", "a", "ins", "small", f"{name}-{more.choice(['slot', 'unit', 'x'])}"])
            return f"{line} <{tag}{'' if '-' in tag else f' class={name}'}>{said}</{tag}>"
        if chance < 0.1:
            some = line.split(" ")
            k = more.randrange(len(some))
            name = more.choice([*HINTS["content"].split(), "x-term"])
            some[k] = f"<x-term>{some[k]}</x-term>" if name == "x-term" else f'<span class="{name}">{some[k]}</span>'
            return " ".join(some)
        return line

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{k}">{words(1, 2)}</a>' for k in range(draw.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if draw.random() < 0.7 else " | ".join(items)

    def boilerplate() -> str:
        kind = draw.choice(["nav", "menu", "header", "footer", "side", "ad", "notice", "form", "comments", "share", "related"])
        if kind == "nav":
            return f"<nav{named('nav menu breadcrumb', 0.4)}{silent(0.05)}>{links(3, 9)}</nav>"
        if kind == "menu":
            return f"<div{named(HINTS['navigation'])}>{links(3, 9)}</div>"
        if kind == "header":
            return f"<header{named('site-header masthead', 0.5)}><div>{words(1, 4)}</div><p>{words(2, 10)}</p></header>"
        if kind == "footer":
            return draw.choice([f"<footer>&copy; {words(1, 3)} &middot; {words(3, 15)}</footer>", f"<footer><p>{words(3, 25)}</p>{links(2, 5)}</footer>", f"<div{named('footer copyright legal', 1)}>{words(4, 20)}</div>"])
        if kind == "side":
            return draw.choice([f"<aside{named(HINTS['side'], 0.6)}><h3>{words(1, 3)}</h3><p>{words(5, 40)}</p>{links(0, 5)}</aside>", f"<div{named('sidebar side widget rail', 1)}><h3>{words(1, 3)}</h3><p>{words(5, 40)}</p></div>"])
        if kind == "ad":
            return draw.choice([f"<div{named(HINTS['advert'], 1)}>{words(3, 25)}</div>", f"<section{named(HINTS['advert'], 1)}><p>{words(3, 25)}</p></section>", f"<aside{named(HINTS['advert'], 0.8)}>{words(3, 20)}</aside>"])
        if kind == "notice":
            return f"<{(t := draw.choice(['div', 'section', 'div', 'p']))}{named(HINTS['notice'], 1)}>{words(4, 30)}</{t}>"
        if kind == "form":
            return f"<form{named(HINTS['form'], 0.5)} action='/s'><label>{words(1, 4)}</label><input name=q><button>{words(1, 1)}</button><p>{words(2, 12)}</p></form>"
        if kind == "comments":
            each = "".join(f"<{(t := draw.choice(['div', 'li', 'article']))}{named('comment reply', 0.7)}><p>{words(4, 60)}</p></{t}>" for _ in range(draw.randint(1, 4)))
            return f"<{(t := draw.choice(['section', 'div', 'ol']))}{named('comments commentlist discussion responses', 1)}><h2>{words(1, 2)}</h2>{each}</{t}>"
        if kind == "share":
            return f"<div{named(HINTS['social'], 1)}>{words(1, 4)} {links(1, 4)}</div>"
        return f"<section{named('related recommended more popular', 1)}><h3>{words(1, 3)}</h3>{links(2, 6)}</section>"

    out = []
    for _ in range(n):
        content: list[str] = []

        def keep(low: int, high: int, content: list = content) -> str:
            content.append(line := words(low, high))
            told = beside(line)
            return f"<b>{told}</b>" if draw.random() < 0.1 else told

        parts = [f"<h1>{keep(2, 12)}</h1>"] if draw.random() < 0.8 else []
        if parts and more.random() < 0.3:  # an article's own header holds its title
            parts = [f"<header>{more.choice(['', '<div class=byline>al en de</div>'])}{parts[0]}</header>"]
        for _ in range(draw.randint(1, 12)):
            chance = draw.random()
            if chance < 0.72:
                shape = draw.random()
                line = keep(1, draw.choice([3, 12, 40, 150, 400]))
                parts.append(f"<p{silent(0.03)}>{line}</p>" if shape < 0.8 else f"<p><b>{line}<br>" if shape < 0.92 else f"<div>{line}</div>")
            elif chance < 0.8:
                parts.append(f"<h{(k := draw.randint(2, 4))}>{keep(1, 8)}</h{k}>")
            elif chance < 0.86:
                parts.append("<ul>" + "".join(f"<li>{keep(1, 25)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>")
            elif chance < 0.9:
                parts.append(f"<blockquote><p>{keep(3, 50)}</p></blockquote>")
            elif chance < 0.93:
                rows = "".join(f"<tr><td>{keep(1, 4)}</td><td>{keep(1, 4)}</td></tr>" for _ in range(draw.randint(1, 3)))
                parts.append(f"<table>{rows}</table>")
            elif chance < 0.95:
                parts.append(f"<p>{keep(5, 40)}</p>")
            else:
                parts.append(boilerplate())
        inner = "".join(parts)
        tag = draw.choice(["article"] * 5 + ["main", "div", "div", "section"])
        body = f"<{tag}{named(HINTS['content'], 0.4 if tag in ('article', 'main') else 0.95)}>{inner}</{tag}>"
        for _ in range(draw.choice([0, 0, 1, 2])):
            body = f"<{(t := draw.choice(['div', 'main', 'section', 'div']))}{named(HINTS['content'] + ' wrapper container', 0.6)}>{body}{boilerplate() if draw.random() < 0.3 else ''}</{t}>"
        before = "".join(boilerplate() for _ in range(draw.randint(0, 4)))
        after = "".join(boilerplate() for _ in range(draw.randint(0, 4)))
        page = f'<!DOCTYPE html><html lang="x"><head><title>{words(2, 8)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{before}{body}{after}'
        out.append((page + "</body></html>" * (draw.random() < 0.9), content))
    return out


def label(page: Page, lines: list[str]) -> list[int]:
    """A node is content if a run of its own, or of one below it, is one of the lines and most of its text is. Where a run
    is a line only without what inline nodes hold, these are not."""
    n = len(page.tags)
    good, all_ = [0] * n, [0] * n
    wanted = set(lines)
    for block, pieces, nodes in page.runs:
        whole = _line(pieces) in wanted
        bare = not whole and _line([p for p, k in zip(pieces, nodes) if k == block]) in wanted
        for node, piece in zip(nodes, pieces):
            size = len(piece.strip())
            all_[node] += size
            good[node] += size * (whole or (bare and node == block))
    for k in range(n - 1, 0, -1):
        good[page.parents[k]] += good[k]
        all_[page.parents[k]] += all_[k]
    return [int(g > 0 and 2 * g >= a) for g, a in zip(good, all_)]


@functools.lru_cache(maxsize=1)
def default_model(pages: int = 400, seed: int = 7) -> TreeModel:
    """Trained here and now, the same each time; bound of the labelled pages: ``pages``."""
    parsed = [(parse(source), lines) for source, lines in labelled_pages(pages, seed)]
    return train([(p, label(p, lines)) for p, lines in parsed])


def main_texts(sources: list[str | None], model: TreeModel) -> list[str]:
    """The main text of each page; messages run over all pages at once."""
    pages = [parse(s or "") for s in sources]
    forest = Forest(pages, [owned(p) for p in pages])
    content = model.marginals(forest)[0][:, 1] > 0.5
    out = []
    for base, page in zip(forest.first.tolist(), pages):
        shown = [bool(c) for c in content[base : base + len(page.tags)]]
        off = list(page.hidden)
        for k in range(1, len(off)):
            off[k] = off[k] or off[page.parents[k]]
        lines = [_line([p for p, k in zip(pieces, nodes) if shown[k] and not off[k]]) for _, pieces, nodes in page.runs]
        out.append("\n".join(filter(None, lines)))
    return out


def extract(
    pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) for each row; no shuffle. Other columns are not read."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = main_texts(batch.column(2).to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string, n_chars long")
