"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A tolerant reader turns a page into its leaf blocks: runs of text without a block boundary, with their
ancestors. Each block has features of its ancestors' tags and of the words in their class, id and role, of
its own text, of its neighbours, and of its container: how much running text that holds, where it stands to
the one that holds most, whether it is one of many alike, and whether the block is unlike the others in it.
The chain's labels are article or not; weights are trained by the exact gradient (forward-backward) on
labelled pages, and pages are decoded by Viterbi.

The labelled pages are made by `labelled_pages` from a seed: page furniture of many kinds around
articles of random words, each block marked as its template says. In many of them the class words say
nothing (random letters) or are missing, so that the other features must do. No text of a corpus is used.

Shown text counts: that of formulas and drawings (math, svg) too, not what stands in for objects, sound,
video and canvas, which browsers do not show.

Defined results: a null or empty page, or one without an article block, has an empty text; unclosed and
stray tags are read as browsers mostly do; repeated rows are read alike; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s>/]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s>/]*)(.*)", re.S)
MARK = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed values of the markup language: elements without content, with raw text, never shown, and in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {x: re.compile(rf"</{x}\b", re.I) for x in RAW}
HIDDEN = frozenset("head script style title template noscript iframe object select option button textarea noembed noframes canvas audio video datalist desc metadata annotation".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input nobr ruby rt rp math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mphantom menclose semantics svg text tspan g textpath".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav header footer form blockquote".split())
#: Words of class, id and role that say something about a block's part in the page.
HINTS = ("nav", "menu", "header", "masthead", "footer", "side", "aside", "ad", "ads", "advert", "promo", "sponsor", "cookie", "notice", "banner", "popup", "modal", "alert", "comment", "reply", "discuss", "share", "social", "related", "recommend", "form", "newsletter", "subscribe", "signup", "login", "search", "breadcrumb", "pag", "tag", "meta", "widget", "copyright", "article", "content", "post", "entry", "main", "body", "story", "text")


class Node:
    """An element on the path to a block. What a path says is a set that a child shares with its parent where it adds nothing."""

    __slots__ = ("parent", "name", "inside", "tail", "clear", "known", "shape", "kids", "sums", "shapes")

    def __init__(self, parent: Node | None, name: str, marks: tuple[str, ...], classed: bool):
        self.parent, self.name, self.known = parent, name, bool(marks)
        above = parent.inside if parent else frozenset()
        here = {f"in:{x}" for x in (name, *marks) if x in ANCESTORS or x[0] == "."}
        self.inside = above if here <= above else above | here
        self.tail = ((parent.tail if parent else ()) + (name, *marks))[-4:]
        #: Whether an article element is open with no page part within it.
        self.clear = name == "article" or bool(parent and parent.clear) and name not in PARTS
        self.shape = (name, marks, classed)
        #: How many elements of each shape it holds; running text and all text of its blocks; shapes of its blocks.
        self.kids: dict[tuple, int] = {}
        self.sums = [0, 0, 0]
        self.shapes: dict[tuple, int] = {}
        if parent:
            parent.kids[self.shape] = parent.kids.get(self.shape, 0) + 1

    @property
    def key(self) -> tuple:
        return self.inside, self.tail, self.name, self.clear, self.shape[2]

    def container(self) -> Node:
        """The nearest ancestor that is no list, table or text element."""
        n = self.parent or self
        while n.parent and n.name in WITHIN:
            n = n.parent
        return n


ANCESTORS = ("nav", "header", "footer", "aside", "form", "main", "article", "section", "div", "ul", "ol", "li", "table", "td", "th", "blockquote", "pre", "figure", "figcaption", "dl", "p", "h1", "h2", "h3", "h4", "address", "menu", "dialog", "details", "body", "fieldset")
PARTS = frozenset("nav aside footer form header".split())
WITHIN = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th blockquote figure figcaption pre p h1 h2 h3 h4 h5 h6".split())


def blocks(page: str) -> list[tuple[Node, str, int, int]]:
    """(element, text, characters within links, order): leaf blocks in page order."""
    out: list[tuple[Node, str, int, int]] = []
    root = Node(None, "#", (), False)
    stack: list[tuple[str, Node]] = []  # names, and the block element of each
    held: list[str] = []
    linked = links = 0
    hidden = 0
    at_node: Node | None = None
    skip_to = ""

    def flush() -> None:
        nonlocal at_node, linked
        text = " ".join("".join(held).split())
        if text:
            out.append((at_node or root, text, linked, len(out)))
        held.clear()
        at_node, linked = None, 0

    def pop(to: int) -> None:
        nonlocal hidden, links
        for name, _ in stack[to:]:
            hidden -= name in HIDDEN
            links -= name == "a"
        del stack[to:]

    def leave_head() -> None:
        """Text and elements of the body end a head that was not closed."""
        k = next((i for i, x in enumerate(stack) if x[0] == "head"), None)
        if k is not None and k == len(stack) - 1:
            pop(k)

    at = 0
    while at < len(page):
        if skip_to:
            m = RAW_END[skip_to].search(page, at)
            at, skip_to = (m.start() if m else len(page)), ""
            continue
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            if hidden and not token.isspace():
                leave_head()
            if not hidden:
                if at_node is None and not token.isspace():
                    at_node = stack[-1][1] if stack else root
                text = html.unescape(token) if "&" in token else token
                if links > 0:
                    linked += len(text.strip())
                held.append(text)
            continue
        t = TAG.match(token)
        if not t:
            continue
        name = t[2].lower().rstrip("/")
        if t[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is None:
                if name in ("p", "br") and name not in INLINE:
                    flush()
                continue
            if name not in INLINE or any(x[0] not in INLINE for x in stack[k:]):
                if name in INLINE:
                    continue  # a stray inline end across a block boundary
                if name not in HIDDEN:
                    flush()
            pop(k)
            continue
        if hidden and name not in IN_HEAD and name != "head":
            leave_head()
        if name not in INLINE and name not in HIDDEN:
            flush()
            #: An open paragraph, item or cell ends where the next begins; inline elements go with it.
            ends = ("p",) if name in CLOSES_P else ()
            ends += SAME.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if not ends:
                    break
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in SCOPE and name not in ("td", "th", "tr") or stack[i][0] == "table":
                    break
        if name in VOID or token.endswith("/>"):
            continue
        above = stack[-1][1] if stack else root
        if name in INLINE:
            node = above
        else:
            marks: tuple[str, ...] = ()
            said = ""
            if "=" in t[3]:
                said = " ".join(x[1] or x[2] or x[3] for x in MARK.findall(t[3])).lower()
                if said:
                    marks = tuple("." + h for h in HINTS if re.search(rf"(?<![a-z]){h}", said))
            node = Node(above, name, marks, bool(said))
        stack.append((name, node))
        hidden += name in HIDDEN
        links += name == "a"
        if name in RAW:
            skip_to = name
    flush()
    return out


@lru_cache(maxsize=100_000)
def path_features(key: tuple) -> tuple[str, ...]:
    inside, tail, name, clear, classed = key
    out = set(inside)
    out.add(f"leaf:{name}" if name in ANCESTORS else "leaf:other")
    out |= {f"near:{x}" for x in tail if x[0] == "."}
    if clear:
        out.add("article:clear")
    if not any(x.startswith("in:.") for x in inside):
        out.add("no hints")
    if classed and not any(x[0] == "." for x in tail):
        out.add("class says nothing")
    return tuple(sorted(out))


def text_features(text: str, linked: int, order: int) -> tuple[str, ...]:
    n = len(text)
    out = ["bias", f"size:{min(12, n.bit_length())}", f"links:{min(3, int(4 * linked / max(1, n)))}"]
    out.append(f"stops:{min(3, text.count('. ') + text.count(', ') + text.endswith('.'))}")
    if "©" in text[:40] or "copyright" in text[:40].lower():
        out.append("copyright")
    if order == 0:
        out.append("first")
    return tuple(out)


def _running(text: str, linked: int) -> int:
    """Characters of running text: outside links, in blocks of several words."""
    return len(text) - linked if text.count(" ") >= 3 else 0


def place_features(found: list[tuple[Node, str, int, int]]) -> list[tuple[str, ...]]:
    """What each block's container and neighbours say."""
    held = [b[0].container() for b in found]
    for c in held:
        c.sums, c.shapes = [0, 0, 0], {}
    for (node, text, linked, _), c in zip(found, held, strict=True):
        c.sums[0] += _running(text, linked)
        c.sums[1] += len(text)
        c.sums[2] += 1
        c.shapes[node.shape] = c.shapes.get(node.shape, 0) + 1
    total = sum({id(c): c.sums[0] for c in held}.values()) or 1
    best = max(held, key=lambda c: c.sums[0], default=None)
    first = next((i for i, c in enumerate(held) if c is best), 0)
    last = max((i for i, c in enumerate(held) if c is best), default=0)
    chains: dict[int, set[int]] = {}

    def chain(c: Node) -> set[int]:
        if id(c) not in chains:
            up, n = set(), c
            while n:
                up.add(id(n))
                n = n.parent
            chains[id(c)] = up
        return chains[id(c)]

    out = []
    for i, ((node, _, _, _), c) in enumerate(zip(found, held, strict=True)):
        if c is best:
            names = ["place:best"]
        elif id(best) in chain(c):
            names = ["place:within"]
        elif i < first:
            names = ["place:before"]
        elif i > last:
            names = ["place:after"]
        else:
            names = ["place:between"]
        names.append(f"share:{min(4, int(5 * c.sums[0] / total))}")
        if c.shapes[node.shape] * 4 < c.sums[2] and c.sums[2] > 3:
            names.append("unlike" + (" and classed" if node.shape[2] else ""))
        alike = max(c.parent.kids.get(c.shape, 1) if c.parent else 1, node.parent.kids.get(node.shape, 1) if node.parent and node.name not in WITHIN else 1)
        if alike >= 2 and c.sums[2] >= 1 and c is not best:
            names.append("one of many" if alike >= 3 else "one of two")
        for k, side in ((i - 1, "prev"), (i + 1, "next")):
            if 0 <= k < len(found):
                _, t, n, _ = found[k]
                names.append(f"{side}:{'same' if held[k] is c else 'other'}:{'links' if 2 * n > len(t) else 'long' if len(t) > 80 else 'short'}")
            else:
                names.append(f"{side}:none")
        out.append(tuple(names))
    return out


def features(found: list[tuple[Node, str, int, int]]) -> list[tuple[str, ...]]:
    return [path_features(b[0].key) + text_features(*b[1:]) + p for b, p in zip(found, place_features(found), strict=True)]


class Model:
    """State weights by feature (rows of 2), transitions and start, all log-linear."""

    def __init__(self, index: dict[str, int], state: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.state, self.move, self.start = index, state, move, start
        self.paths: dict[tuple, tuple[float, float]] = {}

    def __getstate__(self):
        return self.index, self.state, self.move, self.start

    def __setstate__(self, x):
        self.__init__(*x)

    def _sum(self, names: tuple[str, ...]) -> tuple[float, float]:
        at = [self.index[x] for x in names if x in self.index]
        return tuple(self.state[at].sum(0).tolist()) if at else (0.0, 0.0)

    def emissions(self, found: list[tuple[Node, str, int, int]]) -> list[tuple[float, float]]:
        out = []
        if len(self.paths) > 50_000:
            self.paths.clear()
        for (node, text, linked, order), place in zip(found, place_features(found), strict=True):
            e0 = e1 = 0.0
            for key in (node.key, text_features(text, linked, order), place):
                if (a := self.paths.get(key)) is None:
                    a = self.paths[key] = self._sum(path_features(key) if key and not isinstance(key[0], str) else key)
                e0, e1 = e0 + a[0], e1 + a[1]
            out.append((e0, e1))
        return out

    def labels(self, found: list[tuple[Node, str, int, int]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        e = self.emissions(found)
        if not e:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.start[0] + e[0][0], self.start[1] + e[0][1]
        back = []
        for a, b in e[1:]:
            f0, f1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            s0, s1 = (s1 + m10 if f0 else s0 + m00) + a, (s1 + m11 if f1 else s0 + m01) + b
            back.append((f0, f1))
        y = [int(s1 > s0)]
        for f in reversed(back):
            y.append(int(f[y[-1]]))
        return y[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b[1] for b, y in zip(found, self.labels(found), strict=True) if y)


def train(pages: list[tuple[list[tuple], list[int]]], rounds: int = 120, ridge: float = 5e-4) -> Model:
    """Maximum likelihood by full-batch Adam with a ridge; gradients are features minus their expectation."""
    feats = [features(found) for found, _ in pages]
    index = {x: i for i, x in enumerate(sorted({x for p in feats for b in p for x in b}))}
    n, t, k = len(pages), max(len(p) for p in feats), len(index)
    x = np.zeros((n, t, k))
    y, on = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (p, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
        on[i, : len(p)] = True
        y[i, : len(p)] = labels
        for j, b in enumerate(p):
            x[i, j, [index[f] for f in b]] = 1
    flat = x.reshape(n * t, k)
    state, move, start = np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)
    gold = np.eye(2)[y] * on[..., None]
    pair = on[:, 1:] & on[:, :-1]
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1] * pair[..., None], gold[:, 1:])
    total = on.sum()
    m = [np.zeros_like(w) for w in (state, move, start)]
    v = [np.zeros_like(w) for w in (state, move, start)]
    for r in range(1, rounds + 1):
        e = (flat @ state).reshape(n, t, 2)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + e[:, 0]
        for j in range(1, t):
            alpha[:, j] = np.logaddexp(alpha[:, j - 1, :1] + move[0], alpha[:, j - 1, 1:] + move[1]) + e[:, j]
        for j in range(t - 2, -1, -1):
            b = e[:, j + 1] + beta[:, j + 1]
            step = np.stack([np.logaddexp(move[q, 0] + b[:, 0], move[q, 1] + b[:, 1]) for q in (0, 1)], 1)
            beta[:, j] = np.where(on[:, j + 1 : j + 2], step, 0)
        z = np.logaddexp(*(alpha[:, 0] + beta[:, 0]).T)[:, None, None]
        p = np.exp(alpha + beta - z) * on[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None]) * pair[..., None, None]
        g = [flat.T @ (gold - p).reshape(n * t, 2), gold_move - joint.sum((0, 1)), (gold[:, 0] - p[:, 0]).sum(0)]
        for i, w in enumerate((state, move, start)):
            d = g[i] / total - ridge * w
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
            w += 0.1 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    return Model(index, state, move, start)


def labelled_pages(n: int = 480, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(page, article blocks) made from templates: the words are random letters, so only markup and form can be learned."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    letters = "etaoinshrdlucmfwypvbg"

    def word() -> str:
        return "".join(letters[min(20, int(rng.exponential(6)))] for _ in range(int(rng.integers(1, 11))))

    def words(a: int, b: int) -> str:
        style = rng.random()
        w = [word() for _ in range(int(rng.integers(a, b + 1)))]
        if style < 0.06:
            w = [x.upper() + "!!" for x in w]
        elif style < 0.12:
            w = [x + pick("###", "$$$", "%%%", "***") for x in w]
        return " ".join(w)

    def sentence(a: int = 4, b: int = 18) -> str:
        return words(a, b).capitalize() + pick(".", ".", ".", "?", ",", "")

    def prose() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 8))))

    def links(k: int, sep: str = "") -> str:
        tag = pick("li", "li", "span", "div")
        inner = sep.join(f"<{tag}><a href='/{word()}'>{words(1, 3)}</a></{tag}>" for _ in range(k))
        return f"<ul>{inner}</ul>" if tag == "li" else inner

    mute = 0.0  # how often, in the page at hand, a class word says nothing

    def named(markup: str) -> str:
        """The markup with some classes and ids replaced by random words or left out."""
        def new(m: re.Match) -> str:
            if not chance(mute):
                return m[0]
            return "" if chance(0.25) else f" {m[1]}='{word()}{pick('', '-' + word(), '_' + word())}'"

        return re.sub(r" (class|id)='[^']*'", new, markup)

    def furniture(kind: str) -> str:
        return named(_furniture(kind))

    def _furniture(kind: str) -> str:
        k = int(rng.integers(2, 9))
        if kind == "nav":
            return pick(f"<nav>{links(k)}</nav>", f"<div class='{pick('menu', 'navbar', 'main-nav', 'breadcrumbs')}'>{links(k)}</div>", f"<ul id='menu'>{links(k)}</ul>", f"<div role='navigation'>{links(k)}</div>")
        if kind == "header":
            return pick(f"<header><h1>{words(1, 4)}</h1><p>{sentence()}</p>{links(k)}</header>", f"<div id='header'><a href='/'>{words(1, 3)}</a><p>{sentence()}</p></div>", f"<div class='masthead'>{words(1, 6)}</div>")
        if kind == "footer":
            return pick(f"<footer>&copy; {word()}.example &middot; {prose()}</footer>", f"<footer><p>{sentence()}</p>{links(k)}</footer>", f"<div class='{pick('footer', 'site-footer', 'copyright')}'><p>{prose()}</p></div>", f"<footer>{prose()}</footer>")
        if kind == "aside":
            return pick(f"<aside><h3>{words(1, 4)}</h3>{links(k)}</aside>", f"<aside><p>{prose()}</p></aside>", f"<div class='{pick('sidebar', 'side-col', 'widget', 'related', 'recommended')}'><h4>{words(1, 3)}</h4><p>{sentence()}</p>{links(k)}</div>", f"<section class='related-posts'>{links(k)}</section>")
        if kind == "ad":
            return f"<div class='{pick('ad', 'ads', 'advert', 'advertisement', 'promo', 'sponsored', 'ad-box', 'banner')}'>{pick(sentence(), prose(), f'<p>{prose()}</p>', f'<a href=x>{sentence()}</a>')}</div>"
        if kind == "notice":
            return pick(f"<div class='{pick('cookie', 'cookie-notice', 'notice', 'consent-banner', 'alert', 'popup')}'><p>{prose()}</p><button>{word()}</button></div>", f"<div id='cookie-bar'>{prose()}</div>", f"<dialog>{sentence()}</dialog>")
        if kind == "form":
            return pick(f"<form><label>{words(1, 4)}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>", f"<div class='{pick('newsletter', 'subscribe', 'signup', 'search-box', 'login')}'><p>{sentence()}</p><form><input></form></div>")
        if kind == "comments":
            tag = pick("li", "div", "article", "p")
            each = "".join(f"<{tag} class='{pick('comment', 'comment-body', 'reply', 'c')}'><b>{word()}</b> <p>{prose()}</p></{tag}>" for _ in range(k))
            head = pick("", f"<h3>{words(1, 3)}</h3>")
            if chance(0.4):
                box = pick("item", "box", "c", word())
                each = "".join(f"<div class='{box}'><{pick('b', 'span', 'div')}>{words(1, 2)}</b></span></div><p>{prose()}</p></div>" if chance(0.5) else f"<div class='{box}'><div>{words(1, 3)}</div><div>{prose()}</div></div>" for _ in range(k))
            return pick(f"<div id='comments'>{head}{each}</div>", f"<section class='comments'>{head}{each}</section>", f"<ol class='commentlist'>{each}</ol>", f"<div class='discussion-comments'>{head}{each}</div>")
        if kind == "share":
            return f"<div class='{pick('share', 'social', 'tags', 'post-meta', 'pagination')}'>{links(k)}</div>"
        return pick(f"<script>var t='</p>';{word()}()</script>", f"<style>.{word()}{{margin:0}}</style>", f"<!-- {words(1, 5)} -->", f"<noscript>{sentence()}</noscript>")

    for _ in range(n):
        mute = pick(0.0, 0.0, 0.3, 1.0)
        tiny = chance(0.1)  # one or two short blocks and nothing else
        body: list[str] = []
        gold: list[str] = []

        def say(text: str, fmt: str, body: list[str] = body, gold: list[str] = gold) -> None:
            body.append(fmt.replace("{}", text.replace("&", "&amp;").replace("<", "&lt;")))
            gold.append(" ".join(text.split()))

        own = word()
        if chance(0.3 if tiny else 0.85):
            say(words(1, 12), pick("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<h1 class='title'>{}</h1>"))
        for _ in range(1 if tiny else int(rng.geometric(0.18))):
            q = 0.1 if tiny else rng.random()
            if q < 0.74:
                say(pick(prose(), prose(), sentence(1, 8), sentence(1, 3)), pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p class='text'>{}</p>", "<div>{}</div>", "<p><a href='/x'>{}</a></p>" if chance(0.15) else "<p>{}</p>", f"<p class='{own}'>{{}}</p>"))
            elif q < 0.82:
                say(words(1, 7), pick("<h2>{}</h2>", "<h3>{}</h3>"))
            elif q < 0.86:
                body.append("<ul>")
                for _ in range(int(rng.integers(1, 5))):
                    say(sentence(2, 12), "<li>{}</li>")
                body.append("</ul>")
            elif q < 0.88:
                say(prose(), pick("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"))
            elif q < 0.9:
                body.append("<table><tr>")
                for _ in range(int(rng.integers(1, 5))):
                    say(words(1, 4), "<td>{}</td>")
                body.append("</tr></table>")
            elif q < 0.97:
                body.append(furniture(pick("ad", "ad", "share", "form", "aside", "hidden")))
            else:
                body.append("<figure><img src=x><figcaption>")
                say(sentence(), "{}")
                body.append("</figcaption></figure>")
        wrap = pick(*["<article>{}</article>"] * 4, "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='main'>{}</div>", "<div class='post-body'>{}</div>", "<div class='entry-content'>{}</div>", "<div class='article-text'>{}</div>", "<section class='story'>{}</section>", "<div>{}</div>", "<div id='wrap'><div class='inner'>{}</div></div>", "{}")
        wrap = named(wrap) if chance(0.5) else wrap
        before = [furniture(pick("nav", "nav", "header", "ad", "notice", "form", "aside", "hidden")) for _ in range(0 if tiny else int(rng.integers(0, 5)))]
        after = [furniture(pick("footer", "footer", "comments", "aside", "share", "form", "ad", "notice", "nav", "hidden")) for _ in range(0 if tiny else int(rng.integers(0, 5)))]
        page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>" + "".join(before) + wrap.replace("{}", "".join(body)) + "".join(after) + pick("</body></html>", "", "</body>")
        yield page, gold


def marked(page: str, gold: list[str]) -> tuple[list[tuple], list[int]]:
    """A page's blocks with labels: the article's blocks in order are 1."""
    found, k, labels = blocks(page), 0, []
    for b in found:
        hit = k < len(gold) and b[1] == gold[k]
        labels.append(int(hit))
        k += hit
    return found, labels


@lru_cache(maxsize=1)
def trained(n: int = 480, seed: int = 7) -> Model:
    return train([x for x in (marked(p, [g for g in gold if g]) for p, gold in labelled_pages(n, seed)) if x[0] and len(x[0]) <= 60])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            texts = [shared.value.text(p) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
