"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable: part of the article or not. A unary potential
comes from what is seen of the element (tag, words in class, id and role, amount
of text, link density, place), a pairwise one from each parent and child.
Sum-product messages up and down the tree give exact marginals; text whose
nearest element is more likely article than not makes up the blocks. The weights
are trained by exact likelihood on labelled pages from a seeded generator.

Defined cases: null or empty html has empty text; tags may be unclosed, wrongly
nested or cut off; a ``<`` that opens no tag is text; ``br`` and table cells count
as white space; scripts, styles, templates, ``head``, comments, embedded objects and
selections are never text (self-closed ones hold nothing, unclosed ones end with their
parent, or at the next block if they hold none); an unclosed comment, script or style takes the
rest of the page, as in browsers, an unclosed ``head`` what is before ``body``; time is linear in the page's length whatever it holds;
repeated rows give repeated results; null ids and urls are kept; other input
columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import _text as T

_EMPTY, _COMMENT = re.compile("-?>"), re.compile("--!?>")  # what closes a comment at its start, and anywhere
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

# Element names by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style head".split())
_UNSEEN = frozenset("template noscript svg iframe object textarea select".split())
_FLAT = frozenset("svg iframe textarea select".split())  # these hold no blocks
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_CLOSES_P = _BLOCK - {"tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_SCOPE = frozenset("table td th button caption html body".split())
_SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "tbody": ("tbody thead tr td th", {"table"})}

# Words in class, id and role attributes that tell something of an element.
_WORDS = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topnav menubar tabs pagination pager toc skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar aside side widget widgets rail related recommended more popular trending complementary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola",
    "note": "cookie cookies consent gdpr notice alert warning popup modal overlay toast announcement dialog",
    "form": "form search login signup subscribe newsletter register",
    "talk": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "share": "share sharing social follow tags meta byline author date",
    "main": "article content main post entry story body text articlebody prose single page",
}
_MEANS = {w: k for k, ws in _WORDS.items() for w in ws.split()}


class Page:
    """Elements in page order (parents first), and the pieces of text with their nearest element."""

    __slots__ = ("tags", "attrs", "parent", "pieces", "own", "link")

    def __init__(self) -> None:
        self.tags, self.attrs, self.parent = ["html"], [""], [-1]
        self.own, self.link = [0], [0]
        self.pieces: list[tuple[int, str]] = []  # element, text; a break has an empty text


class _Open:
    """The stack of open elements, with the places of each name, so that closing costs what it closes."""

    def __init__(self, page: Page):
        self.page, self.stack, self.links = page, [0], 0
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def top(self, names) -> int:
        """The innermost open element among names, the root aside; 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def push(self, name: str, attrs: str) -> None:
        page, k = self.page, len(self.stack)
        page.tags.append(name), page.attrs.append(attrs), page.parent.append(self.stack[-1]), page.own.append(0), page.link.append(0)
        self.stack.append(len(page.tags) - 1)
        self.places.setdefault(name, []).append(k)
        if name in _BLOCK:
            self.blocks.append(k)
        if name in _SCOPE:
            self.scopes.append(k)
        self.links += name == "a"

    def close(self, k: int) -> None:
        """Closes the k-th open element and all inside it."""
        for i in self.stack[k:]:
            name = self.page.tags[i]
            self.places[name].pop()
            self.links -= name == "a"
        del self.stack[k:]
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= k:
                places.pop()


def parse(source: str) -> Page:
    page = Page()
    opened = _Open(page)
    stack, own, link, pieces = opened.stack, page.own, page.link, page.pieces
    at, n = 0, len(source)
    broken: set[int] = set()  # quotes after which no tag ends
    unclosed: set[str] = set()  # names without any end tag further on
    unseen, flat = 0, False  # depth at which an unclosed embedded element was opened (0: none), and whether it holds no blocks

    def text(a: int, b: int) -> None:
        if a >= b or unseen:
            return
        t = source[a:b]
        pieces.append((stack[-1], t))
        size = len(t.strip())
        own[stack[-1]] += size
        if opened.links:
            link[stack[-1]] += size

    def tag_end(p: int) -> int:
        """Where a tag whose attributes begin at p ends: at the first ``>`` outside quotes, or if quotes don't match the first of all; -1 without any."""
        first, quotes = p, []
        while (m := _STOP.search(source, p)) is not None:
            k = m.start()
            if source[k] == ">":
                return k
            quotes.append(k)
            p = -1 if k in broken else source.find(source[k], k + 1) + 1
            if p <= 0:
                break
        broken.update(quotes)
        return source.find(">", first)

    def end_tag(name: str) -> int:
        """Where the next end tag of this name ends; -1 without any."""
        if name in unclosed:
            return -1
        m = re.compile(f"</{name}\\b[^>]*>", re.I).search(source, at)
        if m is None:
            unclosed.add(name)
        return m.end() if m else -1

    done = 0  # what is before is text or tags already seen
    while (lt := source.find("<", at)) >= 0:
        head = source[lt + 1 : lt + 2]
        if head in ("!", "?"):
            if source.startswith("!--", lt + 1):
                m = _EMPTY.match(source, lt + 4) or _COMMENT.search(source, lt + 4)
                end = m.end() - 1 if m else n
            else:
                end = source.find(">", lt)
            name = None
        else:
            m = _NAME.match(source, lt + 1)
            if m is None:
                at = lt + 1
                continue
            name, end = m.group().lower(), tag_end(m.end())
        if end < 0:
            break  # no tag ends any more
        text(done, lt)
        at = done = end + 1
        if name is None:
            continue
        if name[0] == "/":
            name = name[1:]
            k, block = opened.top((name,)), name in _BLOCK
            if block:
                pieces.append((stack[-1], ""))
            if k and (block or name == "a" or not opened.blocks or k > opened.blocks[-1]):
                opened.close(k)
                unseen = unseen if len(stack) >= unseen else 0
            if block:
                pieces.append((stack[-1], ""))
            continue
        attrs = source[m.end() : end]
        if name in _RAW:
            at = end_tag(name)
            if at < 0 and name == "head":
                body = re.compile("<body\\b", re.I).search(source, done)
                at = body.start() if body else n
            at = done = n if at < 0 else at
            continue
        if name in _UNSEEN:
            if not attrs.endswith("/"):
                past = end_tag(name)
                if past >= 0:
                    at = done = past
                elif not unseen:
                    unseen, flat = len(stack), name in _FLAT
            continue
        if name == "br" or name in ("td", "th"):
            pieces.append((stack[-1], " "))
        if name in _VOID:
            if name == "hr":
                pieces.append((stack[-1], ""))
            continue
        if name in _CLOSES_P:
            if flat:
                unseen, flat = 0, False
            k = opened.top(("p",))
            if k and (not opened.scopes or k > opened.scopes[-1]):
                opened.close(k)
        if name in _SIBLINGS:
            shut, inside = _SIBLINGS[name]
            while (k := opened.top(shut.split())) > opened.top(inside):
                opened.close(k)
                if name != "tr":
                    break
        if unseen and len(stack) < unseen:
            unseen = 0
        if name in ("html", "body") and (name == "html" or opened.places.get(name)):
            continue
        if name in _BLOCK:
            pieces.append((stack[-1], ""))
        opened.push(name, attrs)
        if name in _BLOCK:
            pieces.append((stack[-1], ""))
    text(done, n)
    return page


_meanings: dict[str, tuple[str, ...]] = {}


def _means(attrs: str) -> tuple[str, ...]:
    """Kinds of words in an element's class, id, role and itemprop."""
    if "=" not in attrs:
        return ()
    known = _meanings.get(attrs)
    if known is None:
        if len(_meanings) > 50_000:
            _meanings.clear()
        words = {p.lower() for m in _ATTR.finditer(attrs) for p in _PART.findall(m[1] or m[2] or m[3] or "")}
        known = _meanings[attrs] = tuple(sorted({_MEANS[w] for w in words if w in _MEANS}))
    return known


def observe(page: Page) -> list[tuple]:
    """What is seen of every element: the key of its unary potential."""
    n = len(page.tags)
    size, link = page.own[:], page.link[:]
    parent = page.parent
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        link[parent[i]] += link[i]
    total = max(1, size[0])
    out, seen, depth, inside = [], 0, [0] * n, [()] * n
    bare = "body" not in page.tags  # then the root stands for it
    for i in range(n):
        p = parent[i]
        means = _means(page.attrs[i])
        if i:
            depth[i] = depth[p] + 1
            inside[i] = means or inside[p]
        s = size[i]
        bucket = 0 if s == 0 else 1 if s < 25 else 2 if s < 80 else 3 if s < 300 else 4
        density = 0 if s == 0 else 1 + min(3, 4 * link[i] // s)
        share = 3 * size[i] // total if size[i] * 3 >= total else 0
        held = page.own[i] and (1 if page.own[i] < 25 else 2 if page.own[i] < 80 else 3)
        tag, depth[i] = ("body", 1) if bare and not i else (page.tags[i], depth[i])
        above = "html" if bare and not i else page.tags[p] if i else ""
        out.append((tag, means, bucket, density, min(depth[i], 6), 4 * seen // total, min(share, 2), "body" if above == "html" and bare and i else above, held, inside[p] if i else ()))
        seen += page.own[i]
    return out


def _features(key: tuple) -> list[str]:
    tag, means, bucket, density, depth, place, share, above, held, inside = key
    return ["bias", f"t:{tag}", f"s:{bucket}", f"l:{density}", f"d:{depth}", f"p:{min(place, 3)}", f"w:{share}", f"u:{above}", f"sl:{bucket}{density}", f"ts:{tag}:{bucket}", f"tu:{tag}:{above}", f"n:{len(means) > 0}", f"o:{held}", *(f"in:{k}" for k in inside or ("none",)), *(f"it:{k}:{tag}" for k in inside or ("none",)), f"up:{above}:{tag}:{bucket < 2}", f"ot:{held}:{tag}", f"ow:{held}:{share}", f"op:{held}:{'plain' if not means else 'named'}:{tag in ('div', 'section', 'body', 'html', 'article')}", *(f"m:{m}" for m in means), *(f"m:{m}:{tag in ('div', 'section')}" for m in means)]


class Model:
    """Log potentials: of features for label 1, and of (parent, child) labels."""

    def __init__(self, weights: dict[str, float] | None = None, pair: list[list[float]] | None = None):
        self.weights = weights or {}
        self.pair = pair or [[0.5, -0.5], [-0.5, 0.5]]
        self.known: dict[tuple, float] = {}

    def unary(self, key: tuple) -> float:
        v = self.known.get(key)
        if v is None:
            if len(self.known) > 200_000:
                self.known.clear()
            v = self.known[key] = math.exp(max(-40.0, min(40.0, sum(self.weights.get(f, 0.0) for f in _features(key)))))
        return v


def marginals(parent: list[int], odds: list[float], pair: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on a tree: odds of label 1 for each node from everything, from below, and each node's message to its parent."""
    (p00, p01), (p10, p11) = ([math.exp(x) for x in row] for row in pair)
    n = len(parent)
    below, up = odds[:], [1.0] * n
    for i in range(n - 1, 0, -1):
        o = min(max(below[i], 1e-80), 1e80)
        m = up[i] = (p11 * o + p10) / (p01 * o + p00)
        below[parent[i]] = min(max(below[parent[i]] * m, 1e-80), 1e80)
    full = below[:]
    for i in range(1, n):
        o = min(max(full[parent[i]] / up[i], 1e-80), 1e80)  # the parent without this child
        full[i] = min(max(below[i] * (p11 * o + p01) / (p10 * o + p00), 1e-80), 1e80)
    return full, below, up


def extract(source: str, model: Model) -> str:
    """The page's article: blocks joined by an empty line."""
    if not source:
        return ""
    page = parse(source)
    full, _, _ = marginals(page.parent, [model.unary(k) for k in observe(page)], model.pair)
    blocks, run = [], []
    for element, text in [*page.pieces, (0, "")]:
        if not text:
            if run:
                block = _SPACE.sub(" ", htmllib.unescape("".join(run))).strip()
                if block:
                    blocks.append(block)
                run = []
        elif full[element] >= 1:
            run.append(text)
    return "\n\n".join(blocks)


# ---- labelled pages and training ----


def labelled_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and, for every element that ``parse`` makes, whether it belongs to the article."""
    words = lambda a, b: " ".join(r.choice("an the eau un und re tionth ver la os ção лес orly heit ment que ing".split()) + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(a, b)))
    out: list[str] = []
    labels = [0]

    def el(tag: str, label: int, body, attr: str = "", close: bool = True) -> None:
        labels.append(label)
        out.append(f"<{tag}{' ' + attr if attr else ''}>")
        body() if callable(body) else out.append(body)
        if close:
            out.append(f"</{tag}>")

    def named(kind: str) -> str:
        return r.choice((f'class="{r.choice(_WORDS[kind].split())}"', f'id="{r.choice(_WORDS[kind].split())}"', f'class="{r.choice(_WORDS[kind].split())}-{r.choice(("box", "wrap", "area", "1"))} x{r.randint(1, 9)}"'))

    def linklist() -> None:
        if r.random() < 0.6:
            el(r.choice(("ul", "ol")), 0, lambda: [el("li", 0, lambda: el("a", 0, words(1, 4), f'href="/{i}"'), close=r.random() < 0.8) for i in range(r.randint(2, 8))] and None)
        else:
            for i in range(r.randint(2, 7)):
                el("a", 0, words(1, 3), f'href="/{i}"')
                out.append(r.choice((" | ", " ", " · ")))

    def sentence() -> None:
        el("p", 0, words(3, 30))

    def furniture(kind: str) -> None:
        tag = {"nav": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "note": ("div", "section", "aside"), "form": ("form", "form", "div"), "talk": ("section", "div", "ol"), "share": ("div", "ul")}[kind]
        tag = r.choice(tag)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        attr = named(kind) if not plain or r.random() < 0.5 else ""
        if kind == "nav" or kind == "share":
            el(tag, 0, linklist if tag != "ul" else lambda: [el("li", 0, lambda: el("a", 0, words(1, 3), 'href="/"')) for _ in range(4)] and None, attr)
        elif kind == "head":
            el(tag, 0, lambda: (el(r.choice(("h1", "div", "p", "span")), 0, words(1, 5)), linklist() if r.random() < 0.5 else None), attr)
        elif kind == "foot":
            el(tag, 0, lambda: r.choice((sentence, linklist, lambda: out.append("&copy; " + words(3, 30)), lambda: (sentence(), linklist())))(), attr)
        elif kind == "side":
            el(tag, 0, lambda: (el("h3", 0, words(1, 4)), r.choice((linklist, sentence, linklist))()), attr)
        elif kind in ("ad", "note"):
            el(tag, 0, r.choice((lambda: out.append(words(3, 35)), sentence, lambda: (sentence(), el("button", 0, words(1, 2))), lambda: el("a", 0, words(2, 9), 'href="/x"'))), attr)
        elif kind == "form":
            el(tag, 0, lambda: (el(r.choice(("label", "p", "h3")), 0, words(1, 9)), out.append('<input type="text">'), el("button", 0, words(1, 2))), attr)
        else:
            def talk() -> None:
                el(r.choice(("h2", "h3")), 0, words(1, 3))
                for _ in range(r.randint(1, 6)):
                    el("li" if tag == "ol" else r.choice(("div", "article", "li")), 0, lambda: (el(r.choice(("b", "span", "cite")), 0, words(1, 2)), el("p", 0, words(4, 60))), r.choice(("", 'class="comment"', 'class="reply"')))
            el(tag, 0, talk, attr)

    def article() -> None:
        if r.random() < 0.85:
            if r.random() < 0.3:
                el("header", 1, lambda: (el("h1", 1, words(2, 12)), furniture("share") if r.random() < 0.3 else None))
            else:
                el(r.choice(("h1", "h1", "h2")), 1, words(2, 12))
        if r.random() < 0.12:  # bare text in the container itself
            for _ in range(r.randint(1, 6)):
                out.append(words(4, 60) + r.choice(("<br><br>", "<br>", " ")))
                if r.random() < 0.2:
                    furniture(r.choice(("ad", "share", "note")))
            return
        most = r.choice((90, 90, 30, 3))  # some articles have only short paragraphs, and many
        for _ in range(1 if r.random() < 0.2 else r.randint(1, 14 if most > 3 else 50)):
            x = r.random()
            if x < (0.72 if most > 3 else 0.9):
                def para() -> None:
                    out.append(words(1, most))
                    if r.random() < 0.3:
                        el(r.choice(("b", "i", "em", "strong", "span", "code")), 1, words(1, 6), close=r.random() < 0.8)
                        out.append(r.choice(("<br>", " ")) + words(2, 20))
                    if r.random() < 0.2:
                        el("a", 1, words(1, 3), 'href="http://x"')
                        out.append(" " + words(3, 20))
                el("p", 1, para, close=r.random() < 0.8)
            elif x < 0.78:
                el(r.choice(("h2", "h3")), 1, words(1, 6))
            elif x < 0.84:
                el(r.choice(("ul", "ol")), 1, lambda: [el("li", 1, words(2, 18)) for _ in range(r.randint(2, 6))] and None)
            elif x < 0.88:
                el("blockquote", 1, lambda: el("p", 1, words(5, 40)))
            elif x < 0.91:
                el("pre", 1, words(3, 20))
            elif x < 0.94:
                el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(1, 4)) for _ in range(3)] and None) for _ in range(r.randint(1, 4))] and None)
            elif x < 0.96:
                el("figure", 1, lambda: el("figcaption", 1, words(3, 10)))
            else:
                furniture(r.choice(("ad", "share", "form", "side", "note")))
        for kind in ("talk", "share", "form"):
            if r.random() < 0.12:
                furniture(kind)

    def body() -> None:
        if r.random() < 0.06:  # nothing but an article
            inner = r.choice((article, lambda: out.append(words(5, 80)), lambda: el("p", 1, words(5, 80))))
            if r.random() < 0.6:
                el(r.choice(("div", "article", "main", "section")), 1, inner)
            else:
                labels[1] = 1  # the body is the article
                inner()
            return
        for kind in ("note", "head", "nav", "ad", "side"):
            if r.random() < {"note": 0.25, "head": 0.45, "nav": 0.7, "ad": 0.45, "side": 0.3}[kind]:
                furniture(kind)

        def main() -> None:
            x = r.random()
            if x < 0.45:
                el("article", 1, article, named("main") if r.random() < 0.3 else "")
            elif x < 0.6:
                el("main", 1, article)
            elif x < 0.85:
                el(r.choice(("div", "section")), 1, article, named("main"))
            elif x < 0.95:
                el("div", 1, article)
            else:
                article()
            for kind in ("talk", "side", "ad", "share", "form"):
                if r.random() < 0.25:
                    furniture(kind)

        if r.random() < 0.35:
            el(r.choice(("div", "main")), 0, main, r.choice(("", 'class="wrap"', 'id="container"')))
        else:
            main()
        for kind in ("form", "nav", "foot"):
            if r.random() < {"form": 0.15, "nav": 0.15, "foot": 0.8}[kind]:
                furniture(kind)

    el("body", 0, body)
    return f'<!DOCTYPE html><html lang="en"><head><title>{words(1, 4)}</title></head>{"".join(out)}</html>', labels


def train(pages: int = 1600, rounds: int = 6, seed: int = 3) -> Model:
    """Stochastic gradient on the log likelihood of labelled trees; expectations from the messages are exact."""
    r = random.Random(seed)
    data = []
    while len(data) < pages:
        source, labels = labelled_page(r)
        page = parse(source)
        if len(page.tags) == len(labels):  # a page whose unclosed tags make other elements is no example
            data.append((page.parent, [(_features(k), y) for k, y in zip(observe(page), labels, strict=True)]))
    w: dict[str, float] = {}
    pair = [[0.5, -0.5], [-0.5, 0.5]]
    for turn in range(rounds):
        r.shuffle(data)
        rate = 0.15 / (1 + turn)
        for parent, nodes in data:
            odds = [math.exp(max(-30.0, min(30.0, sum(w.get(f, 0.0) for f in fs)))) for fs, _ in nodes]
            full, below, up = marginals(parent, odds, pair)
            for (fs, y), o in zip(nodes, full, strict=True):
                g = rate * (y - o / (1 + o))
                if abs(g) > 1e-5:
                    for f in fs:
                        w[f] = w.get(f, 0.0) * (1 - 1e-5) + g
            step = [[0.0, 0.0], [0.0, 0.0]]
            e = [[math.exp(x) for x in row] for row in pair]
            for i in range(1, len(parent)):
                o, b = full[parent[i]] / up[i], below[i]
                both = [[e[0][0], e[0][1] * b], [e[1][0] * o, e[1][1] * o * b]]
                z = sum(map(sum, both))
                yp, yc = nodes[parent[i]][1], nodes[i][1]
                for a in (0, 1):
                    for c in (0, 1):
                        step[a][c] += (a == yp and c == yc) - both[a][c] / z
            for a in (0, 1):
                for c in (0, 1):
                    pair[a][c] = max(-6.0, min(6.0, pair[a][c] + rate * 0.05 * step[a][c]))
    return Model(w, pair)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or train()
    weights, pair = model.weights, model.pair
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, pair)
        for piece in T.slices(batches, "html"):
            texts = [extract(h or "", own) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
