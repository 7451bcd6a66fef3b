"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page is read into a tree: elements that make blocks, and leaves that are the runs of text in them. Every node is content or
not. A node's potential is log-linear in its tag, the words of its class, id and role (its own and those above it), and figures of the text
under it (length, links, sentence ends, position); a parent-child potential of two by two values belongs to each kind of child. Messages go
up the tree and down again (sum-product), which gives each node's marginal; leaves at 1/2 and above are the text.

Both kinds of potential are learned together by the gradient of the likelihood, observed less expected counts, where the expectations are
the marginals themselves. Labelled pages are of two kinds: `layouts` (pages of common layouts, marked leaf by leaf), and at most
`most_pages` different pages of the table with one article or main element, where the markup itself tells (`weak_labels`), of at most `most_chars` each.

Edge cases: null html is an empty page; a page without content gives the empty text; a tag that is never closed ends with what is around
it, or with the page; damaged UTF-8 reads as replacement characters; repeated rows and null ids are rows like others; with no
page in the table that can be learned from, the layouts alone teach.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import with_computed

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|hidden|style)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|ad(?![a-z])")
#: text in these is never the page's
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_SKIP = frozenset("template svg math object video audio canvas select button datalist option optgroup".split())
_BLOCK = frozenset(
    """address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu
    nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag ends the open element of these names, unless one of the second kind is in between
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: kinds of a child, each with its own parent-child potential
_KIND = {
    **dict.fromkeys(_HEADING, 1), **dict.fromkeys("nav aside footer form header".split(), 2), **dict.fromkeys("ul ol dl table tbody thead tfoot menu dir".split(), 3),
    **dict.fromkeys("li dt dd tr td th".split(), 4), **dict.fromkeys("p pre blockquote".split(), 5), **dict.fromkeys("article main".split(), 6),
}
_KINDS = 9  # the above, 0 a leaf, 7 any other element, 8 a leaf of a heading


@dataclass
class Page:
    """Nodes in page order, parents first; `text` is None for elements."""

    parent: list[int]
    tag: list[str]
    words: list[tuple[str, ...]]
    text: list[str | None]
    links: list[int]


def _attributes(raw: str) -> tuple[str, ...]:
    out: list[str] = []
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append("hidden")
        elif name != "style":
            out += [w.lower() for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(out))


def parse(source: str) -> Page:
    page = Page([-1], ["body"], [()], [None], [0])
    stack, inline = [0], []  # open blocks; open inline elements with the number of blocks around them
    run: list[str] = []
    linked, skipped = 0, 0
    around: list[str] = []

    def flush() -> None:
        nonlocal linked
        if run:
            words = entities.unescape("".join(run)).split()
            if words and not skipped:
                page.parent.append(stack[-1])
                page.tag.append("")
                page.words.append(tuple(dict.fromkeys(around)))
                page.text.append(" ".join(words))
                page.links.append(linked)
            run.clear()
        linked = 0
        around[:] = [w for *_, own in inline for w in own]

    def pop(at: int) -> None:
        """Close the block at a place of the stack, and all in it."""
        nonlocal skipped
        flush()
        for k in stack[at:]:
            skipped -= page.tag[k] in _SKIP
        del stack[at:]
        inline[:] = [i for i in inline if i[1] <= len(stack)]
        around[:] = [w for *_, own in inline for w in own]

    def nearest(names, stop=()) -> int:
        for at in range(len(stack) - 1, 0, -1):
            if page.tag[stack[at]] in names:
                return at
            if page.tag[stack[at]] in stop:
                break
        return 0

    at, size = 0, len(source)

    def take(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if any(i[0] == "a" for i in inline):
                linked += len(text)

    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            take(source[at:])
            break
        take(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK or name in _SKIP or "-" in name:
                k = nearest((name,) if name not in _HEADING else _HEADING)
                if k:
                    pop(k)
                elif name == "p":
                    flush()
            elif name == "br":
                take(" ")
            else:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        del inline[k]
                        break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
        elif name in _BLOCK or name in _SKIP or "-" in name:
            flush()
            if name in _BLOCK and (k := nearest(("p",), ("td", "th", "table", "button"))):
                pop(k)
            if name in _ENDS and (k := nearest(*_ENDS[name])):
                pop(k)
            elif name in _HEADING and page.tag[stack[-1]] in _HEADING:
                pop(len(stack) - 1)
            page.parent.append(stack[-1])
            page.tag.append(name)
            page.words.append(_attributes(m[3]) if m[3] else ())
            page.text.append(None)
            page.links.append(0)
            stack.append(len(page.tag) - 1)
            skipped += name in _SKIP
        elif name == "br":
            take(" ")
        elif name == "hr":
            flush()
        elif name in ("html", "head", "body"):
            flush()
        elif name not in ("img", "input", "meta", "link", "base", "wbr", "source", "track", "area", "col", "embed", "param"):
            if name == "a":
                inline[:] = [i for i in inline if i[0] != "a"]
            own = _attributes(m[3]) if m[3] else ()
            inline.append((name, len(stack), own))
            around.extend(own)
    flush()
    return page


def _size(n: int) -> int:
    return min(14, n.bit_length())


def _share(part: int, whole: int) -> int:
    return 0 if not part else min(4, 1 + 4 * part // max(whole, 1))


def features(page: Page) -> list[list[str]]:
    n = len(page.tag)
    chars, links, ends, leaves = [0] * n, [0] * n, [0] * n, [0] * n
    start, seen = [0] * n, 0
    for i, text in enumerate(page.text):
        start[i] = seen
        if text is not None:
            seen += len(text)
            chars[i], links[i], leaves[i] = len(text), min(page.links[i], len(text)), 1
            ends[i] = text.count(". ") + text.count("? ") + text.count("! ") + (text[-1] in ".!?…")
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        ends[p] += ends[i]
        leaves[p] += leaves[i]
    out: list[list[str]] = []
    above: list[tuple[str, ...]] = []
    order = [i for i, t in enumerate(page.text) if t is not None]
    spot = {i: k for k, i in enumerate(order)}
    for i in range(n):
        p = page.parent[i]
        up = above[p] if p >= 0 else ()
        own = [f"w:{w}" for w in page.words[i]]
        f = ["all", *up]
        place = 10 * start[i] // max(1, seen)
        if page.text[i] is None:
            mine = [f"^{page.tag[i]}", *[f"^{w}" for w in own]]
            above.append(tuple(dict.fromkeys([*up, *mine])))
            f += [f"t:{page.tag[i]}", *own, f"s:{_size(chars[i])}", f"sl:{_share(links[i], chars[i])}", f"se:{_size(ends[i])}", f"sn:{_size(leaves[i])}", f"sw:{_share(chars[i], seen)}"]
        else:
            above.append(())
            text, tag = page.text[i], page.tag[p]
            k = spot[i]
            near = [chars[order[k + d]] if 0 <= k + d < len(order) else 0 for d in (-1, 1)]
            words = text.count(" ") + 1
            f += [f"p:{tag}", *[f"i{w}" for w in own], f"c:{_size(len(text))}", f"n:{_size(words)}", f"l:{_share(links[i], chars[i])}", f"e:{min(3, ends[i])}", f"at:{place}", f"b:{_size(near[0]) // 2}", f"a:{_size(near[1]) // 2}"]
            f += [f"pn:{tag}:{_size(words)}", f"mark:{int('©' in text or '|' in text or '»' in text)}"]
        out.append(f)
    return out


def kinds(page: Page) -> list[int]:
    return [(8 if page.tag[p] in _HEADING else 0) if text is not None else _KIND.get(tag, 7) for tag, text, p in zip(page.tag, page.text, page.parent, strict=True)]


@dataclass
class Forest:
    """Trees side by side as arrays, nodes by depth; `back` gives the node's place before."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[slice]
    back: np.ndarray


def forest(pages: list[Page]) -> Forest:
    parent, kind, depth = [], [], []
    for page in pages:
        base = len(parent)
        own = [0] * len(page.parent)
        for i, p in enumerate(page.parent):
            own[i] = own[p] + 1 if p >= 0 else 0
            parent.append(base + p if p >= 0 else -1)
        depth += own
        kind += kinds(page)
    deep = np.array(depth, np.int64)
    back = np.argsort(deep, kind="stable")
    place = np.empty(len(back), np.int64)
    place[back] = np.arange(len(back))
    up = np.array(parent, np.int64)[back]
    up = np.where(up >= 0, place[up], -1)
    cuts = np.searchsorted(deep[back], np.arange(deep.max() + 2)) if len(deep) else np.zeros(1, int)
    return Forest(up, np.array(kind, np.int64)[back], [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], back)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(f: Forest, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (N, 2) of the nodes and (N, 2, 2) of their edges to the parent (parent's value first; zero for roots), from log potentials."""
    b = unary.astype(np.float64).copy()
    sent = np.zeros_like(b)
    for level in reversed(f.levels[1:]):
        sent[level] = _log_sum(b[level][:, None, :] + edges[f.kind[level]], 2)
        np.add.at(b, f.parent[level], sent[level])
    joint = np.zeros((len(b), 2, 2))
    whole = b.copy()
    for level in f.levels[1:]:
        rest = whole[f.parent[level]] - sent[level]
        both = rest[:, :, None] + edges[f.kind[level]] + b[level][:, None, :]
        flat = both.reshape(len(both), 4)
        joint[level] = np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(-1, 2, 2)
        whole[level] = b[level] + _log_sum(rest[:, :, None] + edges[f.kind[level]], 1)
    return np.exp(whole - _log_sum(whole, 1)[:, None]), joint


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    edges: np.ndarray

    def unary(self, rows: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.weight
        known = [[k for x in f if (k := get(x)) is not None] for f in rows]
        count = np.array([len(k) for k in known], np.int64)
        flat = np.fromiter((x for k in known for x in k), np.int64, int(count.sum()))
        out = np.zeros((len(rows), 2))
        out[:, 1] = np.bincount(np.repeat(np.arange(len(rows)), count), weights=w[flat], minlength=len(rows))
        return out

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content for every node of every page."""
        f = forest(pages)
        unary = self.unary([x for p in pages for x in features(p)])
        if not len(unary):
            return []
        found = np.empty(len(unary))
        found[f.back] = sum_product(f, unary[f.back], self.edges)[0][:, 1]
        return np.split(found, np.cumsum([len(p.tag) for p in pages])[:-1])


def train(pages: list[Page], labels: list[list[int]], rounds: int = 200, rate: float = 1.0, decay: float = 5e-5, rare: int = 2) -> Model:
    """labels: 1 for each leaf that is content; an element is content if anything in it is."""
    rows, y = [], []
    for page, own in zip(pages, labels, strict=True):
        own = list(own)
        for i in range(len(own) - 1, 0, -1):
            own[page.parent[i]] = max(own[page.parent[i]], own[i])
        y += own
        rows += features(page)
    count: dict[str, int] = {}
    for f in rows:
        for x in f:
            count[x] = count.get(x, 0) + 1
    index = {x: k for k, x in enumerate(sorted(x for x, n in count.items() if n >= rare))}
    model = Model(index, np.zeros(len(index)), np.zeros((_KINDS, 2, 2)))
    f = forest(pages)
    known = [[index[x] for x in r if x in index] for r in rows]
    node = np.repeat(np.arange(len(rows)), [len(k) for k in known])
    flat = np.array([x for k in known for x in k], np.int64)
    truth = np.array(y)[f.back]
    child = f.parent >= 0
    seen = np.zeros_like(model.edges)
    np.add.at(seen, (f.kind[child], truth[f.parent[child]], truth[child]), 1)
    target = np.array(y, float)
    square, edge_square = np.full(len(index), 1e-6), np.full(model.edges.shape, 1e-6)
    size = len(pages)
    for _ in range(rounds):
        unary = np.zeros((len(rows), 2))
        unary[:, 1] = np.bincount(node, weights=model.weight[flat], minlength=len(rows))
        single, joint = sum_product(f, unary[f.back], model.edges)
        p = np.empty(len(rows))
        p[f.back] = single[:, 1]
        grad = np.bincount(flat, weights=(target - p)[node], minlength=len(index)) / size - decay * model.weight
        expected = np.zeros_like(model.edges)
        np.add.at(expected, f.kind[child], joint[child])
        edge_grad = (seen - expected) / size - decay * model.edges
        square += grad * grad
        edge_square += edge_grad * edge_grad
        model.weight += rate * grad / np.sqrt(square)
        model.edges += rate * edge_grad / np.sqrt(edge_square)
    return model


#: marks a leaf of a labelled layout as content
MARK = chr(0xE000)
#: words that class, id and role give to the parts of pages (fixed values)
_NAMES = {
    "menu": "nav navigation navbar menu mainmenu topnav menubar sitenav toc links",
    "header": "header masthead topbar banner site-header branding logo",
    "footer": "footer site-footer bottom copyright colophon legal",
    "side": "sidebar aside side widget widget-area rail secondary column-right complementary related recommended popular trending more-stories promo teaser",
    "notice": "notice cookie cookies cookie-banner consent gdpr alert message warning announcement notification popup modal overlay disclaimer paywall",
    "ad": "ad ads advert advertisement ad-slot adsense sponsored sponsor promotion promoted dfp banner-ad",
    "form": "form search searchform newsletter subscribe signup login register contact-form",
    "share": "share sharing social social-links follow tools print buttons breadcrumb breadcrumbs pagination pager tags tag-list",
    "comments": "comments comment comment-list commentlist respond reply replies discussion disqus thread responses user-comments reader-comments",
    "main": "content main article post entry entry-content post-content article-body story text body page-content main-content hentry prose",
}
_SOUNDS = ["a", "e", "i", "o", "u", "an", "er", "th", "st", "ion", "le", "re", "que", "sch", "ção", "ñ", "ля", "но", "по", "της", "の", "は", "中", "国", "ه", "ال"]


def layouts(n: int = 1800, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled pages: common layouts with invented words. Content leaves begin with MARK (an html page each)."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(_SOUNDS) for _ in range(rng.randrange(1, 4)))

    def some(low, high):
        return " ".join(word() for _ in range(rng.randrange(low, high)))

    def prose(low=8, high=90):
        return some(low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", ""]) + (" " + some(4, 20).capitalize() + "." if rng.random() < 0.5 else "")

    def named(part, bare=0.0):
        if rng.random() < bare:
            return ""
        names = _NAMES[part].split()
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(names, rng.choice([1, 1, 2])))}"'

    def link():
        return f'<a href="/{word()}">{some(1, 5)}</a>'

    def links():
        k = rng.randrange(2, 9)
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
        return rng.choice([" ", " | ", " &middot; "]).join(link() for _ in range(k))

    def box(tags, part, inner, bare=0.0):
        tag = rng.choice(tags)
        return f"<{tag}{named(part, bare if tag != 'div' else 0)}>{inner}</{tag}>"

    def menu():
        return box(["nav", "nav", "div", "ul"], "menu", links(), 0.6)

    def header():
        return box(["header", "div"], "header", rng.choice([f"<h1>{link()}</h1>", f"<p>{some(1, 8)}</p>", link(), some(1, 6)]) + rng.choice(["", menu()]), 0.6)

    def footer():
        return box(["footer", "footer", "div"], "footer", rng.choice([f"&copy; {some(1, 5)} &middot; {prose(3, 20)}", f"<p>&copy; {some(2, 12)}</p>{links()}", links(), f"<p>{prose(5, 40)}</p>", prose(3, 20)]), 0.6)

    def side():
        return box(["aside", "div", "section"], "side", "".join(f"<h3>{some(1, 4)}</h3>{rng.choice([links(), f'<p>{prose(4, 40)}</p>', f'<p>{prose(4, 30)} {link()}</p>'])}" for _ in range(rng.randrange(1, 4))), 0.5)

    def notice():
        return box(["div", "div", "section", "p", "aside"], "notice", rng.choice([prose(5, 50), f"<p>{prose(5, 60)}</p>", f"{prose(5, 30)} {link()} <button>{some(1, 3)}</button>"]))

    def ad():
        return box(["div", "div", "aside", "section", "ins"], "ad", rng.choice([prose(3, 30), f"<p>{prose(4, 40)}</p>", link(), f"<h4>{some(2, 6)}</h4><p>{prose(4, 40)}</p>"]))

    def form():
        return f"<form{named('form', 0.5)}><label>{some(1, 4)}</label><input name=q><p>{prose(3, 25)}</p><button>{some(1, 2)}</button></form>"

    def share():
        return box(["div", "ul", "p", "footer"], "share", rng.choice([links(), f"{some(1, 3)}: {link()} {link()}"]))

    def comments():
        k = rng.randrange(1, 12)
        one = rng.choice(["<li{c}><b>{a}</b><p>{t}</p></li>", "<div{c}><span>{a}</span><p>{t}</p><p>{t2}</p></div>", "<article{c}><h4>{a}</h4><p>{t}</p></article>", "<p>{t}</p>", "<div{c}>{t}</div>"])
        inner = "".join(one.format(c=named("comments"), a=some(1, 3), t=prose(4, 70), t2=prose(4, 40)) for _ in range(k))
        return box(["section", "div", "ol" if one.startswith("<li") else "div", "aside"], "comments", rng.choice(["", *[f"<{h}>{some(1, 4)}</{h}>" for h in ("h2", "h2", "h3", "h4")]]) + inner + rng.choice(["", form()]))

    def paragraph():
        text = prose(1, 90) if rng.random() < 0.85 else prose(90, 400)
        if rng.random() < 0.3:
            text = f"{some(1, 20)} {rng.choice(['<b>{}</b>', '<em>{}</em>', '<a href=/x>{}</a>', '<span>{}</span>', '<code>{}</code>']).format(some(1, 4))} {text}"
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}</b></p>"]).format(MARK + text)

    def body_part():
        r = rng.random()
        if r < 0.72:
            return paragraph()
        if r < 0.8:
            return f"<h2>{MARK}{some(1, 8)}</h2>" + paragraph()
        if r < 0.86:
            point = lambda: rng.choice([prose(2, 25), prose(2, 25), f"{some(1, 9)} <a href=/x>{some(1, 3)}</a>", f"{some(1, 3)} <a href=/x>{some(1, 3)}</a> {prose(1, 9)}"])
            return "<ul>" + "".join(f"<li>{MARK}{point()}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>"
        if r < 0.9:
            return f"<blockquote>{rng.choice(['{}', '<p>{}</p>']).format(MARK + prose())}</blockquote>"
        if r < 0.93:
            return "<table>" + "".join(f"<tr><td>{MARK}{some(1, 5)}</td><td>{MARK}{some(1, 5)}</td></tr>" for _ in range(rng.randrange(2, 5))) + "</table>"
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{MARK}{prose(3, 20)}</figcaption></figure>"
        return f"<pre>{MARK}{some(4, 40)}</pre>"

    def story():
        parts = [rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(MARK + some(2, 12))] if rng.random() < 0.85 else []
        parts += [body_part() for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.35:
            wrap = rng.choice(["<div{}>{}</div>", "<section{}>{}</section>"])
            parts = [parts[0], wrap.format(named("main", 0.3), "".join(parts[1:]))]
        for other, rate in ((ad, 0.3), (side, 0.2), (share, 0.2), (notice, 0.2), (form, 0.12)):
            if rng.random() < rate:
                parts.insert(rng.randrange(len(parts) + 1), other())
        if rng.random() < 0.4:
            parts.append(comments())
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section", "td", "td"])
        inner = "".join(parts)
        if tag == "td":
            return f"<table><tr><td{named(rng.choice(['side', 'menu']), 0.2)}>{rng.choice([links(), '<br>'.join(link() for _ in range(3))])}</td><td{named('main', 0.5)}>{inner}</td></tr></table>"
        return f"<{tag}{named('main', 0.6 if tag in ('article', 'main') else 0.25)}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        first = [f() for f, rate in ((header, 0.6), (menu, 0.8), (notice, 0.25), (ad, 0.5), (form, 0.15), (share, 0.2), (side, 0.15)) if rng.random() < rate]
        last = [f() for f, rate in ((comments, 0.3), (share, 0.2), (side, 0.4), (ad, 0.2), (form, 0.15), (notice, 0.12), (footer, 0.85)) if rng.random() < rate]
        rng.shuffle(first)
        if rng.random() < 0.2:
            rng.shuffle(last)
        middle = story() if rng.random() < 0.97 else ""
        whole = "".join(first) + middle + "".join(last)
        if rng.random() < 0.4:
            whole = f'<div id="{rng.choice(["page", "wrapper", "container", "root", "app"])}">{whole}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{some(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{whole}</body></html>")
    return out


def marked(page: Page) -> list[int]:
    """Labels of a layout; the marks are taken off."""
    own = [int(t is not None and MARK in t) for t in page.text]
    page.text = [t if t is None else t.replace(MARK, "") for t in page.text]
    return own


#: elements of an article that are not its text, and names that say so (fixed values)
_OTHER = frozenset("nav aside footer form".split())
_OTHER_NAMES = frozenset(w for part in ("menu", "side", "notice", "ad", "form", "share", "comments") for name in _NAMES[part].split() for w in name.split("-"))


def weak_labels(page: Page) -> list[int] | None:
    """Labels by the markup of a page with exactly one article or main (an article in a main counts); None for other pages."""
    for name in ("article", "main"):
        tops = [i for i, t in enumerate(page.tag) if t == name]
        if len(tops) == 1:
            inside = [False] * len(page.tag)
            for i, p in enumerate(page.parent):
                out = page.tag[i] in _OTHER or not _OTHER_NAMES.isdisjoint(page.words[i])
                inside[i] = i == tops[0] or p >= 0 and inside[p] and not out
            return [int(t is not None and inside[i]) for i, t in enumerate(page.text)]
    return None


def fit(pages: DataFrame, most_pages: int = 100, most_chars: int = 1 << 16, n_layouts: int = 1800) -> Model:
    """Learns from `n_layouts` layouts and at most `most_pages` pages, taken in the order of a hash of their html."""
    known = []
    for source in layouts(n_layouts):
        page = parse(source)
        known.append((page, marked(page)))
    html = F.col("html").cast("binary")
    some = pages.where(F.length("html").between(1, most_chars)).select(html.alias("h"), F.xxhash64(html).alias("o"))
    # hashes first, so that no task sends pages that aren't taken
    bound = some.select("o").distinct().orderBy("o").limit(most_pages).agg(F.max("o")).first()[0]
    taken = some.where(F.col("o") <= F.lit(bound)).groupBy("o").agg(F.first("h").alias("h"))
    for row in sorted(taken.collect(), key=lambda r: r.o) if bound is not None else []:
        page = parse(bytes(row.h).decode("utf-8", "replace"))
        own = weak_labels(page)
        if own is not None:
            known.append((page, own))
    return train([p for p, _ in known], [y for _, y in known])


def texts(model: Model, sources: list[str], at_once: int = 4 << 20) -> list[str]:
    """The main text of each page; pages of about `at_once` characters go through the model together."""
    out: list[str] = []
    first = 0
    while first < len(sources):
        last, size = first, 0
        while last < len(sources) and (last == first or size + len(sources[last]) <= at_once):
            size += len(sources[last])
            last += 1
        pages = [parse(s) for s in sources[first:last]]
        for page, p in zip(pages, model.marginals(pages), strict=True):
            out.append(" ".join(t for t, q in zip(page.text, p, strict=True) if t is not None and q >= 0.5))
        first = last
    return out


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """`keep` columns, then the main text and its length in code points."""

    def run(html: pa.Array) -> list[pa.Array]:
        found = texts(model, [(b or b"").decode("utf-8", "replace") for b in html.to_pylist()])
        return [pa.array([t.encode("utf-8", "replace").decode() for t in found], pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return with_computed(pages, list(keep), ["html"], run, [(names[0], "string"), (names[1], "bigint")])
