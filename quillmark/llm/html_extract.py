"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the longest runs of text that no block-level tag interrupts. A block's features are its
ancestors' tags and the words of their class, id and role; features of its text (length, share of link text, punctuation,
digits, marks such as a copyright sign, its place on the page); and of its surroundings: how much text and what share of links
the three elements around it hold, and the marks of the heading it stands under. Two states, main and other, with first-order
transitions are decoded by Viterbi; the main blocks, joined by line feeds, are the text.

The field is trained by gradient ascent on the exact log-likelihood (forward-backward) over labelled pages. Labelled pages
can be given to `fit`; `labelled_pages` makes a fixed set of them from page layouts of many kinds with invented words, for
the tables hold none: semantic tags, named and nameless boxes, layout tables, bare bodies, text between line breaks.

Cases: null or empty html, and pages without text, give an empty text. Unclosed, crossed and stray tags are tolerated; an
unclosed template or noscript ends at its own tag. The content of script, style, template, noscript, title, textarea, select
and iframe, and comments, are no blocks. Blocks of head are never main text, nor those of a form, but where an article or main
element stands within the form. Formulas, drawings and fallback content are ordinary text of their block. Repeated rows each get
their result; null ids and urls are passed through; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Content that is never text (up to the end tag), void tags, and tags that don't end a block (fixed values of HTML).
OPAQUE = frozenset("script style template noscript textarea title select iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " object canvas audio video source track svg g defs desc text tspan path circle rect line use"
    " math semantics annotation mi mn mo mtext mspace ms mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
#: Tags that may stand in head (fixed values of HTML); any other one ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open p (fixed values of HTML).
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

BITS = 16


class Block(NamedTuple):
    """path: tags and names of the elements around the text, the outermost first; nodes: these elements' numbers on the page."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int
    nodes: tuple[int, ...] = ()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    nodes: list[int] = []
    parts: list[tuple[str, bool]] = []
    at, links, count = 0, 0, 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                out.append(Block(text, tuple(stack), sum(len(t.strip()) for t, link in parts if link), tuple(nodes)))
            parts = []

    def say(raw: str) -> None:
        if raw:
            parts.append((entities.unescape(raw) if "&" in raw else raw, links > 0))

    def close(k: int) -> None:
        del stack[k:], nodes[k:]

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    links = 0
                    break
            continue
        if tag in OPAQUE:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea") else at
            flush()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            flush()
            close(len(stack) - 1)
        if tag in INLINE:
            if tag == "a":
                links += 1
            elif tag == "br":
                say(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        names = " ".join(x[1].lower() + "=" + (x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(m[3])) if m[3] and "=" in m[3] else ("hidden" if "hidden" in m[3] else "")
        stack.append((tag, names))
        count += 1
        nodes.append(count)
        links = 0
    say(page[at:])
    flush()
    return out


@functools.lru_cache(20_000)
def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    out, near = {"bias"}, set()
    for tag, names in path:
        out.add(f"in:{tag}")
        own = set()
        for pair in re.findall(r"(\S+?)=([^=]*)(?=\s\S+?=|$)", names):
            found = {w.lower() for w in _NAME.findall(pair[1])}
            out.update(f"{'style' if pair[0] == 'style' else 'name'}:{w}" for w in found)
            own |= found if pair[0] != "style" else set()
        near = own or near
        if names.startswith("hidden") or "hidden" in names.split():
            out.add("hidden")
    if path:
        out.add(f"tag:{path[-1][0]}")
        out.add(f"pair:{path[-2][0] if len(path) > 1 else ''}>{path[-1][0]}")
    out.update(f"near:{w}" for w in near)  # the innermost names
    return tuple(sorted(out))


#: Parts of words that notices, footers, menus, adverts and readers' comments use.
MARKS = ("©", "copyright", "all rights reserved", "cookie", "subscribe", "newsletter", "sponsored", "advertisement", "sign in", "log in", "comment", "reply", "replies", "response", "readers", "related", "share", "privacy", "menu", "skip to")
#: Those of readers' comments, which count alike in a heading.
TALK = ("comment", "reply", "replies", "response", "readers")


def _text_features(b: Block, i: int, n: int) -> list[str]:
    t, size = b.text, len(b.text)
    low, last = t.lower(), t[-1]
    out = [f"len:{min(9, size.bit_length())}", f"words:{min(7, (t.count(' ') + 1).bit_length())}", f"link:{4 * b.linked // size}", f"place:{4 * i // n}"]
    out.append("end:stop" if last in ".!?…”»" else "end:alnum" if last.isalnum() else "end:other")
    out.append(f"comma:{min(3, t.count(','))}")
    out.append(f"digits:{min(3, 10 * sum(map(t.count, '0123456789')) // size)}")
    out += [f"mark:{m}" for m in MARKS if m in low]
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    return out


def _around(page: list[Block]) -> list[list[str]]:
    """By block: features of the elements around it and of the last heading in one of them."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in page:
        for n in b.nodes:
            size[n] = size.get(n, 0) + len(b.text)
            linked[n] = linked.get(n, 0) + b.linked
    out, under = [], {}
    for b in page:
        at = b.nodes[:-1] if b.path and b.path[-1][0] in HEADINGS else b.nodes
        f = []
        for k, n in enumerate(b.nodes[-1:-4:-1]):
            f += [f"up{k}:link:{4 * linked[n] // size[n]}", f"up{k}:size:{min(6, (size[n] // 20).bit_length())}"]
        for n in reversed(at):
            if n in under:
                f += [f"under:{m}" for m in under[n]] + ["under:talk"] * any(m in TALK for m in under[n])
                break
        if b.path and b.path[-1][0] in HEADINGS and at:
            low = b.text.lower()
            under[at[-1]] = [m for m in MARKS if m in low]
        out.append(f)
    return out


def _barred(path: tuple[tuple[str, str], ...]) -> bool:
    """Head's content, and a form's unless it is an article's or main's within the form."""
    for tag, _ in reversed(path):
        if tag in ("article", "main"):
            return False
        if tag in ("form", "head"):
            return True
    return False


def features(page: list[Block]) -> list[list[str]]:
    return [[*_path_features(b.path), *_text_features(b, i, len(page)), *f] for i, (b, f) in enumerate(zip(page, _around(page), strict=True))]


def _slot(name: str) -> int:
    h = 2166136261
    for ch in name.encode():
        h = (h ^ ch) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) & (1 << BITS) - 1


class Field:
    """w[feature slot, state] and the transitions [from, to]; state 1 is main text."""

    def __init__(self):
        self.w = np.zeros((1 << BITS, 2))
        self.between = np.zeros((2, 2))
        self._of_path: dict = {}
        self._of_name: dict = {}

    def _sum(self, names) -> tuple[float, float]:
        """The names' weights, each looked up in the array once."""
        a = b = 0.0
        for n in names:
            if (w := self._of_name.get(n)) is None:
                w = self._of_name[n] = tuple(self.w[_slot(n)].tolist())
            a += w[0]
            b += w[1]
        return a, b

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out = []
        for i, (b, around) in enumerate(zip(page, _around(page), strict=True)):
            if (x := self._of_path.get(b.path)) is None:
                if len(self._of_path) > 20_000:
                    self._of_path.clear()
                w = self._sum(_path_features(b.path))
                x = self._of_path[b.path] = (w[0], -1e9 if _barred(b.path) else w[1])
            y = self._sum(_text_features(b, i, len(page)) + around)
            out.append((x[0] + y[0], x[1] + y[1]))
        return out

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.2, l2: float = 1e-4) -> Field:
        """Gradient ascent page by page, with a step size of its own for each weight (Adagrad); the weights are the mean of
        those after each epoch of the later half."""
        mean, mean_t, half = np.zeros_like(self.w), np.zeros((2, 2)), epochs // 2
        rng, seen = random.Random(3), np.ones((1 << BITS, 2)) * 1e-3
        seen_t = np.ones((2, 2)) * 1e-3
        known: dict[str, int] = {}
        rows = []
        for page, y in pages:
            f = [[known[x] if x in known else known.setdefault(x, _slot(x)) for x in b] for b in features(page)]
            flat = np.concatenate([np.array(b) for b in f])
            used, at = np.unique(flat, return_inverse=True)
            rows.append((used, at, np.cumsum([0, *(len(b) for b in f[:-1])]), np.repeat(np.arange(len(f)), [len(b) for b in f]), np.array(y)))
        for epoch in range(epochs):
            rng.shuffle(rows)
            for used, at, first, block, y in rows:
                s = np.add.reduceat(self.w[used][at], first, axis=0)
                p, both = self._marginals(s)
                g = -p
                g[np.arange(len(y)), y] += 1
                grad = np.stack([np.bincount(at, weights=g[block, j], minlength=len(used)) for j in (0, 1)], 1) - l2 * self.w[used]
                seen[used] += grad**2
                self.w[used] += rate * grad / np.sqrt(seen[used])
                gt = -both
                np.add.at(gt, (y[:-1], y[1:]), 1)
                seen_t += gt**2
                self.between += rate * gt / np.sqrt(seen_t)
            if epoch >= half:
                mean += self.w / (epochs - half)
                mean_t += self.between / (epochs - half)
        self.w, self.between = mean, mean_t
        return self

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: each block's chances of the states, and the expected numbers of transitions."""
        t, n = np.exp(self.between), len(s)
        e = np.exp(s - s.max(1, keepdims=True)).tolist()
        (a, b), (c, d) = t.tolist()
        fwd, x = [], None
        for u, v in e:
            x = (u, v) if x is None else ((x[0] * a + x[1] * c) * u, (x[0] * b + x[1] * d) * v)
            z = x[0] + x[1]
            x = (x[0] / z, x[1] / z)
            fwd.append(x)
        bwd, x = [(1.0, 1.0)], (1.0, 1.0)
        for u, v in reversed(e[1:]):
            x = (a * u * x[0] + b * v * x[1], c * u * x[0] + d * v * x[1])
            z = x[0] + x[1]
            x = (x[0] / z, x[1] / z)
            bwd.append(x)
        f, r = np.array(fwd), np.array(bwd[::-1])
        p = f * r
        p /= p.sum(1, keepdims=True)
        if n < 2:
            return p, np.zeros((2, 2))
        pairs = f[:-1, :, None] * t[None] * (np.array(e)[1:] * r[1:])[:, None, :]
        return p, (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest states (Viterbi); a tie goes to main text."""
        s = self.scores(page)
        t = self.between.tolist()
        best, back = s[0], []
        for x in s[1:]:
            step, now = [], []
            for j in (0, 1):
                a, b = best[0] + t[0][j], best[1] + t[1][j]
                step.append(int(b >= a))
                now.append(max(a, b) + x[j])
            back.append(step)
            best = now
        state = int(best[1] >= best[0])
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        if not page or not (found := blocks(page)):
            return ""
        return "\n".join(b.text for b, y in zip(found, self.decode(found), strict=True) if y)


#: Names that pages give to boxes of each kind.
NAMES = {
    "menu": "menu nav navbar navigation site-nav topnav breadcrumb breadcrumbs pagination toolbar tabs links main-menu sitemap",
    "head": "header site-header masthead banner page-header topbar logo top branding hero-head",
    "foot": "footer site-footer bottom copyright legal colophon foot imprint site-info",
    "side": "sidebar side aside widget related related-posts rail recommended popular trending more-stories column-right teaser see-also",
    "note": "cookie cookie-banner notice consent gdpr alert popup modal newsletter subscribe overlay paywall disclaimer message infobar warning",
    "ad": "ads advert advertisement sponsored promo sponsor banner-ad promotion ad-slot ad adbox commercial",
    "talk": "comments comment comment-list discussion replies responses user-comment disqus user-notes reader-notes feedback guestbook reactions opinions thread reader-comments visitors forum reviews",
    "share": "share social share-buttons sharing follow social-links tools",
    "main": "content main-content post-body article-body entry-content story text article post entry body page copy prose column",
}


def labelled_pages(n: int = 3000, seed: int = 1) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their main blocks: layouts of many kinds, drawn at random, with invented words."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi wo xu an en in on un st tr ch ld ng é ü ñ ç ä".split()
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return " ".join(x + "," * chance(0.08) for x in words(a, b).split(" ")).capitalize() + pick(".....!?")

    def para(most: int = 5) -> str:
        return " ".join(sentence() for _ in range(pick((1, 1, 2, 3, most))))

    def links(tag: str = "ul", most: int = 8) -> str:
        item = "li" if tag in ("ul", "ol") else pick(("span", "div", "td"))
        return f"<{tag}>" + "".join(f'<{item}><a href="/x">{words(1, 3).title()}</a></{item}>' for _ in range(rng.randint(2, most))) + f"</{tag}>"

    def loose() -> str:
        return pick((" | ", " ", " &middot; ", "<br>")).join(f'<a href="/x">{words(1, 2).title()}</a>' for _ in range(rng.randint(2, 7)))

    def named(kind: str) -> str:
        return " " + pick(('class="{}"', 'id="{}"', 'class="{} x1"', "class='{}'", "class={}", 'class="site-{}"', 'id="{}-area"')).format(pick(NAMES[kind].split()))

    def heading(text: str) -> str:
        tag = pick(("h2", "h3", "h4", "strong", "b", "p"))
        return f"<{tag}>{text}</{tag}>" if tag in ("h2", "h3", "h4", "p") else f"<div><{tag}>{text}</{tag}></div>"

    def talk(titled: bool = False) -> str:
        said, form = rng.randint(1, 6), rng.random()
        title = pick(("Comments", f"{said} comments", "Replies", f"{said} replies", f"{said} responses", "Responses", "What readers say", "Leave a reply", "Readers write", *(() if titled else (words(1, 3), ""))))
        tag, who = pick(("p", "div", "li", "article", "blockquote")), pick(("<b>{}</b> ", "<div>{}</div>", "<span>{}</span>: ", "<cite>{}</cite><br>", "<a href='#'>{}</a> ", ""))
        one = lambda: f"<{tag}>" + who.format(words(1, 2).title() + pick(("", "", f", {rng.randint(1, 28)} May", f" {rng.randint(1, 12)}:{rng.randint(10, 59)}", " says"))) + pick(("{}", "<p>{}</p>"))[: None if tag != "p" else 2].format(para(2)) + f"</{tag}>"
        return (heading(title) if title else "") + "".join(one() for _ in range(said)) + (f"<form><textarea></textarea><button>{words(1, 1)}</button></form>" if form < 0.2 else "")

    def inside(kind: str) -> str:
        year, site = rng.randint(1999, 2026), f"{words(1, 1)}.example.com"
        if kind == "menu":
            return pick((links(), links(), links("div"), loose(), links("ol", 4)))
        if kind == "head":
            return pick((f"<a href='/'>{words(1, 3)}</a>", f"<h1>{words(1, 4)}</h1><p>{sentence(2, 8)}</p>", f"<div>{words(1, 3)}</div>{links()}", f"<div>{words(1, 4)}</div><form><input><button>{words(1, 1)}</button></form>"))
        if kind == "foot":
            return pick((f"&copy; {year} {site} &middot; {para(2)}", f"<p>&copy; {year} {words(1, 4)}. All rights reserved.</p>{links()}", f"<p>{para(2)}</p>{loose()}", f"Copyright {year} {words(1, 3)}", f"{loose()}<p>&copy; {words(1, 2)}</p>", para(2)))
        if kind == "side":
            return heading(words(1, 4)) + pick((links(), f"<p>{para(2)}</p>", f"<p><a href='/x'>{sentence()}</a></p>" * 2, f"{links()}<p>{sentence()}</p>"))
        if kind == "talk":
            return talk()
        if kind == "share":
            return pick((loose(), links(), f"Share: {loose()}"))
        if kind == "note":
            return pick((f"We use cookies. {sentence()} <button>{words(1, 1)}</button>", f"<p>{para(2)}</p><button>OK</button>", f"<p>{sentence()}</p><a href='/y'>{words(1, 3)}</a>", f"Subscribe to our newsletter. {sentence()}<form><input><button>{words(1, 1)}</button></form>", para(2)))
        return pick((para(2), f"<p>{para(2)}</p>", f"<p>{sentence()}</p><a href='/y'>{words(1, 3)}</a>", f"<a href='/y'>{sentence()}</a>", f"Advertisement {sentence()}"))

    semantic = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "talk": "section", "ad": "aside", "note": "dialog"}

    def box(kind: str, style: str) -> str:
        body = inside(kind)
        if style == "semantic" and kind in semantic and chance(0.75):
            tag = semantic[kind]
            return f"<{tag}{named(kind) * chance(0.5 if kind in ('menu', 'head', 'foot', 'side') else 1)}>{body}</{tag}>"
        if style in ("nameless", "breaks", "table") and kind in ("menu", "head", "foot", "side", "share"):
            while kind in ("foot", "side") and "<a" not in body and not any(m in body.lower() for m in ("&copy;", "copyright")):
                body = inside(kind)  # nothing else would tell a nameless box of prose from the text
            tag = pick(("div", "div", "p", "center", "td"))
            tag = tag if tag != "p" or "<" not in body.replace("<a", "").replace("</a", "").replace("<br", "") else "div"
            return f"<{tag}>{body}</{tag}>"
        tag = pick(("div", "div", "div", "section", "ul" if body.startswith("<li") else "div"))
        if kind == "talk" and chance(0.35):  # told by its heading alone
            return f"<{tag}>{talk(True)}</{tag}>"
        return f"<{tag}{named(kind)}>{body}</{tag}>"

    pages = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str, main=main) -> str:
            main.append(text)
            return text

        def marked(t: str) -> str:
            """A paragraph with a word of it in inline tags."""
            w = t.split(" ")
            i = rng.randrange(len(w))
            return " ".join([*w[:i], pick(("<a href='/z'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<code>{}</code>", "<math><mi>{}</mi></math>", "<span>{}</span>")).format(w[i]), *w[i + 1 :]])

        def fill(style: str) -> str:
            kind = rng.random()
            if kind < 0.68:
                t = keep(para())
                t = marked(t) if chance(0.2) else t
                if style == "breaks":
                    return f"<div>{t}</div>" if chance(0.3) else f"{t}<hr>" if chance(0.5) else f"<center>{t}</center>"
                return pick(("<p>{}</p>",) * 8 + ("<p>{}", "<div>{}</div>", '<div class="paragraph">{}</div>')).format(t)
            if kind < 0.76:
                return "<h{0}>{1}</h{0}>".format(pick("234"), keep(words(1, 8).capitalize()))
            if kind < 0.84:
                return "<{0}>{1}</{0}>".format(pick(("ul", "ol")), "".join(f"<li>{keep(sentence())}</li>" for _ in range(rng.randint(1, 5))))
            if kind < 0.88:
                return f"<blockquote>{pick(('<p>{}</p>', '{}')).format(keep(para()))}</blockquote>"
            if kind < 0.91:
                return f"<pre>{keep(words(2, 12))}</pre>"
            if kind < 0.95:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 3))}</td>" for _ in range(rng.randint(2, 3))) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            if kind < 0.97:
                return f"<dl><dt>{keep(words(1, 3))}</dt><dd>{keep(sentence())}</dd></dl>"
            return f"<figure><img src='a.png'><figcaption>{keep(sentence())}</figcaption></figure>"

        style = pick(("semantic",) * 4 + ("named",) * 4 + ("nameless",) * 4 + ("table",) * 3 + ("bare",) * 3 + ("breaks",) * 2)
        body, title = "", words(1, 9).capitalize()
        if chance(0.75):
            head = f"<h1>{keep(title)}</h1>"
            body += f"<header>{head}</header>" if style == "semantic" and chance(0.2) else head if chance(0.85) else head.replace("h1", "h2")
            if chance(0.2):
                line = f"{pick(('By ', '', ''))}{words(1, 3).title()}, {rng.randint(1, 28)} {words(1, 1)} {rng.randint(1999, 2026)}"
                body += pick(("<p>{}</p>", '<div class="byline">{}</div>', '<p class="meta">{}</p>', "<time>{}</time>")).format(keep(line))
        for k in range(pick((1, 1, 2, 3, 5, 8, 12))):
            body += fill(style)
            if style != "bare" and chance(0.1):
                body += box(pick(("ad", "share", "ad", "note", "side")), style)
        if style != "bare" and chance(0.4):
            body += box(pick(("talk", "talk", "talk", "share", "side")), "named")
        if style == "bare" and chance(0.1):
            main.clear()
            pages.append((keep(para()), main))
            continue
        if style == "bare":
            pages.append((pick(("{}", "<html><body>{}</body></html>", "<body>{}", "<!DOCTYPE html><html><head><title>x</title></head><body>{}</body></html>")).format(body), main))
            continue
        wrap = {
            "semantic": ("<article>{}</article>",) * 4 + ("<main>{}</main>", "<main><article>{}</article></main>", '<article class="post entry">{}</article>', "<main><div>{}</div></main>"),
            "named": tuple(f"<div{named('main')}>{{}}</div>" for _ in range(4)) + (f"<section{named('main')}>{{}}</section>", '<div itemprop="articleBody">{}</div>', f"<div{named('main')}><div{named('main')}>{{}}</div></div>"),
        }.get(style, ("<div>{}</div>", "<div><div>{}</div></div>", "{}", "<center>{}</center>"))
        text = pick(wrap).format(body)
        before = [box(k, style) for k in ("menu", "head", "note", "ad", "side", "menu") if chance(0.4)]
        after = [box(k, style) for k in ("side", "share", "talk", "ad", "note", "foot", "foot", "menu") if chance(0.35)]
        before, after = before if chance(0.85) else [], after if chance(0.85) else []
        if chance(0.5):
            rng.shuffle(before)
        if before and chance(0.3):
            before.append(f"<form><label>{words(1, 3)}</label><input><button>{words(1, 1)}</button></form>")
        if style == "table":
            cell = lambda x, inner="": f"<td{inner}>{x}</td>"
            left, right = cell(inside(pick(("menu", "menu", "side")))), cell(inside(pick(("side", "ad", "menu"))))
            row = f"<tr>{left if chance(0.7) else ''}{cell(text, pick(('', ' width=600', ' valign=top')))}{right if chance(0.4) else ''}</tr>"
            top = f"<tr><td colspan=3>{inside(pick(('head', 'menu')))}</td></tr>" if chance(0.5) else ""
            low = f"<tr><td colspan=3>{inside('foot')}</td></tr>" if chance(0.5) else ""
            text = f"<table>{top}{row}{low}</table>"
            before, after = before if chance(0.2) else [], after if chance(0.2) else []
        page = "".join(before) + text + "".join(after)
        if chance(0.3):
            page = f'<div{pick(("", " class=wrapper", " id=page", " class=container", " id=outer", " class=layout"))}>{page}</div>'
        html = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{page}</body></html>"
        pages.append((f"<html><body><form>{html}</form>" if style == "semantic" and chance(0.03) else html, main))
    return pages


def label_blocks(found: list[Block], main: list[str]) -> list[int]:
    """Each block's state: 1 for those that are the next main text in order."""
    out, k = [], 0
    for b in found:
        hit = k < len(main) and b.text == " ".join(main[k].split())
        out.append(int(hit))
        k += hit
    return out


@functools.cache
def trained(n: int = 3000, seed: int = 1) -> Field:
    pages = [(b, label_blocks(b, main)) for page, main in labelled_pages(n, seed) if (b := blocks(page))]
    return Field().fit(pages)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text) of each page."""
    field = field or trained()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [field.extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string")
