"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant scanner cuts a page into leaf blocks: runs of text between the tags of block elements, each with its ancestors'
tags and attribute words. The field labels the sequence of blocks as main text or not, from features of the ancestors and of
the text; it is trained on labelled pages and decoded by Viterbi. The labelled pages are made here by rules, with layouts,
words and noise of many kinds and the truth known for each block, so that training needs no file and is the same everywhere.

Scripts, styles, comments, forms' controls and the head hold no blocks. Character references are decoded, white space inside a
block becomes one space, and main blocks are joined in page order by two line feeds. Null and empty pages give an empty text;
so do pages without main blocks. A page without any tag is one block. Repeated rows and ties (equal paths take the label "other") get
equal results. A very long or deep page is scanned in linear time. Columns text and n_chars of the input are replaced; others
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Elements whose tags bound blocks.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template head title iframe object canvas select textarea audio video datalist noembed noframes".split())
#: Those whose content has no tags.
RAW = frozenset("script style title textarea noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag; a quoted value may hold ">". An unclosed quote is an ordinary character.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
CLOSE = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Paths of ancestors whose weights a worker remembers.
PATHS = 50_000
#: Groups of attribute words, by their beginnings.
HINTS = {
    "nav": "nav menu breadcrumb toc pagination pager tabs skip",
    "ad": "ad ads advert advertisement banner promo sponsor sponsored outbrain taboola dfp",
    "foot": "footer foot copyright colophon legal",
    "head": "header masthead topbar logo brand",
    "side": "sidebar side aside widget related recommended trending popular rail share social",
    "comment": "comment comments reply replies disqus discussion respond",
    "notice": "cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast",
    "form": "form search login contact register",
    "main": "content article post entry main story text prose body blog",
    "meta": "meta byline author date tags share caption credit",
}
HINT_OF = {w: g for g, ws in HINTS.items() for w in ws.split()}


class Path:
    """What the ancestors of a block say, from the root on. Its size doesn't grow with the depth."""

    __slots__ = ("hints", "key", "last", "marks", "near", "own", "tags")

    def __init__(self, tag: str, own: frozenset, up: Path | None):
        self.own, self.last = own, tag
        self.tags = up.tags | {tag} if up else frozenset({tag})
        self.hints = up.hints | own if up else own
        self.near = own | (up.own if up else frozenset())
        told = ([tag] if tag in LANDMARKS else []) + sorted(own)
        self.marks = (*(up.marks if up else ()), *told)[-2:]
        self.key = (self.tags, self.hints, self.last, self.near, self.marks)


#: Tags that say what a part of a page is.
LANDMARKS = frozenset("article main nav header footer aside form section dialog figure button".split())
NOWHERE = (frozenset(), frozenset(), "", frozenset(), ())


class Block:
    """A leaf block: its text, what its ancestors say (Path.key), and its characters inside links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(10_000)
def _hints(attributes: str) -> frozenset:
    found = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words = WORDS.findall(value)
            found |= {HINT_OF[w] for w in map(str.lower, words) if w in HINT_OF}
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and "true" in value.lower():
            found.add("hidden")
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order. Time is linear in the page's length, however deep it nests."""
    out: list[Block] = []
    stack: list[tuple[str, Path | None]] = []  # open elements, each with the path of the block elements down to it
    opened: Counter = Counter()
    parts: list[str] = []
    linked = hidden = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                path = stack[-1][1] if stack else None
                out.append(Block(text, path.key if path else NOWHERE, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden
        for tag, _ in stack[to:]:
            opened[tag] -= 1
            hidden -= tag in HIDDEN
        del stack[to:]

    def open_at(tags: tuple[str, ...] | frozenset, stop: tuple[str, ...] | frozenset = ()) -> int:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in stop:
                    break
        return -1

    def add(text: str) -> None:
        nonlocal linked
        if not hidden:
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    at = 0
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = end + 1 if end > lt else size
            continue
        closing = after == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if closing and page.find(">", lt) > 0:
                at = page.find(">", lt) + 1
                continue
            add("<")
            at = lt + 1
            continue
        rest = REST.match(page, name.end())
        if not rest:
            break
        tag, attributes, at = name[0].lower(), rest[0][:-1], rest.end()
        if closing:
            if tag in BLOCKS:
                flush()
            i = open_at((tag,), () if tag in BLOCKS else ("td", "th", "table", "body"))
            if i >= 0:
                pop(i)
            continue
        if tag in BLOCKS:
            flush()
            if (i := open_at(PARAGRAPHS, BLOCKS - PARAGRAPHS)) >= 0:
                pop(i)  # a block ends an open paragraph, with what is open in it
            for sisters, parents in ENDS.get(tag, ()):
                if (i := open_at(sisters, parents)) >= 0:
                    pop(i)
        if tag in ("br", "hr", "img", "input"):
            add(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            found = CLOSE[tag].search(page, at)
            close = page.find(">", found.start()) if found else -1
            at = close + 1 if close >= 0 else size
            continue
        up = stack[-1][1] if stack else None
        stack.append((tag, Path(tag, _hints(attributes) if attributes else frozenset(), up) if tag in BLOCKS or tag == "button" else up))
        opened[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return out


PARAGRAPHS = frozenset({"p", *HEADINGS})
#: What the begin of an element ends: (elements, inside of these).
ENDS = {"li": [(("li",), ("ul", "ol", "menu"))], "dt": [(("dt", "dd"), ("dl",))], "dd": [(("dt", "dd"), ("dl",))], "td": [(("td", "th"), ("tr", "table"))], "th": [(("td", "th"), ("tr", "table"))], "tr": [(("tr",), ("table",))]}


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors."""
    tags, hints, last, near, marks = path
    f = ["bias", *(f"in:{t}" for t in tags), *(f"hint:{h}" for h in hints), *(f"near:{h}" for h in near)]
    if last:
        f.append(f"last:{last}")
    f.append(f"inner:{marks[-1]}" if marks else "inner:none")
    if len(marks) > 1:
        f.append(f"inner2:{marks[-2]}>{marks[-1]}")
    return f


def text_features(b: Block, i: int, n: int, longest: int) -> list[str]:
    """Features of a block's text and place: the i-th of n, the longest one having so many characters."""
    size = len(b.text)
    share = b.linked / size
    f = [
        SIZES[min(8, size.bit_length())],
        "links:all" if share > 0.8 else "links:half" if share > 0.3 else "links:few" if share else "links:none",
        "ends:stop" if b.text[-1] in ".!?…。:;\"”’" else "ends:word",
        PLACES[4 * i // n],
        "long" if 2 * size >= longest else "short",
    ]
    if RIGHTS.search(b.text):
        f.append("copyright inside" if b.path[0] & {"article", "main"} else "copyright")
    if i == 0:
        f.append("first")
    if n <= 3:
        f.append("of few")
    return f


RIGHTS = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
SIZES, PLACES = [f"size:{k}" for k in range(9)], [f"place:{k}" for k in range(4)]


def features(page: list[Block]) -> list[list[str]]:
    """Features of each block."""
    longest = max((len(b.text) for b in page), default=1)
    return [path_features(b.path) + text_features(b, i, len(page), longest) for i, b in enumerate(page)]


MAIN, OTHER = 1, 0


def training_pages(n: int = 260, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Labelled pages: (html, label of each block)."""
    rnd = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on ar".split()

    def words(k: int) -> str:
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(k))

    def sentence() -> str:
        return words(rnd.randint(1, 22)).capitalize() + rnd.choice("....!?,") * (rnd.random() < 0.93)

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rnd.choice((1, 1, 2, 3, 5, 8))))

    def links(k: int, item: str = "li") -> list[str]:
        return [f'<{item}><a href="/{words(1)}">{words(rnd.randint(1, 3))}</a></{item}>' for _ in range(k)]

    def attr(*names: str) -> str:
        return f' {rnd.choice(("class", "id"))}="{rnd.choice(names)}"'

    def noise(kind: str) -> tuple[str, int]:
        """A piece of boilerplate and its number of blocks."""
        k = rnd.randint(1, 6)
        if kind == "nav":
            items = links(k)
            return rnd.choice(("<nav><ul>{}</ul></nav>", f"<div{attr('menu', 'navbar', 'main-nav', 'breadcrumbs')}><ul>{{}}</ul></div>", "<ul>{}</ul>")).format("".join(items)), k
        if kind == "ad":
            return rnd.choice((f"<div{attr('ad', 'advert', 'banner-ad', 'sponsored', 'promo')}>{{}}</div>", "<aside class='ads'>{}</aside>", f"<div{attr('ad', 'ad-slot')}><p>{{}}</p></div>")).format(paragraph()), 1
        if kind == "side":
            return f"<{(t := rnd.choice(('aside', 'div')))}{attr('sidebar', 'widget', 'related', 'related-posts', 'trending')}><h3>{words(2)}</h3>{''.join(links(k))}<p>{paragraph()}</p></{t}>", k + 2
        if kind == "notice":
            return f"<div{attr('cookie-notice', 'newsletter', 'consent', 'popup', 'alert', 'notice', 'cookie-banner')}><p>{paragraph()}</p></div>", 1
        if kind == "form":
            return f"<form{rnd.choice(('', attr('search', 'login', 'contact-form')))}><label>{words(2)}</label><input name=q><p>{sentence()}</p><button>{words(1)}</button></form>", 3
        if kind == "comment":
            return f"<{(t := rnd.choice(('section', 'div')))}{attr('comments', 'comment-list', 'disqus', 'replies')}><h3>{words(1)}</h3>{''.join(f'<div{attr(chr(99) + chr(111) + "mment", "reply")}><p>{paragraph()}</p></div>' for _ in range(k))}</{t}>", k + 1
        if kind == "footer":
            return rnd.choice(("<footer>{}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}>{{}}</div>", "<footer><p>{}</p></footer>")).format(f"{rnd.choice(('&copy; ', '© ', ''))}{words(3)} {rnd.choice(('&middot; ', ''))}{paragraph()}"), 1
        return rnd.choice((f"<header><div{attr('logo', 'brand')}>{words(2)}</div><p>{words(4)}</p></header>", f"<div{attr('masthead', 'header', 'topbar')}><div>{words(2)}</div><p>{words(4)}</p></div>")), 2

    def row(cells: list[str], style: str = "") -> str:
        return f"<tr{style}>" + "".join(f"<td{rnd.choice(('', ' valign=top', ' width=120'))}>{c}</td>" for c in cells) + "</tr>"

    def rights() -> str:
        return f"{rnd.choice(('&copy;', '©', 'Copyright', '(c)', 'Copyright &copy;'))} {rnd.randint(1995, 2030)} {words(2).title()}{rnd.choice(('', '. All rights reserved.', ', all rights reserved'))}"

    def old_page() -> tuple[str, list[int]]:
        """A page of layout tables or bare blocks, without names that tell anything."""
        k, m = rnd.randint(2, 7), rnd.randint(1, 6)
        menu = [f'<a href="{words(1)}.htm">{words(rnd.randint(1, 2)).title()}</a>' for _ in range(k)]
        if rnd.random() < 0.3:
            menu = [words(rnd.randint(1, 2)).title() for _ in range(k)]
        main = [f"<p>{paragraph()} {sentence()} {sentence()}</p>" for _ in range(m)]
        truth = [MAIN] * m
        if rnd.random() < 0.8:
            main.insert(0, f"<h{(h := rnd.randint(1, 3))}>{words(rnd.randint(1, 6)).capitalize()}</h{h}>")
            truth.append(MAIN)
        end = [rights()] if rnd.random() < 0.8 else []
        if rnd.random() < 0.5:
            side = rnd.random() < 0.5
            body = "<table>" + ("" if side else row(menu)) + "<tr>" + ("<td>" + "".join(f"<p>{x}</p>" for x in menu) + "</td>" if side else "") + f"<td>{''.join(main)}</td></tr>" + "".join(row([x]) for x in end) + "</table>"
        else:
            shape = rnd.choice(("div", "p", "li"))
            body = "".join(f"<{shape}>{x}</{shape}>" for x in menu) + "".join(main) + rnd.choice(("<hr>", "")) + "".join(f"<p>{x}</p>" for x in end)
        return f"<html><body>{body}</body></html>", [OTHER] * k + truth + [OTHER] * len(end)

    pages = [old_page() for _ in range(n // 4)]
    for _ in range(n):
        body: list[str] = []
        truth: list[int] = []

        def put(text: str, label: int, k: int = 1, body=body, truth=truth) -> None:
            body.append(text)
            truth += [label] * k

        for kind in rnd.sample(("head", "nav", "ad", "notice", "form", "side"), rnd.randint(1, 4)):
            put(*(lambda x: (x[0], OTHER, x[1]))(noise(kind)))
        style = rnd.choice(("article", "article", "article", "main", "main-article", "div", "div", "plain"))
        begin, end = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "main-article": ("<main><article class=post>", "</article></main>"), "div": (f"<div{attr('content', 'post-content', 'entry', 'article-body', 'story', 'main')}>", "</div>"), "plain": ("<div>", "</div>")}[style]
        put(begin, MAIN, 0)
        heading = f"<h1>{words(rnd.randint(1, 9)).capitalize()}{rnd.choice(('', '', '.'))}</h1>"
        put(f"<header>{heading}</header>" if style == "article" and rnd.random() < 0.15 else heading, MAIN)
        for j in range(rnd.choice((0, 1, 1, 2, 3, 5, 9, 14))):
            r = rnd.random()
            if r < 0.1:
                put(f"<h{rnd.randint(2, 4)}>{words(rnd.randint(1, 5))}</h2>", MAIN)
            elif r < 0.17:
                k = rnd.randint(1, 5)
                put("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(k)) + "</ul>", MAIN, k)
            elif r < 0.23:
                put(f"<blockquote><p>{paragraph()}</p></blockquote>", MAIN)
            elif r < 0.25:
                put(f"<p>{rnd.choice(('', '<b>'))}{rights()}", MAIN)
            elif r < 0.28:
                put(f"<pre>{words(6)}\n{words(4)}</pre>", MAIN)
            elif r < 0.33:
                put(f"<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>", MAIN, 2)
            elif r < 0.37:
                put(f"<p>{words(3)} <a href=x>{words(3)}</a> {sentence()}</p>", MAIN)
            elif r < 0.5 and j:
                put(*(lambda x: (x[0], OTHER, x[1]))(noise(rnd.choice(("ad", "notice", "form", "side", "ad")))))
            elif r < 0.62:
                put(f"<p><b>{sentence()}<br>", MAIN)
            else:
                put(f"<p>{paragraph()}</p>", MAIN)
        if rnd.random() < 0.25:
            put(*(lambda x: (x[0], OTHER, x[1]))(noise("comment")))
        put(end, MAIN, 0)
        for kind in rnd.sample(("comment", "side", "form", "ad", "nav", "notice", "footer"), rnd.randint(0, 4)) + ["footer"] * (rnd.random() < 0.7):
            put(*(lambda x: (x[0], OTHER, x[1]))(noise(kind)))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var a=1;</script></head><body>{''.join(body)}</body></html>", truth))
    for _ in range(12):
        pages.append((f"<p>{words(rnd.randint(1, 3))} <a href=x>{words(rnd.randint(1, 2))}</a>", [MAIN]))
        pages.append((f"<p>{sentence()}</p><p>{words(rnd.randint(1, 4))}", [MAIN, MAIN]))
        pages.append((paragraph(), [MAIN]))
        pages.append((f"<p>{paragraph()}</p><p>{paragraph()}</p>", [MAIN, MAIN]))
    return pages


class Field:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves.tolist()
        self.paths: dict[tuple, tuple[float, float]] = {}

    def sums(self, names: list[str]) -> tuple[float, float]:
        found = [w for w in map(self.weights.get, names) if w]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def label(self, page: list[Block]) -> list[int]:
        """The most probable labels (Viterbi)."""
        moves, known = self.moves, self.paths
        if len(known) > PATHS:
            known.clear()
        back: list[tuple[int, int]] = []
        a = b = 0.0
        longest = max((len(x.text) for x in page), default=1)
        for i, block in enumerate(page):
            path = block.path
            own = known.get(path)
            if own is None:
                own = known[path] = self.sums(path_features(path))
            u, v = self.sums(text_features(block, i, len(page), longest))
            u, v = u + own[0], v + own[1]
            if i:
                from_a, from_b = (a + moves[0][0], b + moves[1][0]), (a + moves[0][1], b + moves[1][1])
                back.append((int(from_a[1] > from_a[0]), int(from_b[1] > from_b[0])))
                a, b = max(from_a) + u, max(from_b) + v
            else:
                a, b = u, v
        if not page:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by Adam over all pages at once."""
    found = [(features(b), y) for b, y in ((blocks(p), y) for p, y in pages) if len(b) == len(y) and b]
    names = sorted({x for f, _ in found for row in f for x in row})
    number = {x: i for i, x in enumerate(names)}
    n, longest = len(found), max(len(y) for _, y in found)
    row, feature = zip(*((p * longest + i, number[x]) for p, (f, _) in enumerate(found) for i, xs in enumerate(f) for x in xs), strict=True)
    row, feature = np.array(row), np.array(feature)
    size = np.array([len(y) for _, y in found])
    truth = np.zeros((n, longest), np.int64)
    for p, (_, y) in enumerate(found):
        truth[p, : len(y)] = y
    inside = np.arange(longest) < size[:, None]
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    m, s = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    one = np.eye(2)[truth] * inside[..., None]
    pair = inside[:, 1:] & inside[:, :-1]
    seen_moves = np.einsum("pti,ptj->ij", one[:, :-1], one[:, 1:] * pair[..., None])
    for step in range(1, rounds + 1):
        u = np.stack([np.bincount(row, w[feature, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        ahead = np.zeros_like(u)
        ahead[:, 0] = u[:, 0]
        for t in range(1, longest):
            ahead[:, t] = u[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1)
        behind = np.zeros_like(u)
        for t in range(longest - 2, -1, -1):
            own = np.logaddexp.reduce(moves + (u[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(inside[:, t + 1, None], own, 0.0)
        total = np.logaddexp.reduce(ahead[np.arange(n), size - 1], axis=1)
        node = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
        edge = np.exp(np.minimum(ahead[:, :-1, :, None] + moves + (u + behind)[:, 1:, None, :] - total[:, None, None, None], 0)) * pair[..., None, None]
        gap = (one - node).reshape(-1, 2)
        grads = [np.stack([np.bincount(feature, gap[row, k], len(names)) for k in (0, 1)], 1) - ridge * w, seen_moves - edge.sum((0, 1)) - ridge * moves]
        for i, (x, g) in enumerate(zip((w, moves), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            x += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return Field({x: (float(w[i, 0]), float(w[i, 1])) for x, i in number.items()}, moves)


@lru_cache(1)
def trained() -> Field:
    """The field trained on the labelled pages; the same on every machine."""
    return train(training_pages())


def main_text(page: str, field: Field) -> str:
    """The page's main blocks."""
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.label(found), strict=True) if y == MAIN)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, html_col):
            own = [main_text(t, held.value) for t in texts]
            kept = [c for c in batch.schema.names if c != html_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own, pa.string()), pa.array([len(t) for t in own], pa.int64())], [*kept, "text", "n_chars"])

    kept = pages.drop(*(c for c in ("text", "n_chars") if c != html_col))
    schema = kept.drop(html_col).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema
    return kept.mapInArrow(run, schema)
