"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of
its ancestors (tags, and what their class, id and role say) and of its text (length, share of links,
final punctuation, signs). A chain of two labels, main and other, is trained on labelled pages by
maximum likelihood and decoded by Viterbi. Scripts, styles, comments and markup are never text.

The labelled pages are made by ``labelled_pages``: layouts of many kinds, with menus, headers, footers,
sidebars, notices, adverts, forms and reader comments around and inside articles, sloppy and cut off
markup included. Their words are random, so only structure and form can be learned.

Character references are decoded, white space inside a block is one space, blocks are joined by one
space in page order. Null, empty and text-less pages give an empty text; null or repeated ids keep one
row each; pages of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as references
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkdoc.llm.classify import adam

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    # a quote opens a value only after "=": names, each with a value or not
    r"(?:((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+)>|([^>]*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Open elements that a start tag ends, as long as nothing but inline elements is open inside them.
_ENDS = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head", "title"}}
_ROLES = frozenset("alert alertdialog article banner complementary contentinfo dialog document form main menu menubar navigation note search status toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TELLING = {
    "advert": "ad ads adv advert advertisement adsense adslot adbox sponsor sponsored promo promotion promoted banner dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip topbar toolbar tabs",
    "comments": "comment comments disqus reply replies respond discussion commentlist responses reader readers",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription signup paywall privacy banner announcement warning disclaimer",
    "aside": "sidebar aside related widget rail recommended recommendations popular trending share sharing social complementary more see",
    "edge": "footer foot header head masthead copyright legal contentinfo colophon credits site logo brand",
    "form": "form search login input contact register",
    "meta": "byline author meta date published tags tag categories category timestamp",
    "main": "content article post entry story body text main articlebody prose page",
}
_GROUPS: dict[str, list[str]] = {}
for _group, _words in _TELLING.items():
    for _word in _words.split():
        _GROUPS.setdefault(_word, []).append(_group)


def _hints(attributes: str) -> list[str]:
    found = []
    for name, value in _ATTRIBUTE.findall(attributes):
        for part in _PART.findall(_CAMEL.sub(" ", value).lower()):
            found += _GROUPS.get(part, ())
        if name.lower() == "role" and (role := value.strip("\"' ").lower()) in _ROLES:
            found.append("role " + role)
    return found


def blocks(page: str | None) -> list[tuple[str, frozenset[str], str, int]]:
    """Leaf blocks in page order: (innermost block tag, features of the ancestors, text, characters of links)."""
    out: list[tuple[str, frozenset[str], str, int]] = []
    page = page or ""
    # open blocks, innermost last: tag, features, and the open inline elements inside, by tag
    stack: list[tuple[str, frozenset[str], dict[str, int]]] = [("", frozenset(), {})]
    opened: dict[str, int] = {}  # open elements by tag
    pieces: list[str] = []
    linked, pos = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((stack[-1][0], stack[-1][1], text, linked))
            pieces.clear()
        linked = 0

    def pop() -> None:
        tag, _, inline = stack.pop()
        opened[tag] -= 1
        for name, n in inline.items():
            opened[name] -= n

    while True:
        m = _TOKEN.search(page, pos)
        run = page[pos : m.start()] if m else page[pos:]
        if run:
            run = references.unescape(run) if "&" in run else run
            pieces.append(run)
            if opened.get("a"):
                linked += len(run)
        if not m:
            break
        pos = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if tag == "title" and opened.get("svg"):
            tag = "svg title"
        block = tag in _BLOCK
        inline = stack[-1][2]
        if m.group(1):
            if tag == "p" and not opened.get("p"):
                flush()
            if opened.get(tag):
                if block:
                    flush()
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif inline.get(tag):  # an inline end tag doesn't reach beyond its block
                    inline[tag] -= 1
                    opened[tag] -= 1
            continue
        attributes = m.group(3) if m.group(3) is not None else m.group(4) or ""
        if tag in _RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "textarea", "template"):
                end = _raw_end(tag).search(page, pos)
                pos = end.end() if end else len(page)
            if tag in ("textarea", "iframe"):
                flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        if not block:
            if not attributes.endswith("/") and not (tag == "a" and inline.get("a")):  # links don't nest: a second one ends the first
                inline[tag] = inline.get(tag, 0) + 1
                opened[tag] = opened.get(tag, 0) + 1
            continue
        flush()
        ends = _ENDS.get(tag, {"p"})
        while stack[-1][0] in ends or stack[-1][0] in _HEADINGS and tag in _HEADINGS:  # close what this tag implies closed
            pop()
        features = {f"in {tag}", *(f"hint {h}" for h in _hints(attributes))} if attributes else {f"in {tag}"}
        above = stack[-1][1]
        stack.append((tag, above if features <= above else above | features, {}))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    """End of an element of ``_RAW``."""
    return re.compile(rf"</{tag}\b[^>]*+>?", re.I)


_END = re.compile(r"[.!?…:;\"”»)]$")
_MARKS = {"copyright": re.compile("©|\\(c\\)|copyright|all rights", re.I), "digits": re.compile(r"\d")}


def features(found: list[tuple[str, frozenset[str], str, int]]) -> list[list[str]]:
    """Names of each block's features."""
    rows = []
    semantic = any("in article" in b[1] or "in main" in b[1] or "hint main" in b[1] for b in found)
    article = any("in article" in b[1] for b in found)
    for tag, above, text, linked in found:
        words = text.count(" ") + 1
        row = [*above, f"tag {tag}", f"words {min(9, int(math.log2(words)))}", f"links {min(4, 5 * linked // (len(text) + 1))}", "ends" if _END.search(text) else "open"]
        row += [name for name, mark in _MARKS.items() if mark.search(text)]
        if article and "in article" not in above:
            row.append("out of article")
        if semantic and not ("in article" in above or "in main" in above or "hint main" in above):
            row.append("out of main")
        if not semantic:
            row.append("no main")
            if tag == "p":
                row.append("no main p")
        if tag in _HEADINGS:
            row.append("heading")
        rows.append(row)
    return rows


class Chain:
    """Weights of a two-label chain: a feature's score for main, transitions, start."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], start: list[float]) -> None:
        self.weights, self.moves, self.start = weights, moves, start

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """Viterbi: the likeliest labels (True: main)."""
        if not rows:
            return []
        get, ((oo, om), (mo, mm)) = self.weights.get, self.moves
        other, main, back = self.start[0], self.start[1], []
        for i, row in enumerate(rows):
            if i:
                a, b = other + oo, main + mo
                c, d = other + om, main + mm
                back.append((b > a, d >= c))
                other, main = max(a, b), max(c, d)
            main += sum(get(f, 0.0) for f in row)
        label = main > other
        labels = [label]
        for to_other, to_main in reversed(back):
            label = to_main if label else to_other
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], ridge: float = 1e-3, steps: int = 250) -> Chain:
    """Greatest likelihood of the labels of all pages, by forward and backward sums over all chains at once."""
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    number = {f: i for i, f in enumerate(names)}
    k, longest, n = len(names), max(len(r) for r, _ in pages), len(pages)
    x = np.zeros((n, longest, k), np.float32)
    y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, row in enumerate(rows):
            x[i, j, [number[f] for f in row]] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    flat, where = x[real], np.nonzero(real)
    pair = real[:, 1:]

    def gradient(p: np.ndarray) -> np.ndarray:
        w, moves, start = p[:k], p[k : k + 4].reshape(2, 2), p[k + 4 :]
        score = np.zeros((n, longest, 2))
        score[where[0], where[1], 1] = flat @ w
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(ahead[:, -1], axis=1)
        node = np.exp(ahead + behind - z[:, None, None])
        edge = np.exp(ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None])[pair].sum(axis=0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        g_w = flat.T @ (node[..., 1] - y)[real]
        g_start = node[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=2)
        return np.concatenate([g_w, (edge - seen).ravel(), g_start]) / n + ridge * p

    p = adam(np.zeros(k + 6), gradient, steps, rate=0.1)
    return Chain(dict(zip(names, p[:k].tolist(), strict=True)), p[k : k + 4].reshape(2, 2).tolist(), p[k + 4 :].tolist())


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks."""
    rng = random.Random(seed)
    syllables = "an re tion ka lo mi st er ou qu ble é ü ch ein ar os".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))

    def phrase(least: int, most: int, end: str = "") -> str:
        style = rng.random()
        w = [word() for _ in range(rng.randrange(least, most + 1))]
        if style < 0.08:
            w = [x + rng.choice(["%%%", "***", "###", "$$$"]) for x in w]
        elif style < 0.12:
            w = [x.upper() + "!!" for x in w]
        return " ".join(w).capitalize() + end

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{phrase(1, 2)}</a></{tag}>' for _ in range(rng.randrange(2, 9)))

    def css(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f" class='{word()} {name}'", f' class="{name}-{rng.randrange(9)}"'])

    def other(inside: bool) -> str:
        kind = rng.randrange(12 if not inside else 7)
        text = phrase(3, 25, ".")
        if kind == 0:
            return f"<div{css('ad', 'advert', 'sponsored', 'ad-slot', 'promo')}>{text}</div>"
        if kind == 1:
            return f"<aside{rng.choice(['', css('sidebar', 'related', 'widget')])}><h3>{phrase(1, 3)}</h3><ul>{links()}</ul><p>{text}</p></aside>"
        if kind == 2:
            body = "".join(f"<div{css('comment', 'reply')}><b>{word()}</b><p>{phrase(3, 40, '.')}</p></div>" for _ in range(rng.randrange(1, 5)))
            return rng.choice([f"<section{css('comments', 'disqus', 'responses')}><h2>{phrase(1, 2)}</h2>{body}</section>", f"<div{css('comments', 'comment-list', 'discussion')}>{body}</div>"])
        if kind == 3:
            return f"<form{rng.choice(['', css('search', 'signup')])}><label>{phrase(1, 3)}</label><input name=q><button>{word()}</button><select><option>{word()}</option></select></form>"
        if kind == 4:
            return f"<div{css('share', 'social', 'related', 'tags')}><span>{phrase(1, 3)}</span>{links('span')}</div>"
        if kind == 5:
            return f"<div{css('notice', 'cookie-banner', 'newsletter', 'alert', 'consent', 'paywall')}><p>{text}</p><button>{word()}</button></div>"
        if kind == 6:
            return f"<nav><ul>{links()}</ul></nav>"
        if kind == 7:
            return f"<div{css('menu', 'navbar', 'breadcrumbs', 'nav')}><ul>{links()}</ul></div>"
        if kind == 8:
            return f"<div{css('sidebar', 'rail', 'widget')}><h4>{phrase(1, 3)}</h4><p>{phrase(5, 40, '.')}</p>{links('p')}</div>"
        if kind == 9:
            return f'<div role="{rng.choice(["navigation", "banner", "complementary", "contentinfo", "dialog", "alert"])}">{text}</div>'
        if kind == 10:
            return f"<div{css('popup', 'modal', 'gdpr', 'cookies')}>{text} <a href=#>{word()}</a></div>"
        return f"<noscript>{text}</noscript>"

    def content(gold: list[str]) -> str:
        parts = []

        def add(text: str, markup: str | None = None, tag: str = "p", close: bool = True) -> None:
            gold.append(text)
            parts.append(f"<{tag}>{markup or text}{f'</{tag}>' if close else ''}")

        if rng.random() < 0.8:
            add(phrase(2, 9, rng.choice(["", "."])), tag=rng.choice(["h1", "h1", "h2"]))
        for _ in range(rng.randrange(1, 14)):
            r, text = rng.random(), phrase(*rng.choice([(1, 3), (5, 30), (20, 120)]), ".")
            if r < 0.12:
                add(text, f"<b>{text}<br>", close=False)
            elif r < 0.2:
                add(phrase(1, 5), tag=rng.choice(["h2", "h3"]))
            elif r < 0.28:
                items = [phrase(1, 12) for _ in range(rng.randrange(2, 5))]
                gold.extend(items)
                parts.append(f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>")
            elif r < 0.34:
                add(text, tag=rng.choice(["blockquote", "pre", "div", "figcaption"]))
            elif r < 0.44:
                first, *rest = text.split(" ")
                add(text, f'<a href="/x">{first}</a> {" ".join(rest)}'.strip())
            else:
                add(text, close=rng.random() < 0.9)
            if rng.random() < 0.07:
                parts.append(other(True))
        return "".join(parts)

    pages = []
    for _ in range(n):
        gold: list[str] = []
        head = f"<!DOCTYPE html><html><head><title>{phrase(2, 9)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body{rng.choice(['', css('page', 'home')])}>"
        top = rng.choice([f"<nav><ul>{links()}</ul></nav>", f"<header><h1>{phrase(1, 3)}</h1><nav>{links('span')}</nav></header>", f"<div{css('header', 'masthead', 'topbar')}><a href=/>{phrase(1, 3)}</a><p>{phrase(2, 8)}</p></div>", f"<header><p>{phrase(2, 9, '.')}</p></header>", ""])
        before = "".join(other(False) for _ in range(rng.randrange(0, 3)))
        after = "".join(other(False) for _ in range(rng.randrange(0, 4)))
        body = content(gold)
        if rng.random() < 0.15:
            body += f"<footer>{rng.choice([phrase(2, 6), f'<p>{phrase(2, 9)}</p>'])}</footer>"
        frame = rng.choice(["article", "article", "article", "main", "section-main", "div", "bare"])
        body = {"article": f"<article>{body}</article>", "main": f"<main>{body}</main>", "section-main": f"<main><article{css('post', 'entry')}>{body}</article></main>", "div": f"<div{css('content', 'post-body', 'entry-content', 'article-text', 'main', 'story')}>{body}</div>", "bare": body}[frame]
        if rng.random() < 0.3:
            body = f"<div{css('wrap', 'container', 'page')}>{body}</div>"
        foot = rng.choice([f"<footer>&copy; {word()}.{word()} &middot; {phrase(2, 12, '.')}</footer>", f"<div{css('footer', 'copyright', 'legal')}><p>&copy; {phrase(1, 5)}</p><ul>{links()}</ul></div>", f"<footer><p>{phrase(3, 15, '.')}</p><ul>{links()}</ul></footer>", ""])
        tail = rng.choice(["</body></html>", "</body></html>", ""])
        pages.append((head + top + before + body + after + foot + tail, [" ".join(g.split()) for g in gold]))
    return pages


def align(found: list[tuple[str, frozenset[str], str, int]], gold: list[str]) -> list[bool]:
    """Which blocks are the gold texts, in order."""
    labels, at = [], 0
    for b in found:
        hit = at < len(gold) and b[2] == gold[at]
        at += hit
        labels.append(hit)
    return labels


@functools.lru_cache(maxsize=1)
def model(pages: int = 700, seed: int = 7) -> Chain:
    """The chain trained on ``pages`` labelled pages: a second or two, the same at every run."""
    data = []
    for page, gold in labelled_pages(pages, seed):
        found = blocks(page)
        data.append((features(found), align(found, gold)))
    return train(data)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    return " ".join(b[2] for b, keep in zip(found, chain.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    chain = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), chain) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
