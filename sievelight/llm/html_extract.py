"""Operator 8, HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks (runs of text between block-level tags), each with features of
its ancestor tags and of its text. The field has two states, article and other; it is trained here on
labelled pages that the module writes from templates, and a page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievelight.llm.packs import lean

#: Tags whose content is never text of the page.
SILENT = {"script", "style", "template", "svg", "iframe", "head", "title", "select", "textarea", "button", "option"}
#: Tags that can stand in a head; any other ends one that is open.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Tags that run within a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "annotation", "menclose", "merror", "mfenced", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics"}
#: Tags without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open tag of the first kind ends where one of the second begins, inside the same container.
P_ENDS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that tell what a container is for.
HINTS = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "toolbar", "navigation"],
    "advert": ["ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "adsbygoogle"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "alert", "newsletter", "subscribe", "overlay", "paywall", "signup"],
    "comment": ["comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "reader", "commentlist"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "share", "social", "rail", "more"],
    "edge": ["header", "footer", "masthead", "copyright", "contentinfo", "legal", "topbar", "bottom", "site", "colophon", "complementary"],
    "body": ["article", "content", "post", "entry", "story", "main", "body", "text", "prose"],
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws}
#: Whatever follows a "<" that begins a tag or a comment is matched up to its end or the page's, so that nothing is read
#: twice: a quote counts only behind "=", and one that is never closed goes to the page's end, as in browsers.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|<(?=/)[^>]*(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "template")}
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _hints(attrs: str) -> frozenset:
    """Kinds of container that the attributes speak of."""
    found = set()
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            found |= {_HINT[w] for w in _WORD.findall(value) if w in _HINT}
    return frozenset(found)


#: Words of notices and of page furniture, for one feature.
FURNITURE = {"cookie", "cookies", "accept", "consent", "subscribe", "newsletter", "login", "register", "copyright", "reserved", "rights", "privacy", "advertisement", "sponsored", "share", "reply", "comment", "comments", "related", "menu", "search"}
_TAGS = ["nav", "header", "footer", "aside", "form", "article", "main", "ul", "ol", "li", "table", "p", "h1", "h2", "h3", "blockquote", "pre", "figure", "figcaption", "div", "section", "dl", "address", "menu", "dialog", "details"]
NAMES = [*(f"in:{t}" for t in _TAGS), *(f"hint:{h}" for h in [*HINTS, "hidden"]), *(f"own:{t}" for t in _TAGS), "short", "middling", "long", "linked", "half linked", "stop", "furniture", "sign", "article in", "article header", "bias"]
_AT = {n: i for i, n in enumerate(NAMES)}


@lru_cache(maxsize=50_000)
def _inside(above: frozenset, tag: str, hints: frozenset) -> frozenset:
    """Numbers of the features of a container and all above it. Inside an article its header is part of it."""
    article = _AT["article in"] in above or tag in ("article", "main")
    name = "article header" if tag == "header" and article else f"in:{tag}"
    found = [name, *(f"hint:{h}" for h in hints), *(["hint:notice"] if tag == "noscript" else []), *(["article in"] if article else [])]
    return above | {_AT[n] for n in found if n in _AT}


class _Open:
    """The open tags of a page. Each knows the features of all tags above it, so that a block costs the same at any depth."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.above: list[tuple[frozenset, str]] = [(frozenset(), "")]  # features of the containers, the nearest one's tag
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of tags that don't run within a block
        self.silent = self.links = 0

    def push(self, tag: str, hints: frozenset) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
            self.above.append((_inside(self.above[-1][0], tag, hints), tag))
        else:
            self.above.append(self.above[-1])
        self.tags.append(tag)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def close(self, depth: int) -> None:
        """Ends all tags from depth on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.above.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def place(self, tag: str) -> int | None:
        """Where the last open one of a tag stands."""
        return at[-1] if (at := self.places.get(tag)) else None


def blocks(page: str) -> list[tuple[str, frozenset, str, int]]:
    """Leaf blocks in page order: (text, features of the tags above, the nearest tag, characters inside links).

    Tolerates unclosed and stray tags as browsers do; comments and the content of SILENT tags are no text.
    The time is proportional to the page's length, however deep its tags are nested and whatever is left unclosed.
    """
    out: list[tuple[str, frozenset, str, int]] = []
    open_ = _Open()
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, *open_.above[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if open_.silent and open_.place("head") == len(open_.tags) - 1 and text.strip():
            open_.close(len(open_.tags) - 1)  # text ends a head
        if not open_.silent and text:
            text = html.unescape(text)
            parts.append(text)
            if open_.links:
                linked += len(text.strip())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:  # a bare "<"
            add(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            add(page[at:lt])
        at = m.end()
        if m[1] is not None:
            add(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:  # an end tag; one that was never opened is passed over
            depth = open_.place(tag)
            if depth is not None:
                if tag not in INLINE:
                    flush()
                    open_.close(depth)
                elif not open_.blocks or open_.blocks[-1] < depth:  # an inline tag doesn't close the blocks within it
                    open_.close(depth)
            continue
        if tag not in HEAD and (head := open_.place("head")) is not None:
            open_.close(head)
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in P_ENDS or tag in IMPLIED:
                ends = IMPLIED.get(tag, set()) | ({"p"} if tag in P_ENDS else set())
                for i in reversed(open_.blocks):
                    if open_.tags[i] in ends:
                        open_.close(i)
                        break
                    if open_.tags[i] != "p":
                        break
            if tag == "body":
                root = open_.place("html")
                open_.close(0 if root is None else root + 1)
        if tag in _RAW_END and not m[0].endswith("/>"):
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID or m[0].endswith("/>") and tag not in INLINE | P_ENDS:
            continue
        open_.push(tag, _hints(m[4]) if m[4] else frozenset())
    flush()
    return out


def features(block: tuple[str, frozenset, str, int]) -> list[int]:
    """Numbers of the features that hold for a block."""
    text, above, tag, linked = block
    n = len(text)
    found = [*above, *([_AT[f"own:{tag}"]] if f"own:{tag}" in _AT else []), _AT["bias"], _AT["short" if n < 40 else "middling" if n < 120 else "long"]]
    if linked >= 0.9 * n:
        found.append(_AT["linked"])
    elif linked >= 0.5 * n:
        found.append(_AT["half linked"])
    if text[-1] in ".!?:;\"')”»":
        found.append(_AT["stop"])
    if n < 400 and not FURNITURE.isdisjoint(_WORD.findall(text.lower())):
        found.append(_AT["furniture"])
    if "©" in text[:40] or "|" in text and n < 120:
        found.append(_AT["sign"])
    return found


def training_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Labelled pages: (html, texts of the blocks that belong to the article). Words are invented."""
    r = random.Random(seed)
    syllables = ["ba", "cor", "di", "el", "fen", "gra", "hu", "is", "jol", "ka", "lum", "mer", "nos", "or", "pel", "qui", "ras", "sed", "tur", "vin"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentence = lambda: words(4, 22) + r.choice(["."] * 6 + ["!", "?", ""])
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))

    def links(cls: str) -> str:
        return f"<ul{cls}>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"

    def attr(*names: str) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'

    def furniture(kind: str) -> str:
        words_of = {"notice": "We use cookies " + words(3, 12) + ". Accept", "news": "Subscribe to our newsletter " + words(2, 8)}
        return {
            "nav": lambda: f"<nav{r.choice(['', attr('menu', 'navbar')])}>{links('')}</nav>",
            "menu": lambda: f"<div{attr('menu', 'nav', 'breadcrumbs', 'toolbar')}>{links('')}</div>",
            "header": lambda: f"<header{r.choice(['', attr('site-header', 'masthead')])}><div>{words(1, 4)}</div>{r.choice(['', '<p>' + sentence() + '</p>', '<h1>' + words(1, 4) + '</h1>', links('')])}</header>",
            "footer": lambda: r.choice([f"<footer>&copy; {word()}.example &middot; {prose()}</footer>", f"<footer><p>{sentence()}</p>{links('')}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}>© {words(2, 9)}. All rights reserved</div>"]),
            "aside": lambda: f"<aside{r.choice(['', attr('sidebar', 'related', 'widget')])}><h3>{words(1, 3)}</h3>{r.choice([links(''), '<p>' + prose() + '</p>'])}</aside>",
            "side": lambda: f"<div{attr('sidebar', 'widget', 'related-posts', 'share', 'social')}><h3>{words(1, 3)}</h3>{r.choice([links(''), '<p>' + prose() + '</p>'])}</div>",
            "ad": lambda: f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner')}>{r.choice([prose(), '<p>' + prose() + '</p>', '<a href=x>' + sentence() + '</a>'])}</div>",
            "notice": lambda: f"<div{attr('cookie-notice', 'consent', 'notice', 'newsletter', 'popup', 'modal')}>{r.choice(['<p>{}</p>', '{}'])}<button>OK</button></div>".format(r.choice([words_of["notice"], words_of["news"], prose()])),
            "form": lambda: f"<form><label>{words(1, 3)}</label><input><p>{words(2, 6)}</p><button>{word()}</button></form>",
            "comments": lambda: f"<{(t := r.choice(['div', 'section']))}{attr('comments', 'comment-list', 'replies', 'reader-comments')}><h3>{r.choice(['Comments', words(1, 2)])}</h3>"
            + "".join(r.choice(["<div class=comment><p>{}</p></div>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>", "<ol><li>{}</li></ol>"]).format(prose()) for _ in range(r.randint(1, 4)))
            + f"</{t}>",
            "script": lambda: f"<script>var t='<p>{sentence()}</p>';</script><style>p{{color:red}}</style><!-- {sentence()} -->",
        }[kind]()

    pages = []
    for _ in range(n):
        kept: list[str] = []

        def mine(tag: str, text: str, kept=kept) -> str:
            kept.append(_SPACE.sub(" ", text).strip())
            body = re.sub(r"(\w+)", lambda m: f"<b>{m[1]}</b>" if r.random() < 0.02 else f'<a href="/x">{m[1]}</a>' if r.random() < 0.02 else m[1], text)
            return f"<{tag}>{body}</{tag}>" if tag not in ("p", "li") or r.random() < 0.8 else f"<{tag}>{body}"

        inner = [mine(r.choice(["h1", "h1", "h2"]), words(2, 9))] if r.random() < 0.85 else []
        if inner and r.random() < 0.2:
            inner = [f"<header>{inner[0]}{mine('p', sentence()) if r.random() < 0.5 else ''}</header>"]
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            roll = r.random()
            if roll < 0.72:
                inner.append(mine("p", prose()))
            elif roll < 0.8:
                inner.append(mine(r.choice(["h2", "h3"]), words(1, 6)))
            elif roll < 0.86:
                inner.append("<ul>" + "".join(mine("li", r.choice([sentence, lambda: words(1, 5)])()) for _ in range(r.randint(1, 5))) + "</ul>")
            elif roll < 0.9:
                inner.append(mine("blockquote", prose()))
            elif roll < 0.93:
                inner.append("<table><tr>" + mine("td", words(1, 4)) + mine("td", words(1, 4)) + "</tr></table>")
            elif roll < 0.95:
                inner.append(mine("pre", sentence()))
            else:
                inner.append(furniture(r.choice(["ad", "notice", "script", "side", "aside", "form"])))
        if r.random() < 0.15:
            inner.append(furniture("comments"))
        body = "".join(inner)
        shell = r.choice(["<article>{}</article>"] * 3 + ["<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='post'>{}</div>", "<div><div>{}</div></div>", "<section class='entry-content'>{}</section>", "<article class='post'>{}</article>"])
        before = "".join(furniture(k) for k in r.sample(["nav", "menu", "header", "ad", "notice", "script", "form"], r.randint(1, 4)))
        after = "".join(furniture(k) for k in r.sample(["footer", "aside", "side", "ad", "comments", "form", "notice", "nav", "script"], r.randint(1, 5)))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{before}{shell.format(body)}{after}</body></html>", kept))
    return pages


def train(pages: list[tuple[str, list[str]]], steps: int = 150, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights of state 1 against 0, transition weights) by gradient ascent on the penalised likelihood."""
    seqs = []
    for page, kept in pages:
        found, want = blocks(page), list(kept)
        y = []
        for b in found:
            if b[0] in want:
                want.remove(b[0])
                y.append(1)
            else:
                y.append(0)
        if found:
            x = np.zeros((len(found), len(NAMES)))
            for i, b in enumerate(found):
                x[i, features(b)] = 1
            seqs.append((x, np.array(y)))
    longest, rows = max(len(y) for _, y in seqs), len(seqs)
    x, y, live = np.zeros((rows, longest, len(NAMES))), np.zeros((rows, longest), int), np.zeros((rows, longest), bool)
    for i, (a, b) in enumerate(seqs):
        x[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
    w, t = np.zeros(len(NAMES)), np.zeros((2, 2))
    mw, mt, vw, vt = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
    pair = live[:, 1:]
    seen_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        s = np.zeros((rows, longest, 2))
        s[:, :, 1] = x @ w
        f, b = np.zeros_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0]
        for k in range(1, longest):
            go = np.logaddexp(f[:, k - 1, 0, None] + t[0], f[:, k - 1, 1, None] + t[1]) + s[:, k]
            f[:, k] = np.where(live[:, k, None], go, f[:, k - 1])
        for k in range(longest - 2, -1, -1):
            nxt = s[:, k + 1] + b[:, k + 1]
            go = np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None])
            b[:, k] = np.where(live[:, k + 1, None], go, b[:, k])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None])[:, :, 1] * live
        joint = np.exp(f[:, :-1, :, None] + t + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        gw = np.einsum("rk,rkf->f", (y - p) * live, x) / rows - ridge * w
        gt = (seen_t - joint.sum(axis=(0, 1))) / rows - ridge * t
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        rate = 0.15 / (1 + step / 100)
        w += rate * mw / (1 - 0.9**step) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8)
        t += rate * mt / (1 - 0.9**step) / (np.sqrt(vt / (1 - 0.99**step)) + 1e-8)
    return w, t


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(training_pages())


def viterbi(scores: list[float], t: list[list[float]]) -> list[int]:
    """The likeliest states, where scores are those of state 1 and state 0 has none; a tie goes to state 0."""
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        a1, a2, b1, b2 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
        back.append((int(a2 > a1), int(b2 > b1)))
        a, b = max(a1, a2), max(b1, b2) + s
    state = int(b > a)
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]


def main_text(page: str, w: list[float], t: list[list[float]]) -> str:
    found = blocks(page)
    if not found:
        return ""
    states = viterbi([sum(w[i] for i in features(b)) for b in found], t)
    return " ".join(b[0] for b, s in zip(found, states, strict=True) if s)


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: id, url, text (empty if none), n_chars (its code points).

    A null page counts as empty; repeated rows and null ids are handled like any other; an empty table
    gives an empty result; other columns aren't read. A narrow map with a model of a few hundred numbers,
    which each session trains once on the driver from pages made here, the same every time.
    """
    w, t = (x.tolist() for x in model())
    kind, url = df.schema[id_col].dataType.simpleString(), df.schema[url_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, w, t) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].cast("string").alias("html")).mapInArrow(run, f"id {kind}, url {url}, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op8_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
