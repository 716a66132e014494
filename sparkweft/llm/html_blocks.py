"""Main-text extraction: a recurrent labeller over the leaf blocks of a page.

A page is cut into leaf blocks of text, each with the path of its open elements. A numpy bidirectional LSTM reads the
whole sequence - hashed vectors of path tokens and of words, and a few figures of each block - and classifies every
block with the whole page as context. It is trained on invented pages of many layouts whose labels are known.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style title template noscript textarea iframe svg object select datalist math canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset("p".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Of the unshown ones: those whose content is raw text, so that without an end tag they reach to the end of the page.
RAW = frozenset("script style title textarea iframe".split())

#: A comment, a declaration, or a tag with its attributes. Quotes delimit a value only directly after "=", and only if
#: they are closed; anywhere else they are characters.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>]*+)"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+{_VALUE})*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAMING = frozenset("class id role".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    link_chars: int


# --- pages to blocks ------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tokens that an element adds to the path: its tag and the words of its class, id and role."""
    out = [f"t:{tag}"]
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in _NAMING:
            out += [f"c:{x.lower()}" for x in _PARTS.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


@functools.lru_cache(maxsize=32)
def _same_tags(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def _past(page: str, tag: str, at: int) -> int:
    """Where an unshown element that was opened before `at` ends. Raw text ends at the first end tag or with the page;
    other elements hold elements of their kind, and where no end tag follows they hide nothing."""
    open_ = 1
    for m in _same_tags(tag).finditer(page, at):
        open_ += -1 if m[1] else tag not in RAW and not m[0].endswith("/>")
        if not open_:
            return m.end()
    return len(page) if tag in RAW else at


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space folded; blocks without text are left out.

    Inline elements and line breaks do not end a block, all other tags do. Tags that are not closed, closed twice or
    cut off are borne with; scripts, styles, comments and other unshown parts have no blocks.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, tokens of the path before it
    path: list[str] = []
    text: list[str] = []
    in_link, linked, at, size = 0, 0, 0, len(page)

    def end() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, tuple(path), linked))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        del path[stack[k][1] :]
        del stack[k:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        m = _TOKEN.match(page, start) if start < size else None
        piece = page[at:start] if m or start == size else page[at : start + 1]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not m[4]:  # the page is cut off inside a tag
            break
        if tag == "br":
            text.append(" ")
        elif tag in VOID:
            if tag not in INLINE:
                end()
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif closing:
            end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            in_link = 0
        elif tag in UNSHOWN:
            if not m[3].endswith("/"):
                at = _past(page, tag, at)
        else:
            end()
            in_link = 0
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1) if tag in ITEMS else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ITEMS[tag]:
                    break
            stack.append((tag, len(path)))
            path += _element(tag, m[3])
    end()
    return out


# --- features -------------------------------------------------------------------------------------------------------

PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 2048, 1024, 24, 8, 6, 20


@functools.lru_cache(maxsize=1 << 16)
def _row(token: str, rows: int) -> int:
    return zlib.crc32(token.encode()) % rows


@functools.lru_cache(maxsize=1 << 14)
def _path_rows(path: tuple[str, ...]) -> np.ndarray:
    return np.array([_row(t, PATH_ROWS) for t in (path or ("t:",))])


def _words(text: str) -> list[int]:
    return [zlib.crc32(w.encode()) % WORD_ROWS for w in text.lower().split()]


def describe(page: list[Block]) -> tuple[list[np.ndarray], list[list[int]], np.ndarray]:
    """For every block: rows of its path tokens, rows of its words, and figures of the block."""
    n = len(page)
    figures = np.empty((n, FIGURES), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        stops = b.text.count(".") + b.text.count(",")
        figures[i] = (np.log1p(size) / 5, min(1.0, b.link_chars / size), min(1.0, 10 * stops / size), i / n, (n - i) / n, float(b.text[-1] in ".!?:\"'"))
    return [_path_rows(b.path) for b in page], [_words(b.text) for b in page], figures


# --- the network ----------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights by name; each direction d has x_d (inputs), h_d (state) and b_d for the four gates."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        size = PATH_DIM + WORD_DIM + FIGURES
        w = {"path": rng.normal(0, 0.3, (PATH_ROWS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            w |= {f"x{d}": rng.normal(0, 0.2, (size, 4 * HIDDEN)), f"h{d}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, dict]:
        """(longest, pages, size) inputs, lengths, and what the way back needs."""
        lengths = np.array([len(p[2]) for p in pages])
        flat = [np.concatenate([np.asarray(x[k][i]) for x in pages for i in range(len(x[2]))]).astype(np.int64) for k in (0, 1)]
        counts = [np.array([len(x[k][i]) for x in pages for i in range(len(x[2]))]) for k in (0, 1)]
        means = []
        for rows, n, name in zip(flat, counts, ("path", "word"), strict=True):
            starts = np.cumsum(n) - n
            total = np.add.reduceat(self.w[name][rows], starts, axis=0)
            means.append(total / np.sqrt(n)[:, None].astype(np.float32))
        each = np.concatenate([*means, np.concatenate([p[2] for p in pages])], axis=1)
        where = np.repeat(np.arange(len(pages)), lengths), np.concatenate([np.arange(n) for n in lengths])
        x = np.zeros((lengths.max(), len(pages), each.shape[1]), np.float32)
        x[where[1], where[0]] = each
        return x, lengths, {"flat": flat, "counts": counts, "where": where}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        gates = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        hs, kept = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)):
            g = gates[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            kept.append((i, f, o, u, before, was, tc))
        return hs, kept

    def _back(self, x: np.ndarray, d: str, kept: list, dhs: np.ndarray, grad: dict) -> np.ndarray:
        dgates = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        wh = self.w[f"h{d}"]
        grad[f"h{d}"] = np.zeros_like(wh)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u, before, was, tc = kept[t]
            dh = dh + dhs[t]
            dc = dc + dh * o * (1 - tc * tc)
            g = dgates[t]
            g[:, :HIDDEN] = dc * u * i * (1 - i)
            g[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            g[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            g[:, 3 * HIDDEN :] = dc * i * (1 - u * u)
            grad[f"h{d}"] += was.T @ g
            dh, dc = g @ wh.T, dc * f
        grad[f"x{d}"] = np.einsum("tbi,tbj->ij", x, dgates, optimize=True)
        grad[f"b{d}"] = dgates.sum(axis=(0, 1))
        return dgates @ self.w[f"x{d}"].T

    @staticmethod
    def _turned(lengths: np.ndarray, longest: int) -> np.ndarray:
        """Times in reverse for each page; its filling stays behind its blocks."""
        t = np.arange(longest)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def forward(self, pages: list[tuple]) -> tuple[np.ndarray, tuple]:
        x, lengths, how = self.inputs(pages)
        turn = self._turned(lengths, len(x))
        columns = np.arange(len(pages))
        xb = x[turn, columns]
        hf, kf = self._run(x, "f")
        hb, kb = self._run(xb, "b")
        h = np.concatenate([hf, hb[turn, columns]], axis=2)
        z = h @ self.w["out"] + self.w["bias"]
        return z, (x, xb, lengths, how, turn, columns, kf, kb, h)

    def gradient(self, pages: list[tuple], labels: list[np.ndarray]) -> tuple[float, dict]:
        z, (x, xb, lengths, how, turn, columns, kf, kb, h) = self.forward(pages)
        real = np.arange(len(x))[:, None] < lengths
        y = np.zeros(z.shape, np.float32)
        y[how["where"][1], how["where"][0]] = np.concatenate(labels)
        p = _sigmoid(z)
        dz = (np.where(real, p - y, 0) / real.sum()).astype(np.float32)
        loss = -float(np.where(real, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / real.sum())
        grad = {"out": np.einsum("tb,tbh->h", dz, h), "bias": np.array([dz.sum()], np.float32)}
        dh = dz[:, :, None] * self.w["out"]
        dx = self._back(x, "f", kf, dh[:, :, :HIDDEN], grad)
        dx += self._back(xb, "b", kb, dh[:, :, HIDDEN:][turn, columns], grad)[turn, columns]
        each = dx[how["where"][1], how["where"][0]]
        for rows, n, name, part in zip(how["flat"], how["counts"], ("path", "word"), (each[:, :PATH_DIM], each[:, PATH_DIM : PATH_DIM + WORD_DIM]), strict=True):
            grad[name] = np.zeros_like(self.w[name])
            np.add.at(grad[name], rows, np.repeat(part / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
        return loss, grad

    def keep(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages are read in groups of like length, whole."""
        out = [np.zeros(0, bool) for _ in pages]
        todo = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while todo:
            longest = len(pages[todo[-1]])
            some = todo[-max(1, min(512, 1 << 14) // longest) :] if longest < 1 << 14 else todo[-1:]
            todo = todo[: -len(some)]
            z, _ = self.forward([describe(pages[i]) for i in some])
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k] > 0
        return out


# --- training -------------------------------------------------------------------------------------------------------

PAGES, STEPS, BATCH, SEED = 1500, 700, 48, 7
_SYLLABLES = "an be co de el fa ge hi in jo ka li mo na or pe qui ra se ti um va wen zo ber lich tion ment eau ción ar th".split()


class _Writer:
    """Invented pages: a list of (html, label) pieces; text of label None is never shown."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.html, self.truth = rng, [], []

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        out = ["".join(_SYLLABLES[i] for i in self.rng.integers(len(_SYLLABLES), size=self.rng.integers(1, 4))) for _ in range(max(1, n))]
        if self.rng.random() < 0.15:
            out = [w + self.pick("***", "$$$", "%%%", "&amp;&amp;&amp;", "!!") for w in out]
        return " ".join(out).capitalize()

    def sentence(self, low: int = 1, high: int = 60) -> str:
        s = self.words(low, high)
        return s if self.rng.random() < 0.1 else s.replace(" ", ", ", 1) + self.pick(".", ".", ".", "!", "?") if self.rng.random() < 0.3 else s + "."

    def leaf(self, label: int, tag: str, text: str) -> None:
        self.html.append(f"<{tag}>{text}</{tag.split()[0]}>")
        self.truth += [label] * len(blocks(self.html[-1]))

    def open(self, tag: str, *names: str) -> str:
        name = self.pick(*names) if names else ""
        attribute = "" if not name else f' {self.pick("class", "class", "class", "id")}="{name}"' + (f' id="{self.pick(*names)}"' if self.rng.random() < 0.2 else "")
        self.html.append(f"<{tag}{attribute}>")
        return f"</{tag}>"

    def list(self, label: int, links: bool, low: int, high: int, most: int = 4) -> None:
        self.html.append("<ul>")
        for _ in range(self.rng.integers(low, high)):
            t = self.words(1, most)
            self.leaf(label, "li", f'<a href="/{len(self.html)}">{t}</a>' if links else t)
        self.html.append("</ul>")

    def chrome(self, what: str) -> None:
        r, leaf = self.rng, self.leaf
        if what == "nav":
            end = self.open("nav", *([""] * 4), "menu", "main-nav", "breadcrumb") if r.random() < 0.6 else self.open(self.pick("div", "section", "td"), "nav", "menu", "navigation", "topnav", "navbar", "breadcrumbs", "main-menu", "site-nav", "toc", "pagination")
            self.list(0, r.random() < 0.95, 1, 9) if r.random() < 0.8 else leaf(0, self.pick("p", "div"), " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.integers(2, 6))))
        elif what == "header":
            end = self.open("header", *([""] * 3), "site-header", "page-header") if r.random() < 0.6 else self.open("div", "header", "masthead", "site-header", "top", "topbar", "branding", "page-header", "logo")
            leaf(0, self.pick("h1", "h2", "p", "div"), self.pick("<a href='/'>", "") + self.words(1, 6))
            if r.random() < 0.4:
                leaf(0, self.pick("p", "span", "div"), self.sentence(2, 14))
            if r.random() < 0.4:
                self.chrome("nav")
        elif what == "ad":
            end = self.open(self.pick("div", "div", "aside", "section", "ins"), "ad", "ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "sponsor", "adsbygoogle", "ad-banner", "advert-box", "promoted")
            self.html.append(t := self.sentence(1, 30)) if r.random() < 0.6 else leaf(0, self.pick("p", "a", "h3"), t := self.sentence(1, 30))
            if self.html[-1] == t:
                self.truth.append(0)
        elif what == "notice":
            end = self.open(self.pick("div", "section", "aside", "p"), "notice", "cookie", "cookie-notice", "cookies", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "warning", "cookie-banner", "announcement", "newsletter", "paywall", "message")
            self.html.append(t := self.pick("We use cookies. ", "Accept ", "Subscribe now ", "", "") + self.sentence(2, 40))
            self.truth.append(0)
        elif what == "sidebar":
            end = self.open("aside", *([""] * 3), "sidebar", "related") if r.random() < 0.5 else self.open(self.pick("div", "section"), "sidebar", "side", "widget", "related", "recent-posts", "right-column", "rail", "trending", "popular", "recommended", "read-more", "archive", "tags")
            leaf(0, self.pick("h2", "h3", "h4", "p"), self.words(1, 5))
            self.list(0, r.random() < 0.7, 1, 7, 8) if r.random() < 0.6 else [leaf(0, "p", self.sentence(3, 50)) for _ in range(r.integers(1, 4))]
        elif what == "form":
            end = self.open("form", *([""] * 4), "search", "login", "subscribe", "contact-form", "signup")
            for _ in range(r.integers(1, 4)):
                leaf(0, self.pick("p", "div", "h3", "button", "fieldset", "legend"), self.pick("<label>", "") + self.words(1, 12) + self.pick('<input name="q">', ""))
            leaf(0, "button", self.words(1, 2))
        elif what == "comments":
            end = self.open(self.pick("section", "div", "div", "ol", "aside"), "comments", "comment-list", "comment-section", "reader-comments", "discussion", "responses", "disqus", "replies", "feedback", "comments-area")
            if r.random() < 0.6:
                leaf(0, self.pick("h2", "h3"), self.pick("Comments", "3 comments", "Leave a reply", self.words(1, 3)))
            for _ in range(r.integers(1, 6)):
                inner = self.open(self.pick("div", "article", "li", "section"), "", "comment", "comment", "reply", "comment-body", "response") if r.random() < 0.8 else ""
                if r.random() < 0.4:
                    leaf(0, self.pick("h4", "div", "p", "cite"), self.words(1, 3))
                leaf(0, self.pick("p", "p", "div", "blockquote"), self.sentence(2, 80))
                self.html.append(inner)
        elif what == "share":
            end = self.open(self.pick("div", "ul", "p"), "share", "social", "sharing", "social-links", "share-buttons", "follow", "print", "tools")
            leaf(0, self.pick("span", "div", "li"), " ".join(f'<a href="#">{self.words(1, 1)}</a>' for _ in range(r.integers(1, 5))))
        else:
            end = self.open("footer", *([""] * 4), "site-footer") if r.random() < 0.65 else self.open("div", "footer", "site-footer", "copyright", "bottom", "footer-links", "legal", "credits", "colophon")
            if r.random() < 0.3:
                self.list(0, True, 1, 6)
            self.html.append("&copy; " * (r.random() < 0.5) + self.words(1, 4) + self.pick(" &middot; ", " - ", ". ") + self.sentence(1, 25))
            self.truth.append(0)
        self.html.append(end)

    def body(self) -> None:
        r, leaf = self.rng, self.leaf
        if r.random() < 0.75:
            tag = self.pick("p", "h2", "h1", "h3")
            title = self.words(1, 12)
            wrapped = self.open("header", "", "entry-header", "article-header") if r.random() < 0.12 else ""
            leaf(1, self.pick("h1", "h1", "h1", "h2"), title)
            self.html.append(wrapped)
            if r.random() < 0.3:  # a bold first line, paragraphs that are not closed
                self.html.append(f"<p><b>{title}{self.sentence(1, 30)}<br>" if r.random() < 0.6 else f"<p><b>{self.sentence(1, 3)}<br>")
                self.truth.append(1)
        for _ in range(r.integers(1, 12)):
            at = r.random()
            if at < 0.7:
                text = self.sentence(1, 120)
                if r.random() < 0.2:
                    text = text.replace(" ", f' <a href="/x">{self.words(1, 3)}</a> ', 1)
                leaf(1, "p", text)
            elif at < 0.78:
                leaf(1, self.pick("h2", "h3", "h4"), self.words(1, 9))
            elif at < 0.84:
                self.list(1, r.random() < 0.15, 1, 6, 15)
            elif at < 0.9:
                leaf(1, self.pick("blockquote", "pre", "figcaption", "div", "dd", "section", "td"), self.sentence(1, 50))
            elif at < 0.93:
                self.html.append(f"<p><b>{self.sentence(1, 3)}<br>")
                self.truth.append(1)
            elif r.random() < 0.6:
                self.chrome(self.pick("ad", "ad", "sidebar", "share", "notice", "form"))

    def page(self) -> tuple[str, np.ndarray]:
        r = self.rng
        self.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>'</script></head><body>")
        outer = self.open("div", "", "wrapper", "container", "page", "site", "layout") if r.random() < 0.35 else ""
        top = [x for x, p in (("header", 0.45), ("nav", 0.7), ("notice", 0.25), ("ad", 0.45), ("form", 0.12), ("sidebar", 0.15)) if r.random() < p]
        for i in r.permutation(len(top)):
            self.chrome(top[i])
        ends = []
        if r.random() < 0.3:
            ends.append(self.open(self.pick("main", "div", "section"), "", "main", "content", "page-content", "column"))
        if r.random() < 0.85:
            ends.append(self.open("article", *([""] * 6), "post", "story", "entry") if r.random() < 0.55 else self.open(self.pick("div", "section", "main", "td"), "content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "article", "text", "body-text", "post-content", "page-content"))
        self.body()
        inside = r.random() < 0.25
        after = [x for x, p in (("share", 0.2), ("comments", 0.4), ("sidebar", 0.35), ("ad", 0.2), ("form", 0.15), ("nav", 0.1), ("notice", 0.1)) if r.random() < p]
        for k, i in enumerate(r.permutation(len(after))):
            if ends and not (inside and not k):
                self.html += ends[::-1]
                ends = []
            self.chrome(after[i])
        self.html += ends[::-1]
        if r.random() < 0.8:
            self.chrome("footer")
        self.html.append(outer + ("</body></html>" if r.random() < 0.9 else ""))
        return "".join(self.html), np.array(self.truth, np.float32)


def invented_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """n pages with a label for each of their blocks."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        page, truth = _Writer(rng).page()
        found = blocks(page)
        if len(found) == len(truth):
            out.append((found, truth))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, steps: int = STEPS, seed: int = SEED) -> Labeller:
    """A labeller trained by Adam on invented pages: the same weights for the same parameters."""
    rng = np.random.default_rng(seed)
    data = [(describe(b), y) for b, y in invented_pages(pages, seed)]
    data.sort(key=lambda d: len(d[1]))
    model = Labeller.fresh(rng)
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, max(1, len(data) - BATCH))
        some = data[at : at + BATCH]  # neighbours: pages of like length
        # Figures and words are blurred, so that the layout decides where it can.
        blurred = [(d[0], d[1], d[2] * rng.normal(1, 0.3, d[2].shape).astype(np.float32) if rng.random() < 0.7 else 0 * d[2]) for d, _ in some]
        _, grad = model.gradient(blurred, [y for _, y in some])
        rate = 0.02 * min(1.0, 2 * (1 - step / steps) + 0.02)
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            model.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


# --- DataFrames -----------------------------------------------------------------------------------------------------


def main_text(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page: its kept blocks joined by line ends; empty for null, empty and text-less pages."""
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, k in zip(bs, keep, strict=True) if k) for bs, keep in zip(found, model.keep(found), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row, repeated rows too; a null html gives an empty text.

    Pages are read whole whatever their length: the memory of a page goes with its blocks. An empty table gives an
    empty one; other columns, whatever their names, take no part.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def work(ids: list, urls: list, html_: list) -> list:
        out: list[str] = []
        for k in range(0, len(html_), 256):
            out += main_text(html_[k : k + 256], shared.value)
        return [ids, urls, out, [len(x) for x in out]]

    kinds = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}
    return by_batch(pages.select(F.col("page_id").cast("long"), "url", "html"), kinds, "page_id long, url string, text string, n_chars long", work)
