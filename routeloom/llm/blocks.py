"""Operator 5: main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks: the text between block-level tags, without head, scripts, styles, forms'
controls and comments; inline tags and line breaks don't end a block.  Each block has a vector of its tag path (hashed
names, classes and ids of the open tags), the hashed counts of all its words, and a few measures (length, share of link
text, depth).
A bidirectional LSTM in numpy reads the whole sequence and labels every block; the blocks of the main text are joined.

The labeller is trained here on pages that a seeded generator writes (layouts of navigation, headers, notices, adverts,
sidebars, comments, forms and footers around an article, in invented words), whose labels are known; the corpus's own
pages are not needed, so the model is the same at every size.

Null and empty pages, and pages without text, give an empty text; unclosed tags end with what encloses them; a tag cut
off at the page's end is dropped; very long pages are read whole; equal pages give equal texts; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import RAW, VOID, Hidden, tokens

#: Buckets of path names and of words.
PATHS, WORDS, MEASURES = 96, 16, 6
HIDDEN = 24
#: Pages that the model is trained on, and rounds over them.
TRAIN_PAGES, ROUNDS = 1400, 5
#: Block vectors that one forward pass holds.
HELD = 60_000

_HIDDEN = frozenset("noscript template select svg object button".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that end an open one of the same kind.
_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _bucket(s: str, n: int) -> int:
    return zlib.crc32(s.encode()) % n


@lru_cache(100_000)
def _word_bucket(s: str) -> int:
    return _bucket(s, WORDS)


@lru_cache(50_000)
def _path_bits(name: str, attrs: str) -> tuple[int, ...]:
    out = [_bucket("<" + name, PATHS)]
    for m in _NAMES.findall(attrs):
        out += [_bucket(w, PATHS) for w in _WORD.findall("".join(m).lower())]
    return tuple(out)


def leaves(page: str) -> tuple[list[str], np.ndarray]:
    """The page's blocks and their vectors."""
    texts: list[str] = []
    rows: list[tuple[tuple[int, ...], float, int, str]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    path: tuple[int, ...] = ()
    parts: list[str] = []
    linked = total = anchors = 0
    hidden = Hidden(_HIDDEN)

    def flush() -> None:
        nonlocal linked, total
        if parts:
            t = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if t:
                texts.append(t)
                rows.append((path, linked / max(total, 1), len(stack), stack[-1][0] if stack else ""))
            parts.clear()
        linked = total = 0

    def add(s: str) -> None:
        nonlocal linked, total
        if s:
            parts.append(s)
            total += len(s)
            linked += len(s) if anchors else 0

    for text, name, closing, attrs in tokens(page):
        if not hidden.open:
            add(text)
        if name is None:
            continue
        if name in RAW and not hidden.open or hidden.passed(name, closing, attrs, [t[0] for t in stack]):
            parts.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                anchors = 0 if closing else 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        anchors = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in VOID:
            ends = _SAME.get(name)
            if ends and stack and stack[-1][0] in ends:
                stack.pop()
                if name == "tr" and stack and stack[-1][0] == "tr":
                    stack.pop()
            stack.append((name, _path_bits(name, attrs)))
        path = tuple(b for _, bits in stack for b in bits)
    flush()
    x = np.zeros((len(texts), PATHS + WORDS + MEASURES), np.float32)
    for i, (bits, share, depth, last) in enumerate(rows):
        for b in bits:
            x[i, b] = 1.0
        t = texts[i]
        w = t.lower().split()
        held = [0] * WORDS
        for k in w:
            held[_word_bucket(k)] += 1
        x[i, PATHS : PATHS + WORDS] = [c / (c + 10) for c in held]
        x[i, PATHS + WORDS :] = (4 * len(t) / (len(t) + 1500), share, depth / 10, 1.0 if t[-1] in ".!?\"'”»…" else 0.0, 2 * len(w) / (len(w) + 30), 1.0 if last[:1] == "h" and last[1:].isdigit() else 0.0)
    return texts, x


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over padded sequences; weights by direction: input and recurrent to four gates, and a bias."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = rng.normal(0, 0.2, (width, 4 * hidden)).astype(np.float32)
            self.p[d + "h"] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            self.p[d + "b"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, (2 * hidden + width, 1)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list | None) -> np.ndarray:
        """Hidden states, (steps, pages, hidden); steps beyond a page's end leave its state as it is."""
        steps, n, _ = x.shape
        z = x @ self.p[d + "x"] + self.p[d + "b"]
        h, c = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out = np.zeros((steps, n, self.h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[d + "h"]
            i, f, o = (_sigmoid(a[:, k * self.h : (k + 1) * self.h]) for k in range(3))
            g = np.tanh(a[:, 3 * self.h :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        both = [self._run(x, mask, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"]
        s = np.concatenate([*both, x], 2)
        if kept is not None:
            kept["s"] = s
        return _sigmoid((s @ self.p["o"])[..., 0] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        p = self.scores(x, mask, kept)
        e = ((p - y) * mask / max(1, mask.sum()))[..., None].astype(np.float32)
        s = kept["s"]
        g = {"o": s.reshape(-1, s.shape[2]).T @ e.reshape(-1, 1), "c": e.sum((0, 1))}
        back = e @ self.p["o"].T
        for k, d in enumerate("fb"):
            up = back[..., k * self.h : (k + 1) * self.h]
            dz = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
            dh_next, dc_next = np.zeros_like(up[0]), np.zeros_like(up[0])
            gh = np.zeros_like(self.p[d + "h"])
            for t, h, c, i, f, o, gg, tc, m in reversed(kept[d]):
                dh = up[t] + dh_next
                own = np.where(m, dh, 0)
                dc = np.where(m, dc_next + own * o * (1 - tc * tc), 0)
                a = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), own * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dz[t] = a
                gh += h.T @ a
                dh_next = a @ self.p[d + "h"].T + np.where(m, 0, dh)
                dc_next = np.where(m, dc * f, dc_next)
            g[d + "x"] = x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * self.h)
            g[d + "h"], g[d + "b"] = gh, dz.sum((0, 1))
        return g


def padded(seqs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(s) for s in seqs), default=0)
    x, mask = np.zeros((steps, len(seqs), width), np.float32), np.zeros((steps, len(seqs)), bool)
    for i, s in enumerate(seqs):
        x[: len(s), i] = s
        mask[: len(s), i] = True
    return x, mask


# ---------------------------------------------------------------- training pages


def invented_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    syllables = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 2)) for _ in range(30)]
    serial = iter(range(10**6))

    def words(n: int) -> str:
        w = ["".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
        return (" ".join(w)).capitalize() + f" {next(serial)}x"

    def prose(lo: int, hi: int) -> str:
        return ". ".join(words(int(rng.integers(3, 12))) for _ in range(int(rng.integers(lo, hi)))) + "."

    main: set[str] = set()

    def keep(t: str) -> str:
        main.add(t)
        return t

    def wrap(tag: str, body: str, names: tuple[str, ...] = ()) -> str:
        a = f' {pick("class", "class", "id")}="{pick(*names)}"' if names and rng.random() < 0.9 else ""
        return f"<{tag}{a}>{body}</{tag}>"

    def links(n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{next(serial)}'>{words(int(rng.integers(1, 4)))}</a></{tag}>" for _ in range(n))

    def nav() -> str:
        return pick(wrap("nav", f"<ul>{links(int(rng.integers(3, 8)))}</ul>", ("nav", "menu", "navbar", "main-nav", "breadcrumb")), wrap("nav", f"<ul>{links(5)}</ul>"), wrap("div", f"<ul>{links(6)}</ul>", ("menu", "nav", "navigation", "breadcrumbs", "topbar")), wrap("ul", links(5), ("menu", "nav", "tabs")))

    def ad() -> str:
        return wrap(pick("div", "div", "aside", "section"), pick(prose(1, 3), f"<p>{prose(1, 3)}</p>"), ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "advertisement"))

    def notice() -> str:
        return wrap(pick("div", "section", "p"), prose(1, 3), ("notice", "cookie", "cookie-notice", "consent", "alert", "cookie-banner", "gdpr", "newsletter", "subscribe"))

    def side() -> str:
        return wrap(pick("aside", "aside", "div"), f"<h3>{words(2)}</h3>" + pick(f"<ul>{links(4)}</ul>", f"<p>{prose(1, 4)}</p>", f"<p>{prose(1, 2)}</p><ul>{links(3)}</ul>"), ("sidebar", "related", "widget", "side", "recommended", "trending"))

    def comments() -> str:
        each = "".join(wrap(pick("div", "li", "p", "article"), pick("", f"<b>{words(1)}</b>: ") + prose(1, 4), ("comment", "reply", "comment-body", "response")) for _ in range(int(rng.integers(1, 6))))
        return wrap(pick("section", "div", "ol"), pick("", f"<h2>{words(2)}</h2>") + each, ("comments", "comment-list", "responses", "discussion", "replies"))

    def form() -> str:
        return wrap("form", f"<label>{words(2)}</label><input name=q><p>{words(4)}</p>", ("search", "login", "subscribe", "contact"))

    def paragraph() -> str:
        t = keep(prose(1, 7) if rng.random() < 0.85 else words(int(rng.integers(1, 6))) + ".")
        kind = rng.random()
        if kind < 0.12 and " " in t:
            a, b = t.split(" ", 1)
            return f"<p><b>{a}</b> {b}</p>"
        if kind < 0.22:
            return f"<p><b>{t}<br>"
        if kind < 0.3:
            return f"<p><a href='/x'>{t[:8]}</a>{t[8:]}"
        return f"<p>{t}</p>"

    def extra() -> str:
        return pick(f"<h2>{keep(words(3))}</h2>", f"<blockquote>{keep(prose(1, 3))}</blockquote>", "<ul>" + "".join(f"<li>{keep(prose(1, 2))}</li>" for _ in range(3)) + "</ul>", f"<h3>{keep(words(2))}</h3>", f"<table><tr><td>{keep(words(2))}</td><td>{keep(words(1))}</td></tr></table>", f"<pre>{keep(prose(1, 2))}</pre>", f"<figure><img src=x><figcaption>{keep(prose(1, 2))}</figcaption></figure>")

    body = f"<h1>{keep(words(int(rng.integers(3, 10))))}</h1>" if rng.random() < 0.85 else ""
    for _ in range(int(rng.integers(1, 14))):
        body += paragraph()
        if rng.random() < 0.15:
            body += extra()
        if rng.random() < 0.1:
            body += pick(ad, notice, side, form)()
    if rng.random() < 0.15:
        body += comments()
    holder = pick("article", "article", "article", "main", "div", "section")
    names = ("content", "article", "post", "entry", "main", "story", "article-body", "post-content", "text") if holder in ("div", "section") or rng.random() < 0.3 else ()
    a = f' {pick("class", "id")}="{pick(*names)}"' if names else ""
    body = f"<{holder}{a}>{body}</{holder}>"
    before = [f() for f in (nav, ad, notice, form, side) if rng.random() < 0.4]
    if rng.random() < 0.5:
        before.insert(0, wrap("header", pick(f"<h1>{words(2)}</h1>", f"<p>{words(3)}</p>", f"<div>{words(2)}</div>") + pick("", nav()), ("header", "site-header", "masthead", "top") if rng.random() < 0.5 else ()))
    if rng.random() < 0.5:
        before.insert(0, nav())
    after = [f() for f in (comments, side, ad, form, notice) if rng.random() < 0.4]
    if rng.random() < 0.85:
        after.append(pick(wrap("footer", pick(f"&copy; {words(2)} &middot; {prose(1, 3)}", f"<p>{prose(1, 3)}</p>", f"<ul>{links(3)}</ul>"), ("footer", "site-footer") if rng.random() < 0.4 else ()), wrap("div", prose(1, 2), ("footer", "copyright", "legal", "foot"))))
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}"
    return page + pick("</body></html>", ""), main


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = 3) -> Labeller:
    """The labeller, trained by Adam on batches of invented pages."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, main = invented_page(rng)
        texts, x = leaves(page)
        data.append((x, np.array([t in main for t in texts], np.float32)))
    width = PATHS + WORDS + MEASURES
    net = Labeller(width)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    for r in range(rounds):
        order = sorted(rng.permutation(pages).tolist(), key=lambda i: len(data[i][0]) // 8)
        batches = [order[i : i + 16] for i in range(0, pages, 16)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[b]], width)
            y = padded([data[i][1][:, None] for i in batches[b]], 1)[0][..., 0]
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - 0.01 * (0.5**r) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: list[str | None], net: Labeller, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    got = [leaves(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, (t, _) in enumerate(got) if t), key=lambda i: len(got[i][0]))
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order) and (end == at or max(longest, len(got[order[end]][0])) * (end - at + 1) <= HELD):
            longest = max(longest, len(got[order[end]][0]))
            end += 1
        own = order[at:end]
        x, mask = padded([got[i][1] for i in own], PATHS + WORDS + MEASURES)
        s = net.scores(x, mask)
        for k, i in enumerate(own):
            out[i] = "\n".join([t for t, p in zip(got[i][0], s[:, k], strict=False) if p >= threshold])
        at = end
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text string, n_chars long) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                c = b.slice(i, 256)
                t = main_texts(c.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return d.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
