"""Operator 9: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is lower-cased and folded (accents, look-alike digits and signs) to a small alphabet, letters of other scripts by
their code point to one of its 26 letters; its units are the words
without punctuation at their ends (where some stands inside also without it, whatever their length), runs of three or more single letters joined, and, of units over LONG letters,
overlapping windows.  The kernel of two units counts their common subsequences of three letters, each occurrence weighed
by DECAY to the power of the letters it skips (SPAN letters from first to last at most), divided by a norm of both
lengths.  An insult with inserted letters or gaps keeps most of its subsequences, and so does a new ending of a known stem.

Training takes labelled documents of a bounded sample (SAMPLE_ROWS rows).  A document is as toxic as its worst sentence,
a sentence as its worst unit.  Positives are units of toxic documents alone that together
explain most of them, later also the worst unit of each toxic document without one, and copies of them with inserted letters; negatives are units of
clean documents: at first a random draw of DRAWN, then by active sets all whose margin counts (above -1), in ROUNDS rounds or
until none is new.  A linear support vector machine is fitted on Nystroem features of landmarks from both.  A logistic
curve maps a document's margin to its score.

Because the fitted function is a sum over subsequences, the landmarks' weights are folded into one table of subsequence
weights, so scoring a text of n letters takes n times a constant.  Whole texts are scored.

Null and empty texts have no unit and get the margin of no evidence; repeated rows get equal scores; without training
rows of both labels every text gets the share of toxic rows; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, mixed, passes, text_bytes

SAMPLE_ROWS = 6000
ROUNDS = 4
#: Clean units that training begins with; and units that stand in for signs of toxicity where rows are too few for counts.
DRAWN, GUESSED = 1500, 50
#: What a positive unit weighs, in negative ones.
PULL = 5.0
LANDMARKS = 384
DECAY = 0.7
SPAN = 7
LONG = 24
THRESHOLD = 0.3
#: Classes: 0 ends a unit, 1..26 letters (of any script), 27 other digits, 28 inner punctuation, 29 other characters.
KINDS = 30

_CLASS = np.full(256, 28, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0x30:0x3A] = 27
_CLASS[0x80:] = 29
for _a, _b in zip("013457$@", "oieastsa", strict=True):
    _CLASS[ord(_a)] = ord(_b) - 96
#: Second bytes of U+00C0..U+00FF as their base letters.
_ACCENT = np.full(256, 29, np.uint8)
for _i in range(0xC0, 0x100):
    _ACCENT[_i - 0x40] = ord("aaaaaaaceeeeiiiidnooooo.ouuuuytsaaaaaaaceeeeiiiidnooooo.ouuuuyty"[_i - 0xC0]) - 96 if chr(_i) not in "×÷" else 28


@cache
def _other_classes() -> np.ndarray:
    """By code point the classes of what is neither ASCII nor in U+0080..U+00FF."""
    out = np.full(0x110000, 29, np.uint8)
    for i in range(0x100, 0x20000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Nd":
            out[i] = 27
        elif kind[0] == "L" or kind[0] == "M" and i > 0x36F:
            low = c.lower()[0]
            parts = unicodedata.normalize("NFKD", low)
            if all(unicodedata.combining(x) for x in parts[1:]):
                low = parts[0].lower()
            out[i] = ord(low) - 96 if "a" <= low <= "z" else ord(low) % 26 + 1
    han = np.arange(0x20000, 0x40000)  # planes of ideographs
    out[han] = han % 26 + 1
    return out


_OFFSETS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def _norms() -> np.ndarray:
    """By length: the root of the sum of squared weights of all subsequences of a unit, counted by occurrence."""
    out = np.ones(LONG + 1)
    for n in range(3, LONG + 1):
        out[n] = np.sqrt(sum(max(0, n - a - b) * DECAY ** (2 * (a + b - 2)) for a, b in _OFFSETS))
    out[:5] = out[5]  # a unit of three or four letters is little evidence
    return out


_NORM = _norms()


def folded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the characters, the byte at which each begins, and the row ends among them; rows end in a 0."""
    c = _CLASS[buf]
    lead = buf == 0xC3
    after = np.zeros(len(buf), bool)
    after[1:] = lead[:-1]
    c[after] = _ACCENT[buf[after]]
    wide = np.flatnonzero(buf >= 0xC4)
    if len(wide):
        size = 2 + (buf[wide] >= 0xE0) + (buf[wide] >= 0xF0).astype(np.int64)
        point = buf[wide] & (0x7F >> size)
        point = point.astype(np.int64)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | buf[wide[more] + k] & 0x3F
        c[wide] = _other_classes()[point]
    keep = ~lead & ~((buf >= 0x80) & (buf < 0xC0) & ~after)
    place = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    ends = place[off] + np.arange(len(off))
    out = np.zeros(int(ends[-1]) + 1, np.uint8)
    at = np.flatnonzero(keep)
    row = np.searchsorted(off, at, "right") - 1
    to = place[at] + row
    out[to] = c[at]
    where = np.zeros(len(out), np.int64)
    where[to] = at - after[at]
    return out, where, ends


@dataclass
class Units:
    """Units as spans of one class array, with the row and the byte of each."""

    cls: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    byte: np.ndarray


def units_of(buf: np.ndarray, off: np.ndarray) -> Units:
    c, where, row_ends = folded(buf, off)
    inside = c > 0
    before = np.zeros(len(c), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(c), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    # without punctuation at the ends
    solid = np.flatnonzero((c > 0) & (c != 28))
    a = np.searchsorted(solid, starts)
    z = np.searchsorted(solid, ends) - 1
    ok = z >= a
    starts, ends = solid[a[ok]], solid[z[ok]] + 1
    edge = np.zeros(len(c) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    c[np.cumsum(edge[:-1], dtype=np.int8) == 0] = 0  # what was cut off belongs to no unit
    row = np.searchsorted(row_ends, starts, "right") - 1
    byte = where[starts]
    size = ends - starts
    # units without their inner punctuation, and runs of single letters, joined behind the array
    one = np.flatnonzero((size == 1) & (c[starts] <= 26)) if len(starts) else np.zeros(0, np.int64)
    extra, s2, e2, r2, b2, total = [c], [], [], [], [], len(c)
    signs = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c == 28, out=signs[1:])
    for i in np.flatnonzero(signs[ends] > signs[starts]):
        own = c[starts[i] : ends[i]]
        own = own[own != 28]
        extra += [own, np.zeros(1, np.uint8)]
        s2.append(total)
        e2.append(total + len(own))
        r2.append(row[i])
        b2.append(byte[i])
        total += len(own) + 1
    if len(one) > 2:
        cut = np.flatnonzero((np.diff(one) != 1) | (np.diff(row[one]) != 0)) + 1
        edges = np.concatenate([[0], cut, [len(one)]])
        for i in np.flatnonzero(np.diff(edges) > 2):
            run = one[edges[i] : edges[i + 1]]
            extra += [c[starts[run]], np.zeros(1, np.uint8)]
            s2.append(total)
            e2.append(total + len(run))
            r2.append(row[run[0]])
            b2.append(byte[run[0]])
            total += len(run) + 1
    starts, ends = np.concatenate([starts, np.array(s2, np.int64)]), np.concatenate([ends, np.array(e2, np.int64)])
    row, byte = np.concatenate([row, np.array(r2, np.int64)]), np.concatenate([byte, np.array(b2, np.int64)])
    big = ends - starts > LONG
    if big.any():
        ws, we, wr, wb = [starts[~big]], [ends[~big]], [row[~big]], [byte[~big]]
        for i in np.flatnonzero(big):
            s = np.arange(starts[i], ends[i] - LONG // 2, LONG // 2)
            ws.append(s)
            we.append(np.minimum(s + LONG, ends[i]))
            wr.append(np.full(len(s), row[i]))
            wb.append(np.full(len(s), byte[i]))
        starts, ends, row, byte = (np.concatenate(x) for x in (ws, we, wr, wb))
    return Units(np.concatenate(extra), starts, ends, row, byte)


def margins(u: Units, table: np.ndarray) -> np.ndarray:
    """For each unit the sum of the table's weights over its subsequences, over the norm of its length."""
    c = u.cls.astype(np.int32)
    run = np.cumsum(c == 0)
    acc = np.zeros(len(c) + 1)
    for a, b in _OFFSETS:
        n = len(c) - a - b
        if n > 0:
            w = table[(c[:n] * KINDS + c[a : a + n]) * KINDS + c[a + b : a + b + n]] * DECAY ** (a + b - 2)
            w[run[:n] != run[a + b : a + b + n]] = 0
            acc[1 : n + 1] += w
    total = np.cumsum(acc)
    return (total[u.ends] - total[u.starts]) / _NORM[np.minimum(u.ends - u.starts, LONG)]


#: Units whose subsequences are held at once while a model is fitted.
HELD = 4096


class Sparse:
    """The vectors of some units over all subsequences, over their norms: entries of (unit, subsequence, weight)."""

    def __init__(self, units: list[bytes]):
        lens = np.array([len(u) for u in units], np.int64)
        if len(lens) and lens.max() > LONG:
            raise ValueError("a unit of more than LONG letters")
        self.n = len(units)
        c = np.frombuffer(b"".join(u + b"\0" for u in units), np.uint8).astype(np.int32)
        unit = np.repeat(np.arange(self.n, dtype=np.int32), lens + 1)
        norm = _NORM[lens]
        own, at, val = [], [], []
        for a, b in _OFFSETS:
            n = max(0, len(c) - a - b)
            ok = np.flatnonzero((unit[:n] == unit[a + b :]) & (c[a + b :] > 0))
            own.append(unit[ok])
            at.append((c[ok] * KINDS + c[ok + a]) * KINDS + c[ok + a + b])
            val.append(DECAY ** (a + b - 2) / norm[unit[ok]])
        self.own, self.at, self.val = np.concatenate(own), np.concatenate(at), np.concatenate(val)

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Each unit times a table of weights."""
        return np.bincount(self.own, table[self.at] * self.val, self.n)


def dense(unit: bytes) -> np.ndarray:
    s = Sparse([unit])
    return np.bincount(s.at, s.val, KINDS**3)


def products(units: list[bytes], tables: list[np.ndarray], out: np.ndarray) -> None:
    """Units times tables into `out`, HELD units at a time."""
    for i in range(0, len(units), HELD):
        s = Sparse(units[i : i + HELD])
        for k, t in enumerate(tables):
            out[i : i + HELD, k] = s.dot(t)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, by Newton's method.

    A positive row weighs as PULL negative ones, rows of a class as `weight` says: what a row weighs doesn't change as
    more of the other class come in.
    """
    cost = c * weight * np.where(y > 0, PULL, 1.0)
    ridge = np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1] + 1)

    def parts():
        for i in range(0, len(x), HELD):
            own = slice(i, i + HELD)
            yield np.hstack([x[own], np.ones((len(x[own]), 1))]), y[own], cost[own]

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w / 2 + sum((k * np.maximum(0, 1 - t * (z @ w)) ** 2).sum() for z, t, k in parts()))

    now = loss(w)
    for _ in range(rounds):
        g, h = ridge @ w, ridge.copy()
        for z, t, k in parts():
            gap = 1 - t * (z @ w)
            on = gap > 0
            zs = z[on]
            g -= 2 * zs.T @ (k[on] * t[on] * gap[on])
            h += 2 * (zs * k[on, None]).T @ zs
        step = np.linalg.solve(h, g)
        t = 1.0
        while (new := loss(w - t * step)) > now - 1e-4 * t * float(g @ step) and t > 1e-6:
            t /= 2
        w = w - t * step
        if now - new < 1e-7 * now:
            break
        now = new
    return w


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        u = units_of(buf, off)
        worst = np.full(len(off) - 1, -1.0)
        np.maximum.at(worst, u.row, np.maximum(-1.0, margins(u, self.table) + self.bias))
        return self.curve(worst)

    def curve(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _inserted(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """The unit with one or two letters put in, and with a sign between all letters; long copies as windows."""
    out = []
    for n in (1, 2):
        u = bytearray(unit)
        for _ in range(n):
            u.insert(int(rng.integers(1, len(u))), int(rng.choice([28, int(rng.integers(1, 27))])))
        out.append(bytes(u))
    out.append(bytes(28 if i % 2 else unit[i // 2] for i in range(2 * len(unit) - 1)))
    return [u[s : s + LONG] for u in out for s in windows(0, len(u))]


def windows(start: int, end: int) -> list[int]:
    """Where the windows of a unit begin: it is one itself, or each overlaps the next by half."""
    return [start] if end - start <= LONG else list(range(start, end - LONG // 2, LONG // 2))


def train(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Fits the model on documents and their labels."""
    y = np.array([int(x or 0) for x in labels], bool)
    if not len(y) or y.all() or not y.any():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(KINDS**3), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    buf, off = text_bytes(pa.array(texts, pa.string()))
    names: dict[bytes, int] = {}
    word, doc = [], []
    for i, j in passes(off, 1 << 18):
        u = units_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        raw = u.cls.tobytes()
        which = np.array([names.setdefault(raw[s:e], len(names)) for s, e in zip(u.starts, u.ends, strict=True)], np.int64)
        pairs = np.unique(which * np.int64(j - i) + u.row)
        word.append(pairs // (j - i))
        doc.append(pairs % (j - i) + i)
    word, doc = np.concatenate(word).astype(np.int32), np.concatenate(doc).astype(np.int32)
    words = list(names)
    del names, buf
    usable = np.array([len(w) >= 3 for w in words], bool)
    pos, neg = (np.bincount(word[y[doc] == k], minlength=len(words)) for k in (True, False))
    # every distinct unit once, end to end, so that a table scores all of them together
    lens = np.array([len(w) + 1 for w in words], np.int64)
    flat = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8)
    ends = np.cumsum(lens) - 1

    def all_margins(model: Model) -> np.ndarray:
        """The margins of all distinct units, a bounded number of letters at a time."""
        out = np.full(len(words), -1.0)
        for i, j in passes(np.concatenate([[0], ends + 1]), 1 << 17):
            a = ends[i] - lens[i] + 1
            some = Units(flat[a : ends[j - 1] + 1], ends[i:j] - lens[i:j] + 1 - a, ends[i:j] - a, np.arange(i, j), np.arange(i, j))
            out[i:j] = margins(some, model.table) + model.bias
        return np.where(usable, out, -1.0)

    clean = np.flatnonzero((neg > 0) & usable)
    # near copies count once: documents that agree in four smallest units, by any of six sets of orders, are one group
    order = np.argsort(doc, kind="stable")
    heads = np.flatnonzero(np.diff(doc[order], prepend=-1))
    group = np.arange(len(y))
    for k in range(6):
        key = np.zeros(len(y), np.uint64)
        for z in range(4):
            mark = mixed(np.arange(len(words), dtype=np.uint64) + np.uint64((4 * k + z) << 40))
            key[doc[order][heads]] = mixed(key[doc[order][heads]] * np.uint64(31) + np.minimum.reduceat(mark[word[order]], heads))
        key[np.setdiff1d(np.arange(len(y)), doc)] = np.arange(len(y), dtype=np.uint64)[np.setdiff1d(np.arange(len(y)), doc)]
        same = np.unique(key, return_inverse=True)[1]
        while True:
            low = np.full(len(y), len(y))
            np.minimum.at(low, same, group)
            new = low[same]
            low = np.full(len(y), len(y))
            np.minimum.at(low, group, new)
            new = np.minimum(new, low[group])
            if (new == group).all():
                break
            group = new
    # the first guess at what makes sentences toxic: units (nearly) of toxic documents alone in too many groups for
    # chance, and then each time the one that stands in most groups without one so far, so that other words of a group
    # explain nothing
    allowed = usable & (pos >= 3) & (neg <= 0.02 * pos)
    pick = y[doc] & allowed[word]
    pairs = np.unique(word[pick] * np.int64(len(y)) + group[doc[pick]])
    w_tox, g_tox = pairs // len(y), pairs % len(y)
    sure = np.bincount(w_tox, minlength=len(words)) * -np.log(y.mean()) > np.log(len(words) + 1) + 3
    done = np.unique(g_tox[sure[w_tox]])
    stay = ~np.isin(g_tox, done)
    w_tox, g_tox = w_tox[stay], g_tox[stay]
    while len(w_tox):
        left = np.bincount(w_tox, minlength=len(words))
        best = int(np.lexsort((np.arange(len(words)), -pos, -left))[0])
        if left[best] < 3:
            break
        sure[best] = True
        stay = ~np.isin(g_tox, g_tox[w_tox == best])
        w_tox, g_tox = w_tox[stay], g_tox[stay]
    guess = np.where(sure, 1.0, -1.0)
    model = Model(np.zeros(KINDS**3), 0.0, 1.0, 0.0)
    mined = np.zeros(0, np.int64)
    for r in range(rounds):
        bad = np.flatnonzero(sure)
        if r:
            # the worst unit of toxic documents without a sure one, where it is worse than any clean unit
            known = np.zeros(len(y), bool)
            known[doc[sure[word]]] = True
            open_ = np.flatnonzero(y[doc] & ~known[doc] & (neg[word] == 0))
            order = open_[np.lexsort((word[open_], -guess[word[open_]], doc[open_]))]
            head = word[order[np.unique(doc[order], return_index=True)[1]]]
            top = max(0.0, float(np.quantile(guess[clean], 0.9995))) if len(clean) else 0.0
            bad = np.union1d(bad, head[guess[head] > top])
            mined = np.union1d(mined, clean[guess[clean] > -1])
        if not len(bad):  # too few rows for counts: the units of toxic documents that clean ones hold least
            bad = np.flatnonzero(usable & (pos > 0))
            bad = bad[np.lexsort((bad, -pos[bad], neg[bad]))][:GUESSED]
        if not len(bad) or not len(clean):
            break
        bad = bad[np.lexsort((bad, -pos[bad]))]
        drawn = rng.choice(clean, min(DRAWN, len(clean)), replace=False)
        plus = [words[i] for i in bad]
        extra = [x for w in plus for x in (_inserted(w, rng) if len(w) > 3 else ()) if len(x) >= 3]
        minus = [words[i] for i in np.setdiff1d(np.union1d(mined, drawn), bad)]
        units = [*plus, *extra, *minus]
        t = np.r_[np.ones(len(plus) + len(extra)), -np.ones(len(minus))]
        # landmarks: the most frequent positives, and those negatives that are nearest to any of them
        rows = [dense(u).astype(np.float32) for u in plus[: landmarks * 2 // 3]]
        cols = np.zeros((len(units), landmarks), np.float32)
        products(units, rows, cols)
        near = cols[len(units) - len(minus) :, : len(rows)].max(1)
        more = [dense(minus[int(i)]).astype(np.float32) for i in np.argsort(-near, kind="stable")[: landmarks - len(rows)]]
        products(units, more, cols[:, len(rows) :])
        lm = np.array(rows + more, np.float32)
        del rows, more
        val, vec = np.linalg.eigh((lm @ lm.T).astype(np.float64))
        root = vec[:, val > 1e-4] / np.sqrt(val[val > 1e-4])
        for i in range(0, len(cols), HELD):  # in place: the features are no more than the landmarks
            cols[i : i + HELD, : root.shape[1]] = cols[i : i + HELD, : len(lm)] @ root
        w = svm(cols[:, : root.shape[1]], t, np.r_[np.ones(len(plus)), np.full(len(extra), 0.1), np.ones(len(minus))])
        model.table, model.bias = lm.T.astype(np.float64) @ (root @ w[:-1]), float(w[-1])
        guess = all_margins(model)
    worst = np.full(len(y), -1.0)
    np.maximum.at(worst, doc, np.maximum(-1.0, guess[word]))
    model.slope, model.shift = _logistic(worst, y)
    return model


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve with softened targets, by Newton's method."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    x = np.c_[m, np.ones(len(m))]
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: str = "pmod(crc32(cast(id as string)), 4) = 2", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on the labelled rows that are not held out, a sample of at most `sample_rows` of them by a hash of the id."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(f"not ({held_out})")
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def learn(t: pa.Table) -> pa.Table:
        t = t.select(["id", "text", "y"]).sort_by("id")
        m = train(t.column("text").to_pylist(), t.column("y").to_pylist())
        return pa.table({"table": pa.array([m.table.tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    # the sample is bounded (one row an id), so that one task may hold it; the driver gets the model alone
    got = texts.join(F.broadcast(own), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).groupBy(F.lit(0).alias("g")).applyInArrow(learn, "table binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(got["table"]), got["bias"], got["slope"], got["shift"]) if got else train([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, score double) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in batches_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(buf, off))], ["id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def sentences(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, end, score): the byte spans of the sentences that reach the threshold (they end at . ! ? or a line's end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stop = np.zeros(256, bool)
    stop[[0x21, 0x2E, 0x3F, 0x0A]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in batches_of(batches, "text"):
            u = units_of(buf, off)
            s = shared.value.curve(np.maximum(-1.0, margins(u, shared.value.table) + shared.value.bias))
            cuts = np.unique(np.concatenate([np.flatnonzero(stop[buf]) + 1, off]))
            hit = s >= threshold
            which = np.searchsorted(cuts, u.byte[hit], "right") - 1
            best: dict[int, float] = {}
            rows: dict[int, int] = {}
            for k, v, r in zip(which.tolist(), s[hit].tolist(), u.row[hit].tolist(), strict=True):
                best[k], rows[k] = max(v, best.get(k, 0.0)), r
            keys = sorted(best)
            first = [int(off[rows[k]]) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[rows[k]].as_py() for k in keys], pa.int64()), pa.array([int(cuts[k]) - f for k, f in zip(keys, first, strict=True)], pa.int64()), pa.array([int(cuts[k + 1]) - f for k, f in zip(keys, first, strict=True)], pa.int64()), pa.array([best[k] for k in keys], pa.float64())], ["id", "start", "end", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "id long, start long, end long, score double").withColumnRenamed("id", id_col)


def remove(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in batches_of(batches, text_col):
            yield b.filter(pa.array(shared.value.scores(buf, off) < threshold))

    return docs.mapInArrow(run, docs.schema)
