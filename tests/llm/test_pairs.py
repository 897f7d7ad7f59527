"""Operators 1, 2, 7 and 8 against brute force on small and awkward tables."""

import hashlib
import re

import numpy as np
import pytest

from routeloom.llm import components, decontam, jaccard, suffixes, topk

NOT_SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(seed, n=140, vocabulary=60):
    """Texts with copies, near copies, shared passages, nulls, empty, short and long ones."""
    g = np.random.default_rng(seed)
    words = ["".join(chr(97 + int(c)) for c in g.integers(0, 26, int(g.integers(1, 8)))) for _ in range(vocabulary)] + ["É", "ñandú", "日本", "x's"]
    prose = lambda k: " ".join(words[int(i)] for i in g.integers(0, len(words), k))
    passage = prose(30)
    rows = []
    for i in range(n):
        kind = i % 7
        if kind == 0 or not rows:
            t = prose(int(g.integers(0, 60)))
        elif kind == 1:
            t = rows[int(g.integers(0, len(rows)))][1]
        elif kind in (2, 3):
            w = (rows[int(g.integers(0, len(rows)))][1] or "").split(" ")
            for _ in range(int(g.integers(1, 3))):
                w[int(g.integers(0, len(w)))] = prose(1)
            t = " ".join(w)
        elif kind == 4:
            t = prose(int(g.integers(0, 20))) + " " + passage + "\n" + prose(int(g.integers(0, 20)))
        elif kind == 5:
            t = prose(int(g.integers(1, 9)))
        else:
            t = prose(1) * int(g.integers(1, 90)) + (" ha" * int(g.integers(1, 60)))
        rows.append((int(i * 7 % 1009), t))
    return [*rows, (5000, None), (5001, ""), (5002, " \t\n"), (5003, prose(4000)), (5004, "A"), (5005, "a")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1.5, b"z") for d, t in rows], "doc_id long, text string, id string, score double, block binary").repartition(5)


def plain_cut(rows, k):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        own = [b[i : i + k] for i in range(len(b) - k + 1)]
        for i, s in enumerate(own):
            if s in seen:
                m[i : i + k] = True
        seen.update(own)
        runs = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out[d] = (len(b), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest())
    return out


def test_covers_are_difference_covers():
    for v, d in suffixes.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("seed, length", [(1, 50), (2, 20)])
def test_suffix_dedup(spark, seed, length, monkeypatch):
    rows = corpus(seed)
    d = frame(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in suffixes.report(d, length).collect()}
    assert got == plain_cut(rows, length)


def test_suffix_dedup_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 40 + "abc"), (2, "xé" + "é" * 39 + "abd"), (3, None), (2, "xé" + "é" * 39 + "abd")]
    out = suffixes.deduplicated(frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.id) for r in out] == [(1, rows[0][1], "x"), (2, "xd", "x"), (2, "xd", "x"), (3, None, "x")]
    empty = frame(spark, rows).where("false")
    assert suffixes.report(empty).count() == 0 and suffixes.deduplicated(empty).columns == empty.columns


def plain_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = NOT_SPACE.findall(low(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("seed, k, percent, light", [(1, 4, 85, None), (2, 5, 80, None), (3, 2, 60, None), (3, 2, 60, 6), (4, 1, 80, 19)])
def test_jaccard_join(spark, seed, k, percent, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    rows = corpus(seed, vocabulary=30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), k, percent).collect()}
    assert got == plain_components(rows, k, percent)


def test_jaccard_keep_first(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(3, t), (1, t), (2, t.replace("w30", "v")), (9, "other"), (8, None), (7, "")]
    out = jaccard.keep_first(frame(spark, rows), 5, 80)
    assert sorted(r.doc_id for r in out.collect()) == [1, 7, 8, 9] and out.columns == frame(spark, rows).columns
    assert jaccard.join(frame(spark, rows).where("false")).count() == 0


def test_components(spark):
    g = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: top(x) for x in up}


def plain_hits(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= x
        out[d] = (len(w), len(hit), len(found), decontam.digest_of(list(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300])
def test_decontamination(spark, slice_bytes):
    rows = corpus(5)
    texts = [t for _, t in rows if t]
    items = [("a", texts[4]), ("b", texts[4]), ("c", None), ("d", ""), ("e", "HA ha"), ("f", " ".join(texts[11].split()[:13])), ("g", "no such words here at all"), ("h", "x's")]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontam.report(frame(spark, rows), b, slice_bytes=slice_bytes).collect()}
    want = plain_hits(rows, items)
    assert got == want
    kept = decontam.remove(frame(spark, rows), b, slice_bytes=slice_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in want.items() if not v[4]) and kept.columns == frame(spark, rows).columns
    assert decontam.report(frame(spark, rows), b.where("false")).where("n_hit > 0").count() == 0
    assert decontam.report(frame(spark, rows).where("false"), b).count() == 0


def test_longest_matches(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(w[5:30]) + " c"), (2, " ".join(w[:12]))], "doc_id long, text string")
    got = decontam.matches(docs, spark.createDataFrame([("i", " ".join(w))], "item_id string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "i", 2, 5, 25)]


def plain_top(rows, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in ok if j != i)[:k]  # noqa: B905
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("seed, scale", [(0, 1.0), (1, 40.0)])
def test_topk(spark, seed, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    g = np.random.default_rng(seed)
    x = (g.normal(0, 1, (120, 6)) * scale).tolist()
    rows = list(enumerate(x)) + [(200 + i, x[3]) for i in range(40)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (305, [float("nan")] * 6), (306, [float("inf")] * 6), (None, x[0]), (310, [1.0, 2.0]), (315, [0.0] * 6)]
    d = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, q string")
    rows = [(r[0], r[1]) for r in d.collect()]
    got = sorted(tuple(r) for r in topk.search(d, "id % 5 = 0", 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top(rows, 5)
    assert topk.search(d.where("false"), "id % 5 = 0").count() == 0
    few = d.where("vec_id in (0, 1, 2)")
    assert topk.search(few, "id % 5 = 0").count() == 2
