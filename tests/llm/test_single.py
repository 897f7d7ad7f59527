"""Operators 3, 4, 5, 6, 9 and 10, and the pipeline's contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from routeloom.llm import blocks, bpe, common, lattice, queries, shard, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
NOT_SPACE = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 2.0) for d, t in rows], "doc_id long, text string, id string, score double").repartition(3)


# ---------------------------------------------------------------- 4


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXTS = ["", "a b  c\n\n d", "\U0001f600 naïve 'll don't   ", " " * 50 + "x", "日本語テキスト" * 40, "\x00\x01a", "é" * 9, "1234567 'S ''s x's \x1c a\x85b \xa0c ²½ªº", "<|endoftext|>", "the " * 3000]


def test_bpe_equals_the_reference_library(spark):
    enc = reference_encoding()
    rows = [*enumerate(TEXTS), (90, None), (3, TEXTS[3])]
    got = sorted(tuple(r) for r in bpe.digests(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    assert got == want
    assert bpe.digests(frame(spark, rows).where("false"), PATH, public_tokenizers.PATTERN).count() == 0
    for r in bpe.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN, offsets=True).collect():
        t = (dict(rows)[r.doc_id] or "").encode()
        assert bytes(r.decoded) == t and (r.ends[-1:] or [0])[0] == len(t) and r.starts[1:] == r.ends[:-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_round_trip(text):
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    ids = [i for p in c.encode(text) for i in p[3]]
    assert ids == reference_encoding().encode_ordinary(text) and bpe.decode(ids, c.raw).decode() == text


# ---------------------------------------------------------------- 10


def test_ring_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1009)] + [(None, None), (5, "again"), (5000, "é")]
    got = shard.assign(frame(spark, rows), 40, 16).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    n = [len(v) for v in by.values()]
    assert set(by) == set(range(40)) and max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert shard.assign(frame(spark, rows).where("false")).count() == 0


def test_ring_moves_little(spark):
    d = frame(spark, [(i, "t") for i in range(2000)])
    a = {r.doc_id: r.shard for r in shard.assign(d, 20, 64).collect()}
    b = {r.doc_id: r.shard for r in shard.assign(d.where("doc_id >= 20"), 20, 64).collect()}
    assert np.mean([a[i] != s for i, s in b.items()]) < 0.25


def test_ring_keeps_equal_texts_together(spark, monkeypatch):
    monkeypatch.setattr(shard, "SHARE", 100)  # the rows of the large group are ranked in shares
    rows = [(i, f"text {i % 300}") for i in range(1500)] + [(None, "hot")] * 700 + [(7, "same id")] * 50
    got = shard.assign(frame(spark, rows), 10, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert {len(v) for v in by.values()} == {225} and all(sorted(v) == list(range(225)) for v in by.values())
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(groups[zlib.crc32(b"hot")]) >= 4 and sum(len(g) > 1 for g in groups.values()) <= 30  # a bound cuts few groups


def plain_ring(rows, shards, nodes):
    """Rows by shard as segments() promises: each arc's rows in turn to its own shard, the rest clockwise to shards with room."""
    points = shard.ring(shards, nodes)
    order = list(dict.fromkeys(s for _, s in points))
    room = {s: len(rows) // shards + (i < len(rows) % shards) for i, s in enumerate(order)}
    arcs = Counter()
    for _, t in rows:
        step = int(hashlib.md5((t or "").encode()).hexdigest()[:8], 16) * shard.FINE >> 32
        arcs[next((i for i, (p, _) in enumerate(points) if p >= step), 0)] += 1
    taken, over = Counter(), []
    for arc, (_, s) in enumerate(points):
        k = min(arcs[arc], room[s])
        room[s] -= k
        taken[arc, s] += k
        over.append((arc, arcs[arc] - k))
    for arc, n in over:
        for i in range(1, len(points) + 1):
            s = points[(arc + i) % len(points)][1]
            k = min(n, room[s])
            room[s] -= k
            n -= k
            taken[arc, s] += k
    return Counter({k: v for k, v in taken.items() if v}), points


def test_ring_equals_a_plain_one(spark):
    rows = [(i, f"t{i * 7919 % 613}") for i in range(1203)]
    want, points = plain_ring(rows, 12, 16)
    text = dict(rows)
    got = Counter()
    for r in shard.assign(frame(spark, rows), 12, 16).collect():
        step = int(hashlib.md5(text[r.doc_id].encode()).hexdigest()[:8], 16) * shard.FINE >> 32
        got[next((i for i, (p, _) in enumerate(points) if p >= step), 0), r.shard] += 1
    assert got == want


# ---------------------------------------------------------------- 3


def test_warc_records(spark):
    pages = [(1, "http://a/", "<html><head><title>T</title><script>x<1</script></head><body><p>A &amp; <b>B</b></p><!-- no --><div>C\n c</div>"), (2, None, None), (3, "http://b/", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.with_warc(warc.derive(d, "page_id", "url", "html", bare=True)).collect()
    assert len(got) == 6
    by = {(r.key, r.warc_type): r for r in got}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text.block.decode() == "T\nA & B\nC c" and text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    payload = pages[0][2].encode()
    assert text.source_payload_digest == warc.digest(payload) and text.source_block_digest == warc.digest(warc.response_block(payload))
    assert bytes(by[2, "conversion"].block) == b"" and by[2, "conversion"].target_uri == ""
    for r in got:
        assert bytes(r.warc) == warc.serialise(r.asDict())
    parsed = list(warc.parse(b"".join(bytes(r.warc) for r in got)))
    assert [(h["WARC-Record-ID"], b) for h, b in parsed] == [(r.record_id, bytes(r.block)) for r in got] and all(h["WARC-Block-Digest"] == warc.digest(b) for h, b in parsed)
    status, headers, body = warc.split_message(b"HTTP/1.1 404 No\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9")
    assert (status, headers["content-type"], body) == ("HTTP/1.1 404 No", "text/plain; charset=latin-1", b"\xe9")
    assert warc.derive(d.where("false"), "page_id", "url", "html").count() == 0


def test_warc_keeps_what_the_source_says(spark):
    message = b'HTTP/1.1 200 OK\r\nETag: "x"\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2;\r\n path=/\r\nContent-Type: text/html; charset="utf-8"\r\n\r\n<p>\xc3\xa9</p><p title="a>b">x<svg-icon></svg-icon>y'
    source = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2023-05-06T07:08:09Z\r\nWARC-Target-URI: http://a/\r\nWARC-IP-Address: 10.0.0.1\r\nContent-Length: %d\r\n\r\n" % len(message) + message + b"\r\n\r\n"
    other = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    got = warc.from_records(spark.createDataFrame([(7, bytearray(other + source)), (8, None)], "n long, data binary"), "n", "data").collect()
    by = {r.warc_type: r for r in got}
    assert len(got) == 2 and {(r.refers_to, r.warc_date, r.target_uri, r.key) for r in got} == {("<urn:uuid:1>", "2023-05-06T07:08:09Z", "http://a/", 7)}
    fields = bytes(by["metadata"].block).decode().split("\r\n")
    assert [f for f in fields if "cookie" in f] == ["source-http-set-cookie: a=1", "source-http-set-cookie: b=2; path=/"]
    assert 'source-http-etag: "x"' in fields and "source-warc-warc-ip-address: 10.0.0.1" in fields
    assert bytes(by["conversion"].block).decode() == "é\nxy"
    given = spark.createDataFrame([(1, "u", bytearray(message), "<urn:uuid:2>", "2020-01-01T00:00:00Z")], "k long, u string, b bytes, id string, d string".replace("bytes", "binary"))
    assert {(r.refers_to, r.warc_date) for r in warc.derive(given, "k", "u", "b", id_col="id", date_col="d").collect()} == {("<urn:uuid:2>", "2020-01-01T00:00:00Z")}


def test_warc_ids_and_lines(spark):
    rows = [(1, "http://a/\r\nX-Evil: 1", "<p>x</p>")] * 3 + [(None, None, None)] * 2
    d = spark.createDataFrame(rows, "block long, key string, warc string").repartition(3)  # names that clash with the records' own
    got = warc.with_warc(warc.derive(d, "block", "key", "warc", bare=True)).collect()
    assert len({r.record_id for r in got}) == len(got) == 10 and len({r.refers_to for r in got}) == 5
    for r in got:
        assert bytes(r.warc) == warc.serialise(r.asDict())
        ((headers, _),) = warc.parse(bytes(r.warc))
        assert "X-Evil" not in headers
    long = warc.visible_text("<p>" + "word " * 200_000 + "</p>")
    assert len(long.split()) == 200_000


@pytest.mark.parametrize(
    "page, want",
    [("<p>One.</p><svg-icon></svg-icon><p>Two.</p>", ["One.", "Two."]), ("<p>One.</p><svg/><p>Two.</p>", ["One.", "Two."]), ('<p title="a>b">One</p>', ["One"]), ("<button-group><p>A</p></button-group>B", ["A", "B"]), ("<div>a<button>x</div><p>b</p>", ["a", "b"]), ("<!-->a<!-- <p>no --!>b", ["ab"]), ("<script>if (a</b) '</p>'</SCRIPT >c", ["c"]), ("<p>a<select><option>1<option>2</select>b", ["a b"]), ("a < b <3 & c", ["a < b <3 & c"]), ("x<style>p{}", ["x"])],
)
def test_leaves_of_odd_markup(page, want):
    assert blocks.leaves(page)[0] == want


def test_blocks_are_told_apart_by_all_words():
    same = " ".join(["word"] * 60)
    a, b = (blocks.leaves(f"<p>{same} {end}</p>")[1] for end in ("word " * 40, "other " * 40))
    assert not np.array_equal(a, b)


def test_pages_with_clashing_columns_and_none(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>Some text of the page, long enough to count.</p></article>", "mine", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert blocks.extract(d).columns == ["page_id", "url", "text", "n_chars"] and blocks.extract(d).first().text.startswith("Some text")
    assert blocks.extract(d.where("false")).count() == 0


#: Pages written by hand, with their main text.
HAND = [
    ("<html><body><header><a href=/>Site</a></header><main><h1>Rain in the north</h1><p>Rivers rose over night and two bridges were closed.</p><p>Trains run again since noon.</p></main><footer>&copy; 2020 The Paper</footer></body></html>", "Rain in the north\nRivers rose over night and two bridges were closed.\nTrains run again since noon."),
    ('<nav class="menu"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article><h1>How to bake bread</h1><p>Mix flour, water and salt, and let it rest for an hour.<ul><li>Heat the oven to 230 degrees.<li>Bake for forty minutes.</ul></article><section class="comments"><h2>Comments</h2><p>Great recipe, thanks a lot for it!</p></section>', "How to bake bread\nMix flour, water and salt, and let it rest for an hour.\nHeat the oven to 230 degrees.\nBake for forty minutes."),
    ('<div class="cookie-notice">We use cookies to make this site better.</div><article><p>The old mill was built in 1790 and still works.</p><div class="advert">Buy two mills, get one free today!</div><p>Visitors may see it on Sundays.</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href=c>Other mills</a></ul></aside>', "The old mill was built in 1790 and still works.\nVisitors may see it on Sundays."),
]


def test_pages_that_the_generator_did_not_write():
    assert blocks.main_texts([p for p, _ in HAND], blocks.trained()) == [t for _, t in HAND]


# ---------------------------------------------------------------- 6


def plain_likelihood(word, pieces, q):
    """All segmentations, one after the other."""
    text = b" " + word

    def rest(i):
        return 1.0 if i == len(text) else sum(q[pieces[text[i:j]]] * rest(j) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces)

    return rest(0)


def test_lattice_sums_all_segmentations():
    pieces, q = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert abs(q.sum() - 1) < 1e-9
    words = ["the", "a", "hello", "é", "naïve", "x" * 9, "日"]
    joined = b"".join(w.encode() for w in words)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    model = lattice.Lattice(pieces, q)
    buf = np.frombuffer(joined, np.uint8)
    got = model.forward(buf, starts, ends)
    want = [math.log(plain_likelihood(w.encode(), pieces, q)) for w in words]
    assert np.allclose(got, want) and np.allclose([model.one(w.encode()) for w in words], want)
    expected = model.expected(buf, starts, ends, np.ones(len(words)))
    length = sum(expected[i] * len(p) for p, i in pieces.items())
    assert abs(length - sum(len(w.encode()) + 1 for w in words)) < 1e-6


def test_lattice_scores(spark):
    g = np.random.default_rng(3)
    words = ["the", "The", "of", "naïve", "x" * 70, "日本", "co-op"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[int(k)] for k in g.integers(0, len(words), int(g.integers(0, 30))))) for i in range(60)] + [(100, None), (101, ""), (102, "\t \n"), (5, "the same id")]
    got = sorted((tuple(r) for r in lattice.score(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model")).collect()), key=repr)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = [(i, [*NOT_SPACE.findall(low(t)), None]) for i, t in rows]
    c = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in docs), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5] for r in got], [r[5] for r in want])
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
    assert lattice.score(frame(spark, rows).where("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---------------------------------------------------------------- 5


def test_leaves():
    texts, x = blocks.leaves('<title>no</title><nav><a href=x>Home</a></nav><p>A <b>b</b>&nbsp;c<br>d<p>E&lt;<script>var t="</p>";</script><!-- x --></div><ul><li>f<li>g</ul>tail <cut')
    assert texts == ["Home", "A b c d", "E<", "f", "g", "tail"] and len(x) == 6 and x[0, blocks.PATHS + blocks.WORDS + 1] == 1.0


def test_gradients_are_the_loss_slopes():
    g = np.random.default_rng(0)
    net = blocks.Labeller(5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = blocks.padded([g.normal(size=(n, 5)) for n in (4, 2)], 5)
    x, y = x.astype(np.float64), (g.random((4, 2)) > 0.5).astype(float)
    loss = lambda: -(np.where(y > 0, np.log(net.scores(x, mask)), np.log(1 - net.scores(x, mask))) * mask).sum() / mask.sum()
    grads = net.gradients(x, mask, y)
    for k in net.p:
        at = np.unravel_index(int(g.integers(net.p[k].size)), net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-3, k


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Head line</h1><p>First <b>part</b> &amp; more.</p><p>Second part.</p></article><div class='comments'><p>Nice one!</p></div><footer>&copy; x</footer>"
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    got = sorted(map(tuple, blocks.extract(d).collect()), key=lambda r: r[0])
    main = "Head line\nFirst part & more.\nSecond part."
    assert got == [(1, "u", main, len(main))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]
    rng = np.random.default_rng(77)
    pages = [blocks.invented_page(rng) for _ in range(60)]
    right = total = 0
    for (p, m), t in zip(pages, blocks.main_texts([p for p, _ in pages], blocks.trained()), strict=True):
        every, kept = blocks.leaves(p)[0], set(t.split("\n"))
        right += sum((b in kept) == (b in m) for b in every)
        total += len(every)
    assert right / total > 0.97


# ---------------------------------------------------------------- 9


def toxic_corpus(seed, n):
    g = np.random.default_rng(seed)
    syllables = ["er", "th", "on", "in", "an", "re", "ed", "at", "en", "or", "ti", "ha", "ea", "nd", "ou"]
    clean = ["".join(syllables[int(i)] for i in g.integers(0, 15, int(g.integers(1, 5)))) for _ in range(800)]
    bad = ["blorgfuk", "snivvel", "grubkwit", "zotpaz"]
    rows = []
    for i in range(n):
        w = [clean[int(k)] for k in g.integers(0, 800, int(g.integers(5, 60)))]
        y = int(g.random() < 0.2)
        if y:
            w.insert(int(g.integers(len(w))), bad[int(g.integers(4))] + str(g.choice(["", ".", "s"])))
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus(1, 900)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "grub-kwit b l o r g f u k"), (5003, "x" * 50_000)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    s = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(s[i] >= toxicity.THRESHOLD, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert s[5000] == s[5001] < 0.3 and s[5002] >= 0.3 and all(0 <= x <= 1 for x in s.values())
    kept = {r.doc_id for r in toxicity.remove(docs, model).collect()}
    assert kept == {i for i, x in s.items() if x < toxicity.THRESHOLD}
    spans = toxicity.sentences(frame(spark, [(1, "All the. A blorgfuk here! No")]), model).collect()
    assert [(r.start, r.end) for r in spans] == [(8, 25)]
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(r.score, 4) for r in toxicity.score(docs, none).collect()} == {0.0}


def test_margins_equal_the_plain_kernel():
    g = np.random.default_rng(2)
    table = g.normal(size=toxicity.KINDS**3)
    import pyarrow as pa

    buf, off = common.text_bytes(pa.array(["Hello wörld, foo-bar", "", None, "i d i o t"], pa.string()))
    u = toxicity.units_of(buf, off)
    for s, e, m in zip(u.starts, u.ends, toxicity.margins(u, table), strict=True):
        c = u.cls[s:e].astype(int)
        total = sum(table[(c[i] * 30 + c[j]) * 30 + c[k]] * toxicity.DECAY ** (k - i - 2) for i in range(len(c)) for j in range(i + 1, len(c)) for k in range(j + 1, len(c)) if k - i < toxicity.SPAN)
        assert m == pytest.approx(total / toxicity._NORM[len(c)])
    assert u.row.tolist().count(3) == 6 and set(u.row.tolist()) == {0, 3}


# ---------------------------------------------------------------- queries and pipeline


def test_registered_queries():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_corpus(4, 500)
    shared = " ".join(f"common{i}" for i in range(20))
    rows += [(1000 + i, f"{shared} own{i} " + " ".join(f"u{i}x{k}" for k in range(30)), 0) for i in range(3)]
    rows += [(1100 + i, " ".join(f"copy{k}" for k in range(40)), 0) for i in range(3)] + [(1200, " ".join(f"bench{k}" for k in range(20)), 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(3, 18)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names, now, seen = [], spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, str(tmp_path)), "t")
        names.append(name)
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert len(names) == 5
    ids = set(seen["near_duplicates"])
    assert 1100 in ids and not {1101, 1102} & ids
    assert seen["repeated_strings"][1000].text.startswith(shared) and not seen["repeated_strings"][1001].text.startswith(shared)
    assert all(r.n_chars == len(r.text) for r in seen["repeated_strings"].values())
    assert 1200 in seen["repeated_strings"] and 1200 not in seen["decontamination"]
    last = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last == {i: tuple(r) for i, r in seen["byte_bpe"].items()}
