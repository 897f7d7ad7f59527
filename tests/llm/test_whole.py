"""Rows, texts and words that the operators once left out."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from routeloom.llm import common, decontam, jaccard, lattice, suffixes, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 2.0) for d, t in rows], "doc_id long, text string, id string, score double").repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- op1 on many blocks


def test_stable_order_of_names():
    g = np.random.default_rng(5)
    for n in (0, 1, 2, 3000, 70_000):
        for top in (1, 4, 1 << 34, (1 << 64) - 1):
            x = g.integers(0, top, n, dtype=np.uint64, endpoint=True)
            x[::3] = x[:1]
            x[1::5] ^= np.uint64(1)
            assert (suffixes.ordered(x) == np.argsort(x, kind="stable")).all()
    for x in (np.arange(40_000, 0, -1, dtype=np.uint64), np.r_[np.arange(400, 0, -1, dtype=np.uint64), np.uint64((1 << 64) - 1)]):
        assert (suffixes.ordered(x) == np.argsort(x, kind="stable")).all()


def test_wanted_names_cost_no_more_with_more_blocks():
    def taken(blocks, n):
        g = np.random.default_rng(6)
        names = [np.unique(g.integers(0, 1 << 33, n).astype(np.uint64)) for _ in range(blocks)]
        names[0] = np.unique(np.r_[names[0], names[-1][:9]])
        wants = [g.random(len(x)) < 0.2 for x in names]
        sent = lambda kind, data: pa.table([range(blocks), [kind] * blocks, [7] * blocks, pa.array(data, pa.binary())], schema=suffixes._RECORD)
        left, right = sent(suffixes.DRAWN, [common.packed_sorted(x) for x in names]), sent(suffixes.WANTED, [suffixes._bits(x) for x in wants])
        began = time.process_time()
        got = suffixes._any(left, right)
        took = time.process_time() - began
        wanted = {int(v) for x, w in zip(names, wants, strict=True) for v in x[w]}
        assert all((suffixes._unbits(d) == [int(v) in wanted for v in names[b]]).all() for b, d in zip(got["block"].to_pylist(), got["data"].to_pylist(), strict=True))
        return took

    # as many names in thirty times as many blocks
    assert taken(900, 400) < 8 * max(taken(30, 12_000), 0.05)


def block_of(texts):
    return suffixes.Block(common._packed_rows(1, np.arange(1, len(texts) + 1), pa.array(texts)), 50, 31, 40)


def test_ranges_cover_as_a_plain_mask():
    g = np.random.default_rng(7)
    b = block_of(["x" * 90, "", "y" * 110])
    for n in (0, 1, 5, 40):
        lo = g.integers(0, 200, n)
        hi = lo + g.integers(1, 60, n)
        plain = np.zeros(200, bool)
        for a, z in zip(lo, hi, strict=True):
            plain[a:z] = True
        assert (b.covered(lo, hi) == plain).all()
    assert (b.covered(np.array([0, 10, 20, 199]), np.array([10, 20, 21, 260])) == np.r_[np.ones(21, bool), np.zeros(178, bool), True]).all()


def test_a_block_needs_few_bytes_for_a_byte_of_text():
    text = np.random.default_rng(8).integers(97, 123, 4 << 20).astype(np.uint8).tobytes().decode()
    b = block_of([text[i : i + 4096] for i in range(0, len(text), 4096)])
    n = b.samples()
    removed = n.at[::40]
    tracemalloc.start()
    mask = b.decided(removed)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mask.sum() > len(text) // 10 and most < 6 * len(text)


# ---------------------------------------------------------------- rows without an id


def test_documents_without_an_id_stay(spark):
    long = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcd"]
    near = long[0].replace("a30", "v")
    rows = [(7, long[0]), (None, near), (None, long[1]), (None, long[1]), (None, long[2]), (None, ""), (None, ""), (None, None), (-3, "short"), (None, "short"), (None, long[3] + " one"), (None, long[3] + " two")]
    d = frame(spark, rows)
    # 7: a copy of an id's text goes, of copies without one, one stays, and empty texts are each their own
    kept = texts(jaccard.keep_first(d, 5, 80))
    d_one = [r for r in kept if r[1] and r[1].startswith(long[3])]
    assert len(d_one) == 1
    assert [r for r in kept if r not in d_one] == sorted([(7, long[0]), (None, long[1]), (None, long[2]), (None, ""), (None, ""), (None, None), (-3, "short")], key=repr)
    got = [tuple(r) for r in jaccard.join(d, 5, 80).collect()]
    assert len(got) == len(rows) and sum(r[0] is None and r[3] == 7 for r in got) == 1 and sum(r[0] is None and r[2] == -3 == r[3] for r in got) == 1
    # 1: short texts have nothing to lose, copies lose all to one of them
    cut = texts(suffixes.deduplicated(d, 50))
    assert len(cut) == len(rows) and [t for i, t in cut].count("short") == 2 and cut.count((None, long[1])) == 1 and cut.count((None, long[2])) == 1 and (7, long[0]) in cut
    assert sorted(len(t or "") for i, t in cut) == sorted([len(long[0]), len("v"), len(long[1]), 0, len(long[2]), 0, 0, 0, 5, 5, len(long[3]) + 4, len("two")])
    report = suffixes.report(d, 50).collect()
    assert len(report) == len(rows) and sum(r.doc_id is None for r in report) == 10
    # 6: scored, and learned from
    scores = lattice.score(d, PIECES).collect()
    assert sum(r.doc_id is None and not r.held_out for r in scores) == 10 and all(r.n_tokens == r.n_known for r in scores if r.doc_id is None)


def test_keys_are_above_all_ids(spark):
    top = (1 << 63) - 4
    d = frame(spark, [(top, "a"), (None, "b"), (None, "c"), (None, "b")])
    keyed, size = common.row_keys(d, "doc_id", "text", target=1)
    assert sorted(r[common.KEY] for r in keyed.collect()) == [top, top + 1, top + 2, top + 3] and size == {"bytes": 4, "rows": 4, "none": top + 1}
    assert common.row_keys(d.where("doc_id is not null"), "doc_id", "text")[1]["none"] is None
    assert common.row_keys(d.where("doc_id is null"), "doc_id", "text")[1]["none"] == 0


def test_items_without_an_id_are_found(spark):
    one, two = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(20))
    b = spark.createDataFrame([(None, one), (None, two), (4, one)], "item_id long, text string")
    d = frame(spark, [(1, one), (2, two), (3, "clean"), (None, "clean too")])
    for most in (1 << 20, 100):
        got = {r.doc_id: r for r in decontam.report(d, b, slice_bytes=most).collect()}
        assert {i: (r.n_hit, r.n_items, r.items_sha256) for i, r in got.items()} == {1: (20, 2, decontam.digest_of(["4"])), 2: (20, 1, decontam.digest_of([])), 3: (0, 0, decontam.digest_of([])), None: (0, 0, decontam.digest_of([]))}
        assert texts(decontam.remove(d, b, slice_bytes=most)) == [(3, "clean"), (None, "clean too")]
    assert sorted(((r.doc_id, r.item_id, r.n_words) for r in decontam.matches(d, b).collect()), key=repr) == [(1, "4", 20), (1, None, 20), (2, None, 20)]


# ---------------------------------------------------------------- wide words and long pieces


def test_wide_words_and_long_pieces_count(monkeypatch):
    pieces, q = lattice.vocabulary(PIECES)
    long = [p for p in pieces if len(p) > 16]
    assert len(long) == 20
    model = lattice.Lattice(pieces, q)
    words = [long[0].strip(), "日本語のテキスト".encode() * 9, b"https://example.org/" + b"some-long-path/" * 20, b"the", b"x" * 49]
    ends = np.cumsum([len(w) for w in words])
    starts, buf = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
    counts = np.array([1.0, 2.0, 1.0, 3.0, 0.0])
    got = model.expected(buf, starts, ends, counts)
    assert got[pieces[long[0]]] > 0
    # every byte of a word, and the space before it, lies in one piece of a segmentation
    assert sum(got[i] * len(p) for p, i in pieces.items()) == pytest.approx(sum(c * (len(w) + 1) for c, w in zip(counts, words, strict=True)))
    # equal to the words all at once
    logs = model.forward(buf, starts, ends)
    monkeypatch.setattr(lattice, "WIDE", 10_000)
    assert np.allclose(got, model.expected(buf, starts, ends, counts)) and np.allclose(logs, model.forward(buf, starts, ends))


# ---------------------------------------------------------------- units of any length and script


def units(text):
    u = toxicity.units_of(*common.text_bytes(pa.array([text], pa.string())))
    return [u.cls[s:e].tobytes() for s, e in zip(u.starts, u.ends, strict=True)]


def test_signs_go_from_units_of_any_length():
    insult = units("blorgfuk")[0]
    for n in (0, 20, 100, 3000):
        assert any(insult in u for u in units("q" * n + "b-l-o-r-g-f-u-k" + "z" * n)), n


def test_words_of_other_scripts_differ():
    for words in (["дурак", "добро", "слово", "книга"], ["κακός", "καλός", "λόγος"], ["馬鹿", "日本", "学校"], ["바보", "학교", "나라"]):
        assert len({tuple(units(w)) for w in words}) == len(words), words
    assert units("ДУРАК") == units("дурак") and units("ĀŠ") == units("as") and units("ｆｕｌｌ") == units("full") and units("ё") == units("е")
    assert units("“x”") == [bytes([29, 24, 29])] and units("naïve 😀") == [*units("naive"), b"\x1d"] and units("٣") == [b"\x1b"]


# ---------------------------------------------------------------- the pipeline's stages


def test_pipeline_keeps_empty_texts_and_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    same = " ".join(f"s{i}" for i in range(30))
    bench = " ".join(f"bench{i}" for i in range(20))
    rows = [(1, same), (2, same), (3, ""), (4, None), (5, "clean"), (None, ""), (None, "clean without an id"), (None, None), (6, bench), (None, "more " + bench)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # a text that loses all its bytes goes, one that had none stays
    cut = corpus_pipeline.cut_repeated_strings(spark, docs.where("doc_id != 6 or doc_id is null"), str(tmp_path))
    assert cut.columns == docs.columns
    assert texts(cut) == sorted([r for r in rows if r[0] not in (2, 6)], key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    last = sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert last == sorted([1, 3, 4, 5, None, None, None], key=repr)
