"""Items, cache and whole runs on a small benchmark of the tests' own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from routeloom.operators import generate
from routeloom.plans.run import parser, run
from routeloom.settings import SYSTEM_PROMPTS, generation_kwargs
from routeloom.sources import files, items
from routeloom.streaming import resume


def an_item(i, category):
    kind = {"general": ("contains", {"answer": ["blue"]}), "math": ("numeric", {"answer": i}), "code": ("python_exec", {"test_assertions": f"assert f() == {i}"})}[category]
    return {"id": f"{category}{i}", "category": category, "question": f"{category} question {i}", "verifier": kind[0], **kind[1]}


@pytest.fixture
def data(tmp_path):
    for name, lo, hi in (("smoke_val.json", 0, 4), ("smoke_test.json", 4, 7)):
        (tmp_path / name).write_text(json.dumps([an_item(i, c) for c in ("general", "math", "code") for i in range(lo, hi)]))
    return tmp_path


def args(data, *more):
    return parser().parse_args(["--mock", "--data", str(data), "--root", str(data), *more])


def outputs(data):
    return {p.name: json.loads(p.read_text()) for p in (data / "results_mock/1.5b_smoke_seed42").glob("*.json")}


def test_mock_run_and_resume(spark, data):
    assert run(spark, args(data)) == 0
    out = outputs(data)
    assert set(out) == {"metrics.json", "records.json", "calibration.json", "generations.json", "timing.json", "run_config.json"}
    m = out["metrics.json"]
    assert m["routed"]["k"] == m["baseline"]["k"] == 0 and m["routing_counts"] == {"general": 9, "math": 0, "code": 0} and m["mcnemar"]["p"] == 1.0
    assert sum(t["n_generated"] for t in out["timing.json"].values()) == 63
    assert run(spark, args(data, "--skip-calibration", "--limit", "2")) == 0
    again = outputs(data)
    assert sum(t["n_generated"] for t in again["timing.json"].values()) == 0 and sum(t["n_cached"] for t in again["timing.json"].values()) == 6
    assert again["calibration.json"] == {"skipped": True} and again["metrics.json"]["n"] == 2


def test_exit_codes(spark, data, capsys):
    assert run(spark, args(data, "--val-limit", "2")) == 2
    assert run(spark, args(data, "--benchmark", "real")) == 2
    assert run(spark, parser().parse_args(["--backend", "ollama", "--data", str(data), "--root", str(data)])) == 2
    (data / "smoke_test.json").write_text((data / "smoke_val.json").read_text())
    assert run(spark, args(data)) == 2
    assert "both splits" in capsys.readouterr().err


@pytest.mark.parametrize(
    "change, rule",
    [({"verifier": "guess"}, 7), ({"category": "history"}, 6), ({"answer": None}, 12), ({"answer": True}, 12), ({"answer": 1.5}, None), ({"verifier": "mcq_letter", "answer": "a"}, 13), ({"verifier": "contains", "answer": "x"}, 11), ({"verifier": "contains", "answer": []}, None), ({"verifier": "python_exec", "test_assertions": " "}, 9), ({"verifier": "python_exec"}, 8)],
)
def test_validation(spark, tmp_path, change, rule):
    p = tmp_path / "x.json"
    p.write_text(json.dumps([an_item(1, "math") | change]))
    got = [r["rule"] for r in items.violations(items.raw_items(spark, str(p))).collect()]
    assert got == ([rule] if rule else [])


def test_validation_of_the_file(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"id": 1}')
    with pytest.raises(ValueError, match="list"):
        items.load_items(spark, str(p))
    p.write_text(json.dumps([an_item(1, "math"), an_item(1, "math"), 3]))
    with pytest.raises(ValueError, match="duplicate"):
        items.load_items(spark, str(p))


def test_cache(spark, tmp_path):
    folder = tmp_path / "cache"
    assert files.read_cache(spark, str(folder)).count() == 0
    files.append_cache(spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, response string"), str(folder))
    # files of other makers are older than all batches; their own last line wins
    (folder / "zz.json").write_text('{"key": "k1", "response": "x"}\n[1]\n{"key": "k4", "response": "old"}\n{"key": "k4", "response": "new"}\n{"key": "k3"')
    assert dict(files.read_cache(spark, f"file://{folder}").collect()) == {"k1": "a", "k2": "b", "k4": "new"}
    for i in range(5):
        files.append_cache(spark.createDataFrame([(f"k{k}", f"{i}") for k in range(1, 20)], "key string, response string").repartition(3), str(folder))
        assert set(r["response"] for r in files.read_cache(spark, str(folder)).where("key != 'k4'").collect()) == {str(i)}
    twice = spark.createDataFrame([("k1", "first"), ("k1", "last")], "key string, response string").coalesce(1)
    files.append_cache(twice, str(folder))
    assert files.read_cache(spark, str(folder)).where("key = 'k1'").first()["response"] == "last"


def test_state_and_lists_by_uri(spark, tmp_path):
    from routeloom.operators.router import Router

    router = Router(centroids=[[1.0, 0.0]], matrix={0: {"general": 1.0}}, roles={0: "general"}, k=1)
    files.save_state(router, f"file://{tmp_path}/deep/state.json")
    assert files.load_state(f"file://{tmp_path}/deep/state.json").centroids == [[1.0, 0.0]]
    with pytest.raises(FileNotFoundError):
        files.load_state(f"file://{tmp_path}/none.json")
    files.write_list(f"{tmp_path}/l.json", iter(['{"a": 1}', "2"]))
    files.write_maps(f"{tmp_path}/m.json", {"val": iter([]), "test": iter([("é", {"x": None})])})
    assert json.loads((tmp_path / "l.json").read_text()) == [{"a": 1}, 2]
    assert json.loads((tmp_path / "m.json").read_text()) == {"val": {}, "test": {"é": {"x": None}}}


def test_backends_and_embedders(monkeypatch):
    from routeloom.functions import vectors
    from routeloom.plans.run import embedder
    from routeloom.settings import resolve_dtype

    assert [resolve_dtype(*x) for x in (("cpu", None), ("cuda", None), ("cpu", "bfloat16"), ("cuda", "float32"))] == ["float32", "float16", "bfloat16", "float32"]
    for bad in ({"device": "tpu"}, {"dtype": "int8"}):
        with pytest.raises(ValueError):
            generate.generator("huggingface", "m", "math", "1.5b", False, **bad)
    for backend, role in (("other", "math"), ("huggingface", "poet")):
        with pytest.raises(ValueError):
            generate.generator(backend, "m", role, "1.5b", False)
    with pytest.raises(NotImplementedError):
        generate.generator("ollama", "m", "math", "1.5b", False).respond()
    assert generate.generator("huggingface", "m", "math", "1.5b", True).describe() == {}
    assert generate.generator("huggingface", "m", "math", "1.5b", False).describe()["device"] == "cpu"
    assert embedder(True) == (vectors.hash_embed, "hash_embed") and embedder(False)[0] is not vectors.hash_embed
    assert "temperature" not in generation_kwargs("math") and generation_kwargs("math")["max_new_tokens"] == 512


def test_chat_model_with_stand_in_libraries(monkeypatch):
    """Batches, padding and decoding, against libraries that answer with the prompt's length."""
    import contextlib
    import sys
    import types

    class Row(list):
        def tolist(self):
            return list(self)

    class Tensor:
        def __init__(self, rows):
            self.rows = rows
            self.shape = (len(rows), len(rows[0]))

        def __getitem__(self, at):
            return [Row(r[at[1]]) for r in self.rows]

    class Batch(dict):
        def to(self, device):
            return self

    class Tokenizer:
        pad_token_id, eos_token = None, "<end>"

        def __setattr__(self, name, value):
            object.__setattr__(self, name, value)
            if name == "pad_token":
                object.__setattr__(self, "pad_token_id", 0)

        def apply_chat_template(self, messages, **_):
            return messages[1]["content"]

        def __call__(self, prompts, **_):
            n = max(map(len, prompts))
            return Batch(input_ids=Tensor([[0] * (n - len(p)) + [9] * len(p) for p in prompts]))

        def decode(self, ids, **_):
            return " " + "".join(map(str, ids)) + " "

    class Model:
        def to(self, device):
            return self

        def eval(self):
            return self

        def generate(self, input_ids, pad_token_id, **_):
            made = [[r.count(9), 5] if r.count(9) > 1 else [1] for r in input_ids.rows]
            return Tensor([r + m + [pad_token_id] * (2 - len(m)) for r, m in zip(input_ids.rows, made, strict=True)])

    torch = types.SimpleNamespace(float32=1, inference_mode=contextlib.nullcontext, cuda=types.SimpleNamespace(is_available=lambda: False))
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=types.SimpleNamespace(from_pretrained=lambda *a, **k: Tokenizer()), AutoModelForCausalLM=types.SimpleNamespace(from_pretrained=lambda *a, **k: Model())))
    m = generate.ChatModel("m", "math", "cpu", None)
    assert m(["a", "bbb"] + ["cc"] * 9) == [("1", 1), ("35", 2)] + [("25", 2)] * 9
    m.unload()
    assert m.model is None
    with pytest.raises(RuntimeError):
        generate.ChatModel("m", "math", "cuda", None).load()


def test_key_is_the_digest_of_its_inputs(spark):
    g = generate.generators("huggingface", "1.5b", True)["math"]
    q = 'a "quoted" \\ line\nnext\ttab é \x01'
    text = json.dumps([g.kind, g.model_id, g.role, SYSTEM_PROMPTS["math"], generation_kwargs("math"), None, None, q], sort_keys=True, ensure_ascii=False)
    got = spark.createDataFrame([(q,)], "q string").select(generate.cache_key(g, F.col("q"))).first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()


def test_path_guard(tmp_path):
    files.assert_mock_path(str(tmp_path / "results_mock/x"), str(tmp_path))
    with pytest.raises(RuntimeError):
        files.assert_mock_path(str(tmp_path / "results/x"), str(tmp_path))


def test_stream_answers_what_the_cache_lacks(spark, tmp_path):
    by_role = generate.generators("huggingface", "1.5b", True)
    rows = [(f"k{i}", "math", "q") for i in range(5)]
    spark.createDataFrame(rows, "key string, role string, query string").write.parquet(str(tmp_path / "in"))
    for n in range(2):
        s = spark.readStream.schema("key string, role string, query string").parquet(str(tmp_path / "in"))
        resume.start(s, by_role, str(tmp_path / "cache"), str(tmp_path / f"cp{n}")).awaitTermination()
        assert files.read_cache(spark, str(tmp_path / "cache")).count() == 5
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "cache").glob("*.json")) == 5
