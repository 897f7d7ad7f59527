"""Responses for items x roles, with an append-only cache."""

from __future__ import annotations

import gc
import importlib.util
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import MOCK_RESPONSE, MODELS, NUMERIC_SUFFIX, ROLES, SYSTEM_PROMPTS, generation_kwargs, resolve_dtype


def query_text(question: Column, verifier: Column) -> Column:
    """Numeric questions ask for a box."""
    return F.when(verifier == "numeric", F.concat(question, F.lit(NUMERIC_SUFFIX))).otherwise(question)


def chat(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


@dataclass
class Generator:
    """A backend for one role: `respond` maps queries to (response, new tokens or None) where it runs, batch by batch."""

    kind: str
    model_id: str
    role: str
    device: str | None = None
    dtype: str | None = None
    respond: Callable[[], Callable[[list[str]], list[tuple[str, int | None]]]] | None = None
    is_mock: bool = False

    def describe(self) -> dict:
        """Where and with what it runs; versions and threads where the libraries are installed."""
        if self.is_mock:
            return {}
        try:
            import torch
            import transformers
        except ImportError:
            return {"device": self.device}
        on_gpu = self.device == "cuda" and torch.cuda.is_available()
        return {"device": self.device, "dtype": resolve_dtype(self.device or "cpu", self.dtype), "torch": torch.__version__, "transformers": transformers.__version__, "num_threads": torch.get_num_threads(), "cuda_name": torch.cuda.get_device_name(0) if on_gpu else None}


def mock_response(role: str) -> str:
    return MOCK_RESPONSE.format(role=role)


#: Prompts that a model answers at once.
PROMPTS = 8


class ChatModel:
    """A chat model in the process that answers: loaded at the first call, let go by unload()."""

    def __init__(self, model_id: str, role: str, device: str, dtype: str | None):
        self.model_id, self.role, self.device, self.dtype = model_id, role, device, dtype
        self.model = self.tokenizer = None

    def load(self) -> None:
        if self.model is not None:
            return
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        if self.device == "cuda" and not torch.cuda.is_available():
            raise RuntimeError("this machine has no CUDA device; use --device cpu")
        self.tokenizer = AutoTokenizer.from_pretrained(self.model_id, padding_side="left")
        if self.tokenizer.pad_token_id is None:
            self.tokenizer.pad_token = self.tokenizer.eos_token
        kind = getattr(torch, resolve_dtype(self.device, self.dtype))
        try:
            model = AutoModelForCausalLM.from_pretrained(self.model_id, dtype=kind, low_cpu_mem_usage=True)
        except TypeError:  # the parameter's name in older versions
            model = AutoModelForCausalLM.from_pretrained(self.model_id, torch_dtype=kind, low_cpu_mem_usage=True)
        self.model = model.to(self.device).eval()

    def unload(self) -> None:
        self.model = self.tokenizer = None
        gc.collect()
        if self.device == "cuda":
            import torch

            torch.cuda.empty_cache()

    def __call__(self, queries: list[str]) -> list[tuple[str, int]]:
        """(response, new tokens) of each query, PROMPTS of them at a time, shorter prompts padded on the left."""
        self.load()
        import torch

        system = {"role": "system", "content": SYSTEM_PROMPTS[self.role]}
        pad, out = self.tokenizer.pad_token_id, []
        for i in range(0, len(queries), PROMPTS):
            prompts = [self.tokenizer.apply_chat_template([system, {"role": "user", "content": q}], tokenize=False, add_generation_prompt=True) for q in queries[i : i + PROMPTS]]
            x = self.tokenizer(prompts, return_tensors="pt", padding=True).to(self.device)
            with torch.inference_mode():
                made = self.model.generate(**x, **generation_kwargs(self.role), pad_token_id=pad)
            for row in made[:, x["input_ids"].shape[1] :]:
                ids = row.tolist()
                while ids and ids[-1] == pad:  # behind the shorter answers of a batch
                    ids.pop()
                out.append((self.tokenizer.decode(ids, skip_special_tokens=True).strip(), len(ids)))
        return out


def generator(backend: str, model_id: str, role: str, scale: str, is_mock: bool, device: str = "cpu", dtype: str | None = None) -> Generator:
    """The generator of a backend; mock overrides it."""
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    if is_mock:
        return Generator("MockRunner", model_id, role, respond=lambda: lambda qs: [(mock_response(role), None)] * len(qs), is_mock=True)
    if device not in ("cpu", "cuda") or dtype not in (None, "float32", "float16", "bfloat16"):
        raise ValueError(f"unsupported device or dtype: {device}, {dtype}")
    if backend == "ollama":

        def missing():
            raise NotImplementedError("the ollama backend is not implemented")

        return Generator("OllamaRunner", model_id, role, device, dtype, missing)
    if backend == "huggingface":
        return Generator("HuggingFaceRunner", model_id, role, device, dtype, lambda: ChatModel(model_id, role, device, dtype))
    raise ValueError(f"unknown backend: {backend}")


def generators(backend: str, scale: str, is_mock: bool, device: str = "cpu") -> dict[str, Generator]:
    return {r: generator(backend, MODELS[scale][r], r, scale, is_mock, device) for r in ROLES}


def missing_dependency(backend: str, is_mock: bool, more: tuple[str, ...] = ()) -> str | None:
    """Why a run can't start, or None; `more` names libraries that the run needs besides the backend's."""
    if is_mock:
        return None
    if backend == "ollama":
        return "The ollama backend is not implemented. Use --backend huggingface."
    for name in ("torch", "transformers", *more):
        if importlib.util.find_spec(name) is None:
            return f"Missing dependency: No module named '{name}'."
    return None


def json_string(c: Column) -> Column:
    """The column as a JSON string, as Python's json.dumps(ensure_ascii=False) writes it."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    names = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(names.get(i, f"\\u{i:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cache_key(g: Generator, query: Column, system: str | None = None, settings: dict | None = None) -> Column:
    """SHA-256 of everything a response depends on."""
    head = [g.kind, g.model_id, g.role, SYSTEM_PROMPTS[g.role] if system is None else system, generation_kwargs(g.role) if settings is None else settings, g.device, g.dtype]
    text = json.dumps(head, sort_keys=True, ensure_ascii=False)[:-1] + ", "
    return F.sha2(F.concat(F.lit(text), json_string(query), F.lit("]")).cast("binary"), 256)


def requests(items: DataFrame, by_role: dict[str, Generator]) -> DataFrame:
    """(split, ord, id, role, query, key) for all items x roles."""
    q = items.withColumn("query", query_text(F.col("question"), F.col("verifier")))
    each = [q.select("split", "ord", F.col("id").cast("string").alias("id"), F.lit(r).alias("role"), "query", cache_key(g, F.col("query")).alias("key")) for r, g in by_role.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def hits(req: DataFrame, cache: DataFrame) -> DataFrame:
    return req.join(cache, "key")


def misses(req: DataFrame, cache: DataFrame) -> DataFrame:
    """One request for each key that the cache lacks."""
    return req.join(cache, "key", "left_anti").dropDuplicates(["key"])


def generate(todo: DataFrame, g: Generator) -> DataFrame:
    """(key, response, seconds, new_tokens) for a role's requests; the model is loaded once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = None
        try:
            for b in batches:
                answer = answer or g.respond()
                t = time.perf_counter()
                got = answer(b["query"].tolist())
                each = (time.perf_counter() - t) / max(1, len(b))
                yield pd.DataFrame({"key": b["key"], "response": [x for x, _ in got], "seconds": each, "new_tokens": pd.array([n for _, n in got], "Int64")})
        finally:
            if hasattr(answer, "unload"):
                answer.unload()

    return todo.where(F.col("role") == g.role).select("key", "query").mapInPandas(run, "key string, response string, seconds double, new_tokens long")


def timing(req: DataFrame, made: DataFrame) -> DataFrame:
    """By role: n_generated, n_cached, seconds, sec_per_generation, new_tokens, tokens_per_sec.

    made has the keys answered in this run; further requests for one of them count as cached.
    """
    m = made.select("key", "seconds", "new_tokens").withColumn("made", F.lit(1))
    first = req.groupBy("role", "key").agg(F.count("*").alias("asked")).join(m, "key", "left")
    return rollup(first)


def rollup(first: DataFrame) -> DataFrame:
    """The timing of (role, asked, made, seconds, new_tokens) rows."""
    t = first.groupBy("role").agg(F.coalesce(F.sum("made"), F.lit(0)).cast("long").alias("n_generated"), (F.sum("asked") - F.coalesce(F.sum("made"), F.lit(0))).cast("long").alias("n_cached"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.sum("new_tokens").alias("new_tokens"))
    return t.select("role", "n_generated", "n_cached", "seconds", F.when(F.col("n_generated") > 0, F.col("seconds") / F.col("n_generated")).alias("sec_per_generation"), "new_tokens", F.when((F.col("new_tokens") > 0) & (F.col("seconds") > 0), F.col("new_tokens") / F.col("seconds")).alias("tokens_per_sec"))


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("key"), F.lit("").alias("response"))
