"""Cache, router state and the files of a run, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path, PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import empty_cache
from ..operators.router import Router
from ..settings import DEFAULT_SEED, ROLES, STATE_VERSION

#: A line of the cache; `line` is its place in its batch (files from elsewhere have none).
LINE = "key string, response string, line long"


def _at(path: str):
    """The Hadoop file system of a path, and the path."""
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(folder: str) -> list[str]:
    fs, p = _at(folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(key, response) of an append-only folder of JSON lines; bad lines are skipped, of a repeated key the last one counts.

    Batches count in the order of the numbers in their files' names; files with other names are older than all of them, and
    among each other go by their time of change, name and lines.
    """
    if not any(".json" in n and n[0] not in "._" for n in _names(folder)):
        return empty_cache(spark)
    rows = spark.read.option("pathGlobFilter", "*.json*").text(folder)
    at = F.col("_metadata.file_path")
    batch = F.coalesce(F.regexp_extract(at, r"/batch-([0-9]+)-[^/]*\z", 1).try_cast("long"), F.lit(-1))
    rows = rows.select(F.from_json("value", LINE).alias("r"), batch.alias("b"), F.when(batch < 0, F.col("_metadata.file_modification_time")).alias("t"), F.when(batch < 0, at).alias("f"), F.when(batch < 0, F.col("_metadata.file_block_start")).alias("o"), F.monotonically_increasing_id().alias("i"))
    return last_wins(rows.select("r.key", "r.response", "b", "t", "f", F.coalesce("r.line", "o").alias("o"), "i"), "b", "t", "f", "o", "i")


def last_wins(rows: DataFrame, *order: str) -> DataFrame:
    """(key, response): the last response of each key."""
    return rows.where("key is not null and response is not null").groupBy("key").agg(F.max_by("response", F.struct(*order)).alias("response"))


def append_cache(made: DataFrame, folder: str) -> None:
    """Appends a batch, numbered above all there are; its files come whole from a hidden folder, so no line is ever cut off."""
    fs, p = _at(folder)
    fs.mkdirs(p)
    number = max([int(m[1]) for n in _names(folder) if (m := re.match(r"(?:batch-|_taken-)([0-9]+)", n))], default=0) + 1
    while True:  # of two writers that take a number at once, the one that makes its mark has it
        mark = _at(f"{folder}/_taken-{number}")[1]
        try:
            fs.create(mark, False).close()
            break
        except Exception:
            if not fs.exists(mark):
                raise
            number += 1
    hidden = f"{folder}/_batch-{number}"
    made.select("key", "response", F.monotonically_increasing_id().alias("line")).write.json(hidden)
    for i, name in enumerate(n for n in sorted(_names(hidden)) if n[0] not in "._"):
        fs.rename(_at(f"{hidden}/{name}")[1], _at(f"{folder}/batch-{number:012d}-{i:06d}.json{name.partition('.json')[2]}")[1])
    fs.delete(_at(hidden)[1], True)


def save_state(router: Router, path: str) -> None:
    if router.centroids is None:
        raise RuntimeError("the router is not calibrated")
    write_json(path, {"schema_version": STATE_VERSION, "embedding_model_name": router.embedding_name, "n_clusters": router.k, "seed": router.seed, "centroids": router.centroids, "capability_matrix": router.matrix, "assignment": router.roles})


def load_state(path: str, **how) -> Router:
    """A router from its state; the embedding model is not loaded."""
    s = json.loads(read_text(path))
    if s.get("schema_version") != STATE_VERSION:
        raise ValueError(f"unsupported schema_version: {s.get('schema_version')}")
    return Router(embedding_name=s["embedding_model_name"], k=s["n_clusters"], seed=s.get("seed", DEFAULT_SEED), centroids=s["centroids"], matrix={int(k): v for k, v in s["capability_matrix"].items()}, roles={int(k): v for k, v in s["assignment"].items()}, **how)


def read_text(path: str) -> str:
    fs, p = _at(path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, pieces: Iterable[str]) -> None:
    """The pieces one after the other, a bounded number of them at a time."""
    fs, p = _at(path)
    out = fs.create(p, True)
    try:
        held: list[str] = []
        for x in pieces:
            held.append(x)
            if len(held) == 1000:
                out.write(bytearray("".join(held).encode()))
                held = []
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def write_json(path: str, value) -> None:
    write_text(path, [json.dumps(value, indent=2, ensure_ascii=False)])


def _joined(parts: Iterator[str]) -> Iterator[str]:
    for i, x in enumerate(parts):
        yield (",\n" if i else "\n") + x


def write_list(path: str, rows: Iterator[str]) -> None:
    """A JSON array of rows that are JSON already."""

    def pieces() -> Iterator[str]:
        yield "["
        yield from _joined(rows)
        yield "\n]"

    write_text(path, pieces())


def write_maps(path: str, maps: dict[str, Iterator[tuple[str, dict]]]) -> None:
    """A JSON object of objects, the inner ones from (key, value) pairs."""

    def pieces() -> Iterator[str]:
        for i, (name, rows) in enumerate(maps.items()):
            yield f"{', ' if i else '{'}{json.dumps(name)}: {{"
            yield from _joined(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for k, v in rows)
            yield "\n}"
        yield "}"

    write_text(path, pieces())


def assert_mock_path(path: str, root: str = ".") -> None:
    """Mock runs must not write below `results` or `artifacts` (of the root, if the path lies in it)."""
    p, r = Path(path).resolve(), Path(root).resolve()
    parts = p.relative_to(r).parts if p.is_relative_to(r) else PurePath(path).parts
    if {"results", "artifacts"} & set(parts):
        raise RuntimeError(f"a mock run must not write to {path}")


def run_dir(root: str, scale: str, benchmark: str, seed: int, device: str, mock: bool) -> str:
    return f"{root}/{'results_mock' if mock else 'results'}/{scale}_{benchmark}_seed{seed}{'_cuda' if device == 'cuda' else ''}"


def nested_generations(rows: DataFrame) -> DataFrame:
    """(split, id, responses struct with a field for each role) of (split, id, role, response): one row an item."""
    return rows.groupBy("split", "id").agg(F.min("ord").alias("ord"), F.struct(*[F.max(F.when(F.col("role") == r, F.col("response"))).alias(r) for r in ROLES]).alias("responses"))
