"""A whole evaluation: load, generate what the cache lacks, calibrate or load the router, route, score, report.

Exit codes: 0, or 2 for bad input, missing files or dependencies, and errors while generating.
"""

from __future__ import annotations

import argparse
import platform
import subprocess
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import answers, vectors
from ..operators import generate, metrics
from ..operators.generate import Generator
from ..operators.router import Router
from ..settings import DEFAULT_SEED, EMBEDDING_MODEL, MODELS, N_CLUSTERS, ROLES, SIZE_CONFOUND_NOTE, SYSTEM_PROMPTS, generation_settings
from ..sources import files, items


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--scale", choices=list(MODELS), default="1.5b")
    p.add_argument("--backend", choices=["huggingface", "ollama"], default="huggingface")
    p.add_argument("--mock", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--skip-calibration", action="store_true")
    p.add_argument("--seed", type=int, default=DEFAULT_SEED)
    p.add_argument("--benchmark", choices=list(items.BENCHMARKS), default="smoke")
    p.add_argument("--device", choices=["cpu", "cuda"], default="cpu")
    p.add_argument("--val-limit", type=int)
    p.add_argument("--data", default="data")
    p.add_argument("--root", default=".")
    return p


def run(spark: SparkSession, args: argparse.Namespace, make: Callable[..., dict[str, Generator]] = generate.generators, embed: Callable[[DataFrame, str, str], DataFrame] | None = None) -> int:
    try:
        return _run(spark, args, make, embed)
    except FileNotFoundError as e:
        print(f"no such data file: {e}", file=sys.stderr)
    except ValueError as e:
        print(f"Validation error: {e}", file=sys.stderr)
    return 2


def embedder(mock: bool, given=None):
    """(embedder, its name): the one given, hashed words for mock runs, else the sentence model."""
    if given:
        return given, getattr(given, "__name__", "given")
    return (vectors.hash_embed, "hash_embed") if mock else (vectors.sentence_embed(EMBEDDING_MODEL), EMBEDDING_MODEL)


def _exists(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)


def _run(spark: SparkSession, args: argparse.Namespace, make, embed) -> int:
    folder = files.run_dir(args.root, args.scale, args.benchmark, args.seed, args.device, args.mock)
    state = f"{args.root}/{'artifacts_mock' if args.mock else 'router_state'}/router_state.json"
    if args.mock:
        for p in (folder, state):
            files.assert_mock_path(p, args.root)
    paths = items.dataset_paths(args.benchmark, args.data)
    for p in paths:
        _exists(spark, p)
    val, test = (items.load_items(spark, p) for p in paths)
    items.assert_disjoint(val, test)
    if args.val_limit is not None and args.val_limit < N_CLUSTERS:
        print(f"--val-limit {args.val_limit} is less than {N_CLUSTERS} clusters", file=sys.stderr)
        return 2
    val, test = items.limited(val, args.val_limit).persist(), items.limited(test, args.limit).persist()
    by_role = make(args.backend, args.scale, args.mock, args.device)
    why = generate.missing_dependency(args.backend, args.mock, () if embed else ("sentence_transformers",))
    if why:
        print(why, file=sys.stderr)
        return 2

    tagged = test.withColumn("split", F.lit("test"))
    if not args.skip_calibration:
        tagged = val.withColumn("split", F.lit("val")).unionByName(tagged)
    req = generate.requests(tagged, by_role).persist()
    store = f"{folder}/generation_cache"
    cache = files.read_cache(spark, store).persist()
    todo = generate.misses(req, cache).persist()
    made = None
    for role in ROLES:  # one model at a time
        new = generate.generate(todo, by_role[role]).persist()
        try:
            new.count()
        except Exception as e:
            print(f"generating for {role} failed: {str(e)[-300:]} (a smaller --scale or --device cpu may help)", file=sys.stderr)
            return 2
        files.append_cache(new, store)
        made = new if made is None else made.unionByName(new)
    answered = cache.unionByName(made.select("key", "response"))
    responses = req.join(answered, "key").persist()
    table = answers.scored(responses.join(tagged.withColumn("id", F.col("id").cast("string")).drop("ord", "question", "category"), ["split", "id"])).select("split", "ord", "id", "role", "score").persist()

    how, name = embedder(args.mock, embed)
    if args.skip_calibration:
        try:
            router = files.load_state(state, embed=how)
        except FileNotFoundError:
            print(f"no router state at {state}", file=sys.stderr)
            return 2
        summary: dict = {"skipped": True}
    else:
        router = Router(embed=how, embedding_name=name, seed=args.seed)
        summary = router.calibrate(val, table.where("split = 'val'").select("id", "role", "score"))
        files.save_state(router, state)

    scores = table.where("split = 'test'").groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("role", "score"))).alias("scores"))
    records = router.route(test).join(scores, "ord").withColumn("baseline", F.col("scores")["general"]).persist()
    m = metrics.compute(records)
    times = {r["role"]: {k: v for k, v in r.asDict().items() if k != "role"} for r in generate.timing(req, made).collect()}
    files.write_json(f"{folder}/metrics.json", m)
    rows = records.select("ord", F.to_json(F.struct(F.struct("id", "category", "question", "verifier").alias("item"), F.col("routed").alias("routed_specialist"), "scores", F.col("baseline").alias("baseline_score")), {"ignoreNullFields": "false"}).alias("j")).orderBy("ord")
    files.write_list(f"{folder}/records.json", (r["j"] for r in rows.toLocalIterator()))
    files.write_json(f"{folder}/calibration.json", summary)
    nested = files.nested_generations(responses)
    files.write_maps(f"{folder}/generations.json", {split: ((r["id"], r["responses"].asDict()) for r in nested.where(F.col("split") == split).orderBy("ord").toLocalIterator()) for split in ("val", "test")})
    files.write_json(f"{folder}/timing.json", {r: times[r] for r in ROLES})
    files.write_json(f"{folder}/run_config.json", _config(args, by_role, name, val.count(), test.count()))
    made_n, cached_n = (sum(t[k] for t in times.values()) for k in ("n_generated", "n_cached"))
    print(_summary(args, m, made_n, cached_n, folder))
    for d in (val, test, req, cache, todo, responses, table, records):
        d.unpersist()
    return 0


def _summary(args: argparse.Namespace, m: dict, made: int, cached: int, folder: str) -> str:
    """What a run prints at its end: its files hold the rest."""
    ci = "{acc:.1%} ({k} of {n}, 95 % interval {ci_lo:.1%} to {ci_hi:.1%})"
    lines = [
        f"{args.benchmark} benchmark at scale {args.scale}{', mock answers' if args.mock else ''}: {m['n']} test items",
        f"Routed accuracy {ci.format(**m['routed'])}",
        f"General role alone {ci.format(**m['baseline'])}, routing gains {m['delta']:+.1%}, McNemar p = {m['mcnemar']['p']:.3g}",
        f"Best role of each item {m['oracle']['acc']:.1%}",
        "Routed to " + ", ".join(f"{r}: {n}" for r, n in m["routing_counts"].items()),
        f"{made} answers made, {cached} from the cache; files in {folder}",
    ]
    return "\n".join(lines)


def _config(args: argparse.Namespace, by_role: dict[str, Generator], embedding: str, n_val: int, n_test: int) -> dict:
    head = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    out = {
        "args": vars(args),
        "models": MODELS[args.scale],
        "system_prompts": SYSTEM_PROMPTS,
        "gen_settings": {r: generation_settings(r) for r in ROLES},
        "n_val": n_val,
        "n_test": n_test,
        "mock": bool(args.mock),
        "embedding": embedding,
        "version": __version__,
        "git_commit": head.stdout.strip() or None,
        "python_version": platform.python_version(),
        "device": args.device,
        "val_limit": args.val_limit,
        "runner_describe": {r: g.describe() for r, g in by_role.items()},
    }
    return out | ({"size_confound_note": SIZE_CONFOUND_NOTE} if args.scale == "0.5b" else {})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("routeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
