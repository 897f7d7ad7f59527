"""Evaluation items from JSON arrays, with validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import ROLES, VERIFIERS

BENCHMARKS = {"smoke": ("smoke_val.json", "smoke_test.json"), "real": ("val_set.json", "test_set.json")}


def dataset_paths(benchmark: str, folder: str = "data") -> tuple[str, str]:
    """The files of a benchmark's two splits."""
    if benchmark not in BENCHMARKS:
        raise ValueError(f"Unknown benchmark: {benchmark}")
    return tuple(f"{folder}/{name}" for name in BENCHMARKS[benchmark])


def raw_items(spark: SparkSession, path: str) -> DataFrame:
    """(ord, v variant): the elements of the file's array in order."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    top = whole.select(F.schema_of_variant("v").alias("t")).first()
    if top is None or top["t"] is None or not top["t"].startswith("ARRAY"):
        raise ValueError(f"{path}: the top level must be a list")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<variant>"))).select(F.col("pos").cast("long").alias("ord"), F.col("col").alias("v"))


def _text(path: str):
    return F.try_variant_get("v", path, "string")


def typed(raw: DataFrame) -> DataFrame:
    """(ord, id, category, question, verifier, answer_terms, answer_num, answer_letter, test_assertions, rel_tol, abs_tol)."""
    num = F.try_variant_get("v", "$.answer", "double")
    return raw.select(
        "ord",
        _text("$.id").alias("id"),
        _text("$.category").alias("category"),
        _text("$.question").alias("question"),
        _text("$.verifier").alias("verifier"),
        F.try_variant_get("v", "$.answer", "array<string>").alias("answer_terms"),
        F.when(_text("$.verifier") == "numeric", num).alias("answer_num"),
        F.when(_text("$.verifier") == "mcq_letter", _text("$.answer")).alias("answer_letter"),
        _text("$.test_assertions").alias("test_assertions"),
        F.try_variant_get("v", "$.rel_tol", "double").alias("rel_tol"),
        F.try_variant_get("v", "$.abs_tol", "double").alias("abs_tol"),
    )


def _kind(path: str):
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def violations(raw: DataFrame) -> DataFrame:
    """(ord, rule, message): every broken rule of every item."""
    verifier, answer = _text("$.verifier"), _kind("$.answer")
    has = lambda p: F.try_variant_get("v", p, "variant").isNotNull()
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    plain = verifier.isin("contains", "numeric", "mcq_letter")
    letters = _text("$.answer").isin("A", "B", "C", "D") & (answer == "STRING")
    number = answer.isin("BIGINT", "DOUBLE", "FLOAT") | answer.startswith("DECIMAL")
    rules = [
        (2, ~is_object, "not an object"),
        (3, is_object & ~has("$.id"), "id is missing"),
        (4, is_object & (F.col("nth") > 1), "duplicate id"),
        *[(5, is_object & ~has(f"$.{k}"), f"{k} is missing") for k in ("category", "question", "verifier")],
        (6, has("$.category") & ~F.coalesce(_text("$.category").isin(ROLES), F.lit(False)), "unknown category"),
        (7, has("$.verifier") & ~F.coalesce(verifier.isin(VERIFIERS), F.lit(False)), "unknown verifier"),
        (8, (verifier == "python_exec") & ~has("$.test_assertions"), "test_assertions is missing"),
        (9, (verifier == "python_exec") & has("$.test_assertions") & ((_kind("$.test_assertions") != "STRING") | (F.trim(_text("$.test_assertions")) == "")), "test_assertions must be a non-blank string"),
        (10, plain & ~has("$.answer"), "answer is missing"),
        (11, (verifier == "contains") & has("$.answer") & ~answer.isin("ARRAY<STRING>", "ARRAY<VOID>"), "answer must be a list of strings"),
        (12, (verifier == "numeric") & has("$.answer") & ~number, "answer must be a number"),
        (13, (verifier == "mcq_letter") & has("$.answer") & ~F.coalesce(letters, F.lit(False)), "answer must be A, B, C or D"),
    ]
    seen = raw.withColumn("id", _text("$.id")).withColumn("nth", F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("id").orderBy("ord"))))
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(m).alias("message"))) for n, c, m in rules])
    return seen.select("ord", "id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("ord", "id", "f.rule", "f.message")


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """The file's items; an error for its first broken rule."""
    raw = raw_items(spark, path)
    first = violations(raw).orderBy("ord", "rule").head()
    if first:
        raise ValueError(f"{path}: item {first['ord']} ({first['id']}): {first['message']}")
    return typed(raw)


def overlap(val: DataFrame, test: DataFrame) -> DataFrame:
    """Ids that stand in both splits."""
    return val.select(F.col("id").cast("string").alias("id")).intersect(test.select(F.col("id").cast("string").alias("id")))


def assert_disjoint(val: DataFrame, test: DataFrame) -> None:
    both = overlap(val, test).agg(F.array_sort(F.collect_set("id")).alias("ids")).first()["ids"]
    if both:
        raise ValueError(f"ids in both splits: {both}")


def limited(items: DataFrame, n: int | None) -> DataFrame:
    """The first n items by order; None for all."""
    if n is None:
        return items
    if n < 0:
        raise ValueError("a limit can't be negative")
    return items.orderBy("ord").limit(n)
