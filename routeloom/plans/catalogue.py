"""Registered queries of the engine and the SQL that DuckDB answers them with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, stats, vectors
from ..operators import cluster, generate, metrics, router
from ..settings import NUMERIC_SUFFIX, ROLES, SYSTEM_PROMPTS
from ..sources import files, items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from rows of the driver."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def role_of(c):
    """A role by number."""
    return F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.pmod(c, F.lit(3)) + 1).cast("int"))


def sql_role(x: str) -> str:
    return f"(['general','math','code'])[(({x}) % 3 + 1)::INT]"


def sql_wilson(k: str, n: str) -> str:
    """lo and hi as two columns."""
    p, z2 = f"({k}::DOUBLE / {n}::DOUBLE)", "3.8415999999999997::DOUBLE"
    mid, half, under = f"({p} + {z2} / (2 * {n}))", f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n})))", f"(1 + {z2} / {n})"
    return f"round(greatest(0.0::DOUBLE, ({mid} - {half}) / {under}), 9) AS ci_lo, round(least(1.0::DOUBLE, ({mid} + {half}) / {under}), 9) AS ci_hi"


def sql_mcnemar(b: str, c: str) -> str:
    terms = f"list_sum(list_transform(range(least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) + ({b} + {c}) * ln(0.5::DOUBLE))))"
    return f"round(CASE WHEN {b} + {c} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * {terms}) END, 9) AS p"


# ---------------------------------------------------------------- statistics


@query(f"SELECT l_returnflag, k, n, round(k::DOUBLE / n, 9) AS acc, {sql_wilson('k', 'n')} FROM (SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def q_wilson_by_flag(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    s = stats.proportion(F.col("k"), F.col("n"))
    return a.select("l_returnflag", "k", "n", F.round(s["acc"], 9).alias("acc"), F.round(s["ci_lo"], 9).alias("ci_lo"), F.round(s["ci_hi"], 9).alias("ci_hi"))


@query(f"SELECT lang, b, c, {sql_mcnemar('b', 'c')} FROM (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1)")
def q_mcnemar_lang(spark, d):
    a = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    a = a.groupBy("lang").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"))
    return a.select("lang", "b", "c", F.round(stats.mcnemar_p(F.col("b"), F.col("c")), 9).alias("p"))


def records(spark, d):
    x = table(spark, d, "labels")
    score = F.create_map(F.lit("general"), F.col("quality").cast("double"), F.lit("math"), (F.col("doc_id") % 2).cast("double"), F.lit("code"), F.col("toxic").cast("double"))
    return x.select(F.col("doc_id").alias("ord"), role_of(F.col("doc_id")).alias("category"), role_of(F.floor(F.col("doc_id") / 2)).alias("routed"), score.alias("scores"), F.col("quality").cast("double").alias("baseline"))


_FLAGS = f"""r AS (SELECT doc_id, {sql_role('doc_id')} AS category, {sql_role('doc_id // 2')} AS routed, quality AS g, (doc_id % 2)::INT AS m, toxic AS c FROM labels),
f AS (SELECT *, (CASE routed WHEN 'general' THEN g WHEN 'math' THEN m ELSE c END) = 1 AS rok, g = 1 AS bok, greatest(g, m, c) = 1 AS ook FROM r)"""


@query(
    f"""WITH {_FLAGS}, t AS (SELECT count(*) AS n, count(*) FILTER (rok) AS rk, count(*) FILTER (bok) AS bk, count(*) FILTER (ook) AS ok, count(*) FILTER (m = 1) AS mk, count(*) FILTER (c = 1) AS ck,
count(*) FILTER (rok AND NOT bok) AS b, count(*) FILTER (NOT rok AND bok) AS c FROM f)
SELECT n, rk, bk, ok, mk, ck, b, c, round((rk - bk)::DOUBLE / n, 9) AS delta, {sql_wilson('rk', 'n')}, {sql_mcnemar('b', 'c')} FROM t"""
)
def q_metrics_overall(spark, d):
    m = metrics.overall(records(spark, d))
    return m.select("n", F.col("routed.k").alias("rk"), F.col("baseline.k").alias("bk"), F.col("oracle.k").alias("ok"), F.col("always_math.k").alias("mk"), F.col("always_code.k").alias("ck"), "mcnemar.b", "mcnemar.c", F.round("delta", 9).alias("delta"), F.round("routed.ci_lo", 9).alias("ci_lo"), F.round("routed.ci_hi", 9).alias("ci_hi"), F.round("mcnemar.p", 9).alias("p"))


@query(f"WITH {_FLAGS} SELECT category, count(*) AS n, round(avg(rok::INT), 9) AS routed_acc, round(avg(bok::INT), 9) AS baseline_acc FROM f GROUP BY 1")
def q_metrics_per_category(spark, d):
    return metrics.per_category(records(spark, d)).select("category", "n", F.round("routed_acc", 9).alias("routed_acc"), F.round("baseline_acc", 9).alias("baseline_acc"))


@query(f"WITH {_FLAGS} SELECT count(*) FILTER (routed = 'general') AS general, count(*) FILTER (routed = 'math') AS math, count(*) FILTER (routed = 'code') AS code FROM f")
def q_routing_counts_zero_filled(spark, d):
    return metrics.overall(records(spark, d)).select("routing_counts.*")


@query("SELECT doc_id FROM labels WHERE quality <> 1 AND doc_id % 5 = 0")
def q_record_violations(spark, d):
    """Records whose baseline is spoilt for every fifth id."""
    r = records(spark, d).withColumn("baseline", F.when(F.col("ord") % 5 == 0, 1.0).otherwise(F.col("baseline")))
    return metrics.violations(r).select(F.col("ord").alias("doc_id"))


@query(f"WITH {_FLAGS} SELECT category, count(*) FILTER (ook) AS oracle_k, count(*) FILTER (c = 1) AS code_k, count(*) FILTER (m = 1) AS math_k FROM f GROUP BY 1")
def q_row_oracle(spark, d):
    f = metrics.flags(records(spark, d))
    return f.groupBy("category").agg(F.count_if("oracle_ok").alias("oracle_k"), F.count_if("ok_code").alias("code_k"), F.count_if("ok_math").alias("math_k"))


@query(f"WITH {_FLAGS} SELECT (row_number() OVER (ORDER BY min(doc_id)))::INTEGER AS nth, category, count(*) AS n, round(avg(rok::INT), 9) AS routed_acc, round(avg(bok::INT), 9) AS baseline_acc, (SELECT count(*) FILTER (rok) FROM f) AS routed_k, (SELECT count(*) FILTER (c = 1) FROM f) AS code_k, (SELECT count(*) FILTER (ook) FROM f) AS oracle_k FROM f GROUP BY category")
def q_metrics_computed(spark, d):
    """The whole metrics of a run, its categories in the order in which records first show them."""
    m = metrics.compute(records(spark, d))
    whole = {"routed_k": m["routed"]["k"], "code_k": m["always"]["code"]["k"], "oracle_k": m["oracle"]["k"]}
    rows = [{"nth": i, "category": c, **v, **whole} for i, (c, v) in enumerate(m["per_category"].items(), 1)]
    r = literal(spark, rows, "nth int, category string, n bigint, routed_acc double, baseline_acc double, routed_k bigint, code_k bigint, oracle_k bigint")
    return r.withColumn("routed_acc", F.round("routed_acc", 9)).withColumn("baseline_acc", F.round("baseline_acc", 9))


# ---------------------------------------------------------------- vectors, clusters, routing


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") % 3).alias("g"))


def centroids(spark, d, where: str = "true") -> list[list[float]]:
    """Three centroids, of the groups label % 3."""
    return [r["centroid"] for r in cluster.group_centroids(emb(spark, d).where(where), "g").orderBy("g").collect()]


def placed(spark, d):
    return emb(spark, d).withColumn("cluster", vectors.nearest(F.col("v"), centroids(spark, d)))


def sql_centroids(where: str = "true") -> str:
    return f"""e AS (SELECT vec_id, label, label % 3 AS g, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, g, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e WHERE {where}),
p AS (SELECT g, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS x FROM u),
m AS (SELECT g, list(a ORDER BY pos) AS v FROM (SELECT g, pos, avg(x) AS a FROM p GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT g, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM m),
s AS (SELECT e.vec_id, e.label, arg_max(c.g, (list_inner_product(e.v, c.v), -c.g)) AS cluster, max(list_inner_product(e.v, c.v)) AS sim FROM e CROSS JOIN c GROUP BY 1, 2)"""


@query(f"WITH {sql_centroids()} SELECT g, pos, round(x, 6) AS x FROM (SELECT g, unnest(generate_series(0, len(v) - 1)) AS pos, unnest(v) AS x FROM c)")
def q_lloyd_step(spark, d):
    return cluster.group_centroids(emb(spark, d), "g").select("g", F.posexplode("centroid").alias("pos", "x")).select("g", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {sql_centroids()} SELECT vec_id, cluster FROM s")
def q_nearest_centroid(spark, d):
    return placed(spark, d).select("vec_id", "cluster")


@query(f"WITH {sql_centroids()} SELECT round(sum(sim), 6) AS total FROM s")
def q_total_similarity(spark, d):
    c = centroids(spark, d)
    return emb(spark, d).agg(F.round(F.sum(F.array_max(vectors.similarities(F.col("v"), c))), 6).alias("total"))


@query(f"WITH {sql_centroids()} SELECT cluster, {sql_role('label')} AS category, count(*) AS n FROM s GROUP BY 1, 2")
def q_cluster_category_hist(spark, d):
    return router.category_counts(placed(spark, d).withColumn("category", role_of(F.col("label"))))


@query(f"WITH {sql_centroids()} SELECT k.cluster::INTEGER AS cluster, count(s.vec_id) AS size FROM (SELECT unnest([0, 1, 2, 3]) AS cluster) k LEFT JOIN s ON s.cluster = k.cluster GROUP BY 1")
def q_cluster_sizes_zero_filled(spark, d):
    """Four clusters, of which the last has no member."""
    return router.sizes(placed(spark, d), 4)


@query(f"WITH {sql_centroids()}, z AS (SELECT k.cluster::INTEGER AS cluster, count(s.vec_id) AS size FROM (SELECT unnest([0, 1, 2, 3]) AS cluster) k LEFT JOIN s ON s.cluster = k.cluster GROUP BY 1) SELECT cluster, 'Cluster ' || cluster || ' has only ' || size || ' items (< min_cluster_warn=10).' AS message FROM z WHERE size < 10")
def q_undersize_clusters(spark, d):
    return router.undersized(router.sizes(placed(spark, d), 4), 10)


_SCORES = "(CASE role WHEN 'general' THEN (vec_id % 2) WHEN 'math' THEN (label < 5)::INT ELSE (label % 2) END)::DOUBLE"


def role_scores(spark, x):
    every = x.crossJoin(F.broadcast(router.role_table(spark)))
    s = F.when(F.col("role") == "general", F.col("vec_id") % 2).when(F.col("role") == "math", (F.col("label") < 5).cast("long")).otherwise((F.col("label") % 2).cast("long"))
    return every.withColumn("score", s.cast("double"))


_MATRIX = f"q AS (SELECT s.*, role, {_SCORES} AS score FROM s CROSS JOIN (SELECT unnest(['general', 'math', 'code']) AS role)), cm AS (SELECT cluster, role, avg(score) AS mean_score FROM q GROUP BY 1, 2)"
_ASSIGN = "pv AS (SELECT cluster, max(mean_score) FILTER (role = 'general') AS g, max(mean_score) FILTER (role = 'math') AS m, max(mean_score) FILTER (role = 'code') AS c FROM cm GROUP BY 1), asg AS (SELECT cluster, CASE WHEN c > g AND c > m THEN 'code' WHEN m > g THEN 'math' WHEN c > g THEN 'code' ELSE 'general' END AS role FROM pv)"


@query(f"WITH {sql_centroids()}, {_MATRIX} SELECT cluster, role, round(mean_score, 9) AS mean_score FROM cm")
def q_capability_matrix(spark, d):
    return router.capability(role_scores(spark, placed(spark, d)), 3).select("cluster", "role", F.round("mean_score", 9).alias("mean_score"))


@query(f"WITH {sql_centroids()}, {_MATRIX}, {_ASSIGN} SELECT cluster, role FROM asg")
def q_assignment(spark, d):
    return router.assignment(router.capability(role_scores(spark, placed(spark, d)), 3))


@query(f"WITH {sql_centroids()}, {_MATRIX}, {_ASSIGN} SELECT vec_id, cluster, role AS routed FROM s JOIN asg USING (cluster)")
def q_route_batch(spark, d):
    roles = {r["cluster"]: r["role"] for r in q_assignment(spark, d).collect()}
    cl, role = router.Router(centroids=centroids(spark, d), roles=roles).route_vectors(F.col("v"))
    return emb(spark, d).select("vec_id", cl.alias("cluster"), role.alias("routed"))


@query(
    f"""WITH {sql_centroids('vec_id % 3 <> 0')}, val AS (SELECT * FROM s WHERE vec_id % 3 <> 0),
{_MATRIX.replace('FROM s CROSS', 'FROM val s CROSS')}, {_ASSIGN},
t AS (SELECT s.vec_id, s.label, asg.role AS routed FROM s JOIN asg USING (cluster) WHERE s.vec_id % 3 = 0),
f AS (SELECT *, vec_id % 2 AS gs, (label < 5)::INT AS ms, label % 2 AS cs FROM t),
h AS (SELECT *, (CASE routed WHEN 'general' THEN gs WHEN 'math' THEN ms ELSE cs END) = 1 AS rok, gs = 1 AS bok, greatest(gs, ms, cs) = 1 AS ook FROM f),
z AS (SELECT count(*) AS n, count(*) FILTER (rok) AS rk, count(*) FILTER (bok) AS bk, count(*) FILTER (ook) AS ok, count(*) FILTER (rok AND NOT bok) AS b, count(*) FILTER (NOT rok AND bok) AS c FROM h)
SELECT n, rk, bk, ok, b, c, {sql_wilson('rk', 'n')}, {sql_mcnemar('b', 'c')} FROM z"""
)
def q_flagship(spark, d):
    """Centroids and assignment from two thirds of the vectors, routing and metrics on the rest."""
    c = centroids(spark, d, "vec_id % 3 <> 0")
    x = emb(spark, d).withColumn("cluster", vectors.nearest(F.col("v"), c))
    roles = router.assignment(router.capability(role_scores(spark, x.where("vec_id % 3 <> 0")), 3)).withColumnRenamed("role", "routed")
    test = role_scores(spark, x.where("vec_id % 3 = 0")).groupBy("vec_id", "cluster", "label").agg(F.map_from_entries(F.collect_list(F.struct("role", "score"))).alias("scores"))
    r = test.join(F.broadcast(roles), "cluster").select(F.col("vec_id").alias("ord"), role_of(F.col("label")).alias("category"), "routed", "scores", F.col("scores")["general"].alias("baseline"))
    m = metrics.overall(r)
    return m.select("n", F.col("routed.k").alias("rk"), F.col("baseline.k").alias("bk"), F.col("oracle.k").alias("ok"), "mcnemar.b", "mcnemar.c", F.round("routed.ci_lo", 9).alias("ci_lo"), F.round("routed.ci_hi", 9).alias("ci_hi"), F.round("mcnemar.p", 9).alias("p"))


@query(f"WITH {sql_centroids()} SELECT e.vec_id, round(pow(greatest(0.0::DOUBLE, 1 - max(list_inner_product(e.v, f.v))), 2), 6) AS weight FROM e CROSS JOIN (SELECT v FROM e WHERE vec_id < 2) f GROUP BY 1")
def q_kmeans_pp_dsq(spark, d):
    """Each vector's chance (not yet divided by the sum) to be the next start, after the first two vectors."""
    first = [r["v"] for r in emb(spark, d).where("vec_id < 2").orderBy("vec_id").collect()]
    w = F.pow(F.greatest(F.lit(0.0), 1 - F.array_max(vectors.similarities(F.col("v"), first))), 2)
    return emb(spark, d).select("vec_id", F.round(w, 6).alias("weight"))


@query()
def q_kmeans_fit(spark, d):
    """Sizes of the clusters that the full fit finds."""
    x = emb(spark, d).select(F.col("vec_id").alias("ord"), "v")
    model = cluster.SphericalKMeans().fit(x)
    return router.sizes(x.select(model.predict(F.col("v")).alias("cluster")), model.k)


def sql_lloyd(steps: int) -> str:
    """c0 to c<steps>: the first vector of each group, and the centroids after each step."""
    out = ["u AS (SELECT vec_id, label % 3 AS g, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))", "c0 AS (SELECT g AS c, arg_min(v, vec_id) AS v FROM u GROUP BY 1)"]
    for i in range(steps):
        out += [
            f"a{i} AS (SELECT u.vec_id, any_value(u.v) AS v, arg_max(c{i}.c, (list_inner_product(u.v, c{i}.v), -c{i}.c)) AS c FROM u CROSS JOIN c{i} GROUP BY 1)",
            f"m{i} AS (SELECT c, list(x ORDER BY pos) AS v FROM (SELECT c, pos, avg(x) AS x FROM (SELECT c, unnest(range(len(v))) AS pos, unnest(v) AS x FROM a{i}) GROUP BY 1, 2) GROUP BY 1)",
            f"c{i + 1} AS (SELECT c, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM m{i})",
        ]
    return ", ".join(out)


@query(f"WITH {sql_lloyd(3)} SELECT c::INTEGER AS cluster, unnest(range(len(v)))::INTEGER AS pos, round(unnest(v), 6) AS x FROM c3")
def q_kmeans_three_steps(spark, d):
    """The centroids of a fit that starts from the first vector of each group and stops after three steps."""
    e = emb(spark, d)
    first = e.groupBy("g").agg(F.min_by(vectors.unit(F.col("v")), "vec_id").alias("v")).orderBy("g").collect()  # three rows
    model = cluster.SphericalKMeans(3, restarts=1, max_iter=3).fit(e.select(F.col("vec_id").alias("ord"), "v"), [[r["v"] for r in first]])
    rows = [{"cluster": c, "pos": i, "x": x} for c, v in enumerate(model.centroids) for i, x in enumerate(v)]
    return literal(spark, rows, "cluster int, pos int, x double").withColumn("x", F.round("x", 6))


def axes(items, key, question):
    """Embeds by what the question begins with: one of three axes."""
    return items.select(key, F.array(*[(F.substring(question, 1, 1) == str(i)).cast("double") for i in range(3)]).alias("v"))


@query(
    """WITH i AS (SELECT c_custkey AS ord, c_custkey % 3 AS g, c_nationkey AS k FROM customer),
m AS (SELECT g, avg((k % 2 = 0)::INT) AS general, avg(CASE g WHEN 0 THEN (k % 2 = 0)::INT ELSE ((k + g) % 3 > 0)::INT END) AS math, avg(CASE g WHEN 1 THEN 0 ELSE (k % 2 = 0 OR g = 2 AND k % 5 > 0)::INT END) AS code FROM i GROUP BY 1),
a AS (SELECT *, CASE WHEN code > general AND code > math THEN 'code' WHEN math > general THEN 'math' WHEN code > general THEN 'code' ELSE 'general' END AS routed FROM m)
SELECT ord, routed, round(general, 9) AS general, round(math, 9) AS math, round(code, 9) AS code FROM i JOIN a USING (g)"""
)
def q_calibrated_routes(spark, d):
    """A whole calibration - embedding, the fit from drawn starts, capability matrix, roles - and the routes of the same rows.

    The rows lie on three axes, so that every right fit finds the same clusters; on the first all roles are equally good.
    """
    k, g = F.col("c_nationkey"), F.col("c_custkey") % 3
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), F.concat_ws(" ", g, "c_name").alias("question"), role_of(k).alias("category"), k.alias("k"), g.alias("g"))

    def scores(asked):
        even, k, g = F.col("k") % 2 == 0, F.col("k"), F.col("g")
        math = F.when(g == 0, even).otherwise((k + g) % 3 > 0)
        code = F.when(g == 1, False).otherwise(even | ((g == 2) & (k % 5 > 0)))
        return asked.select("id", "role", F.when(F.col("role") == "general", even).when(F.col("role") == "math", math).otherwise(code).cast("double").alias("score"))

    r = router.Router(embed=axes)
    r.calibrate(rows, scores, min_cluster_warn=0)
    means = literal(spark, [{"cluster": c, **by} for c, by in r.matrix.items()], "cluster int, general double, math double, code double")
    return r.route(rows).join(F.broadcast(means), "cluster").select("ord", "routed", *[F.round(x, 9).alias(x) for x in ROLES])


_TOKENS = "tk AS (SELECT {id} AS id, unnest(CASE WHEN len(t) = 0 THEN ['<empty>'] ELSE t END) AS t FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {table})), w AS (SELECT id, (md5_number_upper(t) % 384)::INTEGER AS idx, sum(CASE WHEN md5_number_lower(t) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS w FROM tk GROUP BY 1, 2)"


@query(f"WITH {_TOKENS.format(id='doc_id', table='documents')} SELECT id AS doc_id, idx, w FROM w")
def q_hash_embed_sparse(spark, d):
    return vectors.token_weights(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_TOKENS.format(id='item_id', table='benchmark')}, n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1) SELECT id AS item_id, round(max(abs(w) / n), 6) AS top, count(*) FILTER (w <> 0) AS used FROM w JOIN n USING (id) GROUP BY 1")
def q_hash_embed_norm(spark, d):
    v = vectors.hash_embed(table(spark, d, "benchmark"), "item_id", "text")
    return v.select("item_id", F.round(F.array_max(F.transform("v", F.abs)), 6).alias("top"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("used"))


# ---------------------------------------------------------------- answers


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(the|und|une|los)([^\\p{L}\\p{N}_]|$)') AS hit FROM documents")
def q_contains(spark, d):
    terms = F.array(*[F.lit(t) for t in ("the", "", "und", "une", "LOS")])
    return table(spark, d, "documents").select("doc_id", answers.contains(F.col("text"), terms).alias("hit"))


_NUMBER = r"((?:[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?))"


@query(rf"SELECT doc_id, replace(list_last(regexp_extract_all(' ' || text, '[^\p{{L}}\p{{N}}_]{_NUMBER}\b', 1)), ',', '')::DOUBLE AS value FROM documents WHERE len(regexp_extract_all(' ' || text, '[^\p{{L}}\p{{N}}_]{_NUMBER}\b', 1)) > 0")
def q_bare_number(spark, d):
    """The last number of each text, by the reader that scoring uses."""
    return table(spark, d, "documents").select("doc_id", answers.bare_number(F.col("text")).alias("value")).where("value is not null")


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity::BIGINT WHEN 1 THEN l_quantity::BIGINT / 4.0::DOUBLE ELSE (l_quantity::BIGINT * 1000)::DOUBLE END AS value FROM lineitem")
def q_boxed_number(spark, d):
    """Numbers in boxes: plain with a sign of percent, as a fraction, with commas; a second box wins over the first."""
    q = F.col("q").cast("string")
    box = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("$"), q, F.lit("\\%"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("\\dfrac{"), q, F.lit("}{4}"))).otherwise(F.concat(q, F.lit(",000")))
    text = F.concat(F.lit("first \\boxed{1}, then 7 and \\boxed{"), F.replace(box, F.lit("\\%"), F.lit("%")), F.lit("}. Done 99"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", answers.number(text).alias("value"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 2 + l_quantity::BIGINT * 3.0::DOUBLE WHEN 2 THEN pow(l_quantity::BIGINT, 2) WHEN 3 THEN floor(-l_quantity::BIGINT / 4.0) ELSE NULL END::DOUBLE AS value FROM lineitem")
def q_safe_arith(spark, d):
    q = F.col("q").cast("string")
    e = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("2 + "), q, F.lit(" * 3"))).when(F.col("l_linenumber") == 2, F.concat(q, F.lit("**2"))).when(F.col("l_linenumber") == 3, F.concat(F.lit("-"), q, F.lit(" // 4"))).otherwise(F.concat(F.lit("__import__('os') + "), q))
    return lines(spark, d).select("l_orderkey", "l_linenumber", answers.safe_arithmetic(e).alias("value"))


@query("SELECT l_orderkey, l_linenumber, abs(x - y) <= greatest(0.001 * greatest(abs(x), abs(y)), 0.000001) AS near FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_extendedprice * (1 + l_linenumber * 0.0003::DOUBLE) AS y FROM lineitem)")
def q_numeric_isclose(spark, d):
    y = F.col("x") * (1 + F.col("l_linenumber") * F.lit(0.0003))
    return lines(spark, d).select("l_orderkey", "l_linenumber", answers.is_close(F.col("x"), y).alias("near"))


@query("SELECT p_partkey, (['A','B','C','D'])[p_size % 4 + 1] AS letter FROM part")
def q_mcq_letter(spark, d):
    """Letters as a box, after a phrase, and alone."""
    p = table(spark, d, "part").withColumn("a", F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), F.col("p_size") % 4 + 1))
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("The answer is B. \\boxed{\\text{"), F.lower("a"), F.lit("}}"))).when(kind == 1, F.concat(F.lit("A planet. I first said the answer is A, but the correct option is ("), F.col("a"), F.lit(")"))).otherwise(F.concat(F.lit(" **"), F.col("a"), F.lit("** ")))
    return p.select("p_partkey", answers.letter(text).alias("letter"))


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS passed, CASE n_nationkey % 4 WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'no code block' WHEN 3 THEN 'execution failed: sentinel not reached' ELSE '' END AS error FROM nation")
def q_python_exec(spark, d):
    """Code that is right, wrong, missing, and ends early; each of the four runs once."""
    k = F.col("n_nationkey") % 4
    code = F.when(k == 0, "```python\ndef f(x):\n    return x + 1\n```").when(k == 1, "```\ndef f(x): return x\n```").when(k == 2, "def f(x): return x + 1").otherwise("```py\nimport os\nos._exit(0)\n```")
    n = table(spark, d, "nation").select("n_nationkey", code.alias("r"), F.lit("assert f(1) == 2").alias("t"))
    e = answers.executed(n, "r", "t")
    last = F.element_at(F.split(F.trim(F.regexp_replace("exec.error", r"\s+\z", "")), "\n"), -1)  # of a traceback
    return e.select("n_nationkey", "exec.passed", last.alias("error"))


@query("SELECT s_suppkey, (s_suppkey % 2 = 0)::INT::DOUBLE AS score FROM supplier")
def q_score_dispatch(spark, d):
    """All four verifiers; responses to even keys are right."""
    right = F.col("s_suppkey") % 2 == 0
    kind = F.floor(F.col("s_suppkey") / 2) % 4
    v = F.element_at(F.array(*[F.lit(x) for x in ("contains", "numeric", "mcq_letter", "python_exec")]), (kind + 1).cast("int"))
    r = (
        F.when(kind == 0, F.when(right, "It is the CAT.").otherwise("concatenate"))
        .when(kind == 1, F.when(right, "so \\boxed{42.0001}").otherwise("42 then 43"))
        .when(kind == 2, F.when(right, "Answer: C").otherwise("C or D? The answer is D"))
        .otherwise(F.when(right, "```python\nx = 1\n```").otherwise("```python\nx = 2\n```"))
    )
    s = table(spark, d, "supplier").select("s_suppkey", v.alias("verifier"), r.alias("response"), F.array(F.lit("cat")).alias("answer_terms"), F.lit(42.0).alias("answer_num"), F.lit("C").alias("answer_letter"), F.lit("assert x == 1").alias("test_assertions"), F.lit(None).cast("double").alias("rel_tol"), F.lit(None).cast("double").alias("abs_tol"))
    return answers.scored(s).select("s_suppkey", "score")


# ---------------------------------------------------------------- generation and cache


def bench_items(spark, d):
    return table(spark, d, "benchmark").select(F.lit("test").alias("split"), F.col("item_id").cast("long").alias("ord"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "numeric").otherwise("contains").alias("verifier"))


_SFX = NUMERIC_SUFFIX.replace("'", "''")


@query(f"SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN text || '{_SFX}' ELSE text END AS query FROM benchmark")
def q_build_query(spark, d):
    return bench_items(spark, d).select("id", generate.query_text(F.col("question"), F.col("verifier")).alias("query"))


@query("SELECT item_id::VARCHAR AS id, role FROM benchmark CROSS JOIN (SELECT unnest(['general', 'math', 'code']) AS role)")
def q_cross_role(spark, d):
    return bench_items(spark, d).crossJoin(F.broadcast(router.role_table(spark))).select("id", "role")


_PROMPTS = " ".join(f"WHEN '{r}' THEN '{p.replace(chr(39), chr(39) * 2)}'" for r, p in SYSTEM_PROMPTS.items())


@query(f"SELECT item_id::VARCHAR AS id, role, CASE role {_PROMPTS} END AS system, text AS question FROM benchmark CROSS JOIN (SELECT unnest(['general', 'math', 'code']) AS role)")
def q_prompt_join(spark, d):
    prompts = router.role_table(spark).withColumn("system", F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_PROMPTS.items() for x in kv]), F.col("role")))
    x = bench_items(spark, d).crossJoin(F.broadcast(prompts)).withColumn("chat", generate.chat(F.col("system"), F.col("question")))
    return x.select("id", "role", F.col("chat")[0]["content"].alias("system"), F.col("chat")[1]["content"].alias("question"))


#: What a key is the digest of, up to the query, by role.
_HEADS = {
    "general": '["MockRunner", "Qwen/Qwen2.5-1.5B-Instruct", "general", "You are a helpful assistant. Answer the question concisely and accurately. For factual questions, give a short direct answer.", {"do_sample": false, "max_new_tokens": 256, "repetition_penalty": 1.05}, null, null, ',
    "math": '["MockRunner", "Qwen/Qwen2.5-Math-1.5B-Instruct", "math", "Please reason step by step, and put your final answer within \\\\boxed{}.", {"do_sample": false, "max_new_tokens": 512, "repetition_penalty": 1.05}, null, null, ',
    "code": '["MockRunner", "Qwen/Qwen2.5-Coder-1.5B-Instruct", "code", "You are an expert Python programmer. Return ONLY a Python code block with no explanation, no markdown prose outside the code block.", {"do_sample": false, "max_new_tokens": 256, "repetition_penalty": 1.05}, null, null, ',
}
_HEAD_SQL = " ".join(f"WHEN '{r}' THEN '{h}'" for r, h in _HEADS.items())


@query(f"SELECT item_id::VARCHAR AS id, role, sha256(CASE role {_HEAD_SQL} END || to_json(CASE WHEN item_id % 2 = 0 THEN text || '{_SFX}' ELSE text END)::VARCHAR || ']') AS key FROM benchmark CROSS JOIN (SELECT unnest(['general', 'math', 'code']) AS role)")
def q_cache_key(spark, d):
    return generate.requests(bench_items(spark, d), generate.generators("huggingface", "1.5b", True)).select("id", "role", "key")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/cache-{uuid.uuid4().hex}"


@query("SELECT user_id || '/' || event_type AS key, CASE WHEN bool_or(event_id % 2 = 0) THEN 'second' ELSE 'first' END AS response FROM events GROUP BY 1")
def q_cache_two_appends(spark, d):
    """A cache written in two batches and read back: the second one's answers win."""
    folder, e = scratch(spark), cache_rows(spark, d)
    files.append_cache(e.withColumn("response", F.lit("first")), folder)
    files.append_cache(e.where("event_id % 2 = 0").withColumn("response", F.lit("second")), folder)
    return files.read_cache(spark, folder)


def cache_rows(spark, d):
    return table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_id").cast("string").alias("response"), "event_id")


@query("SELECT user_id || '/' || event_type AS key, max(event_id)::VARCHAR AS response FROM events GROUP BY 1")
def q_cache_last_wins(spark, d):
    return files.last_wins(cache_rows(spark, d), "event_id")


def key_requests(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("/click")).alias("key"), F.lit("general").alias("role"), F.col("c_custkey").alias("ord"))
    return c.unionByName(c.where("ord % 2 = 0"))


_CACHE = "k AS (SELECT user_id || '/' || event_type AS key, max(event_id)::VARCHAR AS response FROM events GROUP BY 1), q AS (SELECT c_custkey || '/click' AS key, c_custkey AS ord FROM customer UNION ALL SELECT c_custkey || '/click', c_custkey FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_CACHE} SELECT q.key, ord, response FROM q JOIN k USING (key)")
def q_cache_hits(spark, d):
    return generate.hits(key_requests(spark, d), files.last_wins(cache_rows(spark, d), "event_id")).select("key", "ord", "response")


@query(f"WITH {_CACHE} SELECT DISTINCT q.key, ord FROM q WHERE key NOT IN (SELECT key FROM k)")
def q_cache_misses(spark, d):
    return generate.misses(key_requests(spark, d), files.last_wins(cache_rows(spark, d), "event_id")).select("key", "ord")


@query(
    """WITH t AS (SELECT event_type AS role, user_id, count(*) AS asked, max(CASE WHEN event_id % 3 = 0 THEN 1 END) AS made, max(CASE WHEN event_id % 3 = 0 THEN round(value) END) AS seconds FROM events GROUP BY 1, 2)
SELECT role, count(made) AS n_generated, (sum(asked) - count(made))::BIGINT AS n_cached, round(coalesce(sum(seconds), 0), 3) AS seconds, round(sum(seconds) / nullif(count(made), 0), 6) AS sec_per_generation, sum(made * 10)::BIGINT AS new_tokens, round(CASE WHEN sum(seconds) > 0 THEN sum(made * 10) / sum(seconds) END, 6) AS tokens_per_sec FROM t GROUP BY 1"""
)
def q_timing_rollup(spark, d):
    e = table(spark, d, "events")
    mine = F.col("event_id") % 3 == 0
    t = e.groupBy(F.col("event_type").alias("role"), "user_id").agg(F.count("*").alias("asked"), F.max(F.when(mine, 1)).alias("made"), F.max(F.when(mine, F.round("value"))).alias("seconds")).withColumn("new_tokens", F.col("made") * 10)
    r = generate.rollup(t)
    return r.select("role", "n_generated", "n_cached", F.round("seconds", 3).alias("seconds"), F.round("sec_per_generation", 6).alias("sec_per_generation"), "new_tokens", F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


@query("SELECT role, count(*) AS n, min(response) AS response FROM (SELECT role, 'MOCK_PLACEHOLDER [role=' || role || '] not answered' AS response FROM benchmark CROSS JOIN (SELECT unnest(['general', 'math', 'code']) AS role)) GROUP BY 1")
def q_mock_generation(spark, d):
    by_role = generate.generators("huggingface", "1.5b", True)
    req = generate.requests(bench_items(spark, d), by_role)
    out = None
    for r, g in by_role.items():
        got = generate.generate(generate.misses(req, generate.empty_cache(spark)), g).withColumn("role", F.lit(r))
        out = got if out is None else out.unionByName(got)
    return req.join(out.select("key", "response"), "key").groupBy("role").agg(F.count("*").alias("n"), F.min("response").alias("response"))


# ---------------------------------------------------------------- items


@query(
    f"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, item_id::VARCHAR AS id, {sql_role('item_id')} AS category, text AS question, (['contains', 'numeric', 'mcq_letter', 'python_exec'])[item_id % 4 + 1] AS verifier,
CASE item_id % 4 WHEN 0 THEN 'a|' || item_id END AS terms, CASE item_id % 4 WHEN 1 THEN item_id / 4.0::DOUBLE END AS answer_num, CASE item_id % 4 WHEN 2 THEN 'C' END AS answer_letter, CASE item_id % 4 WHEN 3 THEN 'assert True' END AS test_assertions, CASE item_id % 4 WHEN 1 THEN 0.5::DOUBLE END AS rel_tol
FROM benchmark"""
)
def q_load_items(spark, d):
    """The benchmark as a file with a JSON array of items of all four kinds, validated, typed and in order."""
    k, i = F.col("item_id") % 4, F.col("item_id")
    base = [i.alias("id"), role_of(i).alias("category"), F.col("text").alias("question")]
    kinds = [
        [F.lit("contains").alias("verifier"), F.array(F.lit("a"), i.cast("string")).alias("answer")],
        [F.lit("numeric").alias("verifier"), (i / F.lit(4.0)).alias("answer"), F.lit(0.5).alias("rel_tol")],
        [F.lit("mcq_letter").alias("verifier"), F.lit("C").alias("answer")],
        [F.lit("python_exec").alias("verifier"), F.lit("assert True").alias("test_assertions")],
    ]
    js = F.coalesce(*[F.when(k == n, F.to_json(F.struct(*base, *own))) for n, own in enumerate(kinds)])
    path = f"{scratch(spark)}/items.json"
    files.write_list(path, (r["j"] for r in table(spark, d, "benchmark").select("item_id", js.alias("j")).orderBy("item_id").toLocalIterator()))
    x = items.load_items(spark, path)
    return x.select("ord", "id", "category", "question", "verifier", F.when(F.col("verifier") == "contains", F.array_join("answer_terms", "|")).alias("terms"), "answer_num", "answer_letter", "test_assertions", "rel_tol")


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def q_dup_ids(spark, d):
    return router.duplicate_ids(table(spark, d, "conversations").withColumnRenamed("conv_id", "id"))


@query("SELECT doc_id::VARCHAR AS id FROM documents INTERSECT SELECT doc_id::VARCHAR FROM labels WHERE quality = 0")
def q_disjoint_overlap(spark, d):
    return items.overlap(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), table(spark, d, "labels").where("quality = 0").withColumnRenamed("doc_id", "id"))


@query(
    """SELECT c_custkey AS ord, unnest(CASE c_custkey % 14 WHEN 0 THEN [6] WHEN 1 THEN [7] WHEN 2 THEN [10] WHEN 3 THEN [12] WHEN 4 THEN [13] WHEN 5 THEN [3] WHEN 6 THEN [11] WHEN 7 THEN [2] WHEN 8 THEN [5] WHEN 9 THEN [8] WHEN 10 THEN [9]
WHEN 11 THEN CASE WHEN c_custkey > (SELECT min(c_custkey) FROM customer WHERE c_custkey % 14 = 11) THEN [4] ELSE [] END WHEN 12 THEN [5, 9] ELSE [] END)::INTEGER AS rule FROM customer"""
)
def q_validation_violations(spark, d):
    """Rules 2 to 13 broken: one each by eleven of every fourteen items, two by a twelfth; the rest are right."""
    k = F.col("c_custkey") % 14
    ident = F.when(k == 5, "").when(k == 11, '"id": "same", ').otherwise(F.concat(F.lit('"id": '), F.col("c_custkey").cast("string"), F.lit(", ")))
    category = F.when(k == 0, "history").otherwise("math")
    question = F.when(k.isin(8, 12), "").otherwise('"question": "q", ')
    verifier = F.when(k == 1, "guess").when(k == 4, "mcq_letter").when(k == 6, "contains").when(k.isin(9, 10, 12), "python_exec").otherwise("numeric")
    answer = F.when(k.isin(2, 9), "").when(k == 3, ', "answer": true').when(k == 4, ', "answer": "E"').when(k == 6, ', "answer": ["a", 1]').when(k == 10, ', "test_assertions": "  "').when(k == 12, ', "test_assertions": 7').otherwise(', "answer": 1.5')
    js = F.concat(F.lit("{"), ident, F.lit('"category": "'), category, F.lit('", '), question, F.lit('"verifier": "'), verifier, F.lit('"'), answer, F.lit("}"))
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.parse_json(F.when(k == 7, "[1]").otherwise(js)).alias("v"))
    return items.violations(raw).select("ord", "rule")


@query("SELECT item_id::VARCHAR AS id FROM benchmark ORDER BY item_id LIMIT 7")
def q_limit(spark, d):
    """--limit: the first items by order."""
    return items.limited(bench_items(spark, d), 7).select("id")


@query("SELECT split, count(*) AS n FROM (SELECT 'val' AS split FROM conversations UNION ALL SELECT 'test' FROM benchmark) GROUP BY 1")
def q_union_splits(spark, d):
    a = table(spark, d, "conversations").select(F.lit("val").alias("split"))
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("test").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT 'test' AS split, conv_id::VARCHAR AS id, max(text) FILTER (role = 'user') AS general, max(text) FILTER (role = 'assistant') AS math, max(text) FILTER (role = 'system') AS code FROM conversations GROUP BY conv_id")
def q_generations_nested(spark, d):
    names = {"user": "general", "assistant": "math", "system": "code"}
    role = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("role"))
    g = table(spark, d, "conversations").select(F.lit("test").alias("split"), F.col("conv_id").cast("string").alias("id"), role.alias("role"), F.col("text").alias("response"), F.col("conv_id").alias("ord"))
    return files.nested_generations(g).select("split", "id", "responses.*")
