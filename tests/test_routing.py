import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import vectors
from routeloom.operators.cluster import SphericalKMeans
from routeloom.operators.router import Router
from routeloom.sources import files


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, v array<double>")


def plain_fit(x, k=3, seed=42, restarts=10):
    """The same algorithm in a few lines of numpy."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (-np.inf, None)
    for r in range(restarts):
        g = np.random.RandomState(seed + r)
        c = [x[g.randint(0, len(x))]]
        while len(c) < k:
            w = np.maximum(0, 1 - (x @ np.array(c).T).max(1)) ** 2
            c.append(x[g.choice(len(x), p=w / w.sum())])
        c = np.array(c)
        for _ in range(100):
            at = (x @ c.T).argmax(1)
            new = np.array([x[at == j].mean(0) if (at == j).any() else x[(x @ c[j]).argmin()] for j in range(k)])
            new /= np.linalg.norm(new, axis=1, keepdims=True)
            done, c = np.linalg.norm(new - c, axis=1).max() < 1e-6, new
            if done:
                break
        best = max(best, ((x @ c.T).max(1).sum(), c), key=lambda b: b[0])
    return best[1]


def test_kmeans_equals_plain_version(spark):
    g = np.random.RandomState(42)
    x = np.concatenate([np.eye(3)[i] + g.normal(0, 0.05, (15, 3)) for i in range(3)])
    model = SphericalKMeans().fit(frame(spark, x))
    assert np.allclose(model.centroids, plain_fit(x), atol=1e-9)
    labels = [r[0] for r in frame(spark, x).orderBy("ord").select(model.predict(F.col("v"))).collect()]
    assert all(len(set(labels[i : i + 15])) == 1 for i in (0, 15, 30)) and len(set(labels)) == 3


def test_kmeans_errors(spark):
    with pytest.raises(ValueError, match="fewer"):
        SphericalKMeans().fit(frame(spark, np.eye(3)[:2]))
    with pytest.raises(Exception, match="zero-norm"):
        SphericalKMeans().fit(frame(spark, np.vstack([np.eye(3), np.zeros(3)])))
    with pytest.raises(RuntimeError):
        SphericalKMeans().predict(F.col("v"))
    with pytest.raises(ValueError, match="starts"):
        SphericalKMeans(restarts=1).fit(frame(spark, np.eye(3)), np.eye(3)[None, :2])


def test_hash_embed(spark):
    d = spark.createDataFrame([(0, "hello"), (1, ""), (2, "Hello, hello!"), (3, "a b a")], "ord long, t string")
    got = {r["ord"]: np.array(r["v"]) for r in vectors.hash_embed(d, "ord", "t").collect()}
    assert all(len(v) == 384 and abs(np.linalg.norm(v) - 1) < 1e-12 for v in got.values())
    assert np.flatnonzero(got[0]).tolist() == [93] and (got[0] == got[2]).all() and len(np.flatnonzero(got[1])) == 1


def test_calibrate_route_save_load(spark, tmp_path):
    kinds = ["math: problem", "code: task", "gen: query"]
    rows = [(i, f"i{i}", f"{kinds[i % 3]} {i}", ["math", "code", "general"][i % 3]) for i in range(36)]
    items = spark.createDataFrame(rows, "ord long, id string, question string, category string")

    def embed(df, key, question):
        k = F.substring(question, 1, 4)
        v = F.when(k == "math", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(k == "code", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
        return df.select(key, F.transform(v, lambda x: x + F.pmod(F.hash(question), F.lit(7)) * 0.003).alias("v"))

    score = F.when(F.col("role") == F.col("category"), 1.0).when(F.col("role") == "general", 0.5).otherwise(0.0)
    r = Router(embed=embed)
    out = r.calibrate(items, lambda x: x.select("id", "role", score.alias("score")))
    assert sorted(out["assignment"].values()) == ["code", "general", "math"] and out["cluster_sizes"] == [12, 12, 12] and out["warnings"] == []
    routed = {x["id"]: x["routed"] for x in r.route(items).collect()}
    assert all(routed[i] == c for _, i, _, c in rows)
    files.save_state(r, str(tmp_path / "state.json"))
    again = files.load_state(str(tmp_path / "state.json"), embed=embed)
    assert {x["id"]: x["routed"] for x in again.route(items).collect()} == routed
    text = (tmp_path / "state.json").read_text().replace('"schema_version": 1', '"schema_version": 999')
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="schema_version"):
        files.load_state(str(tmp_path / "bad.json"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tie = Router(embed=embed).calibrate(items, lambda x: x.select("id", "role", F.lit(0.8).alias("score")), min_cluster_warn=13)
    assert set(tie["assignment"].values()) == {"general"} and len(tie["warnings"]) == 3
    with pytest.raises(ValueError, match="Duplicate item id"):
        Router(embed=embed).calibrate(items.unionByName(items), lambda x: x)
    with pytest.raises(RuntimeError):
        files.save_state(Router(), str(tmp_path / "x.json"))


def test_predict_one():
    model = SphericalKMeans(centroids=np.eye(3).tolist())
    assert model.predict_one([0.1, 2.0, 0.3]) == 1
    for bad in ([[1.0, 0.0, 0.0]], [0.0, 0.0, 0.0]):
        with pytest.raises(ValueError):
            model.predict_one(bad)
    with pytest.raises(RuntimeError):
        SphericalKMeans().predict_one([1.0])


def test_kmeans_is_the_same_at_any_partitioning(spark, monkeypatch):
    from routeloom.operators import cluster

    g = np.random.RandomState(7)
    x = frame(spark, g.normal(0, 1, (400, 5)))
    one = SphericalKMeans(k=6, restarts=3).fit(x).centroids
    monkeypatch.setattr(cluster, "PART_ROWS", 60)
    assert SphericalKMeans(k=6, restarts=3).fit(x.repartition(7)).centroids == one


def test_kmeans_repairs_an_empty_cluster():
    from routeloom.operators.cluster import SphericalKMeans as K

    start = np.array([[[1.0, 0.0], [0.6, 0.8], [0.6, 0.8]]])
    seen = []

    def partials(x, c):
        seen.append(c.copy())
        return {(0, 0): (np.array([2.0, 0.0]), 2, np.array([0.0, 1.0])), (0, 1): (np.array([1.0, 1.0]), 2, np.array([1.0, 0.0])), (0, 2): (np.zeros(2), 0, np.array([1.0, 0.0]))}

    from routeloom.operators import cluster

    old = cluster.lloyd_partials, cluster.total_similarity
    cluster.lloyd_partials, cluster.total_similarity = partials, lambda x, c: [0.0]
    try:
        out, _ = K(k=3, restarts=1)._iterate(None, start)
    finally:
        cluster.lloyd_partials, cluster.total_similarity = old
    assert np.allclose(out[0], [[1, 0], [0.5**0.5, 0.5**0.5], [1, 0]])  # the row farthest from the empty cluster's old centroid
