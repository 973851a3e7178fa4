"""Fitted models place new rows, and do the same after being saved and loaded."""

import tempfile

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from stratakit.operators import models as m
from stratakit.sources import tables as t
from tests.conftest import SF001


def _vectors(spark):
    return t.read(spark, SF001, "embeddings").select("vec_id", "embedding")


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_kmeans_places_new_rows_and_round_trips(spark):
    v = _vectors(spark)
    old, new = v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1")
    model = m.fit_kmeans(old, "embedding", 5, "vec_id", seed=3, steps=4)
    path = tempfile.mkdtemp(prefix="stratakit-model-") + "/kmeans"
    model.save(path, spark)
    a, b = model.apply(new, "embedding"), m.KMeansStrata.load(path, spark).apply(new, "embedding")
    assert _rows(a, "vec_id", "cluster") == _rows(b, "vec_id", "cluster")
    x = np.array([r["embedding"] for r in old.orderBy("vec_id").collect()])
    assert np.allclose(model.scaler.mean, x.mean(axis=0)) and np.allclose(model.scaler.std, x.std(axis=0))
    y = {r["vec_id"]: (np.array(r["embedding"]) - x.mean(axis=0)) / x.std(axis=0) for r in new.collect()}
    for vec, cluster in _rows(a, "vec_id", "cluster"):
        assert cluster == np.argmin([((y[vec] - np.array(c)) ** 2).sum() for c in model.centres])


def test_pca_and_bisecting_round_trip(spark):
    v = _vectors(spark)
    root = tempfile.mkdtemp(prefix="stratakit-model-")
    pca, strata = m.fit_pca(v, "embedding", 4), m.fit_bisecting(v, "embedding", 3)
    pca.save(f"{root}/pca", spark)
    strata.save(f"{root}/bisecting", spark)
    new = v.limit(20)
    assert _rows(pca.apply(new, "embedding", "e"), "vec_id", "e") == \
        _rows(m.PcaEmbedding.load(f"{root}/pca", spark).apply(new, "embedding", "e"), "vec_id", "e")
    assert _rows(strata.apply(new, "embedding"), "vec_id", "cluster") == \
        _rows(m.BisectingStrata.load(f"{root}/bisecting", spark).apply(new, "embedding"), "vec_id", "cluster")


def test_response_and_classifier_round_trip(spark):
    from pyspark.ml import PipelineModel
    users, items, log = t.users(spark, SF001), t.items(spark, SF001), t.history(spark, SF001)
    root = tempfile.mkdtemp(prefix="stratakit-model-")
    model = m.fit_response(log.where("user_id % 2 = 0"), users, items, "user_id", "item_id", "relevance",
                           ["acctbal"], ["price", "size"], max_iter=5)
    model.save(f"{root}/fm", spark)
    pairs = log.where("user_id = 1").select("user_id", "item_id").distinct()
    a = model.apply(pairs, users, items)
    b = m.ResponseModel.load(f"{root}/fm", spark).apply(pairs, users, items)
    assert _rows(a, *a.columns) == _rows(b, *b.columns) and a.count() == pairs.count()
    data = users.select("user_id", "acctbal", (F.col("acctbal") > 0).cast("int").alias("label"))
    forest = m.fit_classifier(data, ["acctbal"], "label", num_trees=3)
    forest.write().overwrite().save(f"{root}/forest")
    new = data.limit(10)
    assert _rows(m.class_probabilities(forest, new), "user_id", "probs") == \
        _rows(m.class_probabilities(PipelineModel.load(f"{root}/forest"), new), "user_id", "probs")


def test_classifier_after_an_observed_query(spark):
    seen = Observation()
    assert spark.range(3).observe(seen, F.count("id").alias("n")).count() == 3 and seen.get == {"n": 3}
    data = spark.createDataFrame([(i, float(i), int(i > 20)) for i in range(40)], "user_id int, acctbal double, label int")
    forest = m.fit_classifier(data, ["acctbal"], "label", num_trees=3)
    probs = {r["user_id"]: r["probs"] for r in m.class_probabilities(forest, data).collect()}
    assert len(probs) == 40 and probs[1][0] > .5 > probs[38][0]


def test_split_tree_against_a_plain_one(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 40), (9, 25), (30, 10), (33, 5))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id int, x array<double>")
    model = m.fit_bisecting(df, "x", 6, steps=4)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    node, splits = np.zeros(len(z), int), {}
    while len(splits) < 5:                                          # levels of 1, 2 and 2 splits
        leaves = sorted(((((z[node == n] - z[node == n].mean(axis=0)) ** 2).sum(), n) for n in set(node)),
                        key=lambda t: (-t[0], t[1]))[:5 - len(splits)]
        top = 2 * len(splits)
        for at, n in enumerate(sorted(n for _, n in leaves)):
            own = z[node == n]
            mean = own.mean(axis=0)
            left = own[((own - mean) ** 2).sum(axis=1).argmax()]
            right = 2 * mean - left
            for _ in range(5):
                is_left = ((own - left) ** 2).sum(axis=1) <= ((own - right) ** 2).sum(axis=1)
                last = is_left
                left, right = own[is_left].mean(axis=0), own[~is_left].mean(axis=0)
            splits[n] = top + 2 * at + 1
            node[node == n] = np.where(last, splits[n], splits[n] + 1)
    strata = sorted(set(node))
    got = dict(_rows(model.apply(df.where("id < 900"), "x"), "id", "cluster"))
    assert got == {i: strata.index(n) for i, n in enumerate(node)}
    assert model.apply(df.where("id = 900"), "x").first()["cluster"] is None


def test_split_tree_stops_at_equal_rows_and_empty_tables(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 6 + [([4.0, 2.0],)] * 3, "x array<double>")
    model = m.fit_bisecting(df, "x", 5)
    assert sorted(r["n"] for r in model.apply(df, "x").groupBy("cluster").agg(F.count("*").alias("n")).collect()) == [3, 6]
    assert m.fit_bisecting(df.limit(0), "x", 5).splits == []
    assert {r["cluster"] for r in m.fit_bisecting(df, "x", 1).apply(df, "x").collect()} == {0}


def test_components_are_eigenvectors_with_fixed_signs(spark):
    v = _vectors(spark)
    model = m.fit_pca(v, "embedding", 3)
    x = np.array([r["embedding"] for r in v.collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    rows = model.components(spark).collect()
    assert len(rows) == 3 * x.shape[1]
    for c in range(3):
        own = vectors[:, -1 - c] * np.sign(vectors[:, -1 - c][abs(vectors[:, -1 - c]).argmax()])
        got = sorted((r["dim"], r["loading"], r["share"]) for r in rows if r["component"] == c)
        assert np.allclose([g[1] for g in got], own) and np.allclose(got[0][2], values[-1 - c] / values.sum())


def test_factored_response_against_least_squares(spark):
    rng = np.random.default_rng(2)
    users = spark.createDataFrame([(i, float(rng.normal())) for i in range(30)] + [(99, None)], "user_id int, a double")
    items = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(20)], "item_id int, b double, c double")
    log = (users.where("user_id < 30").crossJoin(items)
           .selectExpr("user_id", "item_id", "2 + 3 * a * b - a * c + 0.5 * b AS y"))
    full = m.fit_factored_response(log.unionByName(log.limit(5).withColumn("y", F.lit(None).cast("double"))), users, items,
                                   "user_id", "item_id", "y", ["a"], ["b", "c"], rank=2, steps=30, ridge=1e-6)
    err = full.apply(log, users, items).selectExpr("max(abs(prediction - y)) AS e").first()["e"]
    assert err < 1e-3                                               # a matrix of 2 x 3 has rank 2 at most
    one = m.fit_factored_response(log, users, items, "user_id", "item_id", "y", ["a"], ["b", "c"], rank=1, steps=30, ridge=1e-6)
    assert np.linalg.matrix_rank(np.array(one.weights), tol=1e-9) == 1
    path = tempfile.mkdtemp(prefix="stratakit-model-") + "/factored"
    full.save(path, spark)
    new = items.select(F.lit(99).alias("user_id"), "item_id")       # a user without history or feature
    a = full.apply(new, users, items)
    assert _rows(a, *a.columns) == _rows(m.FactoredResponse.load(path, spark).apply(new, users, items), *a.columns)
    assert a.where("prediction IS NULL").isEmpty() and a.count() == 20
    empty = m.fit_factored_response(log.limit(0), users, items, "user_id", "item_id", "y", ["a"], ["b", "c"])
    assert {r["prediction"] for r in empty.apply(new, users, items).collect()} == {0.0}
