"""Histogram trees against a plain tree of the same rules."""

import math
import tempfile

import pytest

from stratakit.operators.trees import Forest, fit_forest

ROWS = [(i, float(i * 7 % 20), float(i * i % 13), (i * 7 % 20 > 9) + (i * i % 13 > 6 and i % 3 == 0)) for i in range(60)]
SCHEMA = "id long, x double, y double, label int"


def plain_tree(rows, depth, edges, k):
    """(feature, threshold, lower, upper) or class shares."""
    counts = [sum(r[1] == c for r in rows) for c in range(k)]
    n = len(rows)
    best = (sum(c * c for c in counts) / n, None)
    if depth:
        for f, es in enumerate(edges):
            for e in es:
                sides = [[r for r in rows if (r[0][f] > e) == up] for up in (False, True)]
                if all(sides):
                    won = [sum(sum(r[1] == c for r in s) ** 2 for c in range(k)) / len(s) for s in sides]
                    if won[0] + won[1] > best[0]:
                        best = (won[0] + won[1], (f, e, *sides))
    if best[1] is None:
        return [c / n for c in counts]
    f, e, lo, up = best[1]
    return f, e, plain_tree(lo, depth - 1, edges, k), plain_tree(up, depth - 1, edges, k)


def leaf(tree, x):
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
    return tree


def test_single_tree_equals_a_plain_one(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    forest = fit_forest(df, ["x", "y"], "label", ["id"], 3, trees=1, depth=3, bins=8, features_a_node=2, bootstrap=False)

    def quantile(v, q):
        at = (len(v) - 1) * q
        lo = math.floor(at)
        return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)
    edges = [sorted({quantile(sorted(r[f] for r in ROWS), i / 8) for i in range(1, 8)}) for f in (1, 2)]
    tree = plain_tree([(r[1:3], r[3]) for r in ROWS], 3, edges, 3)
    for r in forest.apply(df).collect():
        assert r["probs"] == pytest.approx(leaf(tree, (r["x"], r["y"])))
    nodes = forest.table(spark)
    assert nodes.where("node = 0").first()["counts"] == [sum(r[3] == c for r in ROWS) for c in range(3)]
    inner, leaves = nodes.where("feature IS NOT NULL").count(), nodes.where("feature IS NULL").count()
    assert leaves == inner + 1


def test_forest_round_trip_nulls_and_clashing_names(spark):
    df = spark.createDataFrame(ROWS + [(100, None, float("nan"), 1), (101, 1.0, 2.0, None)], SCHEMA)
    forest = fit_forest(df, ["x", "y"], "label", ["id"], 3, trees=4, depth=3, bins=8)
    path = tempfile.mkdtemp(prefix="stratakit-forest-") + "/f"
    forest.save(path, spark)
    named = df.selectExpr("*", "id AS tree", "id AS node", "id AS n", "id AS w", "id AS bin")
    a = {r["id"]: r["probs"] for r in forest.apply(named).collect()}
    assert a == {r["id"]: r["probs"] for r in Forest.load(path, spark).apply(df).collect()}
    assert len(a) == 62 and all(sum(p) == pytest.approx(1.0) for p in a.values())
    again = fit_forest(df.repartition(7), ["x", "y"], "label", ["id"], 3, trees=4, depth=3, bins=8)
    assert sorted(map(str, again.nodes)) == sorted(map(str, forest.nodes))


def test_forest_rejects_what_it_cannot_learn(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="no rows"):
        fit_forest(df.where("id < 0"), ["x"], "label", ["id"], 3, trees=2, depth=2)
    with pytest.raises(ValueError, match="nodes"):
        fit_forest(df, ["x"], "label", ["id"], 3, trees=100, depth=20)
    with pytest.raises(Exception, match="a label is not one of"):
        fit_forest(df, ["x"], "label", ["id"], 2, trees=1, depth=2)
    assert fit_forest(df.selectExpr("id", "1.0 AS x", "label"), ["x"], "label", ["id"], 3, trees=1, depth=2,
                      bootstrap=False).nodes[0]["feature"] is None
