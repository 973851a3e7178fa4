"""Histogram trees (I16): a random forest grown level by level.

Features are cut into bins at exact quantiles.  A level of all trees is one
pass over the rows: each row walks down the trees grown so far, and one
aggregate over (tree, node, feature, bin) counts classes.  Splits are chosen on
these counts, so what leaves a pass is bounded by trees x 2^level x features x
bins whatever the rows.

Draws (bootstrap weights, features of a node) are hashes of keys, so a fit
doesn't depend on partitions and has a SQL twin.  A null feature goes to the
lower side, NaN to the upper one; rows without a label are left out of the fit."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions.rand import U
from stratakit.operators.strata import exact_quantiles
from stratakit.session import checkpointed
from stratakit.sources.io import load_params, save_params

#: Nodes of a forest at most: trees x 2^depth.
MAX_NODES = 1 << 17

#: A Poisson(1) draw is the number of these points at or below a uniform draw.
POISSON_POINTS = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(8)]


def poisson_weights(trees: int, seed: int, keys: list[str]) -> Column:
    """A row's weights in the trees' bootstrap samples, as an array."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: U(seed, F.lit("w"), t, *keys))
    points = _constant(POISSON_POINTS, "array<double>")
    return F.transform(draws, lambda u: F.size(F.filter(points, lambda p: p <= u)).cast("tinyint"))


@dataclass
class Forest:
    """Nodes in heap order by tree (children of n: 2n + 1 and 2n + 2).  A
    node without a feature is a leaf or unused; ``counts`` are the class
    weights of the node's rows."""
    feature_cols: list[str]
    num_classes: int
    depth: int
    nodes: list[dict]

    @property
    def trees(self) -> int:
        return max(n["tree"] for n in self.nodes) + 1

    def table(self, spark) -> DataFrame:
        """(tree, node, feature, threshold, left, right, counts), one row a node."""
        rows = [(n["tree"], n["node"], *((self.feature_cols[n["feature"]], n["threshold"], 2 * n["node"] + 1, 2 * n["node"] + 2)
                                         if n["feature"] is not None else (None,) * 4), n["counts"]) for n in self.nodes]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, "
                                           "counts array<long>")

    def apply(self, df: DataFrame, out_col: str = "probs") -> DataFrame:
        """The mean over trees of the class shares in a row's leaf."""
        size = (1 << (self.depth + 1)) - 1
        x = F.array(*[F.col(c).cast("double") for c in self.feature_cols])
        shares = [[[] for _ in range(size)] for _ in range(self.trees)]
        for n in self.nodes:
            if n["feature"] is None:
                shares[n["tree"]][n["node"]] = [c / sum(n["counts"]) for c in n["counts"]]
        walk = _walk(self.nodes, self.trees, self.depth, "threshold", x)
        leaf = _constant(shares, "array<array<array<double>>>")
        at = F.zip_with(leaf, walk, lambda s, n: F.get(s, n))
        zeros = F.array_repeat(F.lit(0.0), self.num_classes)
        total = F.aggregate(at, zeros, lambda a, s: F.zip_with(a, s, lambda p, q: p + q))
        return df.withColumn(out_col, F.transform(total, lambda v: v / F.lit(float(self.trees))))

    def save(self, path: str, spark) -> None:
        save_params(spark, asdict(self), path)

    @staticmethod
    def load(path: str, spark) -> "Forest":
        return Forest(**load_params(spark, path))


def _constant(value, kind: str) -> Column:
    """A nested list as one foldable expression."""
    return F.expr(f"from_json('{json.dumps(value)}', '{kind}')")       # numbers and field names only


def _walk(nodes: list[dict], trees: int, steps: int, cut: str, x: Column) -> Column:
    """The node that a row reaches in each tree; ``x`` and the nodes' ``cut``
    are both bins or both values."""
    size = (1 << (steps + 1)) - 1
    grown = [{"f": [None] * size, "c": [None] * size} for _ in range(trees)]
    for n in nodes:
        if n["feature"] is not None:
            grown[n["tree"]]["f"][n["node"]], grown[n["tree"]]["c"][n["node"]] = n["feature"], n[cut]

    def step(t: Column, n: Column) -> Column:
        at = F.get(t["f"], n)
        upper = F.coalesce(F.get(x, at) > F.get(t["c"], n), F.lit(False)).cast("int")
        return F.when(at.isNull(), n).otherwise(2 * n + 1 + upper)

    levels = F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")
    return F.transform(_constant(grown, "array<struct<f:array<int>,c:array<double>>>"), lambda t: F.aggregate(levels, F.lit(0), lambda n, _: step(t, n)))


def feature_edges(df: DataFrame, feature_cols: list[str], bins: int) -> list[list[float]]:
    """The different exact quantiles i / bins of each feature."""
    qs = [i / bins for i in range(1, bins)]
    return [sorted({r["value"] for r in exact_quantiles(df, c, qs).collect() if r["value"] is not None})
            for c in feature_cols]


def fit_forest(train: DataFrame, feature_cols: list[str], label_col: str, keys: list[str], num_classes: int,
               seed: int = 42, trees: int = 20, depth: int = 5, bins: int = 32, features_a_node: int | None = None,
               min_leaf: int = 1, bootstrap: bool = True) -> Forest:
    """Labels are 0 to ``num_classes`` - 1.  Each tree weighs the rows by a
    Poisson(1) draw of ``keys`` (or all by 1).  A node splits where the Gini
    impurity falls most among ``features_a_node`` features drawn for it
    (default: the square root of their number, rounded up; ties: first feature,
    lowest threshold), if both sides keep ``min_leaf`` of weight and it falls
    at all.

    Jobs: the quantiles, one written table of bins and weights, and a pass
    over it for each of ``depth`` levels."""
    if min(trees, depth, bins - 1, min_leaf, num_classes) < 1 or not feature_cols:
        raise ValueError("trees, depth, bins, min_leaf, num_classes and features must be positive")
    if trees << depth > MAX_NODES:
        raise ValueError(f"{trees} trees of depth {depth} have more than {MAX_NODES} nodes")
    per_node = features_a_node or math.isqrt(len(feature_cols) - 1) + 1
    data = train.where(F.col(label_col).isNotNull())
    edges = feature_edges(data, feature_cols, bins)

    def bin_of(c: str, e: list[float]) -> Column:
        return F.size(F.filter(_constant(e, "array<double>"), lambda v: v < F.col(c).cast("double")))

    # own names first: inside a lambda a column can give way to an alias of the same select
    named = ["label", *[f"f{i}" for i in range(len(feature_cols))], *[f"k{i}" for i in range(len(keys))]]
    data = data.select(label_col, *feature_cols, *keys).toDF(*named)
    label = F.col("label").cast("int")
    checked = F.when(label.between(0, num_classes - 1), label).otherwise(
        F.raise_error(F.lit(f"a label is not one of 0 to {num_classes - 1}")).cast("int"))
    ones = F.array_repeat(F.lit(1).cast("tinyint"), trees)
    rows = checkpointed(data.select(checked.alias("y"), F.array(*[bin_of(f"f{i}", e) for i, e in enumerate(edges)]).alias("x"),
                                    (poisson_weights(trees, seed, named[-len(keys):]) if bootstrap else ones).alias("w")))
    nodes: list[dict] = []
    for level in range(depth):
        splits = _best_splits(rows, nodes, trees, level, num_classes, per_node, min_leaf, seed).collect()
        if not level:
            nodes = [{"tree": r["tree"], "node": 0, "feature": None, "bin": None, "threshold": None,
                      "counts": list(r["a"])} for r in splits]
        by_place = {(n["tree"], n["node"]): n for n in nodes}
        grown = [r for r in splits if r["feature"] is not None]
        for r in grown:
            by_place[r["tree"], r["node"]].update(feature=r["feature"], bin=r["bin"],
                                                  threshold=edges[r["feature"]][r["bin"]])
            for side, counts in ((1, r["l"]), (2, [a - b for a, b in zip(r["a"], r["l"])])):
                nodes.append({"tree": r["tree"], "node": 2 * r["node"] + side, "feature": None, "bin": None,
                              "threshold": None, "counts": list(counts)})
        if not grown:
            break
    if len({n["tree"] for n in nodes}) < trees:
        raise ValueError("a tree has no rows to learn from")
    return Forest(list(feature_cols), num_classes, depth, nodes)


def _best_splits(rows: DataFrame, nodes: list[dict], trees: int, level: int, k: int, per_node: int, min_leaf: int,
                 seed: int) -> DataFrame:
    """(tree, node, feature, bin, a, l) of each node of ``level``: class
    weights of the node and of its lower side; no feature where nothing is won."""
    at = rows.withColumn("n", _walk(nodes, trees, level, "bin", F.col("x")))
    at = at.select("y", "x", F.posexplode(F.arrays_zip("w", "n")).alias("tree", "p"))
    at = at.where((F.col("p.w") > 0) & (F.col("p.n") >= (1 << level) - 1))
    long = at.select("tree", F.col("p.n").alias("node"), "y", F.col("p.w").alias("w"), F.posexplode("x").alias("feature", "bin"))
    classes = range(k)

    def weight(v: str) -> str:
        return "(" + " + ".join(f"{v}[{c}]" for c in classes) + ")"

    def purity(v: str) -> str:
        return "(" + " + ".join(f"double({v}[{c}]) * double({v}[{c}])" for c in classes) + f") / double({weight(v)})"

    # plain SQL text: these are a hundred small expressions
    hist = long.groupBy("tree", "node", "feature", "bin").agg(
        *[F.expr(f"sum(if(y = {c}, w, 0)) AS c{c}") for c in classes])
    hist = hist.repartition("tree", "node")                       # one exchange for the windows and the choice
    mine = "OVER (PARTITION BY tree, node, feature"
    upto = "ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    h = hist.selectExpr("tree", "node", "feature", "bin",
                        f"array({', '.join(f'sum(c{c}) {mine})' for c in classes)}) AS a",
                        f"array({', '.join(f'sum(c{c}) {mine} {upto}' for c in classes)}) AS l")
    drawn = Window.partitionBy("tree", "node").orderBy(U(seed, F.lit("f"), "tree", "node", "feature"), "feature")
    h = h.selectExpr("*", "zip_with(a, l, (p, q) -> p - q) AS u").withColumn("rank", F.dense_rank().over(drawn))
    h = h.selectExpr("*", f"if(rank <= {per_node} AND {weight('l')} >= {min_leaf} AND {weight('u')} >= {min_leaf}, "
                          f"{purity('l')} + {purity('u')}, NULL) AS gain", f"{purity('a')} AS least")
    best = "min_by(struct(feature, bin, l), if(gain > least, struct(-gain, feature, bin), NULL)) AS b"   # null is never least
    return (h.groupBy("tree", "node").agg(F.expr("first(a) AS a"), F.expr(best))
            .selectExpr("tree", "node", "b.feature AS feature", "b.bin AS bin", "a", "b.l AS l"))
