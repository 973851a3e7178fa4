"""Learned operators: response (I6), class probabilities (I16), k-means and
bisecting strata (I9, I10), standardise + PCA (I8).

Fitting and applying are separate: every ``fit_*`` returns a model that places
new rows with ``apply`` and is kept with ``save`` and ``load`` (a JSON table of
its numbers, or MLlib's own format).  Standardisation divides by the population
standard deviation throughout, a zero one by 1."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import FMRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratakit.functions.rand import hash32
from stratakit.operators.strata import standardise
from stratakit.session import local_table
from stratakit.sources.io import load_params, save_params


def as_array(cols) -> Column:
    """One array column, or several numeric ones, as ``array<double>``."""
    if isinstance(cols, str):
        return F.col(cols).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in cols])


def literal(values: list) -> Column:
    """A list of numbers, or of such lists, as one constant: a SQL text is one
    call to the JVM instead of one a number."""
    def text(v):
        return f"array({', '.join(map(text, v))})" if isinstance(v, list) else f"{float(v)!r}D"
    return F.expr(text(values))


@dataclass
class Scaler:
    """Means and population standard deviations by position."""
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    def expr(self, vec: Column) -> Column:
        if not self.mean:
            return vec
        m, s = literal(self.mean), literal(self.std)
        return F.transform(vec, lambda x, i: (x - F.element_at(m, i + 1)) / F.element_at(s, i + 1))


def fit_scaler(df: DataFrame, cols) -> Scaler:
    """One aggregate over (position, value); as many rows as positions."""
    rows = (df.select(F.posexplode(as_array(cols)).alias("i", "x")).groupBy("i")
            .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect())
    return Scaler([r["m"] or 0.0 for r in rows], [r["s"] or 1.0 for r in rows])


# ------------------------------------------------------------------ responses
@dataclass
class ResponseModel:
    """A factorisation machine over user and item features."""
    pipeline: PipelineModel
    user_key: str
    item_key: str
    user_feats: list[str]
    item_feats: list[str]
    moments: dict[str, list[float]]

    def features(self, pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
        joined = (pairs.join(users.select(self.user_key, *self.user_feats), self.user_key)
                  .join(items.select(self.item_key, *self.item_feats), self.item_key))
        return joined.withColumns({f"_f_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})

    def apply(self, pairs: DataFrame, users: DataFrame, items: DataFrame, out_col: str = "prediction") -> DataFrame:
        scored = self.pipeline.transform(self.features(pairs, users, items))
        return scored.select(*pairs.columns, F.col("prediction").alias(out_col))

    def save(self, path: str, spark) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        save_params(spark, {k: v for k, v in self.__dict__.items() if k != "pipeline"}, f"{path}/params")

    @staticmethod
    def load(path: str, spark) -> "ResponseModel":
        return ResponseModel(PipelineModel.load(f"{path}/pipeline"), **load_params(spark, f"{path}/params"))


def fit_response(train: DataFrame, users: DataFrame, items: DataFrame, user_key: str, item_key: str,
                 value_col: str, user_feats: list[str], item_feats: list[str], seed: int = 42,
                 factor_size: int = 4, max_iter: int = 30) -> ResponseModel:
    """Fit on ``train`` (pairs with values) joined to both sides' features."""
    model = ResponseModel(None, user_key, item_key, list(user_feats), list(item_feats), {})
    feats = model.user_feats + model.item_feats
    joined = model.features(train.select(user_key, item_key, value_col), users, items)
    m = joined.agg(*[F.avg(c).alias(f"m_{c}") for c in feats], *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]).first()
    model.moments = {c: [m[f"m_{c}"] or 0.0, m[f"s_{c}"] or 1.0] for c in feats}
    joined = model.features(train.select(user_key, item_key, value_col), users, items)
    model.pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_f_{c}" for c in feats], outputCol="_features", handleInvalid="keep"),
        FMRegressor(featuresCol="_features", labelCol=value_col, factorSize=factor_size,
                    maxIter=max_iter, seed=seed, stepSize=0.05)]).fit(joined)
    return model


@dataclass
class FactoredResponse:
    """``sum over r of (a_r . u)(b_r . v)`` over a user's and an item's
    features, standardised and led by a constant; a null feature counts as its
    mean.  ``weights`` is the product of both factor matrices."""
    user_key: str
    item_key: str
    user_feats: list[str]
    item_feats: list[str]
    moments: dict[str, list[float]] = field(default_factory=dict)
    weights: list[list[float]] = field(default_factory=list)

    def sides(self) -> tuple[list[Column], list[Column]]:
        def side(feats):
            scaled = [(F.col(c) - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1]) for c in feats]
            return [F.lit(1.0), *[F.coalesce(c, F.lit(0.0)) for c in scaled]]
        return side(self.user_feats), side(self.item_feats)

    def joined(self, pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
        return (pairs.join(users.select(self.user_key, *self.user_feats), self.user_key)
                .join(items.select(self.item_key, *self.item_feats), self.item_key))

    def apply(self, pairs: DataFrame, users: DataFrame, items: DataFrame, out_col: str = "prediction") -> DataFrame:
        u, v = self.sides()
        score = sum(F.lit(float(w)) * a * b for a, row in zip(u, self.weights) for b, w in zip(v, row))
        return self.joined(pairs, users, items).select(*pairs.columns, score.alias(out_col))

    def save(self, path: str, spark) -> None:
        save_params(spark, asdict(self), path)

    @staticmethod
    def load(path: str, spark) -> "FactoredResponse":
        return FactoredResponse(**load_params(spark, path))


def product_sums(rows: DataFrame, col: str) -> np.ndarray:
    """The sums of all products of two places of an array column without
    nulls: tasks add up their own, and a matrix of the array's width reaches
    the driver."""
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = total + x.T @ x
        if not np.isscalar(total):
            at = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (at[0], at[1], total)], names=["i", "j", "s"])
    out = (rows.select(col).mapInArrow(run, "i bigint, j bigint, s double")
           .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    width = 1 + max((r["i"] for r in out), default=-1)
    sums = np.zeros((width, width))
    for r in out:
        sums[r["i"], r["j"]] = r["s"]
    return sums


def fit_factored_response(train: DataFrame, users: DataFrame, items: DataFrame, user_key: str, item_key: str,
                          value_col: str, user_feats: list[str], item_feats: list[str], rank: int = 2,
                          steps: int = 5, ridge: float = 1.0) -> FactoredResponse:
    """Alternating least squares over features, so that users and items without
    a history are scored too.

    One aggregate over ``train`` (pairs with values) gives the sums of products
    that the normal equations of every step are made of; the ``steps`` then
    solve systems of ``rank`` times the number of features on the driver.
    Item factors start as the first ``rank`` unit vectors; ``rank`` is at
    most the number of item features and the constant."""
    if not 1 <= rank <= len(item_feats) + 1:
        raise ValueError("rank must be between 1 and the number of item features and the constant")
    model = FactoredResponse(user_key, item_key, list(user_feats), list(item_feats))
    feats = model.user_feats + model.item_feats
    rows = (model.joined(train.select(user_key, item_key, F.col(value_col).cast("double").alias("_y")), users, items)
            .where(F.col("_y").isNotNull()))
    m = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in feats],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in feats]).first()
    model.moments = {c: [m[f"m_{c}"] or 0.0, m[f"s_{c}"] or 1.0] for c in feats}
    u, v = model.sides()
    p, q = len(u), len(v)
    if not m["n"]:
        model.weights = [[0.0] * q for _ in range(p)]
        return model
    sums = product_sums(rows.select(F.array(*[a * b for a in u for b in v], F.col("_y")).alias("_z")), "_z")
    both, target = sums[:-1, :-1].reshape(p, q, p, q), sums[:-1, -1].reshape(p, q)
    a, b = np.zeros((p, rank)), np.eye(q, rank)
    for _ in range(steps):
        n = np.einsum("jr,ijkl,ls->irks", b, both, b).reshape(p * rank, p * rank)
        a = np.linalg.solve(n + ridge * np.eye(p * rank), (target @ b).ravel()).reshape(p, rank)
        n = np.einsum("ir,ijkl,ks->jrls", a, both, a).reshape(q * rank, q * rank)
        b = np.linalg.solve(n + ridge * np.eye(q * rank), (target.T @ a).ravel()).reshape(q, rank)
    model.weights = (a @ b.T).tolist()
    return model


# ------------------------------------------------------------------- classes
def fit_classifier(train: DataFrame, feature_cols: list[str], label_col: str, seed: int = 42,
                   num_trees: int = 30, max_depth: int = 6) -> PipelineModel:
    """I16: multiclass random forest; MLlib's ``save`` and ``load`` keep it."""
    asm = VectorAssembler(inputCols=feature_cols, outputCol="_features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label_col, seed=seed,
                                numTrees=num_trees, maxDepth=max_depth)
    # the copy has no training summary, whose session can't go to tasks once it has observed a query
    return Pipeline(stages=[asm, rf]).fit(train).copy()


def class_probabilities(model: PipelineModel, df: DataFrame, out_col: str = "probs") -> DataFrame:
    """I16: the model's probability array of each row."""
    return (model.transform(df).withColumn(out_col, vector_to_array("probability"))
            .drop("_features", "rawPrediction", "probability", "prediction"))


# ------------------------------------------------------------------- clusters
@dataclass
class KMeansStrata:
    """Centres in scaled space; a row belongs to the nearest (lowest
    number on ties)."""
    scaler: Scaler
    centres: list[list[float]]

    def distances(self, vec: Column) -> Column:
        z = self.scaler.expr(vec)
        return F.transform(literal(self.centres), lambda c: F.aggregate(
            F.zip_with(z, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    def apply(self, df: DataFrame, cols, out_col: str = "cluster") -> DataFrame:
        d = self.distances(as_array(cols))
        return df.withColumn("_d", d).withColumn(
            out_col, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")

    def save(self, path: str, spark) -> None:
        save_params(spark, {"scaler": asdict(self.scaler), "centres": self.centres}, path)

    @staticmethod
    def load(path: str, spark) -> "KMeansStrata":
        p = load_params(spark, path)
        return KMeansStrata(Scaler(**p["scaler"]), p["centres"])


def fit_kmeans(df: DataFrame, cols, k: int, key: str, seed: int = 42, steps: int = 10,
               scale: bool = True) -> KMeansStrata:
    """Lloyd's algorithm with repeatable starts: the first centres are the k
    rows of smallest ``hash32(seed, key)``, and each of the ``steps`` is one
    assignment and one aggregate (k rows of means reach the driver).  A centre
    without rows stays where it is; equal steps in a row end it early."""
    rows = df.select(key, as_array(cols).alias("_x")).where(F.col("_x").isNotNull())
    scaler = fit_scaler(df, cols) if scale else Scaler()
    scaled = rows.select(key, scaler.expr(F.col("_x")).alias("_x")).persist()
    try:
        first = scaled.orderBy(hash32(seed, key), key).limit(k).select("_x").collect()      # k rows
        model = KMeansStrata(Scaler(), [list(r["_x"]) for r in first])
        d = len(model.centres[0]) if model.centres else 0
        for _ in range(steps if d else 0):
            means = (model.apply(scaled, "_x", "_c").groupBy("_c")
                     .agg(F.array(*[F.avg(F.col("_x")[i]) for i in range(d)]).alias("m")).collect())
            moved = list(model.centres)
            for r in means:
                moved[r["_c"]] = list(r["m"])
            if moved == model.centres:
                break
            model.centres = moved
    finally:
        scaled.unpersist()
    return KMeansStrata(scaler, model.centres)


@dataclass
class BisectingStrata:
    """Hierarchical (divisive) strata, the distributed stand-in for
    agglomerative linkage, which needs all pairs.  ``splits`` is the tree: rows
    (node, left, right, two centres) from the root, 0; a row goes left on
    ties, and nodes without a split are the strata, numbered in node order."""
    scaler: Scaler
    splits: list[dict] = field(default_factory=list)

    def strata(self) -> list[int]:
        inner = {s["node"] for s in self.splits}
        return [n for n in range(2 * len(self.splits) + 1) if n not in inner]

    def depth(self) -> int:
        below = {0: 0}
        for s in self.splits:
            below[s["left"]] = below[s["right"]] = below[s["node"]] + 1
        return max(below.values())

    def node(self, vec: Column) -> Column:
        """The leaf that a row reaches by walking down."""
        if not self.splits:
            return F.lit(0)
        z, at = self.scaler.expr(vec), {s["node"]: s for s in self.splits}
        nodes = [at.get(n) for n in range(2 * len(self.splits) + 1)]
        width = len(self.splits[0]["centres"][0])

        def children(side):
            return F.array(*[F.lit(s[side] if s else -1) for s in nodes])

        left, right = children("left"), children("right")
        near, far = (literal([s["centres"][side] if s else [0.0] * width for s in nodes]) for side in (0, 1))

        def walk(n, _):
            down = F.when(squared(z, near[n]) <= squared(z, far[n]), left[n]).otherwise(right[n])
            return F.when(left[n] < 0, n).otherwise(down)
        return F.when(z.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(self.depth())), F.lit(0), walk))

    def apply(self, df: DataFrame, cols, out_col: str = "cluster") -> DataFrame:
        place = F.array_position(F.array(*[F.lit(n) for n in self.strata()]), self.node(as_array(cols))) - 1
        return df.withColumn(out_col, place.cast("int"))

    def save(self, path: str, spark) -> None:
        save_params(spark, {"scaler": asdict(self.scaler), "splits": self.splits}, path)

    @staticmethod
    def load(path: str, spark) -> "BisectingStrata":
        p = load_params(spark, path)
        return BisectingStrata(Scaler(**p["scaler"]), p["splits"])


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def fit_bisecting(df: DataFrame, cols, k: int, steps: int = 10, scale: bool = True) -> BisectingStrata:
    """Splits all leaves of a level at once, those of the largest sum of squares
    (then the lowest node) where fewer than all are wanted, until there are
    ``k`` or all rows of each leaf are equal.

    A split starts from the leaf's row farthest from its mean and that row
    mirrored at the mean, so both sides have rows; ``steps`` steps of Lloyd
    follow.  Starts and steps cost an aggregate each for a whole level, and at
    most 2k rows of sums reach the driver.  Null rows take no part."""
    scaler = fit_scaler(df, cols) if scale else Scaler()
    rows = df.select(as_array(cols).alias("_x")).where(F.col("_x").isNotNull())
    rows = rows.select(scaler.expr(F.col("_x")).alias("_x")).withColumn("_v", array_to_vector("_x")).persist()
    tree = BisectingStrata(Scaler())
    try:
        first = rows.first()
        d = len(first["_x"]) if first else 0
        while d and len(tree.splits) + 1 < k:
            leaves = [(r["_n"], r["s"]["mean"].toArray(), (r["s"]["count"] - 1) * r["s"]["variance"].toArray().sum())
                      for r in rows.withColumn("_n", tree.node(F.col("_x"))).groupBy("_n").agg(
                          Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("_v")).alias("s")).collect()
                      if (r["s"]["min"].toArray() != r["s"]["max"].toArray()).any()]
            leaves = sorted(leaves, key=lambda leaf: (-leaf[2], leaf[0]))[:k - len(tree.splits) - 1]
            if not leaves:
                break
            mean = {n: m.tolist() for n, m, _ in sorted(leaves, key=lambda leaf: leaf[0])}
            means = literal([mean.get(n, [0.0] * d) for n in range(2 * len(tree.splits) + 1)])
            far = (rows.withColumn("_n", tree.node(F.col("_x"))).where(F.col("_n").isin(list(mean)))
                   .groupBy("_n").agg(F.max(F.struct(squared(F.col("_x"), means[F.col("_n")]).alias("d"),
                                                     F.col("_x").alias("x"))).alias("m"))
                   .orderBy("_n").collect())
            for r in far:
                n, start = 2 * len(tree.splits) + 1, list(r["m"]["x"])
                tree.splits.append({"node": r["_n"], "left": n, "right": n + 1, "centres":
                                    [start, [2 * m - s for m, s in zip(mean[r["_n"]], start)]]})
            new = {s[side]: (s, i) for s in tree.splits[-len(far):] for i, side in enumerate(("left", "right"))}
            for _ in range(steps):
                moved = (rows.withColumn("_n", tree.node(F.col("_x"))).where(F.col("_n").isin(list(new)))
                         .groupBy("_n").agg(Summarizer.mean(F.col("_v")).alias("m")).collect())
                before = [list(s["centres"]) for s in tree.splits]
                for r in moved:
                    s, i = new[r["_n"]]
                    s["centres"][i] = r["m"].toArray().tolist()
                if before == [s["centres"] for s in tree.splits]:
                    break
    finally:
        rows.unpersist()
    return BisectingStrata(scaler, tree.splits)


# ------------------------------------------------------------------ embedding
@dataclass
class PcaEmbedding:
    """I8: standardise (at transform too, Q8), then the leading components,
    each with the sign that makes its largest loading (the first of equal ones)
    positive, so that a fit is repeatable."""
    scaler: Scaler
    model: PCAModel

    def loadings(self) -> list[list[float]]:
        """A list of loadings a component."""
        pc = self.model.pc.toArray().T
        return [[float(x) for x in c * (1.0 if c[abs(c).argmax()] >= 0 else -1.0)] for c in pc]

    def components(self, spark) -> DataFrame:
        """(component, dim, loading, share): as many rows as components times
        dimensions; ``share`` of the variance."""
        share = [float(x) for x in self.model.explainedVariance.toArray()]
        rows = [(i, j, x, share[i]) for i, c in enumerate(self.loadings()) for j, x in enumerate(c)]
        return local_table(spark, rows, StructType.fromDDL("component int, dim int, loading double, share double"))

    def apply(self, df: DataFrame, cols, out_col: str = "embedding") -> DataFrame:
        v = df.withColumn("_features", array_to_vector(self.scaler.expr(as_array(cols))))
        plain = self.model.pc.toArray().T
        signs = F.array(*[F.lit(1.0 if (c == p).all() else -1.0) for c, p in zip(self.loadings(), plain)])
        signed = F.zip_with(vector_to_array("_pca"), signs, lambda x, s: x * s)
        return self.model.transform(v).withColumn(out_col, signed).drop("_features", "_pca")

    def save(self, path: str, spark) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        save_params(spark, asdict(self.scaler), f"{path}/scaler")

    @staticmethod
    def load(path: str, spark) -> "PcaEmbedding":
        return PcaEmbedding(Scaler(**load_params(spark, f"{path}/scaler")), PCAModel.load(f"{path}/model"))


def fit_pca(df: DataFrame, cols, n_components: int | None = None, variance_share: float = 0.8) -> PcaEmbedding:
    """The component count is given, or the smallest whose explained variance
    reaches ``variance_share``."""
    scaler = fit_scaler(df, cols)
    v = df.select(array_to_vector(scaler.expr(as_array(cols))).alias("_features"))
    if n_components is None:
        full = PCA(k=len(scaler.mean), inputCol="_features", outputCol="_pca").fit(v)
        acc, n_components = 0.0, len(scaler.mean)
        for i, share in enumerate(full.explainedVariance.toArray(), start=1):
            acc += share
            if acc >= variance_share - 1e-12:
                n_components = i
                break
    return PcaEmbedding(scaler, PCA(k=n_components, inputCol="_features", outputCol="_pca").fit(v))


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, cov): the population covariance of the standardised columns,
    i <= j, in one aggregate."""
    z = standardise(df, cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = z.agg(*[F.covar_pop(cols[i], cols[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("cov")) for i, j in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.i", "r.j", "r.cov")
