"""Strata queries: quantile buckets, subsets by strata, standardisation,
k-means / bisecting strata, PCA embedding and copula-generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratakit.operators.copula import fit_copula, sample_copula
from stratakit.operators.models import covariance, fit_bisecting, fit_kmeans, fit_pca
from stratakit.operators.pools import augment_pool
from stratakit.operators.strata import quantile_strata, standardise, subset_by_strata
from stratakit.functions.rand import hash32_sql, inv_norm_cdf_sql, norm_cdf_sql, normal_sql
from stratakit.operators.copula import EPS
from stratakit.plans.registry import SEED, query
from stratakit.session import checkpointed
from stratakit.sources import tables as t

QS = [0.25, 0.5, 0.75]
QS_SQL = "[0.25, 0.5, 0.75]"


def _bucket_sql(x, q):
    return " + ".join(f"CAST({x} >= {q}[{i}] AS INTEGER)" for i in range(1, 4))


@query("quantile_strata", f"""
WITH e AS (SELECT quantile_cont(c_acctbal, {QS_SQL}) AS q FROM customer)
SELECT c_custkey AS user_id, CAST({_bucket_sql('c_acctbal', 'e.q')} AS INTEGER) AS stratum
FROM customer CROSS JOIN e""")
def q_quantile_strata(spark, d):
    """Acctbal quartile bucket per customer (exact quantiles)."""
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return quantile_strata(c, "c_acctbal", QS).select("user_id", "stratum")


def user_rating_features(spark, d):
    h = t.history(spark, d)
    return h.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("rating_cnt"),
                                    F.avg("relevance").alias("rating_avg"))


SUBSET_CTES = f"""
h AS ({t.HISTORY_SQL}),
f AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS rating_cnt, avg(relevance) AS rating_avg FROM h GROUP BY user_id),
e AS (SELECT quantile_cont(rating_cnt, {QS_SQL}) AS qc, quantile_cont(rating_avg, {QS_SQL}) AS qa FROM f),
b AS (SELECT f.user_id, rating_cnt, rating_avg, {_bucket_sql('rating_cnt', 'e.qc')} AS bc, {_bucket_sql('rating_avg', 'e.qa')} AS ba
      FROM f CROSS JOIN e),
codes AS (SELECT user_id, rating_cnt, rating_avg, row_number() OVER (ORDER BY user_id) - 1 AS code FROM b WHERE bc = 2 AND ba = 1)"""


def _quantile_subset(spark, d):
    """Users in rating-count bucket 2 and rating-mean bucket 1
    (buckets over the full frame), and their ratings, both re-coded."""
    # one row a user: the quantiles read it in several rounds, the history is joined once for it
    f = checkpointed(user_rating_features(spark, d))
    f = quantile_strata(f, "rating_cnt", QS, "b_cnt")
    f = quantile_strata(f, "rating_avg", QS, "b_avg")
    return subset_by_strata(f, t.history(spark, d).select("user_id", "item_id", "relevance"),
                            "user_id", {"b_cnt": [2], "b_avg": [1]})


@query("subset_by_quantiles", f"""
WITH {SUBSET_CTES}
SELECT CAST(codes.code AS BIGINT) AS user_code, h.item_id, h.relevance
FROM h JOIN codes ON h.user_id = codes.user_id""")
def q_subset_by_quantiles(spark, d):
    """I12, second output: the ratings."""
    ratings = _quantile_subset(spark, d)[1]
    return ratings.withColumnRenamed("user_id", "user_code").select("user_code", "item_id", "relevance")


@query("subset_by_quantiles_users", f"""
WITH {SUBSET_CTES}
SELECT CAST(code AS BIGINT) AS user_code, rating_cnt, round(rating_avg, 9) AS rating_avg FROM codes""")
def q_subset_by_quantiles_users(spark, d):
    """I12, first output: the re-coded user frame."""
    users = _quantile_subset(spark, d)[0]
    return users.select(F.col("user_id").alias("user_code"), "rating_cnt", F.round("rating_avg", 9).alias("rating_avg"))


@query("standardise", """
WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa,
                  avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM customer)
SELECT c_custkey AS user_id,
       round((c_acctbal - ma) / CASE WHEN sa IS NULL OR sa = 0 THEN 1.0 ELSE sa END, 6) AS z_acctbal,
       round((c_nationkey - mn) / CASE WHEN sn IS NULL OR sn = 0 THEN 1.0 ELSE sn END, 6) AS z_nationkey
FROM customer CROSS JOIN s""")
def q_standardise(spark, d):
    """Z-scores with the population std."""
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_nationkey")
    z = standardise(c, ["c_acctbal", "c_nationkey"])
    return z.select("user_id", F.round("c_acctbal", 6).alias("z_acctbal"),
                    F.round("c_nationkey", 6).alias("z_nationkey"))


def _vectors(spark, d):
    return t.read(spark, d, "embeddings").select("vec_id", "embedding")


KMEANS_STEPS = 5


def _lloyd_ctes(rows: str, key: str, k: int) -> str:
    """CTEs ending in ``a{steps}(key, cid)``: standardised vectors (population
    std), the first k centres by hash, then assignment and means step by step.
    ``rows`` has (key, x list)."""
    dist = "list_sum(list_transform(range(1, len(v.z) + 1), lambda i: (v.z[i] - c.z[i]) * (v.z[i] - c.z[i])))"
    out = f"""
rows AS ({rows}),
mo AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (
         SELECT i, avg(x[i]) AS m, CASE WHEN coalesce(stddev_pop(x[i]), 0) = 0 THEN 1.0 ELSE stddev_pop(x[i]) END AS s
         FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM rows) GROUP BY i)),
v AS (SELECT {key}, list_transform(range(1, len(x) + 1), lambda i: (x[i] - mo.m[i]) / mo.s[i]) AS z FROM rows, mo),
c0 AS (SELECT row_number() OVER (ORDER BY {hash32_sql(SEED, key)}, {key}) - 1 AS cid, z FROM v
       ORDER BY {hash32_sql(SEED, key)}, {key} LIMIT {k})"""
    for s in range(KMEANS_STEPS + 1):
        out += f""",
a{s} AS (SELECT v.{key}, any_value(v.z) AS z, arg_min(c.cid, ({dist}, c.cid)) AS cid FROM v, c{s} c GROUP BY v.{key}),
n{s} AS (SELECT cid, list(m ORDER BY i) AS z FROM (SELECT cid, i, avg(z[i]) AS m FROM (
          SELECT cid, z, unnest(range(1, len(z) + 1)) AS i FROM a{s}) GROUP BY cid, i) GROUP BY cid),
c{s + 1} AS (SELECT c.cid, coalesce(n.z, c.z) AS z FROM c{s} c LEFT JOIN n{s} n ON n.cid = c.cid)"""
    return out


@query("kmeans_strata", f"""
WITH {_lloyd_ctes("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings", "vec_id", 10)}
SELECT vec_id, CAST(cid AS INTEGER) AS cluster FROM a{KMEANS_STEPS}""")
def q_kmeans(spark, d):
    """K-means (k=10) on standardised embeddings, fixed starts and steps."""
    v = _vectors(spark, d)
    model = fit_kmeans(v, "embedding", 10, "vec_id", seed=SEED, steps=KMEANS_STEPS)
    return model.apply(v, "embedding").select("vec_id", "cluster")


BISECT_K, BISECT_STEPS = 8, 5


def _bisect_ctes(levels: int) -> str:
    """CTEs ending in ``b{levels}(vec_id, z, node)``: all leaves of a level are
    split in two, children of node n being 2n + 1 and 2n + 2.  ``v`` has
    (vec_id, z)."""
    def dist(c):
        return f"list_sum(list_transform(range(1, len(z) + 1), lambda i: (z[i] - {c}[i]) * (z[i] - {c}[i])))"

    def means(rows, key):
        return (f"SELECT {key}, list(m ORDER BY i) AS m FROM (SELECT {key}, i, avg(z[i]) AS m FROM ("
                f"SELECT {key}, z, unnest(range(1, len(z) + 1)) AS i FROM {rows}) GROUP BY {key}, i) GROUP BY {key}")

    out = ", b0 AS MATERIALIZED (SELECT vec_id, z, 0 AS node FROM v)"
    for n in range(levels):
        out += f""",
m{n} AS MATERIALIZED ({means(f"b{n}", "node")}),
s{n}_0 AS MATERIALIZED (SELECT node, l, list_transform(range(1, len(l) + 1), lambda i: 2 * m[i] - l[i]) AS r FROM (
  SELECT node, any_value(m) AS m, arg_max(z, ({dist("m")}, z)) AS l FROM b{n} JOIN m{n} USING (node) GROUP BY node))"""
        for s in range(BISECT_STEPS + 1):
            out += f""",
w{n}_{s} AS MATERIALIZED (SELECT vec_id, z, node, l, r, CASE WHEN {dist("l")} <= {dist("r")} THEN 1 ELSE 2 END AS side
                          FROM b{n} JOIN s{n}_{s} USING (node))"""
            if s < BISECT_STEPS:
                out += f""",
p{n}_{s} AS MATERIALIZED ({means(f"w{n}_{s}", "node, side")}),
s{n}_{s + 1} AS MATERIALIZED (SELECT s.node, coalesce(a.m, s.l) AS l, coalesce(b.m, s.r) AS r FROM s{n}_{s} s
  LEFT JOIN p{n}_{s} a ON a.node = s.node AND a.side = 1 LEFT JOIN p{n}_{s} b ON b.node = s.node AND b.side = 2)"""
        out += f""",
b{n + 1} AS MATERIALIZED (SELECT vec_id, z, 2 * node + side AS node FROM w{n}_{BISECT_STEPS})"""
    return out


@query("bisecting_strata", f"""
WITH {_lloyd_ctes("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings", "vec_id", 1).split("c0 AS (")[0].rstrip(", " + chr(10))}
{_bisect_ctes(3)}
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY node) - 1 AS INTEGER) AS cluster FROM b3""")
def q_bisecting(spark, d):
    """Divisive hierarchical strata (k=8: three levels, fixed starts and
    steps)."""
    v = _vectors(spark, d)
    return fit_bisecting(v, "embedding", BISECT_K, steps=BISECT_STEPS).apply(v, "embedding").select("vec_id", "cluster")


KMEANS_SUBSET_CTES = f"""
h AS ({t.HISTORY_SQL}),
f AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS rating_cnt, avg(relevance) AS rating_avg FROM h GROUP BY user_id),
{_lloyd_ctes("SELECT u.user_id, [u.acctbal, f.rating_cnt, f.rating_avg] AS x FROM (" + t.USERS_SQL + ") u JOIN f USING (user_id)", "user_id", 10)},
codes AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS code FROM a{KMEANS_STEPS} WHERE cid IN (2, 7, 5, 3))"""


def _kmeans_subset(spark, d):
    """Users clustered on account balance and rating features (k=10),
    clusters 2, 7, 5, 3 kept, and their ratings, both re-coded."""
    u = t.users(spark, d).select("user_id", "acctbal").join(user_rating_features(spark, d), "user_id")
    cols = ["acctbal", "rating_cnt", "rating_avg"]
    cl = fit_kmeans(u, cols, 10, "user_id", seed=SEED, steps=KMEANS_STEPS).apply(u, cols)
    return subset_by_strata(cl, t.history(spark, d).select("user_id", "item_id", "relevance"),
                            "user_id", {"cluster": [2, 7, 5, 3]})


@query("subset_by_kmeans", f"""
WITH {KMEANS_SUBSET_CTES}
SELECT CAST(codes.code AS BIGINT) AS user_code, h.item_id, h.relevance FROM h JOIN codes ON h.user_id = codes.user_id""")
def q_subset_by_kmeans(spark, d):
    """I13, second output: the ratings."""
    ratings = _kmeans_subset(spark, d)[1]
    return ratings.withColumnRenamed("user_id", "user_code").select("user_code", "item_id", "relevance")


@query("subset_by_kmeans_users", f"""
WITH {KMEANS_SUBSET_CTES}
SELECT CAST(codes.code AS BIGINT) AS user_code, c_acctbal AS acctbal FROM codes JOIN customer ON c_custkey = user_id""")
def q_subset_by_kmeans_users(spark, d):
    """I13, first output: the re-coded user frame."""
    return _kmeans_subset(spark, d)[0].select(F.col("user_id").alias("user_code"), "acctbal")


def _pca_ctes(d: int = 64, sweeps: int = 9, share: float = 0.8) -> str:
    """CTEs ending in ``z(vec_id, i, z)`` and ``ld(component, i, x, share)``: Jacobi
    rotations of the covariance of the standardised dimensions, d / 2 disjoint
    pairs at a time in the order of a round-robin tournament (d even)."""
    m = d - 1
    turn = f"""(SELECT i, p, CASE WHEN b = 0 THEN 1.0 ELSE cos(h) END AS co, CASE WHEN b = 0 THEN 0.0 ELSE sin(h) END AS si FROM (
      SELECT i, p, b, CASE WHEN g = 0 THEN CASE WHEN i < p THEN pi() / 4 ELSE -pi() / 4 END ELSE 0.5 * atan(2 * b / g) END AS h FROM (
        SELECT i, p, a[i * {d} + p + 1] AS b, a[i * {d} + i + 1] - a[p * {d} + p + 1] AS g FROM (
          SELECT a, i, CASE WHEN i = {m} THEN step % {m} WHEN i = step % {m} THEN {m} ELSE (2 * (step % {m}) - i + {m}) % {m} END AS p
          FROM jac, range({d}) r(i)))))"""
    return f"""
e AS MATERIALIZED (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, {d + 1}) r(i)),
mo AS MATERIALIZED (SELECT i, avg(x) AS m, CASE WHEN coalesce(stddev_pop(x), 0) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM e GROUP BY i),
z AS MATERIALIZED (SELECT vec_id, i, (x - m) / s AS z FROM e JOIN mo USING (i)),
cov AS MATERIALIZED (SELECT p.i, q.i AS j, avg(p.z * q.z) AS c FROM z p JOIN z q USING (vec_id) GROUP BY p.i, q.i),
jac AS (
  SELECT 0 AS step, list(c ORDER BY i * {d} + j) AS a, list(CAST(i = j AS DOUBLE) ORDER BY i * {d} + j) AS v FROM cov
  UNION ALL
  SELECT step + 1, na, nv FROM (
    SELECT any_value(w.step) AS step,
           list(x.co * (w.a[x.i * {d} + y.i + 1] * y.co + w.a[x.i * {d} + y.p + 1] * y.si)
                + x.si * (w.a[x.p * {d} + y.i + 1] * y.co + w.a[x.p * {d} + y.p + 1] * y.si) ORDER BY x.i * {d} + y.i) AS na,
           list(w.v[x.i * {d} + y.i + 1] * y.co + w.v[x.i * {d} + y.p + 1] * y.si ORDER BY x.i * {d} + y.i) AS nv
    FROM jac w, {turn} x, {turn} y) WHERE step < {sweeps * m}),
fin AS MATERIALIZED (SELECT a, v FROM jac ORDER BY step DESC LIMIT 1),
ev AS MATERIALIZED (SELECT c, a[c * {d} + c + 1] AS l FROM fin, range({d}) r(c)),
kept AS MATERIALIZED (SELECT c, component, share FROM (
  SELECT c, l / sum(l) OVER () AS share, row_number() OVER (ORDER BY l DESC) - 1 AS component,
         sum(l) OVER (ORDER BY l DESC) / sum(l) OVER () - l / sum(l) OVER () AS before FROM ev) WHERE before < {share} - 1e-12),
raw AS MATERIALIZED (SELECT component, share, i, v[i * {d} + c + 1] AS x FROM fin, kept, range({d}) r(i)),
ld AS MATERIALIZED (SELECT component, share, i, x * CASE WHEN big >= 0 THEN 1.0 ELSE -1.0 END AS x
  FROM raw JOIN (SELECT component, arg_max(x, (abs(x), -i)) AS big FROM raw GROUP BY component) USING (component))"""


@query("pca_embedding", f"""
WITH RECURSIVE {_pca_ctes()}
SELECT vec_id, list(round(s, 4) ORDER BY component) AS embedding FROM (
  SELECT vec_id, component, sum(z * x) AS s FROM z JOIN ld USING (i) GROUP BY vec_id, component) GROUP BY vec_id""")
def q_pca(spark, d):
    """I8: standardise + PCA keeping 80 % of the variance.  Close eigenvalues
    make components differ by about 1e-10 from fit to fit, so values are given
    to 4 digits."""
    v = _vectors(spark, d)
    return fit_pca(v, "embedding", variance_share=0.8).apply(v, "embedding").select(
        "vec_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


@query("pca_components", f"""
WITH RECURSIVE {_pca_ctes()}
SELECT CAST(component AS INTEGER) AS component, CAST(i AS INTEGER) AS dim, round(x, 4) AS loading, round(share, 6) AS share FROM ld""")
def q_pca_components(spark, d):
    """I8: loadings and variance shares of the components kept."""
    model = fit_pca(_vectors(spark, d), "embedding", variance_share=0.8)
    return model.components(spark).select("component", "dim", F.round("loading", 4).alias("loading"),
                                          F.round("share", 6).alias("share"))


PCA_DIMS = 16
_PCA_Z = ", ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - avg(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ())"
                   f" / stddev_pop(CAST(embedding[{i + 1}] AS DOUBLE)) OVER () AS z{i}" for i in range(PCA_DIMS))


@query("pca_covariance", f"""
WITH z AS (SELECT {_PCA_Z} FROM embeddings)
{" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop(z{i}, z{j}), 6) AS cov FROM z"
                    for i in range(PCA_DIMS) for j in range(i, PCA_DIMS))}""")
def q_pca_covariance(spark, d):
    """I8, what the components are made of: the covariance of the first
    standardised dimensions (population moments)."""
    v = _vectors(spark, d).select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(PCA_DIMS)])
    return covariance(v, v.columns).select("i", "j", F.round("cov", 6).alias("cov"))


GRID = 101
_PROBS = "[" + ", ".join(repr(i / (GRID - 1)) for i in range(GRID)) + "]"
_M = GRID - 1


def _grid_u_sql(x: str, g: str) -> str:
    k = f"len(list_filter({g}, lambda v: v <= {x}))"
    lo = f"{g}[greatest({k}, 1)]"
    hi = f"{g}[least({k} + 1, {_M + 1})]"
    frac = f"(CASE WHEN {hi} > {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE 0.5 END)"
    u = f"((CAST(greatest({k} - 1, 0) AS DOUBLE) + {frac}) / {float(_M)!r})"
    return f"(CASE WHEN {k} = 0 THEN {EPS!r} WHEN {k} > {_M} THEN {1 - EPS!r} ELSE {u} END)"


def _clip_sql(u: str) -> str:
    return f"least(greatest({u}, {EPS!r}), {1 - EPS!r})"


def _grid_inv_sql(u: str, g: str) -> str:
    pos = f"(least(greatest({u}, 0.0), 1.0) * {float(_M)!r})"
    k = f"least(CAST(floor({pos}) AS INTEGER), {_M - 1})"
    return f"({g}[{k} + 1] + ({pos} - {k}) * ({g}[{k} + 2] - {g}[{k} + 1]))"


# Oracle for the copula: exact grids (quantile_cont), the same normal-score
# and CDF approximations, DuckDB corr(), a closed-form 3x3 Cholesky and the
# same seeded normal draws.
COPULA_SQL = f"""
WITH u AS ({t.USERS_SQL}),
ga AS (SELECT quantile_cont(acctbal, {_PROBS}) AS g FROM u),
gn AS (SELECT quantile_cont(CAST(nationkey AS DOUBLE), {_PROBS}) AS g FROM u),
sc AS (SELECT segment, count(*) AS cnt FROM u GROUP BY segment),
sp AS (SELECT segment,
              CAST(coalesce(sum(cnt) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / (SELECT sum(cnt) FROM sc) AS lo,
              CAST(sum(cnt) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                / (SELECT sum(cnt) FROM sc) AS hi
       FROM sc),
z AS (SELECT {inv_norm_cdf_sql(_clip_sql(_grid_u_sql('u.acctbal', 'ga.g')))} AS z0,
             {inv_norm_cdf_sql(_clip_sql(_grid_u_sql('CAST(u.nationkey AS DOUBLE)', 'gn.g')))} AS z1,
             {inv_norm_cdf_sql(_clip_sql('((sp.lo + sp.hi) / 2.0)'))} AS z2
      FROM u CROSS JOIN ga CROSS JOIN gn JOIN sp ON u.segment = sp.segment),
cr AS (SELECT corr(z0, z1) AS c10, corr(z0, z2) AS c20, corr(z1, z2) AS c21 FROM z),
l1 AS (SELECT c10 AS l10, sqrt(1.0 - c10 * c10) AS l11, c20 AS l20, c21 FROM cr),
ch AS (SELECT l10, l11, l20, (c21 - l20 * l10) / l11 AS l21 FROM l1),
chol AS (SELECT l10, l11, l20, l21, sqrt(1.0 - (l20 * l20 + l21 * l21)) AS l22 FROM ch),
r AS (SELECT unnest(range((SELECT count(*) FROM u))) AS i),
mx AS (SELECT r.i,
              {norm_cdf_sql("(0.0 + 1.0 * " + normal_sql(SEED, 'r.i', '0') + ")")} AS v0,
              {norm_cdf_sql("((0.0 + chol.l10 * " + normal_sql(SEED, 'r.i', '0') + ") + chol.l11 * " + normal_sql(SEED, 'r.i', '1') + ")")} AS v1,
              {norm_cdf_sql("(((0.0 + chol.l20 * " + normal_sql(SEED, 'r.i', '0') + ") + chol.l21 * " + normal_sql(SEED, 'r.i', '1') + ") + chol.l22 * " + normal_sql(SEED, 'r.i', '2') + ")")} AS v2
       FROM r CROSS JOIN chol),
gen AS (SELECT mx.i, {_grid_inv_sql('mx.v0', 'ga.g')} AS acctbal,
               CAST(round({_grid_inv_sql('mx.v1', 'gn.g')}) AS INTEGER) AS nationkey,
               coalesce((SELECT arg_min(sp.segment, sp.hi) FROM sp WHERE mx.v2 < sp.hi),
                        (SELECT max(segment) FROM sp)) AS segment
        FROM mx CROSS JOIN ga CROSS JOIN gn)
SELECT user_id, round(acctbal, 6) AS acctbal, nationkey, segment, 0 AS __is_synth, 0 AS __cluster,
       'real' AS __stratum FROM u
UNION ALL
SELECT (SELECT coalesce(max(user_id) + 1, 0) FROM u) + i, round(acctbal, 6), nationkey, segment, 1, 1, 'copula'
FROM gen"""


@query("copula_rows", COPULA_SQL)
def q_copula(spark, d):
    """I7 + I1: a Gaussian copula fitted on customers (balance, nation,
    segment; exact quantile grids) generates as many rows as there are
    customers; they join the pool under fresh keys."""
    users = t.users(spark, d)
    model = fit_copula(users, ["acctbal", "nationkey"], ["segment"], grid_points=GRID, exact=True)
    n = users.count()
    gen = sample_copula(spark, model, n, SEED)
    pool = augment_pool(users, {"copula": gen}, "user_id")
    return pool.select("user_id", F.round("acctbal", 6).alias("acctbal"), "nationkey", "segment",
                       "__is_synth", "__cluster", "__stratum")
