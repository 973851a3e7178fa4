"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grown, materialize


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges u > v.  Large: every larger neighbour of u is
    tied to the smallest of u and its neighbours.  Small: u and its smaller
    neighbours are tied to the smallest of these."""
    ties = (edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges)
    # Written out first, so that the join's two sides are plain shuffles and a
    # hub's partition can be split.
    least = materialize(ties.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("m", "u").alias("m")), "least")
    moved = ties.join(grown(least), "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(out.filter("u <> v").distinct(), "ties")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another one; component
    is the smallest node reachable.

    Alternating large-star and small-star steps, each a minimum by key, a join
    and a distinct, until the table no longer changes; the number of rounds
    grows with the logarithm of the longest path.  Edges stay distributed
    throughout: only a count and a hash sum reach the driver.  Null ends and
    loops are left out.  Not having converged after ``max_rounds`` is an error.
    """
    now = (edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
           .filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    now = materialize(now, "ties")

    def state(df):
        # modulo, so that the sum of hashes can't overflow
        return df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()

    before = state(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = _round(_round(now, True), False)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
