"""Connected components of a graph held as edges between longs.

Alternating large-star and small-star rounds: every vertex repeatedly links its
neighbours to the smallest vertex that it knows, until each component is a star
around its smallest vertex. A round is two joins of edges with one row a vertex;
a vertex with very many neighbours has its edges dealt over repeats of its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm._common import discard, materialise, skew_join


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _stars(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """``edges``, ``n`` of them, have u > v. Large: links each larger neighbour of a vertex to its least one; small: each smaller neighbour, and itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    least = materialise(least, "least", few=True)
    joined = skew_join(near, least, ["u"], "n", 2 * n if large else n, ["v"])
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): each vertex u that isn't the smallest of its component, with the smallest as v.

    ``edges`` has long columns u and v in any order; self-loops and repeats are
    dropped; no edges give no rows.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, label, few=True)
    before, state = None, _state(now)
    while state != before and state[0]:
        large = materialise(_stars(now, state[0], large=True).distinct(), label, few=True)
        small = materialise(_stars(large, state[0], large=False).filter("u <> v").distinct(), label, few=True)
        discard(now, large)
        now, before, state = small, state, _state(small)
    return now
