"""Connected components as Spark joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_scope


#: Edges that a task writes.
TASK_EDGES = 500_000


def _edges(df: DataFrame) -> DataFrame:
    return df.filter("u <> v").select("u", "v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges (u, v) with u > v there are, and how many nodes stand between the graph and a forest of stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    found = nodes.agg(F.sum("down").alias("n"), F.count_if(F.expr("down > 1 or down > 0 and up > 0")).alias("open")).first()
    return found.n or 0, found.open


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (u, v); only nodes that have an edge.

    Every round points each node's larger neighbours at its smallest one (large star), then each node and its smaller
    neighbours at the smallest of them (small star); both are an aggregation and a join on the same key. The smallest
    neighbours are written first, so that the join reads both sides from exchanges and a node with very many neighbours is
    split (skew join) or meets a broadcast side. Tasks that write follow the number of edges, so that a small graph does not
    pay for hundreds of empty files in every round. It ends once every edge leads from a node of no other edge to the centre
    of a star: no node may have two smaller neighbours, or a smaller and a larger one. Rounds grow with the logarithm of the
    nodes. An empty input gives an empty result.
    """
    parallelism = edges.sparkSession.sparkContext.defaultParallelism
    with scratch_scope() as kept:
        now = materialise(_edges(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
        for _ in range(rounds):
            count, open_nodes = _state(now)
            tasks = max(parallelism, -(-count // TASK_EDGES))
            if not open_nodes:
                break
            both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks), "least")
            large = materialise(_edges(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).coalesce(tasks), "large", now, least)
            least = materialise(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            now = materialise(_edges(small).coalesce(tasks), "small", large, least)
        else:
            raise RuntimeError("components: no fixed point was reached")
        centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres).coalesce(2 * tasks), "components")
        discard(now)
        kept.append(out)
    return out
