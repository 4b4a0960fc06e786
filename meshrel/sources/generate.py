"""Graph generators whose rows depend on their number alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, initiator: tuple[float, float, float, float] = (0.57, 0.19, 0.19, 0.05), seed: int = 0) -> DataFrame:
    """(src, dst): edge_factor * 2^scale edges among 2^scale vertices; a hash of (edge, level) picks each quadrant."""
    a, b, c, _ = (round(sum(initiator[: k + 1]) * (1 << 30)) for k in range(4))
    edges = spark.range(edge_factor << scale)
    src, dst = [], []
    for level in range(scale):
        h = F.xxhash64("id", F.lit(level), F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1))
        src.append(F.when(h >= b, F.lit(1 << level)).otherwise(0))
        dst.append(F.when(((h >= a) & (h < b)) | (h >= c), F.lit(1 << level)).otherwise(0))
    total = lambda bits: reduce(lambda x, y: x + y, bits).cast("long")
    return edges.select(total(src).alias("src"), total(dst).alias("dst"))


def rename_vertices(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Ends renumbered by (i, v)."""
    s = order.select(F.col("i").alias("src"), F.col("v").alias("s"))
    t = order.select(F.col("i").alias("dst"), F.col("v").alias("t"))
    return edges.join(s, "src").join(t, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


def shuffle_edges(edges: DataFrame, seed: int = 0) -> DataFrame:
    """The same edges in an order drawn by a hash."""
    h = F.xxhash64("src", "dst", F.lit(seed))
    return edges.repartitionByRange(h, "src", "dst").sortWithinPartitions(h, "src", "dst")


def graph500_prepare(edges: DataFrame, n: int):
    """Symmetric adjacency without loops, and the vertices that have an edge."""
    from ..operators import matrix as M

    a = M.from_edges(edges, n, remove_loops=True)
    a = M.symmetrise(a)
    return a, a.df.select(F.col("i").alias("vertex")).distinct()
