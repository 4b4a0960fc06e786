"""Matrices and vectors over the supplied tables, each with the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import DenseVector, Matrix, SparseVector

#: Common table expressions that the oracles build on.
SQL = {
    "m_sp": "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "m_op": "SELECT l_orderkey AS i, l_partkey AS j, count(*) AS v FROM lineitem GROUP BY 1, 2",
    "m_rs": "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "m_nat": "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "g_cp2": "SELECT a.l_partkey AS i, b.l_partkey AS j, count(DISTINCT a.l_orderkey) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2",
    "x_part": "SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS v FROM part",
    "x_supp": "SELECT s_suppkey AS i, CAST(floor(s_acctbal) AS BIGINT) AS v FROM supplier",
    "x_pos": "SELECT s_suppkey AS i, CAST(floor(s_acctbal) AS BIGINT) AS v FROM supplier WHERE s_acctbal > 0",
}


def _size(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).collect()[0][0] or 0) + 1


class Inputs:
    """The tables of one folder as matrices and vectors; keys are the indices, so index 0 may be empty."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def parts(self) -> int:
        return _size(self.table("part"), "p_partkey")

    @property
    def suppliers(self) -> int:
        return _size(self.table("supplier"), "s_suppkey")

    def supplier_part(self, flag: str | None = None) -> Matrix:
        line = self.table("lineitem")
        line = line if flag is None else line.where(F.col("l_returnflag") == flag)
        df = line.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
        return Matrix(df, self.suppliers, self.parts)

    def order_part(self) -> Matrix:
        line = self.table("lineitem")
        df = line.groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.count("*").alias("v"))
        return Matrix(df, _size(self.table("orders"), "o_orderkey"), self.parts)

    def nations(self) -> Matrix:
        o, c, li, s = (self.table(t) for t in ("orders", "customer", "lineitem", "supplier"))
        df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        df = df.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count("*").alias("v"))
        n = _size(self.table("nation"), "n_nationkey")
        return Matrix(df, n, n)

    def copurchase(self, least: int = 2) -> Matrix:
        """Parts that share ``least`` orders: the order-part pattern times itself, without the diagonal."""
        pattern = self.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
        df = pattern.select("o", F.col("p").alias("i")).join(pattern.select("o", F.col("p").alias("j")), "o").where("i <> j").groupBy("i", "j").agg(F.count("*").alias("v"))
        return Matrix(df.where(F.col("v") >= least), self.parts, self.parts)

    def part_sizes(self) -> SparseVector:
        return SparseVector(self.table("part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("v")), self.parts)

    def balances(self, positive: bool = False) -> SparseVector:
        s = self.table("supplier")
        s = s.where("s_acctbal > 0") if positive else s
        return SparseVector(s.select(F.col("s_suppkey").alias("i"), F.floor("s_acctbal").cast("long").alias("v")), self.suppliers)

    def dense_balances(self) -> DenseVector:
        from ..operators.vector import to_dense

        return to_dense(self.balances(), 0)

    def low_parts(self, share: int) -> SparseVector:
        """Index vector k -> part number: the parts whose number is divisible by ``share``."""
        p = self.table("part").where(F.col("p_partkey") % share == 0)
        return SparseVector(p.select((F.col("p_partkey") / share).cast("long").alias("i"), F.col("p_partkey").alias("v")), self.parts // share + 1)

    def embedding_matrix(self) -> Matrix:
        e = self.table("embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("p", "v"))
        return Matrix(e.select("i", F.col("p").cast("long").alias("j"), F.col("v").cast("double").alias("v")), _size(self.table("embeddings"), "vec_id"), 64)
