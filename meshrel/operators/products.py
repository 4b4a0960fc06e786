"""Generalised products: an equi-join on the inner index and an aggregate, planned by Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semiring import PLUS_TIMES, Semiring
from ..types import DenseVector, Matrix, SparseVector


def _products(a: DataFrame, b: DataFrame, keys: list[str], sr: Semiring) -> DataFrame:
    joined = a.join(b, "k")
    if sr.keep is not None:
        joined = joined.where(sr.keep(F.col("av"), F.col("bv")))
    return joined.select(*keys, sr.multiply(F.col("av"), F.col("bv")).alias("v"))


def spgemm(a: Matrix, b: Matrix, sr: Semiring = PLUS_TIMES, left_transposed: bool = False, right_transposed: bool = False) -> Matrix:
    """C(i, j) = add over k of multiply(A(i, k), B(k, j)); either side may be given transposed."""
    ar, ac = (a.ncol, a.nrow) if left_transposed else (a.nrow, a.ncol)
    br, bc = (b.ncol, b.nrow) if right_transposed else (b.nrow, b.ncol)
    if ac != br:
        raise ValueError(f"inner dimensions differ: {ac} and {br}")
    ai, ak = ("j", "i") if left_transposed else ("i", "j")
    bk, bj = ("j", "i") if right_transposed else ("i", "j")
    left = a.df.select(F.col(ai).alias("i"), F.col(ak).alias("k"), F.col("v").alias("av"))
    right = b.df.select(F.col(bk).alias("k"), F.col(bj).alias("j"), F.col("v").alias("bv"))
    return Matrix(_products(left, right, ["i", "j"], sr).groupBy("i", "j").agg(sr.add(F.col("v")).alias("v")), ar, bc)


def spgemm_layered(a: Matrix, b: Matrix, layers: int, sr: Semiring = PLUS_TIMES) -> Matrix:
    """spgemm for skewed inner indices: a heavy index is salted, products are added by layer and then together."""
    if a.ncol != b.nrow:
        raise ValueError(f"inner dimensions differ: {a.ncol} and {b.nrow}")
    salt = F.pmod(F.xxhash64("i"), F.lit(layers)).cast("int")
    left = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("av"), salt.alias("layer"))
    right = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"), F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    joined = left.join(right, ["k", "layer"])
    if sr.keep is not None:
        joined = joined.where(sr.keep(F.col("av"), F.col("bv")))
    partial = joined.select("i", "j", "layer", sr.multiply(F.col("av"), F.col("bv")).alias("v"))
    return Matrix(partial.groupBy("i", "j").agg(sr.add(F.col("v")).alias("v")), a.nrow, b.ncol)


def spgemm_phased(a: Matrix, b: Matrix, phases: int, prune: Callable[[Matrix], Matrix] | None = None, sr: Semiring = PLUS_TIMES) -> Matrix:
    """spgemm by column phases, each pruned (by columns) before it joins the others."""
    out = None
    for p in range(phases):
        part = spgemm(a, b.with_df(b.df.where(F.pmod(F.col("j"), F.lit(phases)) == p)), sr)
        part = prune(part) if prune else part
        out = part if out is None else out.with_df(out.df.unionByName(part.df))
    return out


def block_spgemm(a: Matrix, b: Matrix, row_blocks: int, col_blocks: int, sr: Semiring = PLUS_TIMES) -> Iterator[tuple[int, int, int, int, Matrix]]:
    """The product block by block: (row block, column block, row offset, column offset, block with its own indices)."""
    rs, cs = -(-a.nrow // row_blocks), -(-b.ncol // col_blocks)
    for r in range(row_blocks):
        for c in range(col_blocks):
            rows = a.df.where((F.col("i") >= r * rs) & (F.col("i") < (r + 1) * rs)).select((F.col("i") - r * rs).alias("i"), "j", "v")
            cols = b.df.where((F.col("j") >= c * cs) & (F.col("j") < (c + 1) * cs)).select("i", (F.col("j") - c * cs).alias("j"), "v")
            height, width = max(0, min(rs, a.nrow - r * rs)), max(0, min(cs, b.ncol - c * cs))
            yield r, c, r * rs, c * cs, spgemm(Matrix(rows, height, a.ncol), Matrix(cols, b.nrow, width), sr)


def square(a: Matrix, sr: Semiring = PLUS_TIMES) -> Matrix:
    return spgemm(a, a, sr)


def spmv_sparse(a: Matrix, x: SparseVector, sr: Semiring = PLUS_TIMES, index_is_value: bool = False) -> SparseVector:
    """y = A x over stored entries; rows that no entry reaches stay absent. index_is_value: x(i) is i, so only indices move."""
    if a.ncol != x.n:
        raise ValueError(f"dimensions differ: {a.ncol} and {x.n}")
    left = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = x.df.select(F.col("i").alias("k"), *([] if index_is_value else [F.col("v").alias("bv")]))
    if index_is_value:
        left = left.withColumn("bv", F.col("k"))
    return SparseVector(_products(left, right, ["i"], sr).groupBy("i").agg(sr.add(F.col("v")).alias("v")), a.nrow)


def spmv(a: Matrix, x: DenseVector, sr: Semiring = PLUS_TIMES) -> DenseVector:
    """y = A x; rows without a product hold the semiring's identity."""
    y = spmv_sparse(a, x, sr)
    every = a.df.sparkSession.range(a.nrow).select(F.col("id").alias("i"))
    value = F.col("v") if sr.identity is None else F.coalesce("v", F.lit(sr.identity))
    return DenseVector(every.join(y.df, "i", "left").select("i", value.alias("v")), a.nrow)


def flops(a: Matrix, b: Matrix) -> DataFrame:
    """One row: how many products spgemm makes (never materialised: counts of each side meet)."""
    left = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("x"))
    right = b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("y"))
    return left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("flops"))


def nnz_estimate(a: Matrix, b: Matrix, exact: bool = False, error: float = 0.05) -> DataFrame:
    """One row: entries of the product, exact or by a distinct-count sketch."""
    pairs = a.df.select("i", F.col("j").alias("k")).join(b.df.select(F.col("i").alias("k"), "j"), "k").select("i", "j")
    return pairs.agg((F.countDistinct("i", "j") if exact else F.approx_count_distinct(F.struct("i", "j"), error)).alias("nnz"))


def nnz_sampled(a: Matrix, b: Matrix, samples: int = 64, seed: int = 1) -> DataFrame:
    """(i, nnz): about how many entries each column of the product has, without a product.

    Every row of A draws ``samples`` exponential variables by a hash; their minima
    over what a column reaches, taken over A's columns and then over B's, have a
    mean of one over the number of rows reached. The relative error is about
    1 / sqrt(samples - 2).
    """
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "i"), 11).cast("double") + 1) / float(1 << 53)
    names = [f"e{k}" for k in range(samples)]
    first = a.df.groupBy(F.col("j").alias("k")).agg(*(F.min(-F.log(uniform(k))).alias(n) for k, n in enumerate(names)))
    second = b.df.select(F.col("i").alias("k"), F.col("j").alias("i")).join(first, "k").groupBy("i").agg(*(F.min(n).alias(n) for n in names))
    return second.select("i", ((samples - 1) / sum((F.col(n) for n in names), F.lit(0.0))).alias("nnz"))


def phases_for(a: Matrix, b: Matrix, bytes_available: int, bytes_each: int = 24) -> int:
    """Phases so that the products of one fit in the bytes given."""
    return max(1, -(-flops(a, b).collect()[0][0] * bytes_each // bytes_available))
