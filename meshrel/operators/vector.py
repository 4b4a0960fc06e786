"""Operators on vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import DenseVector, SparseVector
from .matrix import _numbered

Op = Callable[..., Column]


# constructors

def constant(spark: SparkSession, n: int, value) -> DenseVector:
    return DenseVector(spark.range(n).select(F.col("id").alias("i"), F.lit(value).alias("v")), n)


def iota(spark: SparkSession, n: int, first: int = 0) -> DenseVector:
    return DenseVector(spark.range(n).select(F.col("id").alias("i"), (F.col("id") + first).alias("v")), n)


def from_pairs(df: DataFrame, n: int, sum_duplicates: bool = True) -> SparseVector:
    """Vector of (i, v) rows; repeats are summed, else the smallest stays."""
    return SparseVector(df.groupBy("i").agg((F.sum if sum_duplicates else F.min)("v").alias("v")), n)


def permutation(x: DenseVector, seed: int = 0) -> DenseVector:
    """The values in an order drawn by a hash of their positions."""
    drawn = _numbered(x.df.withColumn("h", F.xxhash64("i", F.lit(seed))), ["h", "i"], "k")
    return DenseVector(drawn.select(F.col("k").alias("i"), "v"), x.n)


def candidates(spark: SparkSession, n: int, vertices: int, seed: int = 0) -> DenseVector:
    """n vertex numbers drawn by a hash."""
    return DenseVector(spark.range(n).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(vertices)).alias("v")), n)


def concatenate(vectors: list[DenseVector]) -> DenseVector:
    out, offset = None, 0
    for x in vectors:
        moved = x.df.select((F.col("i") + offset).alias("i"), "v")
        out = moved if out is None else out.unionByName(moved)
        offset += x.n
    return DenseVector(out, offset)


def to_dense(x: SparseVector, default=0) -> DenseVector:
    every = x.df.sparkSession.range(x.n).select(F.col("id").alias("i"))
    return DenseVector(every.join(x.df.withColumn("there", F.lit(True)), "i", "left").select("i", F.when(F.col("there"), F.col("v")).otherwise(F.lit(default)).alias("v")), x.n)


def to_sparse(x: DenseVector, pred: Op | None = None) -> SparseVector:
    return SparseVector(x.df if pred is None else x.df.where(pred(F.col("v"))), x.n)


# projections and filters

def apply(x: SparseVector, f: Op, mask: SparseVector | None = None) -> SparseVector:
    """v <- f(v), with a mask only where it has an entry."""
    if mask is None:
        return x.with_df(x.df.withColumn("v", f(F.col("v"))))
    m = mask.df.select("i", F.lit(True).alias("m"))
    return x.with_df(x.df.join(m, "i", "left").select("i", F.when(F.col("m"), f(F.col("v"))).otherwise(F.col("v")).alias("v")))


def apply_indexed(x: SparseVector, f: Op) -> SparseVector:
    return x.with_df(x.df.withColumn("v", f(F.col("v"), F.col("i"))))


def set_to_index(x: SparseVector) -> SparseVector:
    return x.with_df(x.df.withColumn("v", F.col("i")))


def assign(x: SparseVector, value) -> SparseVector:
    return x.with_df(x.df.withColumn("v", F.lit(value)))


def set_element(x: SparseVector, i: int, value) -> SparseVector:
    kept = x.df.where(F.col("i") != i)
    one = x.df.sparkSession.range(1).select(F.lit(i).cast("long").alias("i"), F.lit(value).cast(x.df.schema["v"].dataType).alias("v"))
    return x.with_df(kept.unionByName(one))


def delete_element(x: SparseVector, i: int) -> SparseVector:
    return SparseVector(x.df.where(F.col("i") != i), x.n)


def number_entries(x: SparseVector, first: int = 0) -> SparseVector:
    """v <- consecutive numbers in order of index."""
    return x.with_df(_numbered(x.df.select("i"), ["i"], "k").select("i", (F.col("k") + first).alias("v")))


def prune(x: SparseVector, pred: Op) -> SparseVector:
    return SparseVector(x.df.where(~pred(F.col("v"))), x.n)


def find(x: SparseVector, pred: Op) -> SparseVector:
    return SparseVector(x.df.where(pred(F.col("v"))), x.n)


def find_indices(x: SparseVector, pred: Op) -> DataFrame:
    """(i, v): matching indices, numbered from 0."""
    return _numbered(x.df.where(pred(F.col("v"))).select("i"), ["i"], "k").select(F.col("k").alias("i"), F.col("i").alias("v"))


def find_values(x: SparseVector, pred: Op) -> DataFrame:
    """(i, v): matching values in order of index, numbered from 0."""
    return _numbered(x.df.where(pred(F.col("v"))), ["i"], "k").select(F.col("k").alias("i"), "v")


def count(x: SparseVector, pred: Op) -> DataFrame:
    return x.df.agg(F.count_if(pred(F.col("v"))).alias("n"))


def select(x: SparseVector, d: DenseVector, pred: Op, op: Op | None = None) -> SparseVector:
    """Entries for which pred(d(i)), values combined with d(i) by op if given."""
    joined = x.df.join(d.df.select("i", F.col("v").alias("w")), "i").where(pred(F.col("w")))
    return SparseVector(joined.select("i", (op(F.col("v"), F.col("w")) if op else F.col("v")).alias("v")), x.n)


def filter_by_value(x: SparseVector, selector: SparseVector, f: Op, by_index: bool = False) -> SparseVector:
    """Without entries whose f(v) is among the selector's values (or indices)."""
    s = selector.df.select(F.col("i" if by_index else "v").alias("_s")).distinct()
    return SparseVector(x.df.withColumn("_s", f(F.col("v"))).join(s, "_s", "left_anti"), x.n)


# elementwise

def ewise_dense(x: DenseVector, y: DenseVector, op: Op, do_op: Op | None = None) -> DenseVector:
    """op(x, y) at every index (where do_op holds, else x stays)."""
    joined = x.df.join(y.df.select("i", F.col("v").alias("w")), "i")
    v = op(F.col("v"), F.col("w"))
    return DenseVector(joined.select("i", (v if do_op is None else F.when(do_op(F.col("v"), F.col("w")), v).otherwise(F.col("v"))).alias("v")), x.n)


def ewise_dense_sparse(x: DenseVector, y: SparseVector, op: Op, null=None) -> DenseVector:
    """op(x, y) where y has an entry; with a null also elsewhere, the null standing in."""
    joined = x.df.join(y.df.select("i", F.col("v").alias("w"), F.lit(True).alias("there")), "i", "left")
    other = F.col("v") if null is None else op(F.col("v"), F.lit(null))
    return DenseVector(joined.select("i", F.when(F.col("there"), op(F.col("v"), F.col("w"))).otherwise(other).alias("v")), x.n)


def ewise_mult(x: SparseVector, d: DenseVector, exclude: bool = False, zero=0) -> SparseVector:
    """exclude: x's entries where d equals zero; else products where it doesn't."""
    joined = x.df.join(d.df.select("i", F.col("v").alias("w")), "i")
    df = joined.where(F.col("w") == zero).select("i", "v") if exclude else joined.where(F.col("w") != zero).select("i", (F.col("v") * F.col("w")).alias("v"))
    return SparseVector(df, x.n)


def ewise_apply(x: SparseVector, y: SparseVector, op: Op, x_null=None, y_null=None, intersect: bool = True, do_op: Op | None = None) -> SparseVector:
    """As the matrix operator of this name, over indices."""
    how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[x_null is not None, y_null is not None]
    joined = x.df.select("i", F.col("v").alias("x"), F.lit(True).alias("ax")).join(y.df.select("i", F.col("v").alias("y"), F.lit(True).alias("by")), "i", how)
    if not intersect:
        joined = joined.where("ax is null or by is null")
    a = F.col("x") if x_null is None else F.when(F.col("ax").isNull(), F.lit(x_null)).otherwise(F.col("x"))
    b = F.col("y") if y_null is None else F.when(F.col("by").isNull(), F.lit(y_null)).otherwise(F.col("y"))
    if do_op is not None:
        joined = joined.where(do_op(a, b))
    return SparseVector(joined.select("i", op(a, b).alias("v")), x.n)


def add(x: SparseVector, y: SparseVector) -> SparseVector:
    return x.with_df(x.df.unionByName(y.df).groupBy("i").agg(F.sum("v").alias("v")))


def subtract(x: SparseVector, y: SparseVector) -> SparseVector:
    return add(x, apply(y, lambda v: -v))


def setminus(x: SparseVector, y: SparseVector) -> SparseVector:
    return SparseVector(x.df.join(y.df.select("i"), "i", "left_anti"), x.n)


# scatter, gather and indexing

def overwrite(d: DenseVector, x: SparseVector) -> DenseVector:
    """d with x's entries put in."""
    return ewise_dense_sparse(d, x, lambda a, b: b)


def scatter(d: DenseVector, x: SparseVector, index: Op, value: Op, agg: Op = F.max) -> DenseVector:
    """d[index(v, i)] <- value(v, i); of several the largest (or another aggregate)."""
    moved = x.df.select(index(F.col("v"), F.col("i")).alias("i"), value(F.col("v"), F.col("i")).alias("v")).groupBy("i").agg(agg("v").alias("v"))
    return overwrite(d, SparseVector(moved, d.n))


def gather(d: DenseVector, x: SparseVector, index: Op, null) -> SparseVector:
    """res[i] = d[index(v, i)], null out of range."""
    keyed = x.df.select("i", index(F.col("v"), F.col("i")).alias("k"))
    return SparseVector(keyed.join(d.df.select(F.col("i").alias("k"), "v"), "k", "left").select("i", F.coalesce("v", F.lit(null)).alias("v")), x.n)


def index(x: SparseVector, at: DenseVector, default=0) -> DenseVector:
    """out[k] = x[at[k]]."""
    keyed = at.df.select("i", F.col("v").alias("k"))
    return DenseVector(keyed.join(x.df.select(F.col("i").alias("k"), "v"), "k", "left").select("i", F.coalesce("v", F.lit(default)).alias("v")), at.n)


def uniq(x: SparseVector) -> SparseVector:
    """One entry for each value: the smallest index."""
    return SparseVector(x.df.groupBy("v").agg(F.min("i").alias("i")), x.n)


def invert(x: SparseVector, n: int, index: Op | None = None, value: Op | None = None, agg: Op = F.min) -> SparseVector:
    """Indices and values swapped (or computed); repeats by an aggregate."""
    i = index(F.col("v"), F.col("i")) if index else F.col("v")
    v = value(F.col("v"), F.col("i")) if value else F.col("i")
    return SparseVector(x.df.select(i.alias("i"), v.alias("v")).groupBy("i").agg(agg("v").alias("v")), n)


def sort(x: SparseVector) -> DataFrame:
    """(i, v, position): values in ascending order (ties by index) and where each stood."""
    return _numbered(x.df, ["v", "i"], "k").select(F.col("k").alias("i"), "v", F.col("i").alias("position"))


# aggregates

def reduce(x: SparseVector, agg: Op, identity=None, unary: Op | None = None) -> DataFrame:
    v = agg(unary(F.col("v")) if unary else F.col("v"))
    return x.df.agg((v if identity is None else F.coalesce(v, F.lit(identity))).alias("v"))


def min_element(x: SparseVector) -> DataFrame:
    """One row (i, v): the smallest value and its smallest index."""
    return x.df.agg(F.min(F.struct("v", "i")).alias("m")).select("m.i", "m.v")
