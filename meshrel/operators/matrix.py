"""Operators on matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from ..types import DenseVector, Matrix, SparseVector, same_shape

Op = Callable[..., Column]
ROW, COLUMN = "row", "column"


def _axis(dim: str) -> str:
    if dim not in (ROW, COLUMN):
        raise ValueError("dim must be 'row' or 'column'")
    return "i" if dim == ROW else "j"


# projections

def apply(a: Matrix, f: Op) -> Matrix:
    return a.with_df(a.df.withColumn("v", f(F.col("v"))))


def transpose(a: Matrix) -> Matrix:
    return Matrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.ncol, a.nrow)


def dim_apply(a: Matrix, dim: str, x: SparseVector, op: Op) -> Matrix:
    """v <- op(v, x of its row or column); entries without one go."""
    k = _axis(dim)
    y = x.df.select(F.col("i").alias(k), F.col("v").alias("x"))
    return a.with_df(a.df.join(y, k).select("i", "j", op(F.col("v"), F.col("x")).alias("v")))


def scale_dense(a: Matrix, d: Matrix) -> Matrix:
    """v <- v * D(i, j)."""
    return ewise_apply(a, d, lambda x, y: x * y)


def update_dense(d: Matrix, a: Matrix, op: Op) -> Matrix:
    """D <- op(D, A) where A has an entry."""
    same_shape(d, a)
    other = a.df.select("i", "j", F.col("v").alias("w"), F.lit(True).alias("there"))
    return d.with_df(d.df.join(other, ["i", "j"], "left").select("i", "j", F.when(F.col("there"), op(F.col("v"), F.col("w"))).otherwise(F.col("v")).alias("v")))


def add_loops(a: Matrix, value, replace: bool = False) -> Matrix:
    """A value (or a vector's values) on every missing diagonal position, or on all with replace."""
    n = min(a.nrow, a.ncol)
    kind = a.df.schema["v"].dataType
    if isinstance(value, SparseVector):
        loops = value.df.where(F.col("i") < n).select("i", F.col("i").alias("j"), F.col("v").cast(kind).alias("v"))
    else:
        loops = a.df.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).cast(kind).alias("v"))
    kept = a.df.join(loops.select("i", "j"), ["i", "j"], "left_anti") if replace else a.df
    fresh = loops if replace else loops.join(a.df.where("i = j").select("i", "j"), ["i", "j"], "left_anti")
    return a.with_df(kept.unionByName(fresh))


def symmetrise(a: Matrix, agg: Op = F.sum) -> Matrix:
    """A + transpose(A): union of the patterns, aggregated where both have an entry."""
    return a.with_df(a.df.unionByName(transpose(a).df).groupBy("i", "j").agg(agg("v").alias("v")))


# filters

def prune(a: Matrix, pred: Op) -> Matrix:
    """Without the entries whose value satisfies pred."""
    return a.with_df(a.df.where(~pred(F.col("v"))))


def prune_i(a: Matrix, pred: Op) -> Matrix:
    """Without the entries for which pred(i, j, v)."""
    return a.with_df(a.df.where(~pred(F.col("i"), F.col("j"), F.col("v"))))


def _listed(x: SparseVector, name: str, by_value: bool = True) -> DataFrame:
    return x.df.select(F.col("v" if by_value else "i").alias(name)).distinct()


def prune_both(a: Matrix, rows: SparseVector, cols: SparseVector) -> Matrix:
    """Without entries whose row is among the first vector's values and column among the second's."""
    flagged = a.df.join(_listed(rows, "i").withColumn("r", F.lit(True)), "i", "left").join(_listed(cols, "j").withColumn("c", F.lit(True)), "j", "left")
    return a.with_df(flagged.where("r is null or c is null"))


def prune_either(a: Matrix, rows: SparseVector, cols: SparseVector) -> Matrix:
    """Without entries whose row or column is listed."""
    return a.with_df(a.df.join(_listed(rows, "i"), "i", "left_anti").join(_listed(cols, "j"), "j", "left_anti"))


def prune_column(a: Matrix, x: SparseVector, op: Op) -> Matrix:
    """Without entries for which op(v, x(j)); columns that x lacks stay whole."""
    y = x.df.select(F.col("i").alias("j"), F.col("v").alias("x"), F.lit(True).alias("there"))
    return a.with_df(a.df.join(y, "j", "left").where(F.col("there").isNull() | ~op(F.col("v"), F.col("x"))))


def prune_columns_listed(a: Matrix, x: SparseVector) -> Matrix:
    """Without the columns that x has an entry for."""
    return a.with_df(a.df.join(_listed(x, "j", by_value=False), "j", "left_anti"))


def remove_loops(a: Matrix) -> Matrix:
    return a.with_df(a.df.where("i <> j"))


# elementwise

def ewise_mult(a: Matrix, b: Matrix, exclude: bool = False) -> Matrix:
    """Products where both have an entry, or a's entries where b has none."""
    return set_difference(a, b) if exclude else ewise_apply(a, b, lambda x, y: x * y)


def set_difference(a: Matrix, b: Matrix) -> Matrix:
    same_shape(a, b)
    return a.with_df(a.df.join(b.df.select("i", "j"), ["i", "j"], "left_anti"))


def ewise_apply(a: Matrix, b: Matrix, op: Op, a_null=None, b_null=None, intersect: bool = True, do_op: Op | None = None) -> Matrix:
    """op over positions that both have; with a_null (b_null) also those that a (b) lacks, the null standing in.

    intersect=False leaves out positions that both have; do_op(x, y) must hold for a result.
    """
    same_shape(a, b)
    how = {(False, False): "inner", (False, True): "left", (True, False): "right", (True, True): "full"}[a_null is not None, b_null is not None]
    left = a.df.select("i", "j", F.col("v").alias("x"), F.lit(True).alias("ax"))
    right = b.df.select("i", "j", F.col("v").alias("y"), F.lit(True).alias("by"))
    joined = left.join(right, ["i", "j"], how)
    if not intersect:
        joined = joined.where("ax is null or by is null")
    x = F.col("x") if a_null is None else F.when(F.col("ax").isNull(), F.lit(a_null)).otherwise(F.col("x"))
    y = F.col("y") if b_null is None else F.when(F.col("by").isNull(), F.lit(b_null)).otherwise(F.col("y"))
    if do_op is not None:
        joined = joined.where(do_op(x, y))
    return a.with_df(joined.select("i", "j", op(x, y).alias("v")))


def add(a: Matrix, b: Matrix, agg: Op = F.sum) -> Matrix:
    same_shape(a, b)
    return a.with_df(a.df.unionByName(b.df).groupBy("i", "j").agg(agg("v").alias("v")))


# aggregates

def reduce(a: Matrix, dim: str, agg: Op, identity=None, unary: Op | None = None, dense: bool = True) -> SparseVector:
    """Aggregate of each row (dim 'row') or column; empty ones hold the identity in a dense result."""
    k = _axis(dim)
    v = unary(F.col("v")) if unary else F.col("v")
    n = a.nrow if dim == ROW else a.ncol
    y = a.df.groupBy(F.col(k).alias("i")).agg(agg(v).alias("v"))
    if not dense:
        return SparseVector(y, n)
    every = a.df.sparkSession.range(n).select(F.col("id").alias("i"))
    return DenseVector(every.join(y, "i", "left").select("i", (F.col("v") if identity is None else F.coalesce("v", F.lit(identity))).alias("v")), n)


def masked_reduce(a: Matrix, mask: SparseVector, agg: Op, identity=None, unary: Op | None = None, exclude: bool = False) -> SparseVector:
    """Column aggregates over the rows that the mask has an entry for (or has none, with exclude)."""
    rows = _listed(mask, "i", by_value=False)
    return reduce(a.with_df(a.df.join(rows, "i", "left_anti" if exclude else "left_semi")), COLUMN, agg, identity, unary)


def merge_duplicates(df: DataFrame, nrow: int, ncol: int, agg: Op = F.sum) -> Matrix:
    return Matrix(df.groupBy("i", "j").agg(agg("v").alias("v")), nrow, ncol)


def bandwidth(a: Matrix) -> DataFrame:
    """One row: the largest j - i on and above the diagonal, -1 if nothing is there."""
    return a.df.where("i <= j").agg(F.coalesce(F.max(F.col("j") - F.col("i")), F.lit(-1)).alias("bandwidth"))


def profile(a: Matrix) -> DataFrame:
    """One row: sum over columns of j - smallest i <= j; a column without one counts 1."""
    per = a.df.where("i <= j").groupBy("j").agg((F.col("j") - F.min("i")).alias("d"))
    return per.agg((F.coalesce(F.sum("d"), F.lit(0)) + F.lit(a.ncol) - F.count("*")).alias("profile"))


def load_imbalance(a: Matrix) -> float:
    """Most entries in a partition over the mean of those with entries; 1 if there is none."""
    r = a.df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.avg("count")).collect()[0]
    return 1.0 if not r[1] else r[0] / r[1]


def equal(a: Matrix, b: Matrix, epsilon: float = 0.01) -> bool:
    """Same pattern and values that agree absolutely or relatively within epsilon."""
    if (a.nrow, a.ncol) != (b.nrow, b.ncol):
        return False
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    near = (x == y) | (F.abs(x - y) < epsilon) | (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)) < epsilon)
    left, right = a.df.select("i", "j", F.col("v").alias("x")), b.df.select("i", "j", F.col("v").alias("y"))
    return left.join(right, ["i", "j"], "full").where(F.col("x").isNull() | F.col("y").isNull() | ~near).isEmpty()


# ranking

def kselect(a: Matrix, k: int, empty=2.2250738585072014e-308, only: SparseVector | None = None) -> SparseVector:
    """k-th largest value of each column. Dense: columns with fewer entries hold ``empty``.

    With ``only`` (sparse form) the listed columns alone, those with fewer
    entries giving their smallest, those with none ``empty``.
    """
    df = a.df if only is None else a.df.join(_listed(only, "j", by_value=False), "j", "left_semi")
    w = Window.partitionBy("j").orderBy(F.desc("v"))
    ranked = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    y = ranked.groupBy(F.col("j").alias("i")).agg(F.min("v").alias("v"), F.max("r").alias("r"))
    if only is not None:
        every = _listed(only, "i", by_value=False)
        return SparseVector(every.join(y, "i", "left").select("i", F.coalesce("v", F.lit(empty)).alias("v")), a.ncol)
    every = a.df.sparkSession.range(a.ncol).select(F.col("id").alias("i"))
    return DenseVector(every.join(y.where(F.col("r") == k), "i", "left").select("i", F.coalesce("v", F.lit(empty)).alias("v")), a.ncol)


def prune_recover_select(a: Matrix, hard: float, select: int, recover: int, percent: float) -> Matrix:
    """Column pruning for Markov clustering: cut-off, recovery of light columns, selection in heavy ones, second recovery.

    Ties at a threshold stay. All thresholds come from two windows over one partitioning by column.
    """
    by = Window.partitionBy("j")
    ranked = a.df.withColumn("r", F.row_number().over(by.orderBy(F.desc("v"))))
    kept = F.col("v") > hard
    stat = ranked.withColumns({
        "n": F.count("*").over(by),
        "kn": F.count(F.when(kept, 1)).over(by),
        "ks": F.sum(F.when(kept, F.col("v")).otherwise(0)).over(by),
        "vr": F.max(F.when(F.col("r") == recover, F.col("v"))).over(by),
        "vs": F.max(F.when(F.col("r") == select, F.col("v"))).over(by),
        "vmin": F.min("v").over(by),
    })
    at_recover = F.coalesce("vr", "vmin")
    light = (F.col("kn") < recover) & (F.col("n") > F.col("kn")) & (F.col("ks") < percent)
    heavy = ~light & (F.col("kn") > select)
    stat = stat.withColumn("ss", F.sum(F.when(F.col("v") >= F.col("vs"), F.col("v")).otherwise(0)).over(by))
    threshold = F.when(light, at_recover).when(heavy & (F.col("ss") < percent) & (F.lit(select) < recover), at_recover).when(heavy, F.col("vs")).otherwise(F.lit(hard))
    return a.with_df(stat.where(F.col("v") >= threshold))


# indexing

def spref(a: Matrix, rows: SparseVector | None = None, cols: SparseVector | None = None) -> Matrix:
    """C(p, q) = A(rows[p], cols[q]); None takes a side as it is, repeats are repeated."""
    df, nrow, ncol = a.df, a.nrow, a.ncol
    if rows is not None:
        df = df.join(rows.df.select(F.col("v").alias("i"), F.col("i").alias("p")), "i").select(F.col("p").alias("i"), "j", "v")
        nrow = rows.n
    if cols is not None:
        df = df.join(cols.df.select(F.col("v").alias("j"), F.col("i").alias("q")), "j").select("i", F.col("q").alias("j"), "v")
        ncol = cols.n
    return Matrix(df, nrow, ncol)


def spasgn(a: Matrix, rows: SparseVector, cols: SparseVector, b: Matrix) -> Matrix:
    """A with A(rows, cols) replaced by B."""
    if (b.nrow, b.ncol) != (rows.n, cols.n):
        raise ValueError("the block's shape differs from the index vectors")
    moved = b.df.join(rows.df.select(F.col("i"), F.col("v").alias("p")), "i").join(cols.df.select(F.col("i").alias("j"), F.col("v").alias("q")), "j")
    return a.with_df(prune_both(a, rows, cols).df.unionByName(moved.select(F.col("p").alias("i"), F.col("q").alias("j"), "v")))


def sparse(rows: SparseVector, cols: SparseVector, vals, nrow: int, ncol: int, sum_duplicates: bool = True) -> Matrix:
    """Matrix from three vectors (or a scalar value); repeats are summed, else the largest stays."""
    df = rows.df.select(F.col("i").alias("k"), F.col("v").alias("i")).join(cols.df.select(F.col("i").alias("k"), F.col("v").alias("j")), "k")
    df = df.join(vals.df.select(F.col("i").alias("k"), "v"), "k") if isinstance(vals, SparseVector) else df.withColumn("v", F.lit(vals))
    return merge_duplicates(df, nrow, ncol, F.sum if sum_duplicates else F.max)


def find(a: Matrix) -> DataFrame:
    """Triples numbered by column, then row: (k, i, j, v)."""
    return _numbered(a.df, ["j", "i"], "k").select("k", "i", "j", "v")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in an order, by range partitions and their sizes: no task sees all rows.

    The partitioned rows are written once, each with its partition: bounds are
    sampled and partitions coalesced anew for every plan, so sizes counted in one
    and rows numbered in another would not agree.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    # a row for each partition
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    local = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return local.join(F.broadcast(bases), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def block_split(a: Matrix, row_blocks: int, col_blocks: int) -> list[list[Matrix]]:
    rs, cs = -(-a.nrow // row_blocks), -(-a.ncol // col_blocks)
    out = []
    for r in range(row_blocks):
        out.append([])
        for c in range(col_blocks):
            df = a.df.where((F.col("i") >= r * rs) & (F.col("i") < (r + 1) * rs) & (F.col("j") >= c * cs) & (F.col("j") < (c + 1) * cs))
            out[-1].append(Matrix(df.select((F.col("i") - r * rs).alias("i"), (F.col("j") - c * cs).alias("j"), "v"), max(0, min(rs, a.nrow - r * rs)), max(0, min(cs, a.ncol - c * cs))))
    return out


def from_edges(edges: DataFrame, n: int, remove_loops: bool = False) -> Matrix:
    """Matrix of an edge list (src, dst): repeats are counted."""
    e = edges.where("src <> dst") if remove_loops else edges
    return Matrix(e.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.count("*").alias("v")), n, n)


def induced_subgraphs(a: Matrix, part: SparseVector) -> DataFrame:
    """(part, i, j, v): the entries whose ends lie in one part."""
    p = part.df.select(F.col("i"), F.col("v").alias("part"))
    return a.df.join(p, "i").join(p.select(F.col("i").alias("j"), F.col("part").alias("other")), "j").where("part = other").select("part", "i", "j", "v")


def last_row_of_columns(a: Matrix) -> DenseVector:
    """Largest row index of each column, -1 where empty."""
    return reduce(a.with_df(a.df.withColumn("v", F.col("i"))), COLUMN, F.max, -1)


def split_columns(a: Matrix, parts: int) -> list[Matrix]:
    return block_split(a, 1, parts)[0]


def concatenate_columns(blocks: list[Matrix]) -> Matrix:
    out, offset = None, 0
    for b in blocks:
        moved = b.df.select("i", (F.col("j") + offset).alias("j"), "v")
        out = moved if out is None else out.unionByName(moved)
        offset += b.ncol
    return Matrix(out, blocks[0].nrow, offset)
