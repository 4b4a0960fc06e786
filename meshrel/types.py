"""Matrices and vectors as DataFrames with their dimensions.

An index that has no row is structurally absent; a stored zero stays stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return df.select(*names)


@dataclass(frozen=True)
class Matrix:
    """Entries (i, j, v), each position once, of an nrow x ncol matrix."""

    df: DataFrame
    nrow: int
    ncol: int

    def __post_init__(self):
        object.__setattr__(self, "df", _columns(self.df, ("i", "j", "v")))
        if self.nrow < 0 or self.ncol < 0:
            raise ValueError("dimensions must not be negative")

    def with_df(self, df: DataFrame) -> Matrix:
        return Matrix(df, self.nrow, self.ncol)

    def nnz(self) -> int:
        return self.df.count()

    def check(self) -> Matrix:
        """Raises if an index is out of range or a position repeats."""
        i, j = F.col("i"), F.col("j")
        bad = self.df.where(i.isNull() | j.isNull() | (i < 0) | (i >= self.nrow) | (j < 0) | (j >= self.ncol))
        if not bad.isEmpty():
            raise ValueError("index out of range")
        if not self.df.groupBy("i", "j").count().where("count > 1").isEmpty():
            raise ValueError("repeated position")
        return self


@dataclass(frozen=True)
class SparseVector:
    """Entries (i, v), each index at most once, of a vector of length n."""

    df: DataFrame
    n: int

    def __post_init__(self):
        object.__setattr__(self, "df", _columns(self.df, ("i", "v")))

    def with_df(self, df: DataFrame) -> SparseVector:
        return type(self)(df, self.n)


@dataclass(frozen=True)
class DenseVector(SparseVector):
    """Entries (i, v) for every index 0 .. n - 1."""


def same_shape(a: Matrix, b: Matrix) -> None:
    if (a.nrow, a.ncol) != (b.nrow, b.ncol):
        raise ValueError(f"shapes differ: {a.nrow} x {a.ncol} and {b.nrow} x {b.ncol}")
