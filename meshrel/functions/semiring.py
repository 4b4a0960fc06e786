"""Semirings as Column functions: multiply two values, aggregate the products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """add: an aggregate over products (it must also combine partial results);
    multiply: of a left and a right value; identity: the value of an empty sum in dense
    results; keep: products for which it is false are discarded before they are added."""

    name: str
    add: Callable[[Column], Column]
    multiply: Callable[[Column, Column], Column]
    identity: Any = None
    keep: Callable[[Column, Column], Column] | None = None

    def where(self, keep: Callable[[Column, Column], Column]) -> Semiring:
        return Semiring(f"{self.name}_where", self.add, self.multiply, self.identity, keep)


def _second(a: Column, b: Column) -> Column:
    return b


def saturating_add(top: int = 2**63 - 1) -> Callable[[Column, Column], Column]:
    """Sum in which ``top`` stands for infinity."""
    return lambda a, b: F.when((a == top) | (b == top) | (a > F.lit(top) - b), F.lit(top)).otherwise(a + b)


PLUS_TIMES = Semiring("plus_times", F.sum, lambda a, b: a * b, 0)
MIN_PLUS = Semiring("min_plus", F.min, saturating_add(), 2**63 - 1)
MIN_PLUS_DOUBLE = Semiring("min_plus_double", F.min, lambda a, b: a + b, float("inf"))
SELECT_MAX = Semiring("select_max", F.max, lambda a, b: a * b, -1)
SELECT_MAX_SECOND = Semiring("select_max_second", F.max, _second, -1)
SELECT_SECOND = Semiring("select_second", F.max, _second, 0)  # any value will do: the largest is taken
SELECT_SECOND_MIN = Semiring("select_second_min", F.min, _second, None)
SELECT_MIN = Semiring("select_min", F.min, _second, -1)
COUNT = Semiring("count", F.sum, lambda a, b: F.lit(1).cast("long"), 0)
OR_AND = Semiring("or_and", F.bool_or, lambda a, b: a & b, False)
COPY_FIRST = Semiring("copy_first", F.max, lambda a, b: a, None)
COPY_SECOND = Semiring("copy_second", F.max, _second, None)


def max_weight(*fields: str) -> Semiring:
    """Largest struct (weight first, then the named fields of the right value)."""
    return Semiring("max_weight", F.max, lambda a, b: F.struct(a.alias("w"), *(b[f].alias(f) for f in fields)), None)


def top_two() -> Semiring:
    """Best profit w - price with its object, and the second best profit."""

    def add(c: Column) -> Column:
        best = F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 2)
        return F.struct(best[0]["p"].alias("p"), best[0]["obj"].alias("obj"), F.get(best, F.lit(1))["p"].alias("second"))

    return Semiring("top_two", add, lambda a, b: F.struct((a - b["price"]).alias("p"), b["obj"].alias("obj")), None)


def select_random(seed: int) -> Semiring:
    """One of the right values, drawn by a hash."""
    return Semiring("select_random", lambda c: F.min(c), lambda a, b: F.struct(F.xxhash64(F.lit(seed), b).alias("r"), b.alias("v")), None)


#: Unary and binary functors over Columns.
FUNCTORS: dict[str, Callable[..., Column]] = {
    "identity": lambda a: a,
    "set": lambda value: F.lit(value),
    "inverse": lambda a: F.when(a == 0, F.lit(1.7976931348623157e308)).otherwise(1 / a),
    "second": _second,
    "power": lambda a, e: F.pow(a, e),
    "maximum": lambda a, b: F.greatest(a, b),
    "minimum": lambda a, b: F.least(a, b),
    "set_if_not_equal": lambda a, b: F.when(a != b, b).otherwise(a),
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "logical_xor": lambda a, b: a != b,
    "absolute_difference": lambda a, b: F.abs(a - b),
}
