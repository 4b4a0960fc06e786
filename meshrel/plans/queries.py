"""One registered query for each operator, over whole tables, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semiring as S
from ..operators import graph as G
from ..operators import matrix as M
from ..operators import products as P
from ..operators import vector as V
from ..sources import generate
from ..types import DenseVector, Matrix, SparseVector
from .inputs import SQL, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "", recursive: bool = False):
    """Registers a function of Inputs; uses names the common table expressions that its SQL needs."""

    def register(f: Callable[[Inputs], DataFrame | Matrix | SparseVector]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Inputs(spark, sf_dir))
            return out.df if isinstance(out, Matrix | SparseVector) else out

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            parts = [f"{u} AS ({SQL[u]})" for u in uses.split()]
            head, body = "", sql.strip()
            if body.upper().startswith("WITH "):
                body = body[5:]
                parts.append(body)
                head = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts)
            else:
                head = (f"WITH {', '.join(parts)} " if parts else "") + body
            ORACLES[f.__name__] = head
        return f

    return register


_SUPP = "(SELECT max(s_suppkey) + 1 FROM supplier)"
_PART = "(SELECT max(p_partkey) + 1 FROM part)"


# products and semirings

@query("SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_op a JOIN m_op b ON a.i = b.i GROUP BY 1, 2", "m_op")
def spgemm_copurchase(t):
    a = t.order_part()
    return P.spgemm(a, a, left_transposed=True)


@query("SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_sp a JOIN m_rs b ON a.j = b.j GROUP BY 1, 2", "m_sp m_rs")
def spgemm_right_transposed(t):
    return P.spgemm(t.supplier_part(), t.supplier_part("R"), right_transposed=True)


@query("SELECT a.i, b.j, min(a.v + b.v) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_min_plus(t):
    a = t.nations()
    return P.square(a, S.MIN_PLUS)


@query("SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_square(t):
    return P.square(t.nations())


@query("SELECT a.i, b.j, max(a.v * b.v) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_select_max(t):
    return P.square(t.nations(), S.SELECT_MAX)


@query("SELECT a.i, b.j, min(b.v) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_select_second_min(t):
    return P.square(t.nations(), S.SELECT_SECOND_MIN)


@query("SELECT a.i, b.j, count(*) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_count(t):
    return P.square(t.nations(), S.COUNT)


@query("SELECT a.i, b.j, bool_or(a.v > 60 AND b.v > 60) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def spgemm_or_and(t):
    return P.square(M.apply(t.nations(), lambda v: v > 60), S.OR_AND)


@query("SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i WHERE a.v % 2 = 0 AND b.v > 50 GROUP BY 1, 2", "m_nat")
def spgemm_filtered(t):
    return P.square(t.nations(), S.PLUS_TIMES.where(lambda a, b: (a % 2 == 0) & (b > 50)))


@query("SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_op a JOIN m_op b ON a.i = b.i GROUP BY 1, 2", "m_op")
def spgemm_layered(t):
    a = t.order_part()
    return P.spgemm_layered(M.transpose(a), a, 4)


@query("SELECT i, j, v FROM (SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2) WHERE v > 100000", "m_nat")
def spgemm_phased(t):
    a = t.nations()
    return P.spgemm_phased(a, a, 3, lambda m: M.prune(m, lambda v: v <= 100000))


@query("SELECT CAST(floor(a.i / 13) AS BIGINT) AS rb, CAST(floor(b.j / 13) AS BIGINT) AS cb, CAST(sum(a.v * b.v) AS BIGINT) AS total FROM m_nat a JOIN m_nat b ON a.j = b.i GROUP BY 1, 2", "m_nat")
def block_spgemm(t):
    a = t.nations()
    rows = [b.df.groupBy().agg(F.lit(r).cast("long").alias("rb"), F.lit(c).cast("long").alias("cb"), F.sum("v").alias("total")) for r, c, _, _, b in P.block_spgemm(a, a, 2, 2)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"SELECT g.i, coalesce(y.v, 0) AS v FROM (SELECT unnest(range({_SUPP})) AS i) g LEFT JOIN (SELECT m.i, CAST(sum(m.v * x.v) AS BIGINT) AS v FROM m_sp m JOIN x_part x ON m.j = x.i GROUP BY 1) y ON g.i = y.i", "m_sp x_part")
def spmv_dense(t):
    return P.spmv(t.supplier_part(), V.to_dense(t.part_sizes()))


@query("SELECT m.j AS i, max(x.v) AS v FROM m_sp m JOIN x_pos x ON m.i = x.i GROUP BY 1", "m_sp x_pos")
def spmv_sparse(t):
    return P.spmv_sparse(M.transpose(t.supplier_part()), t.balances(True), S.SELECT_MAX_SECOND)


@query("SELECT m.j AS i, max(m.i) AS v FROM m_sp m JOIN x_pos x ON m.i = x.i GROUP BY 1", "m_sp x_pos")
def spmv_index_is_value(t):
    return P.spmv_sparse(M.transpose(t.supplier_part()), t.balances(True), S.SELECT_MAX_SECOND, index_is_value=True)


@query("SELECT CAST(sum(x.n * x.n) AS BIGINT) AS flops FROM (SELECT i, count(*) AS n FROM m_op GROUP BY 1) x", "m_op")
def flops(t):
    a = t.order_part()
    return P.flops(M.transpose(a), a)


@query()
def nnz_sampled(t):
    a = t.order_part()
    return P.nnz_sampled(M.transpose(a), a)


@query("SELECT count(*) AS nnz FROM (SELECT DISTINCT a.j, b.j FROM m_op a JOIN m_op b ON a.i = b.i)", "m_op")
def nnz_exact(t):
    a = t.order_part()
    return P.nnz_estimate(M.transpose(a), a, exact=True)


@query("SELECT x.i, y.j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m_rs a JOIN m_sp b ON a.j = b.j GROUP BY 1, 2) x JOIN m_rs y ON x.j = y.i GROUP BY 1, 2", "m_sp m_rs")
def galerkin(t):
    r = t.supplier_part("R")
    return G.galerkin(M.transpose(t.supplier_part()), r, r)


# projections

@query("SELECT i, j, v * v + 1 AS v FROM m_sp", "m_sp")
def matrix_apply(t):
    return M.apply(t.supplier_part(), lambda v: v * v + 1)


@query("SELECT j AS i, i AS j, v FROM m_sp", "m_sp")
def transpose(t):
    return M.transpose(t.supplier_part())


@query("SELECT m.i, m.j, m.v * x.v AS v FROM m_sp m JOIN x_part x ON m.j = x.i", "m_sp x_part")
def dim_apply_column(t):
    return M.dim_apply(t.supplier_part(), M.COLUMN, t.part_sizes(), lambda a, b: a * b)


@query("SELECT m.i, m.j, m.v - x.v AS v FROM m_sp m JOIN x_supp x ON m.i = x.i", "m_sp x_supp")
def dim_apply_row(t):
    return M.dim_apply(t.supplier_part(), M.ROW, t.balances(), lambda a, b: a - b)


@query(f"SELECT i, j, v FROM g_cp2 UNION ALL SELECT i, i, 1 FROM (SELECT unnest(range({_PART})) AS i)", "g_cp2")
def add_loops(t):
    return M.add_loops(t.copurchase(), 1)


@query("SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM m_nat UNION ALL SELECT j, i, v FROM m_nat) GROUP BY 1, 2", "m_nat")
def symmetrise(t):
    return M.symmetrise(t.nations())


@query("SELECT a.i, a.j, CASE WHEN b.v IS NULL THEN a.v ELSE a.v - b.v END AS v FROM m_sp a LEFT JOIN m_rs b ON a.i = b.i AND a.j = b.j", "m_sp m_rs")
def update_dense(t):
    return M.update_dense(t.supplier_part(), t.supplier_part("R"), lambda a, b: a - b)


@query("SELECT i, v * 2 + i AS v FROM x_supp", "x_supp")
def vector_apply_indexed(t):
    return V.apply_indexed(t.balances(), lambda v, i: v * 2 + i)


@query("SELECT a.i, CASE WHEN b.i IS NULL THEN a.v ELSE -a.v END AS v FROM x_supp a LEFT JOIN x_pos b ON a.i = b.i", "x_supp x_pos")
def vector_apply_masked(t):
    return V.apply(t.balances(), lambda v: -v, t.balances(True))


# filters

@query("SELECT i, j, v FROM m_sp WHERE NOT v < 40", "m_sp")
def prune(t):
    return M.prune(t.supplier_part(), lambda v: v < 40)


@query("SELECT i, j, v FROM m_sp WHERE NOT (i + j) % 3 = 0", "m_sp")
def prune_indexed(t):
    return M.prune_i(t.supplier_part(), lambda i, j, v: (i + j) % 3 == 0)


_EVEN = "(SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"
_THIRD = "(SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)"


def _even_suppliers(t) -> SparseVector:
    s = t.table("supplier").where("s_suppkey % 2 = 0")
    return SparseVector(s.select((F.col("s_suppkey") / 2).cast("long").alias("i"), F.col("s_suppkey").alias("v")), t.suppliers // 2 + 1)


@query(f"SELECT i, j, v FROM m_sp WHERE NOT (i IN {_EVEN} AND j IN {_THIRD})", "m_sp")
def prune_rows_and_columns(t):
    return M.prune_both(t.supplier_part(), _even_suppliers(t), t.low_parts(3))


@query(f"SELECT i, j, v FROM m_sp WHERE NOT (i IN {_EVEN} OR j IN {_THIRD})", "m_sp")
def prune_rows_or_columns(t):
    return M.prune_either(t.supplier_part(), _even_suppliers(t), t.low_parts(3))


@query("SELECT m.i, m.j, m.v FROM m_sp m LEFT JOIN x_part x ON m.j = x.i WHERE x.v IS NULL OR NOT m.v < x.v", "m_sp x_part")
def prune_column(t):
    return M.prune_column(t.supplier_part(), t.part_sizes(), lambda v, x: v < x)


@query("SELECT m.i, m.j, m.v FROM m_sp m LEFT JOIN (SELECT i, v FROM x_part WHERE v > 25) x ON m.j = x.i WHERE x.v IS NULL OR NOT m.v < x.v", "m_sp x_part")
def prune_column_sparse(t):
    x = t.part_sizes()
    return M.prune_column(t.supplier_part(), V.find(x, lambda v: v > 25), lambda v, y: v < y)


@query("SELECT i, j, v FROM m_sp WHERE j NOT IN (SELECT i FROM x_part WHERE v > 25)", "m_sp x_part")
def prune_columns_listed(t):
    return M.prune_columns_listed(t.supplier_part(), V.find(t.part_sizes(), lambda v: v > 25))


@query("SELECT i, j, v FROM m_nat WHERE i <> j", "m_nat")
def remove_loops(t):
    return M.remove_loops(t.nations())


@query("SELECT row_number() OVER (ORDER BY i) - 1 AS i, i AS v FROM x_supp WHERE v > 5000", "x_supp")
def find_indices(t):
    return V.find_indices(t.balances(), lambda v: v > 5000)


@query("SELECT row_number() OVER (ORDER BY i) - 1 AS i, v FROM x_supp WHERE v > 5000", "x_supp")
def find_values(t):
    return V.find_values(t.balances(), lambda v: v > 5000)


@query("SELECT count(*) AS n FROM x_part WHERE v > 25", "x_part")
def count_matching(t):
    return V.count(t.part_sizes(), lambda v: v > 25)


@query("SELECT x.i, x.v FROM x_pos x JOIN x_supp d ON x.i = d.i WHERE d.v % 2 = 0", "x_pos x_supp")
def vector_select(t):
    return V.select(t.balances(True), t.dense_balances(), lambda d: d % 2 == 0)


@query("SELECT x.i, x.v + d.v AS v FROM x_pos x JOIN x_supp d ON x.i = d.i WHERE d.v % 2 = 0", "x_pos x_supp")
def vector_select_apply(t):
    return V.select(t.balances(True), t.dense_balances(), lambda d: d % 2 == 0, lambda a, b: a + b)


@query("SELECT i, v FROM x_part WHERE v % 10 NOT IN (SELECT v % 7 FROM x_supp)", "x_part x_supp")
def filter_by_value(t):
    return V.filter_by_value(t.part_sizes(), V.apply(t.balances(), lambda v: v % 7), lambda v: v % 10)


@query("SELECT l_partkey AS i, max(x.v) AS v FROM lineitem JOIN x_pos x ON l_suppkey = x.i WHERE l_returnflag = 'R' GROUP BY 1", "x_pos")
def filtered_traversal(t):
    return P.spmv_sparse(M.transpose(t.supplier_part("R")), t.balances(True), S.SELECT_MAX_SECOND)


# elementwise and set operations

@query("SELECT a.i, a.j, a.v * b.v AS v FROM m_sp a JOIN m_rs b ON a.i = b.i AND a.j = b.j", "m_sp m_rs")
def ewise_mult(t):
    return M.ewise_mult(t.supplier_part(), t.supplier_part("R"))


@query("SELECT i, j, v FROM m_sp WHERE (i, j) NOT IN (SELECT (i, j) FROM m_rs)", "m_sp m_rs")
def set_difference(t):
    return M.set_difference(t.supplier_part(), t.supplier_part("R"))


@query("SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, -1) - coalesce(b.v, 0) AS v FROM m_sp a FULL JOIN (SELECT j % 100 AS i, j, max(v) AS v FROM m_rs GROUP BY 1, 2) b ON a.i = b.i AND a.j = b.j", "m_sp m_rs")
def ewise_apply_full(t):
    a = t.supplier_part()
    b = t.supplier_part("R").df.groupBy((F.col("j") % 100).alias("i"), "j").agg(F.max("v").alias("v"))
    return M.ewise_apply(a, a.with_df(b), lambda x, y: x - y, a_null=-1, b_null=0)


@query("SELECT a.i, a.j, a.v - coalesce(b.v, 7) AS v FROM m_sp a LEFT JOIN m_rs b ON a.i = b.i AND a.j = b.j", "m_sp m_rs")
def ewise_apply_left(t):
    return M.ewise_apply(t.supplier_part(), t.supplier_part("R"), lambda x, y: x - y, b_null=7)


@query("SELECT a.i, a.j, a.v + 7 AS v FROM m_sp a LEFT JOIN m_rs b ON a.i = b.i AND a.j = b.j WHERE b.v IS NULL", "m_sp m_rs")
def ewise_apply_not(t):
    return M.ewise_apply(t.supplier_part(), t.supplier_part("R"), lambda x, y: x + y, b_null=7, intersect=False)


@query("SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM m_sp UNION ALL SELECT * FROM m_rs) GROUP BY 1, 2", "m_sp m_rs")
def matrix_add(t):
    return M.add(t.supplier_part(), t.supplier_part("R"))


@query("SELECT x.i, x.v * d.v AS v FROM x_pos x JOIN x_supp d ON x.i = d.i WHERE d.v <> 0", "x_pos x_supp")
def vector_ewise_mult(t):
    return V.ewise_mult(t.balances(True), t.dense_balances())


@query("SELECT x.i, x.v FROM x_part x WHERE x.v % 3 = 0", "x_part")
def vector_exclude(t):
    x = t.part_sizes()
    return V.ewise_mult(x, V.to_dense(V.apply(x, lambda v: v % 3)), exclude=True)


@query("SELECT coalesce(a.i, b.i) AS i, coalesce(a.v, 0) - coalesce(b.v, 1) AS v FROM x_pos a FULL JOIN x_part b ON a.i = b.i", "x_pos x_part")
def vector_ewise_full(t):
    return V.ewise_apply(t.balances(True), t.part_sizes(), lambda a, b: a - b, x_null=0, y_null=1)


@query(f"SELECT g.i, CASE WHEN x.v IS NULL THEN coalesce(d.v, 0) ELSE coalesce(d.v, 0) + x.v END AS v FROM (SELECT unnest(range({_SUPP})) AS i) g LEFT JOIN x_supp d ON g.i = d.i LEFT JOIN x_pos x ON g.i = x.i", "x_supp x_pos")
def dense_plus_sparse(t):
    return V.ewise_dense_sparse(t.dense_balances(), t.balances(True), lambda a, b: a + b)


@query("SELECT i, v FROM x_supp WHERE i NOT IN (SELECT i FROM x_pos)", "x_supp x_pos")
def vector_setminus(t):
    return V.setminus(t.balances(), t.balances(True))


@query("SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, v FROM x_pos UNION ALL SELECT i, -v FROM x_part) GROUP BY 1", "x_pos x_part")
def vector_subtract(t):
    return V.subtract(t.balances(True), t.part_sizes())


# aggregates

@query(f"SELECT g.i, coalesce(y.v, 0) AS v FROM (SELECT unnest(range({_PART})) AS i) g LEFT JOIN (SELECT j AS i, CAST(sum(v) AS BIGINT) AS v FROM m_sp GROUP BY 1) y ON g.i = y.i", "m_sp")
def reduce_columns(t):
    return M.reduce(t.supplier_part(), M.COLUMN, F.sum, 0)


@query(f"SELECT g.i, coalesce(y.v, -1) AS v FROM (SELECT unnest(range({_SUPP})) AS i) g LEFT JOIN (SELECT i, max(v * 2) AS v FROM m_sp GROUP BY 1) y ON g.i = y.i", "m_sp")
def reduce_rows(t):
    return M.reduce(t.supplier_part(), M.ROW, F.max, -1, lambda v: v * 2)


@query(f"SELECT g.i, coalesce(y.v, 0) AS v FROM (SELECT unnest(range({_PART})) AS i) g LEFT JOIN (SELECT j AS i, CAST(sum(v) AS BIGINT) AS v FROM m_sp WHERE i IN (SELECT i FROM x_pos) GROUP BY 1) y ON g.i = y.i", "m_sp x_pos")
def masked_reduce(t):
    return M.masked_reduce(t.supplier_part(), t.balances(True), F.sum, 0)


@query(f"SELECT g.i, coalesce(y.v, 0) AS v FROM (SELECT unnest(range({_PART})) AS i) g LEFT JOIN (SELECT j AS i, CAST(sum(v) AS BIGINT) AS v FROM m_sp WHERE i NOT IN (SELECT i FROM x_pos) GROUP BY 1) y ON g.i = y.i", "m_sp x_pos")
def masked_reduce_exclude(t):
    return M.masked_reduce(t.supplier_part(), t.balances(True), F.sum, 0, exclude=True)


@query("SELECT CAST(sum(v * v) AS BIGINT) AS v FROM x_supp", "x_supp")
def vector_reduce(t):
    return V.reduce(t.balances(), F.sum, 0, lambda v: v * v)


@query("SELECT i, v FROM x_supp ORDER BY v, i LIMIT 1", "x_supp")
def min_element(t):
    return V.min_element(t.balances())


@query("SELECT coalesce(max(j - i), -1) AS bandwidth FROM g_cp2 WHERE i <= j", "g_cp2")
def bandwidth(t):
    return M.bandwidth(t.copurchase())


@query(f"SELECT CAST(coalesce(sum(d), 0) + {_PART} - count(*) AS BIGINT) AS profile FROM (SELECT j - min(i) AS d FROM g_cp2 WHERE i <= j GROUP BY j)", "g_cp2")
def profile(t):
    return M.profile(t.copurchase())


_STAT = """WITH r AS (SELECT i, j, v, row_number() OVER (PARTITION BY j ORDER BY v DESC) AS r, count(*) OVER w AS n,
  count(*) FILTER (v > 60) OVER w AS kn, coalesce(sum(v) FILTER (v > 60) OVER w, 0) AS ks, min(v) OVER w AS vmin FROM m_nat WINDOW w AS (PARTITION BY j)),
 s AS (SELECT *, max(v) FILTER (r = 8) OVER w AS vr, max(v) FILTER (r = 5) OVER w AS vs FROM r WINDOW w AS (PARTITION BY j)),
 u AS (SELECT *, coalesce(sum(v) FILTER (v >= vs) OVER (PARTITION BY j), 0) AS ss FROM s)
SELECT i, j, v FROM u WHERE v >= CASE WHEN kn < 8 AND n > kn AND ks < 900 THEN coalesce(vr, vmin) WHEN kn > 5 AND ss < 900 THEN coalesce(vr, vmin) WHEN kn > 5 THEN vs ELSE 60 END"""


@query(_STAT, "m_nat")
def prune_recover_select(t):
    return M.prune_recover_select(t.nations(), 60, 5, 8, 900)


# ranking and sorting

@query(f"SELECT g.i, coalesce(y.v, -1) AS v FROM (SELECT unnest(range({_PART})) AS i) g LEFT JOIN (SELECT j AS i, v FROM (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY v DESC) AS r FROM m_sp) WHERE r = 5) y ON g.i = y.i", "m_sp")
def kselect(t):
    return M.kselect(t.supplier_part(), 5, -1)


@query("SELECT x.i, coalesce(y.v, -1) AS v FROM (SELECT i FROM x_part WHERE v > 25) x LEFT JOIN (SELECT j AS i, min(v) AS v FROM (SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY v DESC) AS r FROM m_sp) WHERE r <= 25 GROUP BY 1) y ON x.i = y.i", "m_sp x_part")
def kselect_sparse(t):
    return M.kselect(t.supplier_part(), 25, -1, V.find(t.part_sizes(), lambda v: v > 25))


@query("SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, v, i AS position FROM x_supp", "x_supp")
def vector_sort(t):
    return V.sort(t.balances())


@query("SELECT i, row_number() OVER (ORDER BY i) + 9 AS v FROM x_pos", "x_pos")
def number_entries(t):
    return V.number_entries(t.balances(True), 10)


# sets of values, scatter, gather, indexing

@query("SELECT min(i) AS i, v FROM x_part GROUP BY v", "x_part")
def vector_uniq(t):
    return V.uniq(t.part_sizes())


@query("SELECT v AS i, min(i) AS v FROM x_part GROUP BY v", "x_part")
def vector_invert(t):
    return V.invert(t.part_sizes(), 51)


@query("SELECT v % 10 AS i, CAST(sum(i + v) AS BIGINT) AS v FROM x_part GROUP BY 1", "x_part")
def vector_invert_general(t):
    return V.invert(t.part_sizes(), 10, lambda v, i: v % 10, lambda v, i: v + i, F.sum)


@query(f"SELECT g.i, coalesce(y.v, d.v, 0) AS v FROM (SELECT unnest(range({_SUPP})) AS i) g LEFT JOIN x_supp d ON g.i = d.i LEFT JOIN (SELECT v AS i, max(i) AS v FROM x_part GROUP BY 1) y ON g.i = y.i", "x_supp x_part")
def vector_scatter(t):
    return V.scatter(t.dense_balances(), t.part_sizes(), lambda v, i: v, lambda v, i: i)


@query(f"SELECT x.i, CASE WHEN x.v < {_SUPP} THEN coalesce(d.v, 0) ELSE -1 END AS v FROM x_part x LEFT JOIN x_supp d ON x.v = d.i", "x_part x_supp")
def vector_gather(t):
    return V.gather(t.dense_balances(), t.part_sizes(), lambda v, i: v, -1)


@query("SELECT CAST(p_partkey / 3 AS BIGINT) AS i, x.v FROM part JOIN x_part x ON p_partkey = x.i WHERE p_partkey % 3 = 0", "x_part")
def vector_index(t):
    at = t.low_parts(3)
    return V.index(t.part_sizes(), DenseVector(at.df, at.n))


@query(f"SELECT CAST(i / 2 AS BIGINT) AS i, CAST(j / 3 AS BIGINT) AS j, v FROM m_sp WHERE i IN {_EVEN} AND j IN {_THIRD}", "m_sp")
def spref(t):
    return M.spref(t.supplier_part(), _even_suppliers(t), t.low_parts(3))


@query(f"SELECT i, CAST(j / 3 AS BIGINT) AS j, v FROM m_sp WHERE j IN {_THIRD}", "m_sp")
def spref_columns(t):
    return M.spref(t.supplier_part(), cols=t.low_parts(3))


@query(f"SELECT i, j, v FROM m_sp WHERE NOT (i IN {_EVEN} AND j IN {_THIRD}) UNION ALL SELECT i, j, v * 10 FROM m_sp WHERE i IN {_EVEN} AND j IN {_THIRD}", "m_sp")
def spasgn(t):
    a, r, c = t.supplier_part(), _even_suppliers(t), t.low_parts(3)
    return M.spasgn(a, r, c, M.apply(M.spref(a, r, c), lambda v: v * 10))


@query("SELECT i, j, CAST(max(v) AS BIGINT) AS v FROM (SELECT l_suppkey AS i, l_partkey AS j, CAST(l_quantity AS BIGINT) AS v FROM lineitem) GROUP BY 1, 2")
def sparse_max(t):
    line = t.table("lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("k"))
    n = 2**62
    vec = lambda c: SparseVector(line.select(F.col("k").alias("i"), F.col(c).alias("v")), n)
    return M.sparse(vec("l_suppkey"), vec("l_partkey"), vec("q"), t.suppliers, t.parts, sum_duplicates=False)


@query("SELECT row_number() OVER (ORDER BY j, i) - 1 AS k, i, j, v FROM m_nat", "m_nat")
def find_triples(t):
    return M.find(t.nations())


@query("SELECT l_suppkey AS i, l_partkey AS j, count(*) AS v FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def from_edges(t):
    return M.from_edges(t.table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), t.parts, remove_loops=True)


@query("SELECT x.v AS part, m.i, m.j, m.v FROM m_nat m JOIN (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS v FROM nation) x ON m.i = x.i JOIN (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS v FROM nation) y ON m.j = y.i WHERE x.v = y.v", "m_nat")
def induced_subgraphs(t):
    n = t.table("nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("v"))
    return M.induced_subgraphs(t.nations(), SparseVector(n, 25))


@query(f"SELECT g.i, coalesce(y.v, -1) AS v FROM (SELECT unnest(range({_PART})) AS i) g LEFT JOIN (SELECT j AS i, max(i) AS v FROM m_sp GROUP BY 1) y ON g.i = y.i", "m_sp")
def last_row_of_columns(t):
    return M.last_row_of_columns(t.supplier_part())


@query("SELECT CAST(i // 13 AS BIGINT) AS rb, CAST(j // 13 AS BIGINT) AS cb, i % 13 AS i, j % 13 AS j, v FROM m_nat", "m_nat")
def block_split(t):
    blocks = [b.df.select(F.lit(r).cast("long").alias("rb"), F.lit(c).cast("long").alias("cb"), "i", "j", "v") for r, row in enumerate(M.block_split(t.nations(), 2, 2)) for c, b in enumerate(row)]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


@query(f"SELECT i, v FROM x_supp UNION ALL SELECT i + {_SUPP}, v FROM x_supp", "x_supp")
def vector_concatenate(t):
    x = t.balances()
    d = DenseVector(x.df, x.n)
    return V.concatenate([d, d])


@query("SELECT e.j, round(sum(e.v * e.v), 4) AS s FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e GROUP BY 1")
def embedding_gram_diagonal(t):
    m = t.embedding_matrix()
    return M.reduce(m, M.COLUMN, F.sum, unary=lambda v: v * v).df.select(F.col("i").alias("j"), F.round("v", 4).alias("s"))


# graph algorithms


@query("WITH src AS (SELECT min(i) AS s FROM g_cp2), r(vertex, level) AS (SELECT s, 0 FROM src UNION SELECT g.i, r.level + 1 FROM r JOIN g_cp2 g ON g.j = r.vertex WHERE r.level < 24), l AS (SELECT vertex, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY 1) SELECT l.vertex, l.level, coalesce((SELECT max(g.j) FROM g_cp2 g JOIN l p ON g.j = p.vertex WHERE g.i = l.vertex AND p.level = l.level - 1), l.vertex) AS parent FROM l", "g_cp2", recursive=True)
def bfs(t):
    a = t.copurchase()
    return G.bfs(a, a.df.agg(F.min("i")).collect()[0][0])


_CC = f"WITH r(v, l) AS (SELECT i, i FROM (SELECT unnest(range({_PART})) AS i) UNION SELECT g.i, r.l FROM r JOIN g_cp2 g ON g.j = r.v WHERE r.l < g.i) SELECT v AS vertex, min(l) AS label FROM r GROUP BY 1"


@query(_CC, "g_cp2", recursive=True)
def connected_components(t):
    return G.components(t.copurchase())


@query(_CC, "g_cp2", recursive=True)
def connected_components_by_stars(t):
    return G.components_by_stars(t.copurchase())


@query(_CC.replace("SELECT v AS vertex, min(l) AS label FROM r GROUP BY 1", "SELECT label, count(*) AS size FROM (SELECT v, min(l) AS label FROM r GROUP BY 1) GROUP BY 1"), "g_cp2", recursive=True)
def component_sizes(t):
    return G.component_sizes(G.components(t.copurchase()))


@query()
def independent_set(t):
    return G.independent_set(t.copurchase())


@query()
def independent_set_2(t):
    return G.independent_set(t.copurchase(), hops=2)


@query()
def betweenness(t):
    a = t.copurchase()
    sources = [r[0] for r in a.df.select("i").distinct().orderBy("i").limit(4).collect()]
    return G.betweenness(a, sources).select("vertex", F.round("score", 6).alias("score"))


@query()
def markov_clustering(t):
    return G.markov_clustering(t.copurchase(), inflation=2.0)


@query("SELECT round(max(c), 6) AS chaos FROM (SELECT (max(p) - sum(p * p)) * count(*) AS c FROM (SELECT j, v / sum(v) OVER (PARTITION BY j) AS p FROM m_nat) GROUP BY j)", "m_nat")
def chaos(t):
    return G.chaos(G.column_stochastic(t.nations())).select(F.round("chaos", 6).alias("chaos"))


@query()
def reverse_cuthill_mckee(t):
    return G.reverse_cuthill_mckee(t.copurchase())


@query()
def minimum_degree(t):
    return G.minimum_degree(M.prune(M.symmetrise(t.nations()), lambda v: v < 150))


@query()
def maximal_matching(t):
    return G.maximal_matching(t.copurchase(3))


@query()
def maximum_matching(t):
    return G.maximum_matching(t.copurchase(3))


@query()
def perfect_weight_matching(t):
    return G.perfect_weight_matching(t.nations())


@query()
def auction_round(t):
    return G.auction_round(t.nations(), SparseVector(t.spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("v")), 25))


@query()
def k_tips(t):
    return G.k_tips(t.copurchase(), 3)


@query()
def restriction_operator(t):
    return G.restriction(t.copurchase())


@query("WITH d0 AS (SELECT i, j, CAST(v AS DOUBLE) AS v FROM m_nat WHERE i <> j UNION ALL SELECT i, i, 0.0 FROM (SELECT unnest(range(25)) AS i)), d1 AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d0 a JOIN d0 b ON a.j = b.i GROUP BY 1, 2), d2 AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d1 a JOIN d1 b ON a.j = b.i GROUP BY 1, 2), d3 AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d2 a JOIN d2 b ON a.j = b.i GROUP BY 1, 2), d4 AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d3 a JOIN d3 b ON a.j = b.i GROUP BY 1, 2), d5 AS (SELECT a.i, b.j, min(a.v + b.v) AS v FROM d4 a JOIN d4 b ON a.j = b.i GROUP BY 1, 2) SELECT i, j, v FROM d5", "m_nat")
def shortest_paths(t):
    return G.shortest_paths(t.nations())


@query()
def rmat(t):
    return generate.rmat(t.spark, 10)
