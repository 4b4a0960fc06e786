"""Graph algorithms over the matrix and vector operators.

Every loop keeps its state as a table; only counts and single values reach the
driver. Random choices are hashes of (vertex, round, seed), so results repeat.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semiring import PLUS_TIMES, SELECT_MAX_SECOND, SELECT_SECOND_MIN, MIN_PLUS_DOUBLE, Semiring
from ..plans.fixpoint import cut
from ..types import DenseVector, Matrix, SparseVector
from . import matrix as M
from .products import spgemm, spmv_sparse

BIG = 2**63 - 1


# traversal

def bfs(a: Matrix, source: int, semiring: Semiring = SELECT_MAX_SECOND, edge_filter=None, direction: str = "auto") -> DataFrame:
    """vertex, level, parent of every vertex reached; the parent is the largest neighbour on the frontier.

    direction: 'push' joins the frontier with its edges, 'pull' starts from the
    unreached vertices, 'auto' pulls while the frontier's edges are over a
    twentieth of all. Levels and parents are the same either way.
    """
    edges = a.df.where(edge_filter(F.col("v"))) if edge_filter is not None else a.df
    edges = cut(edges.select("i", "j"))
    degrees = cut(edges.groupBy("j").agg(F.count("*").alias("d")))
    total = edges.count()
    spark = a.df.sparkSession
    seen = frontier = cut(spark.range(1).select(F.lit(source).cast("long").alias("vertex"), F.lit(0).cast("long").alias("level"), F.lit(source).cast("long").alias("parent")))
    level = 0
    while True:
        level += 1
        pull = direction == "pull"
        if direction == "auto":
            pull = 20 * (frontier.join(degrees, frontier.vertex == degrees.j).agg(F.sum("d")).collect()[0][0] or 0) > total
        use = edges.join(seen.select(F.col("vertex").alias("i")), "i", "left_anti") if pull else edges
        step = use.join(frontier.select(F.col("vertex").alias("j")), "j")
        fresh = step.groupBy(F.col("i").alias("vertex")).agg(semiring.add(F.col("j")).alias("parent"))
        fresh = fresh.join(seen.select("vertex"), "vertex", "left_anti")
        frontier = cut(fresh.select("vertex", F.lit(level).cast("long").alias("level"), "parent"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def filtered_bfs(a: Matrix, source: int, edge_filter) -> DataFrame:
    """bfs over the edges whose value satisfies a predicate; the filter reaches the scan."""
    return bfs(a, source, edge_filter=edge_filter)


def random_parent_bfs(a: Matrix, source: int, seed: int = 0) -> DataFrame:
    """bfs whose parents are drawn by a hash."""
    draw = Semiring("draw", lambda c: F.min_by(c, F.xxhash64(F.lit(seed), c)), lambda x, y: y)
    return bfs(a, source, draw)


def single_child_bfs(a: Matrix, source: int) -> DataFrame:
    """bfs in which each parent keeps its smallest child of a level."""
    tree = bfs(a, source)
    return tree.groupBy("parent", "level").agg(F.min("vertex").alias("vertex")).select("vertex", "level", "parent")


def traversed_edges(a: Matrix, tree: DataFrame) -> DataFrame:
    """One row: half the degrees of the vertices reached."""
    deg = M.reduce(a, M.ROW, F.count, 0, dense=False)
    return tree.select(F.col("vertex").alias("i")).join(deg.df, "i").agg((F.coalesce(F.sum("v"), F.lit(0)) / 2).alias("edges"))


def search_roots(a: Matrix, count: int = 64, seed: int = 1) -> list[int]:
    """At most ``count`` vertices with an edge to another one, drawn by a hash."""
    some = a.df.where("i <> j").select("i").distinct().orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(count)
    return [r[0] for r in some.collect()]


def search_statistics(a: Matrix, roots: list[int]) -> DataFrame:
    """One row over searches from all roots: minimum, quartiles, maximum and harmonic mean of edges traversed a second."""
    rates = []
    for root in roots:
        began = time.perf_counter()
        tree = cut(bfs(a, root))
        took = time.perf_counter() - began
        rates.append((float(traversed_edges(a, tree).collect()[0][0]) / took,))
    q = [F.percentile("r", p).alias(n) for n, p in (("low", 0.25), ("median", 0.5), ("high", 0.75))]
    frame = a.df.sparkSession.createDataFrame(rates, "r double")
    return frame.agg(F.count("*").alias("searches"), F.min("r").alias("least"), *q, F.max("r").alias("most"), (F.count("*") / F.sum(1 / F.col("r"))).alias("harmonic_mean"))


# components

def components(a: Matrix) -> DataFrame:
    """vertex, label for every vertex of a symmetric graph: the smallest vertex of its component.

    Minimum-neighbour hooking with shortcutting: each round takes the smallest
    grandparent among neighbours, hooks parents to it and jumps once.
    """
    edges = cut(a.df.where("i <> j").select("i", "j"))
    spark = a.df.sparkSession
    f = cut(spark.range(a.nrow).select(F.col("id").alias("i"), F.col("id").alias("p")))
    while True:
        near = edges.join(f.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.min("q").alias("m"))
        with_near = f.join(near, "i", "left").select("i", "p", F.least("p", F.coalesce("m", "p")).alias("m"))
        hook = with_near.groupBy(F.col("p").alias("i")).agg(F.min("m").alias("h"))  # parents of the tree hook too
        low = with_near.join(hook, "i", "left").select("i", "p", F.least("m", F.coalesce("h", "m")).alias("n"))
        low = cut(low)
        jump = low.select(F.col("i").alias("n"), F.col("n").alias("g"))
        new = cut(low.join(jump, "n", "left").select("i", F.col("p").alias("old"), F.least("n", F.coalesce("g", "n")).alias("p")))
        done = new.where("old <> p").isEmpty()
        f = new.select("i", "p")
        if done:
            return f.select(F.col("i").alias("vertex"), F.col("p").alias("label"))


def components_by_stars(a: Matrix) -> DataFrame:
    """The same labels by conditional and unconditional star hooking and shortcutting, for comparison."""
    edges = cut(a.df.where("i <> j").select("i", "j"))
    f = cut(a.df.sparkSession.range(a.nrow).select(F.col("id").alias("i"), F.col("id").alias("p")))

    def stars(f: DataFrame) -> DataFrame:
        """i, p, star: whether the tree of i has depth one."""
        g = f.select(F.col("i").alias("p"), F.col("p").alias("g"))
        deep = f.join(g, "p").withColumn("deep", F.col("p") != F.col("g"))
        bad = deep.where("deep").select(F.col("g").alias("i")).unionByName(deep.where("deep").select("p").withColumnRenamed("p", "i")).unionByName(deep.where("deep").select("i")).distinct()
        flagged = f.join(bad.withColumn("no", F.lit(True)), "i", "left")
        parent = flagged.select(F.col("i").alias("p"), F.col("no").alias("pno"))
        return flagged.join(parent, "p").select("i", "p", (F.col("no").isNull() & F.col("pno").isNull()).alias("star"))

    def hook(f: DataFrame, smaller: bool) -> DataFrame:
        s = cut(stars(f))
        q = s.select(F.col("i").alias("j"), F.col("p").alias("q"), F.col("star").alias("qstar"))
        over = s.where("star").join(edges, "i").join(q, "j").where("q < p" if smaller else "q <> p and not qstar")
        to = over.groupBy(F.col("p").alias("i")).agg(F.min("q").alias("h"))
        return f.join(to, "i", "left").select("i", F.coalesce("h", "p").alias("p"))

    while True:
        new = hook(cut(hook(f, True)), False)
        new = cut(new)
        jump = new.select(F.col("i").alias("p"), F.col("p").alias("g"))
        new = cut(new.join(jump, "p").select("i", F.col("g").alias("p")))
        if new.join(f.withColumnRenamed("p", "old"), "i").where("p <> old").isEmpty():
            break
        f = new
    least = new.groupBy("p").agg(F.min("i").alias("label"))
    return new.join(least, "p").select(F.col("i").alias("vertex"), "label")


def component_sizes(labels: DataFrame) -> DataFrame:
    """label, size of every component."""
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def largest_component(a: Matrix, labels: DataFrame) -> DataFrame:
    """(i, j, v) of the largest component (smallest label among ties)."""
    top = component_sizes(labels).orderBy(F.desc("size"), "label").limit(1)
    inside = labels.join(F.broadcast(top), "label").select(F.col("vertex").alias("i"))
    return a.df.join(inside, "i", "left_semi")


# independent sets

def independent_set(a: Matrix, seed: int = 0, hops: int = 1) -> DataFrame:
    """vertex: a maximal independent set (of distance over ``hops``, 1 or 2), by hashed priorities in rounds."""
    edges = cut(a.df.where("i <> j").select("i", "j").distinct())
    live = cut(a.df.sparkSession.range(a.nrow).select(F.col("id").alias("i")))
    chosen, r = None, 0

    def near(x: DataFrame) -> DataFrame:
        """Smallest (p, w) among a vertex and its neighbours."""
        moved = edges.join(x.select(F.col("i").alias("j"), "p", "w"), "j").select("i", "p", "w")
        return moved.unionByName(x.select("i", "p", "w")).groupBy("i").agg(F.min(F.struct("p", "w")).alias("m")).select("i", "m.p", "m.w")

    def around(x: DataFrame) -> DataFrame:
        return x.select("i").unionByName(edges.join(x.select(F.col("i").alias("j")), "j").select("i")).distinct()

    while not live.isEmpty():
        low = live.select("i", F.xxhash64("i", F.lit(r), F.lit(seed)).alias("p"), F.col("i").alias("w"))
        for _ in range(hops):
            low = near(low)
        new = cut(low.where("w = i").select("i").join(live, "i", "left_semi"))
        out = new
        for _ in range(hops):
            out = around(out)
        chosen = new if chosen is None else chosen.unionByName(new)
        live = cut(live.join(out, "i", "left_anti"))
        r += 1
    chosen = live if chosen is None else chosen
    return chosen.select(F.col("i").alias("vertex"))


def restriction(a: Matrix, seed: int = 0) -> Matrix:
    """n x aggregates: roots are a distance-2 independent set, neighbours join them, the rest join a neighbour's aggregate."""
    roots = independent_set(a, seed, hops=2).select(F.col("vertex").alias("i"), F.col("vertex").alias("root"))
    edges = a.df.where("i <> j").select("i", "j")
    first = cut(roots.unionByName(edges.join(roots.select(F.col("i").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("root")).join(roots.select("i"), "i", "left_anti")))
    rest = edges.join(first.select("i"), "i", "left_anti").join(first.select(F.col("i").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("root"))
    every = cut(first.unionByName(rest))
    numbered = cut(M._numbered(roots.select("root"), ["root"], "k"))
    return Matrix(every.join(numbered, "root").select("i", F.col("k").alias("j"), F.lit(1).cast("long").alias("v")), a.nrow, numbered.count())


def galerkin(a: Matrix, s: Matrix, t: Matrix) -> Matrix:
    """S A T, the cheaper product first by the count of partial products."""
    from .products import flops

    left = flops(s, a).collect()[0][0]
    right = flops(a, t).collect()[0][0]
    return spgemm(spgemm(s, a), t) if left <= right else spgemm(s, spgemm(a, t))


# centrality

def betweenness(a: Matrix, sources: list[int]) -> DataFrame:
    """vertex, score of every vertex: shortest paths from the sources that pass through it (unweighted, directed i -> j)."""
    edges = cut(a.df.where("i <> j").select("i", "j"))
    spark = a.df.sparkSession
    level = cut(spark.createDataFrame([(s, s) for s in sources], "s long, i long").select("s", "i", F.lit(1.0).alias("n"), F.lit(0).alias("d")))
    seen, d = level, 0
    while not level.isEmpty():
        d += 1
        step = level.join(edges, "i").groupBy("s", F.col("j").alias("i")).agg(F.sum("n").alias("n"))
        level = cut(step.join(seen.select("s", "i"), ["s", "i"], "left_anti").withColumn("d", F.lit(d)))
        seen = seen.unionByName(level)
    seen = cut(seen)
    dep = cut(seen.where("d < 0").select("s", "i", F.lit(0.0).alias("x")))
    for k in range(d - 1, 0, -1):
        low = seen.where(F.col("d") == k).select("s", F.col("i").alias("j"), F.col("n").alias("nj"))
        up = seen.where(F.col("d") == k - 1).select("s", "i", "n")
        below = low.join(dep.select("s", F.col("i").alias("j"), "x"), ["s", "j"], "left").select("s", "j", ((1 + F.coalesce("x", F.lit(0.0))) / F.col("nj")).alias("w"))
        add = edges.join(below, "j").join(up, ["s", "i"]).groupBy("s", "i").agg(F.sum(F.col("n") * F.col("w")).alias("x"))
        dep = cut(dep.unionByName(add))
    total = dep.join(seen.where("d > 0").select("s", "i"), ["s", "i"]).groupBy("i").agg(F.sum("x").alias("x"))
    return spark.range(a.nrow).select(F.col("id").alias("i")).join(total, "i", "left").select(F.col("i").alias("vertex"), F.coalesce("x", F.lit(0.0)).alias("score"))


# Markov clustering

def column_stochastic(a: Matrix) -> Matrix:
    return M.dim_apply(a, M.COLUMN, M.reduce(a, M.COLUMN, F.sum, dense=False), lambda v, s: v / s)


def chaos(a: Matrix) -> DataFrame:
    """One row: the largest (maximum - sum of squares) * entries of a column."""
    per = a.df.groupBy("j").agg(((F.max("v") - F.sum(F.col("v") * F.col("v"))) * F.count("*")).alias("c"))
    return per.agg(F.max("c").alias("chaos"))


def markov_clustering(a: Matrix, inflation: float = 2.0, cutoff: float = 1e-4, select: int = 1100, recover: int = 1400, percent: float = 0.9, epsilon: float = 1e-4, rounds: int = 60) -> DataFrame:
    """vertex, label: expansion, pruning, inflation until chaos is small; clusters are the components of what is left.

    Raises if chaos is still above epsilon after the safety bound of rounds: unfinished states are no clusters.
    """
    a = M.apply(a, lambda v: v.cast("double"))
    top = M.reduce(M.remove_loops(a), M.COLUMN, F.max, 1.0)
    m = column_stochastic(M.add_loops(M.remove_loops(a), top, replace=True))
    m = m.with_df(cut(m.df))
    for _ in range(rounds):
        m = column_stochastic(M.prune_recover_select(spgemm(m, m, PLUS_TIMES), cutoff, select, recover, percent))
        m = m.with_df(cut(m.df))
        c = chaos(m).collect()[0][0]
        m = column_stochastic(M.apply(m, lambda v: F.pow(v, F.lit(inflation))))
        m = m.with_df(cut(m.df))
        if c is None or c <= epsilon:
            return components(M.symmetrise(m, F.max))
    raise RuntimeError(f"chaos above {epsilon} after {rounds} rounds")


def incremental_clustering(old: Matrix, cross: Matrix, back: Matrix, new: Matrix, **options) -> DataFrame:
    """Clusters of old and new vertices together; new ones are numbered after the old."""
    p, q = old.nrow, new.nrow
    df = old.df.unionByName(cross.df.select("i", (F.col("j") + p).alias("j"), "v"))
    df = df.unionByName(back.df.select((F.col("i") + p).alias("i"), "j", "v")).unionByName(new.df.select((F.col("i") + p).alias("i"), (F.col("j") + p).alias("j"), "v"))
    return markov_clustering(Matrix(df, p + q, p + q), **options)


def drop_inter_cluster(a: Matrix, labels: DataFrame) -> Matrix:
    """Without the edges between different clusters."""
    x = labels.select(F.col("vertex").alias("i"), F.col("label").alias("x"))
    y = labels.select(F.col("vertex").alias("j"), F.col("label").alias("y"))
    return a.with_df(a.df.join(x, "i").join(y, "j").where("x = y"))


def f_score(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: best F of each cluster of the first in the second, weighted by size."""
    x, y = first.select("vertex", F.col("label").alias("x")), second.select("vertex", F.col("label").alias("y"))
    both = x.join(y, "vertex").groupBy("x", "y").agg(F.count("*").alias("c"))
    nx, ny = x.groupBy("x").agg(F.count("*").alias("nx")), y.groupBy("y").agg(F.count("*").alias("ny"))
    f = both.join(nx, "x").join(ny, "y").groupBy("x", "nx").agg(F.max(2 * F.col("c") / (F.col("nx") + F.col("ny"))).alias("f"))
    return f.agg((F.sum(F.col("f") * F.col("nx")) / F.sum("nx")).alias("f_score"))


# orderings

def reverse_cuthill_mckee(a: Matrix) -> DataFrame:
    """vertex, pos (1 .. n): level by level by (parent's order, degree, vertex), reversed.

    Each component starts at a pseudo-peripheral vertex. Levels are ordered by a
    window over one level, the one global order that the definition asks for.
    """
    edges = cut(a.df.where("i <> j").select("i", "j").distinct())
    spark = a.df.sparkSession
    deg = cut(spark.range(a.nrow).select(F.col("id").alias("i")).join(edges.groupBy("i").agg(F.count("*").alias("d")), "i", "left").select("i", F.coalesce("d", F.lit(0)).alias("d")))
    labels = cut(components(Matrix(edges.withColumn("v", F.lit(1)), a.nrow, a.nrow)).select(F.col("vertex").alias("i"), "label").join(deg, "i"))

    def levels(starts: DataFrame) -> DataFrame:
        """i, label, d, level from one start in each component, all together."""
        frontier = seen = cut(starts.select("i", "label", "d", F.lit(0).alias("level")))
        k = 0
        while True:
            k += 1
            new = edges.join(frontier.select(F.col("i").alias("j")), "j").select("i").distinct().join(seen.select("i"), "i", "left_anti")
            frontier = cut(new.join(labels, "i").select("i", "label", "d", F.lit(k).alias("level")))
            if frontier.isEmpty():
                return seen
            seen = seen.unionByName(frontier)

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("label").agg(F.min(F.struct("d", "i")).alias("m")).select("label", "m.d", "m.i")

    starts, depth = best(labels), None
    while True:
        tree = cut(levels(starts))
        deepest = tree.groupBy("label").agg(F.max("level").alias("h"))
        if depth is not None:
            up = deepest.join(depth.withColumnRenamed("h", "h0"), "label").where("h > h0")
            if up.isEmpty():
                break
        depth = cut(deepest)
        starts = cut(best(tree.join(depth, "label").where("level = h")))
    k = 0
    frontier = placed = cut(starts.select("i", "label", F.lit(0).alias("level"), F.lit(0).cast("long").alias("o")))
    while True:
        k += 1
        parent = edges.join(frontier.select(F.col("i").alias("j"), "o"), "j").groupBy("i").agg(F.min("o").alias("po"))
        new = parent.join(placed.select("i"), "i", "left_anti").join(labels, "i")
        w = Window.partitionBy("label").orderBy("po", "d", "i")
        frontier = cut(new.select("i", "label", F.lit(k).alias("level"), (F.row_number().over(w) - 1).cast("long").alias("o")))
        if frontier.isEmpty():
            break
        placed = placed.unionByName(frontier)
    numbered = M._numbered(placed, ["label", "level", "o"], "k")
    return numbered.select(F.col("i").alias("vertex"), (F.lit(a.nrow) - F.col("k")).alias("pos"))


def permute(a: Matrix, order: DataFrame) -> Matrix:
    """The matrix with both sides renumbered by (vertex, pos from 0)."""
    p = order.select(F.col("vertex").alias("i"), F.col("pos").alias("p"))
    q = order.select(F.col("vertex").alias("j"), F.col("pos").alias("q"))
    return a.with_df(a.df.join(p, "i").join(q, "j").select(F.col("p").alias("i"), F.col("q").alias("j"), "v"))


def minimum_degree(a: Matrix, bound: int = 5000) -> DataFrame:
    """vertex, pos (0 .. n - 1): always the vertex of least degree in the elimination graph (ties by number).

    Inherently one vertex after another; the graph goes to the driver, so n is bounded and checked.
    """
    if a.nrow > bound:
        raise ValueError(f"minimum degree is sequential; at most {bound} vertices")
    near: dict[int, set[int]] = {i: set() for i in range(a.nrow)}
    for i, j in a.df.where("i <> j").select("i", "j").toPandas().itertuples(index=False):
        near[i].add(j)
        near[j].add(i)
    out, left = [], set(near)
    while left:
        v = min(left, key=lambda x: (len(near[x]), x))
        left.remove(v)
        around = near.pop(v)
        for u in around:
            near[u] |= around
            near[u] -= {u, v}
        out.append((v, len(out)))
    return a.df.sparkSession.createDataFrame(out, "vertex long, pos long")


# matching (rows i, columns j)

def maximal_matching(a: Matrix, weighted: bool = False, by_degree: bool = False, karp_sipser: bool = False) -> DataFrame:
    """row, col: a maximal matching; columns propose, rows and then columns keep the best proposal.

    Best: the smallest column (or the heaviest edge, or the column of least live degree); ties by number.
    karp_sipser: columns of degree one propose first while there are any.
    """
    live = cut(a.df.select("i", "j", F.col("v").cast("double").alias("w")))
    matched = None
    while not live.isEmpty():
        degree = live.groupBy("j").agg(F.count("*").alias("d"))
        offer = live.join(degree, "j") if by_degree or karp_sipser else live.withColumn("d", F.lit(0).cast("long"))
        if karp_sipser:
            ones = cut(offer.where("d = 1"))
            offer = offer if ones.isEmpty() else ones
        rank = F.struct((-F.col("w")).alias("x"), "j") if weighted else F.struct(F.col("d").alias("x"), "j") if by_degree else F.struct(F.lit(0.0).alias("x"), "j")
        rows = offer.groupBy("i").agg(F.min(rank).alias("b")).select("i", "b.j", "b.x")
        pairs = rows.groupBy("j").agg(F.min(F.struct("x", "i")).alias("b")).select("b.i", "j")
        pairs = cut(pairs)
        matched = pairs if matched is None else matched.unionByName(pairs)
        live = cut(live.join(pairs.select("i"), "i", "left_anti").join(pairs.select("j"), "j", "left_anti"))
    matched = live.select("i", "j") if matched is None else matched
    return matched.select(F.col("i").alias("row"), F.col("j").alias("col"))


def maximum_matching(a: Matrix, start: DataFrame | None = None) -> DataFrame:
    """row, col: maximum cardinality by phases of alternating breadth-first trees and augmentation along them."""
    edges = cut(a.df.select("i", "j"))
    mates = cut((maximal_matching(a) if start is None else start).select("row", "col"))
    while True:
        free_col = edges.select("j").distinct().join(mates.select(F.col("col").alias("j")), "j", "left_anti")
        frontier = cut(free_col.select("j", F.col("j").alias("root")))
        visited = None
        leaves = None
        while not frontier.isEmpty():
            step = edges.join(frontier, "j").groupBy("i").agg(F.min(F.struct("root", "j")).alias("b")).select("i", "b.j", "b.root")
            if visited is not None:
                step = step.join(visited.select("i"), "i", "left_anti")
            step = cut(step)
            visited = step if visited is None else visited.unionByName(step)
            ends = cut(step.join(mates.select(F.col("row").alias("i")), "i", "left_anti").groupBy("root").agg(F.min("i").alias("i")))
            leaves = ends if leaves is None else leaves.unionByName(ends)
            on = step.join(leaves.select("root"), "root", "left_anti").join(mates.select(F.col("row").alias("i"), "col"), "i")
            frontier = cut(on.select(F.col("col").alias("j"), "root"))
        if leaves is None or leaves.isEmpty():
            return mates
        visited = cut(visited)
        walk = cut(leaves.groupBy("root").agg(F.min("i").alias("i")).select("i"))
        fresh = None
        while not walk.isEmpty():  # from each leaf back to its root, all paths together
            edge = cut(walk.join(visited, "i").select("i", "j"))
            fresh = edge if fresh is None else fresh.unionByName(edge)
            walk = cut(edge.join(mates.select(F.col("col").alias("j"), "row"), "j").select(F.col("row").alias("i")))
        kept = mates.join(fresh.select(F.col("i").alias("row")), "row", "left_anti").join(fresh.select(F.col("j").alias("col")), "col", "left_anti")
        mates = cut(kept.select("row", "col").unionByName(fresh.select(F.col("i").alias("row"), F.col("j").alias("col"))))


def perfect_weight_matching(a: Matrix, rounds: int = 10) -> DataFrame:
    """row, col: a maximum-cardinality matching whose weight grows by swaps along 4-cycles."""
    w = cut(a.df.select("i", "j", F.col("v").cast("double").alias("w")))
    mates = maximum_matching(a, maximal_matching(a, weighted=True))
    for _ in range(rounds):
        m = mates.join(w.select(F.col("i").alias("row"), F.col("j").alias("col"), "w"), ["row", "col"])
        at_row = m.select(F.col("row").alias("i"), F.col("col").alias("mi"), F.col("w").alias("wi"))
        at_col = m.select(F.col("col").alias("j"), F.col("row").alias("mj"), F.col("w").alias("wj"))
        cross = w.select(F.col("i").alias("mj"), F.col("j").alias("mi"), F.col("w").alias("wc"))
        cycles = w.join(at_row, "i").join(at_col, "j").where("i > mj").join(cross, ["mj", "mi"])
        gains = cycles.select("i", "j", "mi", "mj", (F.col("w") + F.col("wc") - F.col("wi") - F.col("wj")).alias("g")).where("g > 1e-12")
        per_j = gains.groupBy("j").agg(F.max(F.struct("g", "i", "mi", "mj")).alias("b")).select("j", "b.*")
        pick = cut(per_j.groupBy("mi").agg(F.max(F.struct("g", "i", "j", "mj")).alias("b")).select("mi", "b.*"))
        ends = pick.select("g", "i", F.col("j").alias("c")).unionByName(pick.select("g", "i", F.col("mi").alias("c")))
        # a column may be in one swap only: the swap must win at both of its columns
        top = ends.groupBy("c").agg(F.max(F.struct("g", "i")).alias("t"))
        for col in ("j", "mi"):
            pick = pick.join(top.select(F.col("c").alias(col), F.col("t.i").alias("ti")), col).where("ti = i").drop("ti")
        pick = cut(pick)
        if pick.isEmpty():
            break
        new = pick.select(F.col("i").alias("row"), F.col("j").alias("col")).unionByName(pick.select(F.col("mj").alias("row"), F.col("mi").alias("col")))
        mates = cut(mates.join(new.select("row"), "row", "left_anti").select("row", "col").unionByName(new))
    return mates


def auction_round(a: Matrix, prices: SparseVector) -> DataFrame:
    """row, col, bid: each row bids for the column of most profit; each column keeps the highest bid."""
    profit = a.df.join(prices.df.select(F.col("i").alias("j"), F.col("v").alias("p")), "j", "left").select("i", "j", (F.col("v") - F.coalesce("p", F.lit(0))).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    w = Window.partitionBy("i").orderBy(F.desc("g"), "j")
    ranked = profit.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("g").over(w)).where("r = 1")
    bids = ranked.select("i", "j", (F.col("p") + F.col("g") - F.coalesce("second", F.lit(0))).alias("bid"))
    return bids.groupBy("j").agg(F.max(F.struct("bid", (-F.col("i")).alias("n"))).alias("b")).select((-F.col("b.n")).alias("row"), F.col("j").alias("col"), F.col("b.bid").alias("bid"))


def matching_weight(a: Matrix, matching: DataFrame) -> DataFrame:
    return a.df.join(matching.select(F.col("row").alias("i"), F.col("col").alias("j")), ["i", "j"]).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("weight"))


def is_matching(a: Matrix, matching: DataFrame) -> bool:
    n = matching.count()
    unique = matching.select("row").distinct().count() == n == matching.select("col").distinct().count()
    return unique and a.df.select(F.col("i").alias("row"), F.col("j").alias("col")).join(matching, ["row", "col"], "left_semi").count() == n


def is_maximal(a: Matrix, matching: DataFrame) -> bool:
    free = a.df.join(matching.select(F.col("row").alias("i")), "i", "left_anti").join(matching.select(F.col("col").alias("j")), "j", "left_anti")
    return free.isEmpty()


# paths

def k_tips(a: Matrix, length: int) -> DataFrame:
    """tip, vertex, step: paths of at most ``length`` edges from vertices of degree one, as long as they don't branch."""
    edges = cut(a.df.where("i <> j").select("i", "j").distinct())
    deg = cut(edges.groupBy("i").agg(F.count("*").alias("d")))
    walk = cut(deg.where("d = 1").select(F.col("i").alias("tip"), F.col("i").alias("vertex"), F.lit(-1).cast("long").alias("prev"), F.lit(0).alias("step")))
    out = walk
    for k in range(1, length + 1):
        step = walk.join(edges, walk.vertex == edges.i).where("j <> prev").select("tip", F.col("j").alias("vertex"), F.col("i").alias("prev"))
        step = step.join(deg.where("d <= 2").select(F.col("i").alias("vertex")), "vertex", "left_semi")
        walk = cut(step.select("tip", "vertex", "prev", F.lit(k).alias("step")))
        if walk.isEmpty():
            break
        out = out.unionByName(walk)
    return out.select("tip", "vertex", "step")


def shortest_paths(a: Matrix) -> Matrix:
    """All-pairs shortest distances by repeated min-plus squaring; absent pairs have no path."""
    m = M.add_loops(M.apply(a, lambda v: v.cast("double")), 0.0, replace=True)
    m = m.with_df(cut(m.df))
    reach = 1
    while reach < a.nrow:
        new = M.add(m, spgemm(m, m, MIN_PLUS_DOUBLE), F.min)
        new = new.with_df(cut(new.df))
        same = new.df.exceptAll(m.df).isEmpty()
        m, reach = new, 2 * reach
        if same:
            break
    return m
