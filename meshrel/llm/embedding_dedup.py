"""Embedding near-dedup by a pivot-permutation index.

``PIVOTS`` reference points (pivots) are chosen from a bounded sample by
farthest-first traversal. Their number is fixed, so whether a pair meets hangs on
the pair and the pivots alone, not on how many other vectors there are. Each
vector is described by its ``NEAREST`` pivots in order of similarity. An inverted list for every set of ``SHARED`` of
them (within a label) retrieves the vectors that share them, so two vectors meet
if their shared-pivot count reaches ``SHARED``; a pair is tested only in the list
of its first shared pivots. The test is the cosine in double precision,
summed alike in lists of any length. Lists
longer than ``BLOCK`` are dealt out as pairs of blocks. Tasks give link counts
and spanning edges, never pairs: equal vectors are one class with a size.

The index is approximate: tests hold recall against brute force at 0.9 or more
on pairs of cosines from 0.93 to 0.95. (The supplied tables of scales up to 0.1 hold no pair
at 0.93.)

Defined cases: vectors that are null, zero or hold null or non-finite
components, or whose label or id is null, link with nothing and stay. Vectors of unequal length
never link. Very long vectors are taken whole. Rows that repeat an id with an
equal vector count once. Further columns are ignored. An empty table gives an
empty result.
Broadcast: the pivots, ``PIVOTS`` vectors at most. Lists grow with their label, and
the pairs tested with the square of its size; none is passed over.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import discard, parts, save

PIVOTS = 1024
SAMPLE = 4096
NEAREST = 10
SHARED = 3
BLOCK = 1024
SMALL = 64  # lists up to so long are compared together, along their diagonals
COSINE = 0.93


def choose_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal over unit vectors."""
    if not len(vectors):
        return vectors
    picked = [0]
    near = vectors @ vectors[0]
    while len(picked) < min(count, len(vectors)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        picked.append(k)
        near = np.maximum(near, vectors @ vectors[k])
    return vectors[picked]


def _unit(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Unit vectors in double precision of a list column, padded or cut to a width (the longest)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    width = int(lens.max(initial=0)) if width is None else width
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = np.zeros((len(lens), width))
    use = at < width
    out[np.repeat(np.arange(len(lens)), lens)[use], at[use]] = flat[use]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _description(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector in order; ties by pivot number."""
    m = min(NEAREST, len(pivots))
    return np.argsort(-np.round(vectors @ pivots.T, 12), axis=1, kind="stable")[:, :m]


def compare(unit: np.ndarray, v: np.ndarray, near: np.ndarray, last: np.ndarray, own: np.ndarray, apart: np.ndarray, ids: np.ndarray, weight: np.ndarray, shared: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, smallest id reached) of the rows of whole lists that link with another row of theirs.

    unit: which list; near: nearest pivots, ascending; last: the list's last pivot;
    apart: only rows of different blocks (own) are compared.
    """
    n = len(unit)
    edge = np.append(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1)), n)
    size = np.repeat(np.diff(edge), np.diff(edge))
    within = np.arange(n) - np.repeat(edge[:-1], np.diff(edge))
    total, root = np.zeros(n, np.int64), ids.copy()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])
        pairs.append((a, b))

    step = max(1, (4 << 20) // max(1, v.shape[1]))
    for t in range(1, SMALL):
        a = np.flatnonzero((size <= SMALL) & (within + t < size))
        if not len(a):
            break
        for c in range(0, len(a), step):
            x = a[c : c + step]
            x = x[~apart[x] | (own[x] != own[x + t])]
            both = (near[x][:, :, None] == near[x + t][:, None, :]).any(2) & (near[x] <= last[x, None])
            x = x[both.sum(1) == shared]  # no further shared pivot up to the list's last: its own list
            x = x[np.einsum("ij,ij->i", v[x], v[x + t]) >= cosine]
            if len(x):
                keep(x, x + t)
    for p, q in zip(edge[:-1], edge[1:], strict=True):
        if q - p <= SMALL:
            continue
        kinds, code = np.unique(near[p:q], return_inverse=True)
        member = np.zeros((q - p, len(kinds)), np.float32)
        np.put_along_axis(member, code.reshape(q - p, -1), 1, 1)
        below = member[:, kinds <= last[p]]
        hit = (v[p:q] @ v[p:q].T >= cosine - 1e-9) & (below @ below.T <= shared + 0.5)
        hit = np.triu(hit, 1)
        if apart[p]:
            hit &= own[p:q, None] != own[None, p:q]
        a, b = np.nonzero(hit)
        for c in range(0, len(a), step):
            x, y = a[c : c + step] + p, b[c : c + step] + p
            sure = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
            keep(x[sure], y[sure])
    if pairs:
        a, b = (np.concatenate([x[i] for x in pairs]) for i in (0, 1))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
    some = total > 0
    return ids[some], total[some], root[some]


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.coalesce(e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    good = vectors.where(valid).select("vec_id", "label", "embedding").distinct()
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = save(classes, "vectors")
    drawn = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    pivots = choose_pivots(_unit(drawn)) if len(drawn) else np.zeros((0, 0))
    width, shared = pivots.shape[1], min(SHARED, NEAREST, max(1, len(pivots)))

    def describe(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                nearest = np.sort(_description(_unit(rows.column(1), width), pivots), axis=1)
                sets = np.array(list(combinations(range(nearest.shape[1]), shared)))
                code = np.zeros((len(nearest), len(sets)), np.int64)
                for k in range(shared):
                    code = code * PIVOTS + nearest[:, sets[:, k]]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (nearest.astype(np.int16), code)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *lists], ["id", "near", "codes"])

    coded = save(classes.select("id", "embedding").mapInArrow(describe, "id bigint, near array<smallint>, codes array<bigint>"), "codes")
    head = classes.select("id", "label", F.size("embedding").alias("width"))
    entry = coded.join(head, "id").select(F.explode("codes").alias("code"), "label", "width", "id").withColumn("key", F.xxhash64("label", "width", "code"))
    sizes = entry.groupBy("label", "width", "code", "key").agg(F.count("*").alias("n")).where("n > 1").select("key", "code", "n")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    shared_entries = save(entry.select("key", "id").join(sizes.select("key", "code", "blocks"), "key"), "lists")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # a row goes to every pair of blocks that its own block is in
    dealt = shared_entries.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "code", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    units = dealt.join(classes.select("id", "embedding", "size").join(coded.select("id", "near"), "id"), "id")
    units = units.repartition(parts(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "code", "id", "own", "size", "near", "embedding")

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                new = pa.Table.from_batches([batch.slice(a, 4096)])
                held = new if held is None else pa.concat_tables([held, new])
                key, lo, hi = (held.column(i).to_numpy() for i in range(3))
                # the last list may go on in the next batch
                change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
                if len(change):
                    yield from tested(held.slice(0, change[-1]))
                    held = held.slice(change[-1])
        if held is not None:
            yield from tested(held)

    def tested(rows: pa.Table):
        key, lo, hi, code, ids, own, weight = (rows.column(i).to_numpy() for i in range(7))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        near = rows.column(7).combine_chunks().flatten().to_numpy().reshape(len(key), -1).astype(np.int64)
        out = compare(np.cumsum(new), _unit(rows.column(8)), near, code % PIVOTS, own, lo != hi, ids, weight, shared, cosine)
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "n", "root"])

    found = save(units.mapInArrow(run, "id bigint, n bigint, root bigint"), "found")
    discard(coded, shared_entries)
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = found.groupBy("id").agg(F.sum("n").alias("n")).join(component, "id", "left")
    members = good.join(classes, ["label", "embedding"]).select("vec_id", "id", "size").join(per_class, "id", "left")
    linked = members.groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.min(F.coalesce("component", "id")).alias("c"))
    out = vectors.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
