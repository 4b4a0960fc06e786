"""MinHash near-dedup by fast similarity sketching.

A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased).
The sketch has ``COORDINATES`` coordinates filled in rounds: in each of the
first rounds every shingle falls into a hashed bin with a hashed value; later
rounds visit the bins one by one, so every coordinate is filled for certain,
and a round's number is the high part of the value, so earlier rounds win.
Sketches of equal sets are equal; coordinates agree with a probability of the
similarity, with the concentration of independent hashing.

Texts whose sets have one size and equal fingerprints of 128 bits are one class
(two unlike sets among 10^10 do with odds of 10^-18). Class representatives are
banded, tested on their full sets (exact intersection and union of 64-bit
shingle hashes: a pair of sets of 10^4 shingles shares a false one with odds of
10^-11) and joined to components; copies follow their representative.

Defined cases: null texts and texts without words have an empty set and link
with nothing. Fewer words than ``width``: the whole sequence is one shingle.
A row whose id is null is its own component (null). Repeated ids with equal
rows are one row's worth of links. Further columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import link_groups
from .tables import save

COORDINATES = 252
ROWS = 6  # coordinates in a band: 42 bands find a pair of similarity 0.8 but for 4 in a million
CHUNK = 2 << 20

_bin_rng = np.random.default_rng(99)
_ROUND = _bin_rng.integers(1, 2**64, 2 * COORDINATES, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's border in them."""
    w = K.words(K.LOWER[data], offs)
    at, h = K.windows(w, width)
    row = w.text_of[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        extra = np.array([K.mix(np.add.reduce(w.hashes[w.borders[i] : w.borders[i + 1]] * K._LANE[: w.counts[i]])[None])[0] for i in short], np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, extra])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(len(offs)))


def sketch(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Texts x COORDINATES; rows of empty sets are zero."""
    t, rows = COORDINATES, len(borders) - 1
    unset = np.uint64(2**64 - 1)
    out = np.full(rows * t, unset)
    size = np.diff(borders)
    row = np.repeat(np.arange(rows), size)
    left = np.flatnonzero(size > 0)  # texts with coordinates to fill
    value_mask, top = np.uint64((1 << 54) - 1), np.uint64(54)
    for r in range(2 * t):
        if not len(left):
            break
        x = K.mix(h * _ROUND[r] + np.uint64(r))
        if r < t:
            place = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        else:
            place = np.full(len(x), r - t, np.uint64)
        at = row * t + place.astype(np.int64)
        if r:  # a coordinate filled by an earlier round stays
            free = out[at] == unset
            at, x = at[free], x[free]
        value = (np.uint64(min(r, 1000)) << top) | (K.mix(x) & value_mask)
        np.minimum.at(out, at, value)
        more = (out.reshape(rows, t)[left] == unset).any(1)
        if not more.all():
            left = left[more]
            open_ = np.zeros(rows, bool)
            open_[left] = True
            live = open_[row]
            h, row = h[live], row[live]
    out = out.reshape(rows, t)
    out[size == 0] = 0
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (fingerprint of the set), bands."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                h, borders = shingles(data, offs, width)
                size = np.diff(borders)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (h, K.mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
                prints = [K.mix(c[borders[1:]] - c[borders[:-1]] + size.astype(np.uint64)).view(np.int64) for c in total]
                s = sketch(h, borders).reshape(len(size), -1, ROWS)
                band = np.arange(1, s.shape[1] + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
                key = np.broadcast_to(band, s.shape[:2]).copy()
                for k in range(ROWS):
                    key = K.mix(key + s[:, :, k])
                n = s.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * n), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), *map(pa.array, prints), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and the ascending shingle hashes of the documents named."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in K.chunks(batch, "text", CHUNK):
                h, borders = shingles(data, offs, width)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "payload"])

    # always by shuffle: a plan that broadcasts ids while they are few would behave otherwise at size
    wanted = ids.select(F.col("id").alias("doc_id")).hint("shuffle_hash")
    text = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return text.mapInArrow(run, "id bigint, payload array<bigint>")


def similar(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """similarity and ok (100 * intersection >= percent * union) of each pair (a, b), from their full sets (id, payload)."""
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("payload").alias("x")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("payload").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("s"))
    return both.select("a", "b", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity"), (100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).alias("ok"))


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    table = save(sketches(docs, width), "sketches")
    sized = table.where("n_shingles > 0 and doc_id is not null")
    # written: a join with an aggregate on one side couldn't be split where one class holds most rows
    classes = save(sized.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "reps")
    member = save(sized.select("doc_id", "s1", "s2", "n_shingles").join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep").distinct(), "classes")
    reps = member.where("doc_id = rep").select("doc_id")
    bands = sized.join(reps, "doc_id", "left_semi").select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    linked = link_groups(bands, lambda pairs, known: similar(pairs, known, percent), lambda ids: sets(docs, ids, width), F.col("payload"), percent)
    final = member.join(linked.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("found"))
    out = table.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without the near-copies of another row of smaller id; of equal rows that share an id one stays."""
    gone = components(docs, width, percent).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = left.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates()
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again)
