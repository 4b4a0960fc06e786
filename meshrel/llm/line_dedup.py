"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are the \\n-split lines of all texts. Equal lines are one line of several
places. A line's set holds its character shingles of ``WIDTH`` characters; those of
them whose own hash falls to one in ``RATE`` are dealt out by that hash among
``SAMPLED_BANDS`` bands, and the signature takes the minima of ``ROWS`` hash functions
over each band's share, so what a band holds follows from what the shingles say, never
from where they stand. A share of one shingle gives no key: it would bring together all
lines with one common phrase. ``SEEN`` cells tell how many different ones were met; sets
of few (up to ``FEW`` cells) are signed over all shingles in ``BANDS`` bands, each from
minima of its own, and those in between (from ``ENOUGH``) both ways, so that alike sets
meet in one kind of signature at least. Of pairs at exactly 0.8, whole sets miss 1.4 %;
a pair that meets in samples only has 24 shingles in them or more and misses 0.3 % there
and up to 0.7 % in long lines. Lines that agree in a band are tested by the exact
Jaccard similarity of their whole sets, linked, and joined to components by
repeated contraction; the first place (smallest id, then line number) of each
component stays.

Defined cases: lines without a visible character always stay, as do rows without
an id or a text. A line shorter than ``WIDTH`` is its own only shingle. Very long
lines are taken whole. Rows that repeat an id are taken as one document (equal
rows). Further columns are kept by ``clean``. An empty table gives an empty
result. Lines are told apart by 64-bit hashes: a wrong match needs a collision,
one in 10^7 lines at 10^12 lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import link_groups
from .tables import discard, save, save_bucketed

WIDTH = 12
ROWS = 3
BANDS = 6
SAMPLED_BANDS = 7
PERCENT = 80
RATE = 4  # a power of two
SEEN = 64
ENOUGH, FEW = 13, 23  # cells filled by some 14 and 28 different shingles


def places(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, id (the line's hash) of every line that shows a character."""
    known = docs.where("doc_id is not null and text is not null")
    return known.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0).withColumn("id", F.xxhash64("line"))


def _seed(k: int) -> int:
    """Fixed odd 31-bit constants from a Weyl sequence."""
    x = (0x9E3779B9 * (k + 1)) & 0xFFFFFFFF
    x = ((x ^ (x >> 16)) * 0x45D9F3B) & 0xFFFFFFFF
    x = (x ^ (x >> 16)) & 0xFFFFFFFF
    return x >> 1 | 1


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Every distinct line: id, first (its smallest doc_id), n (its places), line; in buckets by id."""
    return save_bucketed(places(docs).groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("line").alias("line")), "lines", "id")


def signatures(lines: DataFrame, rate: int, bands: int) -> DataFrame:
    """id, cells (of ``SEEN`` filled) and the band keys k0, k1, ... from the shingles whose hash is divisible by rate; lines without one are left out.

    Over a sample, each shingle counts in one band alone, and keys of bands with less than two are null: a minimum for
    every band of every shingle would cost three times as much. Of all shingles, each counts in every band.

    Signatures, which only propose pairs, slice two bytes a character, half of what the exact test hashes. A character
    beyond U+FFFF counts as two there, so that shingles with one in them span fewer characters; a test holds their recall.
    """
    encoded = lines.select("id", F.encode("line", "UTF-16BE").alias("b"))  # before the explode: once a line
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("b") - (2 * WIDTH - 1), F.lit(1)), F.lit(2))
    h = F.hash(F.substring("b", F.col("at"), F.lit(2 * WIDTH))).cast("long")
    if rate > 1:
        h = h + 0 * F.spark_partition_id()  # adds nothing, but holds the filter above it: below, each hash that passes would be computed again
    cut = encoded.select("id", "b", F.explode(starts).alias("at")).select("id", h.alias("h"))
    # products of 32 and 31 bits can't overflow; xor with seeds would leave minima of short lines dependent
    least = [F.min((F.col("h") * F.lit(_seed(k)).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"m{k}") for k in range(ROWS if rate > 1 else ROWS * bands)]
    cell = F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(SEEN - 1)).cast("int")
    cells = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell)).alias("cells")
    if rate == 1:
        signature = cut.groupBy("id").agg(cells, *least)
        keys = [F.xxhash64(F.lit(rate), F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))).alias(f"k{b}") for b in range(bands)]
        return signature.select("id", F.bit_count("cells").alias("cells"), *keys)
    band = F.shiftright(F.shiftrightunsigned("h", 16).bitwiseAND(F.lit(0xFFFF)) * F.lit(bands), 16).cast("int")  # other bits than those of rate and cells
    shares = cut.where(F.col("h").bitwiseAND(F.lit(rate - 1)) == 0).groupBy("id", band.alias("band")).agg(cells, *least)
    key = F.when(F.bit_count("cells") > 1, F.xxhash64(F.lit(rate), "band", *(f"m{r}" for r in range(ROWS))))
    shares = shares.select("id", "band", "cells", key.alias("key"))
    return shares.groupBy("id").agg(F.bit_count(F.bit_or("cells")).alias("cells"), *(F.max(F.when(F.col("band") == b, F.col("key"))).alias(f"k{b}") for b in range(bands)))


def bands(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, id): the band keys of every distinct line; and the saved tables that they are read from."""
    sampled = save(signatures(lines, RATE, SAMPLED_BANDS), "sampled")
    # of the lines that gave no sampled shingle, or few
    few = lines.select("id", "line").join(sampled.where(F.col("cells") > FEW).select("id").hint("shuffle_hash"), "id", "left_anti")
    every = save(signatures(few, 1, BANDS), "few")
    keys = lambda n: F.explode(F.array(*(f"k{b}" for b in range(n)))).alias("key")
    dealt = sampled.where(F.col("cells") >= ENOUGH).select(keys(SAMPLED_BANDS), "id").where("key is not null")
    return dealt.unionByName(every.select(keys(BANDS), "id")), [sampled, every]


def _starts(line: str) -> Column:
    """Where each shingle starts (from 1) in the line at four bytes a character."""
    return F.sequence(F.lit(1), 4 * F.greatest(F.length(line) - (WIDTH - 1), F.lit(1)) - 3, F.lit(4))


def _hashes(line: str) -> Column:
    """Hashes of all shingles, repeats too. At four bytes a character every slice is found at once, wherever it starts."""
    at = _starts(line)
    # the outer transform encodes once; within the inner one it would happen for every slice
    return F.transform(F.array(F.encode(line, "UTF-32")), lambda b: F.transform(at, lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * WIDTH)))))[0]


def _shingles(line: str) -> Column:
    """Hashes of the distinct shingles."""
    return F.array_distinct(_hashes(line))


def texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id and payload (the text) of the lines named; the text stays in its buckets."""
    return lines.select("id", F.col("line").alias("payload")).join(ids.hint("shuffle_hash"), "id", "left_semi")


def similar(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """similarity and ok of each pair (a, b) of line hashes, from all shingles of their texts (id, payload)."""
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("payload").alias("x")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("payload").alias("y")), "b")
    sets = both.select("a", "b", _hashes("x").alias("p"), _hashes("y").alias("q"))
    common = sets.select("a", "b", F.size(F.array_intersect("p", "q")).alias("c"), F.size(F.array_union("p", "q")).alias("u"))  # both without repeats
    return common.select("a", "b", (F.col("c") / F.col("u")).alias("similarity"), (100 * F.col("c") >= percent * F.col("u")).alias("ok"))


def removed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, gone): the line numbers to drop, ascending, of each document that loses a line."""
    lines = distinct_lines(docs)
    members, read = bands(lines)
    linked = link_groups(members, lambda pairs, known: similar(pairs, known, percent), lambda ids: texts(lines, ids), _shingles("payload"), percent, read)
    several = lines.select("id", "first", "n").join(linked, "id", "left").where("component is not null or n > 1")
    several = save(several.select("id", "first", F.coalesce("component", "id").alias("group")), "several")
    first = several.groupBy("group").agg(F.min("first").alias("d"))
    wanted = save(several.select("id", "group").join(first, "group"), "wanted")
    repeated = places(docs).select("doc_id", "line_no", "id").join(wanted, "id").select("doc_id", "line_no", "group", "d")
    repeated = save(repeated.distinct(), "repeated")
    discard(lines, linked)
    # written: a join with an aggregate on one side couldn't be split where one group holds most places
    keeper = save(repeated.where("doc_id = d").groupBy("group").agg(F.min("line_no").alias("l")), "keeper")
    gone = repeated.join(keeper, "group").where("doc_id <> d or line_no <> l")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))


def summary(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed line numbers (from 0) of every row."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(removed(docs, percent), "doc_id", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, without the removed lines of their texts."""
    names, at = docs.columns, "_meshrel_gone"
    joined = docs.join(removed(docs, percent).withColumnRenamed("gone", at), "doc_id", "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(at, i))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in names))
