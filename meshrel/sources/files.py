"""Readers and writers: Matrix Market, labelled triples, coordinate text, legacy binary, vectors, clusters."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import _numbered, merge_duplicates
from ..types import Matrix, SparseVector

#: Fixed values of the binary format: magic and header (version, object size, format, rows, columns, entries).
BINARY_MAGIC = b"HKDT"
BINARY_HEADER = struct.Struct("<4s6Q")
BINARY_RECORD = np.dtype([("i", "<i8"), ("j", "<i8"), ("v", "<f8")])


def _after_header(spark: SparkSession, path: str) -> tuple[str, str, DataFrame]:
    """The banner, the first line that is no comment, and all lines after that one (value).

    A folder of parts has both in its first file by name. The line is told by its
    place among that file's lines, so that an equal line further on stays.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise ValueError(f"nothing to read in {path}")
    full = lambda at: spark.read.text(at).where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    for k, first in enumerate(files):  # a part may be empty
        top = [r[0] for r in spark.read.text(first).limit(1).collect()]
        if top:
            break
    else:
        raise ValueError(f"nothing to read in {path}")
    placed = full(first).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    head = placed.orderBy("b", "n").limit(1).collect()
    if not head:
        raise ValueError(f"no size line in {first}")
    body = placed.where(F.col("n") != head[0]["n"]).select("value")
    if files[k + 1 :]:
        body = body.unionByName(full(files[k + 1 :]))
    return top[0] if top[0].startswith("%%") else "", head[0]["value"], body


def read_matrix_market(spark: SparkSession, path: str, one_based: bool = True, agg: Callable = F.sum) -> Matrix:
    """Coordinate files, or folders of parts as the writer gives: real, integer or pattern; symmetric ones are mirrored; repeats are aggregated.

    The first lines give banner and sizes; a file without a banner is general and real.
    """
    top, size, rows = _after_header(spark, path)
    banner = top.lower().split()
    if banner and (banner[2] != "coordinate" or "complex" in banner):
        raise ValueError("only real, integer and pattern coordinate files are supported")
    nrow, ncol, _ = (int(x) for x in size.split())
    f = F.split(F.trim("value"), r"\s+")
    shift = 1 if one_based else 0
    pattern = "pattern" in banner
    df = rows.select((f[0].cast("long") - shift).alias("i"), (f[1].cast("long") - shift).alias("j"), (F.lit(1.0) if pattern else f[2].cast("double")).alias("v"))
    if any(x in banner for x in ("symmetric", "hermitian", "skew-symmetric")):
        sign = -1 if "skew-symmetric" in banner else 1
        df = df.unionByName(df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("v")).alias("v")))
    return merge_duplicates(df, nrow, ncol, agg)


def write_matrix_market(a: Matrix, path: str, one_based: bool = True) -> None:
    """One folder of text parts, the header in the first."""
    shift = 1 if one_based else 0
    spark = a.df.sparkSession
    head = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate real general\n{a.nrow} {a.ncol} {a.nnz()}")], "n long, value string")  # one row: both lines in one part
    body = a.df.select(F.lit(1).cast("long").alias("n"), F.concat_ws(" ", F.col("i") + shift, F.col("j") + shift, "v").alias("value"))
    head.unionByName(body).repartitionByRange("n", "value").sortWithinPartitions("n").select("value").write.text(path)


def read_labelled_triples(spark: SparkSession, path: str, agg: Callable = F.sum) -> tuple[Matrix, DataFrame]:
    """Lines ``source target [weight]`` with string labels: the matrix and (i, label). Numbers follow a hash of the label."""
    f = F.split(F.trim("value"), r"\s+")
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(f[0].alias("s"), f[1].alias("t"), F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))
    labels = raw.select(F.col("s").alias("label")).unionByName(raw.select(F.col("t").alias("label"))).distinct()
    names = _numbered(labels.withColumn("h", F.xxhash64("label")), ["h", "label"], "i").select("i", "label")
    n = names.count()
    df = raw.join(names.select("i", F.col("label").alias("s")), "s").join(names.select(F.col("i").alias("j"), F.col("label").alias("t")), "t")
    return merge_duplicates(df.select("i", "j", "v"), n, n, agg), names


def read_coordinates(spark: SparkSession, path: str, nrow: int | None = None, ncol: int | None = None, parse: Callable[[Column], dict[str, Column]] | None = None, one_based: bool = False, transpose: bool = False, no_value=1.0, agg: Callable = F.sum) -> Matrix:
    """Text rows ``i j [value]``; parse maps the fields to columns i, j, v. Without sizes the first line gives them (rows, columns, entries)."""
    f = F.split(F.trim("value"), r"\s+")
    shift = 1 if one_based else 0
    cols = parse(f) if parse else {"i": f[0].cast("long") - shift, "j": f[1].cast("long") - shift, "v": F.coalesce(F.get(f, F.lit(2)).cast("double"), F.lit(no_value))}
    if nrow is None or ncol is None:
        _, head, lines = _after_header(spark, path)
        nrow, ncol = (int(x) for x in head.split()[:2])
    else:
        lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    df = lines.select(*(c.alias(k) for k, c in cols.items()))
    if transpose:
        df = df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        nrow, ncol = ncol, nrow
    return merge_duplicates(df, nrow, ncol, agg)


def parse_attributed_edge(f: Column) -> dict[str, Column]:
    """Fields ``i j follower count [date time]`` as an edge struct; the time is there if the count is over 0."""
    count = f[3].cast("smallint")
    latest = F.when(count > 0, F.try_to_timestamp(F.concat_ws(" ", F.get(f, F.lit(4)), F.get(f, F.lit(5)))))
    return {"i": f[0].cast("long"), "j": f[1].cast("long"), "v": F.struct((f[2].cast("int") == 1).alias("follower"), latest.alias("latest"), count.alias("count"))}


def write_gathered(a: Matrix, path: str, one_based: bool = False, transpose: bool = False) -> None:
    """All entries in one text file; for small matrices that a person reads."""
    shift = 1 if one_based else 0
    i, j = ("j", "i") if transpose else ("i", "j")
    a.df.orderBy(j, i).select(F.concat_ws("\t", F.col(i) + shift, F.col(j) + shift, "v").alias("value")).coalesce(1).write.text(path)


def write_binary(a: Matrix, folder: str) -> None:
    """The scalable binary form: Parquet rows (i, j, v)."""
    a.df.select("i", "j", F.col("v").cast("double").alias("v")).write.parquet(folder)


def binary_bytes(a: Matrix, bound: int = 1 << 22) -> bytes:
    """The legacy one-file binary form of a matrix of at most ``bound`` entries."""
    rows = a.df.select("i", "j", F.col("v").cast("double").alias("v")).orderBy("j", "i").limit(bound + 1).toPandas()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} entries: write Parquet instead")
    body = np.rec.fromarrays([rows["i"], rows["j"], rows["v"]], dtype=BINARY_RECORD).tobytes()
    return BINARY_HEADER.pack(BINARY_MAGIC, 1, BINARY_RECORD.itemsize, 0, a.nrow, a.ncol, len(rows)) + body


def read_binary(spark: SparkSession, path: str) -> Matrix:
    """Legacy binary files: 52 bytes of header, then (i, j, v) records; a task reads each file."""
    files = spark.read.format("binaryFile").load(path)
    heads = [BINARY_HEADER.unpack(bytes(r[0])) for r in files.select(F.substring("content", 1, BINARY_HEADER.size)).collect()]
    if not heads or any(h[0] != BINARY_MAGIC for h in heads):
        raise ValueError("not a binary matrix file")

    skip = BINARY_HEADER.size

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                x = np.frombuffer(content, BINARY_RECORD, offset=skip)
                yield pd.DataFrame({"i": x["i"], "j": x["j"], "v": x["v"]})

    df = files.select("content").mapInPandas(records, "i long, j long, v double")
    return Matrix(df, max(h[4] for h in heads), max(h[5] for h in heads))


def read_vector(spark: SparkSession, path: str, n: int | None = None, one_based: bool = False, agg: Callable = F.sum) -> SparseVector:
    """Rows ``index value``; repeats are aggregated. Without a length the first line gives it (length, entries)."""
    f = F.split(F.trim("value"), r"\s+")
    if n is None:
        _, head, lines = _after_header(spark, path)
        n = int(head.split()[0])
    else:
        lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    df = lines.select((f[0].cast("long") - int(one_based)).alias("i"), f[1].cast("double").alias("v"))
    return SparseVector(df.groupBy("i").agg(agg("v").alias("v")), n)


def write_vector(x: SparseVector, path: str, one_based: bool = False, indices: bool = True, header: bool = False, gathered: bool = False) -> None:
    """Rows ``index value`` in order; with a header, the first part begins with length and entries; gathered: in one file."""
    fields = ([F.col("i") + int(one_based)] if indices else []) + [F.col("v")]
    rows = x.df.select("i", F.concat_ws("\t", *fields).alias("value"))
    if header:
        rows = x.df.sparkSession.createDataFrame([(-1, f"{x.n}\t{x.df.count()}")], "i long, value string").unionByName(rows)
    placed = rows.repartition(1) if gathered else rows.repartitionByRange("i")
    placed.sortWithinPartitions("i").select("value").write.text(path)


def read_binary_edges(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """(src, dst) from files of fixed records: two little-endian integers of 8 or 4 bytes, no header; files are split between tasks."""
    kind = {8: "<i8", 4: "<i4"}[width]
    records = spark.sparkContext.binaryRecords(path, 2 * width)  # no DataFrame source splits binary files

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["r"]), kind).reshape(-1, 2).astype(np.int64)
            yield pd.DataFrame({"src": x[:, 0], "dst": x[:, 1]})

    return spark.createDataFrame(records.map(lambda r: (r,)), "r binary").mapInPandas(pairs, "src long, dst long")


def edge_bytes(edges: DataFrame, width: int = 8, bound: int = 1 << 24) -> bytes:
    """The same binary form of at most ``bound`` edges; larger lists are written as Parquet."""
    rows = edges.select("src", "dst").limit(bound + 1).toPandas()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} edges: write Parquet instead")
    return rows.to_numpy().astype({8: "<i8", 4: "<i4"}[width]).tobytes()


def write_clusters(labels: DataFrame, path: str) -> None:
    """A cluster in each line, its vertices separated by spaces."""
    labels.groupBy("label").agg(F.array_sort(F.collect_list("vertex")).alias("m")).select(F.concat_ws(" ", F.transform("m", lambda x: x.cast("string"))).alias("value")).write.text(path)
