"""An edge stream folded into a graph and its components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import components
from ..operators.matrix import from_edges, symmetrise
from ..plans.fixpoint import shared_dir


def windowed_counts(edges: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Edges of a stream (ts, src, dst) by window, with a watermark."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "src", "dst").agg(F.count("*").alias("n"))


def follow_components(edges: DataFrame, n: int, sink: Callable[[DataFrame, int], None], folder: str | None = None) -> StreamingQuery:
    """After each batch of edges (src, dst) the sink gets (vertex, label) of the graph so far.

    A batch is a table of its own, so a repeated batch overwrites itself. Old
    edges enter as (vertex, label) stars, so a batch costs what its graph holds.
    """
    spark: SparkSession = edges.sparkSession
    base = folder or f"{shared_dir(spark)}/meshrel-stream-{uuid.uuid4().hex}"

    def fold(batch: DataFrame, epoch: int) -> None:
        new = batch.select("src", "dst")
        if epoch > 0:
            old = spark.read.parquet(f"{base}/labels-{epoch - 1}")
            new = new.unionByName(old.where("vertex <> label").select(F.col("vertex").alias("src"), F.col("label").alias("dst")))
        labels = components(symmetrise(from_edges(new, n)))
        labels.write.mode("overwrite").parquet(f"{base}/labels-{epoch}")
        sink(spark.read.parquet(f"{base}/labels-{epoch}"), epoch)

    return edges.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/state").start()
