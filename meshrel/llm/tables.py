"""Input tables, intermediate tables in the folder that all executors share, and models fitted in an executor."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or the context's checkpoint folder; a temporary one is made only on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meshrel-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else they lie there until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM give back the native memory that it has freed; False where it can't (JDK 17 on glibc can).

    Spark starts a thread for each exchange that it plans and keeps it for a minute; over many small tables there
    are hundreds, and what their allocations leave lies in the allocator's arenas, outside the heap and its collector.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    try:
        for i, kind in enumerate(kinds):
            types[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class can't be reached from outside its module
        named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshrel-{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshrel_path = path
    return out


def save_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same, in as many buckets by a key as there are shuffle partitions: joins and groups by the key exchange only the other side."""
    spark = df.sparkSession
    path, at = f"{shared_dir(spark)}/meshrel-{name}-{uuid.uuid4().hex}", f"meshrel_{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.bucketBy(parts(spark), key).option("path", path).format("parquet").saveAsTable(at)
    trim(spark)
    out = spark.table(at)
    out._meshrel_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes saved tables that nothing reads any more; anything else is passed over."""
    for df in tables:
        path = getattr(df, "_meshrel_path", None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled training texts, whole, drawn by a hash of the id: doc_id, text, lang, y.

    Only rows outside the held-out fold come in. An id counts once whatever the
    tables hold: its largest label and its smallest (text, lang).
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held))
    y = y.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    picked = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(y), "doc_id")
    once = picked.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("x"))
    return once.select("doc_id", "x.text", "x.lang", "y")


def fit_in_task(sample: DataFrame, train: Callable[[pa.Table], object]):
    """The model that ``train`` makes of a bounded sample (doc_id, ...), in order of the ids' hashes.

    One executor task gathers the sample and trains; the driver gets the model
    alone, so that its memory depends on no text.
    """
    columns = [c for c in sample.columns if c != "doc_id"]
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select(*columns)
    empty = ordered.limit(0).toArrow()

    def run(batches):
        held = list(batches)
        model = train(pa.Table.from_batches(held) if held else empty)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], ["model"])

    found = ordered.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train(empty)  # an empty sample may have no task at all
