"""Helpers shared by the corpus operators: shared storage, text batches, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of texts handed to a Python worker holds at most so many rows; a few very long texts then stay affordable.
BATCH_ROWS = 1000
#: ... and about so many bytes.
BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may do without the setting; it gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stockloom-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root; two runs never meet in one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in a fresh shared folder and read it back.

    Cuts the lineage: several readers share one computation and a lost executor
    costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts, by rows and by bytes."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


#: How to drop what modules keep in a worker for the next task of their own operators.
KEPT: list[Callable[[], None]] = []


def drop_kept() -> None:
    for drop in KEPT:
        drop()


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives free memory back to the system after each task.

    Workers live on for the stages that follow; what their allocators keep would add up to what those need. What
    other operators' tasks have left for their like goes first.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
        if trim:
            trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; a null counts as empty."""
    for cell in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield cell.as_py() or b""


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each starts (one more entry for the end)."""
    blobs = list(text_bytes(column))
    ends = np.cumsum([0, *map(len, blobs)], dtype=np.int64)
    return np.frombuffer(b"".join(blobs), np.uint8), ends


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (a long, b long).

    Returns (node, root): root is the smallest node of its component. Nodes
    without edges do not appear. Alternates large-star and small-star steps, so
    chains shrink exponentially; each step is stored, so no lineage builds up.
    Minima are taken by a partial aggregate and joined back, so a node with very many
    neighbours is no single group.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
