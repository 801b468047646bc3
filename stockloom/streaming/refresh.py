"""Keeping the movement summary fresh from arriving sales lines.

The summary is meant to be rebuilt every minute. Re-reading a year of sales
for that would not scale, so each micro-batch is reduced to the day grain and
stored; a refresh then reads day sums, never sales lines. With them each batch stores
the sets of its selling days, which give day counts without the day grain.

A batch has a folder of its own. Compaction merges those of many batches into one and
swaps a small list in one step: it names the merged folders and, for each run, the last batch they
cover. Readers take the merged folders and the batches after those, so they see each line once, whenever they look.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom.functions import sets
from stockloom.functions.expr import days_before
from stockloom.plans.summary import movement_summary
from stockloom.sources.store import Pointer, located

CADENCE = "60 seconds"
SUMS = "stock_id string, uom_id string, doc_date date, qty decimal(28,4), rev decimal(28,4), gp decimal(38,8), month date"
DAYS = "stock_id string, word int, bits bigint"
BATCH = ", run string, batch_id bigint"
# Spark does not list folders whose name starts with an underscore
LIST, MERGED = "_compaction", "_merged"


def day_sums(lines: DataFrame) -> DataFrame:
    """Cash lines of a batch per (stock, unit, day)."""
    cash = lines.filter(F.col("channel") == "CASH")
    return cash.groupBy("stock_id", "uom_id", "doc_date").agg(
        F.sum("qty").cast("decimal(28,4)").alias("qty"),
        F.sum("amount").cast("decimal(28,4)").alias("rev"),
        F.sum(F.col("amount") - F.col("qty") * F.col("unit_cost")).cast("decimal(38,8)").alias("gp"),
    ).withColumn("month", F.trunc("doc_date", "month"))


def selling_days(sold: DataFrame) -> DataFrame:
    """The set of days with rows, of cash lines or their day sums, per stock."""
    return sets.sets(sold, ["stock_id"], sets.day_number(F.col("doc_date")))


def _run_id(grain_root: str, checkpoint: str, another_source: bool) -> str:
    """The name under which a stream stores its batches; it lives as long as its checkpoint.

    A fresh checkpoint counts batches from 0 and reads its source from the
    start: under the old name it would overwrite old batches, under a new one count lines twice. So it is
    refused a root that already has sums, unless the caller says the source is another one.
    """
    note = Pointer(checkpoint, "day-sums-run.json")
    known = note.read()
    if known:
        return known["run"]
    store, path = located(grain_root)
    if not another_source and store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        raise ValueError(f"{grain_root} already has day sums of another checkpoint; restore that one, or take an empty root")
    run = uuid.uuid4().hex
    note.write({"run": run})
    return run


def store_day_sums(lines: DataFrame, grain_root: str, checkpoint: str, trigger: dict | None = None, another_source: bool = False) -> StreamingQuery:
    """Start storing day sums and selling days of a stream of sales lines.

    Each batch of a run owns one folder and overwrites it, so a batch replayed after a
    failure leaves the same sums. `another_source` lets a second stream, of other lines, store beside the first.
    """
    run = _run_id(grain_root, checkpoint, another_source)

    def store(batch: DataFrame, batch_id: int) -> None:
        own = f"run={run}/batch_id={batch_id}"
        day_sums(batch).write.mode("overwrite").partitionBy("month").parquet(f"{grain_root}/sums/{own}")
        # from the sums just stored, so that the batch is read once
        stored = lines.sparkSession.read.schema(SUMS).parquet(f"{grain_root}/sums/{own}")
        selling_days(stored).write.mode("overwrite").parquet(f"{grain_root}/days/{own}")

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": CADENCE})).start()


def _covered(grain_root: str) -> dict:
    """{"sums": folder, "days": folder, "until": {run: last batch}} of the last compaction."""
    return Pointer(f"{grain_root}/{LIST}", "current.json").read() or {"sums": None, "days": None, "until": {}}


def _stored(spark: SparkSession, grain_root: str, table: str, schema: str, covered: dict) -> DataFrame:
    """Rows of all batches: the merged ones and those after them, whose folders alone are opened."""
    batches = spark.read.schema(schema + BATCH).parquet(f"{grain_root}/{table}")
    for run, last in covered["until"].items():
        batches = batches.filter((F.col("run") != run) | (F.col("batch_id") > last))
    batches = batches.drop("run", "batch_id")
    return batches.unionByName(spark.read.schema(schema).parquet(f"{grain_root}/{covered[table]}")) if covered[table] else batches


def compact(spark: SparkSession, grain_root: str) -> dict[str, int]:
    """Merge all batches that are complete into one folder; returns the last batch covered of each run.

    A run's last batch may still be being written, so it is left for the next compaction. Nothing
    is deleted: readers that looked before go on undisturbed, and `drop_covered` removes the folders later.
    """
    old = _covered(grain_root)
    store, path = located(grain_root)
    until = dict(old["until"])
    for run in store.get_file_info(fs.FileSelector(f"{path}/days", allow_not_found=True)):
        ids = [int(b.base_name.split("=")[1]) for b in store.get_file_info(fs.FileSelector(run.path)) if b.base_name.startswith("batch_id=")] if "=" in run.base_name else []
        if len(ids) > 1:
            name = run.base_name.split("=")[1]
            until[name] = max(until.get(name, -1), sorted(ids)[-2])
    if until == old["until"]:
        return until
    fresh = f"{MERGED}/{uuid.uuid4().hex}"
    for table, schema in (("sums", SUMS), ("days", DAYS)):
        rows = spark.read.schema(schema + BATCH).parquet(f"{grain_root}/{table}")
        wanted = F.lit(False)
        for run, last in until.items():
            wanted = wanted | ((F.col("run") == run) & (F.col("batch_id") <= last) & (F.col("batch_id") > old["until"].get(run, -1)))
        rows = rows.filter(wanted).drop("run", "batch_id")
        if old[table]:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{grain_root}/{old[table]}"))
        if table == "sums":
            merged = rows.groupBy("stock_id", "uom_id", "doc_date", "month").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in ("qty", "rev", "gp")])
            merged.repartition("month", "stock_id").write.partitionBy("month").parquet(f"{grain_root}/{fresh}/sums")
        else:
            sets.union(rows, ["stock_id"]).write.parquet(f"{grain_root}/{fresh}/days")
    Pointer(f"{grain_root}/{LIST}", "current.json").write({"sums": f"{fresh}/sums", "days": f"{fresh}/days", "until": until})
    return until


def drop_covered(grain_root: str) -> int:
    """Delete batch folders that the last compaction covers, and merged folders before it; returns how many went.

    To be called well after the compaction, when no reader still uses the older list. The newest covered batch of a run stays, so that
    a restarted stream finds its root in use.
    """
    covered, gone = _covered(grain_root), 0
    store, path = located(grain_root)
    for table in ("sums", "days"):
        for run in store.get_file_info(fs.FileSelector(f"{path}/{table}", allow_not_found=True)):
            last = covered["until"].get(run.base_name.removeprefix("run="))
            for b in store.get_file_info(fs.FileSelector(run.path)) if last is not None else []:
                if b.base_name.startswith("batch_id=") and int(b.base_name.split("=")[1]) < last:
                    store.delete_dir(b.path)
                    gone += 1
    current = (covered["sums"] or "/").split("/")[1]
    for merged in store.get_file_info(fs.FileSelector(f"{path}/{MERGED}", allow_not_found=True)):
        if merged.base_name != current:
            store.delete_dir(merged.path)
            gone += 1
    return gone


def read_day_sums(spark: SparkSession, grain_root: str, as_of) -> DataFrame:
    """The last year's day grain over all stored batches; older month folders are not read."""
    since = days_before(as_of, 365)
    stored = _stored(spark, grain_root, "sums", SUMS, _covered(grain_root))
    year = stored.filter((F.col("month") >= F.trunc(since, "month")) & (F.col("doc_date") >= since))
    return year.groupBy("stock_id", "uom_id", "doc_date").agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), F.sum("gp").alias("gp"))


def read_selling_days(spark: SparkSession, grain_root: str, as_of, windows=(30, 90)) -> DataFrame:
    """SMR-1's selling days per stock from the sets of all stored batches; no day grain is read."""
    stored = _stored(spark, grain_root, "days", DAYS, _covered(grain_root))
    return count_days(sets.union(stored, ["stock_id"]), as_of, windows)


def count_days(days: DataFrame, as_of, windows=(30, 90)) -> DataFrame:
    """Days of the last year on which a stock sold, by window, from its set; stocks without any are left out."""
    since = lambda n: sets.day_number(days_before(as_of, n)).cast("long")
    counted = days.groupBy("stock_id").agg(sets.members(since(365)).alias("year"), *[sets.members(since(n)).alias(f"selling_days_{n}d") for n in windows])
    return counted.filter("year > 0").drop("year")


def refreshed_summary(T, grain_root: str, as_of, spark: SparkSession) -> DataFrame:
    """The movement summary from stored day sums and the current dimension tables."""
    return movement_summary(T, as_of, grain=read_day_sums(spark, grain_root, as_of))
