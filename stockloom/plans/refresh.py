"""Storing a rebuilt summary so that readers always see a whole one.

A run's files appear one by one while it is written. So a run counts only once it
is published: one small file, replaced in one step, names the current run and the few before it that are
kept. Readers look at that file and open the current run alone. A run that was published is never written again.
"""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from stockloom.sources.store import Pointer, located

TABLE = "stock_movement_summary"
PUBLISHED = f"{TABLE}_published"


def _folder(root: str, run: int) -> str:
    return os.path.join(root, TABLE, f"run={run}")


def _pointer(root: str) -> Pointer:
    return Pointer(os.path.join(root, PUBLISHED), "current.json")


def published_runs(root: str) -> list[int]:
    """Published runs that are kept, newest first."""
    return (_pointer(root).read() or {"runs": []})["runs"]


def store_summary(summary: DataFrame, root: str, run: int) -> str:
    """Write a rebuild into a folder of its own, then publish it; earlier runs stay readable meanwhile.

    Runs are numbered upwards. What a failed attempt left in the folder is overwritten.
    """
    runs = published_runs(root)
    if runs and run <= runs[0]:
        raise ValueError(f"run {run} is not after the published {runs[0]}")
    path = _folder(root, run)
    summary.write.mode("overwrite").parquet(path)
    _pointer(root).write({"runs": [run, *runs]})
    return path


def latest_summary(spark: SparkSession, root: str) -> DataFrame:
    """The newest published rebuild; no other run's folder is opened."""
    return spark.read.parquet(_folder(root, published_runs(root)[0]))


def drop_old_runs(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Delete the data of all but the newest published runs and take them off the list; returns what went.

    Call it from the job that stores, between two runs.
    """
    runs = published_runs(root)
    gone = runs[keep:]
    _pointer(root).write({"runs": runs[:keep]})  # first off the list, so that the list names nothing that is gone
    for run in gone:
        store, path = located(_folder(root, run))
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
    return gone
