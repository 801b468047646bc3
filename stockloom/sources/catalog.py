"""Canonical tables on Parquet, and the database connector.

Large facts are stored by month; operators over a period filter on that month
too, so they read only the folders they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from stockloom.sources.schemas import SCHEMAS

# facts stored by month of their date column
MONTHLY = {"sales_line": "doc_date", "stock_ledger": "doc_date", "supplier_invoice_line": "doc_date"}


class Tables:
    """The canonical tables by name; operators read only the ones they use."""

    def __init__(self, **frames: DataFrame):
        for name, frame in frames.items():
            setattr(self, name, frame)

    def sales(self, costed: bool = False) -> DataFrame:
        """Sales lines; a source that must join for line cost does so only when asked."""
        return self.sales_line


class SomeLines(Tables):
    """The tables of another source, of whose sales lines only some have arrived."""

    def __init__(self, T: Tables, arrived):
        self._all, self._arrived = T, arrived

    def sales(self, costed: bool = False) -> DataFrame:
        return self._all.sales(costed).filter(self._arrived)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.sales(True) if name == "sales_line" else getattr(self._all, name)


class ParquetTables(Tables):
    """Tables kept as one Parquet folder per name under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self._spark, self._root, name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        schema = SCHEMAS[name]
        if name in MONTHLY:
            schema = StructType(schema.fields + [StructField("month", DateType())])
        reader = reader.schema(schema)
    return reader.parquet(os.path.join(root, name))


def write_table(df: DataFrame, root: str, name: str) -> str:
    """Overwrite one table; monthly facts go one folder per month."""
    path = os.path.join(root, name)
    if name in MONTHLY:
        df = df.withColumn("month", F.trunc(MONTHLY[name], "month"))
        # hash on month and stock keeps a hot month spread over many writers
        df.repartition("month", "stock_id").write.mode("overwrite").partitionBy("month").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def jdbc_options(url: str, table: str, column: str, lower, upper, partitions: int, **extra) -> dict:
    """Options for a parallel database read split over a numeric or date column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
        **{k: str(v) for k, v in extra.items()},
    }


def read_jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    """Read a source table over JDBC in parallel slices (needs the driver jar)."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()
