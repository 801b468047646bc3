"""Text search without reading every name: stored trigrams for needles, keyed trigrams for many patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.expr import like_text
from stockloom.sources.store import PartStore, bucket_of

GRAM = 3
#: Rarest grams of a needle whose lists are intersected; the candidates are verified in any case.
RAREST = 3
SCHEMAS = {"postings": "gram string, id string", "counts": "gram string, n long"}


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct substrings of n characters; none of a shorter text or null."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: text.substr(i, F.lit(n)))), F.array().cast("array<string>"))


class SearchIndex:
    """Trigram lists of some text columns of a table, in hash buckets of the trigram.

    A gram that very many rows have is spread over several files of its bucket. Rows
    added after the last build are not found; rows that have changed or gone since are verified like all.
    """

    def __init__(self, spark, root: str, columns: list[str], key: str = "stock_id", buckets: int = 64):
        self.store = PartStore(spark, root, SCHEMAS)
        self.columns, self.key = columns, key
        self.buckets = self.store.current()["notes"].get("buckets", buckets)

    def build(self, df: DataFrame, version: int) -> None:
        """Index all rows; readers of the index before go on with that."""
        every = F.flatten(F.array(*[grams(F.lower(F.col(c).cast("string"))) for c in self.columns]))
        rows = df.select(F.col(self.key).cast("string").alias("id"), F.explode(F.array_distinct(every)).alias("gram"))
        postings = self.store.write("postings", rows.withColumn("part", bucket_of("gram", self.buckets)), "id")
        counted = self.store.read("postings", folders=postings).groupBy("gram").agg(F.count("id").alias("n"))
        counts = self.store.write("counts", counted.withColumn("part", bucket_of("gram", self.buckets)), "gram")
        every_part = [str(b) for b in range(self.buckets)]
        self.store.publish(version, {"postings": (every_part, postings), "counts": (every_part, counts)}, {"buckets": self.buckets})

    def candidates(self, needle: str) -> DataFrame | None:
        """(id) of rows that may hold the needle; None if it has no trigram, so that all rows may."""
        spark = self.store.spark
        pieces = [p for p in re.split(r"\\.|[%_\\]", needle) if len(p) >= GRAM]  # between the wildcards of LIKE
        if not pieces:
            return None
        wanted = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.explode(grams(F.lower("p"))).alias("gram")).distinct()
        # as many rows as the needle has grams
        placed = wanted.select("gram", bucket_of("gram", self.buckets).alias("part")).collect()
        if not placed:
            return None
        found = self.store.read("counts", sorted({r.part for r in placed})).filter(F.col("gram").isin([r.gram for r in placed])).orderBy("n", "gram").collect()
        if len(found) < len(placed):
            return spark.createDataFrame([], "id string")
        rarest = [r.gram for r in found[:RAREST]]
        lists = self.store.read("postings", sorted({r.part for r in placed if r.gram in rarest})).filter(F.col("gram").isin(rarest))
        return lists.groupBy("id").agg(F.count("gram").alias("n")).filter(F.col("n") == len(rarest)).select("id")

    def search(self, df: DataFrame, needle: str) -> DataFrame:
        """Rows of the table whose columns hold the needle in either case, as a scan with ILIKE gives them."""
        may = self.candidates(needle)
        if may is not None:
            df = df.join(may.withColumnRenamed("id", self.key), self.key, "left_semi")
        return df.filter(like_text(self.columns, needle))


def matched(df: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str = "pattern", shortest: int = GRAM, salts: int = 8) -> DataFrame:
    """(key) of rows whose text, in upper case, holds one of very many patterns; one row a key.

    A pattern can only lie where its first characters are. So patterns are keyed by these, texts by all
    their substrings of that length, and what an equi-join brings together is verified; the work
    grows with the texts, not with texts times patterns. `shortest` is the least length of a pattern (shorter ones are
    ignored). Both sides are salted by the key, as one substring may be in a third of the texts. Both are sorted and
    merged: Spark takes exploded substrings for as small as the texts, and would gather them on the driver to broadcast them.
    """
    given = patterns.select(F.col(pattern).alias("p")).filter(F.length("p") >= shortest).distinct()
    # patterns of one key that begin alike in twice its length share a list; so lists stay short
    keyed = given.groupBy(F.substring("p", 1, GRAM).alias("gram"), F.substring("p", 1, 2 * GRAM)).agg(F.collect_list("p").alias("ps")).select("gram", "ps")
    keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    upper = F.upper(F.col(text))
    every = F.flatten(F.array(*[grams(upper, n) for n in range(min(shortest, GRAM), GRAM + 1)]))
    rows = df.select(F.col(key), upper.alias("t"), F.explode(F.array_distinct(every)).alias("gram")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    both = rows.hint("merge").join(keyed, ["gram", "salt"])
    return both.filter(F.exists("ps", lambda p: F.contains(F.col("t"), p))).select(key).distinct()
