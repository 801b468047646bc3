"""Importance resampling of documents towards the distribution of a target text collection.

N-grams are hashed to buckets. A bucket's gain is the log ratio of its smoothed share in the target and in
the documents; a document's weight is the sum over its n-grams. Weight plus
noise of a Gumbel distribution, fixed by seed and doc_id, ranks the documents; the highest are a
sample without replacement in proportion to the exponential of the weights.

Two passes over the texts, each in the tasks that read them: bucket counts, of which a task sends
at most one row a bucket, and weights. In a batch each distinct n-gram is interned once
(`ngramtable`), and occurrences gather their gain by slot. The gains
are one number a bucket, so their size is that of the parameter `buckets`.

The ranks come from a range partitioning of scores and the number of rows in each range: no
task holds the whole order, and a score that very many share is cut by doc_id.

A null text has no words. A null doc_id draws its noise as an empty one and comes after others
of its score; rows that repeat a doc_id each take part. Without eligible documents none is drawn. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stockloom.llm.common import small_text_batches, stored, table, text_bytes
from stockloom.llm.ngramtable import CHUNK, Table, grams

#: Production parameters: longest n-gram, buckets, least words of a document that may be drawn, share drawn in percent, seed.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def interned(texts: Iterator[bytes], longest: int, tab: Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(slots, number of the text, words of each text so far) of the n-grams of a batch, some at a time."""
    items: list[bytes] = []
    owner: list[np.ndarray] = []
    words: list[int] = []

    def flush() -> tuple[np.ndarray, np.ndarray, list[int]]:
        got = tab.intern(items), np.concatenate(owner), words
        items.clear()
        owner.clear()
        return got

    for i, text in enumerate(texts):
        words.append(0)
        for n, own in grams(text, longest):
            words[i] += n
            items.extend(own)
            owner.append(np.full(len(own), i))
            if len(items) >= CHUNK:
                yield flush()
    yield flush() if items else (np.zeros(0, np.int64), np.zeros(0, np.int64), words)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; the driver gets one row a bucket."""
    small_text_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            tab = Table(buckets)
            for _ in interned(text_bytes(b.column(0)), longest, tab):
                pass
            total += tab.bucket_counts()
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of target share over source share, each bucket counted once more, rounded down."""
    every, wanted = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tab = Table(len(gain))
            features, weight = np.zeros((2, b.num_rows), np.int64)
            words: list[int] = []
            for slots, owner, words in interned(text_bytes(b.column(1)), longest, tab):
                np.add.at(features, owner, 1)
                np.add.at(weight, owner, gain[tab.bucket[slots]])
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scores(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Weights of all documents against a target table with a column text, and their noisy score."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    return weights(docs, gain, longest).withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, label: str = "ranked") -> DataFrame:
    """Stored rows (doc_id, score, ...) with rank 1, 2, ... by descending score, then doc_id.

    Rows must not change between two reads: ranges are fitted to them first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart too, so that no range has to hold them all
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(np.arange(before, before + b.num_rows))
            before += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), place], names=[*b.schema.names, "part", "place"])

    placed = stored(dealt.mapInArrow(run, StructType([*dealt.schema, StructField("part", LongType()), StructField("place", LongType())])), label)
    # one number for each range, whatever the number of rows
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()))
    starts = rows.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("before") + F.col("place") + 1).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its score, and rank where it is drawn: `percent` of those with at least `least_words` words."""
    scored = stored(scores(docs, target, longest, buckets, seed), "resample-scores")
    may = scored.where(F.col("n_words") >= least_words)
    number = percent * may.count() // 100
    in_order = ranked(may, "resample-ranked").withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))
    return in_order.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Contract query: unigrams of all documents against all benchmark texts."""
    got = drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def _words(name: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""SELECT row, UNNEST(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
    FROM (SELECT row_number() OVER () AS row, text FROM {name})"""


SQL = f"""WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i,
    list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
doc_words AS ({_words("documents")}), target_words AS ({_words("benchmark")}),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda p: CAST('0x' || h[p:p + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM (SELECT w, hex(w) AS h FROM doc_words UNION SELECT w, hex(w) FROM target_words), crc),
s AS (SELECT bucket, COUNT(*) AS n FROM doc_words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS n FROM target_words JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(COALESCE(t.n, 0) + 1 AS DOUBLE) * ((SELECT COUNT(*) FROM doc_words) + {BUCKETS})
    / (CAST(s.n + 1 AS DOUBLE) * ((SELECT COUNT(*) FROM target_words) + {BUCKETS})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, COUNT(*) AS n, CAST(SUM(g) AS BIGINT) AS weight FROM doc_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, COALESCE(n, 0) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || sha256('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN weighed USING (row)),
ordered AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS k, COUNT(*) OVER () AS every FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * every // 100 THEN k END AS rank FROM scored LEFT JOIN ordered USING (row)"""
