"""How quality filters interact: what each removes, in every order they could be applied in.

A document is a set of failed filters, its mask. In one order a document goes at the least
position among the filters it fails; for all orders and masks at once that is a product of
matrices over (min, +): masks, with 0 for a failed filter and infinity for another, by the
inverse permutations' positions. So documents are only counted, by part and mask, and
the counts are scattered to the steps at which they go.

Every text is read once, in the task that reads its split, and becomes its mask without the filter for
repeats and a digest; texts are not shuffled. A text repeats if its smallest doc_id is another
one. Those that do not repeat are found by an equi-join of digest *and* doc_id with the smallest
doc_id of each digest: a digest that very many documents share is spread by their ids. Labels are joined on the doc_id.

A null text is empty, a null source the empty string. A null doc_id is smaller than none: it repeats every
id that has its text, and others with null do not repeat it. Rows that repeat a doc_id are
documents each. A document counts as labelled if any label row of its id says so. An empty table has no parts.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, stored, table, text_bytes


@dataclass(frozen=True)
class Filter:
    """A named filter; `fails` judges the words and the whole UTF-8 text. Without it, it fails texts of a smaller doc_id."""

    name: str
    fails: Callable[[list[bytes], bytes], bool] | None


CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUED = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def points(text: bytes) -> int:
    return len(text.translate(None, CONTINUED))


# --- Fixed values: the filters of the production audit -----------------------
FILTERS = [
    Filter("A", lambda words, text: len(words) < 50),
    Filter("B", lambda words, text: 100 * len(set(words)) < 65 * len(words)),
    Filter("C", lambda words, text: 100 * len(text.translate(None, CAPITALS)) > 5 * points(text)),
    Filter("D", lambda words, text: SIGNS.search(text) is not None),
    Filter("E", None),
]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def judged(docs: DataFrame, filters: list[Filter], text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, digest): the filters that a text alone fails, one bit each."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, digests = [], []
            for whole in text_bytes(b.column(2)):
                words = whole.split()  # bytes are split at ASCII white space alone
                masks.append(sum(1 << i for i, f in enumerate(filters) if f.fails and f.fails(words, whole)))
                digests.append(hashlib.sha256(whole).digest())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def counted(docs: DataFrame, labels: DataFrame, filters: list[Filter]) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of a mask."""
    repeat = [i for i, f in enumerate(filters) if f.fails is None]
    if len(repeat) > 1:
        raise ValueError("one filter for repeats is enough")
    rows = stored(judged(docs, filters), "audit-masks")
    if repeat:
        least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
        first = F.col("a.digest") == F.col("b.digest")
        first &= F.col("a.doc_id").eqNullSafe(F.col("b.least"))
        rows = rows.alias("a").join(least.alias("b"), first, "left").select("a.doc_id", "a.part", F.when(F.col("b.digest").isNull(), F.col("a.mask") + F.lit(1 << repeat[0])).otherwise(F.col("a.mask")).alias("mask"))
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("q"), F.max((F.col("toxic") == 1).cast("long")).alias("t"))
    return rows.join(says, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("good"), F.coalesce(F.sum("t"), F.lit(0)).alias("toxic")
    )


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): each order of the filters, and by order and mask the step at which a document goes; 0 for never.

    The minimum over filters of (0 if failed, else infinity) + position is the (min, +) product.
    """
    orders = np.array(list(permutations(range(filters))))
    position = np.argsort(orders, axis=1) + 1  # inverse permutations
    failed = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
    never = filters + 1
    step = np.full((len(orders), 1 << filters), never)
    for f in range(filters):
        np.minimum(step, position[:, f, None] + np.where(failed[:, f], 0, never)[None, :], out=step)
    return orders, np.where(step == never, 0, step)


def interactions(tally: np.ndarray, filters: int) -> np.ndarray:
    """Counts by (part, order, step, COUNTS) from a tally by (part, mask, (n, good, toxic))."""
    orders, step = removal_steps(filters)
    parts, masks = tally.shape[0], np.arange(tally.shape[1])
    # by order and step: what goes there, scattered from the masks
    gone = np.zeros((parts, len(orders), filters + 1, 3), np.int64)
    for o in range(len(orders)):
        np.add.at(gone[:, o], (slice(None), step[o]), tally)
    out = np.zeros((parts, len(orders), filters, len(COUNTS)), np.int64)
    removed = gone[:, :, 1:]
    out[..., 0] = tally[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(removed[..., 0], axis=2)
    out[..., 1] = removed[..., 0]
    failing = np.stack([tally[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(filters)], axis=1)
    alone = np.stack([tally[:, 1 << f, 0] for f in range(filters)], axis=1)
    out[..., 2] = failing[:, orders] - removed[..., 0]
    out[..., 3] = alone[:, orders]
    out[..., 4], out[..., 5] = removed[..., 1], removed[..., 2]
    shapley = np.zeros((parts, filters), np.int64)
    np.add.at(shapley, (slice(None), orders), removed[..., 0])
    out[..., 6] = shapley[:, orders]
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: list[Filter] | None = None) -> DataFrame:
    """One row per part, order of the filters and step, with COUNTS."""
    filters = filters or FILTERS
    n = len(filters)
    tally = counted(docs, labels, filters).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most one cell a mask
    names = ["".join(filters[f].name for f in o) for o in permutations(range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                parts, cells = (batch.column(i).slice(at, 64).to_pylist() for i in (0, 1))
                table = np.zeros((len(parts), 1 << n, 3), np.int64)
                for i, own in enumerate(cells):
                    for c in own:
                        table[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = interactions(table, n).reshape(-1, len(COUNTS))
                rows = len(names) * n
                yield pa.record_batch(
                    [pa.array(np.repeat(np.array(parts, object), rows), pa.string()), pa.array(np.tile(np.repeat(np.array(names, object), n), len(parts)), pa.string()),
                     pa.array(np.tile(np.arange(1, n + 1), len(parts) * len(names)), pa.int32()), *(pa.array(np.ascontiguousarray(got[:, c])) for c in range(len(COUNTS)))],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return tally.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """Contract query: the five production filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, MIN(doc_id) OVER (PARTITION BY t) AS least FROM d),
labelled AS (SELECT doc_id, MAX(CAST(quality = 1 AS INT)) AS q, MAX(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, COALESCE(q, 0) AS q, COALESCE(x, 0) AS x, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    COALESCE(doc_id <> least, least IS NOT NULL)] AS fails FROM w LEFT JOIN labelled l USING (doc_id)),
cells AS (SELECT part, fails, COUNT(*) AS n, SUM(q) AS good, SUM(x) AS bad FROM f GROUP BY part, fails),
l AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
gone AS (SELECT part, fails, n, good, bad, o, list_min(list_transform([i for i in range(1, 6) if fails[i]], lambda i: instr(o, chr(CAST(64 + i AS INT))))) AS went FROM cells, orders),
steps AS (SELECT part, o, CAST(step AS INT) AS step, substr(o, CAST(step AS INT), 1) AS letter, ascii(substr(o, CAST(step AS INT), 1)) - 64 AS f,
    COALESCE(SUM(n) FILTER (went IS NULL OR went > step), 0) AS kept, COALESCE(SUM(n) FILTER (went = step), 0) AS removed,
    COALESCE(SUM(n) FILTER (went < step AND fails[ascii(substr(o, CAST(step AS INT), 1)) - 64]), 0) AS redundant,
    COALESCE(SUM(n) FILTER (fails[ascii(substr(o, CAST(step AS INT), 1)) - 64] AND len([x for x in fails if x]) = 1), 0) AS unique_fails,
    COALESCE(SUM(good) FILTER (went = step), 0) AS good_lost, COALESCE(SUM(bad) FILTER (went = step), 0) AS toxic_lost
  FROM gone, range(1, 6) r(step) GROUP BY part, o, step)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM steps"""
