"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its word shingles' hashes
have it set. Fingerprints within `radius` bits are found with 2^(radius+1)-1 bit
masks: give each bit position a vector of radius+1 bits; the mask of a non-zero
vector v keeps the positions whose vector has an odd product with v. For any
`radius` positions some v is orthogonal to all of their vectors, so two
fingerprints that differ only there agree under that mask: no pair is missed.

Buckets (mask, masked bits) hold *distinct* fingerprints. A bucket gives the
edges of a spanning star of each group it links, never all pairs. Buckets above
BUCKET are dealt again by a third of the bits that the mask leaves out: two
fingerprints within two bits agree in one third at least, and then only about
18 bits are left free, so such a bucket is bounded whatever the data. (For other radii it
is radius+1 parts.)

Nulls and empty texts have no word and get fingerprint zero, which is linked
like any other. Repeated rows each give a row. Rows with a null doc_id get a
fingerprint and a component, but name no component: its id is the smallest
non-null doc_id, or null if there is none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import components, small_text_batches, stored, text_bytes, trimmed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = 64
#: Distinct fingerprints of a bucket that are compared in one go.
BUCKET = 1024
SEED = 42


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words joined by a space; of all words if there are fewer."""
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], seed) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], "<u8")


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over the word shingles, repeats included."""
    words = words_of(text)
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(trimmed(run), "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks as unsigned 64-bit integers: every pair within the radius agrees under one of them."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((i % top + 1) & v).count("1") % 2) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def thirds(mask: int, parts: int) -> list[int]:
    """The bits outside a mask, dealt into so many parts."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[p::parts]) for p in range(parts)]


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct sorted fingerprints, the index of the first of the group that each is linked to, near ones only.

    Small sets are compared blockwise. Larger ones, which differ in few bits by
    construction, are probed: every change of up to `radius` of those bits is looked up.
    """
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)

    if n <= BUCKET:
        for at in range(0, n, 256):
            near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= radius
            i, j = np.nonzero(near)
            keep = i + at < j
            join(i[keep] + at, j[keep])
    else:
        varied = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [np.uint64(1 << i) for i in range(BITS) if int(varied) >> i & 1]
        flips = [np.uint64(0)]
        for _ in range(radius):
            flips = list({int(f) ^ int(b) for f in flips for b in [np.uint64(0), *bits]})
        for f in flips:
            if f:
                other = fps ^ np.uint64(f)
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                hit = np.nonzero((fps[at] == other) & (at > np.arange(n)))[0]
                join(hit, at[hit])
    return np.array([find(i) for i in range(n)], np.int64)


def edges_within(buckets: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Star edges (a, b) of the groups that buckets link; rows (keys..., fp) with distinct fp in each bucket."""
    n = len(keys)

    def star(fps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        own = np.sort(np.array(fps, np.int64).view(np.uint64))
        root = linked(own, radius)
        far = np.nonzero(root != np.arange(len(own)))[0]
        return own[far].view(np.int64), own[root[far]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def close() -> None:
            if len(held) > 1:
                x, y = star(held)
                a.append(x)
                b.append(y)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n + 1)]
            for *key, fp in zip(*columns):
                if key != last:
                    close()
                    last, held = key, []
                held.append(fp)
            if a:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return buckets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), "a long, b long")


def near_edges(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (fp) linked within the radius."""
    cover = masks(radius)
    rows = [F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for v, m in enumerate(cover)]
    spread = distinct_fps.select("fp", F.explode(F.array(*rows)).alias("t")).select("t.v", "t.k", "fp")
    sizes = spread.groupBy("v", "k").agg(F.count("*").alias("n")).where("n > 1")
    sized = spread.join(sizes, ["v", "k"])
    usual = edges_within(sized.where(F.col("n") <= BUCKET).select("v", "k", "fp"), ["v", "k"], radius)
    parts = [[signed(p) for p in thirds(m, radius + 1)] for m in cover]
    split = F.element_at(F.lit(parts), F.col("v") + 1)
    again = (
        sized.where(F.col("n") > BUCKET)
        .select("v", "k", "fp", F.posexplode(split).alias("p", "m"))
        .select("v", "k", "p", F.col("fp").bitwiseAND(F.col("m")).alias("q"), "fp")
    )
    return usual.unionByName(edges_within(again, ["v", "k", "p", "q"], radius))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable over links)."""
    fps = stored(fingerprints(docs, shingle), "simhash-fp")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(near_edges(distinct.select("fp"), radius), "simhash-cc")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash_covering_lsh(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
