"""Removal of byte strings that already start in an earlier document, with suffix arrays.

Each byte covered by a string of LENGTH bytes that also starts in a document of smaller
doc_id is removed. A suffix array of a whole corpus has no shards that could be
sorted apart, so equal strings are first brought together:

0. Documents with equal texts are merged: all strings of the later ones start in the first, which
   alone goes on.
1. Every string of LENGTH bytes has an anchor: the place in it where a hash of
   GRAM bytes is smallest. Equal strings have equal anchors, and neighbouring strings
   mostly share one, so only one place in eighteen is an anchor.
2. A string holds its anchor and REACH bytes before it, or its anchor and REACH bytes after it:
   33 bytes, which common words alone seldom make equal as they do the anchor's 16. Where those occur under one doc_id
   only, the strings around them cannot matter. Tasks send hashes of these sides in packed
   rows by bucket, with at most two doc_ids of each. A bit table of the sides that several
   documents have (at most 2^MOST_BITS bits, whatever the corpus) then lets tasks drop most
   of their text; a false hit costs time, never a result.
3. What is left goes on as pieces: the run of strings of one anchor, without a side that the table has not. Equal
   pieces are merged before they are shuffled, with the smallest and largest doc_id they have, so a passage that a third of
   the documents share is one row for each task. The pieces of an anchor that has very many
   (a passage's border) are handed on and split by their strings, of which those of several documents go into shards.
4. A shard takes whole anchors up to SHARD bytes, builds its suffix array by induced sorting
   (suffixes.py) and the permuted common prefixes; neighbours that share
   LENGTH bytes are equal strings, and the group's smallest doc_id is theirs.
5. The spans found go back to the documents that hold the piece, and are cut out.

Documents are compared by their whole texts as UTF-8 bytes; a null text is
empty, matches never cross documents. Rows that repeat a doc_id are one document
for the comparison (none is smaller) and a row each in the result. A null
doc_id counts as larger than any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, stored, text_bytes, trimmed
from stockloom.llm.suffixes import permuted_prefixes, places, suffix_array

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Bytes of the hashed places; LENGTH - GRAM + 1 of them lie in a string.
GRAM = 16
#: Each string holds so many bytes before its anchor, or so many after it.
REACH = (LENGTH - GRAM) // 2
#: Bytes of text that are hashed at a time, so that what is made of them stays near the processor.
BLOCK = 1 << 16
#: Bytes of pieces after which a shard is closed.
SHARD = 1 << 19
#: Bits for each side that several documents have, and at most so many in all (as a power of two).
BITS_EACH, MOST_BITS = 16, 28
#: Sides, and different pieces, that a task gathers before it passes them on.
GATHERED, MERGED = 4_000_000, 200_000
#: Different pieces of one anchor above which it is split by its strings.
CROWD = 20_000
#: Sorts after every document.
LAST = (1 << 63) - 1
#: Bits of an anchor's hash that are kept.
HASH_BITS = 48
#: Setting of Spark by which a query's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, from the two words of GRAM / 2 bytes that they are."""
    half = GRAM // 2
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.lib.stride_tricks.as_strided(data[:half].view(f"<u{half}"), (n + half,), (1,)).astype(np.uint64)
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word[half:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - HASH_BITS)
    return h


def anchored(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor, in texts laid end to end.

    Returns the hash at each place, and (place of the anchor, first string, last string, text) of each run; strings
    are named by where they start. The smallest hash wins, the leftmost of equal ones.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    # 36 bits of the hash, then the place: one minimum gives both
    h = rolling(data)
    key = (h >> np.uint64(HASH_BITS - 36)) << np.uint64(28) | np.arange(len(h), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[:n], key[span - width : span - width + n])
    place = (key & np.uint64((1 << 28) - 1)).astype(np.int64)
    # runs of one place, broken where a text starts and where its last string has started
    new = np.append(True, place[1:] != place[:-1])
    size = np.diff(ends)
    long = size >= LENGTH
    new[ends[:-1][long]] = True
    after = (ends[1:] - LENGTH + 1)[long]
    new[after[after < n]] = True
    first = np.nonzero(new)[0]
    last = np.append(first[1:], n) - 1
    text = np.searchsorted(ends, first, side="right") - 1
    good = first + LENGTH <= ends[text + 1]
    first, last, text = first[good], last[good], text[good]
    return h, place[first], first, last, text


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first string, last string, text) of each run."""
    h, place, first, last, text = anchored(data, ends)
    return h[place], first, last, text


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """One hash of two."""
    h = (a + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - HASH_BITS)


def sides(h: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two sides of each run: (left hash, right hash, strings to the left, strings to the right).

    A string that starts REACH bytes or more before its anchor holds these bytes and the anchor, any other one the
    anchor and the REACH bytes after it. The hash of a side without strings means nothing.
    """
    n = len(h) - 1
    left = mixed(h[np.maximum(place - REACH, 0)], h[place], 1)
    right = mixed(h[place], h[np.minimum(place + REACH, n)], 2)
    to_left = np.clip(place - REACH - first + 1, 0, last - first + 1)
    return left, right, to_left, last - first + 1 - to_left


def blocks(batch: pa.RecordBatch, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, doc keys, offset of each text's first byte in its document) of bounded size.

    A document longer than the limit comes in parts that overlap by LENGTH - 1
    bytes, so each of its strings lies in exactly one part.
    """
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    held: list[bytes] = []
    of: list[int] = []
    offset: list[int] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(of, np.int64), np.array(offset, np.int64)

    for key, raw in zip(keys.tolist(), text_bytes(batch.column(1))):
        step = limit - LENGTH + 1
        for at in range(0, max(1, len(raw) - LENGTH + 1), step):
            part = raw[at : at + limit]
            if held and size + len(part) > limit:
                yield out()
                held, of, offset, size = [], [], [], 0
            held.append(part)
            of.append(key)
            offset.append(at)
            size += len(part)
    if held:
        yield out()


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text): doc_id with nulls last."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.col("text").cast("string").alias("text"))


def outermost(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once with its smallest key, and once more with the largest if that differs; in order of keys."""
    order = np.argsort(h)
    h, key = h[order], key[order]
    first = np.nonzero(np.append(True, h[1:] != h[:-1])[: len(h)])[0]
    if not len(first):
        return h, key
    h, low, high = h[first], np.minimum.reduceat(key, first), np.maximum.reduceat(key, first)
    more = high != low
    h, key = np.concatenate([h, h[more]]), np.concatenate([low, high[more]])
    at = np.argsort(key)
    return h[at], key[at]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(h): hashes of the sides of anchors that documents of different keys have.

    A task's hashes go out as a few long rows, one for each bucket of hashes: six
    bytes a hash, and the keys as differences.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = HASH_BITS // 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            h, key = outermost(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            bucket = (h % np.uint64(buckets)).astype(np.min_scalar_type(buckets))  # small numbers are sorted digit by digit
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, order[cut[b] : cut[b + 1]]) for b in range(buckets) if cut[b] < cut[b + 1]]
            hashes = [h[i].view(np.uint8).reshape(-1, 8)[:, :size].tobytes() for _, i in rows]
            keys = [np.diff(key[i], prepend=0).tobytes() for _, i in rows]
            return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array(hashes, pa.binary()), pa.array(keys, pa.binary())], names=["bucket", "hashes", "keys"])

        for b in batches:
            for data, ends, keys, _ in blocks(b):
                h, place, first, last, text = anchored(data, ends)
                left, right, to_left, to_right = sides(h, place, first, last)
                for side, some in ((left, to_left > 0), (right, to_right > 0)):
                    held.append((side[some], keys[text[some]]))
                    n += len(held[-1][0])
            if n > GATHERED:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            h, _ = outermost(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            h.sort()
            several = h[:-1][h[1:] == h[:-1]]
            for i in range(0, len(several), 10_000):
                yield pa.record_batch([pa.array(several[i : i + 10_000].view(np.int64))], names=["h"])

        for b in batches:
            for bucket, hashes, keys in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if held and bucket != now:
                    yield from out()
                    held = []
                now = bucket
                raw = np.frombuffer(hashes.as_py(), np.uint8).reshape(-1, size)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :size] = raw
                held.append((wide.view(np.uint64).reshape(-1), np.cumsum(np.frombuffer(keys.as_py(), np.int64))))
        if held:
            yield from out()

    sent = docs.mapInArrow(trimmed(send), "bucket int, hashes binary, keys binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(receive), "h long")


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each hash in a table of 2^bits bits."""
    return [h >> np.uint64(HASH_BITS - bits), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)]


def bit_table(shared: DataFrame) -> np.ndarray:
    """A table of a power of two of bits with those of the hashes h set: built by tasks, bounded by MOST_BITS."""
    n = shared.count()
    bits = min(MOST_BITS, max(10, (n * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.concatenate(slots(b.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.record_batch([pa.array(slot >> 6), pa.array(np.int64(1) << (slot & 63))], names=["w", "b"])

    words = shared.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table.view(np.uint64)


def held_by(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Which hashes the table of 2^width bits has."""
    hit = np.ones(len(h), bool)
    for slot in slots(h, width):
        hit &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def shared_runs(batch: pa.RecordBatch, bits: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(anchor, piece, document, place in it) of the runs of which the bit table has a side, by block of texts."""
    width = (len(bits) * 64).bit_length() - 1
    for data, ends, keys, offset in blocks(batch):
        h, place, first, last, text = anchored(data, ends)
        left, right, to_left, to_right = sides(h, place, first, last)
        # a side whose hash the table has not is left off the run
        first = np.where((to_left > 0) & ~held_by(bits, left, width), first + to_left, first)
        last = np.where((to_right > 0) & ~held_by(bits, right, width), last - to_right, last)
        hit = np.nonzero(first <= last)[0]
        h, first, last, text = h[place[hit]].view(np.int64), first[hit], last[hit], text[hit]
        raw = data.tobytes()
        yield h, [raw[s : e + LENGTH] for s, e in zip(first.tolist(), last.tolist())], keys[text], first - ends[text] + offset[text]


def piece_rows(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, piece, low, high): pieces of which a side may be shared, with the smallest and largest key that a task met each under."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def merged() -> Iterator[pa.RecordBatch]:
            rows = [(h, piece, low, high) for piece, (h, low, high) in seen.items()]
            seen.clear()
            for i in range(0, len(rows), 20_000):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000]), kinds)], names=["h", "piece", "low", "high"])

        for b in batches:
            for h, pieces, keys, _ in shared_runs(b, shared.value):
                for x, piece, k in zip(h.tolist(), pieces, keys.tolist()):
                    had = seen.get(piece)
                    if had is None:
                        seen[piece] = [x, k, k]
                    elif k < had[1]:
                        had[1] = k
                    elif k > had[2]:
                        had[2] = k
                if len(seen) > MERGED:
                    yield from merged()
        yield from merged()

    return docs.mapInArrow(trimmed(run), "h long, piece binary, low long, high long")


def named(piece: bytes) -> int:
    """A hash of a piece, signed."""
    return xxhash.xxh64_intdigest(piece) - (1 << 63)


def place_rows(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, id, key, at): where pieces start in documents; `id` is a hash of the piece."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, pieces, keys, at in shared_runs(b, shared.value):
                yield pa.record_batch([pa.array(h), pa.array([named(p) for p in pieces], pa.int64()), pa.array(keys), pa.array(at)], names=["h", "id", "key", "at"])

    return docs.mapInArrow(trimmed(run), "h long, id long, key long, at long")


def earliest(pieces: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes in the pieces: (piece, offset, smallest key of the pieces that hold it)."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(size + 1) - (size + 1)
    raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    # the bytes that occur are numbered in their order from 1, in one byte where that and a number beyond fit; pieces end with 0
    number = np.cumsum(np.bincount(raw, minlength=256) > 0)
    text = number.astype(np.uint8 if number[-1] < 255 else np.uint16)[raw]
    text[start + size] = 0
    kind = places(len(text))
    owner = np.repeat(np.arange(len(pieces), dtype=kind), size + 1)
    offset = np.arange(len(text), dtype=kind) - np.repeat(start.astype(kind), size + 1)
    whole = offset <= np.repeat((size - LENGTH).astype(kind), size + 1)  # a whole string starts here
    order = suffix_array(text, int(number[-1]) + 1)
    order = order[whole[order]]  # suffixes between two that share LENGTH bytes share them too, so none is missed
    common = permuted_prefixes(text, order, LENGTH)
    new = common[order] < LENGTH
    new[0] = True
    at = np.nonzero(new)[0]
    group = np.minimum.reduceat(least[owner[order]], at)
    found = np.empty(len(text), np.int64)
    found[order] = np.repeat(group, np.diff(np.append(at, len(order))))
    return owner[whole], offset[whole], found[whole]


def runs(owner: np.ndarray, offset: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first offset, last offset, value) of maximal runs of equal value, of the wanted strings."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]) | ~wanted[:-1]
    first = np.nonzero(new & wanted)[0]
    start = np.nonzero(new | ~wanted)[0]
    following = np.append(start, len(owner))[np.searchsorted(start, first, side="right")]
    return owner[first], offset[first], offset[following - 1], value[first]


def shard_runs(pieces: DataFrame) -> DataFrame:
    """(h, id, a, b, least): strings a..b of piece id first occur in document `least`.

    pieces: (h, piece, low, high); rows of one piece are merged. Only strings that
    some document after `least` holds are given. The pieces of an anchor that has more than CROWD are handed
    on as they are, in rows with a null id: (h, piece, least, high).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int]] = {}
        now: dict[bytes, list[int]] = {}
        size, last, crowded = 0, None, False
        names = ["h", "id", "a", "b", "least", "piece", "high"]

        def close() -> Iterator[pa.RecordBatch]:
            h, low, high = (np.array(c, np.int64) for c in zip(*held.values()))
            ids = np.array([named(p) for p in held], np.int64)
            owner, offset, value = earliest(list(held), low)
            piece, a, b, least = runs(owner, offset, value, value < high[owner])
            for i in range(0, len(piece), 10_000):
                part = slice(i, i + 10_000)
                n = len(a[part])
                yield pa.record_batch([*(pa.array(c[part], pa.int64()) for c in (h[piece], ids[piece], a, b, least)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)

        def hand_on() -> Iterator[pa.RecordBatch]:
            n, (low, high) = len(now), zip(*now.values())
            none = pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array([last] * n, pa.int64()), none, none, none, pa.array(low, pa.int64()), pa.array(list(now), pa.binary()), pa.array(high, pa.int64())], names=names)
            now.clear()

        def anchor_ends() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if crowded and now:
                yield from hand_on()
            for piece, (low, high) in now.items():
                held[piece] = (last, low, high)
                size += len(piece) + 1
            if size >= SHARD:
                yield from close()
                held.clear()
                size = 0

        for batch in batches:
            for h, piece, low, high in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != last:
                    yield from anchor_ends()
                    now, last, crowded = {}, h, False
                had = now.get(piece)
                if had is None:
                    now[piece] = [low, high]
                    if len(now) > CROWD:
                        crowded = True
                        yield from hand_on()
                else:
                    had[0], had[1] = min(had[0], low), max(had[1], high)
        yield from anchor_ends()
        if held:
            yield from close()

    return pieces.select("h", "piece", "low", "high").repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(run), "h long, id long, a long, b long, least long, piece binary, high long")


def crowd_rows(pieces: DataFrame) -> DataFrame:
    """(h, piece, a, string, low, high) of anchors with very many pieces: each of their strings."""
    strings = pieces.select("h", "piece", "low", "high", F.explode(F.expr(f"sequence(0, length(piece) - {LENGTH})")).alias("a"))
    return strings.withColumn("string", F.expr(f"substring(piece, a + 1, {LENGTH})"))


def crowd_runs(pieces: DataFrame) -> DataFrame:
    """As shard_runs, for anchors with very many pieces: their strings one by one, each its own anchor.

    pieces: (h, piece, low, high). Strings of one document alone cannot matter and go no further.
    """
    strings = crowd_rows(pieces.groupBy("h", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    own = strings.groupBy("string").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    lone = shard_runs(own.select(F.xxhash64("string").alias("h"), F.col("string").alias("piece"), "low", "high"))
    least = lone.groupBy(F.col("h").alias("s"), F.col("id").alias("t")).agg(F.min("least").alias("least"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, strings = (np.array([named(x) for x in b.column(i).to_pylist()], np.int64) for i in (1, 3))
            same = pa.array(strings == b.column(4).to_numpy())
            yield pa.record_batch([b.column(0), pa.array(ids), b.column(2), b.column(5)], names=["h", "id", "a", "least"]).filter(same)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of strings of one piece and one value; a run that goes over two batches comes in two parts."""
        for b in batches:
            if not b.num_rows:
                continue
            h, id, a, least = (b.column(i).to_numpy() for i in range(4))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (id[1:] != id[:-1]) | (a[1:] != a[:-1] + 1) | (least[1:] != least[:-1])
            first = np.nonzero(new)[0]
            last = np.append(first[1:], len(h)) - 1
            yield pa.record_batch([pa.array(c) for c in (h[first], id[first], a[first], a[last], least[first])], names=["h", "id", "a", "b", "least"])

    met = strings.withColumn("s", F.xxhash64("string")).join(least, "s").select("h", "piece", F.col("a").cast("long").alias("a"), "string", "t", "least")
    placed = met.mapInArrow(names, "h long, id long, a long, least long")
    return placed.repartition("h", "id").sortWithinPartitions("h", "id", "a").mapInArrow(join_up, "h long, id long, a long, b long, least long")


def settled(df: DataFrame, label: str) -> DataFrame:
    """The stored frame, without the shuffle files that made it: some are as large as the texts, and would stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        return stored(df, label)
    finally:
        if before is None:
            conf.unset(SHUFFLES_GO)
        else:
            conf.set(SHUFFLES_GO, before)


def copies(texts: DataFrame) -> DataFrame:
    """(key, size): documents whose whole text an earlier one has, with their bytes."""
    rows = texts.select("key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    first = rows.groupBy("sha").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("sha", "low")
    return rows.join(first, "sha").where("key > low").select("key", F.col("size").cast("long").alias("size")).distinct()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, start, stop): byte spans of documents that are to be removed; spans may overlap."""
    small_text_batches(docs.sparkSession)
    every = keyed(docs)
    again = settled(copies(every), "spans-copies")
    texts = every.join(again.select("key"), "key", "left_anti")
    table = bit_table(settled(shared_anchors(texts), "spans-anchors"))
    found = settled(shard_runs(piece_rows(texts, table)), "spans-found")
    crowd = found.where("piece is not null").select("h", "piece", F.col("least").alias("low"), "high")
    found = found.where("id is not null").select("h", "id", "a", "b", "least")
    if not crowd.isEmpty():
        found = found.unionByName(settled(crowd_runs(crowd), "spans-crowd-runs"))
    spans = place_rows(texts, table).join(found, ["h", "id"]).where("least < key").select("key", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b") + LENGTH).alias("stop"))
    return spans.unionByName(again.where(F.col("size") >= LENGTH).select("key", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop")))


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], reach[np.append(np.nonzero(new)[0][1:], len(start)) - 1]


def with_spans(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and text (string) of each row, with `spans`: its document's packed merged spans, or null."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    pair = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    # spans of a document: at most as many as it has anchors
    by_doc = settled(repeated_spans(docs).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).cast(pair).alias("spans")), "spans")
    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"))
    return rows.join(by_doc, rows["_key"] == by_doc["key"], "left").drop("_key", "key")


def each_spans(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(starts, stops) of each cell of a column of spans, or None for a null."""
    start, stop = (c.to_numpy() for c in column.values.flatten())
    ends = column.offsets.to_numpy()
    for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_null().to_pylist()):
        yield None if null else (start[a:b], stop[a:b])


def cut(raw: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs."""
    if spans is None or not len(spans[0]):
        return raw, []
    start, stop = merged_spans(*spans)
    gone = list(zip(start.tolist(), stop.tolist()))
    kept, at = [], 0
    for s, e in gone:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(kept), gone


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw, spans in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), each_spans(b.column(2))):
                kept, gone = cut(raw, spans)
                rows.append((key, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], names=names)

    found = with_spans(docs, ["doc_id"]).select(F.col("doc_id").cast("long"), "_text", "spans")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The removed runs, narrowed so that no UTF-8 character is cut."""
    out = []
    for s, e in gone:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, text and n_chars of documents after removal; a document of which nothing is left is dropped.

    Only whole characters are removed. `columns` must not hold text or n_chars.
    """
    rows = with_spans(docs, columns)
    names = [*columns, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            for raw, null, spans in zip(text_bytes(b.column(len(columns))), b.column(len(columns)).is_null().to_pylist(), each_spans(b.column(len(columns) + 1))):
                kept, at = [], 0
                for s, e in whole_characters(raw, cut(raw, spans)[1]):
                    kept.append(raw[at:s])
                    at = e
                texts.append(None if null else b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
            empty = [not none and t == "" for t, none in zip(texts, b.column(len(columns) + 1).is_null().to_pylist())]
            size = [None if t is None else len(t) for t in texts]
            out = pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(texts, pa.string()), pa.array(size, pa.int64())], names=names)
            yield out.filter(pa.array([not x for x in empty], pa.bool_()))

    schema = docs.select(*columns).schema.add("text", "string").add("n_chars", "long")
    return rows.select(*columns, "_text", "spans").mapInArrow(trimmed(run), schema)


def op5_suffix_array_spans(spark, sf_dir: str) -> DataFrame:
    """Contract query: what is removed from each document, and the digest of what is kept."""
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
