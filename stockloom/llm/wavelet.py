"""Token ids of a corpus as wavelet matrices, one per shard file.

Documents are range-partitioned and sorted by doc_id; each task encodes its
documents and writes shards of about SHARD tokens. A shard file holds the
matrix's bit planes (each compressed on its own), the ids of its documents and their token
ends. The planes answer, without unpacking the ids: `access` (the id at
a position), `count`/`rank` (occurrences of an id in a range) and `select` (position of
the k-th occurrence). Reading a whole shard back inverts the planes from the
last to the first.

Null texts are empty and still get their end id. Rows with a null doc_id come
first, repeated doc_ids follow each other by text. A document is never cut, so one longer
than SHARD is a shard of its own. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm import files
from stockloom.llm.common import run_folder, small_text_batches, stored, text_bytes
from stockloom.llm.wordids import encoder

#: Tokens after which a shard is closed.
SHARD = 1 << 22
#: The id written after each document.
END = 1
MAGIC = b"WMX1"


class WaveletMatrix:
    """Bit planes of a sequence of non-negative integers, most significant plane first."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.depth = len(planes)
        self._ranks: list[np.ndarray | None] = [None] * self.depth

    @classmethod
    def of(cls, values: np.ndarray, depth: int | None = None) -> WaveletMatrix:
        values = np.asarray(values)
        if depth is None:
            depth = max(1, int(values.max(initial=0)).bit_length())
        planes, zeros = [], []
        for p in reversed(range(depth)):
            ones = (values & values.dtype.type(1 << p)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = np.compress(~ones, values)
            zeros.append(len(low))
            values = np.concatenate([low, np.compress(ones, values)])
        return cls(len(values), planes, zeros)

    def _directory(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of a plane and the ones before each."""
        if self._ranks[level] is None:
            raw = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw[: len(self.planes[level])] = self.planes[level]
            words = raw.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self._ranks[level] = (words, before)
        return self._ranks[level]

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits of a plane."""
        words, before = self._directory(level)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return before[word] + np.bitwise_count(below)

    def access(self, at) -> np.ndarray:
        """The values at some positions."""
        at = np.array(at, np.int64)
        value = np.zeros(at.shape, np.int64)
        for level in range(self.depth):
            words, _ = self._directory(level)
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._rank1(level, at)
            value = value << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value

    def _down(self, value: int, at: np.ndarray) -> np.ndarray:
        """Where boundaries lie after following a value through all planes."""
        for level in range(self.depth):
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if value >> (self.depth - 1 - level) & 1 else at - ones
        return at

    def count(self, value: int, low, high) -> np.ndarray:
        """Occurrences of a value in the ranges [low, high)."""
        low, high = np.broadcast_arrays(np.array(low, np.int64), np.array(high, np.int64))
        if value >> self.depth:
            return np.zeros(low.shape, np.int64)
        return self._down(value, high) - self._down(value, low)

    def rank(self, value: int, at) -> np.ndarray:
        """Occurrences of a value before some positions."""
        return self.count(value, np.zeros_like(np.array(at, np.int64)), at)

    def select(self, value: int, k) -> np.ndarray:
        """Position of the k-th occurrence (from 0) of a value; n where there are fewer."""
        k = np.atleast_1d(np.array(k, np.int64))
        total = int(self.rank(value, np.array([self.n]))[0])
        at = self._down(value, np.zeros(1, np.int64))[0] + np.minimum(k, max(total - 1, 0))
        for level in reversed(range(self.depth)):
            words, before = self._directory(level)
            one = value >> (self.depth - 1 - level) & 1
            rank = at - self.zeros[level] if one else at
            ahead = before if one else np.arange(len(before)) * 64 - before
            word = np.minimum(np.searchsorted(ahead, rank, side="right") - 1, len(words) - 1)
            bits = np.unpackbits((words[word] if one else ~words[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            seen = np.cumsum(bits, axis=1)
            at = word * 64 + np.argmax(seen > (rank - ahead[word])[:, None], axis=1)
        return np.where(k < total, at, self.n)

    def values(self) -> np.ndarray:
        """The whole sequence: each plane's stable partition is undone, last plane first."""
        now = np.zeros(self.n, np.uint32 if self.depth > 16 else np.uint16)
        for level in reversed(range(self.depth)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            now[self.zeros[level] :] |= now.dtype.type(1 << (self.depth - 1 - level))
            before = np.empty_like(now)
            before[~ones] = now[: self.zeros[level]]
            before[ones] = now[self.zeros[level] :]
            now = before
        return now


class Shard:
    """A wavelet matrix with its documents: ids (None for a null) and the end of each in tokens."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: list[int | None], ends: np.ndarray):
        self.matrix, self.doc_ids, self.ends = matrix, doc_ids, np.asarray(ends, np.int64)

    def dumps(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        parts = [ids.tobytes(), np.array([d is None for d in self.doc_ids], np.uint8).tobytes(), self.ends.astype("<i8").tobytes(), *(p.tobytes() for p in self.matrix.planes)]
        packed = [pack(p) for p in parts]
        head = json.dumps({"n": self.matrix.n, "docs": len(ids), "zeros": self.matrix.zeros, "parts": [len(p) for p in packed]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8 : 8 + size])
        at, parts = 8 + size, []
        if at + sum(head["parts"]) != len(data):
            raise ValueError("a wavelet shard breaks off")
        unpack = zstandard.ZstdDecompressor().decompress
        for length in head["parts"]:
            parts.append(unpack(data[at : at + length]))
            at += length
        ids = [None if null else d for d, null in zip(np.frombuffer(parts[0], "<i8").tolist(), parts[1])]
        planes = [np.frombuffer(p, np.uint8) for p in parts[3:]]
        return cls(WaveletMatrix(head["n"], planes, head["zeros"]), ids, np.frombuffer(parts[2], "<i8"))

    def tokens(self, document: int) -> np.ndarray:
        """Ids of the document at an index of this shard, by access on the planes."""
        low = int(self.ends[document - 1]) if document else 0
        return self.matrix.access(np.arange(low, int(self.ends[document])))

    def find(self, token: int, k) -> list[tuple[int | None, int]]:
        """(doc_id, position in the document) of the k-th occurrences of a token."""
        at = self.matrix.select(token, k)
        at = at[at < self.matrix.n]
        doc = np.searchsorted(self.ends, at, side="right")
        start = np.concatenate([[0], self.ends])[doc]
        return [(self.doc_ids[d], int(p)) for d, p in zip(doc, at - start)]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Encode all documents in ascending doc_id order and write wavelet shards.

    Returns the stored manifest: file, part and seq (the shards' order), docs, tokens.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        depth = max(1, (ids.library.get_vocab_size() - 1).bit_length())
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        mark = np.array([end], ids.dtype)

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held]) if held else np.zeros(0, np.int64)
            data = Shard(WaveletMatrix.of(np.concatenate(held), depth), keys, ends).dumps()
            name = files.put(folder, ".wmx", lambda out: out.write(data))
            return pa.record_batch([[name], pa.array([part], pa.int32()), pa.array([seq], pa.int32()), [len(keys)], [size]], names=["file", "part", "seq", "docs", "tokens"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                keys.append(key)
                held.append(np.concatenate([ids.encode(text), mark]))
                size += len(held[-1])
                if size >= shard:
                    yield close()
                    keys, held, size, seq = [], [], 0, seq + 1
        ids.forget()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "file string, part int, seq int, docs long, tokens long"), "wavelet-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds `base`, the tokens before each shard: a running sum inside each part, and one over the parts' totals."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(bases, "part").withColumn("base", F.col("first") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))


def document_digests(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def rows(uri: str, base: int) -> Iterator[pa.RecordBatch]:
        shard = Shard.loads(files.whole(uri))
        ids = shard.matrix.values().astype("<u4")
        ends = shard.ends
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
        yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=names)

    return files.per_file(with_base(manifest).select("file", "base"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long", columns=2)


def op1_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents written as wavelet shards and read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), run_folder(spark, "wavelet"))
    return document_digests(manifest)
