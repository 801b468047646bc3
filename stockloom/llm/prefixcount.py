"""Exact token counts of byte-level BPE at every prefix, by dynamic programming.

Byte-level BPE has one property that makes prefixes cheap: a sequence of tokens
is an encoding if and only if each two neighbours are, taken alone. So the last token of
a prefix of a piece is the one vocabulary entry that ends there and fits behind the
last token of the prefix before it, and

    count[i] = count[i - len(token)] + 1.

The table is filled for all new pieces of a batch at once, position by position,
with hashed vocabulary lookups in numpy; pieces are remembered by each worker.
Two neighbours fit if no merge crosses their border while both sides are being
built: the walk below undoes the later of the two sides' last merges and looks
for a crossing merge that would have come earlier.

Around the pieces, three things make a prefix differ from a cut of the whole
text's pieces, and are treated: a run of white space whose last character belongs to
the next word, contractions cut in the middle, and special strings cut in the middle. With the
stored counts, `longest` answers how much of a text fits a token budget, without
encoding again.

The table of a text is put together from those of its chunks, a run of white space with what follows it: a
cut inside a chunk concerns no other. Stored are the differences of neighbouring counts, most of them 0 or 1, compressed.

Null texts are empty: no bytes, no tokens. Null and repeated doc_ids are
documents like others; other columns are ignored. One piece of very many bytes is walked through by itself,
in time in proportion to its length; what a worker remembers is bounded by bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockloom.llm.common import small_text_batches, stored, text_bytes
from stockloom.llm.wordids import visible_bytes

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts in which single spaces alone border on words can be split there.
RUNS = regex.compile(r"\s\s")
#: Separators that white-space classes of different libraries see differently.
ODD = regex.compile(r"[\x1c-\x1f\x85᠎​]")
#: What a cut concerns: a run of white space with the characters after it.
CHUNK = re.compile(r"\S+|\s+\S*")
#: Where a long text is taken apart, every so many characters.
START, PART = re.compile(r"(?<=\S)\s"), 1 << 20
#: Characters whose new chunks are learned together.
TOGETHER = 1 << 23
#: Pieces and chunks that a worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: Contractions of which a cut leaves more than a letter.
TREATED = {"'ll", "'re", "'ve"}
#: Longer pieces are not filled together but walked through one by one.
LONG = 256
#: Differences of neighbouring counts; a count falls by less than the length of a token.
STEP = np.dtype("<i2")
BASE = 0x9E3779B97F4A7C15
NONE = np.iinfo(np.int32).max


class Lookup:
    """A fixed map from unsigned 64-bit keys to int32, probed for whole arrays; -1 for a missing key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        # most keys asked for are missing: a small table of the places that are taken turns nearly all of them away
        self.taken = np.zeros(1 << 20, bool)
        self.taken[self._place(keys)] = True
        factor, shift = 0xD6E8FEB86659FD93, np.uint64(64 - max(8, len(keys).bit_length() + 2))
        while len(keys):
            slot = keys * np.uint64(factor) >> shift
            at, value = np.zeros(1 << (64 - int(shift)), np.uint64), np.full(1 << (64 - int(shift)), -1, np.int32)
            at[slot], value[slot] = keys, values
            self.tables.append((np.uint64(factor), at, value))
            left = at[slot] != keys
            keys, values = keys[left], values[left]
            factor = (factor * 0xA0761D6478BD642F | 1) % (1 << 64)
        self.shift = shift

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(keys.shape, -1, np.int32)
        asked = np.nonzero(self.taken[self._place(keys)])[0]
        keys = keys[asked]
        for factor, at, value in self.tables:
            slot = (keys * factor >> self.shift).view(np.int64)
            hit = at[slot] == keys
            found[asked[hit]] = value[slot[hit]]
            asked, keys = asked[~hit], keys[~hit]
        return found


class Vocabulary:
    """Tokens, merges and hashes of a byte-level BPE file whose ids follow the merges' order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("needs a byte-level BPE file with its usual pre-tokenizer")
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        shown = {**{b: b for b in range(256)}, **visible_bytes()}
        self.raw = {chr(c): b for b, c in shown.items()}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        size = max(ids.values()) + 1
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        pairs, merged = [], []
        before = -1
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            t = ids[a + b]
            if t <= before or ids[a] >= t or ids[b] >= t:
                raise ValueError("token ids do not follow the merges' order")
            before = t
            self.left[t], self.right[t] = ids[a], ids[b]
            pairs.append(ids[a] << 32 | ids[b])
            merged.append(t)
        self.pairs = Lookup(np.array(pairs, np.uint64) * np.uint64(BASE), np.array(merged, np.int32))
        tokens = {bytes(self.raw[c] for c in t): i for t, i in ids.items()}
        # a token that its own bytes do not encode to never appears
        t = np.array([i for i in tokens.values() if self.left[i] >= 0], np.int32)
        own = np.ones(size, bool)
        own[t] = self.fits(self.left[t], self.right[t], t)
        for i in t.tolist():  # parts first: ids ascend
            own[i] &= own[self.left[i]] & own[self.right[i]]
        tokens = {k: i for k, i in tokens.items() if own[i]}
        self.lengths = sorted({len(k) for k in tokens}, reverse=True)
        self.power = np.multiply.accumulate(np.full(1 << 16, BASE, np.uint64))
        keys = np.array([self._hash(k) for k in tokens], np.uint64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two tokens share a hash")
        self.tokens = Lookup(keys, np.array(list(tokens.values()), np.int32))
        self.ids, self.merged = tokens, dict(zip(pairs, merged))
        self.parts = list(zip(self.left.tolist(), self.right.tolist()))
        self.known_fits: dict[tuple[int, int], bool] = {}

    def fit(self, a: int, b: int) -> bool:
        """`fits` for one pair."""
        known = self.known_fits.get((a, b))
        if known is None:
            if len(self.known_fits) > REMEMBERED:
                self.known_fits.clear()
            known = self.known_fits[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        end_a = end_b = int(NONE)
        while True:
            c = self.merged.get(a << 32 | b, -1)
            if 0 <= c < end_a and c <= end_b:
                return False
            if a > b:
                end_a, a = a, self.parts[a][1]
            else:
                end_b, b = b, self.parts[b][0]
            if a < 0 or b < 0:
                return True

    def walk(self, piece: bytes) -> np.ndarray:
        """Counts of all prefixes of one piece, as `fill` gives them, byte by byte."""
        last, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for i in range(1, len(piece) + 1):
            for length in self.lengths:
                if length > i:
                    continue
                token = self.ids.get(piece[i - length : i])
                if token is not None and (length == i or self.fit(last[i - length], token)):
                    last[i], counts[i] = token, counts[i - length] + 1
                    break
        return np.array(counts, np.int32)

    @staticmethod
    def _hash(data: bytes) -> int:
        h = 0
        for b in reversed(data):
            h = (h * BASE + b + 1) % (1 << 64)
        return (h + len(data)) * BASE % (1 << 64)

    def fits(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NONE) -> np.ndarray:
        """Whether tokens a, b side by side stay apart; `until`: only merges before this id count."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        end_a = np.broadcast_to(np.asarray(until, np.int32), a.shape).copy()
        end_b = end_a.copy()
        while len(at):
            c = self.pairs((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(BASE))
            crossed = (c >= 0) & (c < end_a) & (c <= end_b)
            ok[at[crossed]] = False
            undo_a = a > b  # of equal merges the left one came first, so the right one is undone first
            next_a, next_b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            end_a, end_b = np.where(undo_a, a, end_a), np.where(undo_a, end_b, b)
            go = ~crossed & (next_a >= 0) & (next_b >= 0)
            at, a, b, end_a, end_b = at[go], next_a[go], next_b[go], end_a[go], end_b[go]
        return ok

    def fill(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, starts): counts[starts[k] + i] is the token count of the first i bytes of piece k."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64) + np.uint64(1)
        while len(self.power) < len(flat) + 1:
            self.power = np.concatenate([self.power, self.power * self.power[-1]])
        # suffix sums of byte * BASE^position; dividing by BASE^start is a product with its inverse power
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(flat), inverse, np.uint64)]))
        up = np.concatenate([[np.uint64(1)], self.power[: max(0, len(flat) - 1)]])
        total = np.concatenate([[np.uint64(0)], np.cumsum(flat * up[: len(flat)], dtype=np.uint64)])
        byte_at = (np.cumsum(size) - size)[order]
        starts = np.cumsum(size + 1) - (size + 1)
        base, size = starts[order], size[order]
        counts = np.zeros(int(starts[-1] + len(pieces[-1]) + 1) if len(pieces) else 0, np.int32)
        last = np.full(len(counts), -1, np.int32)
        for i in range(1, int(size[0]) + 1 if len(size) else 0):
            live = np.arange(np.searchsorted(-size, -i, side="right"))
            for length in self.lengths:
                if length > i or not len(live):
                    continue
                end = byte_at[live] + i
                key = ((total[end] - total[end - length]) * down[end - length] + np.uint64(length)) * np.uint64(BASE)
                token = self.tokens(key)
                hit = np.nonzero(token >= 0)[0]
                if not len(hit):
                    continue
                row, token = live[hit], token[hit]
                before = last[base[row] + i - length]
                good = before < 0
                good[~good] = self.fits(before[~good], token[~good])
                row, token = row[good], token[good]
                last[base[row] + i] = token
                counts[base[row] + i] = counts[base[row] + i - length] + 1
                left = np.ones(len(live), bool)
                left[hit[good]] = False
                live = live[left]
        return counts, starts


class PrefixCounter:
    """Counts texts and their prefixes; remembers pieces and chunks."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.piece: dict[str, bytes] = {}
        self.piece_bytes = 0
        self.whole: dict[str, int] = {}
        self.chunk: dict[str, bytes] = {}
        self.chunk_bytes = 0

    def pieces(self, text: str) -> list[str]:
        if ODD.search(text):  # ask the library itself
            raw = self.vocabulary.raw
            found = (bytes(raw[c] for c in p) for p, _ in self.vocabulary.library.pre_tokenizer.pre_tokenize_str(text))
            return [p.decode("utf-8", "replace") for p in found]
        return PATTERN.findall(text)

    def _learn(self, pieces) -> None:
        asked = list(dict.fromkeys(pieces))
        new = [p for p in asked if p not in self.piece]
        if len(self.piece) + len(new) > REMEMBERED or self.piece_bytes > REMEMBERED_BYTES:
            self.piece, self.piece_bytes, new = {}, 0, asked
        for p in new:
            if len(p) > LONG:
                raw = p.encode()
                self.piece[p] = np.diff(whole_characters(self.vocabulary.walk(raw), raw)).astype(STEP).tobytes()
                self.piece_bytes += 3 * len(p)
        new = [p for p in new if len(p) <= LONG]
        if new:
            raw = [p.encode() for p in new]
            counts, starts = self.vocabulary.fill(raw)
            # a byte between the pieces gives the bytes the places of the counts
            steps = np.diff(whole_characters(np.append(counts, 0), b"\0".join(raw) + b"\0")).astype(STEP).tobytes()
            self.piece.update((p, steps[2 * s : 2 * (s + len(b))]) for p, s, b in zip(new, starts.tolist(), raw))
            self.piece_bytes += 3 * len(counts)

    def _counts(self, piece: str) -> np.ndarray:
        """Counts at all prefixes of a learned piece."""
        return np.concatenate([np.zeros(1, np.int32), np.cumsum(np.frombuffer(self.piece[piece], STEP), dtype=np.int32)])

    def _total(self, piece: str) -> int:
        return int(np.frombuffer(self.piece[piece], STEP).sum())

    def chunks(self, text: str) -> list[str]:
        """Strings whose counts add up to the text's: words with the space before them, or pieces."""
        if RUNS.search(text) or ODD.search(text):
            return self.pieces(text)
        first, *others = text.split(" ")
        return [first, *(f" {w}" for w in others)]

    def totals(self, texts: list[str]) -> list[int]:
        """Token count of each text: the last entry of each piece's table, added up."""
        special, split = [], []
        for text in texts:
            parts = self.vocabulary.cuts.split(text) if self.vocabulary.cuts else [text]
            special.append(len(parts) - 1)
            split.append([c for p in parts for c in self.chunks(p)])
        if len(self.whole) > REMEMBERED or sum(map(len, texts)) > REMEMBERED_BYTES:
            self.whole = {}
        new = [c for c in dict.fromkeys(c for s in split for c in s) if c not in self.whole]
        inside = [self.pieces(c) for c in new]
        self._learn(p for ps in inside for p in ps)
        for c, ps in zip(new, inside):
            self.whole[c] = sum(map(self._total, ps))
        return [n + sum(map(self.whole.__getitem__, s)) for n, s in zip(special, split)]

    def _segment(self, text: str) -> tuple[np.ndarray, int]:
        """Counts at every byte prefix of a text without special strings, and its total."""
        pieces = self.pieces(text)
        spaces: list[str] = []
        for p, after in zip(pieces, pieces[1:]):
            if p.isspace():
                spaces.append(p + after[0])
        self._learn([*pieces, *spaces, "'", "l", "r", "v", "e"])
        counts = np.zeros(len(text.encode()) + 1, np.int32)
        at = total = run = 0
        before = ""
        for p in pieces:
            own = self._counts(p)
            counts[at + 1 : at + len(own)] = total + own[1:]
            if before.isspace() and p[0].isspace():  # cut here, the run of white space is one piece
                n = len(p[0].encode())
                counts[at + n] = run + self._total(before + p[0])
            if p in TREATED:
                counts[at + 2] = total + self._total("'") + self._total(p[1])
            run, total, at, before = total, total + int(own[-1]), at + len(own) - 1, p
        return counts, total

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of each byte prefix; inside a character, that of the characters before it."""
        raw = text.encode()
        counts = np.zeros(len(raw) + 1, np.int32)
        at = total = 0
        marks = list(self.vocabulary.cuts.finditer(text)) if self.vocabulary.cuts else []
        begin = 0
        for m in [*marks, None]:
            segment = text[begin : m.start() if m else len(text)]
            own, n = self._segment(segment + (m.group()[:-1] if m else ""))
            counts[at + 1 : at + len(own)] = total + own[1:]
            if m:
                n = int(own[len(segment.encode())])
                at, total, begin = at + len(own), total + n + 1, m.end()
                counts[at] = total
        return whole_characters(counts, raw)

    def steps(self, text: str) -> bytes:
        """Differences of the counts at neighbouring byte prefixes (STEP)."""
        return self.all_steps([text])[0]

    def all_steps(self, texts: list[str]) -> list[bytes]:
        """`steps` of each text, put together from those of the chunks; new chunks of many texts are learned together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def close() -> None:
            self._learn_chunks([c for _, chunks in held for c in chunks])
            for k, chunks in held:
                out[k].append(b"".join(map(self.chunk.__getitem__, chunks)))
            held.clear()

        for k, text in enumerate(texts):
            if ODD.search(text) or (self.vocabulary.cuts and self.vocabulary.cuts.search(text)):
                out[k].append(np.diff(self.prefixes(text)).astype(STEP).tobytes())
                continue
            at = 0
            while at < len(text):
                cut = START.search(text, at + PART)
                end = cut.start() if cut else len(text)
                held.append((k, CHUNK.findall(text[at:end] if at or cut else text)))
                size, at = size + end - at, end
                if size >= TOGETHER:
                    close()
                    size = 0
        close()
        return [b"".join(x) for x in out]

    def _learn_chunks(self, chunks: list[str]) -> None:
        asked = set(chunks)
        new = [c for c in asked if c not in self.chunk]
        if len(self.chunk) + len(new) > REMEMBERED or self.chunk_bytes > REMEMBERED_BYTES:
            self.chunk, self.chunk_bytes, new = {}, 0, list(asked)
        if new:
            # a space and letters are one piece
            inside = [[c] if c[0] == " " and c[1:].isalpha() else PATTERN.findall(c) for c in new]
            self._learn(p for ps in inside for p in ps)
            treated = []
            for c, ps in zip(new, inside):
                if len(ps) == 1:
                    self._keep(c, self.piece[c])
                elif ps[0].isspace() or not TREATED.isdisjoint(ps):
                    treated.append(c)
                else:
                    self._keep(c, b"".join(map(self.piece.__getitem__, ps)))
            for c in treated:  # last, as this may make the worker forget pieces
                self._keep(c, np.diff(whole_characters(self._segment(c)[0], c.encode())).astype(STEP).tobytes())

    def _keep(self, chunk: str, steps: bytes) -> None:
        self.chunk[chunk] = steps
        self.chunk_bytes += len(steps) + len(chunk)


def whole_characters(counts: np.ndarray, raw: bytes) -> np.ndarray:
    """Inside a character, the count of the characters before it."""
    if raw.isascii():
        return counts
    inside = np.zeros(len(counts), bool)
    inside[: len(raw)] = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
    return counts[np.maximum.accumulate(np.where(inside, 0, np.arange(len(counts))))]


def longest(counts: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix of at most so many tokens."""
    return int(np.nonzero(counts <= budget)[0][-1])


def packed(steps: bytes) -> bytes:
    """Steps, compressed; almost all are 0 or 1."""
    return zstandard.ZstdCompressor(level=1).compress(steps)


def unpacked(data: bytes) -> np.ndarray:
    """The count at every byte prefix, from packed steps; the first is that of the empty one."""
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), STEP)
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(steps, dtype=np.int32)])


_OPEN: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def prefix_tables(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, counts) of each document, stored: the count at every prefix (see `unpacked` and `longest`)."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            raw = list(text_bytes(b.column(1)))
            tables = [packed(steps) for steps in count.all_steps([t.decode("utf-8", "replace") for t in raw])]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(tables, pa.binary())], names=["doc_id", "n_bytes", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, counts binary"), "prefix-counts")


def answered(tables: DataFrame, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) from stored prefix tables alone: a text is over the limit if its longest prefix within it is not the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, over = [], []
            for data, size in zip(b.column(2), b.column(1).to_pylist()):
                counts = unpacked(data.as_py())
                tokens.append(int(counts[-1]))
                over.append(longest(counts, limit) < size)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tables.select("doc_id", "n_bytes", "counts").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_bytes, n_tokens, over_limit (512), read from the stored prefix counts."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return answered(prefix_tables(docs, public_tokenizers.path("byte_bpe_50k.json")))
