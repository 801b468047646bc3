"""Benchmark decontamination by latent semantic retrieval.

1. Words of the benchmark are the vocabulary. Each document becomes the sorted
   positions of its vocabulary words; its passages are windows of WINDOW words, every
   half a window. Document frequencies count all passages of all documents.
2. TF-IDF passages (unit length) are factored by a randomised SVD: a random matrix is multiplied by
   the passages and their transpose, which orthonormalised, twice, spans the leading right
   singular vectors. Passages have few words of the benchmark, so their transpose times themselves, the sums of products for
   pairs of words, is counted first: in one pass of Spark tasks over all passages of all documents,
   in whole multiples of 1 / FIXED, so that their order does not matter. The products with it are Spark jobs, too. The
   benchmark's own passages weigh as much as all others, so that their directions are kept.
3. Passages and benchmark items meet in the latent space: cosine by matrix products, with the
   norms of the whole vectors (in the latent norm one common rare word would look like a copy),
   the items of a block against all passages. Pairs of at least COSINE are candidates, and so is each
   place that shares a run of RUN words with an item, whatever the words weigh. A passage with such a run
   does not count towards the document frequencies of the item's words, so copies of an item never
   take away its weight, however many documents hold them.
4. A candidate is confirmed on word sequences: the longest common subsequence of the item and the
   passage's surroundings, at most twice as long as the item, holds LCS of the item's words, and so
   does that of the words with weight alone (common words come together by chance); or
   LCS_ANSWER of both, and the item's answer (its last words) is there nearly whole.

The benchmark is taken in blocks of ITEMS items, so what travels to tasks is
bounded by the block (its texts' size is checked, longer blocks are split).

Words: lower-cased runs of letters and digits (any character beyond ASCII counts as a letter). Null and empty texts
have none; items without a word are never found. Rows that repeat a doc_id are searched each and
give their pairs once. Rows with a null doc_id are found under null. Null item_ids are ignored, and of repeated ones
each text counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, stored, text_bytes, trimmed

#: Words of a passage; passages start every half of it.
WINDOW = 64
STEP = WINDOW // 2
#: Benchmark items' passages, and bytes of their texts, of a block; fewer passages than the rank.
ITEMS, ITEM_BYTES = 200, 8 << 20
#: Rank of the factorisation, extra random columns, power iterations.
RANK, EXTRA, POWERS = 208, 16, 2
#: Products of pairs of words are counted in whole multiples of 1 / FIXED; a task holds so many pairs, a step makes so many products.
FIXED, PAIRS, PRODUCTS = 1 << 24, 1_500_000, 1 << 19
#: Words in more than this share of the passages carry no weight in the search; in more than this, none in the confirmation.
COMMON, COMMON_HERE = 0.02, 0.05
#: Least cosine of a candidate; shares of an item's words that confirm it, alone and with the answer.
COSINE, LCS, LCS_ANSWER = 0.3, 0.6, 0.45
#: The answer: the last words of an item, of which this share must be there.
ANSWER, ANSWER_SHARE = 8, 0.75
#: Consecutive words shared with an item that make a candidate whatever their weight.
RUN = 4
#: Rows of documents' passages projected at a time.
BLOCK = 4096

BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(BLANK).split()


@dataclass
class Item:
    item_id: int
    words: np.ndarray  # vocabulary numbers


class Runs:
    """The runs of RUN words of a block's items (shorter items have none), by a hash of their numbers."""

    def __init__(self, items: list[Item]):
        code = [self.codes(i.words) for i in items]
        of = np.repeat(np.arange(len(items)), [len(c) for c in code])
        pair = np.unique(np.stack([np.concatenate(code).view(np.int64), of]), axis=1)
        self.code, self.item = pair[0].view(np.uint64), pair[1].astype(np.int32)
        order = np.argsort(self.code, kind="stable")
        self.code, self.item = self.code[order], self.item[order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.code >> np.uint64(46)] = True

    @staticmethod
    def codes(word: np.ndarray) -> np.ndarray:
        n = max(0, len(word) - RUN + 1)
        code = np.zeros(n, np.uint64)
        for i in range(RUN):
            code = (code ^ (word[i : i + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code * np.uint64(0xBF58476D1CE4E5B9)

    def found(self, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of each run of a document that an item has too."""
        code = self.codes(word)
        k = np.nonzero(self.maybe[code >> np.uint64(46)] & (at[RUN - 1 :] - at[: len(code)] == RUN - 1))[0] if len(code) else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.code, code[k]), np.searchsorted(self.code, code[k], side="right")
        n = high - low
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return at[np.repeat(k, n)], self.item[entry]


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], runs: Runs) -> DataFrame:
    """(doc_id, n_words, at, word, place, item): positions and numbers of vocabulary words, passages that share a run with an item, and the item (int32 each)."""
    small_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, runs = shared.value
        for b in batches:
            sizes, ats, found, places, its = [], [], [], [], []
            for raw in text_bytes(b.column(1)):
                words = words_of(raw)
                n = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                at = np.nonzero(n >= 0)[0].astype(np.int32)
                sizes.append(len(words))
                ats.append(at.tobytes())
                found.append(n[at].tobytes())
                place, item = hits(*runs.found(at, n[at]), passages(len(words)))
                places.append(place.tobytes())
                its.append(item.tobytes())
            packed = [pa.array(x, pa.binary()) for x in (ats, found, places, its)]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), *packed], names=["doc_id", "n_words", "at", "word", "place", "item"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_words long, at binary, word binary, place binary, item binary")


def passages(n_words: int) -> int:
    return 0 if n_words == 0 else max(1, -(-(n_words - STEP) // STEP))


def hits(at: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item), each pair once, of the passages that hold a position."""
    late = np.minimum(at // STEP, n - 1)
    early = np.maximum(late - 1, 0)
    pair = np.unique(np.concatenate([late, early]).astype(np.int64) << 32 | np.concatenate([item, item]))
    return (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)


def terms(at: np.ndarray, word: np.ndarray, n_words: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, times) of a document, each pair once."""
    return all_terms([at], [word], np.array([passages(n_words)]), size)


def all_terms(ats: list[np.ndarray], words: list[np.ndarray], n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, times) of some documents of n passages each, each pair once; passages are numbered through."""
    held = np.fromiter(map(len, ats), np.int64, len(ats))
    at, word = np.concatenate(ats), np.concatenate(words).astype(np.int64)
    last, base = np.repeat(n - 1, held), np.repeat(np.cumsum(n) - n, held)
    late = np.minimum(at // STEP, last)  # the last passage that holds a position, and the one before it
    early = np.maximum(at // STEP - 1, 0)
    both = early < late
    code = np.concatenate([(base + late) * size + word, (base[both] + early[both]) * size + word[both]])
    code.sort()
    first = np.nonzero(np.append(True, code[1:] != code[:-1])[: len(code)])[0]
    pair = code[first]
    row = pair // size
    return row, pair - row * size, np.diff(np.append(first, len(code)))


def read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for key, n, *packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in range(2, 6))):
        yield key, n, *(np.frombuffer(x.as_py(), np.int32) for x in packed)


def frequencies(occurring: DataFrame, items: list[Item], size: int) -> tuple[int, np.ndarray]:
    """(passages, those that hold each word and no run of an item with that word) over all documents."""
    shared = occurring.sparkSession.sparkContext.broadcast([np.unique(i.words).astype(np.int64) for i in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, own = 0, np.zeros(size, np.int64), shared.value
        for b in batches:
            docs = list(read(b))
            n = np.array([passages(doc[1]) for doc in docs], np.int64)
            total += int(n.sum())
            if docs:
                row, w, _ = all_terms([doc[2] for doc in docs], [doc[3] for doc in docs], n, size)
                held = [(p + base) * size + own[i] for doc, base in zip(docs, (np.cumsum(n) - n).tolist()) for p, i in zip(doc[4].tolist(), doc[5].tolist())]
                if held:
                    w = w[~np.isin(row * size + w, np.concatenate(held))]
                seen += np.bincount(w, minlength=size)
        hit = np.nonzero(seen)[0]
        yield pa.record_batch([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], total))], names=["word", "n"])

    got = occurring.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    counts = dict(zip(got["word"], got["n"]))
    total = counts.pop(-1, 0)
    found = np.zeros(size)
    for w, n in counts.items():
        found[w] = n
    return total, found


def weights(total: int, found: np.ndarray, common: float) -> np.ndarray:
    """Inverse document frequency; zero for words in more than `common` of the passages."""
    share = (found + 1) / (total + 1)
    return np.where((share > common) & (found > 20), 0.0, np.log((total + 1) / (found + 1)) + 0.1)


class Rows:
    """Unit-length TF-IDF rows in a sparse form; products with dense matrices go by sorted runs."""

    def __init__(self, row: np.ndarray, word: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray):
        value = (1 + np.log(times)) * idf[word]
        keep = value > 0
        self.row, self.word, value = row[keep], word[keep], value[keep]
        self.n = n
        norm = np.sqrt(np.bincount(self.row, value**2, minlength=n))
        self.value = (value / np.maximum(norm[self.row], 1e-12)).astype(np.float32)

    @staticmethod
    def _grouped(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, rows.shape[1]), np.float32)
        if len(index):
            first = np.nonzero(np.append(True, index[1:] != index[:-1]))[0]
            out[index[first]] = np.add.reduceat(rows, first, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        """These rows times a matrix with a row for each word; rows are in order."""
        return self._grouped(self.row, dense[self.word] * self.value[:, None], self.n)

    def products(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word * size + other word, sum of products) of the words that a row holds, the smaller word first; some rows at a time."""
        # words of a row ascend: each meets itself and those after it
        held = np.bincount(self.row, minlength=self.n)
        each = np.cumsum(held)[self.row] - np.arange(len(self.row))
        made = np.cumsum(each)
        at = 0
        while at < len(each):
            to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PRODUCTS, side="right")))
            n = each[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + left
            value = np.rint(self.value[left].astype(float) * self.value[right] * FIXED).astype(np.int64)
            yield added(self.word[left].astype(np.int64) * size + self.word[right], value)
            at = to

    def transposed(self, dense: np.ndarray, size: int) -> np.ndarray:
        order = np.argsort(self.word, kind="stable")
        return self._grouped(self.word[order], dense[self.row[order]] * self.value[order, None], size)


def added(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with the sum of its values (integers, so their order does not matter)."""
    order = np.argsort(code)
    code = code[order]
    first = np.nonzero(np.append(True, code[1:] != code[:-1]))[0]
    return code[first], np.add.reduceat(value[order], first)


def gathered(batches: Iterator[pa.RecordBatch], size: int, idf: np.ndarray) -> Iterator[tuple[Rows, list, np.ndarray]]:
    """Blocks of documents: their passages' rows, the documents, and the first row of each."""
    docs, rows, n, count = [], [], [], 0

    def out():
        each = np.array(n, np.int64)
        parts = all_terms([at for at, _ in rows], [w for _, w in rows], each, size)
        return Rows(*parts, int(each.sum()), idf), docs, np.cumsum(each) - each

    for b in batches:
        for doc in read(b):
            _, n_words, at, word, place, _ = doc
            useful = idf[word] > 0
            if not useful.any() and not len(place):
                continue
            docs.append(doc)
            rows.append((at[useful], word[useful]))
            n.append(passages(n_words))
            count += n[-1]
            if count >= BLOCK:
                yield out()
                docs, rows, n, count = [], [], [], 0
    if docs:
        yield out()


def word_pairs(occurring: DataFrame, idf: np.ndarray) -> DataFrame:
    """(i, j, v): for each word i the words j (int32 each) of its passages, with the sums of their products (int64, of 1 / FIXED) over all passages, stored."""
    size = len(idf)
    names, schema = ["i", "j", "v"], "i int, j binary, v binary"

    def packed(code: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = code // size, code % size
        other = i != j  # each pair is sent in both orders
        code, value = added(np.concatenate([code, j[other] * size + i[other]]), np.concatenate([value, value[other]]))
        i, j = code // size, (code % size).astype(np.int32)
        first = np.nonzero(np.append(True, i[1:] != i[:-1]))[0]
        ends = [*first[1:].tolist(), len(i)]
        for at in range(0, len(first), 256):
            part = list(zip(first[at : at + 256].tolist(), ends[at : at + 256]))
            packs = [pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in (j, value)]
            yield pa.record_batch([pa.array(i[first[at : at + 256]], pa.int32()), *packs], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows, _, _ in gathered(batches, size, idf):
            for pair in rows.products(size):
                held.append(pair)
                count += len(pair[0])
                if count > PAIRS:
                    held = [added(*(np.concatenate(x) for x in zip(*held)))]
                    count = len(held[0][0])
                    if count > PAIRS // 2:
                        yield from packed(*held[0])
                        held, count = [], 0
        if held:
            yield from packed(*added(*(np.concatenate(x) for x in zip(*held))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, j, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                row = sums.setdefault(i, np.zeros(size, np.int64))
                row[np.frombuffer(j.as_py(), np.int32)] += np.frombuffer(v.as_py(), np.int64)
        for i, row in sums.items():
            j = np.nonzero(row)[0]
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([j.astype(np.int32).tobytes()], pa.binary()), pa.array([row[j].tobytes()], pa.binary())], names=names)

    # some 256 words meet in a task
    return stored(occurring.mapInArrow(trimmed(run), schema).repartition(-(-size // 256), "i").mapInArrow(trimmed(add), schema), "lsa-pairs")


def fit(occurring: DataFrame, own: Rows, idf: np.ndarray, n_passages: int) -> np.ndarray:
    """Directions (words x RANK) of the benchmark's own rows, in the space that a randomised SVD of all passages and benchmark spans.

    RANK is above the passages of a block, so the space keeps the probes nearly whole.
    """
    size = len(idf)
    pairs = word_pairs(occurring, idf)
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.normal(size=(size, min(size, RANK + EXTRA))))[0].astype(np.float32)
    for _ in range(POWERS):
        shared = occurring.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [
                    ((np.frombuffer(v.as_py(), np.int64) / FIXED).astype(np.float32) @ shared.value[np.frombuffer(j.as_py(), np.int32)]).tobytes()
                    for j, v in zip(b.column(1), b.column(2))
                ]
                yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], names=["i", "part"])

        # a row for each word returns, as long as the basis is wide
        product = max(1.0, n_passages / max(own.n, 1)) * own.transposed(own.times(basis), size)
        for r in pairs.mapInArrow(run, "i int, part binary").collect():
            product[r.i] += np.frombuffer(r.part, np.float32)
        basis = np.linalg.qr(product.astype(np.float64))[0].astype(np.float32)
    # rotate to singular vectors by the small matrix that the basis leaves of the benchmark's rows
    small = own.times(basis).astype(np.float64)
    _, vectors = np.linalg.eigh(small.T @ small)
    return (basis @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        m = masks.get(w, 0)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def confirmed(item: np.ndarray, at: np.ndarray, word: np.ndarray, start: int, weighty: np.ndarray) -> tuple[float, float]:
    """(share of the item's words in order near a passage, share of its answer there).

    The share is the smaller of that of all words and that of the words with weight.
    """
    n = len(item)
    best, answer = 0.0, 0.0
    ranked = item[-ANSWER:]
    rare = item[weighty[item]]
    low, high = start - n, start + WINDOW + n
    reach = max(2 * n, 8)
    for s in range(low, max(low, high - reach) + 1, max(1, n // 2)):  # stretches of twice the item, by half of it
        part = word[np.searchsorted(at, s) : np.searchsorted(at, s + reach)]
        if len(part) < LCS_ANSWER * n or np.isin(part, item).sum() < LCS_ANSWER * n:
            continue
        share = common_subsequence(rare, part[weighty[part]]) / len(rare) if len(rare) else 1.0
        if share > best:
            share = min(share, common_subsequence(item, part) / n)
        if share > best:
            best, answer = share, common_subsequence(ranked, part) / len(ranked)
    return best, answer


def search(occurring: DataFrame, items: list[Item], probes: np.ndarray, of: np.ndarray, basis: np.ndarray, idf: np.ndarray, weighty: np.ndarray) -> DataFrame:
    """Confirmed pairs (doc_id, item_id, cosine, lcs, answer, start) of one block of items."""
    size = len(idf)
    shared = occurring.sparkSession.sparkContext.broadcast((items, probes, of, basis))
    names = ["doc_id", "item_id", "cosine", "lcs", "answer", "start"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, probes, of, basis = shared.value
        for rows, docs, first in gathered(batches, size, idf):
            cosine = rows.times(basis) @ probes.T
            found: dict[tuple[int, int], tuple] = {}
            row, probe = np.nonzero(cosine >= COSINE)
            # places that share a run of words, with the item's probe that is nearest
            place = np.concatenate([doc[4] + f for doc, f in zip(docs, first.tolist())])
            runs = np.concatenate([doc[5] for doc in docs])
            begin = np.searchsorted(of, np.arange(len(items) + 1))
            best = np.array([begin[i] + np.argmax(cosine[r, begin[i] : begin[i + 1]]) for r, i in zip(place, runs)], np.int64)
            pair = np.unique(np.concatenate([row * len(of) + probe, place * len(of) + best]))
            row, probe = pair // len(of), pair % len(of)
            doc = np.searchsorted(first, row, side="right") - 1
            for r, p, d in zip(row.tolist(), probe.tolist(), doc.tolist()):
                item = items[of[p]]
                had = found.get((d, item.item_id))
                if had is not None and had[3] == 1.0 and cosine[r, p] <= had[2]:
                    continue
                key, _, at, word, *_ = docs[d]
                start = (r - int(first[d])) * STEP
                lcs, answer = confirmed(item.words, at, word, start, weighty)
                if lcs >= LCS or lcs >= LCS_ANSWER and answer >= ANSWER_SHARE:
                    hit = (key, item.item_id, float(cosine[r, p]), lcs, answer, start)
                    if had is None or hit[3:1:-1] > had[3:1:-1]:
                        found[d, item.item_id] = hit
            if found:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found.values()), kinds)], names=names)

    return occurring.mapInArrow(trimmed(run), "doc_id long, item_id long, cosine double, lcs double, answer double, start long")


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items with a word, in blocks bounded by number and bytes; it is read in order, one partition at a time."""
    held, size, count = [], 0, 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        raw = r.text.encode()
        n = passages(len(words_of(raw)))
        if held and (count + n > ITEMS or size + len(raw) > ITEM_BYTES):
            yield held
            held, size, count = [], 0, 0
        if n:
            held.append((r.item_id, raw))
            size += len(raw)
            count += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a benchmark item, with cosine, lcs, answer and the first word's place."""
    found = None
    for block in blocks_of(benchmark):
        vocabulary: dict[bytes, int] = {}
        items = [Item(i, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(raw)], np.int32)) for i, raw in block]
        size = len(vocabulary)
        occurring = stored(occurrences(docs, vocabulary, Runs(items)), "lsa-words")
        total, seen = frequencies(occurring, items, size)
        idf, weighty = weights(total, seen, COMMON), weights(total, seen, COMMON_HERE) > 0
        for item in items:  # an item of common words alone keeps a little weight
            if not (idf[item.words] > 0).any():
                idf[item.words] = 0.1
        rows, of, at_row = [], [], 0
        for i, item in enumerate(items):
            row, word, times = terms(np.arange(len(item.words)), item.words, len(item.words), size)
            rows.append((row + at_row, word, times))
            of += [i] * passages(len(item.words))
            at_row += passages(len(item.words))
        own = Rows(*(np.concatenate(x) for x in zip(*rows)), at_row, idf)
        basis = fit(occurring, own, idf, total)
        pairs = search(occurring, items, own.times(basis), np.array(of), basis, idf, weighty)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double, start long")
    best = F.max(F.struct("lcs", "cosine", "answer", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer", (-F.col("m.col4")).alias("start"))


def op3_latent_semantic_leaks(spark, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, item_id): every document that holds a benchmark item, verbatim or paraphrased."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
