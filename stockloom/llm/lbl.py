"""Language-model scores by a log-bilinear neural model over word classes.

Words become symbols: the most frequent ones (with the end of text) have a symbol
of their own, the others share a class by their last two bytes. The number of symbols
grows with the training tokens (`sizes`). The model gives log P(symbol | two symbols
before) from products of context and output vectors and is trained with
noise-contrastive estimation in numpy, inside Spark tasks: all training texts are stored as symbols;
in each round every task climbs on its own part from the common parameters, and
Spark averages what the tasks found, weighted by their steps. Rounds share out the tokens, so that together
they learn from every training token, from each once (more often if there are few).
As the score of a symbol is a sum of one term of each context position, two matrix products give
the terms and a third the normalising sums of all contexts: three tables of symbols x
symbols. Inside a class a word has its smoothed share of the class's count; an
unknown word has that of a count of 0:

    log10 P(word | before) = log10 P(symbol | before) + log10 ((c + 0.5) / (N_class + 0.5 (V_class + 1)))

Counts of all words are summed by Spark. Those of the most frequent words
(HEAVY, a bound) travel to the tasks; each document's other words are joined with the
counts table, so nothing that grows with the vocabulary is broadcast and no
joined key is frequent.

Tokens: A-Z lower-cased, split at ASCII white space, then one end for each text.
A null text is empty and has the end alone. A null doc_id is in the training part. Without
training texts all counts are 0. Repeated doc_ids are documents like others;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, stored, text_bytes

#: Symbols: this times the fifth root of the training tokens, within these bounds. The upper one, reached at 10^13 tokens, keeps the three tables of a task under 200 MB.
GROWTH, LEAST_SYMBOLS, MOST_SYMBOLS = 10, 96, 4096
#: Frequent words whose counts each task knows.
HEAVY = 200_000
#: Words a task counts before it passes them on.
FLUSH = 300_000
#: The end of a text; no word contains white space.
END = b"\n"
#: Training: vector length, rounds of averaging, batch, noise symbols that a batch shares.
DIM, ROUNDS, BATCH, NOISE = 24, 4, 1024, 64
#: Tokens learned in a round, at least; the others of few training tokens are then taken again.
LEAST_DRAWS = 1_000_000
RATE = 0.1
#: Parameters are averaged as whole multiples of 2^-20, so that the order of addition does not matter.
UNIT = 1 << 20


def sizes(tokens: int) -> tuple[int, int]:
    """(symbols of single words, classes of other words) for a number of training tokens."""
    symbols = min(MOST_SYMBOLS, max(LEAST_SYMBOLS, int(GROWTH * tokens**0.2)))
    return symbols * 2 // 3, symbols - symbols * 2 // 3


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c): counts of all tokens of a column of texts, the end included."""
    small_text_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for at in range(0, len(items), 10_000):
                w, n = zip(*items[at : at + 10_000])
                yield pa.record_batch([pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

        for b in batches:
            for text in text_bytes(b.column(0)):
                seen.update(words_of(text))
                seen[END] += 1
            if len(seen) > FLUSH:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Totals, what a task knows of frequent words (symbol, log10(c + 0.5)), and the classes' sums."""

    tokens: int
    distinct: int
    heavy: dict[bytes, int]
    count_log: np.ndarray
    symbol: np.ndarray
    class_log: np.ndarray  # log10(N_class + 0.5 (V_class + 1)) of each class
    unigram: np.ndarray  # count of each symbol
    words: int  # symbols of single words; those above are classes
    end: int  # symbol of the end
    end_count: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        """From the stored counts: the heavy words and sums of the classes reach the driver, no more.

        Heavy words are those above a level of the count; a histogram of levels finds it.
        """
        ends = F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("c")))
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), ends.alias("ends")).first()
        level = F.floor(F.log2("c") * 64)
        above, least = 0, None
        for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            above += r["count"]
            if above > HEAVY:
                break
            least = r.level
        top = counts.where(level >= least if least is not None else F.lit(False)).toArrow()
        ranked = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist()), key=lambda r: (-r[1], r[0]))
        words = [w for w, _ in ranked]
        singles, classes = sizes(total.n or 0)
        own = words[: singles - 1]
        own = own if END in own else [*own, END]
        rank = {w: i for i, w in enumerate(own)}
        symbol = np.array([rank.get(w, singles + class_of(w, classes)) for w in words], np.int64)
        kind = F.crc32(F.expr("substring(word, -2, 2)")) % classes
        sums = counts.where(~F.col("word").isin([bytearray(w) for w in own])).groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        n, v = np.zeros(classes), np.zeros(classes)
        for r in sums:
            n[r.k], v[r.k] = r.n, r.v
        known = {w: i for i, w in enumerate(words)}
        unigram = np.zeros(singles + classes)
        unigram[singles:] = n
        for w, c in ranked:
            if w in rank:
                unigram[rank[w]] = c
        unigram[rank[END]] = total.ends or 0
        return cls(total.n or 0, total.v, known, np.log10(np.array([c for _, c in ranked], float) + 0.5), symbol, np.log10(n + 0.5 * (v + 1)), unigram, singles, rank[END], total.ends or 0)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and its index among the heavy words or -1."""
        index = np.fromiter((self.heavy.get(w, -1) for w in words), np.int64, len(words))
        found = self.symbol[index] if len(self.symbol) else np.zeros(len(words), np.int64)
        for i in np.nonzero(index < 0)[0].tolist():
            found[i] = self.words + class_of(words[i], len(self.class_log))
        return found, index


def contexts(symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before last, last, this) for texts laid end to end, each with its end; a text begins after two ends."""
    last = np.concatenate([[end], symbols[:-1]])
    before = np.concatenate([[end, end], symbols])[: len(symbols)]
    before[last == end] = end
    return before, last, symbols


def as_symbols(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(line binary): each text's symbols and its end, 16 bits each, stored."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        end = np.array([v.end], np.uint16).tobytes()
        for b in batches:
            lines = [v.symbols(words_of(t))[0].astype(np.uint16).tobytes() + end for t in text_bytes(b.column(0))]
            yield pa.record_batch([pa.array(lines, pa.binary())], names=["line"])

    return stored(texts.mapInArrow(run, "line binary"), "lbl-symbols")


class Model:
    """Log-bilinear model in one vector, with the squared slopes of Adagrad.

    Each context position has a matrix, each symbol an input and an output vector and a bias.
    """

    def __init__(self, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(unigram)
        self.noise = (unigram + 0.5) / (unigram + 0.5).sum()
        parts = [rng.normal(0, 0.3, n * DIM), np.eye(DIM).reshape(-1) * 0.5, np.eye(DIM).reshape(-1) * 0.5, rng.normal(0, 0.1, n * DIM), np.log(self.noise)]
        self.values = np.concatenate(parts)
        self.squares = np.full(len(self.values), 1e-2)

    def views(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Input vectors, the two matrices, output vectors and biases of a flat vector."""
        n, d = len(self.noise), DIM * DIM
        ends = np.cumsum([n * DIM, d, d, n * DIM])
        r, m1, m2, q, bias = np.split(flat, ends)
        return r.reshape(n, DIM), m1.reshape(DIM, DIM), m2.reshape(DIM, DIM), q.reshape(n, DIM), bias

    def climb(self, trigrams: tuple[np.ndarray, ...], order: np.ndarray, rng: np.random.Generator) -> None:
        """Steps on the trigrams in an order: the logistic likelihood of telling each from the batch's noise symbols."""
        r, m1, m2, q, bias = self.views(self.values)
        level = np.log(NOISE * self.noise)
        below = np.cumsum(self.noise)
        squares = self.views(self.squares)

        def step(which: int, slope: np.ndarray, rows: np.ndarray | None = None) -> None:
            value, square = (r, m1, m2, q, bias)[which], squares[which]
            if rows is None:
                square += slope * slope
                value += RATE * slope / np.sqrt(square)
                return
            order = np.argsort(rows, kind="stable")
            at, first = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(slope[order], first, axis=0)
            square[at] += total * total
            value[at] += RATE * total / np.sqrt(square[at])

        for start in range(0, len(order), BATCH):
            take = order[start : start + BATCH]
            a, b, c = (x[take] for x in trigrams)
            drawn = np.minimum(np.searchsorted(below, rng.random(NOISE)), len(below) - 1)
            ra, rb, qc, qn = r[a], r[b], q[c], q[drawn]
            h = ra @ m1 + rb @ m2
            real = 1 / (1 + np.exp(np.clip((h * qc).sum(1) + bias[c] - level[c], -30, 30)))
            fake = -1 / (1 + np.exp(-np.clip(h @ qn.T + bias[drawn] - level[drawn], -30, 30)))
            size = len(take)
            real, fake = real / size, fake / size
            back = real[:, None] * qc + fake @ qn
            rows = np.concatenate([c, drawn])
            step(3, np.concatenate([real[:, None] * h, fake.T @ h]), rows)
            step(4, np.concatenate([real, fake.sum(0)]), rows)
            step(0, np.concatenate([back @ m1.T, back @ m2.T]), np.concatenate([a, b]))
            step(1, ra.T @ back)
            step(2, rb.T @ back)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(far, near, norm) with log10 P(this) = far[before last, this] + near[last, this] - norm[before last, last]."""
        r, m1, m2, q, bias = self.views(self.values)
        far, near = (r @ m1) @ q.T + bias, (r @ m2) @ q.T
        high_far, high_near = far.max(1, keepdims=True), near.max(1, keepdims=True)
        norm = np.log(np.exp(far - high_far) @ np.exp(near - high_near).T) + high_far + high_near.T
        return tuple((t / np.log(10)).astype(np.float32) for t in (far, near, norm))


def turn(n: int, number: int, times: float, seed: list[int]) -> np.ndarray:
    """Which of n tokens a round takes, in random order: its part of them, and `times` n in all if that is more.

    The parts of all rounds hold every token once.
    """
    order = np.random.default_rng(seed).permutation(n)
    mine = order[number::ROUNDS]
    more = int(n * times) - len(mine)
    return mine if more <= 0 else np.concatenate([mine, np.resize(np.roll(order, -number * n // ROUNDS), more)])


def train(lines: DataFrame, vocabulary: Vocabulary) -> Model:
    """Model from all stored symbols: tasks climb on their parts, Spark averages. A round returns as many sums to the driver as the model has numbers."""
    model = Model(vocabulary.unigram)
    tokens, end = vocabulary.tokens, vocabulary.end
    if not tokens:
        return model
    spark = lines.sparkSession
    small_text_batches(spark)
    times = LEAST_DRAWS / tokens
    size = len(model.values)
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            mine = None
            done = 0
            for at, b in enumerate(batches):
                symbols = np.frombuffer(b"".join(text_bytes(b.column(0))), np.uint16).astype(np.int64)
                if not len(symbols):
                    continue
                if mine is None:
                    mine = Model(shared.value.noise)
                    mine.noise, mine.values, mine.squares = shared.value.noise, shared.value.values.copy(), shared.value.squares.copy()
                    rng = np.random.default_rng([number, TaskContext.get().partitionId()])
                order = turn(len(symbols), number, times, [TaskContext.get().partitionId(), at])
                mine.climb(contexts(symbols, end), order, rng)
                done += len(order)
            if done:
                found = np.concatenate([mine.values, mine.squares, [1.0]])
                whole = np.rint(found * UNIT).astype(np.int64) * done
                for at in range(0, len(whole), 10_000):
                    part = whole[at : at + 10_000]
                    yield pa.record_batch([pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["i", "v"])

        sums = lines.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).toArrow()
        shared.unpersist()
        flat = np.zeros(2 * size + 1)
        flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
        if not flat[-1]:  # batches of so few tokens that none has its turn
            continue
        model.values, model.squares = flat[:size] / flat[-1], np.maximum(flat[size:-1] / flat[-1], 1e-6)
    return model


@dataclass
class Scorer:
    """What a task needs: the vocabulary and the model's tables."""

    vocabulary: Vocabulary
    far: np.ndarray
    near: np.ndarray
    norm: np.ndarray

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P of symbols c after the symbols a, b."""
        return self.far[a, c] + self.near[b, c] - self.norm[a, b]

    def text(self, raw: bytes) -> tuple[int, int, float, float, Counter]:
        """(tokens, known heavy tokens, base and model log10 without rare words' own part, rare words with counts)."""
        v = self.vocabulary
        words = words_of(raw)
        symbols, index = v.symbols(words)
        heavy = index[index >= 0]
        logs = v.count_log[heavy]
        n = len(words) + 1
        base = logs.sum() + np.log10(v.end_count + 0.5) - n * v.base_log
        score = float(self.logs(*contexts(np.append(symbols, v.end), v.end)).sum(dtype=np.float64))
        in_class = symbols >= v.words
        score -= v.class_log[symbols[in_class] - v.words].sum()
        score += logs[v.symbol[heavy] >= v.words].sum()
        rare = Counter(words[i] for i in np.nonzero(index < 0)[0].tolist())
        return n, len(heavy) + int(v.end_count > 0), float(base), score, rare


def score_texts(docs: DataFrame, counts: DataFrame, scorer: Scorer) -> DataFrame:
    """Per document (doc_id): n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_text_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)
    names = ["rid", "doc_id", "n_tokens", "known", "base", "lbl", "words", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for key, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                n, known, base, score, rare = s.text(raw)
                rows.append((rid, key, n, known, base, score, list(rare), list(rare.values())))
                rid += 1
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "rid long, doc_id long, n_tokens long, known long, base double, lbl double, words array<binary>, times array<int>"
    # written, so that both readers see the same row numbers, whatever task is run again
    held = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "lbl-parts")
    rare = held.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("t"))
    looked = rare.join(counts, "word", "left").select("rid", (F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"), F.when(F.col("c") > 0, F.col("t")).otherwise(0).alias("k"))
    sums = looked.groupBy("rid").agg(F.sum("log").alias("log"), F.sum("k").alias("k"))
    return held.drop("words", "times").join(sums, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(scorer.vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", F.lit(0.0))).alias("base_score"), (F.col("lbl") + F.coalesce("log", F.lit(0.0))).alias("score"),
    )


def learn(texts: DataFrame) -> tuple[DataFrame, Scorer]:
    """Stored word counts and the trained scorer, from all rows of a column of texts."""
    counts = stored(word_counts(texts), "lbl-counts")
    vocabulary = Vocabulary.of(counts)
    return counts, Scorer(vocabulary, *train(as_symbols(texts, vocabulary), vocabulary).tables())


def op9_log_bilinear_scores(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from stockloom.llm.langid import part_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = part_of(F.col("doc_id"), 5)
    counts, scorer = learn(docs.where(F.coalesce(part != 1, F.lit(True))).select(F.col("text").cast("string")))
    found = score_texts(docs, counts, scorer)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
