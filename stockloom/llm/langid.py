"""Language identification with a string kernel.

Kernel: two texts' sets of character 1- to 3-grams (blended spectrum, presence only),
size of the intersection over the root of the product of the sizes. N-grams are
taken from lower-cased letters, other characters count as one space, and are
hashed into DIM buckets, so a text is a row of zeros and ones and a batch of
kernel values is one matrix product.

Training: Nyström landmarks, some hundred texts (see `sample`), give the feature map
k(x, landmarks) K^-1/2; kernel ridge regression on it, one language against the
rest, has a closed form in sums over the learned texts. Spark tasks sum over all of them,
in whole multiples of a small unit, so that their order does not matter; rows of a language with over PER_LANGUAGE share its
weight, so that languages weigh alike. Mapping and weights fold into one matrix, so scoring is
two products per batch of whole texts.

Defined results: a null text or one without a letter is `und` with score 0; so is every text
if nothing could be learned. The score is the winning regression value, clipped to
[0, 1]. lang and doc_id only choose what is learned and are never looked at in
prediction. A null doc_id is not held out. Ties go to the language that sorts
first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import small_text_batches, text_bytes, trimmed

DIM_BITS = 13
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
LANDMARKS = 256
RIDGE = 1e-2
#: Bounds of the rows that landmarks are taken from and of the weights in the regression: all languages together, one language, and languages (the most frequent ones).
SAMPLE, PER_LANGUAGE, LANGUAGES = 4096, 800, 256
UNKNOWN = "und"
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Texts turned into a matrix at a time.
BLOCK = 256
#: Weighted features are whole multiples of 1 / UNIT, so that sums of products of a block are exact.
UNIT = 1 << 20


def letters_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTERS: list[np.ndarray] = []


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of 0/1 bytes over DIM buckets, whether each text has a letter)."""
    if not _LETTERS:
        _LETTERS.append(letters_table())
    found = np.zeros((len(texts), DIM), np.uint8)
    has = np.zeros(len(texts), bool)
    flat = found.reshape(-1)
    for row, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):  # very long texts in overlapping parts
            code = np.frombuffer(text[at : at + (1 << 20) + 2].lower().encode("utf-32-le", "replace"), np.uint32)
            letter = _LETTERS[0][code]
            code = np.where(letter, code, 0)
            keep = np.ones(len(code), bool)
            keep[1:] = letter[1:] | letter[:-1]
            code = code[keep]
            has[row] |= bool(letter.any())
            for n in ORDERS:
                if len(code) >= n:
                    mixed = np.full(len(code) - n + 1, n, np.uint32)
                    for i in range(n):
                        mixed = (mixed ^ code[i : len(code) - n + 1 + i]) * MULTIPLIERS[i]
                        mixed ^= mixed >> np.uint32(15)
                    bucket = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)
                    flat[row * DIM + bucket.astype(np.int64)] = 1
    return found, has


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Normalised presence kernel between rows of 0/1."""
    x, z = x.astype(np.float32), z.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(z.sum(1), 1))[None, :]
    return x @ z.T / norm


@dataclass
class Space:
    """The feature map of some landmarks, and what a row of each language weighs."""

    languages: list[str]
    weight: list[float]
    marks: np.ndarray  # rows of 0/1
    half: np.ndarray  # landmarks x features

    @classmethod
    def of(cls, rows: np.ndarray, of: list[str], weight: dict[str, float]) -> Space | None:
        """From rows of 0/1 and the language of each."""
        if not len(rows):
            return None
        names = sorted(weight)
        number = np.array([names.index(x) for x in of])
        # landmarks: every language in turn, in the sample's order
        turn = np.zeros(len(number), np.int64)
        for c in range(len(names)):
            turn[number == c] = np.arange((number == c).sum())
        marks = rows[np.argsort(turn, kind="stable")[:LANDMARKS]]
        value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        good = value > 1e-6 * max(value.max(), 1e-12)
        return cls(names, [weight[x] for x in names], marks, vector[:, good] / np.sqrt(value[good]))

    def products(self, texts: list[str], languages: list[str]) -> np.ndarray:
        """Weighted sums over texts of the products of features, a one and the language's mark with each other, in 1 / UNIT squared."""
        number = {x: i for i, x in enumerate(self.languages)}
        m = self.half.shape[1]
        out = np.zeros((m + 1 + len(number),) * 2, np.int64)
        for at in range(0, len(texts), BLOCK):
            of = np.array([number[x] for x in languages[at : at + BLOCK]])
            features = kernel(presence(texts[at : at + BLOCK])[0], self.marks).astype(np.float64) @ self.half
            row = np.concatenate([features, np.ones((len(of), 1)), of[:, None] == np.arange(len(number))], axis=1)
            whole = np.rint(row * np.sqrt(np.array(self.weight)[of])[:, None] * UNIT)
            out += (whole.T @ whole).astype(np.int64)
        return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # landmarks x languages
    shift: np.ndarray

    @classmethod
    def of(cls, space: Space, sums: np.ndarray) -> Model:
        """The regression from the sums of products of `Space.products`."""
        m = space.half.shape[1]
        total = sums[m, m]
        mean_x, mean_y = sums[:m, m] / total, sums[m + 1 :, m] / total
        xx = sums[:m, :m] - total * np.outer(mean_x, mean_x)
        xy = sums[:m, m + 1 :] - total * np.outer(mean_x, mean_y)
        beta = np.linalg.solve(xx + RIDGE * np.eye(m), xy)
        return cls(space.languages, np.packbits(space.marks, axis=1), (space.half @ beta).astype(np.float32), (mean_y - mean_x @ beta).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        marks = np.unpackbits(self.landmarks, axis=1)
        names: list[str] = []
        scores: list[float] = []
        for at in range(0, len(texts), BLOCK):
            x, has = presence(texts[at : at + BLOCK])
            value = kernel(x, marks) @ self.weights + self.shift
            best = value.argmax(1)
            top = np.clip(value[np.arange(len(best)), best], 0, 1)
            names += [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
            scores += [float(t) if h else 0.0 for t, h in zip(top, has)]
        return names, scores


def strings(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in text_bytes(column)]


def weights(labelled: DataFrame) -> dict[str, float]:
    """The languages learned, and what a row of each weighs: all alike up to `each` rows, which rows of more share."""
    frequent = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(len(frequent), 1)))
    return {lang: min(1.0, each / n) for lang, n in frequent.items()}


def sample(labelled: DataFrame, weight: dict[str, float]) -> tuple[np.ndarray, list[str]]:
    """Feature rows and languages of at most SAMPLE rows (doc_id, lang, text), chosen by hash, every language alike; landmarks are taken from them.

    Texts become fixed-size bit rows in the executors; only those reach the driver.
    A first cut by hash, with twice the rows wanted of each language, keeps all other
    texts out of the shuffle.
    """
    small_text_batches(labelled.sparkSession)
    if not weight:
        return np.zeros((0, DIM), np.uint8), []
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(weight)))
    share = F.create_map(*[F.lit(x) for lang, w in weight.items() for x in (lang, min(1.0, (2 + 20 / each) * w))])[F.col("lang")]
    drawn = labelled.withColumn("r", F.xxhash64(F.col("doc_id").cast("string"), "text")).where(F.pmod("r", F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy("r", "text")
    chosen = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence([t])[0][0]).tobytes() for t in strings(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])

    got = sorted((r.lang, bytes(r.bits)) for r in chosen.mapInArrow(trimmed(run), "lang string, bits binary").collect())
    if not got:
        return np.zeros((0, DIM), np.uint8), []
    rows = np.unpackbits(np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1), axis=1)
    return rows, [x for x, _ in got]


def part_of(column: Column, parts: int) -> Column:
    """crc32 of a column as text, modulo `parts`; null for a null."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def sums(labelled: DataFrame, space: Space) -> np.ndarray:
    """`Space.products` over all rows (doc_id, lang, text) of the languages learned; each task returns one matrix, which Spark adds up."""
    small_text_batches(labelled.sparkSession)
    shared = labelled.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        total = space.products([], [])
        for b in batches:
            total += space.products(strings(b.column(1)), b.column(0).to_pylist())
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1)):
                held[i] = held.get(i, 0) + np.frombuffer(part.as_py(), np.int64)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "part"])

    ours = labelled.where(F.col("lang").isin(space.languages)).select("lang", "text")
    out = space.products([], [])
    for r in ours.mapInArrow(trimmed(run), "i int, part binary").repartition("i").mapInArrow(trimmed(add), "i int, part binary").collect():
        out[r.i] = np.frombuffer(r.part, np.int64)
    return out / UNIT**2


def train(docs: DataFrame) -> Model | None:
    """Learn from all documents with a language and a text that has a letter, outside the held-out quarter."""
    ours = docs.where("lang is not null and text rlike '\\\\p{L}'").where(F.coalesce(part_of(F.col("doc_id"), 4) != 2, F.lit(True)))
    labelled = ours.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    weight = weights(labelled)
    space = Space.of(*sample(labelled, weight), weight)
    return space and Model.of(space, sums(labelled, space))


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of each document with lang_pred and score, predicted from text alone."""
    small_text_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string"))
    others = [c for c in rows.columns if c != "text"]
    names = others + ["text"] * ("text" in keep) + ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(b.num_columns - 1))
            lang, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            kept = b.columns if "text" in names else b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    schema = rows.select(*names[:-2]).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(trimmed(run), schema).select(*keep, "lang_pred", "score")


def op7_string_kernel_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(part_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
