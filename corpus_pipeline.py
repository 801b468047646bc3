"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of `documents`. A stage's result is written as Parquet in the shared
folder and read again as the next stage's docs, so a stage can be run anew alone.
Every decision is taken on what the stage before kept.

Near copies are texts whose fingerprints of three-word shingles differ in two bits at most, and what such links connect.

Null texts and texts without a letter end in the first stage. A row with a null
doc_id cannot be named by the second and fourth stage and passes them. Rows that
repeat a doc_id share its fate. Other columns are dropped in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import langid, lsa, packing, simhash, spandedup
from stockloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that no learned language scores at least so much is no text in any of them.
LEAST_SCORE = 0.3
#: The reports of single stages cannot be had from SQL; tests hold them against brute force.
ORACLE_SQL = None


def typed(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages."""
    docs = typed(docs)
    model = langid.train(docs)
    judged = langid.predict(docs, model, COLUMNS)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the SimHash operator at its contract's settings: that with the smallest doc_id."""
    found = simhash.near_duplicates(docs, shingle=3, radius=2)
    others = stored(found.where("doc_id <> component_id").select("doc_id"), "pipeline-copies")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that an earlier document has."""
    return spandedup.without_repeats(docs, ["doc_id", "lang", "source"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = stored(lsa.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
