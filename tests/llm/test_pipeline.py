import random

import corpus_pipeline as pipeline
from stockloom.llm import simhash
from stockloom.llm.common import run_folder
from tests.llm import cases

SOUND = {"en": ["the", "tion", "er", "and", "ing", "wh"], "de": ["sch", "ung", "der", "ein", "ß", "ge"]}


def edited(text, near):
    """The text with one word changed, such that the fingerprints are within two bits, or are not."""
    words = text.split()
    for at in range(len(words)):
        other = " ".join([*words[:at], "changed", *words[at + 1 :]])
        if near == ((simhash.fingerprint(text.encode(), 3) ^ simhash.fingerprint(other.encode(), 3)).bit_count() <= 2):
            return other
    raise AssertionError("no such edit")


def corpus():
    rng = random.Random(11)
    prose = lambda lang, n: " ".join("".join(rng.choice(SOUND[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n))
    items = [prose("en", 30) for _ in range(8)]
    langs = ["en", "de"]
    texts = [prose(langs[i % 2], rng.randint(40, 120)) for i in range(240)]
    labels = {i: langs[i % 2] for i in range(240)}
    texts[10] = texts[0]  # exact copy
    for first, copy, near in ((2, 12, True), (4, 14, False)):
        texts[first] = prose("en", 300)
        texts[copy] = edited(texts[first], near)
    shared = prose("en", 25)
    texts[20] += " " + shared
    texts[40] = texts[40] + " " + shared + " é"
    texts[50] = texts[50] + " " + items[3] + " end"  # leak
    texts[60], texts[61], texts[62] = None, "123 456", ""
    return texts, labels, items


def test_stages(spark):
    texts, labels, items = corpus()
    folder = run_folder(spark, "t")
    cases.docs(spark, texts, labels).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = [{60, 61, 62}, {10, 12}, set(), {50}]
    for (_, stage), lost in zip(pipeline.STAGES[:-1], gone):
        before = {r.doc_id: r for r in docs.collect()}
        docs = pipeline.stored(stage(spark, docs, folder), "t")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == pipeline.COLUMNS and set(before) - set(after) == lost
        changed = {d for d in after if after[d].text != before[d].text}
        if stage is pipeline.repeated_passages:
            # 14 is no near copy, but all it has besides the changed word is in 4
            assert changed == {14, 40} and len(after[14].text) < 200 and len(before[40].text) - len(after[40].text) > 100 and after[40].n_chars == len(after[40].text)
        else:
            assert not changed
    pieces = pipeline.packed(spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(after)
    again = pipeline.run(spark, folder).collect()
    assert {(p.doc_id, p.start, p.length) for p in again} and {p.doc_id for p in again} == set(after)


def test_awkward_tables(spark):
    folder = run_folder(spark, "t")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, docs in (("none", cases.docs(spark, [])), ("odd", cases.messy(spark, cases.awkward()))):
        docs.write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
        rows = pipeline.run(spark, f"{folder}/{name}").collect()
        assert (name == "none") == (rows == [])


def test_workers_give_memory_back_after_a_task(monkeypatch):
    from types import SimpleNamespace

    from stockloom.llm import common

    asked = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: SimpleNamespace(malloc_trim=asked.append))
    task = common.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(task) == 2 and not asked
    assert list(task) == [3] and asked == [0]


def test_other_tasks_drop_the_encoders_words():
    import public_tokenizers

    from stockloom.llm import common, wordids

    wordids.encoder(public_tokenizers.path("word_bpe_49k.json")).encode(b"some words")
    assert wordids._OPEN
    list(common.trimmed(lambda batches: batches)(iter([])))
    assert not wordids._OPEN
