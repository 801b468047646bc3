import random
import zlib

import numpy as np

from stockloom.llm import langid
from tests.llm import cases

PARTS = {"en": ["the", "and", "tion", "ing", "her", "wh"], "de": ["der", "sch", "ung", "ein", "über", "ß"], "es": ["ción", "ñ", "que", "los", "mente", "rr"]}


def prose(lang, rng, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus():
    rng = random.Random(1)
    langs = {i: rng.choice(sorted(PARTS)) for i in range(400)}
    return [prose(langs[i], rng, rng.randint(5, 60)) for i in range(400)], langs


def test_held_out_accuracy(spark):
    texts, langs = corpus()
    docs = cases.docs(spark, texts, langs)
    got = langid.predict(docs, langid.train(docs)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_learned(spark):
    texts, langs = corpus()
    wrong = {i: ("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else langs[i]) for i in langs}
    model = langid.train(cases.docs(spark, texts, wrong))
    again = langid.train(cases.docs(spark, texts, langs))
    assert model.languages == ["de", "en", "es"] and np.array_equal(model.weights, again.weights)


def test_no_letter_null_and_untrained(spark):
    texts, langs = corpus()
    model = langid.train(cases.docs(spark, texts, langs))
    odd = [None, "", "123 !?", "\U0001f600", "é", texts[0] * 300]
    got = {r.doc_id: r for r in langid.predict(cases.docs(spark, odd), model).collect()}
    assert [got[i].lang_pred == "und" for i in range(6)] == [True, True, True, True, False, False]
    assert got[0].score == 0.0
    assert langid.train(cases.docs(spark, [])) is None and langid.train(cases.docs(spark, odd[:4])) is None
    assert {r.lang_pred for r in langid.predict(cases.docs(spark, odd), None).collect()} == {"und"}
    assert langid.predict(cases.messy(spark, cases.awkward()[:8]), model).count() == 10


def test_kernel_is_the_plain_one():
    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    a, b = "The cat, the hat", "a  the-bat!"
    rows, _ = langid.presence([a, b])
    assert rows.sum(1).tolist() == [len(grams(a)), len(grams(b))]  # no two of these share a bucket
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(langid.kernel(rows, rows)[0, 1] - want) < 1e-6


def test_long_texts_in_parts_lose_no_gram():
    text = ("ab" * (1 << 19))[:-1] + "cdexyz" + "ab"
    whole, _ = langid.presence([text])
    ends, _ = langid.presence([text[-200:]])
    assert (whole >= ends).all()


def test_regression_learns_from_every_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "LANDMARKS", 8)
    monkeypatch.setattr(langid, "BLOCK", 7)
    texts = [f"{a} {b}{i}" for i in range(20) for a, b in (("haus und", "der"), ("house and", "the"))]
    labelled = spark.createDataFrame([(i, "de" if t.startswith("haus") else "en", t) for i, t in enumerate(texts + texts[:20:2])], "doc_id long, lang string, text string").repartition(3)
    weight = langid.weights(labelled)
    assert weight == {"de": 5 / 30, "en": 5 / 20}
    space = langid.Space.of(*langid.sample(labelled, weight), weight)
    got = langid.sums(labelled, space)
    rows = labelled.collect()
    features = langid.kernel(langid.presence([r.text for r in rows])[0], space.marks) @ space.half
    whole = np.concatenate([features, np.ones((len(rows), 1)), np.array([[r.lang == "de", r.lang == "en"] for r in rows])], axis=1)
    want = whole.T @ (whole * np.array([weight[r.lang] for r in rows])[:, None])
    m = space.half.shape[1]
    assert np.abs(got - want).max() < 1e-4 and abs(got[m, m] - 10) < 1e-4  # each language weighs as five rows, of all its rows
    assert np.array_equal(got, langid.sums(labelled.coalesce(1), space))
