import random

import numpy as np

from stockloom.llm import lsa
from tests.llm import cases


def make():
    rng = random.Random(9)
    common = ["the", "of", "and", "in", "to"]
    word = lambda: "".join(rng.choice(["tion", "er", "the", "an", "ea", "st", "ing", "é"]) for _ in range(rng.randint(3, 5)))
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [prose(rng.randint(15, 70)) for _ in range(40)]
    docs, want, free = [], {}, set()
    for d in range(300):
        words = prose(rng.randint(20, 400))
        kind = d % 6
        item = rng.randrange(40)
        at = rng.randrange(len(words))
        if kind == 0:  # verbatim, in other case and punctuation
            words[at:at] = [w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", "."]) for w in items[item]]
            want[d] = item
        elif kind == 1:  # a word in eight replaced, dropped or doubled
            words[at:at] = [x for w in items[item] for x in (rng.choice([[], [w, w], [word()]]) if rng.random() < 0.12 else [w])]
            want[d] = item
        elif kind == 2:  # a short quotation is no leak
            i = rng.randrange(len(items[item]) - 6)
            words[at:at] = items[item][i : i + 6]
            free.add(d)
        else:
            free.add(d)
        docs.append(" ".join(words))
    return docs, [" ".join(i).capitalize() + "." for i in items], want, free


def frame(spark, items):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, word long")


def test_leaks(spark, monkeypatch):
    docs, items, want, free = make()
    got = {(r.doc_id, r.item_id): r for r in lsa.leaks(cases.docs(spark, docs), frame(spark, items)).collect()}
    found = set(got)
    assert {d for d, _ in found}.isdisjoint(free)
    assert all((d, i) in found for d, i in want.items() if d % 6 == 0)
    assert sum((d, i) in found for d, i in want.items()) >= 0.95 * len(want)
    assert all(got[d, i].lcs == 1.0 for d, i in want.items() if d % 6 == 0)
    monkeypatch.setattr(lsa, "ITEMS", 15)  # in blocks the same documents are found
    again = {(r.doc_id, r.item_id) for r in lsa.leaks(cases.docs(spark, docs), frame(spark, items)).collect()}
    assert len(again ^ found) <= 2 and {d for d, _ in again} >= {d for d in want if d % 6 == 0}


def test_awkward_tables(spark):
    odd = [*cases.awkward(), None]
    items = [None, "", "...", "one two", odd[6], "日本語 мир"]
    got = lsa.leaks(cases.messy(spark, odd), frame(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(6, 4), (7, 4), (8, 4), (9, 4), (None, 4), (4, 3), (5, 3)}
    assert {r.doc_id for r in got}.isdisjoint({0, 1, 2, 3, 11, 13, 14, 15, 16, 17})  # the long ones repeat the same few words
    assert lsa.leaks(cases.docs(spark, []), frame(spark, items)).count() == 0
    assert lsa.leaks(cases.docs(spark, odd), frame(spark, [])).count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 80)), rng.integers(0, 6, rng.integers(0, 90))
        row = np.zeros(len(b) + 1, int)
        for x in a:
            old = row.copy()
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert lsa.common_subsequence(a, b) == row[-1]


def test_basis_spans_the_leading_directions():
    rng = np.random.default_rng(1)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    row, word = np.nonzero(dense)
    rows = lsa.Rows(row, word, np.ones(len(row)), 60, np.ones(40))
    plain = np.zeros((60, 40))
    plain[rows.row, rows.word] = rows.value
    x = rng.random((40, 7)).astype(np.float32)
    assert np.allclose(rows.times(x), plain @ x, atol=1e-5)
    y = rng.random((60, 7)).astype(np.float32)
    assert np.allclose(rows.transposed(y, 40), plain.T @ y, atol=1e-5)


def test_items_that_many_documents_hold(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    usual = ["the", "of", "and", "in", "to", "is", "a", "for"]
    prose = lambda n: [rng.choice(usual) if rng.random() < 0.4 else rng.choice(pool) for _ in range(n)]
    items = [prose(30) for _ in range(60)] + [[rng.choice(usual) for _ in range(30)]]
    hot, plain, docs, want = items[0], items[60], [], set()
    for d in range(900):
        words = prose(200)
        at = rng.randrange(200)
        if d % 3 == 0:  # in a third of the documents, every other time with a few words replaced
            words[at:at] = [w if d % 2 or rng.random() > 0.1 else rng.choice(pool) for w in hot]
            want.add((d, 0))
        elif d % 10 == 1:  # common words alone
            words[at:at] = plain
            want.add((d, 60))
        docs.append(" ".join(words))
    rows = lsa.leaks(cases.docs(spark, docs), frame(spark, [" ".join(i) for i in items])).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found >= {(d, i) for d, i in want if d % 2 or i}  # every verbatim copy
    assert len(found & want) >= 0.99 * len(want)
    assert len(found - want) <= 0.02 * len(docs)


def test_factorisation_counts_every_passage(spark, monkeypatch):
    monkeypatch.setattr(lsa, "PRODUCTS", 50)
    monkeypatch.setattr(lsa, "PAIRS", 400)
    docs, items, _, _ = make()
    vocabulary = {}
    listed = [lsa.Item(i, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in lsa.words_of(t.encode())], np.int32)) for i, t in enumerate(items)]
    size = len(vocabulary)
    occurring = lsa.occurrences(cases.docs(spark, docs), vocabulary, lsa.Runs(listed)).repartition(3)
    idf = lsa.weights(*lsa.frequencies(occurring, listed, size), lsa.COMMON)
    want = np.zeros((size, size))
    for text in docs:
        n = np.array([vocabulary.get(w, -1) for w in lsa.words_of(text.encode())])
        at = np.nonzero(n >= 0)[0].astype(np.int32)
        row, word, times = lsa.terms(at, n[at], len(n), size)
        rows = lsa.Rows(row, word, times, lsa.passages(len(n)), idf)
        dense = np.zeros((rows.n, size))
        dense[rows.row, rows.word] = rows.value
        want += dense.T @ dense
    got = np.zeros((size, size))
    for r in lsa.word_pairs(occurring, idf).collect():
        got[r.i, np.frombuffer(r.j, np.int32)] += np.frombuffer(r.v, np.int64) / lsa.FIXED
    assert want.sum() > 100 and np.abs(got - want).max() < 1e-4


def test_products_of_a_pair_are_made_once(monkeypatch):
    monkeypatch.setattr(lsa, "PRODUCTS", 30)
    rng = np.random.default_rng(2)
    at = [np.sort(rng.choice(300, 40, replace=False)).astype(np.int32) for _ in range(6)]
    word = [rng.integers(0, 25, 40).astype(np.int32) for _ in at]
    n = np.array([lsa.passages(300)] * 6)
    row, w, times = lsa.all_terms(at, word, n, 25)
    apart = [lsa.terms(a, x, 300, 25) for a, x in zip(at, word)]
    assert row.tolist() == np.concatenate([r + i * n[0] for i, (r, _, _) in enumerate(apart)]).tolist()
    assert (w.tolist(), times.tolist()) == tuple(np.concatenate([x[k] for x in apart]).tolist() for k in (1, 2))
    rows = lsa.Rows(row, w, times, int(n.sum()), np.ones(25))
    got = np.zeros((25, 25))
    for code, value in rows.products(25):
        assert (code // 25 <= code % 25).all()
        np.add.at(got, (code // 25, code % 25), value)
    dense = np.zeros((rows.n, 25))
    dense[rows.row, rows.word] = rows.value
    assert np.allclose(got / lsa.FIXED, np.triu(dense.T @ dense), atol=1e-4)
