import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stockloom.llm import lbl
from tests.llm import cases


@pytest.fixture(autouse=True)
def few_draws(monkeypatch):
    monkeypatch.setattr(lbl, "LEAST_DRAWS", 150_000)


def tokens(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + ["\n"]


def corpus(n=400):
    rng = random.Random(5)
    sides = [[f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], [f"{a}{b}é" for a in "uvwxyzabcd" for b in "klmnopqrst"]]
    return [" ".join(rng.choice(sides[i % 2][: rng.choice([5, 100])]) for _ in range(rng.randint(3, 60))) for i in range(n)]


def run(spark, docs, monkeypatch, heavy):
    monkeypatch.setattr(lbl, "HEAVY", heavy)
    learned = docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").select("text")
    counts, scorer = lbl.learn(learned)
    return lbl.score_texts(docs, counts, scorer).collect(), scorer


def test_base_and_counts_against_brute_force(spark, monkeypatch):
    texts = [*cases.awkward(), *corpus(40)]
    texts = [t if t is None else t[:3000] for t in texts]
    got, scorer = run(spark, cases.docs(spark, texts), monkeypatch, 15)
    seen = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    total, size = sum(seen.values()), len(seen)
    assert len(got) == len(texts)
    for r in got:
        ts = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(seen[t] > 0 for t in ts), total)
        assert math.isclose(r.base_score, sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (size + 1))) for t in ts), rel_tol=1e-9)
    # the model, token by token, from the same table
    v = scorer.vocabulary
    symbol = lambda w: next((v.symbol[i] for x, i in v.heavy.items() if x == w.encode() and v.symbol[i] < v.words), v.words + lbl.class_of(w.encode(), len(v.class_log)))
    own = {w for w in seen if w != "\n" and symbol(w) < v.words}
    of_class = Counter()
    kinds = Counter()
    for w, c in seen.items():
        if w not in own and w != "\n":
            of_class[lbl.class_of(w.encode(), len(v.class_log))] += c
            kinds[lbl.class_of(w.encode(), len(v.class_log))] += 1
    for r in got[:30]:
        a = b = v.end
        want = 0.0
        for t in tokens(texts[r.doc_id]):
            s = v.end if t == "\n" else symbol(t)
            want += float(scorer.logs(a, b, s))
            if s >= v.words:
                k = s - v.words
                want += math.log10((seen[t] + 0.5) / (of_class[k] + 0.5 * (kinds[k] + 1)))
            a, b = b, s
        assert math.isclose(r.score, want, rel_tol=1e-5)


def test_model_is_normalised_and_better_than_base(spark, monkeypatch):
    texts = corpus()
    got, scorer = run(spark, cases.docs(spark, texts), monkeypatch, 200_000)
    n = len(scorer.norm)
    a, b, c = np.ogrid[:n, :n, :n]
    assert np.allclose((10.0 ** scorer.logs(a, b, c).astype(float)).sum(-1), 1, atol=1e-4)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    mean = lambda k: sum(getattr(r, k) for r in held) / sum(r.n_tokens for r in held)
    assert len(held) > 50 and mean("score") > mean("base_score") + 0.1


def test_nothing_to_learn(spark, monkeypatch):
    got, _ = run(spark, cases.docs(spark, []), monkeypatch, 100)
    assert got == []
    counts, scorer = lbl.learn(cases.docs(spark, []).select("text"))
    got = {r.doc_id: r for r in lbl.score_texts(cases.docs(spark, ["a b", None]), counts, scorer).collect()}
    assert (got[0].n_known, got[0].train_tokens, round(got[0].base_score, 9), got[1].n_tokens) == (0, 0, 0.0, 1)
    got, _ = run(spark, cases.messy(spark, cases.awkward()[:8]), monkeypatch, 3)
    assert len(got) == 10


def test_symbols_and_contexts_grow_with_the_tokens():
    counts = [lbl.sizes(n) for n in (0, 10**6, 10**8, 10**10, 10**12)]
    assert all(a < b for a, b in zip(counts, counts[1:])) and counts[0] == (64, 32)
    assert sum(lbl.sizes(10**18)) == lbl.MOST_SYMBOLS
    got = lbl.contexts(np.array([5, 7, 8, 0, 0, 6, 0]), 0)
    assert [x.tolist() for x in got] == [[0, 0, 5, 7, 0, 0, 0], [0, 5, 7, 8, 0, 0, 6], [5, 7, 8, 0, 0, 6, 0]]


def test_rounds_learn_from_every_token():
    for n in (1, 3, 10, 1001):
        rounds = [lbl.turn(n, number, 0.1, [3, 1]) for number in range(lbl.ROUNDS)]
        assert sorted(np.concatenate(rounds).tolist()) == list(range(n))
        more = [lbl.turn(n, number, 2.5, [3, 1]) for number in range(lbl.ROUNDS)]
        assert all(len(x) == int(2.5 * n) and set(x.tolist()) == set(range(n)) for x in more)
