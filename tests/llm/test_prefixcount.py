import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stockloom.llm import prefixcount
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = prefixcount.PrefixCounter(PATH)


def number(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def check(text):
    assert COUNTER.totals([text]) == [number(text)], repr(text)
    table = COUNTER.prefixes(text)
    assert prefixcount.unpacked(prefixcount.packed(COUNTER.steps(text))).tolist() == table.tolist(), repr(text)
    at = 0
    for i in range(len(text) + 1):
        assert table[at] == number(text[:i]), (text[:i], text)
        if i < len(text):
            at += len(text[i].encode())


letters = st.one_of(st.sampled_from(list("aaeinstTIl'rv  \n\t.,!0129<|>éñ日\xa0\x85\x1c")), st.sampled_from(["'ll", "'re", "'s", "<|endoftext|>", "   ", "\n\n", "tion", " the", "aaaa"]), st.characters(codec="utf-8"))


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=25).map("".join))
@example("I'll've  x \n\n y'l")
@example("!!<|endoftext|>?<|endoftext|><|endo")
@example("aaaaaaaaaaaaaaaaaaaaaaaaa" * 3)
@example("   \n   \n  a  \nb \x85 c")
@example("================================-----------------")
def test_every_prefix(text):
    check(text)


def test_awkward_texts():
    for text in cases.awkward():
        check((text or "")[:400])
    texts = [t or "" for t in cases.awkward()]
    assert COUNTER.totals(texts) == [number(t) for t in texts]


def test_every_token_of_the_vocabulary():
    words = [bytes(COUNTER.vocabulary.raw[c] for c in t).decode("utf-8", "ignore") for t in LIBRARY.get_vocab() if t != "<|endoftext|>"]
    for at in range(0, len(words), 5000):
        part = words[at : at + 5000]
        assert COUNTER.totals(part) == [len(e.ids) for e in LIBRARY.encode_batch(part, add_special_tokens=False)]


def test_budgets():
    text = cases.awkward()[6]
    table = prefixcount.unpacked(prefixcount.packed(COUNTER.steps(text)))
    cut = prefixcount.longest(table, 20)
    assert number(text.encode()[:cut].decode("utf-8", "ignore")) <= 20 < number(text)
    assert prefixcount.longest(table, 10**6) == len(text.encode())


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(prefixcount, "REMEMBERED", 20)
    small = prefixcount.PrefixCounter(PATH)
    texts = [t or "" for t in cases.awkward()]
    for t in texts[:9]:
        assert small.totals([t]) == [number(t)]
        assert small.steps(t) == COUNTER.steps(t)
    tables = prefixcount.prefix_tables(cases.docs(spark, cases.awkward()), PATH)
    got = prefixcount.answered(tables).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), number(t), number(t) > 512) for i, t in enumerate(texts)}
    for r in tables.collect():
        counts = prefixcount.unpacked(r.counts)
        assert len(counts) == r.n_bytes + 1 and prefixcount.longest(counts, 10**9) == r.n_bytes
    assert prefixcount.answered(prefixcount.prefix_tables(cases.messy(spark, cases.awkward()[:8]), PATH)).count() == 10
    assert prefixcount.answered(prefixcount.prefix_tables(cases.docs(spark, []), PATH)).count() == 0
    assert np.ndim(small.prefixes("")) == 1 and small.steps("") == b""


def test_long_runs_without_spaces():
    import base64
    import random
    import time

    rng = random.Random(1)
    for text in ("a" * 5000, base64.b64encode(rng.randbytes(4000)).decode(), "日本語" * 900, "x" * 300 + "  " + "=" * 700 + "\n\n" + "né" * 400):
        steps = COUNTER.steps(text)
        counts = prefixcount.unpacked(prefixcount.packed(steps))
        assert counts[-1] == number(text) == COUNTER.totals([text])[0]
        for cut in sorted(rng.sample(range(len(text)), 40)):
            assert counts[len(text[:cut].encode())] == number(text[:cut])
    # time in proportion to the length
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    start = time.perf_counter()
    steps = COUNTER.steps(text)
    assert time.perf_counter() - start < 8 and prefixcount.unpacked(prefixcount.packed(steps))[-1] == number(text)


def test_pieces_fill_and_walk_alike():
    words = ["tion", " the", "aaaaaaaaaaaaa", "====---", "Straße", "0000", " " * 40, "x" * 120]
    counts, starts = COUNTER.vocabulary.fill([w.encode() for w in words])
    for w, s in zip(words, starts.tolist()):
        assert COUNTER.vocabulary.walk(w.encode()).tolist() == counts[s : s + len(w.encode()) + 1].tolist()


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(cases.awkward()[6] for _ in range(3)) + "\n\n  end " + "b" * 90
    whole = COUNTER.steps(text)
    monkeypatch.setattr(prefixcount, "PART", 50)
    assert prefixcount.PrefixCounter(PATH).steps(text) == whole


def test_lookup_turns_missing_keys_away_at_once():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    lookup = prefixcount.Lookup(keys, np.arange(len(keys), dtype=np.int32))
    asked = np.concatenate([keys, rng.integers(0, 1 << 63, 50_000).astype(np.uint64)])
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert lookup(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    assert lookup(asked[:0]).tolist() == []
    assert lookup.taken[lookup._place(asked[len(keys) :])].mean() < 0.1
