import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stockloom.llm import wavelet, wordids
from stockloom.llm.common import run_folder
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_chunks_equal_whole_texts():
    ids = wordids.WordIds(PATH)
    more = ["ÀÉß ÿ× ÷ ªº µ", "é x́ ́a", "a\x85b\xa0c d​e", "<|startoftext|>a <|endoftext|><|x", "I'M we'LL 'sound o'clock's 'd", "İıſK ﬁ", "x" * 500, "1234567890 3.14", "\x00\x01\x7f", "\x1c\x1d\x1e\x1fa"]
    for text in [*cases.awkward(), *more]:
        assert ids.encode((text or "").encode()).tolist() == whole(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ 'slmdtre0 9.,\n\t<|>éÉñß́\xa0　日")), st.characters(codec="utf-8"))))
def test_any_text(text):
    assert wordids.encoder(PATH).encode(text.encode()).tolist() == whole(text)


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(wordids, "PART", 50)
    text = cases.awkward()[10]
    assert wordids.encoder(PATH).encode(text.encode()).tolist() == whole(text)


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (64, 2), (1000, 49407), (5000, 7), (4097, 70000)])
def test_matrix(n, top):
    rng = np.random.default_rng(n)
    v = rng.integers(0, top, n)
    m = wavelet.WaveletMatrix.of(v)
    assert m.values().tolist() == v.tolist()
    at = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert m.access(at).tolist() == v[at].tolist()
    for c in [*v[:5].tolist(), 0, top + 1]:
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(c, low, high) == (v[low:high] == c).sum()
        where = np.nonzero(v == c)[0]
        k = np.arange(len(where) + 2)
        assert m.select(c, k).tolist() == [*where.tolist(), n, n]


def test_shard_file():
    v = np.array([5, 1, 7, 7, 1, 1])
    s = wavelet.Shard.loads(wavelet.Shard(wavelet.WaveletMatrix.of(v), [3, None, 9], np.array([2, 5, 6])).dumps())
    assert s.doc_ids == [3, None, 9] and s.tokens(1).tolist() == [7, 7, 1]
    assert s.find(1, [0, 1, 2, 3]) == [(3, 1), (None, 2), (9, 0)] and s.find(7, [1]) == [(None, 1)]
    with pytest.raises(ValueError):
        wavelet.Shard.loads(s.dumps()[:-1])


def test_corpus_round_trip(spark):
    texts = cases.awkward()
    manifest = wavelet.write_shards(cases.docs(spark, texts), PATH, run_folder(spark, "t"), shard=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.document_digests(manifest).collect()}
    want, at = {}, 0
    for i, t in enumerate(texts):
        ids = [*whole(t), 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want and manifest.count() > 3


def test_null_ids_repeats_and_empty(spark):
    texts = cases.awkward()[:8]
    got = wavelet.document_digests(wavelet.write_shards(cases.messy(spark, texts), PATH, run_folder(spark, "t"))).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == len(texts) + 2 and [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    assert min(got, key=lambda r: r.start).doc_id is None
    assert wavelet.document_digests(wavelet.write_shards(cases.docs(spark, []), PATH, run_folder(spark, "t"))).count() == 0
