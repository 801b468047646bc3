import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stockloom.llm import packing
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, want):
    """want: doc_id -> ids. Each id lies in one piece, sequences are gapless and full."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            ids = want[d][at : at + p.length]
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(np.array(ids, "<u4").tobytes()), len(want[d])) and p.length > 0
            at += p.length
        assert at == len(want[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0 and {p.sequence_length for p in ps} == {at} and len({p.step_group for p in ps}) == 1


def test_all_pieces(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*cases.awkward(), *[cases.awkward()[12]] * 300]
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    check(packing.pack(cases.docs(spark, texts), PATH).collect(), want)


def test_null_ids_repeats_and_empty(spark):
    texts = cases.awkward()[:8]
    got = packing.pack(cases.messy(spark, texts), PATH).collect()
    assert sum(p.length for p in got if p.doc_id is None) == next(p.doc_tokens for p in got if p.doc_id is None)
    assert sum(p.length for p in got if p.doc_id == 6) == 2 * next(p.doc_tokens for p in got if p.doc_id == 6)
    assert packing.pack(cases.docs(spark, []), PATH).count() == 0


def test_packer_keeps_every_token():
    rng = np.random.default_rng(1)
    packer = packing.Packer(pool=4)
    total = 0
    for d in range(3000):
        n = int(rng.choice([1, 5, 300, 511, 512, 513, 1500, 4096, 4097, 9000]))
        total += n
        packer.add(packing.Piece(d, 0, np.zeros(n, np.uint16), n))
        assert sum(packer.tokens) <= 3 * 4 * sum(packing.TIERS)
    packer.finish()
    assert sum(size for size, _ in packer.done) == total
    assert all(sum(map(len, w)) == size for size, w in packer.done)
    assert sum(size in packing.TIERS for size, _ in packer.done) >= len(packer.done) - 12
    whole = sum(len(w) == 1 or p.start == 0 for _, w in packer.done for p in w)
    assert whole > 0.5 * sum(len(w) for _, w in packer.done)


def test_steps_are_balanced():
    rng = np.random.default_rng(2)
    windows = [(512, [packing.Piece(0, 0, np.zeros(n), n) for n in (k, 512 - k)]) for k in rng.integers(1, 511, 32)]
    cost = defaultdict(int)
    for g, (_, w) in zip(packing.steps(windows), windows):
        cost[g] += sum(len(p) ** 2 for p in w)
    assert len(cost) == 4 and max(cost.values()) < 1.2 * min(cost.values())


def test_tiers_are_powers_of_two():
    with pytest.raises(ValueError):
        packing.Packer((512, 1000))
