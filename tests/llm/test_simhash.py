import random

import numpy as np
import xxhash

from stockloom.llm import simhash
from tests.llm import cases


def plain(text, k):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps):
    ids = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and ids[a] != ids[b]:
                    ids[a] = ids[b] = min(ids[a], ids[b])
                    changed = True
    return ids


def test_against_brute_force(spark):
    texts = [t if t is None or len(t) < 9000 else t[:9000] for t in cases.awkward()]
    got = {r.doc_id: r for r in simhash.near_duplicates(cases.docs(spark, texts)).collect()}
    want = {i: plain(t, 3) for i, t in enumerate(texts)}
    assert {d: r.fp % 2**64 for d, r in got.items()} == want
    assert {d: r.component_id for d, r in got.items()} == closure(want)


def test_null_ids_and_repeats(spark):
    texts = cases.awkward()[:12]
    got = simhash.near_duplicates(cases.messy(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    assert {r.component_id for r in got if r.doc_id in (6, None)} == {6}


def test_masks_cover_every_pair():
    for radius in (1, 2, 3):
        cover = simhash.masks(radius)
        rng = random.Random(1)
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(d & m == 0 for m in cover)


def test_links_of_crowded_fingerprints(spark):
    rng = random.Random(3)
    fps = {0}
    while len(fps) < 3000:  # one dense ball: buckets far above the limit
        fps.add(sum(1 << b for b in rng.sample(range(12), rng.randint(1, 12))) ^ sum(1 << b for b in rng.sample(range(40, 44), 2)))
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    old, simhash.BUCKET = simhash.BUCKET, 16
    try:
        edges = simhash.near_edges(frame).collect()
        dense = simhash.linked(np.sort(np.array(sorted(fps), np.uint64)), 2)
    finally:
        simhash.BUCKET = old
    order = sorted(fps)
    plainly = simhash.linked(np.array(order[:1000], np.uint64), 2)
    assert all(bin((e.a ^ e.b) % 2**64).count("1") <= 64 for e in edges)

    def groups(pairs):
        root = {f: f for f in order}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in order}

    near = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if (a ^ b).bit_count() <= 2]
    want = groups(near)
    assert groups((e.a % 2**64, e.b % 2**64) for e in edges) == want
    assert {f: order[dense[i]] for i, f in enumerate(order)} == want
    assert len(plainly) == 1000


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.docs(spark, [])).count() == 0
