import hashlib
import random
import time

import numpy as np
import pyarrow as pa

from stockloom.llm import spandedup, suffixes
from tests.llm import cases


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    old = suffixes.WIDE
    try:
        for _ in range(1500):
            text = rng.integers(0, rng.integers(1, 6), rng.integers(0, 60))
            suffixes.WIDE = int(rng.choice([2, 4, 2048]))
            order = suffixes.suffix_array(text)
            line = text.tolist()
            assert order.tolist() == sorted(range(len(line)), key=lambda i: line[i:])
            most = int(rng.integers(1, 12))
            common = suffixes.permuted_prefixes(text, order, most)
            for x, y in zip(order.tolist(), order.tolist()[1:]):
                n = 0
                while n < most and max(x, y) + n < len(line) and line[x + n] == line[y + n]:
                    n += 1
                assert common[y] == n
    finally:
        suffixes.WIDE = old


def plain(rows):
    """rows: (key, text). Removed runs of each row, string by string."""
    first = {}
    for key, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    shared, base = prose(30), prose(150)
    made = [None, "", "short", base, base, base[:300] + "X" + base[300:], base[200:] + base[:100], "a" * 49, "a" * 50, "a" * 200, "ab" * 90, "ab" * 25]
    made += [prose(rng.randint(0, 20)) + shared + prose(rng.randint(0, 20)) for _ in range(40)]
    return made + [base[100:149], base[100:150], base[100:151], cases.awkward()[6], cases.awkward()[7]]


def result(frame):
    got = frame.collect()
    last = spandedup.LAST
    return sorted((last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_against_brute_force(spark):
    made = texts()
    assert result(spandedup.removal_report(cases.docs(spark, made))) == plain(list(enumerate(made)))


def test_small_limits_change_nothing(spark, monkeypatch):
    made = texts()
    monkeypatch.setattr(spandedup, "CROWD", 3)
    monkeypatch.setattr(spandedup, "SHARD", 300)
    monkeypatch.setattr(spandedup, "MOST_BITS", 12)
    assert result(spandedup.removal_report(cases.docs(spark, made))) == plain(list(enumerate(made)))


def test_null_ids_repeats_and_empty(spark):
    made = texts()[:12]
    rows = [*enumerate(made), (6, made[6]), (spandedup.LAST, made[6])]
    assert result(spandedup.removal_report(cases.messy(spark, made))) == plain(rows)
    assert spandedup.removal_report(cases.docs(spark, [])).count() == 0


def test_long_documents_come_in_overlapping_parts():
    import pyarrow as pa

    raw = " ".join(str(i * i) for i in range(3000))
    batch = pa.record_batch([pa.array([5]), pa.array([raw])], names=["key", "text"])
    whole = next(spandedup.blocks(batch))
    h, first, last, _ = spandedup.anchors(whole[0], whole[1])
    strings = {s: x for a, b, x in zip(first.tolist(), last.tolist(), h.tolist()) for s in range(a, b + 1)}
    again = {}
    for data, ends, _, offset in spandedup.blocks(batch, 700):
        h, first, last, text = spandedup.anchors(data, ends)
        for a, b, x, t in zip(first.tolist(), last.tolist(), h.tolist(), text.tolist()):
            for s in range(a, b + 1):
                at = s - int(ends[t]) + int(offset[t])
                assert at not in again
                again[at] = x
    assert strings == again


def test_prefixes_compare_whole_words_of_bytes():
    rng = np.random.default_rng(8)
    for sigma, most in ((2, 50), (257, 50), (3, 300), (1, 400)):
        text = rng.integers(0, sigma, 500)
        order = suffixes.suffix_array(text)
        got = suffixes.permuted_prefixes(text, order, most)
        for x, y in zip(order.tolist(), order[1:].tolist()):
            n = 0
            while n < most and max(x, y) + n < len(text) and text[x + n] == text[y + n]:
                n += 1
            assert got[y] == n
    assert suffixes.packed_words(np.arange(257))[2] == 7


def test_texts_are_hashed_a_little_at_a_time():
    texts = [b"ab" * 9_000, b"", b"x" * 700_000, b"c" * 30_000]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array([t.decode() for t in texts])], names=["key", "text"])
    sizes = [len(data) for data, *_ in spandedup.blocks(batch)]
    assert max(sizes) <= 1 << 18 and len(sizes) > 3


def test_common_phrases_alone_make_no_pieces(spark):
    rng = random.Random(6)
    alone = ["".join(rng.choice("abcdefgh ") for _ in range(150)) + " of the same words in " + "".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(60)]
    docs = spandedup.keyed(cases.docs(spark, alone))
    # sixteen bytes of a text are in all others, but never 33 that a repeated string needs
    assert len({(k, x) for k, t in enumerate(alone) for x in spandedup.rolling(np.frombuffer(t.encode(), np.uint8)).tolist()}) > len({x for t in alone for x in spandedup.rolling(np.frombuffer(t.encode(), np.uint8)).tolist()})
    assert spandedup.piece_rows(docs, spandedup.bit_table(spandedup.shared_anchors(docs))).count() == 0
    # one string of fifty bytes in two of them is found whatever its place
    for at in (0, 17, 34):
        made = [*alone[:5], alone[0][120 + at : 170 + at]]
        assert result(spandedup.removal_report(cases.docs(spark, made))) == plain(list(enumerate(made)))


def test_both_sides_hold_what_all_their_strings_hold():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 10, 1500, 1560, 5000])
    h, place, first, last, _ = spandedup.anchored(data, ends)
    left, right, to_left, to_right = spandedup.sides(h, place, first, last)
    raw, held = data.tobytes(), {}
    for p, a, b, x, y, n, m in zip(*(c.tolist() for c in (place, first, last, left, right, to_left, to_right))):
        assert n + m == b - a + 1 and n >= 0 and m >= 0
        for s in range(a, b + 1):
            start, side = (p - spandedup.REACH, x) if s < a + n else (p, y)
            core = raw[start : start + spandedup.GRAM + spandedup.REACH]
            assert s <= start and start + len(core) <= s + 50 and len(core) == 33
            assert held.setdefault((core, s < a + n), side) == side


def test_crowds_send_on_only_strings_of_several_documents(spark, monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdef") for _ in range(55))
    pieces = [(7, ("".join(rng.choice("abcdef") for _ in range(12)) + shared).encode(), k, k) for k in range(40)]
    sent = []
    real = spandedup.shard_runs
    monkeypatch.setattr(spandedup, "shard_runs", lambda df: sent.append(df.count()) or real(df))
    found = spandedup.crowd_runs(spark.createDataFrame(pieces, "h long, piece binary, low long, high long")).collect()
    first, last = {}, {}
    for _, p, k, _ in pieces:
        for a in range(len(p) - 49):
            first.setdefault(p[a : a + 50], k)
            last[p[a : a + 50]] = k
    assert sent == [sum(first[s] < last[s] for s in first)]
    got = {(r.id, a): r.least for r in found for a in range(r.a, r.b + 1)}
    assert got == {(spandedup.named(p), a): first[p[a : a + 50]] for _, p, _, _ in pieces for a in range(len(p) - 49) if first[p[a : a + 50]] < last[p[a : a + 50]]}
    # neighbouring strings of one piece and one document are one row
    assert len(found) < len(got) / 3


def test_words_of_bytes_compare_as_numbers_do():
    rng = np.random.default_rng(2)
    for top in (3, 200, 254, 255):
        text = np.append(rng.integers(0, top + 1, 400), top).astype(np.uint8)
        text = np.concatenate([text, text[100:300]])
        order = suffixes.suffix_array(text)
        assert order.tolist() == suffixes.suffix_array(text.astype(np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())
        assert suffixes.permuted_prefixes(text, order, 50).tolist() == suffixes.permuted_prefixes(text.astype(np.int64), order, 50).tolist()


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    jvm = spark.sparkContext._jvm
    manager = spark.sparkContext._jsc.sc().env().blockManager()
    kept = lambda: sum(1 for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_"))
    before, there = spark.conf.get(spandedup.SHUFFLES_GO, None), kept()
    made = spandedup.settled(spark.range(1000).repartition(5, "id"), "test-settled")
    for _ in range(100):  # files go in the background
        if kept() <= there:
            break
        time.sleep(0.1)
    assert kept() <= there and made.count() == 1000
    assert spark.conf.get(spandedup.SHUFFLES_GO, None) == before
