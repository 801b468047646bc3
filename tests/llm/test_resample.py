import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from stockloom.llm import ngramtable, resample
from tests.llm import cases

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, targets, percent, least, longest, buckets, seed):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, other = [features(t) for _, t in rows], [f for t in targets for f in features(t)]
    s, t = [0] * buckets, [0] * buckets
    for f in own:
        for b in f:
            s[b] += 1
    for b in other:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (doc, text), f in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc, len(plain_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def some_texts(n=300):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "x1", "été", "日本", "of", "the", "The", "q"] + [f"w{i}" for i in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 35)])
def test_against_brute_force(spark, longest, percent):
    texts = cases.awkward() + some_texts()
    targets = ["alpha beta gamma alpha", None, "x1 of the été", ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resample.drawn(cases.messy(spark, texts), target, percent, 20, longest, 500, 2024)
    rows = [*enumerate(texts), (6, texts[6]), (None, texts[6])]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == plain(rows, targets, percent, 20, longest, 500, 2024)


def test_ties_and_equal_rows_are_ranked_by_id(spark):
    rows = [(i % 50 if i < 200 else None, 7) for i in range(210)] + [(1000 + i, 9 - i % 3) for i in range(30)]
    got = [(r["rank"], -r.score, r.doc_id is None, r.doc_id or 0) for r in resample.ranked(resample.stored(spark.createDataFrame(rows, "doc_id long, score long"), "t")).collect()]
    assert sorted(r[0] for r in got) == list(range(1, 241))
    assert [r[1:] for r in sorted(got)] == sorted(r[1:] for r in got)


def test_table_keeps_equal_keys_apart(monkeypatch):
    monkeypatch.setattr(ngramtable.xxhash, "xxh64_intdigest", lambda b: len(b))
    rng = random.Random(2)
    items = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(6000)]
    tab = ngramtable.Table(100)
    for at in range(0, len(items), 1000):
        slots = tab.intern(items[at : at + 1000])
        assert [tab.entries[tab.entry[s]] for s in slots] == items[at : at + 1000]
    want = np.bincount([zlib.crc32(i) % 100 for i in items], minlength=100)
    assert (tab.bucket_counts() == want).all() and len(tab.entries) == len(set(items)) and tab.mask + 1 > 2 * len(tab.entries)


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(some_texts(40)) + " " + "日" * 500
    whole = sorted(g for _, own in ngramtable.grams(text.encode(), 3) for g in own)
    monkeypatch.setattr(ngramtable, "PIECE", 37)
    parts = list(ngramtable.grams(text.encode(), 3))
    assert len(parts) > 50 and sorted(g for _, own in parts for g in own) == whole


def test_sql_and_empty_tables(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    for name, texts in (("some", cases.awkward() + some_texts()), ("none", [])):
        cases.docs(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "alpha Beta the")] if texts else [], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        for t in ("documents", "benchmark"):
            duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{name}/{t}.parquet/*.parquet'")
        got, want = resample.op12_importance_resampling(spark, f"{tmp_path}/{name}"), duckdb.sql(resample.SQL)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
