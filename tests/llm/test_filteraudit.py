import random
import re
from itertools import permutations

import numpy as np
import pytest

from stockloom.llm import filteraudit
from tests.llm import cases

SCHEMA = "doc_id long, text string, source string, mask string, part string, n string, digest string, least string, q string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def some_rows():
    rng = random.Random(4)
    words = ["a", "bb", "ccc", "DDD", "#x", "été", "日本", "e", "f", "g", "H"] + [f"w{i}" for i in range(80)]
    prose = lambda n, k: " ".join(rng.choice(words[-k:]) for _ in range(n))
    texts = [*cases.awkward(), *[prose(rng.choice([10, 49, 50, 51, 90]), rng.choice([10, 60, 91])) for _ in range(150)]]
    texts += [rng.choice(texts) for _ in range(80)] + ["x " * 48 + "x x", "same"] + ["same"] * 40
    rows = [(i, t, rng.choice(["s1", "s2", "", None, "s3"])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(3, texts[3], "s9"), (None, "same", "s1"), (None, "alone", "s1"), (None, "alone", None), rows[0]]


def some_labels():
    return [(i, i % 3 % 2, i % 5 // 4) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]


def failing(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = t in least and d != least[t]
        out.append({k for k, v in f.items() if v})
    return out


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failing(rows)
    out = {}
    for part in {s or "" for *_, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                lost = [x for x in left if c in x[1]]
                before = sum(c in f for _, f in own) - len(lost)
                left = [x for x in left if c not in x[1]]
                taken[c] += len(lost)
                out[part, order, step] = [len(left), len(lost), before, sum(f == {c} for _, f in own), sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost), c]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = taken[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def table_of(spark, rows):
    return spark.createDataFrame([(d, t, s, *["clash"] * 6) for d, t, s in rows], SCHEMA)


def test_against_filters_applied_one_by_one(spark):
    rows, labels = some_rows(), some_labels()
    got = filteraudit.audit(table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    have = [tuple(r) for r in got.collect()]
    assert {r[:3]: r[3:] for r in have} == plain(rows, labels) and len(have) == 600 * len({s or "" for *_, s in rows})


def test_removal_steps():
    orders, step = filteraudit.removal_steps(4)
    for o, order in enumerate(orders):
        for mask in range(16):
            assert step[o, mask] == next((i for i, f in enumerate(order, 1) if mask >> f & 1), 0)
    assert filteraudit.interactions(np.zeros((0, 16, 3), np.int64), 4).shape == (0, 24, 4, 7)


def test_sql_and_empty_tables(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    for name, rows, labels in (("some", some_rows(), some_labels()), ("none", [], [])):
        table_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for t in ("documents", "labels"):
            duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{name}/{t}.parquet/*.parquet'")
        got, want = filteraudit.op13_filter_interactions(spark, f"{tmp_path}/{name}"), duckdb.sql(filteraudit.SQL)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_other_filters(spark):
    own = [filteraudit.Filter("short", lambda words, text: len(words) < 2), filteraudit.Filter("long", lambda words, text: len(words) > 3)]
    docs = table_of(spark, [(1, "a", "s"), (2, "a b c d", "s"), (3, "a b", "s")])
    got = filteraudit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), own)
    assert {(r.filter_order, r.step): (r.kept, r.removed) for r in got.collect()} == {("shortlong", 1): (2, 1), ("shortlong", 2): (1, 1), ("longshort", 1): (2, 1), ("longshort", 2): (1, 1)}
